"""Readers, writers, in-memory sources and generators."""
