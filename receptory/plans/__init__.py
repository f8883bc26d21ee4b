"""Parameters, composite pipelines, the query catalog and its SQL."""
