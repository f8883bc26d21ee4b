"""Operations for large-scale training-data pipelines.

Ten self-contained operators over document tables.  Nothing outside this
subpackage imports it; ``receptory.llm.registry`` lists the queries that apply
each operator to its whole table with production parameters.
"""
