"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and
their SQL, which ``__spark_entry__.py`` adds only when this folder is present.
"""
