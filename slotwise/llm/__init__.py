"""Operators of a training-data pipeline, each a Spark job over whole tables.

One module per operator; ``queries.py`` holds the thin ``opN_<name>`` queries
and their DuckDB SQL.  Nothing outside this subpackage imports it except the
guarded import in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
