"""Scans of the supplied parquet tables.

``spark.read.parquet`` keeps the scan lazy: Catalyst prunes unused columns
(``ReadSchema``) and pushes comparison filters into the Parquet reader
(``PushedFilters``), so operators just select and filter what they need.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy scan of one supplied table; files are listed anew by each call."""
    return spark.read.parquet(table_path(sf_dir, name))
