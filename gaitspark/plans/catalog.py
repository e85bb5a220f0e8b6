"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import share_package
from . import documents, matches, motion, records, scenes, streams


def _shared(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shared(f) for name, f in (motion.QUERIES | scenes.QUERIES | records.QUERIES | streams.QUERIES | matches.QUERIES | documents.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return motion.ORACLES | scenes.ORACLES | records.ORACLES | streams.ORACLES | matches.ORACLES | documents.ORACLES
