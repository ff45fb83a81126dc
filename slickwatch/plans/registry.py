"""Where query keys meet their Spark callable and their SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slickwatch.plans import views
from slickwatch.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the views Spark derives from them, for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.spark.sql(views.spark_sql(name, self.folder))


def query(key: str, oracle: str | None = None):
    """Register a callable taking :class:`Tables`; ``oracle`` is DuckDB SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = views.duck_sql(oracle)
        return fn

    return wrap


def rnd(expr: str, digits: int = 6) -> str:
    """Half-up rounding as SQL text, same arithmetic as ``geo.rnd``."""
    return f"(floor(({expr})*1e{digits}+0.5e0)/1e{digits})"
