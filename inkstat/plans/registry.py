"""Registration of named queries together with their DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.session import configure, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# moves values such as n/64 off the rounding tie, where the last bit would decide
NUDGE = 1e-10


class Tables:
    """Lazy access to the parquet tables of one scale: ``t.lineitem`` is an unread scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        # text is parsed right behind the scan, so a scan of one split would be a job of one task
        return spread(table, "doc_id") if name == "documents" else table


def query(name: str, sql: str | None = None, floats: tuple[str, ...] | str = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``floats`` lists the DOUBLE results whose last bits depend on the summation order; both
    sides round them to six places.
    """
    cols = tuple(floats.split()) if isinstance(floats, str) else tuple(floats)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(F.col(c).cast("double") + F.lit(NUDGE), 6) + F.lit(0.0) for c in cols}) if cols else out

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            fixed = ", ".join(f"round(CAST({c} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {c}" for c in cols)
            ORACLES[name] = f"SELECT * REPLACE ({fixed}) FROM ({sql}) AS q" if cols else sql
        return fn

    return register
