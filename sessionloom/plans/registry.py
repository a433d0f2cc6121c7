"""Where the queries register, with the helpers that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assemble import assemble
from .bridge import bridged

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, on: str = "tables"):
    """Registers a function of the assembled tables (``on`` tables) or of the events (``on`` events)."""
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            events = bridged(spark, sf_dir)
            return f(assemble(events) if on == "tables" else events)
        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def ms(c: str):
    return F.floor(F.unix_micros(c) / 1000).cast("long")


def on_documents(name: str, sql: str):
    """Registers a function of the documents table."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        ORACLE[name] = sql
        return f
    return add
