"""Named queries and, where SQL can say the same, the statement they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.plans import fixtures
from quirework.session import configure


class Tables:
    """Access to the driver tables and their projections for one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixtures.frame(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


WITH = "WITH RECURSIVE "


def with_views(sql: str, views: tuple[str, ...], extra: str = "") -> str:
    """Put the projections (and further common tables) in front of a statement."""
    heads = [h for h in (fixtures.sql_views(*views), extra.strip().rstrip(",")) if h]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        heads.append(body[5:])
        return WITH + ",\n".join(heads)
    return (WITH + ",\n".join(heads) + "\n" if heads else "") + body


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), extra: str = ""):
    """Register the decorated function as a query; ``sql`` is its check."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(configure(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, views, extra)
        return build

    return register
