"""Scans (A1 - A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework import schemas
from quirework.functions import scalars


def describe(size: Column, digest: Column | None = None) -> list[Column]:
    """Size in bytes, MiB with three decimals, and the upper-case digest."""
    cols = [size.alias("size_bytes"), F.bround(size / scalars.MIB, 3).alias("size_mib")]
    return cols if digest is None else [*cols, F.upper(digest).alias("sha256")]


def file_inventory(spark: SparkSession, path: str, glob: str = "*.pdf", with_hash: bool = False) -> DataFrame:
    """A1: one row per non-empty file below ``path``; the content is read only for the digest."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    digest = F.sha2("content", 256) if with_hash else None
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), *describe(F.col("length"), digest),
    )


def load_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A2: one extracted table under its explicit schema."""
    return spark.read.schema(schemas.TABLES[name]).format(fmt).load(f"{path.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet", names: list[str] | None = None) -> dict[str, DataFrame]:
    """A2: the extracted tables ``names`` (default all), parquet or JSON."""
    return {name: load_table(spark, path, name, fmt) for name in names or schemas.TABLES}


def load_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Whole-file reports, or one report per line with ``multi_line=False``."""
    return spark.read.schema(schemas.REPORT).json(path, multiLine=multi_line)


def load_runs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A3: one row per benchmark run; ``run_no`` is its place in the report."""
    return load_reports(spark, path, multi_line).select(F.posexplode("runs").alias("run_no", "r")).select(
        F.col("r.case").alias("case_name"), "r.label", "run_no", "r.seconds", "r.pages", "r.bytes",
        F.col("r.target").alias("target_bytes"), "r.native", "r.link_count", "r.text_preserved", "r.render_hashes",
    )


def load_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """A3: one row per named fixture of a report."""
    rows = F.array(*(F.struct(F.lit(n).alias("fixture"), F.col(f"fixtures.{n}").alias("f")) for n in schemas.FIXTURE_NAMES))
    return load_reports(spark, path).select("label", F.explode(rows).alias("x")).select(
        "label", "x.fixture", "x.f.name", "x.f.bytes", "x.f.pages", "x.f.sha256"
    ).where("sha256 IS NOT NULL")
