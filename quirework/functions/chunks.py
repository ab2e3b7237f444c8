"""Ordered per-key computations that survive a hot key.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here every key is
cut into *chunks* by a function that never decreases along the order (for example
``page_no div 4096``). The window runs inside ``(key, chunk)``; only one small total per
chunk is carried over the chunk sequence and joined back. Keys that fit in one chunk,
the usual case, have no carry, so the joined side is tiny and adaptive execution
broadcasts it after measuring it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quirework.session import stored

CHUNK = "_chunk"
CHUNK_WIDTH = 65_536


@dataclass(frozen=True)
class Scan:
    """One running value: kind is count, sum, sum_before, max or last_before."""

    kind: str
    expr: Column | None = None


def count() -> Scan:
    """Row number, starting at 1."""
    return Scan("count")


def sum_upto(expr: Column) -> Scan:
    return Scan("sum", expr)


def sum_before(expr: Column) -> Scan:
    return Scan("sum_before", expr)


def max_upto(expr: Column) -> Scan:
    return Scan("max", expr)


def last_before(expr: Column) -> Scan:
    """Last non-null value of an earlier row (``lag`` when the value is never null)."""
    return Scan("last_before", expr)


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """Shuffle by ``key``; adaptive execution sizes the partitions from the data.

    A following grouping by ``key`` reuses the shuffle.
    """
    return df.repartition(*key)


def by_width(c: Column, width: int = CHUNK_WIDTH) -> Column:
    """Chunk number of an integer ordinal."""
    return F.floor(c / F.lit(width)).cast("long")


def by_magnitude(c: Column) -> Column:
    """Chunk of a double: fine logarithmic steps, then linear steps; both follow its order."""
    return F.struct(
        F.floor(F.asinh(c) * 512).alias("log"),
        F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c)) * 8).alias("lin"),
    )


def _whole(one: Scan, upto: WindowSpec) -> Column:
    """A running value of keys that are not cut."""
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    if one.kind == "count":
        return F.row_number().over(upto).cast("long")
    if one.kind == "sum":
        return F.sum(one.expr).over(upto)
    if one.kind == "sum_before":
        return F.coalesce(F.sum(one.expr).over(before), F.lit(0))
    if one.kind == "max":
        return F.max(one.expr).over(upto)
    if one.kind == "last_before":
        return F.last(one.expr, ignorenulls=True).over(before)
    raise ValueError(f"unknown scan kind {one.kind!r}")


def scan(
    df: DataFrame,
    key: list[str],
    order: list[Column],
    chunk: Column,
    only_above: int | None = None,
    **wanted: Scan,
) -> DataFrame:
    """Add the running values ``wanted`` to ``df``.

    ``order`` must be ascending expressions that give a total order inside a key, and
    ``chunk`` must not decrease along that order. With ``only_above`` the keys are counted
    first and only larger ones are cut; use it when the chunks are fine, as the small keys
    then need no carry, and without a larger one there is none at all. The count reads ``df`` once more,
    so ``df`` should be cheap.
    """
    if only_above is not None:
        sizes = stored(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > only_above), "large-keys")
        if sizes.isEmpty():
            upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            return df.withColumns({name: _whole(one, upto) for name, one in wanted.items()})
        same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in key]
        cut = df.alias("d").join(sizes.alias("s"), same, "left").select("d.*", F.col("s._rows").isNotNull().alias("_cut"))
        return scan(cut, key, order, F.when(F.col("_cut"), chunk), **wanted).drop("_cut")
    part = [*key, CHUNK]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunked = df.withColumn(CHUNK, chunk)

    local, totals, carry = {}, [], {}
    earlier = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    for name, one in wanted.items():
        held, moved = f"_total_{name}", f"_carry_{name}"
        if one.kind == "count":
            local[name] = F.row_number().over(upto.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
            totals.append(F.count(F.lit(1)).alias(held))
            carry[moved] = F.sum(held).over(earlier)
        elif one.kind in ("sum", "sum_before"):
            frame = upto if one.kind == "sum" else before
            local[name] = F.sum(one.expr).over(frame)
            totals.append(F.sum(one.expr).alias(held))
            carry[moved] = F.sum(held).over(earlier)
        elif one.kind == "max":
            local[name] = F.max(one.expr).over(upto)
            totals.append(F.max(one.expr).alias(held))
            carry[moved] = F.max(held).over(earlier)
        elif one.kind == "last_before":
            local[name] = F.last(one.expr, ignorenulls=True).over(before)
            totals.append(
                F.max_by(one.expr, F.when(one.expr.isNotNull(), F.struct(*order))).alias(held)
            )
            carry[moved] = F.last(held, ignorenulls=True).over(earlier)
        else:
            raise ValueError(f"unknown scan kind {one.kind!r}")

    rows = chunked.withColumns(local)
    carries = (
        chunked.groupBy(*part).agg(*totals).withColumns(carry)
        .where(F.greatest(*(F.col(c).isNotNull().cast("int") for c in carry), F.lit(0)) == 1)
        .select(*part, *carry)
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in part]
    joined = rows.alias("r").join(carries.alias("c"), same, "left")

    def merged(name: str, one: Scan) -> Column:
        here, past = F.col(f"r.{name}"), F.col(f"c._carry_{name}")
        if one.kind in ("count", "sum", "sum_before"):
            total = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
            if one.kind == "sum":
                return F.when(here.isNotNull() | past.isNotNull(), total).alias(name)
            return total.alias(name)
        if one.kind == "max":
            return F.greatest(here, past).alias(name)
        return F.coalesce(here, past).alias(name)

    kept = [c for c in df.columns if c not in wanted]
    return joined.select(
        *(F.col(f"r.`{c}`") for c in kept), *(merged(n, s) for n, s in wanted.items())
    )


def order_statistics(df: DataFrame, key: list[str], value: str, **ranks: Column) -> DataFrame:
    """Exact order statistics per key; each rank is a 0-based expression over ``n``.

    Equal values are counted first, so copies cost one row; ranks come from a chunked
    running count instead of one sorted list per key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    sized = counted.join(sizes, key)
    fine = F.when(F.col("n") > CHUNK_WIDTH, by_magnitude(F.col(value).cast("double")))
    picked = scan(sized, key, [F.col(value)], fine, _first=sum_before(F.col("_n")))
    inside = {
        name: (F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n"))
        for name, rank in ranks.items()
    }
    hit = F.lit(False)
    for condition in inside.values():
        hit = hit | condition
    return (
        picked.where(hit)
        .groupBy(*key)
        .agg(F.max("n").alias("n"), *(F.max(F.when(c, F.col(value))).alias(n) for n, c in inside.items()))
    )
