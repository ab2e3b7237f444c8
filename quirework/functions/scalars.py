"""Scalar expressions; everything but Unicode normalisation is a built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions import intervals

# Fixed values -----------------------------------------------------------------
KIB = 1024
MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024
UNSAFE_NAME_CHARACTERS = r'[<>:"/\\|?*]+'
RESERVED_NAMES = (
    ["CON", "PRN", "AUX", "NUL"]
    + [f"COM{i}" for i in range(1, 10)]
    + [f"LPT{i}" for i in range(1, 10)]
)
# ------------------------------------------------------------------------------


def half_even_div(numerator: Column, denominator: int) -> Column:
    """Integer division of a non-negative BIGINT, rounding halves to even, exactly."""
    whole = F.floor(numerator / F.lit(denominator)).cast("long")
    rest = numerator - whole * F.lit(denominator)
    up = (rest * 2 > denominator) | ((rest * 2 == denominator) & (whole % 2 == 1))
    return whole + up.cast("long")


def fixed_point(scaled: Column, digits: int) -> Column:
    """Text of ``scaled / 10**digits`` with exactly ``digits`` decimals."""
    unit = 10**digits
    return F.concat(
        F.floor(scaled / F.lit(unit)).cast("string"),
        F.lit("."),
        F.lpad((scaled % unit).cast("string"), digits, "0"),
    )


def human_bytes(c: Column) -> Column:
    """B2: compact byte count."""
    size = c.cast("long")
    mib_rest = size % MIB
    hundredths = (F.floor(size / F.lit(MIB)).cast("long") * 100) + half_even_div(mib_rest * 100, MIB)
    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MIB, F.concat(fixed_point(half_even_div(size * 10, KIB), 1), F.lit(" KB")))
        .otherwise(F.concat(fixed_point(hundredths, 2), F.lit(" MB")))
    )


def plain_digits(c: Column) -> Column:
    """Full-width digits as ASCII digits."""
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def parse_size(value: Column, unit: Column) -> Column:
    """Size target in bytes; null when it is no finite number, not positive or below 1 KiB."""
    text = F.regexp_replace(plain_digits(value), r"(?U)^\s+|\s+$|_", "")
    number = text.try_cast("decimal(30,12)") if hasattr(text, "try_cast") else text.cast("decimal(30,12)")
    factor = F.when(unit == "MB", F.lit(MIB)).otherwise(F.lit(KIB)).cast("decimal(7,0)")
    size = F.floor(number * factor)
    return F.when((number > 0) & (size >= KIB) & (size <= F.lit(2**63 - 1)), size.try_cast("long"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def quality_profile(score: Column) -> Column:
    """struct(image_scale, jpeg_quality, dpi) of a 0..100 score."""
    s = clamp(score.cast("double"), 0.0, 100.0)
    return F.struct(
        (F.lit(0.25) + F.lit(0.75) * s / 100).alias("image_scale"),
        F.bround(F.lit(45.0) + F.lit(53.0) * s / 100).cast("int").alias("jpeg_quality"),
        F.bround(F.lit(180.0) + F.lit(540.0) * s / 100).cast("int").alias("dpi"),
    )


def path_weight(item_arity: Column) -> Column:
    """Relative instruction cost of one vector path; scalar items count 12."""
    total = F.aggregate(
        item_arity,
        F.lit(0).cast("long"),
        lambda acc, n: acc + F.greatest(F.lit(12), F.lit(12) * (F.coalesce(n, F.lit(1)) - 1)),
    )
    return F.greatest(F.coalesce(total, F.lit(1)), F.lit(1)).cast("long")


@F.pandas_udf(StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def safe_fragment(c: Column, fallback: str, limit: int = 64) -> Column:
    """File-name-safe text."""
    text = F.regexp_replace(_nfkc(c), r"[\x00-\x1f]", "")
    text = F.regexp_replace(text, UNSAFE_NAME_CHARACTERS, "_")
    text = F.regexp_replace(text, r"(?U)\s+", "_")
    text = F.btrim(text, F.lit(" ._"))
    text = F.regexp_replace(F.substring(text, 1, limit), r"[ ._]+$", "")
    text = F.when(text == "", F.lit(fallback)).otherwise(text)
    return F.when(F.upper(text).isin(RESERVED_NAMES), F.concat(F.lit("_"), text)).otherwise(text)


def natural_key(c: Column) -> Column:
    """Sortable array; digit runs compare as numbers of any length, text by case fold."""
    folded = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")
    parts = F.regexp_extract_all(folded, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        is_text = ~p.rlike("^[0-9]")
        digits = F.regexp_replace(p, "^0+", "")
        return F.struct(
            is_text.cast("int").alias("kind"),
            F.when(is_text, F.lit(0)).otherwise(F.length(digits)).alias("digits"),
            F.when(is_text, p).otherwise(digits).alias("text"),
        )

    return F.transform(parts, part)


def natural_chunk(key: Column) -> Column:
    """A coarse prefix of ``natural_key`` that never decreases along its order."""
    first, second = F.get(key, F.lit(0)), F.get(key, F.lit(1))
    short = (F.length(first.getField("text")) <= 12)
    return F.struct(
        first.getField("kind").alias("k1"),
        first.getField("digits").alias("d1"),
        F.substring(first.getField("text"), 1, 12).alias("t1"),
        F.when(short, second.getField("kind")).alias("k2"),
        F.when(short, second.getField("digits")).alias("d2"),
        F.when(short, F.substring(second.getField("text"), 1, 2)).alias("t2"),
    )


def is_sha256(c: Column) -> Column:
    """B18."""
    return F.coalesce(c.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def strip_whitespace(c: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "")


def saved_ratio(before: Column, after: Column) -> Column:
    """Saved share, 0 for an empty source."""
    return F.when(
        before > 0, F.greatest(F.lit(0.0), F.lit(1.0) - after / F.nullif(before, F.lit(0)))
    ).otherwise(F.lit(0.0))


def ranges_text(pages: Column, sep: str = ", ") -> Column:
    """Sorted distinct zero-based pages as one-based ranges, e.g. ``1-3, 5``."""
    return intervals.text(intervals.runs_of(pages), sep)
