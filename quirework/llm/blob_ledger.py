"""Secret scan with an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its bytes. The ledger, a Parquet folder that
only grows, says which blob was scanned under which version of which rule and what was found. A scan
addresses all rows, looks up the ledger, brings the text of each blob that lacks a current rule version
once, however many paths hold it, scans it for the missing rules only, appends, and joins the findings
back to all paths.

Only addresses are grouped, with partial sums, so a text that very many rows share costs its copies'
addresses; its text is shuffled once. What an interrupted or repeated append leaves twice is equal and
is read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirework.llm import words as W
from quirework.llm.carry import name as column_named
from quirework.llm.registry import query, read
from quirework.session import discard, fresh_dir

# A scan of less than this part of the rows leaves the join's form to Spark.
FEW = 20

SPAN = "struct<version: string, kind: string, start: long, stop: long>"
ENTRY = f"blob binary, versions array<string>, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; those with a last group below ``least`` are dropped.

    The pattern works on ASCII bytes. ``anchors`` are strings of which any match holds one; without
    them a match is a run of bytes of ``alphabet``, ``least`` long. ``either_case``: letters match in
    either case; pattern and anchors are then written in lower case.
    """

    kind: str
    pattern: str
    least: int = 1
    anchors: tuple[str, ...] = ()
    alphabet: str = ""
    either_case: bool = False

    @property
    def version(self) -> str:
        """An address of everything that decides the rule's findings."""
        parts = (self.kind, self.pattern, str(self.least), *self.anchors, "", self.alphabet, str(self.either_case))
        return f"{self.kind}-{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()[:16]}"


# The base kinds in their order.
BASE = (
    Rule("assign", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)", 6, ("password", "passwd", "secret", "token", "api"), either_case=True),
    Rule("access", r"(AKIA[A-Z0-9]+)", 20, ("AKIA",)),
    Rule("hex", r"([0-9a-f]+)", 24, alphabet="0123456789abcdef"),
)
# Further public token formats.
MORE = (
    Rule("forge", r"(gh[opsur]_[A-Za-z0-9]{36,})", 40, ("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("chat", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 15, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 32, ("eyJ",)),
    Rule("bearer", r"bearer\x20+([a-z0-9._~+/-]{20,}=*)", 20, ("bearer",), either_case=True),
    Rule("address", r"([a-z]{2,10}://[A-Za-z0-9._%+-]{1,100}:[A-Za-z0-9._%+!$*-]{1,100}@)", 1, ("://",)),
    Rule("key_block", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, ("-----BEGIN ",)),
)
RULES = BASE + MORE


def _rows_of(places: list[int], bounds: np.ndarray) -> np.ndarray:
    return np.unique(np.searchsorted(bounds, np.array(places, dtype=np.int64), "right") - 1)


def _where(raw: bytes, anchor: bytes) -> list[int]:
    out, at = [], raw.find(anchor)
    while at >= 0:
        out.append(at)
        at = raw.find(anchor, at + 1)
    return out


def _likely(rule: Rule, raw: bytes, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The rows that can hold a match."""
    if rule.anchors:
        return _rows_of([at for anchor in rule.anchors for at in _where(raw, anchor.encode())], bounds)
    if rule.alphabet:
        known = set(rule.alphabet.encode())
        starts, ends, _ = W.spans(data, bounds, W.table(lambda b: b in known))
        return _rows_of(starts[ends - starts >= rule.least].tolist(), bounds)
    return np.arange(len(bounds) - 1)


def find(rules: Sequence[Rule], data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, stop, rule) of all findings, in characters; ``wanted`` says which rules each row takes (rows x rules)."""
    lower = W.LOWER[data]
    raws = {False: data.tobytes(), True: lower.tobytes()}
    chars = np.concatenate([[0], np.cumsum(~W.CONTINUATION[data])])
    out = []
    for k, rule in enumerate(rules):
        raw, pattern = raws[rule.either_case], re.compile(rule.pattern.encode())
        for r in _likely(rule, raw, lower if rule.either_case else data, bounds).tolist():
            if not wanted[r, k]:
                continue
            low = int(bounds[r])
            for match in pattern.finditer(raw[low : int(bounds[r + 1])]):
                a, b = match.span(1)
                if b - a >= rule.least:
                    out.append((r, int(chars[low + match.start()] - chars[low]), int(chars[low + match.end()] - chars[low]), k))
    return sorted(out)


def blob(text: Column) -> Column:
    """The address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries so far; none if nothing was written yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(path)


def _scanner(rules: Sequence[Rule]):
    versions = [rule.version for rule in rules]
    number = {v: k for k, v in enumerate(versions)}

    def scan(batches):
        for batch in batches:
            for low, high, data, bounds in W.blocks(batch.column(2)):
                missing = batch.column(1).slice(low, high - low)
                lists = missing.to_pylist()
                wanted = np.zeros((high - low, len(rules)), dtype=bool)
                for r, some in enumerate(lists):
                    wanted[r, [number[v] for v in some]] = True
                found = find(rules, data, bounds, wanted)
                firsts = np.searchsorted(np.array([f[0] for f in found], dtype=np.int64), np.arange(high - low + 1))
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array([versions[f[3]] for f in found], pa.string()), pa.array([rules[f[3]].kind for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                    ],
                    names=["version", "kind", "start", "stop"],
                )
                listed = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(lists, pa.list_(pa.string())), listed], names=["blob", "versions", "spans"])

    return scan


def update(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, paths: tuple[str, ...] = ("doc_id",)) -> int:
    """Scan what the ledger at ``path`` lacks for the texts of ``docs`` and append it; returns the blobs scanned.

    One scan at a time may write to a ledger. The columns ``paths`` name a version; of the rows that
    hold a blob the one with the smallest hash of them brings the text. An empty table adds nothing.
    """
    spark = docs.sparkSession
    versions = [rule.version for rule in rules]
    if len(set(versions)) < len(versions):
        raise ValueError("two rules are the same")
    texts = docs.select(blob(F.col("text")).alias("blob"), F.xxhash64(*map(column_named, paths)).alias("bearer"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = texts.groupBy("blob").agg(F.min("bearer").alias("bearer"))
    done = ledger(spark, path).select("blob", F.explode("versions").alias("version")).groupBy("blob").agg(F.collect_set("version").alias("done"))
    current = F.array(*map(F.lit, versions))
    missing = F.array_except(current, F.coalesce("done", F.array().cast("array<string>")))
    pending = fresh_dir(spark, "blobs-pending")
    blobs.join(done, "blob", "left").select("blob", "bearer", missing.alias("missing")).where(F.size("missing") > 0).write.parquet(pending)
    todo = spark.read.parquet(pending)
    count = todo.count()
    if count:
        # Where little is new, Spark may send it to the rows, by its measured size; else both are shuffled.
        if count * FEW > docs.count():
            todo = todo.hint("merge")
        brought = texts.join(todo, ["blob", "bearer"]).dropDuplicates(["blob", "bearer"])
        brought.select("blob", "missing", "text").mapInArrow(_scanner(rules), ENTRY).write.mode("append").parquet(path)
    discard(spark, pending)
    return count


def findings(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, paths: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (the columns ``paths``), ``blob`` and ``spans`` (kind, start, stop; by start, then by the rules' order) of every row.

    Characters count from 0, ``stop`` is exclusive. Texts without findings, empty and null ones have an
    empty list; equal rows have equal results. Findings of other rule versions are left out.
    """
    rank = F.create_map(*(part for k, rule in enumerate(rules) for part in (F.lit(rule.version), F.lit(k))))
    one = ledger(docs.sparkSession, path).where(F.size("spans") > 0).select("blob", F.explode("spans").alias("span"))
    one = one.where(F.col("span.version").isin([rule.version for rule in rules]))
    span = F.struct(F.col("span.start").alias("start"), rank[F.col("span.version")].alias("rank"), F.col("span.kind").alias("kind"), F.col("span.stop").alias("stop"))
    found = one.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("found"))
    rows = docs.select(F.struct(*(column_named(p).alias(p) for p in paths)).alias("row"), blob(F.col("text")).alias("blob"))
    spans = F.transform(F.coalesce("found", F.array().cast("array<struct<start: long, rank: int, kind: string, stop: long>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.join(found, "blob", "left").select("row", "blob", spans.alias("spans"))


def _sql() -> str:
    """The same from pieces between matches, whose lengths give the places."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = []
    for k, rule in enumerate(RULES):
        text = f"translate(t, '{upper}', '{lower}')" if rule.either_case else "t"
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex({text}, '{pattern}') AS gaps, "
            f"regexp_extract_all({text}, '{pattern}', 0) AS hits, regexp_extract_all({text}, '{pattern}', 1) AS values FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT doc_id, rank, kind, length(values[i]) AS size, least, length(hits[i]) AS wide,
  list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x)))::BIGINT, 0) AS start FROM p),
f AS (SELECT doc_id, rank, kind, start, kind || ':' || start || ':' || (start + wide) AS span FROM s WHERE size >= least),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op11_blob_ledger", _sql())
def op11(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = fresh_dir(spark, "blob-ledger")
    update(docs, path)
    found = findings(docs, path)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([rule.kind for rule in BASE]))
    return found.select("row.doc_id", *(of(rule.kind) for rule in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
