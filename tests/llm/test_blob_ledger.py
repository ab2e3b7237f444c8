"""The ledger's findings against plain regular expressions, and what each further scan has to do."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quirework.llm import blob_ledger as B, words as W
from quirework.llm.queries import ORACLES, QUERIES
from quirework.session import fresh_dir
from llm_data import SCHEMA, prose
import numpy as np
import pyarrow as pa

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
PLAIN = {
    "assign": lambda t: [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 6],
    "access": lambda t: [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
    "hex": lambda t: [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24],
    "forge": lambda t: [m.span() for m in re.finditer(r"gh[opsur]_[A-Za-z0-9]{36,}", t)],
    "key_block": lambda t: [m.span() for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", t)],
}
SECRETS = [
    "password: hunter22", "PassWord = 'aB3+/_.=-x'", "api_key:=x", "APIKEY='\"", "ſecret=abcdefgh", "toKen=abcdefg", "token==12345", "token  :  \"abc",
    "AKIA" + "Q7" * 9, "AKIAAKIA" + "0" * 12, "AKIA1", "AKIA", "0123456789abcdef01234567", "0123456789abcdef0123456", "f" * 60, "ghp_" + "a1B2" * 9, "ghp_x",
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "é😀", "https://me:pw@host", "\n", " ", "x", "secret=ab;secret=abcdefg", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9,
    "Bearer " + "t0" * 11 + "==",
]


def plain(text):
    return sorted((a, list(PLAIN).index(k), k, b) for k, f in PLAIN.items() for a, b in f(text or ""))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(SECRETS), max_size=8).map("".join)), max_size=6))
def test_spans_equal_plain_expressions(texts):
    kinds = [r.kind for r in B.RULES]
    for low, high, data, bounds in W.blocks(pa.array(texts, pa.string()), 100):
        got = B.find(B.RULES, data, bounds, np.ones((high - low, len(kinds)), dtype=bool))
        for r in range(low, high):
            assert [(a, kinds[k], b) for row, a, b, k in got if row == r - low and kinds[k] in PLAIN] == [(a, k, b) for a, _, k, b in plain(texts[r])]


def rows():
    out = [(i, "".join(SECRETS[(i * k) % len(SECRETS)] + " " for k in range(1, 9)), "en", "s", 0) for i in range(60)]
    out += [(100 + i, out[3][1], "en", "s", 0) for i in range(40)]
    return out + [out[5], (None, out[5][1], None, None, None), (None, None, None, None, None), (7000, "", "en", "s", 0), (7001, prose(3, 9000) + " password=abcdefgh", "en", "s", 0)]


def test_query_against_plain_expressions_and_sql(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op11_blob_ledger"](spark, str(tmp_path)).collect()), key=str)
    assert len(got) == len(rows())
    by_id = {r[0]: r[1] for r in rows() if r[0] is not None}
    for doc_id, n_assign, n_access, n_hex, base, spans in got:
        if doc_id is None:
            continue
        want = [s for s in plain(by_id[doc_id]) if s[1] < 3]
        assert [n_assign, n_access, n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert base == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [s for s in spans.split(",") if s.split(":")[0] in PLAIN] == [s for s in joined(plain(by_id[doc_id])).split(",") if s]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT DISTINCT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    want = sorted(db.sql(ORACLES["op11_blob_ledger"]).fetchall(), key=str)
    assert sorted({g for g in got if g[0] is not None}, key=str) == want


def test_only_unseen_pairs_are_scanned(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    first, second = docs.where("doc_id < 30 OR doc_id IS NULL"), docs
    path = fresh_dir(spark, "ledger-test")
    distinct = lambda some: some.select(F.coalesce("text", F.lit(""))).distinct().count()
    base = B.BASE
    assert B.update(first, path, base) == distinct(first)
    assert B.update(first, path, base) == 0
    assert B.update(second, path, base) == distinct(second) - distinct(first)
    entries = B.ledger(spark, path).count()
    assert entries == distinct(second)
    # A changed rule has a new version: every blob is scanned again, for that rule alone.
    changed = (base[0], B.Rule("access", r"(AKIA[A-Z0-9]+)", 5, ("AKIA",)), base[2])
    assert B.update(second, path, changed) == distinct(second)
    again = B.ledger(spark, path).where(F.array_contains("versions", changed[1].version))
    assert again.where("size(versions) <> 1").count() == 0 and again.count() == distinct(second)
    assert B.update(second, path, changed) == 0
    # Both rule sets can be read from the one ledger.
    fresh = fresh_dir(spark, "ledger-test")
    B.update(second, fresh, changed)
    for rules, other in ((changed, fresh), (base, path)):
        a = B.findings(second, path, rules).select("row.doc_id", "spans").collect()
        b = B.findings(second, other, rules).select("row.doc_id", "spans").collect()
        assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(rows())
    # A repeated append leaves equal entries, which are read once.
    B.ledger(spark, path).limit(20).write.mode("append").parquet(path)
    a = B.findings(second, path, base).select("row.doc_id", "spans").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_odd_rows_clashing_columns_and_empty_table(spark, odd, clashing, empty):
    path = fresh_dir(spark, "ledger-test")
    assert B.update(empty, path) == 0 and B.findings(empty, path).count() == 0
    assert B.update(clashing, path, paths=tuple(clashing.columns)) == clashing.select(F.coalesce("text", F.lit(""))).distinct().count()
    got = B.findings(clashing, path, paths=tuple(clashing.columns)).select("row.*", "spans")
    assert got.columns == [*clashing.columns, "spans"] and got.count() == clashing.count()
    assert B.findings(odd, path).count() == odd.count()
    with pytest.raises(ValueError):
        B.update(odd, path, (B.BASE[0], B.BASE[0]))
