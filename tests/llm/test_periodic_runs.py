"""Periodic runs against every lag of every document, compared word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st

from quirework.llm import periodic_runs as P, words as W
from quirework.llm.queries import QUERIES
from llm_data import SCHEMA, prose
import numpy as np


def smallest_period(words):
    border = [0] * (len(words) + 1)
    border[0] = -1
    k = -1
    for i, w in enumerate(words):
        while k >= 0 and words[k] != w:
            k = border[k]
        k += 1
        border[i + 1] = k
    return len(words) - border[-1]


def plain_runs(words, least=24, times=3):
    number = {w: i for i, w in enumerate(words)}
    ids, out = np.array([number[w] for w in words], dtype=np.int64), []
    for q in range(1, len(words) // times + 1):
        differ = np.concatenate([[-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]])
        for k in np.flatnonzero(np.diff(differ) - 1 + q >= max(least, times * q)).tolist():
            start, length = int(differ[k]) + 1, int(differ[k + 1] - differ[k]) - 1 + q
            if length > q and smallest_period(words[start : start + length]) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def as_hashes(rows):
    flat = [w for row in rows for w in row]
    number = {w: i for i, w in enumerate(sorted(set(flat)))}
    h = W.mix(np.array([number[w] for w in flat], dtype=np.uint64) + np.uint64(1)) if flat else np.zeros(0, np.uint64)
    return h, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def found(rows, least=24, times=3):
    got = P.find(*as_hashes(rows), least, times).tolist()
    return [[(s, length, q) for r, s, length, q in got if r == k] for k in range(len(rows))]


BLOCKS = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 9)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(BLOCKS, max_size=4))
def test_all_runs_of_repeated_blocks(rows):
    rows = [[w for block, n in row for w in block * n] for row in rows]
    assert found(rows) == [plain_runs(r) for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90), max_size=4), st.integers(6, 30), st.integers(3, 5))
def test_other_limits(rows, least, times):
    rows = [r * 3 for r in rows]
    assert found(rows, least, times) == [plain_runs(r, least, times) for r in rows]


def test_grams_that_occur_twice_within_a_period():
    """A primitive block in which every gram of 16 words stands twice."""
    rng = random.Random(3)
    hub, p, r, s = ([f"{name}{i}" for i in range(20)] for name in "hprs")
    block = hub + p + hub + r + hub + s + hub + p + hub + s + hub + r
    row = [str(rng.random()) for _ in range(50)] + block * 3 + block[:7] + ["end"]
    assert found([row, row[::-1], ["x"] * 5000])[2] == [(0, 5000, 1)]
    assert found([row, row[::-1]]) == [plain_runs(row), plain_runs(row[::-1])]


def test_query_against_plain_rows(spark, odd, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rows += [(i, prose(i, 20 + i % 300)) for i in range(100, 400)]
    rows += [(i, "a b c d " * i + prose(i, 40) + " x y" * i) for i in range(400, 440)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_clashing_columns_and_empty_table(spark, clashing, empty):
    got = P.periodic_runs(clashing, tuple(clashing.columns)).select("row.*", "runs", "collapsed")
    assert got.columns == [*clashing.columns, "runs", "collapsed"] and got.count() == clashing.count()
    assert P.periodic_runs(empty).count() == 0


def test_limits_are_checked(empty):
    with pytest.raises(ValueError):
        P.find(*as_hashes([["a"]]), times=2)
    assert SCHEMA.startswith("doc_id long, text string") and P.guaranteed(24, 3) == 16
