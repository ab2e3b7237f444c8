import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_data import SCHEMA, prose
from quirework.llm import shingle_join as J, simhash_tree


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(rows):
    """The smallest key of each component, by comparing all pairs of sets."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            label[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted(least.values())


def edited_copies():
    """Originals, copies with changed words, heads and tails, a large group with a common line, and short texts."""
    rng = random.Random(8)
    texts = [prose(i, 40 + 9 * i) for i in range(40)]
    for i in range(40):
        for edits in (1, 2, 4):
            words = texts[i].split(" ")
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(999)}"
            texts.append(" ".join(words))
        texts.append("A new head of four words " + texts[i])
    base = prose(700, 300).split(" ")
    for k in range(60):
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = f"other{rng.randrange(999)}"
        texts.append(" ".join(words))
    line = " Terms and conditions of this common line apply to every page of it alike"
    texts += [prose(800 + i, 30 + i) + line for i in range(50)]
    texts += ["", None, "one two", "One  two", "one two three", texts[3], texts[3].upper()]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [2, 32])
def test_stage_equals_brute_force_on_edited_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(J, "LONG_LIST", limit)
    rows = edited_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors(rows)


def test_odd_tables(odd, clashing, empty):
    for frame in (odd, clashing):
        assert J.one_of_each(frame).columns == frame.columns
        assert J.one_of_each(frame).count() == len({shingles(r["text"]) for r in frame.collect()})
    assert J.one_of_each(empty).count() == 0


def test_operator_8_names_candidates(spark):
    """Each set is held against the smallest of its fingerprint's component, as operator 8 finds it."""
    base = prose(900, 3000)
    texts = [base, base + " end", base.replace(" ", "  ", 1), prose(901, 60), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["row"]["doc_id"]: r["component_id"] for r in simhash_tree.near_duplicates(docs).collect()}
    prints = J._with_sets(docs, "doc_id")
    sets = {r["id"]: r["set_id"] for r in prints.collect()}
    assert found[0] == found[1] and sets[0] != sets[1] and sets[0] == sets[2]
    assert [tuple(r) for r in J._within_radius(prints).collect()] == [tuple(sorted((sets[0], sets[1])))]


@pytest.mark.parametrize("candidates", ["none", "one component"])
def test_result_does_not_depend_on_the_candidates_of_operator_8(spark, monkeypatch, candidates):
    """the join of the sets finds every pair by itself, also those of a component whose smallest set is unlike both."""
    own = J._within_radius
    as_one = lambda prints: own(prints.withColumn("fp", F.lit(0).cast("long")))
    none = lambda prints: own(prints).where("false")
    monkeypatch.setattr(J, "_within_radius", as_one if candidates == "one component" else none)
    rows = edited_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    if candidates == "one component":
        prints = J._with_sets(docs, "doc_id")
        sets = {r["set_id"] for r in prints.where("size > 0").select("set_id").collect()}
        found = [tuple(r) for r in J._within_radius(prints).collect()]
        assert {u for u, _ in found} == {min(sets)} and len(found) == len(sets) - 1
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors(rows)


def test_texts_stay_where_they_are_stored(spark):
    """Rows are found by their numbers; only numbers are shuffled."""
    rows = edited_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = J.one_of_each(docs)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    prints = J._with_sets(docs, "doc_id").select("id", "at")
    stored = {r["at"]: r["id"] for r in prints.collect()}
    for some in (sorted(stored)[::7], [min(stored)], []):
        numbers = spark.createDataFrame([(at,) for at in some], "at long")
        assert sorted(r["id"] for r in J._rows_at(prints, numbers).collect()) == sorted(stored[at] for at in some)


def test_members_without_a_possible_partner_leave_the_list():
    """Of a list of unlike sets and two near ones only the two are compared again."""
    rng = np.random.default_rng(1)
    gram = np.sort(rng.integers(1, 1 << 62, 1200).astype(np.uint64))
    sets = [gram[:200], gram[2:202], gram[400:600], gram[800:1000]]
    flat, firsts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    names = pa.array([1, 2, 3, 4])
    batch = pa.RecordBatch.from_arrays([pa.array([9] * 4), pa.array([200 << 32] * 4), names, names, J._parities(flat, firsts)], names=["gram", "spot", "node", "root", "parities"])
    found = pa.Table.from_batches(J._candidates(True)([batch])).to_pylist()
    assert {(r["u"], r["v"]) for r in found if r["gram"] is None} == {(1, 2)}
    assert sorted((r["gram"], r["u"], r["spot"]) for r in found if r["gram"] is not None) == [(9, 1, 200 << 32), (9, 2, 200 << 32)]
    alone = J._candidates(False)([batch])
    assert [(r["gram"], r["u"], r["v"]) for one in alone for r in one.to_pylist()] == [(None, 1, 2)]
