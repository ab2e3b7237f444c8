import re
from collections import Counter

from quirework.llm import divergence as D
from llm_data import SCHEMA, odd_rows, prose


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    seen, dups = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered), n < 10 or 100 * len(covered) > 20 * n


def figures(frame):
    return sorted(map(tuple, frame.select("row.doc_id", *D.RESULT_NAMES[:6]).collect()), key=repr)


def test_base_figures(odd, corpus):
    for frame in (odd, corpus):
        rows = [(r["doc_id"], *base(r["text"])) for r in frame.collect()]
        assert figures(D.judge(frame)) == sorted(rows, key=repr)


def test_junk_goes_and_prose_stays(spark, corpus):
    words = prose(900, 200).split()
    junk = [" ".join(f"{w}%%% |" for w in words), " ".join(w.upper() + "!!" for w in words), "qzx vvk wpj " * 80, " | ".join(f"{w}{w}{i}" for i, w in enumerate(words))]
    docs = corpus.union(spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(junk)], corpus.schema))
    kept = {r["doc_id"]: r["kept"] for r in D.judge(docs).select("row.doc_id", "kept").collect()}
    assert not any(kept[1000 + i] for i in range(4))
    # Short texts stray; one in fifty may be lost.
    assert sum(not kept[i] for i in range(120)) <= 2


def test_distance_is_a_distance():
    import numpy as np

    q = np.array([0.5, 0.5, 0.0])
    d = D.js_distance(np.array([[5, 5, 0], [0, 0, 3], [0, 0, 0], [9, 1, 0]]), q)
    assert d[0] == 0 and d[1] == 1 and d[2] == 1 and 0 < d[3] < 1


def test_keep_carries_columns(clashing, empty):
    kept = D.keep(clashing)
    assert kept.columns == clashing.columns
    rows = {tuple(r) for r in clashing.collect()}
    assert kept.count() > 0 and all(tuple(r) in rows for r in kept.collect())
    assert D.keep(empty).count() == 0


def test_without_references_only_the_base_rule_decides(odd):
    from pyspark.sql import functions as F

    frame = odd.withColumn("lang", F.lit(None).cast("string"))
    for r in D.judge(frame).collect():
        assert r["kept"] == (not r["base_failed"]) and r["language"] is None
    assert len(odd_rows()) == frame.count()


def test_small_languages_are_not_judged_by_others(spark):
    english = [(i, prose(i, 3000), "en", "s", 0) for i in range(700)]
    # A two-hundredth of all text, with and without enough of its own for a reference.
    french = [(1000 + i, prose(i, 250, "fr"), "fr", "s", 0) for i in range(40)]
    for rows, known in ((french, True), (french[:3], False)):
        docs = spark.createDataFrame(english + rows, SCHEMA)
        assert ("fr" in D.references(docs)) == known
        judged = D.judge(docs.where("lang = 'fr'"), refs=D.references(docs)).collect()
        assert len(judged) == len(rows) and all(r["kept"] != r["base_failed"] for r in judged)
        assert sum(r["kept"] for r in judged) >= len(rows) - 1
        assert not known or {r["language"] for r in judged} == {"fr"}
