import json
import re
from itertools import combinations

import numpy as np
import xxhash

from llm_data import SCHEMA, odd_rows, prose
from quirework.llm import components as C, license_join as L, qgram_bands as Q, simhash_tree as S, tool_calls as T


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, radius=2):
    """Component (smallest position) of each fingerprint, by comparing all pairs."""
    distinct = sorted(set(prints))
    label = {p: p for p in distinct}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            label[find(a)] = find(b)
    return [find(p) for p in prints]


def test_near_duplicates_equal_brute_force(odd, corpus):
    for frame in (odd, corpus):
        rows = S.near_duplicates(frame, ("doc_id", "text")).collect()
        assert len(rows) == frame.count()
        prints = [fingerprint(r["row"]["text"]) for r in rows]
        assert [r["fp"] & (2**64 - 1) for r in rows] == prints
        least = {}
        roots = grouped(prints)
        for r, root in zip(rows, roots):
            i = r["row"]["doc_id"]
            if i is not None:
                least[root] = min(least.get(root, i), i)
        assert [r["component_id"] for r in rows] == [least.get(root) for root in roots]


def test_links_of_crowded_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    # Many fingerprints that share 40 bits, so that shards are large and split.
    center = int(rng.integers(0, 2**63))
    prints = [center ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False)) for _ in range(600)]
    prints += [int(x) for x in rng.integers(0, 2**63, 200)] + [0, 1, 3, 2**63 - 1]
    distinct = sorted(set(prints))
    frame = spark.createDataFrame([(p,) for p in distinct], "fp long")
    for limit in (S.LARGE_SHARD, 20):
        monkeypatch.setattr(S, "LARGE_SHARD", limit)
        found = {r["node"]: r["root"] for r in C.components(S.near_links(frame)).collect()}
        want = grouped(distinct)
        mine = [found.get(p, p) for p in distinct]
        assert len(set(zip(mine, want))) == len(set(want)) == len(set(mine))


def test_tree_search_finds_every_neighbour():
    rng = np.random.default_rng(6)
    fp = np.sort(rng.integers(0, 1 << 16, 300).astype(np.uint64) << np.uint64(7))
    shard = np.repeat([1, 2, 3], 100)
    q, node = S.Forest(shard, fp).search(np.arange(300), 3)
    got = set(zip(q.tolist(), node.tolist()))
    want = {(a, b) for a in range(300) for b in range(300) if a != b and shard[a] == shard[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert got == want


def test_one_of_each(corpus, odd, clashing, empty):
    for frame in (corpus, odd, clashing):
        kept = S.one_of_each(frame)
        assert kept.columns == frame.columns
        rows = kept.collect()
        roots = grouped([fingerprint(r["text"]) for r in frame.collect()])
        assert len(rows) == len(set(roots)) == len(set(grouped([fingerprint(r["text"]) for r in rows])))
    assert S.one_of_each(empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges + [(5, 5), (None, 3)], "u long, v long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


NOTICES = [
    "x\nLicensed under the Apache License, Version 2.0\ny", "MIT License", "mit\nlicense", "Licensed under CC BY-NC 4.0.", "Licensed under\nCC BY-NC 4.0.",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the \"Software\")",
    "Permission is hereby granted, free of charge", "the GNU General Public License and the GNU Lesser General Public License", "a general public   license. General-Public-License",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted\n\nprovided that the following conditions are met",
]


def scanned(text, templates=L.TEMPLATES, contained=L.CONTAINED):
    words = L.words_of(text or "")
    spots, base = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        spots += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if spots else 0.0
    for label, unit, wording in templates:
        want = set(L.words_of(wording))
        step = L.REACH[unit]
        for i in range(0, len(words), step):
            share = len(want & set(words[i : i + 2 * step])) / len(want)
            if share >= contained - 1e-9:
                labels.add(label)
                score = max(score, share)
    return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licences_equal_brute_force(spark, odd, clashing, empty):
    docs = odd.union(spark.createDataFrame([(100 + i, t, "en", "s", 0) for i, t in enumerate(NOTICES)], SCHEMA))
    names = [part.split()[0] for part in L.RESULT.split(", ")]
    for contained in (L.CONTAINED, 0.5):
        got = [(r["row"]["doc_id"], *(r[n] for n in names)) for r in L.scan(docs, contained=contained).collect()]
        want = [(r["doc_id"], *scanned(r["text"], contained=contained)) for r in docs.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert L.scan(empty).count() == 0
    assert L.scan(clashing, ("score", "row")).select("row.*").columns == ["score", "row"]


def test_wrapped_notices_and_scattered_words(spark):
    isc = L.words_of(next(text for label, _, text in L.TEMPLATES if label == "isc"))
    cases = {
        "see the GNU Lesser General Public\nLicense for": {"gpl", "lgpl"}, "GNU Affero\r\n\r\nGeneral\nPublic License": {"gpl", "agpl"},
        "licensed under a Creative Commons\n# Attribution 4.0\n# International License.": {"cc-by"},
        " ".join(f"{w} some other words that stand between" for w in isc): set(),
    }
    texts = [(" ".join(["word"] * k) + " " + text, labels) for text, labels in cases.items() for k in range(0, 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, (t, _) in enumerate(texts)], SCHEMA)
    got = {r["row"]["doc_id"]: r["labels"] for r in L.scan(docs).collect()}
    assert got == {i: ",".join(sorted(labels)) for i, (_, labels) in enumerate(texts)}


def test_set_join_equals_brute_force():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    templates = [(str(i), "short" if i % 2 else "long", " ".join(rng.choice(words, rng.integers(3, 12), replace=False))) for i in range(25)]
    index = L.build(templates, {w: int(rng.integers(1, 50)) for w in words}, 0.7)
    ranked = np.argsort(index.number)
    number = {int(h): int(n) for h, n in zip(index.hashes, index.number)}
    of = {w: number[int(L._hash([w])[0])] for w in words}
    blocks = [set(rng.choice(words, rng.integers(1, 30), replace=False)) for _ in range(200)]
    block = np.array([b for b, s in enumerate(blocks) for _ in s])
    word = np.array([of[w] for s in blocks for w in s])
    for short in (True, False):
        got = set(zip(*(x.tolist() for x in L.join(index, block, word, short))))
        want = set()
        for b, s in enumerate(blocks):
            for t, (_, unit, text) in enumerate(templates):
                shared = len(s & set(text.split()))
                if (unit == "short") == short and shared >= np.ceil(0.7 * len(text.split()) - 1e-9):
                    want.add((b, t, shared))
        assert got == want and len(ranked) == len(words)


ITEMS = [prose(700 + i, 45) for i in range(6)] + [prose(707, 45, "fr"), "too short", None, "", prose(700, 45)]


def typos(text, every, rng):
    out = list(text)
    for i in range(every // 2, len(out), every):
        out[i] = rng.choice(["x", "", out[i] + "q"])
    return "".join(out)


def test_leaks(spark, corpus):
    import random

    rng = random.Random(1)
    planted = {
        1000: prose(800, 80) + " " + ITEMS[1] + " " + prose(801, 30), 1001: ITEMS[2].upper().replace(" ", "  "), 1002: prose(802, 50) + typos(ITEMS[3], 40, rng),
        1003: ITEMS[4][: len(ITEMS[4]) * 3 // 4], 1004: ITEMS[6] + "\n" + ITEMS[5], 1005: prose(803, 20) + ITEMS[0] + prose(804, 20000),
    }
    docs = corpus.union(spark.createDataFrame([(k, v, "en", "s", 0) for k, v in planted.items()], SCHEMA))
    benchmark = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    found = Q.leaks(docs, benchmark).select("row.doc_id", "item_key", "edits", "start", "stop").collect()
    assert {(r["doc_id"], r["item_key"]) for r in found} == {(1000, 1), (1001, 2), (1002, 3), (1003, 4), (1004, 5), (1004, 6), (1005, 0), (1005, 10)}
    span = {(r["doc_id"], r["item_key"]): planted[r["doc_id"]][r["start"] : r["stop"]] for r in found}
    assert len(set(L.words_of(ITEMS[1])) - set(L.words_of(span[1000, 1]))) <= 2
    kept = {r["doc_id"] for r in Q.clean(docs, benchmark).collect()}
    assert kept == {r["doc_id"] for r in corpus.collect()}
    # The same with an index in several shards.
    limit, Q.MOST_BYTES = Q.MOST_BYTES, 500
    try:
        again = Q.leaks(docs, benchmark).select("row.doc_id", "item_key", "edits", "start", "stop").collect()
    finally:
        Q.MOST_BYTES = limit
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def sellers(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_every_window_within_its_budget_is_found():
    import random

    rng = random.Random(8)
    index = Q.build([t for t in ITEMS if t])
    for trial in range(40):
        item = rng.choice(ITEMS[:7])
        text = prose(900 + trial, 30) + " " + typos(item, rng.choice([9, 14, 25, 60]), rng) + " " + prose(950 + trial, 30)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        clean, low_, high, _ = Q.normalized(data, np.array([0, len(data)]))
        row, window, edits, _ = Q.search(index, clean, low_, high)
        best = {}
        for w, e in zip(window.tolist(), edits.tolist()):
            best[w] = min(e, best.get(w, 99))
        for w in range(len(index.items)):
            least = sellers(index.windows[w, : index.lengths[w]].tolist(), clean[: high[0]].tolist())
            assert (best.get(w) == least) if least <= index.budget[w] else w not in best


def test_every_excerpt_of_thirteen_words_is_found():
    for number in range(4):
        words = L.words_of(prose(720 + number, 60, "fr" if number == 3 else "en"))
        index = Q.build([prose(730, 40), " ".join(words), prose(731, 40)])
        for i in range(len(words) - Q.WORDS + 1):
            excerpt = " ".join(words[i : i + Q.WORDS])
            data = np.frombuffer(f"Before it, {excerpt.upper()} and behind.".encode(), dtype=np.uint8)
            item = Q.leaks_in(index, data, np.array([0, len(data)]))[1].tolist()
            assert item == [1] or (len(excerpt.encode()) < Q.SHORTEST and item == [])


def test_leaks_of_odd_rows(spark, odd, empty, clashing):
    benchmark = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    nothing = benchmark.where("false")
    assert Q.leaks(odd, benchmark).count() == 0 and Q.leaks(empty, benchmark).count() == 0 and Q.leaks(odd, nothing).count() == 0
    assert Q.clean(clashing, benchmark).columns == clashing.columns
    assert Q.clean(odd, nothing).count() == odd.count() == len(odd_rows())


CALL = "conv_id long, position long, call_id string, tool string, arguments string, depends_on array<string>"


def test_tool_calls(spark):
    schemas = spark.createDataFrame([*T.SCHEMAS, (None, "x", "string", True), ("ask", "text", "string", True)], "tool string, name string, type string, required boolean")
    calls = [
        (1, 1, "a", "ask", '{"text": "x", "limit": 2.0}', []), (1, 2, "b", "ask", '{"limit": "2"}', ["a", "a", None]), (1, 3, "c", "nobody", "{}", None),
        (2, 1, "a", "compute", '{ "factor":1.50, "text":"é/\\n" }', ["z", "b"]), (2, 2, "b", "lookup", '{"text":null,"tags":{},"exact":true,"more":1}', ["c"]), (2, 3, "c", "ask", "[1]", []),
        (3, 1, "a", "ask", "{bad", ["b"]), (3, 2, "b", "ask", None, ["a"]), (3, 3, "c", "ask", '{"text":"t"}', ["a"]), (3, 4, "d", "ask", '{"text":"t"}', []),
        (4, 1, "a", "ask", '{"text":"t"}', []), (4, 1, "a", "ask", '{"text":"t"}', []), (4, 5, "a", "ask", '{"text":"u"}', []), (None, 1, "a", None, None, None), (5, 1, None, "ask", '{"text":"t"}', []),
    ]
    results = [(1, 9, "a", "late"), (1, 8, "a", "early"), (1, 8, None, "none"), (7, 1, "a", "lost"), (4, 2, "a", None), (None, 1, "a", "x")]
    rows = T.link(
        spark.createDataFrame([(*c, "extra") for c in calls], CALL + ", status string"),
        spark.createDataFrame(results, "conv_id long, position long, call_id string, content string"), schemas,
    ).collect()
    assert sum(r["n_rows"] or 0 for r in rows) == len(calls)
    got = {(r["conv_id"], r["position"], r["call_id"], r["status"]): r for r in rows}
    one = got[1, 1, "a", "linked"]
    assert one["valid"] and one["n_results"] == 2
    assert one["canonical"] == '{"arguments":{"limit":2,"text":"x"},"call_id":"a","conv_id":1,"result":"early","tool":"ask"}'
    assert got[1, 2, "b", "unanswered"]["errors"] == ["missing:text", "type:limit"]
    assert got[1, 3, "c", "unanswered"]["errors"] == ["no_schema"]
    two = [got[2, i, c, "unanswered"] for i, c in ((1, "a"), (2, "b"), (3, "c"))]
    assert [r["level"] for r in two] == [2, 1, 0] and two[0]["n_unknown"] == 1
    assert json.loads(two[0]["canonical"])["arguments"] == {"factor": 1.5, "text": "é/\n"} and '"depends_on":["b","z"]' in two[0]["canonical"]
    assert two[1]["errors"] == ["missing:text", "type:tags", "unknown:more"] and two[2]["errors"] == ["not_object"]
    assert [got[3, i, c, "unanswered"]["cycle"] for i, c in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))] == [True, True, True, False]
    assert got[3, 1, "a", "unanswered"]["errors"] == ["not_json"]
    assert got[4, 1, "a", "linked"]["n_rows"] == 1 and got[4, 1, "a", "repeated"]["n_rows"] == 1 and got[4, 5, "a", "repeated"]["n_rows"] == 1
    assert (None, 1, "a", "no_id") in got and (5, 1, None, "no_id") in got
    assert got[7, None, "a", "orphan"]["canonical"] is None
    assert sum(r["status"] == "orphan" for r in rows) == 3


def test_no_tool_calls(spark):
    calls, results = T.from_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    schemas = spark.createDataFrame(T.SCHEMAS, "tool string, name string, type string, required boolean")
    assert T.link(calls, results, schemas).count() == 0
