import zlib

import numpy as np
import pyarrow as pa

from quirework.llm import arrow_tokens as A, bin_config as B, pieces, token_spans as T, words as W
from quirework.session import fresh_dir


def ids_of(text, end, encoder):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_sequence_files_hold_every_id(spark, odd):
    folder = fresh_dir(spark, "test")
    parts = A.write(odd, folder, length=16)
    got = [tuple(r) for r in A.read_back(spark, folder, parts).collect()]
    encoder = pieces.word_bpe()
    rows = [(r["doc_id"], ids_of(r["text"], 1, encoder)) for r in odd.collect()]
    assert sorted((k is not None, k or 0, n, c) for k, _, n, c in got) == sorted((k is not None, k or 0, len(i), crc(i)) for k, i in rows)
    # Starts follow the order of keys, nulls first, without gaps.
    at, last = 0, (False, -1)
    for key, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at and (key is not None, key or 0) >= last
        at, last = at + n, (key is not None, key or 0)
    reader = A.sequences(folder, parts[0][0])
    batch = reader.get_batch(0)
    assert batch.schema.field("ids").type.list_size == 16
    assert len(batch.column(0)[0].as_py()) == 16


def test_sequence_files_of_nothing(spark, empty):
    folder = fresh_dir(spark, "test")
    parts = A.write(empty, folder)
    assert parts == [] and A.read_back(spark, folder, parts).count() == 0


def test_packing(spark, odd, empty):
    rows = B.packed(odd, capacity=64).collect()
    encoder = pieces.byte_bpe()
    want = []
    for r in odd.collect():
        ids = ids_of(r["text"], 2, encoder)
        first = len(ids) - (-(-len(ids) // 64) - 1) * 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(str(r["doc_id"]), i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_key"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert np.frombuffer(r["ids"], encoder.dtype).size == r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 64) * 1.05 + 3
    assert B.packed(empty).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(300, 700, 3000), rng.geometric(0.004, 5000).clip(1, 1024), np.full(700, 400)):
        histogram = np.bincount(lengths, minlength=1025)
        rows, sequences, bound = B.plan(histogram)
        assert sequences >= bound - 1e-6
        greedy = len(B.best_fit(lengths.tolist(), 1024))
        assert sequences <= 1.01 * greedy + 1
        ranks = {}
        for length, low, high, first, offset in rows:
            assert offset + length <= 1024
            ranks.setdefault(length, []).append((low, high))
        for length, spans in ranks.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == histogram[length]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def brute(tokenizer, text, sections, rule):
    out = {i: [0, 0, 0.0] for i in [*range(len(sections)), -1]}
    for a, b in tokenizer.encode(text or "", add_special_tokens=False).offsets:
        own = [next((i for i, (x, y) in enumerate(sections) if x <= c < y), -1) for c in range(a, max(b, a + 1))]
        share = {o: own.count(o) / len(own) for o in set(own)}
        if rule == "first":
            parts = {own[0]: 1.0}
        elif rule == "most":
            real = {o: s for o, s in share.items() if o >= 0}
            best = min(real, key=lambda o: (-real[o], o)) if real else -1
            parts = {-1 if share.get(-1, 0) > real.get(best, 0) else best: 1.0}
        else:
            parts = share
        for o, w in parts.items():
            out[o] = [out[o][0] + 1, out[o][1] + (len(set(own)) > 1), out[o][2] + w]
    return {k: v for k, v in out.items() if k >= 0 or v[0]}


def test_attribution(spark):
    texts = [None, "", "Hello world\nand more\n", "internationalisation of tokens", "é日本語\n\nx", "the quick brown fox " * 20]
    cuts = [[], [], [(0, 3), (3, 9), (12, 15)], [(0, 4), (4, 9), (9, 14), (20, 21)], [(0, 1), (1, 2), (2, 9)], [(i, i + 3) for i in range(1, 300, 4)]]
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(zip(texts, cuts))] + [(9, "null sections", None)], "doc_id int, text string, parts array<struct<start: long, stop: long>>")
    tokenizer = pieces.byte_bpe(offsets=True).tokenizer
    for rule in T.RULES:
        got = {}
        for r in T.attribute(docs, sections="parts", rule=rule).collect():
            got.setdefault(r["row"]["doc_id"], {})[r["section"]] = [r["n_tokens"], r["n_crossing"], r["weight"]]
        for i, (t, c) in enumerate(zip(texts, cuts)):
            want = brute(tokenizer, t, c, rule)
            mine = got.get(i, {})
            assert set(mine) == set(want)
            for k in want:
                assert mine[k][:2] == want[k][:2] and abs(mine[k][2] - want[k][2]) < 1e-9
        assert got[9][-1][2] == len(tokenizer.encode("null sections").ids)


def test_attribution_to_lines(odd, empty, clashing):
    tokenizer = pieces.byte_bpe(offsets=True).tokenizer
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = T.attribute(odd).collect()
    assert sum(r["weight"] for r in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert sum(r["section"] >= 0 for r in got) == sum(len((t or "").split("\n")) for _, t in rows)
    assert T.attribute(empty).count() == 0
    assert T.attribute(clashing, ("doc_id", "length", "a.b")).select("row.*").columns == ["doc_id", "length", "a.b"]


def test_ids_of_pieces_stay_in_spark(corpus):
    """What Python gets of a piece when it is packed are two numbers; its ids go past."""
    packed = B.packed(corpus)
    assert "ids" in packed.columns
    assert "MapInArrow" not in packed._jdf.queryExecution().executedPlan().toString()
    for row in packed.collect():
        assert len(row["ids"]) % row["length"] == 0 and 0 <= row["offset"] <= B.CAPACITY - row["length"]


def test_pieces_are_packed_where_they_stand(corpus, monkeypatch):
    """No piece is shuffled for its place, whatever files hold the counts of the tasks."""
    want = sorted((r["doc_key"], r["piece"], r["sequence_id"], r["offset"]) for r in B.packed(corpus, with_ids=False).collect())
    monkeypatch.setattr(B, "GROUP", 2)
    packed = B.packed(corpus)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    got = packed.collect()
    assert sorted((r["doc_key"], r["piece"], r["sequence_id"], r["offset"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(end == start for p in places.values() for (a, n), (start, _) in zip(sorted(p), sorted(p)[1:]) for end in [a + n])


def test_freed_memory_goes_back(monkeypatch):
    """Batches come through whole and in order; what they leave is given back before the next."""
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    W.release()
    freed = []
    monkeypatch.setattr(W, "release", lambda: freed.append(1))
    assert [b["x"][0].as_py() for b in W.released(iter(batches))] == [0, 1, 2]
    assert len(freed) == 4
