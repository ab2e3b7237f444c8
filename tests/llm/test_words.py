import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from llm_data import SCHEMA
from quirework.llm import words as W

TEXT = st.text(alphabet=st.sampled_from(list("aAbé \n\t\x0b,😀 x")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12), st.integers(1, 40))
def test_blocks_spans_lines_and_hashes(texts, limit):
    seen, rows = {}, 0
    for low, high, data, bounds in W.blocks(pa.array(texts, pa.string()), limit):
        assert low == rows
        rows = high
        raw = data.tobytes()
        for member, pattern in ((W.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (W.ALPHANUMERIC, r"[0-9a-z\x80-\U0010ffff]+")):
            starts, ends, firsts = W.spans(data, bounds, member)
            h = W.hashes(data, starts, ends)
            for r in range(high - low):
                got = [raw[starts[i] : ends[i]].decode() for i in range(firsts[r], firsts[r + 1])]
                assert got == re.findall(pattern, texts[low + r] or "")
                for word, value in zip(got, h[firsts[r] : firsts[r + 1]]):
                    assert seen.setdefault(word, value) == value
        starts, ends, firsts = W.lines(data, bounds)
        for r in range(high - low):
            assert [raw[starts[i] : ends[i]].decode() for i in range(firsts[r], firsts[r + 1])] == (texts[low + r] or "").split("\n")
    assert rows == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_long_segments_hash_by_content():
    text = "y" * (W.LONG_SEGMENT + 5)
    _, _, data, bounds = next(W.blocks(pa.array([f"{text} a {text} b {text}c"])))
    h = W.hashes(data, *W.spans(data, bounds, W.NOT_SPACE)[:2])
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_windows_stay_in_rows():
    h = np.arange(7, dtype=np.uint64)
    starts, _ = W.windows(h, np.array([0, 3, 3, 7]), 3)
    assert starts.tolist() == [0, 3, 4]


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2 ** n letters and its complement, which every polynomial modulo 2 ** 64 of an odd base maps to one value."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return tuple("".join("ab"[b ^ k] for b in bits) for k in (0, 1))


@pytest.mark.parametrize("n", [5, 6, 7, 10, 12])
def test_words_that_collide_in_a_polynomial(n):
    a, b = thue_morse(n)
    for texts in ([a, b], [f"{a}\n{b}"], [f"x {a} {b} y"]):
        for _, _, data, bounds in W.blocks(pa.array(texts)):
            starts, ends, _ = W.spans(data, bounds, W.NOT_SPACE)
            h = W.hashes(data, starts, ends)
            assert len(set(h.tolist())) == len(starts)


def test_encoders_and_sets_tell_colliding_texts_apart():
    from quirework.llm import pieces, shingle_join

    a, b = thue_morse(12)
    texts = [a, b, f"{a} {b}", f"{b} {a}"]
    for _, _, data, bounds in W.blocks(pa.array(texts)):
        for encoder in (pieces.byte_bpe(), pieces.word_bpe(), pieces.byte_bpe(offsets=True)):
            ids, firsts = encoder.encode(data, bounds)[:2]
            for r, text in enumerate(texts):
                assert ids[firsts[r] : firsts[r + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        gram, firsts = shingle_join.shingle_sets(data, bounds)
        assert len({tuple(gram[x:y]) for x, y in zip(firsts[:-1], firsts[1:])}) == 4


def test_queries_tell_colliding_texts_apart(spark, tmp_path):
    from quirework.llm.queries import QUERIES

    a, b = thue_morse(12)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([f"{a}\n{b}", f"{a}\n{a}", a, b, f"one {a}", f"one {b}"])]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r["doc_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    lines = run("op1_quality_divergence")
    assert [lines[i]["n_dup_lines"] for i in (0, 1)] == [0, 1]
    scores = run("op4_kneser_ney")
    assert all(r["n_tokens"] in (2, 3) for r in scores.values())
    ids = run("op3_arrow_sequences")
    assert ids[2]["ids_crc32"] != ids[3]["ids_crc32"]
    packed = run("op6_configuration_packing")
    assert packed[2]["ids_crc32"] != packed[3]["ids_crc32"]
    spans = [r["n_tokens"] for r in QUERIES["op2_token_spans"](spark, str(tmp_path)).where("doc_id IN (2, 3)").collect()]
    assert len(spans) == 2 and min(spans) > 0
    from quirework.llm import shingle_join

    assert shingle_join.one_of_each(spark.read.parquet(str(tmp_path / "documents.parquet"))).count() == 6
