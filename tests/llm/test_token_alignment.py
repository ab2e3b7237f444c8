"""Alignments against whole texts encoded by the libraries and compared byte by byte."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quirework.llm import pieces, token_alignment as T, words as W
from quirework.llm.queries import QUERIES
from llm_data import SCHEMA, odd_rows, prose

CHARS = list("aBz'sTd .,;-0129éß…  　日😀▁\n\t\x0b\x1c<|>_") + ["it's", "  ", " the", "<|endoftext|>", "</s>", "<0x0A>", "x" * 70]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(pieces.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=pieces.vocabulary("piece_bpe_32k.model"))


def plain(libraries, text):
    """(ids of A, ids of B, groups, links) of one text, from the bytes of both."""
    a, b = libraries
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    printable = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i]
    chars = {chr(i): i for i in printable} | {chr(256 + k): i for k, i in enumerate(i for i in range(256) if i not in printable)}
    raw_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], [], []
    owner = lambda raw: [k for k, r in enumerate(raw) for _ in r]
    at_a, at_b = owner(raw_a), owner(raw_b)
    links = sorted(set(zip(at_a, at_b)))
    groups, i, j = [], 0, 0
    for k in range(len(at_a)):
        last = k + 1 == len(at_a)
        if last or (at_a[k] != at_a[k + 1] and at_b[k] != at_b[k + 1]):
            groups.append((ids_a[i : at_a[k] + 1], ids_b[j : at_b[k] + 1]))
            i, j = at_a[k] + 1, at_b[k] + 1
    return ids_a, ids_b, groups, [(ids_a[x], ids_b[y]) for x, y in links]


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(CHARS), max_size=25).map("".join)), max_size=6))
def test_groups_and_links_equal_the_libraries(libraries, texts):
    aligner = T._aligner(None, None)
    padded = [" " + t if t else "" for t in texts]
    for low, high, data, bounds in W.blocks(pa.array(padded, pa.string()), 64):
        n_a, n_b, n_groups, links, first, joined = aligner.run(data, bounds)
        for r in range(low, high):
            a, b, groups, pairs = plain(libraries, texts[r])
            k = r - low
            assert (n_a[k], n_b[k], n_groups[k], joined[k].decode()) == (len(a), len(b), len(groups), text_of(groups))
            assert links[first[k] : first[k + 1]].tolist() == [x * 32000 + y for x, y in pairs]


def test_pieces_of_the_second_model(libraries):
    encoder = pieces.piece_bpe()
    assert encoder.cuts
    texts = [" " + t for t in ["a", " ", "  ", "a ", "a  b ", "é" * 90 + " 日本", "x" * 3000, prose(8, 200)]]
    for _, _, data, bounds in W.blocks(pa.array(texts)):
        ids, firsts = encoder.encode(data, bounds)
        for r, text in enumerate(texts):
            assert ids[firsts[r] : firsts[r + 1]].tolist() == libraries[1].encode(text[1:])


def test_a_full_memory(libraries, monkeypatch):
    monkeypatch.setattr(T, "MOST_WINDOWS", 20)
    aligner = T.Aligner(None, None)
    for seed in range(4):
        for _, _, data, bounds in W.blocks(pa.array([" " + prose(seed, 50)])):
            joined = aligner.run(data, bounds)[5]
            assert joined[0].decode() == text_of(plain(libraries, prose(seed, 50))[2])


def test_query_against_the_libraries(spark, libraries, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "LOOKED_UP", 500)
    rows = [r for r in odd_rows() if len(r[1] or "") < 150_000] + [(50 + i, prose(i % 9, 40 + i, "fr" if i % 2 else "en"), "en", "s", 0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_token_alignment"](spark, str(tmp_path)).collect()
    each = [plain(libraries, r[1]) for r in rows]
    held = Counter(pair for one in each for pair in set(one[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = [
        (r[0], len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else "")
        for r, (a, b, groups, links) in zip(rows, each)
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_clashing_columns_and_empty_table(spark, clashing, empty):
    got = T.scored(clashing, tuple(clashing.columns))
    assert got.select("row.*").columns == clashing.columns and got.count() == clashing.count()
    assert T.scored(empty).count() == 0
    texts = T.aligned(clashing.where("doc_id = 3")).select("groups", "n_a").first()
    assert texts["n_a"] == 1 and texts["groups"].count("|") == 1
