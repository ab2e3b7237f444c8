import pyarrow as pa
from hypothesis import given, settings, strategies as st

from quirework.llm import pieces, words as W
from llm_data import odd_rows

CHARS = list("aBz'sTd .,;-0129éÉß×÷…“  ́日😀ΣİÅ\n\t\x0b\x1c<|>_") + ["it's", "'ll", " the", "<|endoftext|>"]


def check(encoder, texts):
    for low, high, data, bounds in W.blocks(pa.array(texts, pa.string()), 64):
        got = encoder.encode(data, bounds)
        for r in range(low, high):
            want = encoder.tokenizer.encode(texts[r] or "", add_special_tokens=False)
            a, b = got[1][r - low], got[1][r - low + 1]
            assert got[0][a:b].tolist() == want.ids
            if encoder.offsets:
                assert [tuple(s) for s in got[2][a:b].tolist()] == want.offsets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(CHARS), max_size=25).map("".join)), max_size=6))
def test_equal_to_the_library(texts):
    for make in (pieces.byte_bpe, pieces.word_bpe):
        for offsets in (False, True):
            check(make(offsets=offsets), texts)


def test_odd_texts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PIECES", 50)
    texts = [r[1] for r in odd_rows() if len(r[1] or "") < 250_000]
    for spaces, lower, name in ((True, False, "byte_bpe_50k.json"), (False, True, "word_bpe_49k.json")):
        check(pieces.Encoder(pieces.vocabulary(name), spaces, lower), texts)


def test_special_tokens_are_found_as_the_library_finds_them():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|startoftext|>A<|ENDOFTEXT|> <|endoftext|>", "x <|EndOfText|>", "<|endof", "text|> plain", "a\u2003<|ENDOFTEXT|> B"]
    for make, name in ((pieces.byte_bpe, "byte_bpe_50k.json"), (pieces.word_bpe, "word_bpe_49k.json")):
        library = Tokenizer.from_file(pieces.vocabulary(name))
        for _, _, data, bounds in W.blocks(pa.array(texts)):
            ids, firsts, spans = make(offsets=True).encode(data, bounds)
            for r, text in enumerate(texts):
                want = library.encode(text, add_special_tokens=False)
                assert ids[firsts[r] : firsts[r + 1]].tolist() == want.ids
                assert [tuple(s) for s in spans[firsts[r] : firsts[r + 1]].tolist()] == want.offsets
    encode = library.encode("a <|endoftext|> b", add_special_tokens=False)
    assert encode.ids == [320, 49407, 321]
