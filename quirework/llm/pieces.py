"""Exact tokenization of whole texts, one distinct piece at a time.

Both public tokenizers cut a text before they merge: a boundary always lies where white space
follows other characters, and between an ASCII or Latin-1 letter and ASCII punctuation (apostrophes
aside, which may belong to a contraction). A text's ids are therefore its pieces' ids in a row. Each
worker encodes a distinct piece once and remembers it. A text with white space beyond ASCII, with
control characters, or with the string of a special token is one piece, so it is encoded as a whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from quirework.llm import words as W

# Pieces and ids that a worker remembers; beyond, it starts afresh.
MOST_PIECES = 1_500_000
MOST_IDS = 8_000_000

_LETTER = W.table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_PUNCTUATION = W.table(lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum() and b != 0x27)
_CONTROL = W.table(lambda b: b < 0x20 and b not in (0x09, 0x0A, 0x0D) or b == 0x7F)


def _shift(a: np.ndarray, k: int) -> np.ndarray:
    """a moved k places to the left, zeros behind."""
    out = np.zeros_like(a)
    out[: len(a) - k] = a[k:]
    return out


def _whole(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that must not be cut."""
    odd = np.flatnonzero(_CONTROL[data])
    if (data >= 0xC2).any():
        one, two = _shift(data, 1), _shift(data, 2)
        space = (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
        space |= (data == 0xE1) & (one == 0x9A) & (two == 0x80)
        space |= (data == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
        space |= (data == 0xE2) & (one == 0x81) & (two == 0x9F)
        space |= (data == 0xE3) & (one == 0x80) & (two == 0x80)
        odd = np.sort(np.concatenate([odd, np.flatnonzero(space)]))
    return W.per_row(odd, bounds) > 0


def _holding(data: np.ndarray, bounds: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Rows in which one of the strings may stand."""
    raw, found = data.tobytes(), []
    for string in strings:
        at = raw.find(string)
        while at >= 0:
            found.append(at)
            at = raw.find(string, at + 1)
    return W.per_row(np.sort(np.array(found, dtype=np.int64)), bounds) > 0


def cut(data: np.ndarray, bounds: np.ndarray, spaces: bool, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, first piece of each row. ``spaces``: white space is kept, before what follows it; ``whole``: rows that are one piece."""
    space, letter = W.SPACE[data], _LETTER[data]
    lead = data == 0xC3
    if lead.any():
        after = np.zeros(len(data), dtype=bool)
        after[1:] = lead[:-1]
        after &= (data != 0x97) & (data != 0xB7)
        letter = letter | after
        letter[:-1] |= after[1:]
    mark = _PUNCTUATION[data]
    start = np.zeros(len(data) + 1, dtype=bool)
    start[1:-1] = (space[1:] & ~space[:-1]) | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    if not spaces:
        start[1:-1] |= ~space[1:] & space[:-1]
    for r in np.flatnonzero(whole):
        start[bounds[r] : bounds[r + 1]] = False
    start[bounds] = True
    starts = np.flatnonzero(start[:-1])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    if not spaces:
        kept = ~space[starts]
        if whole.any():
            kept |= whole[np.searchsorted(bounds, starts, "right") - 1]
        starts, ends = starts[kept], ends[kept]
    return starts, ends, np.searchsorted(starts, bounds)


def expand(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for each of the runs of ``many`` items, one run after the other."""
    return np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)


class Encoder:
    """Ids of whole texts by one tokenizer file of the ``tokenizers`` library.

    ``most``: pieces remembered, if not ``MOST_PIECES``. ``special``: the strings of special tokens are found in texts; else they are plain text.
    """

    def __init__(self, path: str, spaces: bool, lower: bool, offsets: bool = False, special: bool = True, most: int | None = None):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # The library finds these in the text before anything else, so no cut may come between.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.spaces, self.lower, self.offsets = spaces, lower, offsets
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.firsts = np.zeros(1, np.int64)
        self.ids, self.spans = np.zeros(0, self.dtype), np.zeros((0, 2), np.int32)

    def _tokenize(self, texts: list[str]) -> tuple[list[list[int]], list]:
        """Ids of each text, and spans of each token where they are kept."""
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        got = encode(texts, add_special_tokens=False)
        return [e.ids for e in got], [span for e in got for span in e.offsets] if self.offsets else []

    def _cut(self, data: np.ndarray, bounds: np.ndarray):
        """The bytes to encode, and starts, ends and first of the pieces."""
        whole = _whole(data, bounds) | _holding(data, bounds, self.special)
        if self.lower:
            # Special tokens are matched as written, so texts that are one piece keep their case.
            given, data = data, W.LOWER[data]
            for r in np.flatnonzero(whole):
                data[bounds[r] : bounds[r + 1]] = given[bounds[r] : bounds[r + 1]]
        return data, *cut(data, bounds, self.spaces, whole)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids, spans = self._tokenize(texts)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for one in ids for i in one), self.dtype, int(counts.sum()))
        slots = len(self.firsts) - 1 + np.arange(len(keys))
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, flat])
        if self.offsets:
            self.spans = np.concatenate([self.spans, np.array(spans, dtype=np.int32).reshape(-1, 2)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)

    def encode(self, data: np.ndarray, bounds: np.ndarray):
        """Ids of all rows, the first id of each row, and with offsets the ids' spans in characters of the row."""
        data, starts, ends, piece_first = self._cut(data, bounds)
        h = W.hashes(data, starts, ends)
        keys, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            fresh = np.flatnonzero(~known)
            if len(self.keys) + len(fresh) > (self.most or MOST_PIECES) or len(self.ids) > MOST_IDS:
                self._forget()
                fresh = np.arange(len(keys))
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[example[fresh]].tolist(), ends[example[fresh]].tolist())]
            self._learn(keys[fresh], texts)
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][inverse]
        low, many = self.firsts[slot], np.diff(self.firsts)[slot]
        place = expand(low, many)
        firsts = np.concatenate([[0], np.cumsum(many)])[piece_first]
        ids = self.ids[place]
        if not self.offsets:
            return ids, firsts
        # Characters before each byte, counted from the start of its row.
        before = np.concatenate([[0], np.cumsum(~W.CONTINUATION[data])])
        begin = before[starts] - np.repeat(before[bounds[:-1]], np.diff(piece_first))
        return ids, firsts, self.spans[place] + np.repeat(begin, many)[:, None]


class PieceEncoder(Encoder):
    """Ids of whole texts by one ``sentencepiece`` model that puts a space before the text.

    Rows hold that space already. No entry of such a model has a space after another character, so no
    merge crosses the place where a space follows one, and a text's ids are those of its pieces.
    """

    def __init__(self, path: str, most: int | None = None):
        self.most = most
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        entries = [self.model.id_to_piece(i) for i in range(size)]
        self.cuts = not any("\u2581" in e.lstrip("\u2581") for e in entries)
        self.space = self.model.piece_to_id("\u2581")
        self.offsets = False
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self._forget()

    def _cut(self, data: np.ndarray, bounds: np.ndarray):
        start = np.zeros(len(data) + 1, dtype=bool)
        if self.cuts:
            space = data == 0x20
            start[1:-1] = space[1:] & ~space[:-1]
        start[bounds] = True
        starts = np.flatnonzero(start[:-1])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        return data, starts, ends, np.searchsorted(starts, bounds)

    def _tokenize(self, texts: list[str]) -> tuple[list[list[int]], list]:
        got = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids if t != " " else [self.space] for ids, t in zip(got, texts)], []


@lru_cache(maxsize=4)
def _encoder(path: str, spaces: bool, lower: bool, offsets: bool) -> Encoder:
    return Encoder(path, spaces, lower, offsets)


def byte_bpe(path: str | None = None, offsets: bool = False) -> Encoder:
    """This worker's encoder for the byte-level tokenizer."""
    return _encoder(path or vocabulary("byte_bpe_50k.json"), True, False, offsets)


def word_bpe(path: str | None = None, offsets: bool = False) -> Encoder:
    """This worker's encoder for the lower-casing tokenizer with word ends."""
    return _encoder(path or vocabulary("word_bpe_49k.json"), False, True, offsets)


@lru_cache(maxsize=4)
def plain_byte_bpe(path: str | None = None, most: int | None = None) -> Encoder:
    """This worker's byte-level encoder to which special tokens' strings are plain text."""
    return Encoder(path or vocabulary("byte_bpe_50k.json"), True, False, special=False, most=most)


@lru_cache(maxsize=4)
def piece_bpe(path: str | None = None, most: int | None = None) -> PieceEncoder:
    """This worker's encoder for the model with space-marked pieces."""
    return PieceEncoder(path or vocabulary("piece_bpe_32k.model"), most)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
