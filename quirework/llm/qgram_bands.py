"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-case words with single spaces. A window of a benchmark item is ``WORDS``
words from any word on (more if they are short, its first ``WINDOW`` bytes if they are long), so every
verbatim excerpt of so many words holds a whole one, wherever it begins. A window of m bytes that
occurs with at most k edits leaves m + 1 - q - k q of its q-grams intact, on diagonals that lie within
k of each other. Shared q-grams are counted in overlapping bands of diagonals, each as wide as twice
the largest k; windows that reach their bound within a band are verified by banded alignment.

The q-grams of an item are indexed once each, not once a window. Tasks build the index in shards of
bounded size in the shared folder; the tasks that search map them, so nothing of the benchmark
passes through the driver and the documents are read once for all shards.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirework.llm import words as W
from quirework.llm.carry import map_rows, name
from quirework.llm.registry import query, read
from quirework.llm.shared_files import map_file, write_whole
from quirework.session import fresh_dir

# A q-gram is one 64-bit number.
Q = 8
# A window has so many words and so many bytes at least; an item that has less is one window.
WORDS = 13
SHORTEST = 48
WINDOW = 96
# One edit is allowed for so many bytes of a window.
BYTES_PER_EDIT = 12
MOST_EDITS = WINDOW // BYTES_PER_EDIT
# Diagonals of a band; the next one begins half a band further.
BAND = 2 * MOST_EDITS
# Items with fewer bytes after normalization are no evidence of anything.
LEAST = 24
# Benchmark bytes in one shard of the index, which takes about 25 times as many.
MOST_BYTES = 4_000_000
_U = np.uint64


def normalized(data: np.ndarray, bounds: np.ndarray):
    """Bytes of the words with single spaces, first and last byte of each row there, and their origins."""
    starts, ends, firsts = W.spans(W.LOWER[data], bounds, W.ALPHANUMERIC)
    text, begin, origin = W.joined(W.LOWER[data], starts, ends)
    stops = np.append(begin, len(text))
    low, high = stops[firsts[:-1]], stops[firsts[1:]]
    return text, low, np.maximum(high - 1, low), origin


def grams(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; the last seven places have none."""
    n = max(0, len(text) - Q + 1)
    out = np.zeros(n, dtype=_U)
    for k in range(Q):
        out |= text[k : k + n].astype(_U) << _U(8 * k)
    return out


def _sieved(gram: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (gram * _U(0x9E3779B97F4A7C15) >> _U(64 - bits)).astype(np.int64)


def _edits(length: np.ndarray) -> np.ndarray:
    """The edit budget of a window; the lemma's bound stays at one q-gram at least."""
    return np.minimum(length // BYTES_PER_EDIT, (length - Q) // Q)


@dataclass(frozen=True)
class Index:
    text: np.ndarray  # the normalized items end to end
    items: np.ndarray  # number of the item of each window
    starts: np.ndarray  # first byte of each window, rising
    lengths: np.ndarray
    grams: np.ndarray  # sorted distinct q-grams
    at: np.ndarray  # where the places of each begin
    place: np.ndarray
    sieve: np.ndarray  # whether a q-gram may be one of them

    @cached_property
    def budget(self) -> np.ndarray:
        return _edits(self.lengths.astype(np.int64))

    @cached_property
    def bound(self) -> np.ndarray:
        return self.lengths + 1 - Q - self.budget * Q

    @cached_property
    def windows(self) -> np.ndarray:
        """Bytes of each window, zeros behind."""
        return self.patterns(np.arange(len(self.starts)))

    def patterns(self, window: np.ndarray) -> np.ndarray:
        at = self.starts[window][:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < self.lengths[window][:, None]
        return np.where(inside, self.text[np.minimum(at, max(0, len(self.text) - 1))], 0).astype(np.uint8)


def _windows(clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows of one item."""
    space = np.flatnonzero(clean == 0x20)
    begin, end = np.append(0, space + 1), np.append(space, len(clean))
    first = np.arange(len(begin))
    last = np.maximum(first + WORDS - 1, np.searchsorted(end, begin + SHORTEST))
    whole = last < len(end)
    if not whole.any():
        return np.zeros(1, np.int64), np.array([min(len(clean), WINDOW)])
    return begin[whole], np.minimum(end[last[whole]] - begin[whole], WINDOW)


def build(texts: list[str]) -> Index:
    """Index all items; those too short have no window."""
    parts, items, starts, lengths, size = [], [], [], [], 0
    for number, text in enumerate(texts):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        clean, low, high, _ = normalized(data, np.array([0, len(data)]))
        clean = clean[low[0] : high[0]]
        if len(clean) < LEAST:
            continue
        start, length = _windows(clean)
        items.append(np.full(len(start), number))
        starts.append(start + size)
        lengths.append(length)
        # No document has a zero byte there, so no q-gram reaches from one item into the next.
        parts += [clean, np.zeros(1, np.uint8)]
        size += len(clean) + 1
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    text = flat(parts, np.uint8)
    gram = grams(text)
    inside = per_gram(text == 0)
    place = np.flatnonzero(~inside)
    place = place[np.argsort(gram[place], kind="stable")]
    distinct, at = np.unique(gram[place], return_index=True)
    bits = max(16, int(8 * len(distinct)).bit_length())
    sieve = np.zeros(1 << bits, dtype=bool)
    sieve[_sieved(distinct, bits)] = True
    return Index(text, flat(items, np.int32), flat(starts, np.int64), flat(lengths, np.int32), distinct, np.append(at, len(place)).astype(np.int64), place.astype(np.int64), sieve)


def per_gram(marked: np.ndarray) -> np.ndarray:
    """Whether a q-gram holds a marked byte."""
    upto = np.concatenate([[0], np.cumsum(marked)])
    return upto[Q:] > upto[:-Q] if len(marked) >= Q else np.zeros(0, bool)


def align(pattern: np.ndarray, length: np.ndarray, text: np.ndarray, base: np.ndarray, low: np.ndarray, high: np.ndarray, width: int):
    """Least edits between each pattern and any part of its row whose diagonals lie in [base, base + width), and where that part ends.

    Banded alignment of all candidates at once; the part may begin and end anywhere in [low, high).
    """
    n = len(base)
    offset = np.arange(width)
    far = WINDOW + width + 1
    # Position of the text byte that follows prefix i on diagonal d is base + d + i.
    before = base[:, None] + offset
    cost = np.where((before >= low[:, None]) & (before <= high[:, None]), 0, far)
    best, stop = np.full(n, far), np.zeros(n, np.int64)
    for i in range(WINDOW):
        live = i < length
        at = before + i
        inside = (at >= low[:, None]) & (at < high[:, None])
        byte = text[np.clip(at, 0, len(text) - 1)]
        step = np.where(inside, cost + (byte != pattern[:, i : i + 1]), far)
        # Leaving out a pattern byte moves one diagonal down, taking a text byte one up.
        drop = np.full_like(cost, far)
        drop[:, :-1] = cost[:, 1:] + 1
        new = np.minimum(step, drop)
        new = np.minimum.accumulate(new - offset, axis=1) + offset
        cost = np.where(live[:, None], new, cost)
        done = length == i + 1
        if done.any():
            d = cost[done].argmin(axis=1)
            best[done] = cost[done, d]
            stop[done] = np.minimum(base[done] + d + i + 1, high[done])
    return best, stop


def search(index: Index, text: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(row, window, edits, end in the text) of every verified region."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    gram = grams(text)
    if not len(gram) or not len(index.grams):
        return none
    spot = np.flatnonzero(index.sieve[_sieved(gram, len(index.sieve).bit_length() - 1)])
    which = np.minimum(np.searchsorted(index.grams, gram[spot]), len(index.grams) - 1)
    hit = index.grams[which] == gram[spot]
    spot, which = spot[hit], which[hit]
    row = np.searchsorted(low, spot, "right") - 1
    # Empty rows share their place with the next one.
    inside = spot + Q <= high[row]
    spot, which, row = spot[inside], which[inside], row[inside]
    found = []
    # Places are expanded in runs of bounded size; a row is never cut.
    many = np.diff(index.at)[which]
    upto = np.cumsum(many)
    begin = 0
    while begin < len(spot):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + (1 << 21), "right"))
        end = max(end, begin + 1)
        if end < len(spot):
            same = int(np.searchsorted(row, row[end]))
            end = same if same > begin else int(np.searchsorted(row, row[begin], "right"))
        found.append(_candidates(index, spot[begin:end], which[begin:end], row[begin:end], many[begin:end]))
        begin = end
    key = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if not len(key):
        return none
    out = []
    for a in range(0, len(key), 4096):
        r, w, base = key[a : a + 4096].T
        k = index.budget[w]
        edits, stop = align(index.patterns(w), index.lengths[w], text, base - MOST_EDITS, low[r], high[r], BAND + 2 * MOST_EDITS + 1)
        good = edits <= k
        out.append(np.stack([r[good], w[good], edits[good], stop[good]]))
    return tuple(np.concatenate(out, axis=1))


def _candidates(index: Index, spot, which, row, many) -> np.ndarray:
    """(row, window, first diagonal of the band from the window's start) wherever a band's shared q-grams reach the bound."""
    owner = np.repeat(np.arange(len(spot)), many)
    post = np.arange(len(owner)) + np.repeat(index.at[which] - (np.cumsum(many) - many), many)
    place = index.place[post]
    # Diagonals may lie before the text; they are moved up by the length of the items.
    band = (spot[owner] - place + len(index.text)) // (BAND // 2)
    band, place, row = np.concatenate([band, band - 1]), np.tile(place, 2), np.tile(row[owner], 2)
    order = np.lexsort((place, band, row))
    band, place, row = band[order], place[order], row[order]
    none = np.zeros((0, 3), np.int64)
    if not len(place):
        return none
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (band[1:] != band[:-1])])
    # A q-gram of an item counts once, however often the band meets it.
    once = fresh | np.concatenate([[True], place[1:] != place[:-1]])
    band, place, row, fresh = band[once], place[once], row[once], fresh[once]
    flat = (np.cumsum(fresh) - 1) * (len(index.text) + WINDOW) + place
    # Only where the lowest bound is met within a window's reach may one begin.
    least = max(1, int(index.bound.min()))
    j = np.arange(max(0, len(flat) - least + 1))
    j = j[flat[j + least - 1] - flat[j] <= WINDOW - Q]
    # Windows whose first shared q-gram is this one.
    before = np.where(fresh[j], -1, place[np.maximum(j - 1, 0)])
    begin = np.searchsorted(index.starts, np.maximum(before + 1, place[j] - (WINDOW - Q)))
    end = np.searchsorted(index.starts, place[j], "right")
    number = np.maximum(end - begin, 0)
    which = np.repeat(np.arange(len(j)), number)
    window = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + begin[which]
    j = j[which]
    upto = np.searchsorted(flat, flat[j] - place[j] + index.starts[window] + index.lengths[window] - Q, "right")
    good = upto - j >= np.maximum(index.bound[window], 1)
    j, window = j[good], window[good]
    return np.stack([row[j], window, band[j] * (BAND // 2) - len(index.text) + index.starts[window]], axis=1)


RESULT = "item long, n_windows int, edits int, start long, stop long"


def leaks_in(index: Index, data: np.ndarray, bounds: np.ndarray):
    """(row, item, matched windows, least edits, start, stop) per row and item; the span is in bytes of the block."""
    text, low, high, origin = normalized(data, bounds)
    row, window, edits, stop = search(index, text, low, high)
    # One row per (row, window), then per (row, item).
    start = np.maximum(stop - index.lengths[window] - edits, low[row]) if len(row) else stop
    item = index.items[window].astype(np.int64)
    order = np.lexsort((window, item, row))
    row, item, window, edits, start, stop = (x[order] for x in (row, item, window, edits, start, stop))
    if not len(row):
        return (row,) * 6
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] != window[:-1])]).astype(np.int64)
    first, last = np.minimum.reduceat(start, head), np.maximum.reduceat(stop, head)
    return row[head], item[head], np.add.reduceat(fresh, head), np.minimum.reduceat(edits, head), origin[first], origin[np.maximum(last - 1, first)] + 1


def _save(index: Index, uri: str) -> None:
    def write(sink):
        arrays = [getattr(index, f.name) for f in fields(Index)]
        sink.write(pa.py_buffer(np.array([len(a) for a in arrays], np.int64)))
        for a in arrays:
            # Every array begins at a multiple of eight bytes.
            sink.write(pa.py_buffer(np.ascontiguousarray(a)))
            sink.write(b"\0" * (-a.nbytes % 8))

    write_whole(uri, write)


_KINDS = {"text": np.uint8, "items": np.int32, "starts": np.int64, "lengths": np.int32, "grams": np.uint64, "at": np.int64, "place": np.int64, "sieve": np.bool_}


@lru_cache(maxsize=2)
def _load(uri: str) -> Index:
    buffer = map_file(uri).read_buffer()
    sizes, at, out = np.frombuffer(buffer, np.int64, len(_KINDS)), 8 * len(_KINDS), {}
    for (field, kind), n in zip(_KINDS.items(), sizes.tolist()):
        out[field] = np.frombuffer(buffer, kind, n, at)
        at += out[field].nbytes + -out[field].nbytes % 8
    return Index(**out)


def _indexed(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, list[tuple[int, str]]]:
    """(item, item_key) of every item, and the number and file of each shard of the index."""
    spark = benchmark.sparkSession
    known = benchmark.where(name(text).isNotNull()).select(name(key).alias("item_key"), name(text).alias("item_text"))
    size = known.agg(F.sum(F.octet_length("item_text").cast("long"))).first()[0] or 0
    count, folder = max(1, -(-size // MOST_BYTES)), fresh_dir(spark, "benchmark-index")

    def file(shard):
        return f"{folder}/shard-{shard:06d}"

    def write(batches):
        held, number = [], None

        def flush():
            keys = pa.concat_arrays([k for k, _ in held])
            _save(build([t for _, texts in held for t in texts.to_pylist()]), file(number))
            return pa.RecordBatch.from_arrays([pa.array((number << 32) + np.arange(len(keys))), keys], names=["item", "item_key"])

        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b and held and shards[a] != number:
                    yield flush()
                    held = []
                if a < b:
                    number = int(shards[a])
                    held.append((batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)))
        if held:
            yield flush()

    shard = F.pmod(F.xxhash64("item_text", F.col("item_key").cast("string")), F.lit(count))
    rows = known.select(shard.alias("shard"), "item_key", "item_text").repartition("shard").sortWithinPartitions("shard", "item_text", "item_key")
    # The checkpoint writes the files; a task that runs again writes the same.
    keys = rows.mapInArrow(write, f"item long, item_key {known.schema['item_key'].dataType.simpleString()}").checkpoint()
    there = keys.select(F.shiftright("item", 32).alias("shard")).distinct().collect()
    return keys, [(n, file(n)) for n in sorted(r["shard"] for r in there)]


def leaks(docs: DataFrame, benchmark: DataFrame, carried: tuple[str, ...] = ("doc_id",), key: str = "item_id", text: str = "text") -> DataFrame:
    """``row`` (the carried columns), item key, matched windows, least edits and span of every leaked item.

    The span is in characters of the text, from the first matched window to the last. Null, empty
    and too short texts and items match nothing; equal items are all reported, as are equal rows. An
    empty benchmark gives no rows.
    """
    keys, shards = _indexed(benchmark, key, text)

    def run(columns):
        for low, _, data, bounds in W.blocks(columns["text"]):
            chars = np.concatenate([[0], np.cumsum(~W.CONTINUATION[data])])
            for shard, uri in shards:
                row, item, many, edits, start, stop = leaks_in(_load(uri), data, bounds)
                base = chars[bounds[row]]
                yield pa.array(row + low), [pa.array(item + (shard << 32)), *(pa.array(x.astype(np.int32)) for x in (many, edits)), *(pa.array(chars[x] - base) for x in (start, stop))]

    found = map_rows(docs, run, RESULT, list(carried), ["text"])
    return found.join(keys, "item").select("row", "item_key", "n_windows", "edits", "start", "stop")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that hold no leak, with all their columns; null and empty texts hold none.

    Repeated rows are judged alike; an empty benchmark or table changes nothing.
    """
    _, shards = _indexed(benchmark, key, text)

    def run(columns):
        for low, high, data, bounds in W.blocks(columns["text"]):
            dirty = np.zeros(high - low, dtype=bool)
            for _, uri in shards:
                dirty[leaks_in(_load(uri), data, bounds)[0]] = True
            yield pa.array(np.flatnonzero(~dirty) + low), [pa.array(np.zeros(int((~dirty).sum()), dtype=bool))]

    return map_rows(docs, run, "leaked boolean", list(docs.columns), ["text"]).select("row.*")


@query("op10_qgram_decontamination")
def op10(spark, sf_dir):
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", F.col("item_key").alias("item_id"), "n_windows", "edits", "start", "stop")
