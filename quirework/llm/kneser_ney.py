"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by the workers.

Tokens are lower-cased words and one end token per document, which is also the context of the first
word. Counting takes two shuffles of packed, sorted blocks: pairs by (context, word), then words.
What comes out are files of sorted hash arrays in the shared folder, one per shard:

``pairs-*``  hashes of (context, word), a count of one byte each, and the few counts that need more;
``words-*``  hashes of words, counts, distinct predecessors, and followers seen once, twice, more.

A worker maps the files and looks up the sorted n-grams of a whole block of texts at a time. Shards
are chosen by hash, so the many pairs of one frequent context spread over all of them, and their
number grows with the corpus.

The lower order is the share of distinct predecessors, discounted in the same way and interpolated
with one part in V + 1, where V is the number of distinct tokens in training: unknown words get that.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from quirework.llm import words as W
from quirework.llm.carry import map_rows
from quirework.llm.registry import query, read
from quirework.llm.shared_files import map_file, write_whole
from quirework.session import fresh_dir

# Training tokens per shard, about; pairs that a task gathers before it hands them on.
PER_SHARD = 2_000_000
GATHERED = 2_000_000
# Text that a task scores at once; larger blocks read the model more in sequence.
SCORED = 8 << 20

_U = np.uint64
END = _U(0x5EED5EED5EED5EED)


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the first token of each row; every row ends with END."""
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, bounds, W.NOT_SPACE)
    h = np.insert(W.hashes(data, starts, ends), firsts[1:], END)
    return h, firsts + np.arange(len(firsts))


def _contexts(h: np.ndarray) -> np.ndarray:
    """The token before each; rows end with END, so the first word of a row has it as context."""
    return np.concatenate([[END], h[:-1]]) if len(h) else h


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Columns of one block, bytes of equal weight together, compressed."""
    n = len(arrays[0])
    parts = [np.array([n], dtype="<i8").tobytes()]
    for a in arrays:
        parts.append(a.astype("<u8").view(np.uint8).reshape(n, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(columns, 8, n)
    return [np.ascontiguousarray(planes[k].T).view("<u8").reshape(n).astype(_U) for k in range(columns)]


def _delta(sorted_values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.diff(sorted_values, prepend=_U(0))


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _count_pairs(context: np.ndarray, word: np.ndarray, counts: np.ndarray | None = None):
    """Distinct (context, word), sorted, with their counts."""
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])) if len(order) else order
    weights = np.ones(len(order), np.int64) if counts is None else counts[order].astype(np.int64)
    return context[first], word[first], np.add.reduceat(weights, first) if len(first) else weights


def _blocks_by_shard(shard: np.ndarray, columns: list[np.ndarray], sorted_column: int = 0):
    """(shard, packed columns) for each shard; the columns are sorted by the first one."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    heads = np.append(_runs(shard), len(shard))
    for a, b in zip(heads[:-1], heads[1:]):
        part = [c[order[a:b]] for c in columns]
        part[sorted_column] = _delta(part[sorted_column])
        yield int(shard[a]), _pack(part)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "block"])


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.pair(context, word)


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((key >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _by_shard(batches):
    """(shard, its blocks) of a partition whose rows are sorted by shard."""
    held, blocks = None, []
    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            if shard != held and blocks:
                yield held, blocks
                blocks = []
            held = shard
            blocks.append(block.as_buffer().to_pybytes())
    if blocks:
        yield held, blocks


@dataclass(frozen=True)
class Model:
    """Where the files are, and the few numbers that hold for all of them."""

    folder: str
    shards: int
    tokens: int
    types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    continuations: int  # distinct pairs
    backoff: float  # mass that the lower order hands to the uniform one


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams seen once to four times; 0.5 of each where too few are seen."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    wanted = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(wanted, 1))


def _amount(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def train(docs: DataFrame, per_shard: int = PER_SHARD) -> Model:
    """Count the texts of ``docs`` and write the model below the shared folder; null counts as empty."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "kneser-ney")
    texts = docs.select("text")
    spaces = F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), " \n", ""))
    about = texts.agg(F.sum(spaces + 2)).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, about / per_shard))))

    def gather(batches):
        held, size = [], 0

        def hand_on():
            context, word, counts = _count_pairs(np.concatenate([c for c, _ in held]), np.concatenate([w for _, w in held]))
            yield _batch(list(_blocks_by_shard(_shard_of(_pair_key(context, word), shards), [context, word, counts])))

        for batch in batches:
            for _, _, data, bounds in W.blocks(batch.column(0)):
                h, _ = _tokens(data, bounds)
                held.append((_contexts(h), h))
                size += len(h)
                if size >= GATHERED:
                    yield from hand_on()
                    held, size = [], 0
        if size:
            yield from hand_on()

    def merge_pairs(batches):
        for shard, blocks in _by_shard(batches):
            columns = [_unpack(b, 3) for b in blocks]
            for c in columns:
                c[0] = np.cumsum(c[0], dtype=_U)
            context, word, counts = _count_pairs(*(np.concatenate([c[k] for c in columns]) for k in range(3)))
            del columns, blocks
            key = _pair_key(context, word)
            order = np.argsort(key)
            sizes = counts[order]
            large = np.flatnonzero(sizes >= 255)

            def pairs(sink, key=key[order], sizes=sizes, large=large):
                for a in (np.array([len(key), len(large)], "<i8"), key.astype("<u8"), key[large].astype("<u8"), sizes[large].astype("<i8"), np.minimum(sizes, 255).astype(np.uint8)):
                    sink.write(pa.py_buffer(np.ascontiguousarray(a)))

            write_whole(f"{folder}/pairs-{shard:06d}", pairs)
            stats = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(counts), int(counts.sum())]
            # Per context: followers seen once, twice, more. Per word: its count and predecessors.
            head = _runs(context)
            seen = [np.add.reduceat((counts == 1).astype(np.int64), head), np.add.reduceat((counts == 2).astype(np.int64), head), np.add.reduceat((counts > 2).astype(np.int64), head)]
            by_word = np.argsort(word, kind="stable")
            w_head = _runs(word[by_word])
            zero_c, zero_w = np.zeros(len(head), np.int64), np.zeros(len(w_head), np.int64)
            keys = np.concatenate([context[head], word[by_word][w_head]])
            values = [
                np.concatenate([zero_c, np.add.reduceat(counts[by_word], w_head)]),
                np.concatenate([zero_c, np.diff(np.append(w_head, len(word)))]),
                *(np.concatenate([s, zero_w]) for s in seen),
            ]
            order = np.argsort(keys, kind="stable")
            keys, values = _sum_by(keys[order], [v[order] for v in values])
            rows = list(_blocks_by_shard(_shard_of(keys, shards), [keys, *values]))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary()), pa.array([stats if i == 0 else None for i in range(len(rows))], pa.list_(pa.int64()))], names=["shard", "block", "stats"])

    def merge_words(batches):
        for shard, blocks in _by_shard(batches):
            columns = [_unpack(b, 6) for b in blocks]
            for c in columns:
                c[0] = np.cumsum(c[0], dtype=_U)
            whole = [np.concatenate([c[k] for c in columns]) for k in range(6)]
            order = np.argsort(whole[0], kind="stable")
            keys, values = _sum_by(whole[0][order], [v[order].astype(np.int64) for v in whole[1:]])

            def table(sink, keys=keys, values=values):
                for a in (np.array([len(keys)], "<i8"), keys.astype("<u8"), *(v.astype("<i8") for v in values)):
                    sink.write(pa.py_buffer(np.ascontiguousarray(a)))

            write_whole(f"{folder}/words-{shard:06d}", table)
            before = values[1]
            stats = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum()), len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array([stats], pa.list_(pa.int64()))], names=["stats"])

    def shuffled(frame: DataFrame) -> DataFrame:
        return frame.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")

    first = f"{folder}-words"
    shuffled(texts.mapInArrow(gather, "shard int, block binary")).mapInArrow(merge_pairs, "shard int, block binary, stats array<long>").write.parquet(first)
    blocks = spark.read.parquet(first)
    numbers = lambda n: [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(n)]
    n1, n2, n3, n4, distinct, tokens = blocks.where("stats IS NOT NULL").agg(*numbers(6)).first()
    words = shuffled(blocks.select("shard", "block")).mapInArrow(merge_words, "stats array<long>")
    m1, m2, m3, m4, m_more, types = words.agg(*numbers(6)).first()
    lower = _discounts(m1, m2, m3, m4)
    backoff = (lower[0] * m1 + lower[1] * m2 + lower[2] * m_more) / distinct if distinct else 1.0
    return Model(folder, shards, int(tokens), int(types), _discounts(n1, n2, n3, n4), lower, int(distinct), float(backoff))


def _sum_by(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    head = _runs(keys)
    return keys[head], [np.add.reduceat(v, head) for v in values] if len(head) else values


@lru_cache(maxsize=4096)
def _pair_file(uri: str):
    try:
        buffer = map_file(uri).read_buffer()
    except FileNotFoundError:
        return None
    n, large = np.frombuffer(buffer, "<i8", 2)
    key = np.frombuffer(buffer, "<u8", n, 16)
    over = np.frombuffer(buffer, "<u8", large, 16 + 8 * n)
    sizes = np.frombuffer(buffer, "<i8", large, 16 + 8 * (n + large))
    return key, np.frombuffer(buffer, np.uint8, n, 16 + 8 * (n + 2 * large)), over, sizes


@lru_cache(maxsize=4096)
def _word_file(uri: str):
    try:
        buffer = map_file(uri).read_buffer()
    except FileNotFoundError:
        return None
    n = int(np.frombuffer(buffer, "<i8", 1)[0])
    return np.frombuffer(buffer, "<u8", n, 8), [np.frombuffer(buffer, "<i8", n, 8 * (1 + n * (k + 1))) for k in range(5)]


def _look_up(keys: np.ndarray, shards: int, open_shard, found) -> None:
    """Call ``found(slice of keys, places in the shard's arrays, shard)`` for sorted ``keys``, shard by shard."""
    edges = np.append(_runs(shard := _shard_of(keys, shards)), len(keys))
    for a, b in zip(edges[:-1], edges[1:]):
        table = open_shard(int(shard[a]))
        if table is None or not len(table[0]):
            continue
        place = np.searchsorted(table[0], keys[a:b])
        place[place == len(table[0])] = 0
        hit = np.flatnonzero(table[0][place] == keys[a:b])
        found(hit + a, place[hit], table)


def pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of the sorted pair hashes."""
    out = np.zeros(len(keys), np.int64)

    def found(at, place, table):
        out[at] = table[1][place]
        full = out[at] == 255
        if full.any():
            out[at[full]] = table[3][np.searchsorted(table[2], keys[at[full]])]

    _look_up(keys, model.shards, lambda s: _pair_file(f"{model.folder}/pairs-{s:06d}"), found)
    return out


def word_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Five columns per sorted word hash: count, predecessors, followers seen once, twice, more."""
    out = np.zeros((5, len(keys)), np.int64)

    def found(at, place, table):
        for k in range(5):
            out[k, at] = table[1][k][place]

    _look_up(keys, model.shards, lambda s: _word_file(f"{model.folder}/words-{s:06d}"), found)
    return out


def log_probabilities(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token after the one before it, and each token's training count."""
    words, inverse = np.unique(h, return_inverse=True)
    table = word_counts(model, words)
    count, before, one, two, more = table
    uniform = model.backoff / (model.types + 1)
    share = np.maximum(before - _amount(before, model.word_discounts), 0) / max(1, model.continuations)
    lower = (share + uniform)[inverse]
    d1, d2, d3 = model.pair_discounts
    total = np.maximum(count, 1)
    free = np.where(count > 0, (d1 * one + d2 * two + d3 * more) / total, 1.0)
    # The context of a token is the token before it, and END before the first.
    end = int(np.searchsorted(words, END))
    place = np.concatenate([[end], inverse[:-1]])
    keys, back = np.unique(_pair_key(words[place], h), return_inverse=True)
    pairs = pair_counts(model, keys)[back]
    seen = np.where(pairs > 0, (pairs - _amount(pairs, model.pair_discounts)) / total[place], 0.0)
    return np.log10(seen + free[place] * lower), count[inverse]


RESULT = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (the carried columns), tokens, known tokens, additive unigram score and the model's log10 probability.

    Perplexity is ``10 ** (-score / n_tokens)``. Null and empty texts consist of the end token.
    """

    def run(columns):
        for low, high, data, bounds in W.blocks(columns["text"], SCORED):
            h, firsts = _tokens(data, bounds)
            logs, count = log_probabilities(model, h)
            base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            rows = W.owners(firsts)
            n = high - low
            sums = [np.bincount(rows, weights=w, minlength=n) for w in (count > 0, base, logs)]
            yield pa.array(np.arange(low, high)), [pa.array(np.diff(firsts)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]

    return map_rows(docs, run, RESULT, list(carried), ["text"])


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key gives -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % divisor, F.lit(-1))


@query("op4_kneser_ney")
def op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(remainder(F.col("doc_id"), 10) != 0))
    scored = score(docs, model)
    return scored.select(
        "row.doc_id", (remainder(F.col("row.doc_id"), 10) == 0).alias("held_out"),
        "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
