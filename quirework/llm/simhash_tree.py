"""SimHash near-duplicates found in BK-trees.

A fingerprint holds one bit per majority of its shingles' hashes. Fingerprints within the radius are
found in BK-trees: the children of a node are keyed by their Hamming distance to it, and a search
follows only edges whose distance lies within the radius of the query's own.

One tree over all fingerprints would grow with the corpus, and so would a broadcast of trees. So the
trees are sharded: two fingerprints that differ in at most ``RADIUS`` = 2 bits agree in at least two
of four 16-bit blocks, and every pair of blocks with its values names a shard. Shards that are still
large are sharded once more by the other 32 bits in the same way; then 48 bits are fixed, and a shard
has 65 536 fingerprints at most. Each shard's tree is built and searched where its fingerprints meet.
A shard hands on the components that it found, never its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quirework.llm import words as W
from quirework.llm.carry import map_rows
from quirework.llm.components import components
from quirework.llm.registry import query, read
from quirework.session import fresh_dir

RADIUS = 2
WIDTH = 3
SEED = 42
# Shards with more fingerprints than this are split once more.
LARGE_SHARD = 4096
# Pairs of a query and a node that are compared at once.
FRONTIER = 1 << 20

_U = np.uint64


def fingerprints(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row; zero for a row without words."""
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, bounds, W.NOT_SPACE)
    text, begin, _ = W.joined(data, starts, ends)
    text, stop = text.tobytes(), begin + ends - starts
    n_words = np.diff(firsts)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    bound = np.concatenate([[0], np.cumsum(n_shingles)])
    row = W.owners(bound)
    first = firsts[row] + np.arange(len(row)) - bound[row]
    last = first + np.minimum(width, n_words[row]) - 1
    view, digest = memoryview(text), xxhash.xxh64_intdigest
    h = np.array([digest(view[a:b], seed) for a, b in zip(begin[first].tolist(), stop[last].tolist())], dtype=_U)
    out = np.zeros(len(n_words), dtype=_U)
    filled = np.flatnonzero(n_shingles)
    # Bits are counted in runs of shingles, so that memory stays small for any text.
    counts = np.zeros((len(n_words), 64), dtype=np.int64)
    step = 1 << 15
    for low in range(0, len(h), step):
        part = h[low : low + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        rows = row[low : low + step]
        edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        counts[rows[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    set_bits = (2 * counts > n_shingles[:, None]).astype(np.uint8)
    out[filled] = np.packbits(set_bits, axis=1).reshape(-1, 8).view(">u8").astype(_U)[filled, 0]
    return out


def with_fingerprint(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (the carried columns) and the fingerprint ``fp`` of the text; null counts as empty."""

    def run(columns):
        for low, high, data, bounds in W.blocks(columns["text"]):
            yield pa.array(np.arange(low, high)), [pa.array(fingerprints(data, bounds).view(np.int64))]

    return map_rows(docs, run, "fp long", list(carried), ["text"])


class Forest:
    """BK-trees of many shards, grown together one level at a time."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """``shard`` is sorted; a shard's first fingerprint is the root of its tree."""
        n = len(fp)
        self.fp = fp
        roots = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(roots, np.diff(np.append(roots, n)))
        child_of, child, edge = [], [], []
        item = np.setdiff1d(np.arange(n), roots, assume_unique=True)
        node = self.root[item]
        while len(item):
            distance = np.bitwise_count(fp[item] ^ fp[node]).astype(np.int64)
            place = node * 65 + distance
            order = np.argsort(place, kind="stable")
            ordered = place[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            fresh = order[new]
            child_of.append(node[fresh])
            edge.append(distance[fresh])
            child.append(item[fresh])
            # The others go down to the child that now stands where they would have stood.
            owner = item[fresh][np.cumsum(new) - 1]
            item, node = item[order][~new], owner[~new]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place = join(child_of) * 65 + join(edge)
        order = np.argsort(place)
        self.place, self.child = place[order], join(child)[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) for all nodes within the radius of each query, itself excluded."""
        found_q, found_n = [], []
        stack = [(queries, self.root[queries])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            distance = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (distance <= radius) & (q != node)
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.place, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.place, node * 65 + np.minimum(distance + radius, 64), "right")
            many = high - low
            if many.sum():
                owner = np.repeat(np.arange(len(q)), many)
                offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                stack.append((q[owner], self.child[low[owner] + offset]))
        return np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_n or [np.zeros(0, np.int64)])


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest item reachable from each of n items over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _linked(batches):
    """Rows (key, fp) sorted by both to links (u, v) from a fingerprint to its shard's component."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(key, fp):
        single = np.concatenate([[True], key[1:] != key[:-1]]) & np.concatenate([key[1:] != key[:-1], [True]])
        key, fp = key[~single], fp[~single]
        if not len(fp):
            return
        forest = Forest(key, fp.view(_U))
        # Queries are taken in runs whose links fit in memory whatever the shards look like.
        sizes = np.bincount(forest.root, minlength=len(fp))[forest.root]
        label = np.arange(len(fp))
        part = np.cumsum(sizes) // (FRONTIER * 4)
        for run in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(part)) + 1):
            q, node = forest.search(run, RADIUS)
            below = node < q
            label = roots_of(len(fp), np.concatenate([q[below], np.arange(len(fp))]), np.concatenate([node[below], label]))
        moved = label != np.arange(len(fp))
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], names=["u", "v"])

    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        # The last shard may go on in the next batch.
        cut = int(np.searchsorted(key, key[-1]))
        held_key, held_fp = key[cut:], fp[cut:]
        if cut:
            yield from links(key[:cut], fp[:cut])
    if len(held_key):
        yield from links(held_key, held_fp)


def _block(fp, block: int, size: int):
    return F.shiftrightunsigned(fp, block * size).bitwiseAND(F.lit((1 << size) - 1))


def _shards(base, fp, first: int, blocks: int, size: int):
    """Keys of all pairs of blocks of ``fp`` from bit ``first`` on: hashes of pair and values."""
    low = F.shiftrightunsigned(fp, first)
    return F.array(*(F.xxhash64(base, F.lit(100 * i + j), _block(low, i, size), _block(low, j, size)) for i, j in combinations(range(blocks), 2)))


def _split_shards(base, fp):
    """As ``_shards`` for the two blocks that the first key left open, each cut into two bytes."""
    options = []
    for i, j in combinations(range(4), 2):
        k, m = (b for b in range(4) if b not in (i, j))
        rest = _block(fp, k, 16) + F.shiftleft(_block(fp, m, 16), 16)
        options.append(_shards(F.xxhash64(base, F.lit(100 * i + j)), rest, 0, 4, 8))
    return options


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints ``fp`` within the radius; at most one per shard and fingerprint."""
    pairs = list(combinations(range(4), 2))
    keyed = distinct.select(
        "fp",
        F.posexplode(F.array(*(F.xxhash64(F.lit(n), _block(F.col("fp"), i, 16), _block(F.col("fp"), j, 16)) for n, (i, j) in enumerate(pairs)))).alias("pair", "key"),
    ).checkpoint()
    large = keyed.groupBy("key").count().where(F.col("count") > LARGE_SHARD).select("key", F.lit(True).alias("large"))
    marked = keyed.join(large, "key", "left")
    split = _split_shards(F.lit(0), F.col("fp"))
    finer = F.array(*split)[F.col("pair")]
    final = marked.select(
        "fp",
        F.explode(F.when(F.col("large"), F.transform(finer, lambda k: F.xxhash64("key", k))).otherwise(F.array("key"))).alias("key"),
    )
    return (
        final.select("key", "fp")
        .repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_linked, "u long, v long")
    )


def _grouped(docs: DataFrame, carried: tuple[str, ...], key: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (row, fp, id), and (fp, id, component_id) of the row that stands for each fingerprint.

    Only keys and fingerprints are grouped; the carried columns stay in the stored rows.
    """
    path = fresh_dir(docs.sparkSession, "fingerprints")
    prints = with_fingerprint(docs, tuple(dict.fromkeys([*carried, key])))
    prints.withColumn("id", F.col("row").getField(key)).write.parquet(path)
    prints = docs.sparkSession.read.parquet(path)
    least = prints.groupBy("fp").agg(F.min("id").alias("id")).checkpoint()
    joined = components(near_links(least.select("fp"))).withColumnRenamed("node", "fp").checkpoint()
    by_root = least.join(joined, "fp").groupBy("root").agg(F.min("id").alias("reached"))
    reached = joined.join(by_root, "root").select("fp", "root", "reached")
    named = least.join(reached, "fp", "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("reached")).alias("component_id")
    )
    return prints, named


def near_duplicates(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), key: str = "doc_id") -> DataFrame:
    """``row`` (the carried columns), ``fp`` and ``component_id``, the smallest key that is reachable over links.

    Rows whose texts give the same fingerprint are one node. Null keys get their component like any
    other, but never name one; a component of null keys only has none. Empty texts have fingerprint
    zero. An empty table gives no rows.
    """
    prints, named = _grouped(docs, carried, key)
    return prints.join(named.select("fp", "component_id"), "fp").select("row", "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each component, with all columns: the smallest key, and of equal keys the smallest fingerprint."""
    prints, named = _grouped(docs, tuple(docs.columns), key)
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "fp")).alias("first"))
    chosen = chosen.select(F.col("first.id").alias("chosen_id"), F.col("first.fp").alias("chosen_fp"))
    same = F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("fp") == F.col("chosen_fp"))
    return prints.join(chosen, same, "left_semi").dropDuplicates(["id", "fp"]).select("row.*")


@query("op8_simhash_bk_trees")
def op8(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
