"""Near-duplicates by operator 8, checked and completed by an exact join of shingle sets.

A text is the set of its shingles of ``WIDTH`` words; two texts are near-duplicates if their sets
have a Jaccard similarity of at least four fifths. Operator 8 names the first candidates: its
fingerprints are searched in BK-trees, and every set is held against the smallest of its component.
Its radius cannot reach them all: at 0.8 two 64-bit fingerprints differ in some ten bits on average,
and no shard scheme is complete that far out. A join of the sets finds the rest.

Every set is ordered in the same way: shingles that are frequent in a sample come last, the others
by their hash. Two sets that are similar enough share a shingle among the first fifth of each, so
only those are shuffled, and pairs are formed where they meet. Any order gives the same pairs; the
sample only keeps common lines from meeting everywhere. Pairs are thinned by size, by place and by
parities: each set carries the parities of its shingles in some bits, and two sets differ in at least
as many shingles as their parities in bits. The others are counted exactly on the whole sets, so none
is missed and none is wrong.

In every list of three or more sets that meet, each first links to one leader, then, in a round or two,
to the member of another component whose parities are nearest. Members that this has not connected are
compared with the whole list, and a pair leaves the task only if it passes the bound. So a group of
near-copies costs pairs in proportion to its size, and a line that many unlike documents share none.
Members that may be similar to none of another component leave the list after the first round.

Whole texts are never shuffled. A stored row has a number that names the task that wrote it; the numbers
of the rows that are wanted go into a sorted file for each such task, and the tasks that read rows map it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quirework.llm import simhash_tree, words as W
from quirework.llm.carry import map_rows
from quirework.llm.components import components
from quirework.llm.shared_files import map_file, write_whole
from quirework.session import fresh_dir

WIDTH = 5
SEED = 42
# Documents whose shingles are counted to find the frequent ones, and how often those occur there.
SAMPLE = 20_000
FREQUENT = 8
MOST_FREQUENT = 200_000
# Lists of more sets than this are linked to leaders before they are compared in full.
LONG_LIST = 2
# Least bits of a set's parities, and bits for each shingle of larger ones; pairs whose sets are read at once; names that a task remembers.
PARITY_BITS = 512
BITS_A_SHINGLE = 2
SETS_AT_ONCE = 256
MOST_NAMES = 1_000_000
# Rounds in which members of a list link to the nearest one outside their component.
NEAREST_ROUNDS = 2
# Pairs held before they are handed on, and arrays that hold them.
MOST_PAIRS = 1 << 18
MOST_PARTS = 1 << 14
# Bits of a row's number below those of the task that wrote it, as ``monotonically_increasing_id`` has them.
ROW_BITS = 33

_U = np.uint64


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each row, and the first of each row; a short text is one shingle."""
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, bounds, W.NOT_SPACE)
    h = W.hashes(data, starts, ends)
    begin, gram = W.windows(h, firsts, WIDTH)
    row = W.owners(firsts)[begin]
    many = np.diff(firsts)
    short = np.flatnonzero((many > 0) & (many < WIDTH))
    one = h[firsts[short]]
    for k in range(1, WIDTH - 1):
        longer = many[short] > k
        one[longer] = W.pair(one[longer], h[firsts[short][longer] + k])
    gram, row = np.concatenate([gram, W.pair(one, many[short].astype(_U))]), np.concatenate([row, short])
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    return gram, np.searchsorted(row, np.arange(len(bounds)))


def _names(gram: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    view = memoryview(gram.tobytes())
    return np.array([xxhash.xxh64_intdigest(view[8 * a : 8 * b], SEED) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())], dtype=_U).view(np.int64)


def _parities(gram: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """For each row and bit, whether an odd number of its shingles has it; larger sets have more bits."""
    n, size = len(firsts) - 1, np.diff(firsts)
    width = np.maximum(PARITY_BITS, 1 << np.ceil(np.log2(np.maximum(BITS_A_SHINGLE * size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    row = W.owners(firsts)
    place = begin[row] + (gram & (width[row] - 1).astype(_U)).astype(np.int64)
    odd = np.zeros(int(begin[-1]), dtype=np.uint8)
    np.bitwise_xor.at(odd, place, np.uint8(1))
    bits = np.packbits(odd)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(bits)])


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parities of rows of equal length in ``width`` bytes: bit k of a shingle is its hash modulo the bits."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def _with_sets(docs: DataFrame, key: str) -> DataFrame:
    """Stored rows: ``row`` (all columns), ``set_id``, ``size``, ``parities``, the fingerprint ``fp``, ``id`` and a number ``at``."""

    def run(columns):
        for low, high, data, bounds in W.blocks(columns["text"]):
            gram, firsts = shingle_sets(data, bounds)
            yield pa.array(np.arange(low, high)), [
                pa.array(_names(gram, firsts)), pa.array(np.diff(firsts)), _parities(gram, firsts),
                pa.array(simhash_tree.fingerprints(data, bounds).view(np.int64)),
            ]

    path = fresh_dir(docs.sparkSession, "shingle-sets")
    found = map_rows(docs, run, "set_id long, size long, parities binary, fp long", list(docs.columns), ["text"])
    found.withColumn("id", F.col("row").getField(key)).withColumn("at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _rows_at(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The stored rows whose ``at`` is among the numbers; only numbers are shuffled."""
    folder = fresh_dir(rows.sparkSession, "row-numbers")

    def store(batches):
        held = []
        for batch in batches:
            at = batch.column(0).to_numpy()
            for part in np.split(at, np.flatnonzero(np.diff(at >> ROW_BITS)) + 1) if len(at) else []:
                if held and held[0][0] >> ROW_BITS != part[0] >> ROW_BITS:
                    yield put(held)
                    held = []
                held.append(part)
        if held:
            yield put(held)

    def put(held):
        owner = int(held[0][0] >> ROW_BITS)
        write_whole(f"{folder}/{owner}", lambda sink: sink.write(np.concatenate(held).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([owner])], names=["owner"])

    def chosen(batches):
        owner, known = None, None
        for batch in batches:
            at = batch.column("at").to_numpy()
            keep = np.zeros(len(at), dtype=bool)
            for one in np.unique(at >> ROW_BITS).tolist():
                if one != owner:
                    try:
                        owner, known = one, np.frombuffer(map_file(f"{folder}/{one}").read_buffer(), np.int64)
                    except FileNotFoundError:  # none of its rows is wanted
                        owner, known = one, np.zeros(0, np.int64)
                mine = np.flatnonzero(at >> ROW_BITS == one)
                place = np.searchsorted(known, at[mine])
                keep[mine] = np.append(known, -1)[place] == at[mine]
            yield batch.filter(pa.array(keep))

    owners = F.shiftright("at", ROW_BITS)
    numbers.select("at").repartition(owners).sortWithinPartitions("at").mapInArrow(store, "owner long").count()
    return rows.mapInArrow(chosen, rows.schema)


def _frequent(prints: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample, rarest first. They decide only which pairs meet where."""
    count = max(1, prints.count() // SAMPLE)
    part = prints.where(F.pmod(F.xxhash64("set_id"), F.lit(count)) == 0).select(F.col("row.text").alias("text"))

    def grams(batches):
        for batch in batches:
            for _, _, data, bounds in W.blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(data, bounds)[0].view(np.int64))], names=["gram"])

    counted = part.mapInArrow(grams, "gram long").groupBy("gram").count().where(F.col("count") >= FREQUENT)
    table = counted.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).toArrow()
    return table.column(0).to_numpy()[::-1].view(_U)


def _postings(prints: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(gram, size and place in one number, set_id) of the first fifth of each set."""
    order = np.argsort(frequent)
    known, rank = frequent[order], order + 1

    def run(batches):
        # A task hands on a set once, however many copies it holds.
        seen = set()
        for batch in batches:
            for _, _, data, bounds in W.blocks(batch.column(0)):
                gram, firsts = shingle_sets(data, bounds)
                names = _names(gram, firsts)
                if len(seen) > MOST_NAMES:
                    seen.clear()
                size = np.diff(firsts)
                fresh = np.zeros(len(names), dtype=bool)
                for i, one in enumerate(names.tolist()):
                    if one not in seen:
                        seen.add(one)
                        fresh[i] = True
                row = W.owners(firsts)
                late = np.zeros(len(gram), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    late = np.where(known[at] == gram, rank[at], 0)
                to = np.lexsort((gram, late, row))
                gram, place = gram[to], np.arange(len(gram)) - firsts[row]
                kept = fresh[row] & (place <= (size - (4 * size + 4) // 5)[row])
                gram, row, place = gram[kept], row[kept], place[kept]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(size[row] << 32 | place), pa.array(names[row])], names=["gram", "spot", "set_id"])

    return prints.select(F.col("row.text").alias("text")).mapInArrow(run, "gram long, spot long, set_id long")


def _lists(batches):
    """The columns of each run of equal first values, whose rows come together."""
    held, key = [], None

    def whole():
        return [np.concatenate([part[k] for part in held]) for k in range(len(held[0]))]

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not batch.num_rows:
            continue
        first = columns[0]
        # Most runs are of one row. Those that end within the batch are dropped together.
        edge = np.concatenate([[True], first[1:] != first[:-1], [True]])
        several = ~(edge[:-1] & edge[1:])
        several[[0, -1]] = True
        columns = [c[several] for c in columns]
        first = columns[0]
        edges = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]]).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            if held and first[a] != key:
                if len(held) > 1 or len(held[0][0]) > 1:
                    yield whole()
                held = []
            key = first[a]
            held.append([c[a:b] for c in columns])
    if held and (len(held) > 1 or len(held[0][0]) > 1):
        yield whole()


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets with these spots can be similar, if this is the first shingle that they share."""
    m, n = a >> 32, b >> 32
    i, j = a & 0xFFFFFFFF, b & 0xFFFFFFFF
    return (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & (9 * np.minimum(m - i, n - j) >= 4 * (m + n))


def _batch(gram, u, v, spot):
    names = ["gram", "u", "v", "spot"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (gram, u, v, spot)], names=names)


def _meet(batches):
    """Pairs (u, v) of short lists; of long ones the pairs with a leader, and with ``gram`` the members."""
    us, vs, held = [], [], 0
    for gram, spot, name in _lists(batches):
        # Copies of a set come from several tasks.
        once = np.unique(name, return_index=True)[1]
        gram, spot, name = gram[once], spot[once], name[once]
        if len(name) <= LONG_LIST:
            a, b = np.triu_indices(len(name), 1)
        else:
            yield _batch(gram, name, name, spot)
            a, b = np.zeros(len(name) - 1, np.int64), np.arange(1, len(name))
        good = _possible(spot[a], spot[b])
        if not good.any():
            continue
        us.append(name[a[good]])
        vs.append(name[b[good]])
        held += int(good.sum())
        if held > MOST_PAIRS or len(us) > MOST_PARTS:
            u = np.concatenate(us)
            yield _batch([None] * len(u), u, np.concatenate(vs), [None] * len(u))
            us, vs, held = [], [], 0
    if held:
        u = np.concatenate(us)
        yield _batch([None] * len(u), u, np.concatenate(vs), [None] * len(u))


def _levels(parities: np.ndarray, width: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width, the rows of it and of twice as many bytes, and their parities in that width."""
    out = {}
    for w in np.unique(width).tolist():
        part = [np.flatnonzero(width == k) for k in (w, 2 * w)]
        bits = [_folded(np.frombuffer(b"".join(parities[rows]), np.uint8).reshape(len(rows), w * k), w) for rows, k in zip(part, (1, 2)) if len(rows)]
        out[w] = np.concatenate(part), np.concatenate(bits).view(np.uint64)
    return out


def _candidates(nearest: bool):
    """Pairs of a list's members that lie in different components and may be similar by place, size and parities.

    All of them, or for each member outside the largest component the nearest by its parities. In that
    case rows with ``gram`` name the members that lie in such a pair: as components only grow, the
    others never will.
    """

    def handed_on(us, vs, members):
        if us:
            u, v = _ordered_pairs(us, vs)
            yield _batch([None] * len(u), u, v, [None] * len(u))
        if members:
            gram, name, spot = (np.concatenate([part[k] for part in members]) for k in range(3))
            yield _batch(gram, name, name, spot)

    def run(batches):
        us, vs, members, held = [], [], [], 0
        for gram, spot, name, root, parities in _lists(batches):
            paired = np.zeros(len(name), dtype=bool)
            _, inverse, many = np.unique(root, return_inverse=True, return_counts=True)
            width = np.array([len(p) for p in parities])
            levels, size = _levels(parities, width), spot >> 32
            own = {w: np.argsort(rows) for w, (rows, _) in levels.items()}
            # The members of the largest component meet the others only.
            outside = inverse != many.argmax()
            for i in np.flatnonzero(outside).tolist():
                found, far = [], []
                # Sets of such a similarity have widths that differ by one step at most.
                for w in (int(width[i]), int(width[i]) // 2):
                    if w not in levels:
                        continue
                    rows, bits = levels[w]
                    good = _possible(spot[i], spot[rows]) & (inverse[rows] != inverse[i])
                    if w < width[i]:
                        good &= width[rows] == w
                    if not nearest:
                        good &= ~outside[rows] | (rows > i)
                    good = np.flatnonzero(good)
                    mine = bits[own[w][np.searchsorted(rows, i, sorter=own[w])]]
                    apart = np.bitwise_count(bits[good] ^ mine).sum(axis=1, dtype=np.int64)
                    # Sets of such a similarity differ in a ninth of their sizes' sum at most.
                    fits = 9 * apart <= size[rows[good]] + size[i]
                    found.append(rows[good[fits]])
                    far.append(apart[fits] / (size[rows[good[fits]]] + size[i]))
                partner = np.concatenate(found)
                if nearest and len(partner):
                    paired[i] = True
                    paired[partner] = True
                    partner = partner[[np.concatenate(far).argmin()]]
                # Most members find none; they must cost nothing, for a task may see any number of them.
                if not len(partner):
                    continue
                us.append(np.full(len(partner), name[i]))
                vs.append(name[partner])
                held += len(partner)
                if held > MOST_PAIRS or len(us) > MOST_PARTS:
                    yield from handed_on(us, vs, members)
                    us, vs, members, held = [], [], [], 0
            if paired.any():
                members.append((gram[paired], name[paired], spot[paired]))
                held += int(paired.sum())
        yield from handed_on(us, vs, members)

    return run


def _ordered_pairs(us, vs):
    pairs = np.unique(np.sort(np.column_stack([np.concatenate(us), np.concatenate(vs)]), axis=1), axis=0)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _close(batches):
    """Pairs (u, v) whose sets may be similar by their parities."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        size = a.field("size").to_numpy(zero_copy_only=False) + b.field("size").to_numpy(zero_copy_only=False)
        apart = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(a.field("parities"), b.field("parities"))):
            p, q = (np.frombuffer(one.as_buffer(), np.uint8)[None] for one in (x, y))
            width = min(p.shape[1], q.shape[1])
            apart[i] = np.bitwise_count(_folded(p, width) ^ _folded(q, width)).sum(dtype=np.int64)
        keep = pa.array(9 * apart <= size)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _similar(batches):
    for batch in batches:
        u, v, a, b = (batch.column(i) for i in range(4))
        good = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(a, b)):
            p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            good[i] = 9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q))
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])


def _with_both(pairs: DataFrame, table: DataFrame, column) -> DataFrame:
    """(u, v, a, b): the column of both sets of each pair."""
    both = pairs.join(table.select(F.col("set_id").alias("v"), column.alias("b")), "v")
    return both.join(table.select(F.col("set_id").alias("u"), column.alias("a")), "u").select("u", "v", "a", "b")


def _verified(close: DataFrame, prints: DataFrame, least: DataFrame) -> DataFrame:
    """Of distinct, written pairs, links that connect all pairs whose sets have the similarity, counted on the whole sets.

    Each set is counted against one other first; of the other pairs only those that this has not
    connected.
    """
    nodes = close.select(F.col("u").alias("set_id")).union(close.select(F.col("v").alias("set_id"))).distinct()
    one = least.join(nodes, "set_id", "left_semi").select("at")
    rows = _rows_at(prints.select("at", "set_id", F.col("row.text").alias("text")), one)

    def pack(batches):
        for batch in batches:
            for low, high, data, bounds in W.blocks(batch.column(1)):
                gram, firsts = shingle_sets(data, bounds)
                flat = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((8 * firsts).astype(np.int32)), pa.py_buffer(gram)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), flat], names=["set_id", "grams"])

    sets = rows.select("set_id", "text").mapInArrow(pack, "set_id long, grams binary").checkpoint()

    def similar(some):
        # A row holds two whole sets, so a batch takes few of them.
        spark, setting = prints.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
        usual = spark.conf.get(setting)
        spark.conf.set(setting, str(SETS_AT_ONCE))
        try:
            return _with_both(some, sets, F.col("grams")).mapInArrow(_similar, "u long, v long").checkpoint()
        finally:
            spark.conf.set(setting, usual)

    links = similar(close.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    joined = components(links).checkpoint()
    root = lambda end: joined.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    placed = close.join(root("u"), "u", "left").join(root("v"), "v", "left")
    apart = placed.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    return links.union(similar(apart))


def _within_radius(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of operator 8: each set with the smallest one in the component of its fingerprint.

    They are first candidates only; pairs that they leave out are found by the join of the sets.
    """
    held = prints.where("size > 0").select("set_id", "fp").distinct().checkpoint()
    joined = components(simhash_tree.near_links(held.select("fp").distinct())).withColumnRenamed("node", "fp")
    placed = held.join(joined, "fp", "left").select("set_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("set_id").alias("u"))
    return placed.join(least, "root").where("u < set_id").select("u", F.col("set_id").alias("v"))


def _links(prints: DataFrame, least: DataFrame) -> DataFrame:
    """(node, root) of every set that has a near-duplicate."""
    spark = prints.sparkSession
    path = fresh_dir(spark, "shingle-pairs")
    postings = _postings(prints, _frequent(prints))
    met = postings.repartition("gram").sortWithinPartitions("gram", "set_id").mapInArrow(_meet, "gram long, u long, v long, spot long")
    met.write.parquet(path)
    met = spark.read.parquet(path)
    short = met.where(F.col("gram").isNull()).select("u", "v").union(_within_radius(prints)).distinct()
    close = _with_both(short, least, F.struct("parities", "size")).mapInArrow(_close, "u long, v long").checkpoint()
    links = _verified(close, prints, least)
    joined = components(links).checkpoint()
    long = met.where(F.col("gram").isNotNull()).select("gram", "spot", F.col("u").alias("node"))
    if long.isEmpty():
        return joined
    bits = least.select(F.col("set_id").alias("node"), "parities")
    for nearest in [True] * NEAREST_ROUNDS + [False]:
        placed = long.join(joined, "node", "left").select("gram", "spot", "node", F.coalesce("root", "node").alias("root"))
        # Lists whose members are all connected are done.
        open_lists = placed.groupBy("gram").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("gram")
        left = placed.join(open_lists, "gram", "left_semi").join(bits, "node").select("gram", "spot", "node", "root", "parities")
        found = left.repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(_candidates(nearest), "gram long, u long, v long, spot long")
        if nearest:
            found = found.checkpoint()
            long = found.where(F.col("gram").isNotNull()).select("gram", "spot", F.col("u").alias("node"))
        met_again = found.where(F.col("gram").isNull()).select("u", "v").distinct().checkpoint()
        # If no member has a nearest one, no two members of different components may be similar.
        if met_again.isEmpty():
            break
        links = links.union(_verified(met_again, prints, least)).checkpoint()
        joined = components(links).checkpoint()
    return joined


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each component of near-duplicates, with all columns: the smallest key, and of equal keys the smallest set.

    Texts without words are copies of each other. An empty table gives no rows.
    """
    prints = _with_sets(docs, key)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")).alias("first")
    least = prints.groupBy("set_id").agg(first, F.max("size").alias("size"), F.max("parities").alias("parities"))
    least = least.select("set_id", "first.id", "first.at", "size", "parities").checkpoint()
    joined = _links(prints, least.where(F.col("size") > 0)).withColumnRenamed("node", "set_id")
    named = least.drop("parities").join(joined, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "set_id", "at")).alias("first"))
    # A row is known by its number, so copies neither meet nor are dropped one by one.
    return _rows_at(prints.select("row", "at"), chosen.select(F.col("first.at").alias("at"))).select("row.*")
