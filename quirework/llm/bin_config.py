"""Packing pieces into sequences by a configuration linear program.

A configuration says how many pieces of each length share one sequence. The fractional optimum over
all configurations is found by multiplicative weights: every length has a price, a knapsack by
dynamic programming finds the dearest configuration, and the prices of the lengths that it covers
fall. The plan is rounded down to whole sequences, and the few pieces left over are packed best-fit or by
exact subset sums, whichever takes fewer.
The plan is made from the histogram of lengths alone, whose size is the capacity. Spark counts that
histogram and, for each length, the pieces of the tasks before each task. Those counts lie in files that
the tasks map, so a piece gets its rank and its place in the plan where it stands, and is not shuffled.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quirework.llm import pieces, words as W
from quirework.llm.carry import name
from quirework.llm.registry import query, read
from quirework.llm.shared_files import map_file, write_whole
from quirework.session import fresh_dir

CAPACITY = 1024
END = 2
ROUNDS = 90
# Share of a sequence that may stay empty when a length of its configuration has run out.
WASTE = 0.05
# Bytes of text that a worker encodes at a time, and tasks whose counts share a file.
BLOCK = 1 << 20
GROUP = 256
# Pieces that may be left over for the last fit, and turns until then at most.
FEW = 20_000
TURNS = 16
STEP = 0.03
# How far below the dearest configuration another may lie and still be used.
NEAR = 0.02


def encode_pieces(docs: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_key, piece, start, length, ids_crc32, task, place[, ids]) of each piece of at most ``capacity`` tokens.

    A longer document is cut so that all pieces but the first are full. Null counts as empty: one
    piece with the end id. ``place`` counts the pieces of the same length in one run of a task, and
    ``task`` names that run.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder = pieces.byte_bpe(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in W.released(batches):
            for low, high, data, bounds in W.blocks(batch.column(1), BLOCK):
                ids, firsts = encoder.encode(data, bounds)
                ids = np.insert(ids, firsts[1:], encoder.dtype(end))
                firsts = firsts + np.arange(len(firsts))
                n = np.diff(firsts)
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                short = n - (many - 1) * capacity
                start = np.where(number == 0, 0, short[row] + (number - 1) * capacity)
                length = np.where(number == 0, short[row], capacity)
                begin = firsts[row] + start
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(wide[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())), np.int64, len(row))
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                within = np.arange(len(row)) - np.searchsorted(ranked, ranked)
                place = np.empty(len(row), np.int64)
                place[order] = within + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                keys = batch.column(0).slice(low, high - low).take(pa.array(row))
                columns = [keys, *(pa.array(x) for x in (number.astype(np.int32), start, length, crc, np.full(len(row), task, np.int32), place))]
                if with_ids:
                    sizes = np.append(begin, firsts[-1]) * ids.itemsize
                    columns.append(pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(ids)]))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES + ["ids"] * with_ids)

    return docs.select(name(key).cast("long").alias("doc_key"), "text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


NAMES = ["doc_key", "piece", "start", "length", "ids_crc32", "task", "place"]
SCHEMA = "doc_key long, piece int, start long, length long, ids_crc32 long, task int, place long"


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per room: the highest price that fits, and the length to put in first (0: none)."""
    sizes = np.flatnonzero(price > 0)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    value = price[sizes]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        fits = upto[room]
        if fits:
            total = value[:fits] + best[room - sizes[:fits]]
            i = int(total.argmax())
            best[room], pick[room] = total[i], sizes[i]
        if best[room - 1] > best[room]:
            # Nothing is gained by the last unit of room.
            best[room], pick[room] = best[room - 1], pick[room - 1]
    return best, pick


def _configurations(first: np.ndarray, pick: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For each length, the dearest configuration that holds it: longest piece first."""
    room = capacity - first
    columns = [first]
    while room.any():
        size = pick[room]
        if not size.any():
            break
        columns.append(size)
        # The knapsack's choice for a room never exceeds it.
        room = np.where(size > 0, room - size, 0)
    table = -np.sort(-np.stack(columns, axis=1), axis=1)
    return [tuple(x for x in row if x) for row in table.tolist()]


def solve(histogram: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional uses of configurations that cover the histogram, and a lower bound on the sequences.

    Each round prices all lengths, finds the dearest configuration of every length by one knapsack,
    uses those that are worth nearly as much as the dearest of all, and lowers the prices of what
    they cover beyond its share. ``histogram[k]`` counts the pieces of length k.
    """
    capacity = len(histogram) - 1
    wanted = np.flatnonzero(histogram)
    if not len(wanted):
        return {}, 0.0
    demand = histogram[wanted].astype(float)
    log_price = np.log(wanted / capacity)
    bound = float(wanted @ demand) / capacity
    uses: dict[tuple[int, ...], float] = {}
    for turn in range(rounds):
        price = np.zeros(capacity + 1)
        price[wanted] = np.exp(log_price)
        best, pick = _knapsack(price, capacity)
        # Prices over the worth of the dearest configuration are a dual solution.
        bound = max(bound, float(price[wanted] @ demand) / best[capacity])
        worth = price[wanted] + best[capacity - wanted]
        near = worth >= (1 - NEAR) * best[capacity]
        configs = _configurations(wanted[near], pick, capacity)
        weight = demand[near]
        lengths = np.fromiter((x for c in configs for x in c), np.int64)
        many = np.fromiter(map(len, configs), np.int64, len(configs))
        covered = np.bincount(lengths, weights=np.repeat(weight, many), minlength=capacity + 1)[wanted]
        scale = float(wanted @ demand) / float(wanted @ covered)
        log_price -= STEP * np.clip(covered * scale / demand - 1, -1, 2)
        if turn >= rounds // 3:
            for config, w in zip(configs, (weight * scale).tolist()):
                uses[config] = uses.get(config, 0.0) + w
    turns = rounds - rounds // 3
    return {config: w / turns for config, w in uses.items()}, bound


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest sequence that still has room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    open_rooms = np.zeros(capacity + 1, dtype=bool)
    for length in sorted(lengths, reverse=True):
        fits = np.flatnonzero(open_rooms[length:])
        if len(fits):
            room = length + int(fits[0])
            b = rooms[room].pop()
            open_rooms[room] = bool(rooms[room])
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(length)
        rooms[room - length].append(b)
        open_rooms[room - length] = True
    return bins


def fullest_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The longest piece left, then those that fill its sequence best, longest first.

    The sums that the other pieces can reach are the bits of one number, so a sequence takes one
    shift per piece tried, and stops as soon as its room can be filled exactly.
    """
    left = np.bincount(lengths, minlength=capacity + 1)
    bins: list[list[int]] = []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        room, mask = capacity - longest, (1 << (capacity - longest + 1)) - 1
        tried, reached = [], [1]
        for size in np.flatnonzero(left[: room + 1])[::-1].tolist():
            for _ in range(min(int(left[size]), room // size)):
                tried.append(size)
                reached.append((reached[-1] | reached[-1] << size) & mask)
            if reached[-1] >> room:
                break
        total, chosen = reached[-1].bit_length() - 1, [longest]
        for i in range(len(tried) - 1, -1, -1):
            if not reached[i] >> total & 1:
                chosen.append(tried[i])
                total -= tried[i]
        for size in chosen[1:]:
            left[size] -= 1
        bins.append(sorted(chosen, reverse=True))
    return bins


def plan(histogram: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple], int, float]:
    """Rows (length, from rank, to rank, first sequence, offset), the number of sequences, a lower bound.

    A row serves the ranks [from, to) of its length: rank r stands in sequence first + r - from.
    """
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    rows, sequences = [], 0
    used = np.zeros(capacity + 1, dtype=np.int64)

    def place(config: list[int], copies: int) -> None:
        nonlocal sequences
        offset = 0
        for length in config:
            rows.append((length, int(used[length]), int(used[length] + copies), sequences, offset))
            used[length] += copies
            left[length] -= copies
            offset += length
        sequences += copies

    # Full pieces have no choice.
    full = int(left[capacity])
    if full:
        place([capacity], full)
    bound, waste = 0.0, WASTE
    for turn in range(TURNS):
        solution, lower = solve(left, rounds)
        bound = bound or lower + full
        before, due = sequences, 0.0
        # Running sums are rounded, in order of the lengths, so that like configurations make up for
        # each other; never beyond what is left. The first turn takes those without waste alone.
        for config in sorted((c for c in solution if turn or sum(c) == capacity), reverse=True):
            due, least = due + solution[config], (1 - waste) * sum(config)
            # Without the lengths that have run out, as long as little room is wasted by that.
            while due >= 1 and config and sum(config) >= least:
                inside, need = np.unique(config, return_counts=True)
                whole = min(int(due), int((left[inside] // need).min()))
                if whole:
                    place(list(config), whole)
                    due -= whole
                gone = set(inside[left[inside] < need].tolist())
                config = tuple(x for x in config if x not in gone)
            due = min(due, 1.0)
        # What is left over is solved again until it is few pieces, whatever the corpus.
        if left.sum() <= FEW or (turn and sequences == before and waste == 1):
            break
        # Where hardly anything fitted any more, room is given up.
        waste = 1 if turn and sequences - before < left.sum() / 10 / capacity else WASTE
    # What rounding left.
    rest = [int(k) for k in np.flatnonzero(left) for _ in range(int(left[k]))]
    for config in min(best_fit(rest, capacity), fullest_fit(rest, capacity), key=len):
        place(config, 1)
    return rows, sequences, bound


def _store_bases(based: DataFrame) -> str:
    """A folder of files, one for each ``GROUP`` tasks: sorted keys ``task << 32 | length``, then for each the pieces of that length in earlier tasks."""
    folder = fresh_dir(based.sparkSession, "bases")

    def store(rows: pa.Table) -> pa.Table:
        # At most as many rows as lengths in the tasks of a group.
        part, key, base = (c.to_numpy() for c in rows.columns)
        order = np.argsort(key)
        whole = np.concatenate([key[order], base[order]]).astype("<i8").tobytes()
        write_whole(f"{folder}/{part[0]}", lambda sink: sink.write(whole))
        return rows.select(["part"]).slice(0, 1)

    task = F.col("task").cast("long")
    rows = based.select(F.floor(task / GROUP).alias("part"), F.shiftleft(task, 32).bitwiseOR(F.col("length")).alias("key"), "base")
    rows.groupBy("part").applyInArrow(store, "part long").count()
    return folder


@lru_cache(maxsize=16)
def _bases(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of a file of ``_store_bases``, and their bases; mapped where that can be."""
    source = map_file(uri)
    rows = np.frombuffer(source.read_buffer(source.size()), "<i8")
    return rows[: len(rows) // 2], rows[len(rows) // 2 :]


def pack(encoded: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``encode_pieces`` with ``sequence_id`` and ``offset`` instead of task and place.

    ``encoded`` must be stored, for it is read twice. Equal documents are packed like any others;
    full pieces get a sequence each. An empty table gives no rows.
    """
    per_task = encoded.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).checkpoint()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in based.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    rows, _, _ = plan(histogram, rounds)
    # The plan is as large as the rounds and the capacity allow, whatever the corpus.
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    lookup = (table[:, 0] << 48) + table[:, 1]
    names = [c for c in encoded.columns if c not in ("task", "place")]
    folder = _store_bases(based)

    @F.arrow_udf("sequence_id long, offset long")
    def assign(length: pa.Array, task: pa.Array, place: pa.Array) -> pa.Array:
        length, task, place = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, task, place))
        rank = np.empty(len(length), np.int64)
        for group in np.unique(task // GROUP).tolist():
            mine = np.flatnonzero(task // GROUP == group)
            keys, bases = _bases(f"{folder}/{group}")
            rank[mine] = bases[np.searchsorted(keys, task[mine] << 32 | length[mine])] + place[mine]
        at = np.searchsorted(lookup, (length << 48) + rank, "right") - 1
        sequence = table[at, 3] + rank - table[at, 1]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(table[at, 4])], names=["sequence_id", "offset"])

    # Only three numbers of a piece go to Python; its ids stay in Spark, in the task that reads them.
    return encoded.select(*names, assign("length", "task", "place").alias("_at")).select(*names, "_at.sequence_id", "_at.offset")


def packed(docs: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Encode, store and pack the texts of ``docs``."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "pieces")
    encode_pieces(docs, key, capacity, with_ids=with_ids).write.parquet(path)
    return pack(spark.read.parquet(path), capacity)


@query("op6_configuration_packing")
def op6(spark, sf_dir):
    return packed(read(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("doc_key", "doc_id")
