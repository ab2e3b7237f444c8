"""Periodic runs of words: seeds on diagonals, extended once per lag.

A run is a maximal stretch of words with smallest period q that is at least ``least`` words and
``times`` periods long. Its words equal those q places on over at least ``guaranteed(least, times)``
places, so every run holds equal grams of that many words, q apart. Those grams are indexed per
document, and the pairs of an occurrence and the next one are the seeds.

The next occurrence is enough. A gram of k >= q words cannot occur again before q places within a run,
for then the run would have a smaller period; so the seeds of periods up to k are found at lag q, and
there are no more of them than words. Periods above k take grams of twice the size, periods above that
twice again; each octave keeps only places whose shorter gram occurs twice, so in ordinary text little
is left after the first. A pair whose lag is not in its octave is dropped. Hence no seed has a lag that
is a multiple of the smallest period, and no document emits all pairs of occurrences.

A table of the furthest place that each lag has covered suppresses the other seeds of a stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quirework.llm import words as W
from quirework.llm.carry import map_rows
from quirework.llm.registry import query, read

LEAST = 24
TIMES = 3
# Words compared in the first step of an extension; each further step takes twice as many.
STEP = 64


def guaranteed(least: int, times: int) -> int:
    """Words that every run shares with itself one period on, at least."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _reach(h: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The widest [a, b) around ``at`` in which each word equals the one ``lag`` places on, within [low, high)."""
    b, step = at, STEP
    while b < high - lag:
        stop = min(b + step, high - lag)
        differ = np.flatnonzero(h[b:stop] != h[b + lag : stop + lag])
        if len(differ):
            b += int(differ[0])
            break
        b, step = stop, 2 * step
    a, step = at, STEP
    while a > low:
        start = max(a - step, low)
        differ = np.flatnonzero(h[start:a] != h[start + lag : a + lag])
        if len(differ):
            a = start + int(differ[-1]) + 1
            break
        a, step = start, 2 * step
    return a, b


def _seeds(key: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of ``at`` whose key occurs again in its row, and the next such place."""
    order = at[np.argsort(key[at], kind="stable")]
    here, there = order[:-1], order[1:]
    same = (key[here] == key[there]) & (row[here] == row[there])
    return here[same], there[same]


def find(h: np.ndarray, firsts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of all rows by row, start and period: an array of (row, start in the row, length, period)."""
    if times < 3 or least < 2:
        raise ValueError("runs must have three periods and two words at least")
    row = W.owners(firsts)
    stop = firsts[1:][row] if len(row) else row
    many = np.diff(firsts)[row] if len(row) else row
    size, goal = 1, guaranteed(least, times)
    gram, at = h.copy(), np.flatnonzero(many >= least)
    while size < goal:
        step = min(size, goal - size)
        at = at[at + size + step <= stop[at]]
        gram[at] = W.pair(gram[at], gram[at + step])
        size += step
    shorter, found, furthest = 0, [], {}
    repeated = np.zeros(len(h), dtype=bool)
    while len(at):
        here, there = _seeds(W.pair(gram, row.astype(np.uint64)), at, row)
        lag = there - here
        kept = np.flatnonzero((lag > shorter) & (lag <= size))
        order = kept[np.lexsort((here[kept], lag[kept], row[here[kept]]))]
        seed, period = here[order], lag[order]
        # A seed within the gram of the one before it, at the same lag, is in the same stretch.
        near = np.zeros(len(seed), dtype=bool)
        near[1:] = (period[1:] == period[:-1]) & (row[seed[1:]] == row[seed[:-1]]) & (seed[1:] <= seed[:-1] + size)
        for i, q in zip(seed[~near].tolist(), period[~near].tolist()):
            r = int(row[i])
            if i < furthest.get((r, q), 0):
                continue
            a, b = _reach(h, i, q, int(firsts[r]), int(firsts[r + 1]))
            furthest[r, q] = b
            if b - a + q >= max(least, times * q):
                found.append((r, a - int(firsts[r]), b - a + q, q))
        repeated[:] = False
        repeated[here] = repeated[there] = True
        shorter, size = size, 2 * size
        at = np.flatnonzero(repeated & (many >= times * (shorter + 1)))
        at = at[at + size <= stop[at]]
        at = at[repeated[at + shorter]]
        gram[at] = W.pair(gram[at], gram[at + shorter])
    return np.array(sorted(found, key=lambda run: (run[0], run[1], run[3])), dtype=np.int64).reshape(-1, 4)


RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``row`` (the carried columns), the runs by start and period, and the text without repetitions.

    ``collapsed`` holds the words that lie in no run behind its first period, joined by one space.
    Null counts as empty; empty texts have no run and collapse to an empty text, texts without runs to
    their words. Equal rows give equal results, an empty table none. Words are compared by 64-bit
    hashes of their bytes.
    """

    def run(columns):
        for low, high, data, bounds in W.blocks(columns["text"]):
            starts, ends, firsts = W.spans(data, bounds, W.NOT_SPACE)
            found = find(W.hashes(data, starts, ends), firsts, least, times)
            begin = firsts[found[:, 0]] + found[:, 1]
            covered = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(covered, begin + found[:, 3], 1)
            np.add.at(covered, begin + found[:, 2], -1)
            kept = np.cumsum(covered[:-1]) == 0
            text, place, _ = W.joined(data, starts[kept], ends[kept])
            edge = np.append(place, len(text))[np.concatenate([[0], np.cumsum(kept)])[firsts]]
            raw = text.tobytes()
            rows = pa.array(np.searchsorted(found[:, 0], np.arange(high - low + 1)), pa.int32())
            items = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
            # The space behind a row's last word is not part of it.
            collapsed = [raw[a : max(a, b - 1)].decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.array(np.arange(low, high)), [pa.ListArray.from_arrays(rows, items), pa.array(collapsed, pa.string())]

    return map_rows(docs, run, RESULT, list(carried), ["text"])


def strongest() -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.reduce("runs", nothing, lambda best, run: F.when(better(best, run), run).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; a tenth of the documents, by their ids, repeats a passage to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    cut = F.expr("floor(h / 10) % size(words)")
    known = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    known = known.withColumn("a", F.when(F.size("words") > 0, cut))
    period = F.expr("1 + floor((size(words) - a) / (3 + floor(h / 10) % 8))")
    place = F.expr("transform(words, (word, i) -> words[int(if(i < a, i, a + (i - a) % p))])")
    changed = known.withColumn("p", period).withColumn("text", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(place, " ")))
    return changed.select("doc_id", "text")


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    found = periodic_runs(planted(read(spark, sf_dir, "documents"))).withColumn("best", strongest())
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
