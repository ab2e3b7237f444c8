"""Alignment of two tokenizers' tokens, window by window between white-space anchors.

A document is encoded in full by a byte-level tokenizer (A) and by one with space-marked pieces (B). An
anchor is a byte offset where tokens of both end and tokens of both that begin with a space follow; the
anchors cut the document into windows of token ids. A window's alignment (groups and links) depends on
its ids alone, so each worker aligns a distinct pair of id tuples once, all new ones of a block at a
time, and remembers it by a 64-bit hash of the ids.

Within a window two tokens are linked if their bytes overlap, and the ends that both share close a group.
Links are numbered pairs of ids; the documents that hold each are counted over the corpus. The counts are
written as sorted arrays, one file for some ids of A, in the shared folder; scoring tasks map them. How
many there are is bounded by both vocabularies, but no task ever holds them as its own memory.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quirework.llm import pieces, words as W
from quirework.llm.carry import map_rows
from quirework.llm.registry import query, read
from quirework.llm.shared_files import map_file, write_whole
from quirework.session import fresh_dir

# Windows and bytes of their groups that a worker remembers; beyond, it starts afresh.
MOST_WINDOWS = 300_000
MOST_BYTES = 24 << 20
# Pieces that each encoder remembers here, and text aligned at once.
MOST_PIECES = 300_000
BLOCK = 1 << 19
# Ids of A whose pairs are kept in one file.
IDS_A_FILE = 1024
# Links that a scoring task looks up at once.
LOOKED_UP = 2_000_000
SPACE = 0x20


def _plain_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_entries(encoder: pieces.Encoder) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer."""
    known = _plain_bytes()
    size = encoder.tokenizer.get_vocab_size()
    entries = [encoder.tokenizer.id_to_token(i) or "" for i in range(size)]
    return [bytes(known[c] for c in e) if all(c in known for c in e) else e.encode() for e in entries]


def piece_entries(encoder: pieces.PieceEncoder) -> list[bytes]:
    """The bytes of every id of a model with space-marked pieces and single bytes."""
    model = encoder.model
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Entries:
    """The bytes of all ids end to end, and where each begins."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.spaced = np.array([e[:1] == b" " for e in entries])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[pieces.expand(self.first[ids], self.size[ids])]


def align(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray):
    """Links (place in a, place in b) and the group of each token, from the ends of tokens of the same bytes."""
    union = np.union1d(end_a, end_b)
    shared = end_a[end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a] if len(b) else end_a[:0]
    # Between two neighbouring ends lie bytes of one token each, and every pair that overlaps has one such place.
    return np.searchsorted(end_a, union), np.searchsorted(end_b, union), np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)


def _listed(ids: np.ndarray, other: np.ndarray, group: np.ndarray, other_group: np.ndarray, numbers: Entries, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` of each group as bytes, and where each group begins."""
    n = int(group[-1]) + 1 if len(group) else 0
    many_a, many_b = np.bincount(group, minlength=n), np.bincount(other_group, minlength=n)
    first = np.cumsum(many_a + many_b) - many_a - many_b
    item = np.empty(len(ids) + len(other), np.int64)
    at_a = np.arange(len(ids)) - (np.cumsum(many_a) - many_a)[group] + first[group]
    at_b = np.arange(len(other)) - (np.cumsum(many_b) - many_b)[other_group] + (first + many_a)[other_group]
    item[at_a], item[at_b] = ids, other + shift
    text, size = numbers.bytes_of(item), numbers.size[item]
    end = np.cumsum(size)
    # The byte behind a number: a comma, a bar behind a group's last of A, a semicolon behind its last of B.
    text[end[first + many_a - 1] - 1] = ord("|")
    text[end[first + many_a + many_b - 1] - 1] = ord(";")
    return text, (end - size)[first]


class Aligner:
    """Both encoders, their entries, and the windows aligned so far."""

    def __init__(self, path_a: str | None, path_b: str | None):
        self.a, self.b = pieces.plain_byte_bpe(path_a, MOST_PIECES), pieces.piece_bpe(path_b, MOST_PIECES)
        self.in_a, self.in_b = Entries(byte_entries(self.a)), Entries(piece_entries(self.b))
        self.width = len(self.in_b.size)
        if len(self.in_a.size) * self.width > 1 << 31:
            raise ValueError("pairs of ids do not fit in 32 bits")
        # Every id in decimal, of A and then of B, with a comma behind it.
        self.numbers = Entries([b"%d," % i for i in (*range(len(self.in_a.size)), *range(self.width))])
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.groups = np.zeros(0, np.int64)
        self.links, self.link_first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.text, self.text_first = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray) -> None:
        """Align new windows, given end to end."""
        end_a, end_b = np.cumsum(self.in_a.size[a]), np.cumsum(self.in_b.size[b])
        x, y, group_a, group_b = align(a, b, end_a, end_b)
        text, group_at = _listed(a, b, group_a, group_b, self.numbers, len(self.in_a.size))
        # Windows end where groups do, so the group of a window's first token is its first group.
        group_first = np.append(group_a, len(group_at))[first_a]
        link_first = np.searchsorted(x, first_a)
        text_first = np.append(group_at, len(text))[group_first]
        at, slots = np.searchsorted(self.keys, keys), len(self.groups) + np.arange(len(keys))
        self.groups = np.concatenate([self.groups, np.diff(group_first)])
        self.link_first = np.concatenate([self.link_first, self.link_first[-1] + link_first[1:]])
        self.text_first = np.concatenate([self.text_first, self.text_first[-1] + text_first[1:]])
        self.links = np.concatenate([self.links, (a[x] * self.width + b[y]).astype(np.int32)])
        self.text = np.concatenate([self.text, text])
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)

    def _kept(self, data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, firsts: np.ndarray, entries: Entries) -> np.ndarray:
        """Whether the tokens' bytes joined are the bytes of each row."""
        size = entries.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])[firsts]
        good = np.diff(total) == np.diff(bounds)
        token, byte = np.repeat(good, np.diff(firsts)), np.repeat(good, np.diff(bounds))
        wrong = entries.bytes_of(ids[token]) != data[byte]
        if wrong.any():
            row = np.repeat(np.arange(len(good)), np.diff(bounds))[byte]
            good[np.unique(row[wrong])] = False
        return good

    def run(self, data: np.ndarray, bounds: np.ndarray):
        """Per row: tokens of both, groups, links (numbered pairs, with their first), and the bytes that list the groups.

        Rows hold the space before their text; rows without bytes, and those that either tokenizer does
        not give back byte by byte, have no tokens.
        """
        (a, first_a), (b, first_b) = self.a.encode(data, bounds), self.b.encode(data, bounds)
        good = self._kept(data, bounds, a, first_a, self.in_a) & self._kept(data, bounds, b, first_b, self.in_b)
        a, b = a[np.repeat(good, np.diff(first_a))].astype(np.int64), b[np.repeat(good, np.diff(first_b))].astype(np.int64)
        n_a, n_b = np.where(good, np.diff(first_a), 0), np.where(good, np.diff(first_b), 0)
        rows = np.concatenate([[0], np.cumsum(np.where(good, np.diff(bounds), 0))])
        end_a, end_b = np.cumsum(self.in_a.size[a]), np.cumsum(self.in_b.size[b])
        # Shared ends before space-marked tokens of both, and the ends of rows.
        at = np.searchsorted(end_b, end_a)
        next_a, next_b = np.append(self.in_a.spaced[a][1:], True), np.append(self.in_b.spaced[b][1:], True)
        near = np.minimum(at, len(end_b) - 1)
        anchor = (end_b[near] == end_a) & ((next_a & next_b[near]) | np.isin(end_a, rows)) if len(a) else np.zeros(0, bool)
        stop_a = np.flatnonzero(anchor) + 1
        stop_b = at[stop_a - 1] + 1
        start_a, start_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
        slot = self._slots(a, b, start_a[: len(stop_a)], stop_a, start_b[: len(stop_b)], stop_b)
        window = np.searchsorted(stop_a, np.concatenate([[0], np.cumsum(n_a)]), "right")
        groups = np.concatenate([[0], np.cumsum(self.groups[slot])])[window]
        many = np.diff(self.link_first)[slot]
        links = self.links[pieces.expand(self.link_first[slot], many)]
        size = np.diff(self.text_first)[slot]
        text = self.text[pieces.expand(self.text_first[slot], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[window]
        # The semicolon behind a row's last group is not part of it.
        joined = [text[x : max(x, y - 1)] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        return n_a, n_b, np.diff(groups), links, np.concatenate([[0], np.cumsum(many)])[window], joined

    def _slots(self, a, b, start_a, stop_a, start_b, stop_b) -> np.ndarray:
        """The remembered alignment of each window; those not known yet are aligned."""
        bytes_a, bytes_b = a.astype("<u4").view(np.uint8), b.astype("<u4").view(np.uint8)
        every = W.pair(W.hashes(bytes_a, 4 * start_a, 4 * stop_a), W.hashes(bytes_b, 4 * start_b, 4 * stop_b))
        keys, example, inverse = np.unique(every, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            fresh = np.flatnonzero(~known)
            if len(self.keys) + len(fresh) > MOST_WINDOWS or len(self.text) > MOST_BYTES:
                self._forget()
                fresh = np.arange(len(keys))
            w = example[fresh]
            many_a, many_b = (stop_a - start_a)[w], (stop_b - start_b)[w]
            first_a, first_b = (np.concatenate([[0], np.cumsum(m)]) for m in (many_a, many_b))
            self._learn(keys[fresh], a[pieces.expand(start_a[w], many_a)], first_a, b[pieces.expand(start_b[w], many_b)], first_b)
            at = np.searchsorted(self.keys, keys)
        return self.slots[at][inverse]


@lru_cache(maxsize=2)
def _aligner(path_a: str | None, path_b: str | None) -> Aligner:
    return Aligner(path_a, path_b)


ALIGNED = "n_a long, n_b long, n_groups long, links array<int>, groups_sha256 string, groups string"


def aligned(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), groups: bool = True, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``row`` (the carried columns), tokens of both, groups and the numbered links of each text.

    A link's number is the id of A times the size of B's vocabulary plus the id of B. ``groups`` lists
    them as ``a1,a2|b1;a3|b2,b3`` (null unless asked for). Null and empty texts, and texts that one of
    the tokenizers does not give back, have no tokens, no links and an empty hash. Equal rows give
    equal results, an empty table none.
    """

    def run(columns):
        aligner = _aligner(path_a, path_b)
        for low, high, data, bounds in W.blocks(columns["text"], BLOCK):
            # A space before every text that has a byte.
            some = np.diff(bounds) > 0
            data, bounds = np.insert(data, bounds[:-1][some], SPACE), bounds + np.concatenate([[0], np.cumsum(some)])
            n_a, n_b, n_groups, links, first, texts = aligner.run(data, bounds)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
            yield pa.array(np.arange(low, high)), [
                pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(links)),
                pa.array(digests), pa.array([t.decode() for t in texts] if groups else [None] * len(texts), pa.string()),
            ]

    return map_rows(docs, run, ALIGNED, list(carried), ["text"])


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(link, n, best): the documents that hold each link, and whether no other link of its A id has more."""
    pairs = found.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").count()
    # An id of A meets no more links than B has ids.
    most = F.max("count").over(Window.partitionBy(F.expr(f"link div {width}")))
    return pairs.select("link", F.col("count").alias("n"), (F.col("count") == most).alias("best"))


def write_counts(counts: DataFrame, folder: str, width: int) -> int:
    """Sorted arrays of links, counts and best marks, one file for ``IDS_A_FILE`` ids of A; the number of links."""

    def write(batches):
        held, shard = [], None

        def flush():
            link, n, best = (np.concatenate([part[k] for part in held]) for k in range(3))

            def table(sink):
                for one in (np.array([len(link)], "<i8"), n.astype("<i8"), link.astype("<i4"), best.astype(np.uint8)):
                    sink.write(pa.py_buffer(np.ascontiguousarray(one)))

            write_whole(f"{folder}/links-{shard:06d}", table)
            return pa.RecordBatch.from_arrays([pa.array([len(link)])], names=["written"])

        for batch in batches:
            shards, *columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            edges = np.flatnonzero(np.diff(shards)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)]):
                if x == y:
                    continue
                if held and shards[x] != shard:
                    yield flush()
                    held = []
                shard = int(shards[x])
                held.append([c[x:y] for c in columns])
        if held:
            yield flush()

    shard = F.expr(f"cast(link div {width} div {IDS_A_FILE} as int)")
    ordered = counts.select(shard.alias("shard"), "link", "n", "best").repartition("shard").sortWithinPartitions("shard", "link")
    return ordered.mapInArrow(write, "written long").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


@lru_cache(maxsize=128)
def _count_file(uri: str):
    buffer = map_file(uri).read_buffer()
    n = int(np.frombuffer(buffer, "<i8", 1)[0])
    return np.frombuffer(buffer, "<i4", n, 8 + 8 * n), np.frombuffer(buffer, "<i8", n, 8), np.frombuffer(buffer, np.uint8, n, 8 + 12 * n)


def _scores(folder: str, per_file: int, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and best mark of each link; all of them are in the files."""
    known, inverse = np.unique(links, return_inverse=True)
    n, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    shard = known // per_file
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(known)]
    for x, y in zip(edges[:-1], edges[1:]):
        if x < y:
            table = _count_file(f"{folder}/links-{int(shard[x]):06d}")
            place = np.searchsorted(table[0], known[x:y])
            n[x:y], best[x:y] = table[1][place], table[2][place]
    return n[inverse], best[inverse]


def scored(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``row`` (the carried columns), the figures of ``aligned`` and, over the links, those that are their A id's commonest (``n_best``) and the sum of their counts.

    A link's count is the number of rows of ``docs`` that hold it; of links with equal counts all are
    the commonest. Rows without tokens have zeros.
    """
    spark = docs.sparkSession
    width = pieces.piece_bpe(path_b).model.get_piece_size()
    stored, folder = fresh_dir(spark, "aligned"), fresh_dir(spark, "link-counts")
    aligned(docs, carried, False, path_a, path_b).drop("groups").write.option("compression", "zstd").parquet(stored)
    found = spark.read.parquet(stored)
    write_counts(pair_counts(found, width), folder, width)
    per_file = width * IDS_A_FILE

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            first = column.offsets.to_numpy()
            links, low = column.values.to_numpy(), 0
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(first, first[low] + LOOKED_UP, "right")) - 1)
                n, best = _scores(folder, per_file, links[first[low] : first[high]])
                bounds = first[low : high + 1] - first[low]
                sums = [np.diff(np.concatenate([[0], np.cumsum(one)])[bounds]) for one in (best, n)]
                rest = [batch.column(0).slice(low, high - low), *(pa.array(s) for s in (np.diff(bounds).astype(np.int64), *sums))]
                yield pa.RecordBatch.from_arrays(rest, names=["kept", "n_links", "n_best", "count_sum"])
                low = high

    kept = [c for c in found.columns if c != "links"]
    inner = found.select(F.struct(*kept).alias("kept"), "links")
    fields = [inner.schema["kept"], *(StructField(name, LongType()) for name in ("n_links", "n_best", "count_sum"))]
    out = inner.mapInArrow(run, StructType(fields))
    return out.select("kept.*", "n_links", "n_best", "count_sum")


@query("op13_token_alignment")
def op13(spark, sf_dir):
    found = scored(read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
