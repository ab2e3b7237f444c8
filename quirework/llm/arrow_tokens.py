"""Token ids in Arrow files of equal-length sequences.

A file holds part of the corpus, in rising order of document id. Its record batches have two columns
of fixed-size lists: ``ids``, the tokens of all its documents laid end to end, ``LENGTH`` to a row,
and ``mask``, true for tokens and false for the padding of the last row. Row *i* starts at byte
``i * LENGTH`` times the width of an id in its batch's buffer, so any sequence can be read from the
mapped file without a copy. A second file beside it lists the documents: key, first token, tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.llm import pieces, words as W
from quirework.llm.carry import name
from quirework.llm.registry import query, read
from quirework.llm.shared_files import map_file, write_whole
from quirework.session import fresh_dir

LENGTH = 2048
END = 1
# Sequences in a record batch.
BATCH = 64


def encoded(docs: DataFrame, bounds: list, key: str, path: str | None, end: int) -> DataFrame:
    """(part, key, ids): each text's ids as bytes, in the part whose range holds its key; null keys come first."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches):
        encoder = pieces.word_bpe(path)
        for batch in batches:
            keys = batch.column(0)
            for low, high, data, offsets in W.blocks(batch.column(1)):
                ids, firsts = encoder.encode(data, offsets)
                # Every document ends with its own end id.
                ids = np.insert(ids, firsts[1:], encoder.dtype(end))
                firsts = firsts + np.arange(len(firsts))
                sizes = (firsts * ids.itemsize).astype(np.int32)
                mine = keys.slice(low, high - low)
                part = np.where(mine.is_null(), 0, np.searchsorted(edges, mine.fill_null(0).to_numpy(zero_copy_only=False), "right"))
                blob = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(sizes), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), mine, blob], names=["part", "doc_key", "ids"])

    return docs.select(name(key).cast("long").alias("doc_key"), "text").mapInArrow(run, "part int, doc_key long, ids binary")


class _Writer:
    """One part's sequence file, filled one document at a time."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, dtype
        self.size = length * BATCH
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        while self.n >= self.size:
            whole = np.concatenate(self.held)
            self._put(whole[: self.size])
            self.held, self.n = [whole[self.size :]], self.n - self.size

    def _put(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, dtype=self.dtype)
        padded[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(len(padded)) < len(ids))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        if len(rest):
            self._put(rest)
        self.out.close()


def write(docs: DataFrame, folder: str, key: str = "doc_id", length: int = LENGTH, path: str | None = None, end: int = END) -> list:
    """Write the files below ``folder``; (part, documents, tokens) of each part that has any, in order.

    Null texts count as empty and hold the end id alone. Documents with equal keys stand together,
    ordered by their ids. Rows without a key come first. An empty table writes no file.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(name(key).cast("double").alias("k")).where("k IS NOT NULL").approxQuantile("k", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts})
    ranged = encoded(docs, bounds, key, path, end).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_key", "ids")
    width = pieces.word_bpe(path).dtype

    def run(batches):
        files: dict[int, list] = {}
        rows = ((p, k, i) for b in batches for p, k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        first = next(rows, None)
        while first is not None:
            part, following = first[0], [None]
            keys, counts = [], []

            def sequences(sink, first=first, part=part, following=following, keys=keys, counts=counts):
                out, row = _Writer(sink, length, width), first
                while row is not None and row[0] == part:
                    ids = np.frombuffer(row[2].as_buffer(), dtype=width)
                    keys.append(row[1])
                    counts.append(len(ids))
                    out.add(ids)
                    row = next(rows, None)
                out.close()
                following[0] = row

            def index(sink, keys=keys, counts=counts):
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
                table = pa.table({"doc_key": pa.array(keys, pa.int64()), "start": starts, "n_tokens": np.array(counts, np.int64)})
                with pa.ipc.new_file(sink, table.schema) as out:
                    out.write_table(table)

            write_whole(f"{folder}/ids-{part:06d}.arrow", sequences)
            write_whole(f"{folder}/docs-{part:06d}.arrow", index)
            files[part] = [len(keys), int(sum(counts))]
            first = following[0]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(files), pa.int32()), "docs": pa.array([f[0] for f in files.values()], pa.int64()), "tokens": pa.array([f[1] for f in files.values()], pa.int64())})

    return sorted(tuple(r) for r in ranged.mapInArrow(run, "part int, docs long, tokens long").collect())


def sequences(folder: str, part: int) -> pa.ipc.RecordBatchFileReader:
    """The sequence file of a part, open for access to any batch."""
    return pa.ipc.open_file(map_file(f"{folder}/ids-{part:06d}.arrow"))


def _stream(reader: pa.ipc.RecordBatchFileReader):
    """The ids under the mask, batch by batch."""
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids, mask = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in (0, 1))
        yield ids if mask.all() else ids[mask]


def read_back(spark: SparkSession, folder: str, parts: list) -> DataFrame:
    """(doc_key, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it in the whole corpus.
    """
    base, tasks = 0, []
    for part, _, tokens in parts:
        tasks.append((part, base))
        base += tokens
    listed = spark.createDataFrame(tasks, "part int, base long")

    def run(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = pa.ipc.open_file(map_file(f"{folder}/docs-{part:06d}.arrow")).read_all()
                counts = index.column("n_tokens").to_numpy()
                crc = np.zeros(len(counts), dtype=np.int64)
                stream, held = _stream(sequences(folder, part)), np.zeros(0, np.uint16)
                for i, left in enumerate(counts.tolist()):
                    value = 0
                    while left:
                        if not len(held):
                            held = next(stream)
                        value = zlib.crc32(held[:left].astype("<u4").tobytes(), value)
                        held, left = held[left:], left - min(left, len(held))
                    crc[i] = value
                starts = index.column("start").to_numpy() + base
                for low in range(0, len(crc), 10_000):
                    cut = slice(low, low + 10_000)
                    keys = index.column("doc_key").combine_chunks().slice(low, 10_000)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(starts[cut]), pa.array(counts[cut]), pa.array(crc[cut])], names=["doc_key", "start", "n_tokens", "ids_crc32"])

    return listed.repartitionById(max(1, 1 + max((t[0] for t in tasks), default=0)), F.col("part")).mapInArrow(run, "doc_key long, start long, n_tokens long, ids_crc32 long")


@query("op3_arrow_sequences")
def op3(spark, sf_dir):
    folder = fresh_dir(spark, "sequences")
    parts = write(read(spark, sf_dir, "documents"), folder)
    return read_back(spark, folder, parts).withColumnRenamed("doc_key", "doc_id")
