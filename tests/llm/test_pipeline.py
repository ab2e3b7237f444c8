"""The whole pipeline on a small corpus: what each stage keeps, and the packed tokens against the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_data import SCHEMA, prose
from quirework.llm import divergence, mixture_language, pieces
from test_shingle_join import shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rng = random.Random(5)
    items = [prose(9000 + i, 60) for i in range(4)]
    rows = []
    for i in range(260):
        lang = "fr" if i % 3 == 0 else "en"
        rows.append([i, prose(i, 120 + 11 * (i % 50), lang), lang, f"s{i % 4}", i])
    for i in range(260, 300):
        words = rows[i - 260][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append([i, rows[i - 260][1] if i % 2 else " ".join(words), rows[i - 260][2], "s", i])
    for i in range(300, 304):
        rows.append([i, prose(i, 90) + " " + items[i - 300] + " " + prose(i + 50, 90), "en", "s", i])
    rows += [[304, None, "en", "s", 0], [305, "", None, None, None], [306, "too few words", "en", "s", 1], [307, "again and again " * 80, "en", "s", 2], [308, "12 34 " * 9, "en", "s", 3]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder).checkpoint()
        assert kept.columns == docs.columns
        ids.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    quality, language, single, clean = ids
    judged = divergence.judge(docs).select("row.doc_id", "kept").collect()
    assert quality == {r["doc_id"] for r in judged if r["kept"]} and not quality & {304, 305, 306, 307, 308}
    learned = mixture_language.learn(docs.where(F.col("doc_id").isin(*quality)))
    found = mixture_language.identify(docs.where(F.col("doc_id").isin(*quality)), learned).collect()
    assert language <= quality and len(found) == len(quality) and len(language) >= 0.95 * len(quality)
    sets = {i: shingles(texts[i]) for i in language}
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = {i: i for i in sorted(language)}
    for a in sorted(language):
        for b in sorted(language):
            if a < b and similar(a, b):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert single == set(root.values()) and len(single) < len(language)
    assert single - clean == single & {300, 301, 302, 303}
    # Every kept document's tokens, whole and in their order, in gapless sequences of at most 1 024.
    tokenizer = pieces.byte_bpe().tokenizer
    packed = corpus_pipeline.run(spark, folder).collect()
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == clean
    for doc_id, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_run_on_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
