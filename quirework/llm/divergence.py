"""Quality rules by distribution divergence.

Each language with enough text in the corpus gets two reference histograms, counted over all its
documents: classes of characters, and words that are common in it. A document is compared with every
reference by the Jensen-Shannon distance (base 2, 0 to 1). It is kept if one language is close enough
in both, where a histogram counts only from a minimum length on. A document that is labelled with a
language without a reference is not judged by the others: for it the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirework.llm import words as W
from quirework.llm.carry import map_rows
from quirework.llm.histograms import SCHEMA, Tally
from quirework.llm.registry import query, read

# The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"

CLASSES = [
    "vowel", "consonant", "capital", "digit", "space", "line feed", "sentence end", "comma or colon", "exclamation",
    "quote or bracket", "symbol", "other ASCII", "two bytes", "three bytes", "four bytes",
]
BUCKET_BITS = 14


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte >= 0x80:
        return len(CLASSES) if byte < 0xC0 else 12 + (byte >= 0xE0) + (byte >= 0xF0)
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".?", ",;:", "!", "\"'()[]{}", SYMBOLS]
    return next((i for i, group in enumerate(groups) if char in group), 11)


CLASS = W.table(_class_of)
_SYMBOL = W.table(lambda b: chr(b) in SYMBOLS)


@dataclass(frozen=True)
class Rules:
    """Limits of the base rule and of the method."""

    least_words: int = 10
    most_repeated: int = 20  # per cent of the words
    # A limit is base + noise / sqrt(length): short texts stray further by chance.
    class_limit: float = 0.16
    class_noise: float = 2.0
    word_limit: float = 0.20
    word_noise: float = 1.0
    class_least: int = 200  # characters from which the class histogram counts
    word_least: int = 45  # words from which the word histogram counts
    common: float = 0.004  # share of a language's words from which a word is common
    least_reference: int = 20_000  # characters of its own from which a language has a reference


def _common_words(data, starts, ends):
    return (W.hashes(W.LOWER[data], starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def reference_counts(docs: DataFrame) -> DataFrame:
    """(key, feature, n) per language: classes first, then hashed words. Null language: none."""

    def count(batches):
        tally = Tally(len(CLASSES) + (1 << BUCKET_BITS))
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for low, high, data, bounds in W.blocks(batch.column("text")):
                starts, ends, firsts = W.spans(data, bounds, W.NOT_SPACE)
                bucket = _common_words(data, starts, ends)
                classes = CLASS[data]
                names = langs[low:high]
                code = {name: i for i, name in enumerate(dict.fromkeys(names))}
                row = np.array([code[name] for name in names])
                of_byte, of_word = np.repeat(row, np.diff(bounds)), np.repeat(row, np.diff(firsts))
                for name, i in code.items():
                    mine = classes[of_byte == i]
                    tally.add(name, np.concatenate([mine[mine < len(CLASSES)].astype(np.int64), bucket[of_word == i] + len(CLASSES)]))
            if tally.full():
                yield from tally.flush()
        yield from tally.flush()

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return known.mapInArrow(count, SCHEMA).groupBy("key", "feature").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: class shares, buckets of the common words, their shares.

    At most ``1 / common`` words of each language come to the driver. Characters are counted, not
    words, so that languages written without blanks get their reference as early as others.
    """
    counts = reference_counts(docs).withColumn("is_word", F.col("feature") >= len(CLASSES))
    totals = counts.groupBy("key").agg(F.sum(F.when(F.col("is_word"), F.col("n")).otherwise(0)).alias("w"), F.sum(F.when(~F.col("is_word"), F.col("n")).otherwise(0)).alias("chars"))
    large = totals.where(F.col("chars") >= rules.least_reference).select("key", "w")
    rows = (
        counts.join(large, "key")
        .where(~F.col("is_word") | (F.col("n") >= rules.common * F.col("w")))
        .select("key", "feature", "n", "w")
        .collect()
    )
    out = {}
    for name in sorted({r["key"] for r in rows}):
        mine = sorted((r["feature"], r["n"], r["w"]) for r in rows if r["key"] == name)
        classes = np.zeros(len(CLASSES))
        for feature, n, _ in mine:
            if feature < len(CLASSES):
                classes[feature] = n
        common = [(f - len(CLASSES), n / w) for f, n, w in mine if f >= len(CLASSES)]
        out[name] = (classes / max(1.0, classes.sum()), np.array([b for b, _ in common], dtype=np.int64), np.array([s for _, s in common]))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the distribution q; 1 for an empty row."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def _repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mark every item whose hash occurs again in the same row."""
    key = W.pair(h, row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    mark = np.zeros(len(key), dtype=bool)
    mark[order[1:][same]] = True
    mark[order[:-1][same]] = True
    return mark


def measure(data: np.ndarray, bounds: np.ndarray):
    """Base figures per row, and the words' bounds for the method."""
    n = len(bounds) - 1
    starts, ends, firsts = W.spans(data, bounds, W.NOT_SPACE)
    h = W.hashes(data, starts, ends)
    bytes_before = np.concatenate([[0], np.cumsum(ends - starts)])[firsts]
    word_chars = np.diff(bytes_before) - W.per_row(np.flatnonzero(W.CONTINUATION[data]), bounds)
    symbols = W.per_row(np.flatnonzero(_SYMBOL[data]), bounds)
    line_start, line_end, line_first = W.lines(data, bounds)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row = W.owners(line_first)[worded]
    key = W.pair(W.hashes(data, line_start[worded], line_end[worded]), line_row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    dup_lines = np.bincount(line_row[again], minlength=n)
    begin, gram = W.windows(h, firsts, 5)
    covered = np.zeros(len(h), dtype=bool)
    if len(gram):
        twice = begin[_repeats(gram, W.owners(firsts)[begin])]
        for k in range(5):
            covered[twice + k] = True
    repeat_words = W.per_row(np.flatnonzero(covered), firsts)
    return np.diff(firsts), word_chars, symbols, dup_lines, repeat_words, starts, ends, firsts


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, language string, class_distance double, word_distance double"
)
RESULT_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def judge(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), rules: Rules = Rules(), refs: dict | None = None, kept_only: bool = False) -> DataFrame:
    """``row`` (the carried columns), base figures, verdict, nearest language and its distances.

    Null and empty texts have no words and fail the base rule. Ties between languages go to the
    first by name. Equal rows give equal results. Without any reference only the base rule decides,
    and so it does where the label ``lang`` of a document names a language that has none; rows without
    a label are held against all. A distance is null where its minimum length is not met.
    """
    refs = references(docs, rules) if refs is None else refs
    names = list(refs)
    labelled = ["lang"] if "lang" in docs.columns else []

    def run(columns):
        slots = []
        for name in names:
            lut = np.full(1 << BUCKET_BITS, len(refs[name][1]), dtype=np.int64)
            lut[refs[name][1]] = np.arange(len(refs[name][1]))
            slots.append(lut)
        labels = columns["lang"].to_pylist() if labelled else [None] * len(columns["text"])
        foreign = np.array([label is not None and label not in refs for label in labels], dtype=bool)
        for low, high, data, bounds in W.blocks(columns["text"]):
            n = high - low
            n_words, chars, symbols, dups, repeats, starts, ends, firsts = measure(data, bounds)
            failed = (n_words < rules.least_words) | (100 * repeats > rules.most_repeated * n_words)
            width = len(CLASSES) + 1
            of_byte = np.repeat(np.arange(n) * width, np.diff(bounds))
            classes = np.bincount(of_byte + CLASS[data], minlength=n * width).reshape(n, width)[:, :-1]
            n_chars = classes.sum(axis=1)
            long_class, long_word = n_chars >= rules.class_least, n_words >= rules.word_least
            class_limit = rules.class_limit + rules.class_noise / np.sqrt(np.maximum(n_chars, 1))
            word_limit = rules.word_limit + rules.word_noise / np.sqrt(np.maximum(n_words, 1))
            bucket, of_word = _common_words(data, starts, ends), W.owners(firsts)
            best, chosen = np.full(n, np.inf), np.full(n, -1)
            near = np.full((2, n), np.nan)
            for i, name in enumerate(names):
                q, common, share = refs[name]
                wide = len(common) + 1
                counts = np.bincount(of_word * wide + slots[i][bucket], minlength=n * wide).reshape(n, wide)
                d_class = js_distance(classes, q)
                d_word = js_distance(counts, np.append(share, max(0.0, 1 - share.sum())))
                # The worse of the two in units of its limit; 0 where neither counts.
                worse = np.maximum(np.where(long_class, d_class / class_limit, 0), np.where(long_word, d_word / word_limit, 0))
                better = worse < best
                best, chosen = np.where(better, worse, best), np.where(better, i, chosen)
                near = np.where(better, np.stack([d_class, d_word]), near)
            kept = ~failed & ((best <= 1) | foreign[low:high]) if names else ~failed
            rows = np.flatnonzero(kept) if kept_only else np.arange(n)
            none = chosen < 0
            yield pa.array(rows + low), [
                *(pa.array(x[rows].astype(np.int64)) for x in (n_words, chars, symbols, dups, repeats)),
                pa.array(failed[rows]),
                pa.array(kept[rows]),
                pa.array([names[chosen[i]] if chosen[i] >= 0 else None for i in rows], pa.string()),
                pa.array(near[0][rows], mask=(none | ~long_class)[rows]),
                pa.array(near[1][rows], mask=(none | ~long_word)[rows]),
            ]

    return map_rows(docs, run, RESULT, list(carried), ["text", *labelled])


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns; judged in one pass without a join.

    Null, empty and short texts fail the base rule; equal rows are judged alike; an empty table gives none.
    """
    return judge(docs, tuple(docs.columns), rules, kept_only=True).select("row.*")


@query("op1_quality_divergence")
def op1(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents")).select("row.*", *RESULT_NAMES)
