"""Language identification as inference of a mixture.

Every language is a distribution over hashed letter trigrams, counted from labelled documents. A
document's words are drawn from an unknown mixture of languages: expectation-maximisation estimates
the proportions from the words' likelihoods, and the set of languages grows as long as the
likelihood gains more than a penalty for each further language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirework.llm import words as W
from quirework.llm.carry import map_rows
from quirework.llm.histograms import SCHEMA, Tally
from quirework.llm.kneser_ney import remainder
from quirework.llm.registry import query, read

BUCKET_BITS = 14
UNKNOWN = "und"
_U = np.uint64


@dataclass(frozen=True)
class Setting:
    """``least_trigrams``: a language's own training trigrams, from which it is learned."""

    least_trigrams: int = 5_000
    smoothing: float = 0.5
    iterations: int = 12
    # What a further language costs, in units of log(words).
    penalty: float = 1.5


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower-case code point of every letter; zero for everything else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, first letter of each word, first word of each row.

    A word is a run of letters; beyond its ends stands a blank.
    """
    points = _fold()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
    chars = np.concatenate([[0], np.cumsum(~W.CONTINUATION[data])])[bounds]
    starts, ends, firsts = W.runs(points > 0, chars)
    letters = np.flatnonzero(points)
    here = points[letters].astype(_U)
    before, after = np.zeros_like(here), np.zeros_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    lengths = ends - starts
    head = np.cumsum(lengths) - lengths
    before[head] = 0
    after[head + lengths - 1] = 0
    with np.errstate(over="ignore"):
        h = ((before * _U(0x9E3779B97F4A7C15)) ^ here) * _U(0xBF58476D1CE4E5B9) + after
        h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return (h >> _U(64 - BUCKET_BITS)).astype(np.int64), head, firsts


@dataclass(frozen=True)
class Languages:
    """Per language only the buckets that occur, their log-likelihoods, and that of all others."""

    names: tuple[str, ...]
    buckets: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]
    others: tuple[np.float32, ...]

    def word_logs(self, bucket: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Log-likelihoods (words x languages); one language's table is spread out at a time."""
        out = np.empty((len(head), len(self.names)), dtype=np.float32)
        for i in range(len(self.names)):
            table = np.full(1 << BUCKET_BITS, self.others[i], dtype=np.float32)
            table[self.buckets[i]] = self.values[i]
            out[:, i] = np.add.reduceat(table[bucket], head)
        return out


def learn(labelled: DataFrame, setting: Setting = Setting()) -> Languages:
    """The languages of ``labelled`` (text, lang); rows without a text or a language are left out."""

    def count(batches):
        tally = Tally(1 << BUCKET_BITS)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for low, high, data, bounds in W.blocks(batch.column(0)):
                bucket, head, firsts = trigrams(data, bounds)
                names = langs[low:high]
                code = {name: i for i, name in enumerate(dict.fromkeys(names))}
                row = np.array([code[name] for name in names])
                first_letter = np.append(head, len(bucket))[firsts]
                of_letter = np.repeat(row, np.diff(first_letter))
                for name, i in code.items():
                    tally.add(name, bucket[of_letter == i])
            if tally.full():
                yield from tally.flush()
        yield from tally.flush()

    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = known.mapInArrow(count, SCHEMA).groupBy("key", "feature").agg(F.sum("n").alias("n")).checkpoint()
    sizes = counts.groupBy("key").agg(F.sum("n").alias("size"))
    large = sizes.where(F.col("size") >= setting.least_trigrams)
    # A language has 2 ** BUCKET_BITS counts at most, and only those that occur are held.
    table = counts.join(large.select("key"), "key", "left_semi").toArrow()
    keys, features, n = table.column(0).combine_chunks().dictionary_encode(), table.column(1).to_numpy(), table.column(2).to_numpy()
    names = keys.dictionary.to_pylist()
    of = keys.indices.to_numpy(zero_copy_only=False)
    by_language = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[by_language], np.arange(len(names) + 1))
    order = sorted(range(len(names)), key=names.__getitem__)
    buckets, values, others = [], [], []
    for i in order:
        mine = by_language[edge[i] : edge[i + 1]]
        total = n[mine].sum() + setting.smoothing * (1 << BUCKET_BITS)
        buckets.append(features[mine].astype(np.uint16))
        values.append(np.log((n[mine] + setting.smoothing) / total).astype(np.float32))
        others.append(np.float32(np.log(setting.smoothing / total)))
    return Languages(tuple(names[i] for i in order), tuple(buckets), tuple(values), tuple(others))


def _mixture(like: np.ndarray, firsts: np.ndarray, share: np.ndarray, row: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over words: proportions per document, and log-likelihood relative to each word's best language."""
    words = np.diff(np.append(firsts, len(like)))[:, None]
    for _ in range(iterations):
        part = like * share[row]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, firsts, axis=0) / words
    return share, np.add.reduceat(np.log((like * share[row]).sum(axis=1)), firsts)


def infer(logs: np.ndarray, firsts: np.ndarray, setting: Setting) -> np.ndarray:
    """Proportions (documents x languages) from log-likelihoods (words x languages); every document has a word.

    Forward selection: the language whose small share would raise the likelihood fastest comes in,
    and stays if the fitted mixture gains more than the penalty. A gain of D in the mean likelihood
    ratio raises the log-likelihood by at most words * log(D), so most documents end unfitted.
    """
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs - top, -60)).astype(np.float64)
    n, count = len(firsts), np.diff(np.append(firsts, len(logs)))
    best = np.add.reduceat(logs.astype(np.float64), firsts, axis=0).argmax(axis=1)
    share = np.zeros((n, logs.shape[1]))
    share[np.arange(n), best] = 1.0
    cost = setting.penalty * np.log(count + 1)
    active = np.arange(n)
    for _ in range(logs.shape[1] - 1):
        if not len(active):
            break
        sizes = count[active]
        take = np.repeat(firsts[active] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        first, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(active)), sizes)
        mine, now = like[take], share[active]
        mixed = (mine * now[row]).sum(axis=1)
        ratio = np.add.reduceat(mine / mixed[:, None], first, axis=0) / sizes[:, None]
        ratio[now > 0] = 0
        enter = ratio.argmax(axis=1)
        gain = sizes * np.log(np.maximum(ratio[np.arange(len(active)), enter], 1e-300))
        go = np.flatnonzero(gain > cost[active])
        if not len(go):
            break
        kept = np.isin(row, go)
        sub = mine[kept]
        sub_sizes = sizes[go]
        sub_first, sub_row = np.cumsum(sub_sizes) - sub_sizes, np.repeat(np.arange(len(go)), sub_sizes)
        before = np.add.reduceat(np.log(mixed[kept]), sub_first)
        trial = now[go] * 0.7
        trial[np.arange(len(go)), enter[go]] = 0.3
        fitted, after = _mixture(sub, sub_first, trial, sub_row, setting.iterations)
        better = after - before > cost[active[go]]
        share[active[go[better]]] = fitted[better]
        active = active[go[better]]
    return share


def identify(docs: DataFrame, languages: Languages, carried: tuple[str, ...] = ("doc_id",), setting: Setting = Setting(), least: float = 0.0, known_only: bool = False) -> DataFrame:
    """``row`` (the carried columns), ``lang_pred``, ``score`` and ``shares`` of all languages found.

    The prediction has the largest share, the first by name among equals; the share is its score.
    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
    language was learned. ``known_only`` leaves out ``und`` and scores below ``least``.
    """
    names = languages.names
    # Words times languages stay within bounds, however many languages there are.
    limit = W.BLOCK * 16 // max(16, len(names))

    def run(columns):
        for low, high, data, bounds in W.blocks(columns["text"], limit):
            n = high - low
            bucket, head, firsts = trigrams(data, bounds)
            share = np.zeros((n, max(1, len(names))))
            filled = np.flatnonzero(np.diff(firsts))
            if len(names) and len(filled):
                share[filled] = infer(languages.word_logs(bucket, head), firsts[:-1][filled], setting)
            best = share.argmax(axis=1)
            value = np.clip(share[np.arange(n), best], 0, 1)
            label = [names[b] if v > 0 else UNKNOWN for b, v in zip(best, value)]
            rows = np.flatnonzero((value > 0) & (value >= least)) if known_only else np.arange(n)
            doc, lang = np.nonzero(share[rows] > 0)
            entries = pa.StructArray.from_arrays([pa.array([names[i] for i in lang], pa.string()), pa.array(share[rows][doc, lang])], names=["lang", "share"])
            shares = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(rows) + 1)), pa.int32()), entries)
            yield pa.array(rows + low), [pa.array([label[i] for i in rows], pa.string()), pa.array(value[rows]), shares]

    return map_rows(docs, run, RESULT, list(carried), ["text"])


RESULT = "lang_pred string, score double, shares array<struct<lang:string,share:double>>"


def keep(docs: DataFrame, languages: Languages, least: float) -> DataFrame:
    """The documents in a learned language with a share of at least ``least``, with all their columns.

    Null texts and texts without a letter have no language and go; equal rows are judged alike.
    """
    return identify(docs, languages, tuple(docs.columns), least=least, known_only=True).select("row.*")


@query("op5_mixture_language")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    found = identify(docs, learn(docs.where(~held)))
    return found.select("row.doc_id", (remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "shares")
