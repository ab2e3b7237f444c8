import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from llm_data import SCHEMA, prose
from quirework.llm import kneser_ney as K, mixture_language as M
from quirework.llm.kneser_ney import remainder


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def discounts(counts):
    n = [counts[k] for k in (1, 2, 3, 4)]
    if not all(n):
        return 0, 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    wanted = 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]
    return 0, *(min(max(d, 0.01), k - 0.01) for k, d in enumerate(wanted, 1))


class Brute:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            self.words.update(tokens(t))
            self.pairs.update(zip([None, *tokens(t)], tokens(t)))
        self.before, self.after = Counter(b for _, b in self.pairs), defaultdict(Counter)
        for (a, _), c in self.pairs.items():
            self.after[a][min(c, 3)] += 1
        self.d, self.e = discounts(Counter(self.pairs.values())), discounts(Counter(self.before.values()))
        self.n = sum(self.words.values())
        self.free = sum(self.e[min(c, 3)] for c in self.before.values()) / max(1, len(self.pairs)) if self.pairs else 1.0

    def lower(self, w):
        return max(self.before[w] - self.e[min(self.before[w], 3)], 0) / max(1, len(self.pairs)) + self.free / (len(self.words) + 1)

    def p(self, a, w):
        if not self.words[a]:
            return self.lower(w)
        c = self.pairs[a, w]
        gamma = sum(self.d[k] * self.after[a][k] for k in (1, 2, 3)) / self.words[a]
        return max(c - self.d[min(c, 3)], 0) / self.words[a] + gamma * self.lower(w)

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (len(self.words) + 1))) for w in t)
        return len(t), sum(self.words[w] > 0 for w in t), base, sum(math.log10(self.p(a, w)) for a, w in zip([None, *t], t))


def compare(train, docs, **options):
    model = K.train(train, **options)
    brute = Brute([r["text"] for r in train.collect()])
    assert (model.tokens, model.types) == (brute.n, len(brute.words))
    got = sorted((r["row"]["doc_id"] or -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in K.score(docs, model).collect())
    want = sorted((r["doc_id"] or -1, *brute.row(r["text"])) for r in docs.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)
    return model, brute


def test_scores_equal_brute_force(corpus):
    held = remainder(corpus["doc_id"], 10) == 0
    _, brute = compare(corpus.where(~held), corpus, per_shard=3000)
    # The model is a distribution: known words and one unknown share the mass.
    for a in ("the", "de", None, "never seen"):
        unknown = brute.p(a, "never seen either")
        assert abs(sum(brute.p(a, w) for w in brute.words) + unknown - 1) < 1e-9


def test_scores_of_odd_rows(odd, corpus, empty):
    compare(odd, odd)
    compare(corpus, odd)
    compare(empty, odd)
    assert K.score(empty, K.train(corpus)).count() == 0


def test_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([(i, "a b " * 40 + "c" * (i % 3), "en", "s", 0) for i in range(30)], SCHEMA)
    compare(docs, docs)


def test_remainder(spark):
    rows = spark.createDataFrame([(7,), (123456,), (None,)], "k long").select(remainder(F.col("k"), 10).alias("r")).collect()
    assert [r["r"] for r in rows] == [zlib.crc32(b"7") % 10, zlib.crc32(b"123456") % 10, -1]


def test_languages_are_told_apart(corpus):
    held = remainder(corpus["doc_id"], 4) == 2
    languages = M.learn(corpus.where(~held))
    assert languages.names == ("en", "fr")
    rows = M.identify(corpus, languages, ("doc_id", "lang")).collect()
    assert len(rows) == corpus.count()
    assert np.mean([r["lang_pred"] == r["row"]["lang"] for r in rows]) > 0.98
    assert all(0 < r["score"] <= 1 and abs(sum(s["share"] for s in r["shares"]) - 1) < 1e-6 for r in rows)


def test_mixed_document(spark, corpus):
    mixed = prose(500, 150) + "\n" + prose(501, 50, "fr")
    docs = spark.createDataFrame([(1, mixed, None, None, 0), (2, prose(502, 200), None, None, 0)], SCHEMA)
    rows = {r["row"]["doc_id"]: r for r in M.identify(docs, M.learn(corpus)).collect()}
    assert rows[1]["lang_pred"] == "en" and 0.6 < rows[1]["score"] < 0.85 and len(rows[1]["shares"]) == 2
    assert rows[2]["score"] == 1.0 and len(rows[2]["shares"]) == 1


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet(np.ones(4), 50))
    like = np.exp(logs)
    firsts, row = np.array([0, 20]), np.repeat([0, 1], [20, 30])
    last = None
    for steps in (1, 3, 10, 40):
        share, value = M._mixture(like, firsts, np.full((2, 4), 0.25), row, steps)
        assert np.allclose(share.sum(axis=1), 1)
        assert last is None or (value >= last - 1e-9).all()
        last = value


def test_languages_of_odd_rows(odd, empty, clashing, corpus):
    languages = M.learn(corpus)
    for r in M.identify(odd, languages, ("text",)).collect():
        has_letter = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter)
    assert {r["lang_pred"] for r in M.identify(odd, M.learn(empty)).collect()} == {"und"}
    assert M.identify(empty, languages).count() == 0
    assert M.keep(clashing, languages, 0.4).columns == clashing.columns


def test_a_language_with_little_of_the_text_is_learned(spark):
    rows = [(i, prose(i, 20_000), "en", "s", 0) for i in range(180)]
    rows += [(1000 + i, prose(i, 330, "fr"), "fr", "s", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sum(len(r[1]) for r in rows if r[2] == "fr") < 0.0006 * sum(len(r[1]) for r in rows)
    languages = M.learn(docs)
    assert languages.names == ("en", "fr")
    held = spark.createDataFrame([(i, prose(2000 + i, 120, "fr"), "fr", "s", 0) for i in range(20)], SCHEMA)
    assert {r["lang_pred"] for r in M.identify(held, languages).collect()} == {"fr"}
