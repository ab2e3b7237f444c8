"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A block matches a template if it holds at least ``CONTAINED`` of the template's distinct words. Blocks
are runs of consecutive words, whatever lines they stand on: twice as long as the longest notice of
their kind and overlapping by half, so every notice stands whole in one of them, and words that are
scattered over a page do not meet in any. The
words are ordered by their frequency in the whole corpus, rarest first; a template's prefix are the
words of which a matching block must have one. Candidates come from the prefixes alone, are thinned
by length and by position, and are then counted exactly, so none is missed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirework.llm import words as W
from quirework.llm.carry import map_rows
from quirework.llm.histograms import SCHEMA, Tally
from quirework.llm.registry import query, read

CONTAINED = 0.9
# Templates travel with the tasks; more words than this must be scanned in several calls.
MOST_TEMPLATE_WORDS = 200_000

# Words of the longest notice of each kind; a block has twice as many, and the next one begins so many further.
REACH = {"short": 12, "long": 36}

# Phrases of the base labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Label, kind of block and wording of public licence notices.
TEMPLATES = [
    ("mit", "short", "Released under the MIT License"),
    ("mit", "long", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "long", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "short", "Licensed under the Apache License, Version 2.0"),
    ("apache", "long", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "short", "licensed under the GNU General Public License, version"),
    ("gpl", "long", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "short", "GNU Lesser General Public License"),
    ("agpl", "short", "GNU Affero General Public License"),
    ("bsd", "long", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "long", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "long", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "long", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "short", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "short", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "short", "Licensed under CC BY-SA 4.0"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@dataclass(frozen=True)
class Index:
    """Templates over words numbered by rising frequency."""

    hashes: np.ndarray  # sorted hashes of all template words
    number: np.ndarray  # the word number of each of them
    member: np.ndarray  # templates x words
    needed: np.ndarray  # words that a match must share
    size: np.ndarray
    short: np.ndarray  # whether the template is held against short blocks
    prefix_at: np.ndarray  # word number -> first entry of the two lists below
    prefix_of: np.ndarray  # the templates whose prefix holds the word
    prefix_place: np.ndarray  # and the place that it has there
    labels: tuple[str, ...]


def _hash(words: list[str]) -> np.ndarray:
    data = "\n".join(words).encode()
    array = np.frombuffer(data, dtype=np.uint8)
    starts, ends, _ = W.lines(array, np.array([0, len(array)]))
    return W.hashes(array, starts, ends)


def _find(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted vocabulary, or -1."""
    sieve = np.zeros(1 << 16, dtype=bool)
    sieve[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    out = np.full(len(h), -1)
    maybe = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
    hit = vocabulary[place] == h[maybe]
    out[maybe[hit]] = place[hit]
    return out


def _vocabulary(templates) -> list[str]:
    out = sorted({w for _, _, text in templates for w in words_of(text)} | {w for phrase, _ in PHRASES for w in phrase.split()})
    if len(out) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"more than {MOST_TEMPLATE_WORDS} distinct template words: scan in several calls")
    return out


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of the given words stands in the whole corpus."""
    h = _hash(words)
    order = np.argsort(h)

    def count(batches):
        tally = Tally(len(words))
        for batch in batches:
            for _, _, data, bounds in W.blocks(batch.column(0)):
                data = W.LOWER[data]
                starts, ends, _ = W.spans(data, bounds, W.ALPHANUMERIC)
                found = _find(W.hashes(data, starts, ends), h[order])
                tally.add("", found[found >= 0])
        yield from tally.flush()

    rows = docs.select("text").mapInArrow(count, SCHEMA).groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = dict.fromkeys(words, 0)
    out.update({words[order[r["feature"]]]: r["n"] for r in rows})
    return out


def build(templates, counts: dict[str, int], contained: float = CONTAINED) -> Index:
    for _, unit, text in templates:
        if len(words_of(text)) > REACH[unit]:
            raise ValueError(f"a {unit} template has at most {REACH[unit]} words")
    ranked = sorted(counts, key=lambda w: (counts[w], w))
    number = {w: i for i, w in enumerate(ranked)}
    h = _hash(ranked)
    order = np.argsort(h)
    sets = [sorted({number[w] for w in words_of(text)}) for _, _, text in templates]
    member = np.zeros((len(sets), len(ranked)), dtype=bool)
    needed = np.array([max(1, math.ceil(contained * len(s) - 1e-9)) for s in sets])
    entries = []
    for i, s in enumerate(sets):
        member[i, s] = True
        entries += [(w, i, place) for place, w in enumerate(s[: len(s) - needed[i] + 1])]
    entries.sort()
    at = np.searchsorted([e[0] for e in entries], np.arange(len(ranked) + 1))
    return Index(
        h[order], np.arange(len(ranked))[order], member, needed, member.sum(axis=1), np.array([unit == "short" for _, unit, _ in templates]),
        at, np.array([e[1] for e in entries], dtype=np.int64), np.array([e[2] for e in entries], dtype=np.int64), tuple(label for label, _, _ in templates),
    )


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of each range [low, high), and the range that it belongs to."""
    many = high - low
    owner = np.repeat(np.arange(len(low)), many)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + low[owner]


def join(index: Index, block: np.ndarray, word: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, template, shared words) of all matches; ``block`` and ``word`` list the template words of each block."""
    width = index.member.shape[1]
    key = np.unique(block * width + word)
    block, word = key // width, key % width
    heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    first = np.repeat(heads, np.diff(np.append(heads, len(block))))
    size = np.repeat(np.diff(np.append(heads, len(block))), np.diff(np.append(heads, len(block))))
    owner, entry = _expand(index.prefix_at[word], index.prefix_at[word + 1])
    template, place = index.prefix_of[entry], index.prefix_place[entry]
    # Length filter, then positions: what is left on the shorter side must reach the needed overlap.
    rest = 1 + np.minimum(index.size[template] - place, size[owner] - (owner - first[owner])) - 1
    fits = (index.short[template] == short) & (size[owner] >= index.needed[template])
    pair = first[owner] * len(index.labels) + template
    # A pair's first shared prefix word bounds its overlap; rows come in rising word order.
    _, once = np.unique(pair, return_index=True)
    once = once[fits[once] & (rest[once] >= index.needed[template[once]])]
    begin, template = first[owner[once]], template[once]
    who, at = _expand(begin, begin + size[begin] if len(begin) else begin)
    shared = np.bincount(who, weights=index.member[template[who], word[at]], minlength=len(begin)).astype(np.int64)
    good = shared >= index.needed[template]
    return block[begin[good]], template[good], shared[good]


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), templates=None, contained: float = CONTAINED) -> DataFrame:
    """``row`` (the carried columns), the base phrases' places and labels, all labels, best containment.

    The score is the highest contained share of a matching template, 1 where a base phrase stands,
    and 0 without either. Null counts as empty; empty texts and texts without words have no place,
    no label and score 0.
    """
    templates = TEMPLATES if templates is None else templates
    index = build(templates, frequencies(docs, _vocabulary(templates)), contained)
    by_word = {int(h): int(i) for h, i in zip(index.hashes, index.number)}
    phrases = [([by_word[int(h)] for h in _hash(phrase.split())], label) for phrase, label in PHRASES]

    def run(columns):
        for low, high, data, bounds in W.blocks(columns["text"]):
            n = high - low
            data = W.LOWER[data]
            starts, ends, firsts = W.spans(data, bounds, W.ALPHANUMERIC)
            place = _find(W.hashes(data, starts, ends), index.hashes)
            number = np.where(place >= 0, index.number[place], -1)
            row = W.owners(firsts)
            labels, base = [set() for _ in range(n)], [set() for _ in range(n)]
            score, spots = np.zeros(n), []
            for phrase, label in phrases:
                at = np.flatnonzero(number[: max(0, len(number) - len(phrase) + 1)] == phrase[0])
                at = at[row[at] == row[at + len(phrase) - 1]]
                for k, want in enumerate(phrase):
                    at = at[number[at + k] == want]
                spots.append(at)
                for r in np.unique(row[at]):
                    base[r].add(label)
            spots = np.sort(np.concatenate(spots))
            count = W.per_row(spots, firsts)
            from_spot = np.searchsorted(spots, firsts)
            known = np.flatnonzero(number >= 0)
            place = known - firsts[row[known]]
            for short in (True, False):
                # Every word lies in two blocks; a block's number grows with the place and with every row.
                step = place // REACH["short" if short else "long"] + row[known] * (len(data) + 2)
                got, template, shared = join(index, np.concatenate([step, step + 1]), np.tile(number[known], 2), short)
                for r, t, s in zip((got // (len(data) + 2)).tolist(), template.tolist(), shared.tolist()):
                    labels[r].add(index.labels[t])
                    score[r] = max(score[r], s / int(index.size[t]))
            has = count > 0
            score[has] = 1.0
            spot = np.append(spots, 0)
            first = np.where(has, spot[np.minimum(from_spot[:-1], len(spots))] - firsts[:-1], 0)
            last = np.where(has, spot[np.maximum(from_spot[1:] - 1, 0)] - firsts[:-1], 0)
            yield pa.array(np.arange(low, high)), [
                pa.array(np.diff(firsts)), pa.array(count), pa.array(first, mask=~has), pa.array(last, mask=~has),
                pa.array([",".join(sorted(b)) for b in base], pa.string()),
                pa.array([",".join(sorted(b | m)) for b, m in zip(base, labels)], pa.string()), pa.array(score),
            ]

    return map_rows(docs, run, RESULT, list(carried), ["text"])


def _sql() -> str:
    """The same labels from plain set containment in SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"({i}, '{label}', '{unit}', {sorted(set(words_of(text)))})" for i, (label, unit, text) in enumerate(TEMPLATES))
    blocks = " UNION ALL ".join(f"SELECT doc_id, '{unit}' AS unit, pos // {n} - {back} AS b, word FROM places" for unit, n in REACH.items() for back in (0, 1))
    places = ", ".join(
        f"CASE WHEN {' AND '.join(f'''w[i + {k}] = '{x}' ''' for k, x in enumerate(phrase.split()))} THEN '{label}' END" for phrase, label in PHRASES
    )
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
spots AS (SELECT doc_id, i - 1 AS pos, unnest([{places}]) AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS found
  FROM spots WHERE label IS NOT NULL GROUP BY doc_id),
templates(number, label, unit, words) AS (VALUES {values}),
wanted AS (SELECT number, label, unit, len(words) AS size, unnest(words) AS word FROM templates),
places AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM w)
  WHERE word IN (SELECT word FROM wanted)),
blocks AS ({blocks}),
shared AS (SELECT doc_id, label, count(DISTINCT word) AS n, size FROM blocks JOIN wanted USING (unit, word)
  GROUP BY doc_id, unit, b, number, label, size),
hits AS (SELECT doc_id, list(DISTINCT label) AS found, max(n::DOUBLE / size) AS best FROM shared
  WHERE n >= greatest(1, ceil({CONTAINED} * size - 1e-9)) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(base.found, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(hits.found, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN hits USING (doc_id)
"""


@query("op7_license_set_join", _sql())
def op7(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents")).select("row.doc_id", *(part.split()[0] for part in RESULT.split(", ")))
