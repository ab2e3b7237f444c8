"""Token counts of sections, from one encoding of the whole document.

A document is encoded once; its tokens keep the characters that they cover. Sections are spans of
the same text. Both are held against each other by an interval join inside the row that holds them,
since a token meets only sections of its own document.

A token that crosses a boundary is allocated by one of three rules:

``first``     to the section that holds its first character,
``most``      to the section that holds most of its characters, the first of equals,
``parts``     in parts, one for each section that it touches, by its share of characters.

A token whose span is empty counts where it stands. What no section holds is counted in the rest,
section -1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.llm import pieces, words as W
from quirework.llm.carry import map_rows
from quirework.llm.registry import query, read

RULES = ("first", "most", "parts")
RESULT = "section int, start long, stop long, n_tokens long, n_crossing long, weight double"


def _line_sections(data: np.ndarray, bounds: np.ndarray, chars: np.ndarray):
    """Starts and stops of the lines in characters of their row, and the first line of each row."""
    starts, ends, firsts = W.lines(data, bounds)
    last = np.zeros(len(starts), dtype=bool)
    last[firsts[1:] - 1] = True
    base = np.repeat(chars[bounds[:-1]], np.diff(firsts))
    return chars[starts] - base, chars[ends + ~last] - base, firsts


def _given_sections(column: pa.Array, low: int, high: int):
    """The same from a column of lists of (start, stop); lists are sorted by start and do not overlap."""
    lists = column.slice(low, high - low)
    sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], dtype=np.int64)
    values = lists.flatten()
    starts, stops = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    return starts, stops, np.concatenate([[0], np.cumsum(sizes)])


def allocate(token_row, begin, end, section_row, start, stop, firsts, rule: str):
    """(section or -1, weight, crosses) of every part of every token, and the token it belongs to.

    Sections are numbered through all rows; ``firsts`` gives the first of each row.
    """
    # Rows are laid on one axis, far enough apart that no token reaches another row's sections.
    reach = int(max(end.max(initial=0), stop.max(initial=0))) + 2
    key = section_row * reach + start
    at = token_row * reach
    first = np.searchsorted(key, at + begin, "right") - 1
    first = np.maximum(first, firsts[token_row] - 1)
    tail = np.maximum(end - 1, begin)
    last = np.maximum(np.searchsorted(key, at + tail, "right") - 1, firsts[token_row] - 1)
    # Between the last section that begins before the token and the last that begins inside it.
    many = last - first + 1
    token = np.repeat(np.arange(len(begin)), many)
    section = np.arange(len(token)) + np.repeat(first - (np.cumsum(many) - many), many)
    real = section >= firsts[token_row[token]]
    s, e = np.where(real, start[section], 0), np.where(real, stop[section], 0)
    size = np.maximum(end - begin, 1)
    overlap = np.where(real, np.minimum(e, np.maximum(end, begin + 1)[token]) - np.maximum(s, begin[token]), 0)
    overlap = np.maximum(overlap, 0)
    held = np.bincount(token, weights=overlap, minlength=len(begin)).astype(np.int64)
    touched = np.bincount(token, weights=overlap > 0, minlength=len(begin)).astype(np.int64) + (held < size)
    crossing = touched > 1
    if rule == "first":
        inside = (first >= firsts[token_row]) & (begin < np.where(first >= 0, stop[first] if len(stop) else 0, 0))
        return np.arange(len(begin)), np.where(inside, first, -1), np.ones(len(begin)), crossing
    if rule == "most":
        order = np.lexsort((section, -overlap, token))
        head = order[np.searchsorted(token[order], np.arange(len(begin)))]
        best = np.where((overlap[head] > 0) & (overlap[head] >= size - held), section[head], -1)
        return np.arange(len(begin)), best, np.ones(len(begin)), crossing
    kept = overlap > 0
    rest = np.flatnonzero(held < size)
    tokens = np.concatenate([token[kept], rest])
    sections = np.concatenate([section[kept], np.full(len(rest), -1)])
    weights = np.concatenate([overlap[kept] / size[token[kept]], (size - held)[rest] / size[rest]])
    return tokens, sections, weights, crossing


def attribute(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), sections: str | None = None, rule: str = "first", path: str | None = None) -> DataFrame:
    """One row per section: ``row`` (the carried columns), its number and span, and its tokens.

    ``sections`` names a column array<struct<start, stop>> in characters, sorted and disjoint; without
    one the lines are taken, each with its line feed. ``n_tokens`` counts the tokens that have a part
    here, ``n_crossing`` those of them that cross a boundary, ``weight`` sums the parts; under the
    rules ``first`` and ``most`` a token has one part, so the weights of a document's rows always sum
    to its tokens. Section -1 appears where it holds a token. Null counts as empty; an empty text has
    one empty line. Equal rows give equal results.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(columns):
        encoder = pieces.byte_bpe(path, offsets=True)
        given = columns.get(sections) if sections else None
        for low, high, data, bounds in W.blocks(columns["text"]):
            _, token_first, spans = encoder.encode(data, bounds)
            chars = np.concatenate([[0], np.cumsum(~W.CONTINUATION[data])])
            start, stop, firsts = _given_sections(given, low, high) if sections else _line_sections(data, bounds, chars)
            token_row, section_row = W.owners(token_first), W.owners(firsts)
            token, section, weight, crossing = allocate(token_row, spans[:, 0].astype(np.int64), spans[:, 1].astype(np.int64), section_row, start, stop, firsts, rule)
            # The rest of row r is numbered behind all sections.
            slot = np.where(section >= 0, section, len(start) + token_row[token])
            width = len(start) + high - low
            n_tokens = np.bincount(slot, minlength=width)
            n_crossing = np.bincount(slot, weights=crossing[token], minlength=width).astype(np.int64)
            total = np.bincount(slot, weights=weight, minlength=width)
            rest = np.flatnonzero(n_tokens[len(start) :])
            keep = np.concatenate([np.arange(len(start)), len(start) + rest])
            row = np.concatenate([section_row, rest])
            number = np.concatenate([np.arange(len(start)) - np.repeat(firsts[:-1], np.diff(firsts)), np.full(len(rest), -1)])
            nothing = np.zeros(len(rest), np.int64)
            yield pa.array(row + low), [
                pa.array(number.astype(np.int32)), pa.array(np.concatenate([start, nothing])), pa.array(np.concatenate([stop, nothing])),
                pa.array(n_tokens[keep]), pa.array(n_crossing[keep]), pa.array(total[keep]),
            ]

    return map_rows(docs, run, RESULT, list(carried), ["text", *([sections] if sections else [])])


@query("op2_token_spans")
def op2(spark, sf_dir):
    """Tokens of every line of every document."""
    found = attribute(read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "section", "start", "stop", "n_tokens", "n_crossing", "weight")
