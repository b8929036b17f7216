"""Repetition rules: how much of a text lies in repeated n-grams and lines.

Rolling hashes of several n-gram lengths are taken for all texts of a slice at
once; an n-gram counts as duplicated where its hash occurs twice or more in the
same text. Characters are counted inside duplicated n-grams (2 to 4: the most
frequent one; 5 to 10: all of them) and inside duplicated lines, as shares of
the characters of all words, and compared with published thresholds.

Defined results: null counts as an empty text, which has zeros everywhere and
fails the base rule; very long texts are handled whole, in one slice of their
own; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T

# Thresholds of the repetition rules published with a large-scale corpus study.
TOP_NGRAM_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINE_SHARE = 0.30
DUP_LINE_CHAR_SHARE = 0.20
SYMBOLS = b"#*$%&|<>"

BASE_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, top_ngram_share double, dup_ngram_share array<double>, dup_line_share double, dup_line_char_share double, base_failed boolean, kept boolean"


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of flags between edges."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _in_text(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return keys ^ T.mix(doc.astype(np.uint64) + np.uint64(1))


def measure(t: T.Texts) -> dict:
    n = len(t)
    w = T.Words(t, T.SPACE_SEP, lower=False)
    pre = T.byte_prefix(t.data)
    words = T.range_hash(pre, w.start, w.end)
    lead = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_LEAD[t.data], out=lead[1:])
    chars = lead[w.end] - lead[w.start]
    upto = np.zeros(len(w) + 1, np.int64)
    np.cumsum(chars, out=upto[1:])
    n_words = np.diff(w.first)
    word_chars = upto[w.first[1:]] - upto[w.first[:-1]]
    n_symbols = _per_text(_SYMBOL[t.data], t.offs)
    share = lambda part, whole: part / np.maximum(whole, 1)

    # lines: ranges between line feeds and text borders that hold a word
    feed = np.flatnonzero(t.data == 10)
    begins = np.unique(np.concatenate([t.offs[:-1], feed + 1]))
    begins = begins[begins < len(t.data)]
    stops = np.minimum(np.append(begins[1:], len(t.data)), len(t.data))
    ends_feed = np.zeros(len(begins), bool)
    if len(begins):
        ends_feed = (t.data[stops - 1] == 10) & (stops > begins)
    line_end = stops - ends_feed
    first_word = np.searchsorted(w.start, begins)
    last_word = np.searchsorted(w.start, line_end)
    has = last_word > first_word
    begins, line_end, first_word, last_word = begins[has], line_end[has], first_word[has], last_word[has]
    line_doc = w.doc[first_word] if len(first_word) else first_word
    line_key = _in_text(T.range_hash(pre, begins, line_end), line_doc)
    order = np.argsort(line_key, kind="stable")
    earlier = np.zeros(len(order), bool)
    earlier[order[1:]] = line_key[order[1:]] == line_key[order[:-1]]
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup_lines = np.bincount(line_doc, earlier, n).astype(np.int64)
    line_chars = upto[last_word] - upto[first_word]
    dup_line_chars = np.bincount(line_doc, earlier * line_chars, n)

    top = np.zeros(n)
    bad = np.zeros(n, bool)
    for k, most in TOP_NGRAM_SHARE.items():
        at, key = T.ngrams(words, w.doc, k)
        if not len(at):
            continue
        order = np.argsort(_in_text(key, w.doc[at]))
        sorted_key = _in_text(key, w.doc[at])[order]
        edge = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        count = np.diff(np.append(edge, len(order)))
        one = at[order[edge]]
        mass = np.where(count > 1, count * (upto[one + k] - upto[one]), 0)
        found = np.zeros(n)
        np.maximum.at(found, w.doc[one], mass)
        # the most frequent n-gram may overlap itself: its share is at most 1
        found = np.minimum(share(found, word_chars), 1)
        bad |= found > most
        top = np.maximum(top, found)
    dup = np.zeros((n, len(DUP_NGRAM_SHARE)))
    n_repeat = np.zeros(n, np.int64)
    for i, (k, most) in enumerate(DUP_NGRAM_SHARE.items()):
        at, key = T.ngrams(words, w.doc, k)
        again = at[T.repeated(_in_text(key, w.doc[at]))]
        inside = T.covered(again, k, len(w))
        dup[:, i] = share(_per_text(np.where(inside, chars, 0), w.first), word_chars)
        bad |= dup[:, i] > most
        if k == BASE_WINDOW:
            n_repeat = _per_text(inside, w.first)
    dup_line_share, dup_line_char = share(n_dup_lines, n_lines), share(dup_line_chars, word_chars)
    bad |= (dup_line_share > DUP_LINE_SHARE) | (dup_line_char > DUP_LINE_CHAR_SHARE)
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "top_ngram_share": top,
        "dup_ngram_share": pa.ListArray.from_arrays(pa.array(np.arange(0, dup.size + 1, dup.shape[1], dtype=np.int32)), pa.array(dup.ravel())),
        "dup_line_share": dup_line_share,
        "dup_line_char_share": dup_line_char,
        "base_failed": base,
        "kept": ~base & ~bad,
    }


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, shares and verdict of the repetition rules for every row."""
    return T.per_row(df, [text_col], SCHEMA, measure, [id_col])
