"""Counts and shape statistics of whole documents, from their bytes."""

from __future__ import annotations

import numpy as np

from . import bytescan as b

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in ".,;:!?\"'()"]] = True


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document, and its words."""
    n = len(offsets) - 1
    starts, ends, bounds, hashes = b.word_hashes(data, offsets)
    lead = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(bounds), "word_chars": b.per_doc(lead & ~b.SPACE[data], offsets), "n_symbols": b.per_doc(SYMBOL[data], offsets)}

    heads, tails, line_bounds = b.runs(data != 10, offsets)
    with_word = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
    docs = b.doc_of(line_bounds)[with_word]
    lines = b.piece_hash(data, heads, tails)[with_word]
    out["n_lines"] = np.bincount(docs, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - b.distinct_per_doc(lines, docs, n)

    word_docs = b.doc_of(bounds)
    grams, at = b.ngram_hashes(hashes, bounds, 5)
    twice = at[b.repeated(b.salted(grams, word_docs[at]))]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    out["n_repeat_words"] = b.per_doc(np.cumsum(cover)[:-1] > 0, bounds)
    return out | {"_starts": starts, "_ends": ends, "_bounds": bounds, "_hashes": hashes}


#: The transformed statistics, in the order in which they're kept.
FEATURES = ("log_words", "word_length", "symbols", "upper", "bangs", "bars", "digits", "other_punct", "dup_lines", "repeat_words", "distinct_words", "short_words", "line_words", "non_ascii", "letters")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document: shares go through asinh or a root, so that tails stay short."""
    n = len(offsets) - 1
    c = base_counts(data, offsets)
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(c["n_words"], 1)
    letters = np.maximum(b.per_doc(LETTER[data], offsets), 1)
    short = b.per_doc((c["_ends"] - c["_starts"]) <= 3, c["_bounds"])
    distinct = b.distinct_per_doc(c["_hashes"], b.doc_of(c["_bounds"]), n)
    share = lambda mask, of: np.arcsinh(50 * b.per_doc(mask, offsets) / of)
    out = np.column_stack([
        np.log1p(c["n_words"]),
        np.log1p(c["word_chars"] / words),
        share(SYMBOL[data], size),
        share(UPPER[data], letters),
        share(data == ord("!"), size),
        share(data == ord("|"), size),
        share(DIGIT[data], size),
        share(PUNCT[data], size),
        np.sqrt(c["n_dup_lines"] / np.maximum(c["n_lines"], 1)),
        np.sqrt(c["n_repeat_words"] / words),
        np.log((distinct + 1) / (words + 1)),
        np.sqrt(short / words),
        np.log1p(words / np.maximum(c["n_lines"], 1)),
        share(data >= 128, size) / 4,
        letters / size,
    ])
    return out.astype(np.float64)
