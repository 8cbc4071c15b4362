"""Rule statistics of whole texts, and the features the models of this package draw from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed values of the base rules: symbol characters, words of a window, fewest words, most repeated words in percent.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_digits", "n_runs", "n_types", "n_bytes")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "exclaims", "digits", "runs", "types")

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOL_BYTES = SYMBOLS.encode()
_SEPARATORS = " \t\n\x0b\x0c\r"
_ODD = 0x9E3779B97F4A7C15


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words that lie in an 8-word window which occurs twice or more in the text.

    Rolling hashes rule repeats out (equal windows hash equally); where two hashes meet, ranks of pairs, fours and eights
    of words decide exactly.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h *= np.uint64(_ODD)
        h += hashes[k : k + n]
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):
        rank = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(rank, return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in _SEPARATORS)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    runs = int((hashes[1:] == hashes[:-1]).sum()) if n > 1 else 0
    return (
        n, word_chars, sum(raw.count(c) for c in _SYMBOL_BYTES), dup, repeated_words(words, hashes),
        len(raw) - len(raw.translate(None, _UPPER)), raw.count(b"!"), len(raw) - len(raw.translate(None, _DIGITS)), runs, len(set(words)), len(raw),
    )


def count_columns(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    return np.array([text_counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS: shares of words or characters, so that a text's length shows in one column only."""
    c = dict(zip(COUNTS, np.asarray(counts, float).T, strict=True))
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), np.minimum(c["word_chars"] / n, 40), np.minimum(c["n_symbols"] / n, 4), np.minimum(c["n_dup_lines"] / n * 10, 1), c["n_repeat_words"] / n,
        c["n_upper"] / chars, np.minimum(c["n_exclaim"] / n, 2), c["n_digits"] / chars, c["n_runs"] / n, np.minimum(c["n_types"] / n**0.8, 3),
    ])


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The base rules' verdict on rows of COUNTS."""
    n, repeats = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
