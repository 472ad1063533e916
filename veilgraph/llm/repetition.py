"""Quality rules on repetition coverage.

Beside base rules on the word count and on repeated three-word windows, a text fails if too many of its characters lie
inside duplicated n-grams of several lengths, or in repeated lines. N-grams are compared by a rolling hash
over the text's words in numpy; lengths go up, and stop at the first without a duplicate, as longer
n-grams then have none either.

Words are runs of bytes other than the six ASCII white-space bytes. A character is a code point.

Cases: a null or empty text has no words and fails the base rule; texts of any length are read whole, one at a
time; repeated rows and null ids each get a result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.plans.workspace import bounded_batches, freeing

MIN_WORDS, WINDOW, REPEAT_PERCENT = 50, 3, 50
#: The largest share of characters inside duplicated n-grams of each length, and in lines equal to an earlier one.
COVERAGE = {4: 0.45, 5: 0.42, 6: 0.39, 7: 0.36, 8: 0.33, 9: 0.31, 10: 0.30}
LINE_CHARS = 0.30

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(repeated: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the repeated n-grams."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _exact_windows(ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """A key per n-word window, equal for equal windows only."""
    key, keys = ids, size
    for j in range(1, n):
        if keys * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            keys = len(key)
        key = key[:-1] * size + ids[j : j + len(key) - 1]
        keys *= size
    return key


def measure(text: bytes, coverage: dict[int, float] = COVERAGE) -> dict:
    """All counts and shares of one text."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out = {"n_words": n, "word_chars": 0, "n_symbols": 0, "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": 0, "line_share": 0.0, "shares": [0.0] * len(coverage)}
    if not n:
        return out
    raw = np.frombuffer(b"".join(words), np.uint8)
    points = (raw & 0xC0) != 0x80
    sizes = np.fromiter(map(len, words), np.int64, n)
    chars = np.add.reduceat(points, np.cumsum(sizes) - sizes, dtype=np.int64)
    total = out["word_chars"] = int(chars.sum())
    out["n_symbols"] = int(_SYMBOL[raw].sum())
    if out["n_dup_lines"]:
        seen, again, every = set(), 0, 0
        for line in lines:
            size = len(line.decode("utf-8", "replace"))
            every += size
            if line in seen:
                again += size
            seen.add(line)
        out["line_share"] = again / every
    if n < WINDOW:
        return out
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = _repeated(_exact_windows(ids, WINDOW, len(known)))
    if not repeated.any():
        return out
    out["n_repeat_words"] = int(_covered(repeated, WINDOW, n).sum())
    first = _mixed(ids)
    rolling, length = first, 1
    for k, size in enumerate(coverage):
        while length < size and len(rolling) > 1:
            rolling = rolling[:-1] * _BASE + first[length:]
            length += 1
        if length < size or not (repeated := _repeated(rolling)).any():
            break
        out["shares"][k] = float(chars[_covered(repeated, size, n)].sum() / total) if total else 0.0
    return out


def _judge(min_words: int, percent: int, coverage: dict[int, float], line_chars: float):
    limits = np.array(list(coverage.values()))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches):
        for batch in batches:
            found = [measure(t or b"", coverage) for t in batch.column(1).to_pylist()]
            failed = [m["n_words"] < min_words or 100 * m["n_repeat_words"] > percent * m["n_words"] for m in found]
            kept = [not f and m["line_share"] <= line_chars and not (np.array(m["shares"]) > limits).any() for f, m in zip(failed, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([m[c] for m in found], pa.int64()) for c in counts), pa.array(failed, pa.bool_()), pa.array([bool(k) for k in kept], pa.bool_()), pa.array([m["line_share"] for m in found], pa.float64()), pa.array([m["shares"] for m in found], pa.list_(pa.float64()))],
                names=["doc_id", *counts, "base_failed", "kept", "line_share", "ngram_shares"],
            )

    return judge


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = REPEAT_PERCENT, coverage: dict[int, float] | None = None, line_chars: float = LINE_CHARS) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the measured shares, one row per row of ``docs``. ``coverage`` maps ascending n-gram lengths to limits."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        freeing(_judge(min_words, percent, dict(coverage or COVERAGE), line_chars)),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, ngram_shares array<double>",
    )
