"""Substring dedup over sliding sentence spans.

A text is cut into sentences (to ``.``, ``!``, ``?`` or a line's end), and a sentence further after words that a hash picks, one in ``CUT``, whatever its
length; after ``STRETCH`` words without a cut, after every word until the next one. So cuts don't depend on what stands around a passage: from its
``STRETCH``-th word on, and up to its last cut, all copies are cut alike, also where it was pasted inside a sentence.

Runs of consecutive parts are hashed to 128 bits over their words, so white space between them doesn't matter. From every part on, the shortest
run that has ``MIN_WORDS`` words is hashed, and up to every part, the shortest that ends with it; longer runs that repeat are covered by these. Any
2 * STRETCH + MIN_WORDS - 1 words that repeat hold a run that does. Repeated runs under ``MIN_WORDS`` words stay: the number is a
parameter, and one sentence of a few words that many texts have in common is no copied passage.

Runs are joined over all documents, and the parts that any non-first occurrence covers are removed, the first being the one of the
smallest id, then the earliest. Of the runs up to a part, only those are hashed from parts whose own shortest run is met more than once, as that run lies within the
other and repeats if it does. A run that many documents share is one row per map task before the shuffle; occurrences are marked by a join
with the first ones, whose large partitions adaptive execution can split. Runs are hashed in numpy, by two polynomials over the words' own hashes.

Cases: a null text is empty; a very long text is cut by itself; rows with one id are ordered by their text's hash, null ids last; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.rows import unique_ids
from veilgraph.plans.workspace import bounded_batches, discard, freeing, materialize, release

MIN_WORDS, CUT = 20, 8
#: Words without a cut after which every word ends a part; 2 * STRETCH + MIN_WORDS - 1 words that repeat are enough to be found.
STRETCH = 15
#: Bytes of text that are hashed at once, and parts of the runs that are joined one after the other, so that their shuffles don't add up on disk.
PIECE, PARTS = 1 << 20, 2
_RUN, _RESULT = "high long, low long, id long, at long", "doc_id long, n_sentences long, n_removed long, n_removed_bytes long, text string"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, PIECE + (1 << 16))
        factors = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for f in factors:
            f[0] = 1
        _POWERS[base] = tuple(np.cumprod(f, dtype=np.uint64) for f in factors)
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(values: np.ndarray, base: int):
    """A function that hashes ``values[a:b]`` for arrays of a and b."""
    up, down = _powers(len(values) + 1, base)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return lambda a, b: _mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


class Parts:
    """Words of some texts, and the parts that they are cut into wherever they stand.

    A part's words are ``bound[u]`` to ``bound[u + 1]``, its bytes ``start[u]`` to ``stop[u]`` of the text that it is in; text ``t`` has the parts ``of[t]`` to ``of[t + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        blank, dot = (raw == 32) | ((raw >= 9) & (raw <= 13)), (raw == 33) | (raw == 46) | (raw == 63)
        starts = np.flatnonzero(~blank & (np.concatenate(([True], blank[:-1])) | (np.concatenate(([False], dot[:-1])) & ~dot)))
        ends = np.flatnonzero(~blank & (np.concatenate((blank[1:], [True])) | (dot & ~np.concatenate((dot[1:], [False]))))) + 1
        letters = raw.astype(np.uint64) + np.uint64(1)
        words = [_hashes(letters, b)(starts, ends) for b in _BASES]
        self.run = [_hashes(w, b) for w, b in zip(words, _BASES, strict=True)]
        lines = np.cumsum(raw == 10)
        natural = dot[ends - 1] | (words[0] % np.uint64(CUT) == 0)
        if len(starts):
            natural |= np.concatenate((lines[starts[1:]] > lines[ends[:-1] - 1], [True]))
        at = np.arange(len(starts))
        last = np.maximum.accumulate(np.where(natural, at, -1))
        cut = natural | (at - np.concatenate(([-1], last))[: len(at)] >= STRETCH)
        self.bound = np.concatenate(([0], np.flatnonzero(cut) + 1))
        self.of = np.searchsorted(self.bound, np.searchsorted(starts, offsets))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.of))
        after = np.concatenate((starts, offsets[-1:]))
        self.start = starts[self.bound[:-1]] - offsets[self.text]
        self.stop = np.minimum(after[self.bound[1:]], offsets[self.text + 1] - 1) - offsets[self.text]

    def from_each(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the shortest run from every part that has so many words."""
        first = np.arange(len(self.bound) - 1)
        end = np.searchsorted(self.bound, self.bound[:-1] + min_words)
        fits = end <= self.of[self.text + 1]
        return first[fits], end[fits]

    def up_to_each(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the shortest run up to every part that has so many words, where it isn't the shortest from its own first part."""
        end = np.arange(1, len(self.bound))
        first = np.searchsorted(self.bound, self.bound[1:] - min_words, "right") - 1
        fits = first >= self.of[self.text]
        first, end = first[fits], end[fits]
        more = np.searchsorted(self.bound, self.bound[first] + min_words) < end
        return first[more], end[more]

    def rows(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        text = self.text[first]
        digests = [f(self.bound[first], self.bound[end]).view(np.int64) for f in self.run]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*digests, ids[text], (first - self.of[text]) << 31 | end - first)], names=["high", "low", "id", "at"])


def _pieces(batch):
    """(row numbers, texts) of a batch, some bytes at once."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column(1).to_pylist()):
        if texts and size + len(text or b"") > PIECE:
            yield rows, texts
            rows, texts, size = [], [], 0
        rows.append(i)
        texts.append(text or b"")
        size += len(texts[-1])
    if texts:
        yield rows, texts


def _runs(min_words: int):
    def runs(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, texts in _pieces(batch):
                parts = Parts(texts)
                yield parts.rows(ids[rows], *parts.from_each(min_words))

    return runs


def _ends(min_words: int):
    def ends(batches):
        for batch in batches:
            ids, starts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for rows, texts in _pieces(batch):
                parts = Parts(texts)
                met = np.zeros(len(parts.bound), bool)
                for t, i in enumerate(rows):
                    met[parts.of[t] + np.array(starts[i].as_py(), np.int64)] = True
                first, end = parts.up_to_each(min_words)
                yield parts.rows(ids[rows], first[met[first]], end[met[first]])

    return ends


def _cut(batches):
    for batch in batches:
        own, covered = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for held, texts in _pieces(batch):
            parts = Parts(texts)
            rows = []
            for t, (i, text) in enumerate(zip(held, texts, strict=True)):
                a, b = int(parts.of[t]), int(parts.of[t + 1])
                gone = np.zeros(b - a, bool)
                for at in covered[i] or ():
                    gone[at >> 31 : (at >> 31) + (at & (1 << 31) - 1)] = True
                kept, upto = [], 0
                for u in (np.flatnonzero(gone) + a).tolist():
                    kept.append(text[upto : parts.start[u]])
                    upto = int(parts.stop[u])
                kept = b"".join([*kept, text[upto:]])
                rows.append((own[i], b - a, int(gone.sum()), len(text) - len(kept), kept.decode("utf-8", "replace")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_sentences", "n_removed", "n_removed_bytes", "text"])


def _met(runs: DataFrame, parts: int = PARTS) -> DataFrame:
    """(id, at, later) of the runs that are met more than once; ``later`` for all but the first of each."""
    out = []
    for part in range(parts):
        rows = runs.where(F.pmod("high", F.lit(parts)) == part)
        first = materialize(rows.groupBy("high", "low").agg(F.min(F.struct("id", "at")).alias("least"), F.count("*").alias("n")).where("n > 1").select("high", "low", "least"))
        release(runs.sparkSession)
        later = (F.col("id") != F.col("least.id")) | (F.col("at") != F.col("least.at"))
        out.append(materialize(rows.join(first, ["high", "low"]).select("id", "at", later.alias("later"))))
        discard(first)
        release(runs.sparkSession)
    return reduce(DataFrame.unionByName, out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_removed_bytes, text) for every row of ``docs``; the numbers are of parts, text is what is left."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = unique_ids(docs, id_col, text_col)
    runs = materialize(keyed.select("id", "bytes").mapInArrow(freeing(_runs(min_words)), _RUN))
    met = _met(runs)
    discard(runs)
    starts = met.groupBy("id").agg(F.collect_list(F.shiftright("at", 31)).alias("starts"))
    ends = materialize(keyed.select("id", "bytes").join(starts, "id").mapInArrow(freeing(_ends(min_words)), _RUN))
    release(spark)
    met_ends = _met(ends, 1)
    discard(ends)
    covered = materialize(met.unionByName(met_ends).where("later").groupBy("id").agg(F.collect_list("at").alias("covered")))
    discard(met, met_ends)
    release(spark)
    return keyed.join(covered, "id", "left").select("own", "bytes", "covered").mapInArrow(freeing(_cut), _RESULT)
