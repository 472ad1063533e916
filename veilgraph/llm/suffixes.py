"""Exact substring dedup with a logarithmic family of suffix arrays.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (in a document with a
smaller id, or earlier in the same document) is removed. A *window* is such a string at one position;
windows never cross documents, and all are judged on the input.

1. Anchors. A window's anchor is the ``GRAM``-byte gram in it with the least hash, the leftmost of
   equals, so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor
   form a *run*: a string of LENGTH - 1 bytes more than it has windows. Only runs whose gram occurs in more than
   one run can hold a repeated window; the others end here.
2. Equal runs. Runs with the same bytes are one string before the shuffle: all windows of all but the
   first are repeats, one row each whatever the size of the group, and the first goes on.
3. Dealing. The different runs of one gram go to one task. Where a key has more than ``GROUP`` of them (the
   edges of very common passages), its runs are cut in four by the place of the gram in the window, and
   the bytes that all windows of a part have in common are its longer key; parts whose key nobody shares
   end here, equal parts are one again. This goes on until no key has more, at most to the whole window. A
   run is four rows then at most, and equal windows always meet under one key.
4. Suffix arrays. Every task keeps a logarithmic family of levels, each the positions of the distinct
   suffixes (to LENGTH bytes) in sorted order. Runs come in document order: a batch gets its own suffix array, is
   merge-scanned against every level for matches, and enters as a level of rank 0; two levels of
   equal rank merge into one of the next, so a suffix is merged a logarithmic number of times. All that
   is found in different runs is found here.

Steps 1 to 3 compare 64-bit hashes of bytes within groups that already agree in another 64-bit
hash; step 4 compares the bytes.

Cases: a null text is empty; texts under LENGTH bytes stay whole; rows with the same id are ordered
by their text's hash, null ids last (``row_ids``); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.rows import unique_ids
from veilgraph.plans.workspace import bounded_batches, discard, freeing, materialize, release

LENGTH, GRAM = 100, 32
#: Different runs of a key beyond which it is dealt by longer keys; results don't depend on it.
GROUP = 256
#: Halvings of the blocks of places at once when a key is made longer.
HALVINGS = 2
#: Bytes of text hashed at once; positions in it fit in _POS bits.
SEGMENT = 1 << 18
_POS = np.uint64(20)
#: Windows in a batch of the family, and about how many a task is to hold.
BATCH, TASK = 1 << 16, 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for the positions of a segment."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(SEGMENT + 1, base, np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a segment in constant time, from prefix sums modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _powers()
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * power[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        """Of the substring of this length at every position."""
        n = max(0, len(self.sums) - length)
        return _mix((self.sums[length : length + n] - self.sums[:n]) * self.inverse[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def runs(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of the documents that begin at ``starts`` in one segment: (document, first window, windows, gram hash, hash of the run's bytes)."""
    n = len(buf) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    ends = np.append(starts[1:], len(buf))
    inside = np.zeros(len(buf) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:n]))
    hashes = Hashes(buf)
    grams = hashes.all(gram)
    keyed = (grams & ~np.uint64((1 << int(_POS)) - 1)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(keyed, length - gram + 1)[at] & np.uint64((1 << int(_POS)) - 1)).astype(np.int64)
    doc = np.searchsorted(starts, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    return doc[first], begin - starts[doc[first]], count, grams[anchor[first]], hashes(begin, begin + count + length - 1)


def _segments(ids: list[int], texts: list[bytes | None], length: int):
    """(ids, offsets in their texts, starts, bytes): short texts together, long ones cut with length - 1 bytes in common."""
    held, size = [], 0
    step = SEGMENT - length + 1
    for i, t in zip(ids, texts, strict=True):
        t = t or b""
        if len(t) < length:
            continue
        for cut in range(0, max(1, len(t) - length + 1), step):
            part = t[cut : cut + SEGMENT]
            if size + len(part) > SEGMENT:
                yield held
                held, size = [], 0
            held.append((i, cut, part))
            size += len(part)
    if held:
        yield held


def _emit_runs(length: int, gram: int):
    def emit(batches):
        for batch in batches:
            for held in _segments(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
                sizes = np.fromiter((len(p) for _, _, p in held), np.int64, len(held))
                starts = np.cumsum(sizes) - sizes
                doc, first, count, g, whole = runs(np.frombuffer(b"".join(p for _, _, p in held), np.uint8), starts, length, gram)
                ids = np.array([i for i, _, _ in held], np.int64)[doc]
                first = first + np.array([c for _, c, _ in held], np.int64)[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids), pa.array(first), pa.array(count.astype(np.int32))],
                    names=["gram", "whole", "id", "first", "n"],
                )

    return emit


_RUN = "gram long, whole long, id long, first long, n int"
_SPAN = "id long, first long, n int"


class Levels:
    """A logarithmic family of suffix arrays, each the positions in ``text`` of distinct suffixes cut at ``length`` bytes, sorted by these bytes."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.text = np.empty(0, np.uint8)
        self.levels: list[np.ndarray | None] = []  # by rank

    def suffixes(self, at: np.ndarray) -> np.ndarray:
        """The bytes at these positions, as strings that numpy compares."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, self.length)[at]).view(f"S{self.length}").ravel()

    def _merged(self, level: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sorted arrays merged, and for each of the merged whether it equals the one before it; of equals, the level's comes first."""
        strings = np.concatenate((self.suffixes(level), self.suffixes(array)))
        order = np.argsort(strings, kind="stable")  # of two sorted runs: one merge
        strings = strings[order]
        return order, np.concatenate(([False], strings[1:] == strings[:-1]))

    def add(self, texts: list[bytes], counts: np.ndarray) -> np.ndarray:
        """For every window of a batch, in order: whether an equal one came before. texts[i] has counts[i] windows."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at, window_at = np.cumsum(sizes) - sizes + len(self.text), np.cumsum(counts) - counts
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(texts), np.uint8)))
        at = np.arange(counts.sum()) + np.repeat(text_at - window_at, counts)
        if not len(at):
            return np.zeros(0, bool)
        strings = self.suffixes(at)
        order = np.argsort(strings, kind="stable")  # equal suffixes stay in order of arrival
        strings = strings[order]
        seen = np.zeros(len(at), bool)
        seen[order[1:]] = strings[1:] == strings[:-1]
        firsts = order[~seen[order]]
        array, known = at[firsts], np.zeros(len(firsts), bool)
        for level in self.levels:
            if level is not None:
                merged, equal = self._merged(level, array)
                known[merged[equal] - len(level)] = True
        seen[firsts[known]] = True
        if len(new := array[~known]):
            self._enter(new)
        return seen

    def _enter(self, level: np.ndarray) -> None:
        for rank, other in enumerate(self.levels):
            if other is None:
                self.levels[rank] = level
                return
            level = np.concatenate((other, level))[self._merged(other, level)[0]]
            self.levels[rank] = None
        self.levels.append(level)


def _spans(seen: np.ndarray, ids: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Maximal runs of seen windows within each text: (id, first window, windows)."""
    base = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    hit = np.flatnonzero(seen)
    if not len(hit):
        return [np.empty(0, np.int64)] * 3
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    begin = np.flatnonzero(new)
    o = owner[hit[begin]]
    return [ids[o], firsts[o] + hit[begin] - base[o], np.diff(np.append(begin, len(hit)))]


def _scan(length: int):
    def scan(batches):
        family = Levels(length)
        held: list[list] = [[], [], [], []]

        def flush():
            counts = np.array(held[2], np.int64)
            found = _spans(family.add(held[3], counts), np.array(held[0], np.int64), np.array(held[1], np.int64), counts)
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int32))], names=["id", "first", "n"])

        waiting = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                waiting += row[2]
                if waiting >= BATCH:
                    yield flush()
                    waiting = 0
        if waiting:
            yield flush()

    return scan


def _cut(length: int):
    """The bytes of the chosen runs of each text."""

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for c in chosen:
                    for column, value in zip(out, (c["gram"], i, c["first"], c["n"], text[c["first"] : c["first"] + c["n"] + length - 1]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["gram", "id", "first", "n", "bytes"])

    return cut


def halves(text: bytes, n: int, length: int, gram: int, level: int) -> list[tuple[bytes, int, int]]:
    """The parts of a run of ``n`` windows (key, first window, windows) when the places that its gram can have in a window are cut into 2**level blocks.

    A part's key holds the bytes that all windows with the gram in that block have in common, and which block it is.
    """
    places = length - gram + 1
    hashes = Hashes(np.frombuffer(text, np.uint8)).all(gram)[:places]
    anchor = int(np.argmin(hashes & ~np.uint64((1 << int(_POS)) - 1)))  # as in ``runs``: the leftmost of the least
    out, window = [], 0
    while window < n:
        block = (anchor - window << level) // places
        low, high = -(-(block * places) >> level), -(-((block + 1) * places) >> level) - 1
        end = min(n, anchor - low + 1)
        out.append((b"%d:" % block + text[anchor - low : anchor - high + length], window, end - window))
        window = end
    return out


def _halve(length: int, gram: int, level: int):
    """Parts of runs, with the hashes of their keys and of all their bytes."""

    def halve(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, first, n, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for key, window, count in halves(text, n, length, gram, level):
                    part = text[window : window + count + length - 1]
                    row = (xxhash.xxh3_64_intdigest(key) - (1 << 63), xxhash.xxh3_64_intdigest(part, level) - (1 << 63), i, first + window, count, part)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["gram", "whole", "id", "first", "n", "bytes"])

    return halve


def _repeats(found: DataFrame, most_rows: int | None = None, more: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Equal runs (same gram and whole): the spans of all but the first, and the first of each kind with its columns ``more``."""
    kept = F.min(F.struct("id", "first", *more)).alias("least")
    least = materialize(found.groupBy("gram", "whole").agg(kept, F.max("n").alias("n"), F.count("*").alias("copies")), most_rows)
    later = (
        found.join(least.where("copies > 1").select("gram", "whole", "least.id", "least.first").withColumnsRenamed({"id": "least_id", "first": "least_first"}), ["gram", "whole"])
        .where("id <> least_id or first <> least_first")
        .select("id", "first", "n")
    )
    return later, least.select("gram", "least.id", "least.first", "n", *(f"least.{c}" for c in more))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, first, n) over ``docs`` (id, bytes): n windows from ``first`` on of document id occur earlier. Spans may touch or overlap."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = docs.mapInArrow(freeing(_emit_runs(length, gram)), _RUN)
    counts = materialize(found.groupBy("gram").count().where("count > 1").select("gram"))
    shared = materialize(found.join(counts.hint("shuffle_hash"), "gram"))
    release(spark)
    later, kinds = _repeats(shared)
    spans = materialize(later)
    discard(shared)
    # written, as a held table would keep its partitioning, and the join no exchange to split
    several = materialize(kinds.groupBy("gram").count().where("count > 1").select("gram"), kinds.count())
    mixed = kinds.join(several, "gram").select("id", F.struct("gram", "first", "n").alias("run"))
    chosen = mixed.groupBy("id").agg(F.collect_list("run").alias("chosen"))
    texts = materialize(docs.select("id", "bytes").join(chosen, "id").mapInArrow(freeing(_cut(length)), "gram long, id long, first long, n int, bytes binary"))
    rows = texts.count()
    release(spark)
    dealt, windows, level = [], 0, 0
    while True:
        # a round is a few tables of known size, written to few files; there are four rounds at the most
        sizes = materialize(texts.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("windows")).where("kinds > 1"), rows)
        few, many = F.col("kinds") <= group, F.col("kinds") > group
        dealt.append(texts.join(sizes.where(few).select("gram"), "gram"))
        now, rows = sizes.agg(F.sum(F.when(few, F.col("windows"))), F.sum(F.when(many, F.col("kinds")))).first()
        windows += now or 0
        if not rows:
            break
        rows <<= HALVINGS
        level += HALVINGS  # keys of many runs are dealt by longer ones
        parts = materialize(texts.join(sizes.where(many).select("gram"), "gram").select("id", "first", "n", "bytes").mapInArrow(freeing(_halve(length, gram, level)), f"{_RUN}, bytes binary"), rows)
        later, kinds = _repeats(parts, rows, ("bytes",))
        spans = spans.unionByName(later)
        texts = kinds.select("gram", "id", "first", "n", "bytes")
    tasks = max(1, -(-windows // TASK))
    whole = reduce(DataFrame.unionByName, dealt).repartition(tasks, "gram").sortWithinPartitions("id", "first")
    return spans.unionByName(whole.select("id", "first", "n", "bytes").mapInArrow(freeing(_scan(length)), _SPAN))


def _keep(length: int, with_text: bool, carried: list[str]):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else [])]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]

    def keep(batches):
        for batch in batches:
            rows = []
            for given, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, kept, end, removed, n = given or b"", [], 0, 0, 0
                last = -1
                for first, count in sorted((s["first"], s["n"]) for s in spans or ()):
                    stop = first + count + length - 1
                    if first > last:
                        n += 1
                        kept.append(text[end:first])
                        end = first
                    if stop > end:
                        removed += stop - end
                        end = last = stop
                kept.append(text[end:])
                whole = b"".join(kept)
                rows.append((len(text), removed, n, hashlib.sha256(whole).hexdigest(), *([given and whole.decode("utf-8", "ignore")] if with_text else [])))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *batch.columns[3:]], names=["doc_id", *names, *carried]
            )

    return keep


def _judged(docs: DataFrame, id_col: str, text_col: str, length: int, with_text: bool, carry: list[str]) -> DataFrame:
    """The columns of ``remove_repeats``, the carried ones under private names."""
    keyed = unique_ids(docs, id_col, text_col, carry)
    spans = repeated_spans(keyed.select("id", "bytes"), length)
    per = materialize(spans.groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("spans")), keyed.count())
    release(docs.sparkSession)
    carried = [f"_carried_{i}" for i in range(len(carry))]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    schema += "".join(f", {c} {keyed.schema[c].dataType.simpleString()}" for c in carried)
    return keyed.join(per, "id", "left").select("own", "bytes", "spans", *carried).mapInArrow(freeing(_keep(length, with_text, carried)), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``; n_spans counts maximal removed runs of bytes."""
    return _judged(docs, id_col, text_col, length, False, [])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` without the bytes that repeat earlier ones, all its columns kept whatever their names; ``chars_col``, if there is one, is counted anew.

    A character of which a part was removed goes whole, and so does a document of which no word is left; rows from which nothing is removed stay as they are, null texts too.
    """
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    out = _judged(docs, id_col, text_col, length, True, carry).where((F.col("n_removed") == 0) | F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    now = {id_col: F.col("doc_id"), text_col: F.col("kept")} | {c: F.col(f"_carried_{i}") for i, c in enumerate(carry)}
    if chars_col in now:
        now[chars_col] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(now[chars_col]).cast(docs.schema[chars_col].dataType)
    return out.select(*(now[c].alias(c) for c in docs.columns))
