"""Packing documents into token sequences by swap-based local search.

A document's tokens, ended by an end token, are one piece; only a longer one than a sequence is cut, into
whole sequences after a first piece that takes the remainder. Whole pieces are sequences by themselves. The
others, at most one per document, are dealt evenly to tasks of about ``TASK`` pieces, and each task

1. places them best-fit in the order in which they come, then
2. empties its least filled sequences by local search: it moves a document to another underfull sequence, or
   exchanges one for one or two for one, each time what raises the sum of squared fills most for the
   sequence being emptied. It ends when no sequence can give in a way that raises the sum, or with as few sequences as can be.

The order of coming leaves the work to the search: best fit in decreasing length would itself be near the least number where documents are short.

More tasks cost at most a part of a sequence each. A vocabulary of byte-level BPE without merges
to skip is run by ``tiktoken`` from the ranks in the tokenizer's file, as it gives the same ids at several times the speed; any other,
and a text that spells a special token, by ``tokenizers``.

Cases: a null text is empty: one end token; a very long text is tokenized by itself; rows with one id are separate
documents; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.plans.workspace import bounded_batches, freeing, hold

LENGTH, END, TASK = 2048, 0, 16384
#: How GPT-2's pre-tokenizer splits text before the merges.
_PATTERN = public_tokenizers.PATTERN
_LOADED: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _load(path: str) -> tuple:
    """(tokenizer, faster encoding or None, special strings) of a tokenizer's file."""
    if path not in _LOADED:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        slow, fast = Tokenizer.from_file(path), None
        model, special = spec["model"], [t["content"] for t in spec["added_tokens"]]
        level = spec["pre_tokenizer"] or {}
        if model["type"] == "BPE" and not spec["normalizer"] and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and level.get("use_regex") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"):
            byte = _byte_of()
            merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
            ids = [model["vocab"].get(m) for m in merged]
            if None not in ids and ids == sorted(ids) and len(model["vocab"]) == 256 + len(merged):  # ids are the order of the merges
                ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
                fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[path] = (slow, fast, special)
    return _LOADED[path]


def encode(text: str, path: str) -> list[int]:
    """The ids that ``tokenizers`` gives with add_special_tokens=False."""
    slow, fast, special = _load(path)
    if fast is None or any(s in text for s in special):
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cuts(tokens: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many tokens."""
    first = tokens % length or length
    return [(0, first), *((s, length) for s in range(first, tokens, length))]


def _pieces(path: str, length: int, end: int):
    def pieces(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "", path)
                ids.append(end)
                raw = np.array(ids, "<u4")
                for k, (start, size) in enumerate(cuts(len(ids), length)):
                    for column, value in zip(out, (i, k, start, size, zlib.crc32(raw[start : start + size].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return pieces


def best_fit(sizes: list[int], capacity: int, decreasing: bool = False) -> list[list[int]]:
    """Bins of item numbers: each item, in the order given or largest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens of room
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)) if decreasing else range(len(sizes)):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


class _Underfull:
    """Bins with room, by their fill and the sizes they hold; size 0 stands for a bin itself, which a mere move takes nothing from."""

    def __init__(self, size: np.ndarray, bins: list[list[int]], capacity: int):
        self.size, self.bins, self.capacity = size, [list(b) for b in bins], capacity
        self.fill = [int(size[b].sum()) for b in bins]
        self.kinds = np.unique(np.concatenate(([0], size)))
        self.row = np.searchsorted(self.kinds, size).tolist()
        self.count = np.zeros((len(self.kinds), capacity), np.int32)
        self.at: dict[int, set[int]] = {}
        for b in range(len(bins)):
            self._put(b, 1)
        self.below = np.maximum.accumulate(np.where(self.count > 0, np.arange(capacity), -1), axis=1)  # the largest fill up to each

    def _put(self, b: int, sign: int) -> list[int]:
        """Enter a bin, or take it out; the rows of its sizes."""
        fill = self.fill[b]
        if not 0 < fill < self.capacity:
            return []
        rows = [0, *(self.row[i] for i in self.bins[b])]
        for r in rows:
            self.count[r, fill] += sign
        same = self.at.setdefault(fill, set())
        if sign > 0:
            same.add(b)
        else:
            same.discard(b)
        return rows

    def put(self, b: int, sign: int) -> None:
        rows = np.unique(self._put(b, sign)).astype(np.int64)
        if len(rows):
            self.below[rows] = np.maximum.accumulate(np.where(self.count[rows] > 0, np.arange(self.capacity), -1), axis=1)

    def move(self, source: int) -> int | None:
        """Give what raises the sum of squared fills most to another underfull bin, for a document of it or for none; that bin, or None if nothing raises it."""
        self.put(source, -1)
        mine, fill = self.bins[source], self.fill[source]
        gifts = {}
        for k, i in enumerate(mine):
            gifts.setdefault(int(self.size[i]), (i,))
            for j in mine[k + 1 :]:
                gifts.setdefault(int(self.size[i] + self.size[j]), (i, j))
        amounts, rows = np.array(sorted(gifts), np.int64), np.arange(len(self.kinds))
        best, found = 0, None
        for k in range(0, len(amounts), 64):
            shift = amounts[k : k + 64, None] - self.kinds
            fills = self.below[rows, np.clip(self.capacity - shift, 0, self.capacity - 1)]
            gains = np.where((shift > 0) & (shift < self.capacity) & (fills > 0), 2 * shift * (fills - fill + shift), 0)
            most = int(gains.argmax())
            if gains.flat[most] > best:
                g, r = divmod(most, len(self.kinds))
                best, found = int(gains.flat[most]), (int(amounts[k + g]), r, int(fills[g, r]))
        if found is None:
            self.put(source, 1)
            return None
        amount, row, level = found
        target = next(b for b in self.at[level] if not row or any(self.row[i] == row for i in self.bins[b]))
        back = [next(i for i in self.bins[target] if self.row[i] == row)] if row else []
        self.put(target, -1)
        for items, here, there in ((gifts[amount], source, target), (back, target, source)):
            for i in items:
                self.bins[here].remove(i)
                self.bins[there].append(i)
        shift = amount - int(self.kinds[row])
        self.fill[source] -= shift
        self.fill[target] += shift
        self.put(source, 1)
        self.put(target, 1)
        return target


def local_search(sizes: list[int], bins: list[list[int]], capacity: int, report: dict | None = None) -> list[list[int]]:
    """Fewer bins, where moves and exchanges between underfull bins can empty some; ``report`` gets the numbers of steps and of emptied bins.

    Every step raises the sum of squared fills, the least filled bin that can give giving first. The search ends when no bin can give, or
    with as many bins as the sizes need at the least.
    """
    size = np.array(sizes, np.int64)
    least, left = -(-int(size.sum()) // capacity), len(bins)
    if left <= least:
        return [list(b) for b in bins]
    under = _Underfull(size, bins, capacity)
    moved, steps = True, 0
    while moved and left > least:
        moved = False
        queue = [(f, b) for b, f in enumerate(under.fill) if 0 < f < capacity]
        heapq.heapify(queue)
        while queue and left > least:
            fill, source = heapq.heappop(queue)
            if fill != under.fill[source] or (target := under.move(source)) is None:
                continue
            moved = True
            steps += 1
            left -= not under.bins[source]
            for b in (source, target):
                if 0 < under.fill[b] < capacity:
                    heapq.heappush(queue, (under.fill[b], b))
    if report is not None:
        report.update(steps=steps, emptied=len(bins) - left)
    return [b for b in under.bins if b]


def _pack(length: int):
    def pack(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        sizes = table.column("length").to_pylist()
        number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(local_search(sizes, best_fit(sizes, length), length)):
            at = 0
            for i in sorted(items):
                number[i], offset[i] = b, at
                at += sizes[i]
        number += TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        yield from table.combine_chunks().to_batches(max_chunksize=1 << 14)

    return pack


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END, task: int = TASK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = hold(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(freeing(_pieces(path, length, end)), _PIECE))
    partial = pieces.where(F.col("length") < length)
    tasks = max(1, -(-partial.count() // task))
    packed = partial.repartition(tasks).mapInArrow(freeing(_pack(length)), _PIECE + ", sequence_id long, offset long")
    whole = pieces.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)
