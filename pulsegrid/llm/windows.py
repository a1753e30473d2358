"""Removal of word windows that an earlier document has, behind a count-min prefilter.

1. *Sketch.* Every block hashes its windows of ``width`` words to cells and hands
   each cell range (shard) its part of the block's sketch: the cells it touches
   and whether it touches them once or more often. The shards add the parts up.
   A merged count is never below the number of times a window occurs, so a
   window whose count stays at one occurs once and is settled.
2. *Exact grouping.* Only windows estimated repeated are grouped, by 128-bit
   identifiers of their word sequences, with the smallest ``doc_id`` of each.
   Chance hits of the sketch end here; no repeated window is lost before.

The sketch has one row of 2**27 cells per eight megabytes of text, sent as the
cells in use, so its load and its chance hits (about one window in a hundred) do
not grow with the corpus. A block states a cell or window once, which bounds what
a window found in a third of all documents sends by the number of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm import blocks as bl

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

CELL_BITS = 27
_U = np.uint64
_LAST = np.iinfo(np.int64).max

#: Two odd multipliers and their inverses modulo 2**64, for prefix polynomials.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE = tuple(bl.mixed(np.arange(1, 257, dtype=np.uint64) * _U(m)) for m in _ODD)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(odd: int, n: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block, document by document."""

    def __init__(self, texts: bl.Texts):
        self.texts = texts
        inside = ~_SPACE[texts.data]
        limit = texts.limits[1:-1]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = limit[(limit > 0) & (limit < len(inside))]
        begins[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
        self.low, self.high = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: number of the first word of each document, and one past the last
        self.first = np.searchsorted(self.low, texts.limits)

    def ids(self, k: int) -> np.ndarray:
        """64-bit identifiers of the words; ``k`` chooses one of two independent ones."""
        n = len(self.texts.data)
        sums = np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum(_BYTE[k][self.texts.data] * _powers(_ODD[k], n), dtype=np.uint64))
        )
        back = _powers(pow(_ODD[k], -1, 1 << 64), n + 1)
        ids = (sums[self.high] - sums[self.low]) * back[self.low]
        return bl.mixed(ids + (self.high - self.low).astype(np.uint64))

    def windows(self, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows, and the windows' identifiers."""
        ids = self.ids(k)
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h = h * _U(_ODD[1 - k]) + ids[i : i + n]
        ok = np.zeros(n, bool)
        for low, high in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            ok[low : max(low, high - width + 1)] = True
        start = np.flatnonzero(ok)
        return start, bl.mixed(h[start])


class Sieve:
    """The questions of a block and its result; arrays are rebuilt in each step."""

    def __init__(self, width: int, n_shards: int):
        self.width, self.n = width, n_shards

    def _cells(self, ids):
        shard = (ids % _U(self.n)).astype(np.uint64)
        cell = (ids >> _U(64 - CELL_BITS)) | (shard << _U(32))
        order = np.argsort(cell, kind="stable")
        new = np.ones(len(cell), bool)
        new[1:] = cell[order][1:] != cell[order][:-1]
        head = cell[order][new]
        return order, new, (head >> _U(32)).astype(np.int32), head.astype(np.uint32)

    def sketch(self, texts, answers):
        _, ids = Words(texts).windows(self.width, 0)
        order, new, shard, cell = self._cells(ids)
        often = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
        return [
            (s, bl.falling(cell[i:j]) + np.packbits(often[i:j]).tobytes())
            for s, i, j in bl.by_shard(shard)
        ]

    def _estimated(self, texts, answers):
        """Windows whose merged count is above one, as distinct (identifier pair, smallest document)."""
        words = Words(texts)
        start, ids = words.windows(self.width, 0)
        order, new, shard, cell = self._cells(ids)
        above = np.zeros(len(cell), bool)
        for s, i, j in bl.by_shard(shard):
            above[i:j] = np.unpackbits(np.frombuffer(answers[1, s], np.uint8), count=j - i)
        keep = np.sort(order[above[np.cumsum(new) - 1]]) if len(order) else order
        start, ids = start[keep], ids[keep]
        second = words.windows(self.width, 1)[1][keep]
        number = np.searchsorted(words.first, start, "right") - 1
        named = np.array([_LAST if d is None else d for d in texts.ids], np.int64)
        doc = named[number]
        shard = (ids % _U(self.n)).astype(np.int32)
        order = np.lexsort((doc, second, ids, shard))
        new = np.ones(len(order), bool)
        a, b = ids[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return words, start, ids, second, doc, shard, order, new

    def exact(self, texts, answers):
        _, _, ids, second, doc, shard, order, new = self._estimated(texts, answers)
        head = order[new]
        return [
            (s, b"".join(x[head[i:j]].astype("<u8").tobytes() for x in (ids, second, doc)))
            for s, i, j in bl.by_shard(shard[head])
        ]

    def removed(self, texts, answers):
        words, start, _, _, doc, shard, order, new = self._estimated(texts, answers)
        head = order[new]
        earlier = np.zeros(len(head), bool)
        for s, i, j in bl.by_shard(shard[head]):
            earlier[i:j] = np.unpackbits(np.frombuffer(answers[2, s], np.uint8), count=j - i)
        number = np.cumsum(new) - 1
        gone = np.zeros(len(start), bool)
        gone[order] = earlier[number] | (doc[order] > doc[head][number]) if len(order) else False
        edge = np.zeros(len(words.low) + 1, np.int32)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + self.width, -1)
        return _digest(words, np.cumsum(edge[:-1]) > 0)


def _merged(bodies: list[bytes]) -> list[bytes]:
    """A shard of the sketch: the parts' counts added up; which of each part's cells are above one."""
    parts = []
    for body in bodies:
        n = next(n for n in (len(body) * 8 // 33 + d for d in (0, 1, -1)) if 4 * n + -(-n // 8) == len(body))
        parts.append((bl.rising(body[: 4 * n]), np.unpackbits(np.frombuffer(body, np.uint8, offset=4 * n), count=n)))
    cells = np.concatenate([c for c, _ in parts])
    order = np.argsort(cells, kind="stable")
    new = np.ones(len(cells), bool)
    new[1:] = cells[order][1:] != cells[order][:-1]
    number = np.cumsum(new) - 1
    counts = np.bincount(number, 1 + np.concatenate([o for _, o in parts])[order])
    above = np.empty(len(cells), bool)
    above[order] = counts[number] > 1
    return [np.packbits(x).tobytes() for x in np.split(above, np.cumsum([len(c) for c, _ in parts])[:-1])]


def _earlier(bodies: list[bytes]) -> list[bytes]:
    """Exact grouping in a shard: does a smaller document than the message's own have the window?"""
    sizes = [len(b) // 24 for b in bodies]
    ids, second, doc = (
        np.concatenate([np.frombuffer(b, kind, s, 8 * s * i) for b, s in zip(bodies, sizes)])
        for i, kind in enumerate(("<u8", "<u8", "<i8"))
    )
    order = np.lexsort((doc, second, ids))
    a, b = ids[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = doc[order][new][np.cumsum(new) - 1]
    found = np.empty(len(order), bool)
    found[order] = least < doc[order]
    return [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]


def _digest(words: Words, gone: np.ndarray) -> pa.RecordBatch:
    texts = words.texts
    out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256")}
    data = texts.data.tobytes()
    for i, doc in enumerate(texts.ids):
        a, b = int(words.first[i]), int(words.first[i + 1])
        mask = gone[a:b]
        n = int(mask.sum())
        if n == 0:
            kept = data[texts.limits[i] : texts.limits[i + 1]].split()
        else:
            keep = np.flatnonzero(~mask) + a
            kept = [data[x:y] for x, y in zip(words.low[keep].tolist(), words.high[keep].tolist())]
        out["doc_id"].append(doc)
        out["n_words"].append(b - a)
        out["n_removed"].append(n)
        out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.RecordBatch.from_pydict(
        {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
    )


def remove_windows(docs: DataFrame, width: int = 13) -> DataFrame:
    """Per row of ``docs`` what is left without windows that a document of smaller ``doc_id`` has.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``width`` words of one
    document. Returns ``doc_id, n_words, n_removed, kept_sha256`` (kept words
    joined by one space). Null, empty and blank texts have no words; texts of
    fewer words lose nothing. Rows that share a ``doc_id`` don't remove from each
    other; a null ``doc_id`` counts as larger than any other. An empty table gives
    an empty result. Other columns are ignored.
    """
    blocks = bl.pack(docs)
    sieve = Sieve(width, bl.shards(blocks))
    past = bl.materialize(bl.answer(bl.ask(blocks, sieve.sketch), _merged, 1), "sketch")
    later = bl.answer(bl.ask(blocks, sieve.exact, past), _earlier, 2)
    past = past.unionByName(bl.materialize(later, "windows"))
    return bl.conclude(blocks, past, sieve.removed, RESULT)
