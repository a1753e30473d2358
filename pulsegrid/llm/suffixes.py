"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

Every string of ``length`` bytes that starts in two places is found, exactly:

1. *Initial buckets.* Suffixes are put in buckets by their q-gram of ``gram``
   bytes. Not every suffix is needed: a string's *anchor* is its q-gram of least
   identifier (the first one on ties), so equal strings have equal anchors at
   equal offsets. Only anchors (about one in 140 bytes) enter the buckets. A
   bucket with one suffix is settled: nothing that it anchors repeats.
2. *Refinement.* A bucket is refined by the bucket identifiers of later offsets:
   the identifier of 2h bytes at p is made from those of h bytes at p and at
   p + h, so each pass reuses the identifiers that the pass before updated. The
   strings of one anchor lie together; the class of that whole stretch settles
   them all at once when it occurs again. What is left, the edges of repeats, is
   refined string by string.

A bucket may hold any share of all rows: blocks state equal suffixes once, and a
bucket's members are compared by identifiers only, never in pairs. Identifiers
have 128 bits in step 1, and in step 2 64 bits beside the shard's own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm import blocks as bl

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = "doc_id long, start long, stop long"

#: What a bucket says of a stretch: nothing of it repeats; all of it does; all of it
#: does, and its strings serve the undecided ones; to be refined string by string.
DROP, ALL, ALL_SERVES, OPEN = 0, 1, 2, 3

_U = np.uint64


def _joined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of twice the length, from those of both halves."""
    x = first * _U(0x9E3779B97F4A7C15) + (later ^ (later >> _U(29)))
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(31)
    return x


def _ladder(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Identifiers of 2, 4, .. ``top`` bytes at every offset that has them; the last three are kept."""
    ids, h = data.astype(np.uint64), 1
    kept: dict[int, np.ndarray] = {}
    while h < top:
        n = max(0, len(data) - 2 * h + 1)
        if h < 8:
            ids = ids[:n] | (ids[h : h + n] << _U(8 * h)) if n else ids[:0]
        else:
            ids = _joined(ids[:n], ids[h : h + n]) if n else ids[:0]
        h *= 2
        if h * 4 >= top:
            kept[h] = ids
    return kept


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    rows = np.concatenate((keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Stretches:
    """The strings of a block, in stretches that share an anchor."""

    def __init__(self, texts: bl.Texts, length: int, gram: int):
        self.length, n = length, len(texts.data)
        self.whole = 1 << (length.bit_length() - 1)
        self.low = self.high = self.anchor = np.zeros(0, np.int64)
        if n < length:
            return
        ladder = _ladder(texts.data, self.whole)
        self.top, grams = ladder[self.whole], ladder[gram]
        keys = bl.mixed(grams) & _U(0xFFFFFFFF00000000)
        keys |= np.arange(len(keys), dtype=np.uint64)
        at = (_least(keys, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        # a string stays inside its document
        valid = np.zeros(n - length + 1, bool)
        for low, high in zip(texts.limits[:-1].tolist(), texts.limits[1:].tolist()):
            valid[low : max(low, high - length + 1)] = True
        cut = np.flatnonzero((np.diff(at) != 0) | (valid[1:] != valid[:-1])) + 1
        low = np.concatenate(([0], cut))
        high = np.concatenate((cut, [len(at)]))
        # documents that touch: the last string of one and the first of the next
        keep = valid[low]
        self.low, self.high = low[keep], high[keep]
        self.anchor = at[self.low]
        self.bucket = grams[self.anchor]

    def classes(self) -> np.ndarray:
        """Identifiers of all bytes that a stretch's strings cover."""
        if not len(self.low):
            return np.zeros(0, np.uint64)
        span = self.high - self.low + self.length - 1
        pieces = -(-2 * self.length // self.whole) + 1  # enough for any stretch
        ids = (span * 131 + (self.anchor - self.low)).astype(np.uint64)
        for k in range(pieces):
            ids = _joined(ids, self.top[self.low + (span - self.whole) * k // (pieces - 1)])
        return ids

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the strings of some stretches, their identifiers, and those that choose the shard."""
        low, size = self.low[which], (self.high - self.low)[which]
        start = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        first, last = self.top[start], self.top[start + self.length - self.whole]
        return start, _joined(first, last), _joined(last, first)


def _told(keys: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (shard, keys, second), and where a new pair begins in it."""
    shard = (keys % _U(n)).astype(np.int32)
    order = np.lexsort((second, keys, shard))
    k, s = keys[order], second[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    return order, new


def _numbered(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row, the number of its distinct pair."""
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number


def _buckets(bodies: list[bytes]) -> list[bytes]:
    """Step 1 for a shard: what becomes of each class of each bucket."""
    sizes = [len(b) // 17 for b in bodies]
    where = np.repeat(np.arange(len(bodies)), sizes)
    bucket = np.concatenate([np.frombuffer(b, "<u8", s) for b, s in zip(bodies, sizes)])
    cls = np.concatenate([np.frombuffer(b, "<u8", s, 8 * s) for b, s in zip(bodies, sizes)])
    many = np.concatenate([np.frombuffer(b, np.uint8, s, 16 * s) for b, s in zip(bodies, sizes)])
    code = np.zeros(len(bucket), np.uint8)
    if len(bucket):
        order = np.lexsort((where, cls, bucket))
        b, c = bucket[order], cls[order]
        new_b = np.concatenate(([True], b[1:] != b[:-1]))
        new_c = new_b | np.concatenate(([True], c[1:] != c[:-1]))
        of_c, of_b = np.cumsum(new_c) - 1, np.cumsum(new_b) - 1
        again = np.bincount(of_c, many[order])[of_c] >= 2
        classes = np.bincount(of_b, new_c)[of_b]
        # a repeated class serves the others of its bucket through its first block
        code[order] = np.where(
            again, np.where((classes > 1) & new_c, ALL_SERVES, ALL), np.where(classes > 1, OPEN, DROP)
        )
    return [x.tobytes() for x in np.split(code, np.cumsum(sizes)[:-1])]


def _repeated(bodies: list[bytes]) -> list[bytes]:
    """Step 2 for a shard: which strings start elsewhere too."""
    sizes = [len(b) // 9 for b in bodies]
    ids = np.concatenate([np.frombuffer(b, "<u8", s) for b, s in zip(bodies, sizes)])
    many = np.concatenate([np.frombuffer(b, np.uint8, s, 8 * s) for b, s in zip(bodies, sizes)])
    order = np.argsort(ids, kind="stable")
    new = np.concatenate(([True], ids[order][1:] != ids[order][:-1]))[: len(ids)]
    number = np.cumsum(new) - 1
    flags = np.empty(len(ids), bool)
    if len(ids):
        flags[order] = np.bincount(number, many[order])[number] >= 2
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


class Refiner:
    """The questions of a block and its result; the same arrays are rebuilt in each step."""

    def __init__(self, length: int, n_shards: int, result=None):
        if length < 24:
            raise ValueError("strings shorter than 24 bytes have no q-gram to be sampled by")
        self.length, self.n = length, n_shards
        self.gram = 1 << max(3, (length // 3).bit_length() - 1)
        self.result = result or _digest

    def _first(self, texts):
        st = Stretches(texts, self.length, self.gram)
        cls = st.classes()
        bucket = st.bucket if len(cls) else cls
        order, new = _told(bucket, cls, self.n)
        return st, bucket, cls, order, new

    def initial(self, texts, answers):
        st, bucket, cls, order, new = self._first(texts)
        head = order[new]
        count = np.minimum(np.diff(np.append(np.flatnonzero(new), len(order))), 2).astype(np.uint8)
        shard = (bucket[head] % _U(self.n)).astype(np.int32)
        b, c = bucket[head].astype("<u8"), cls[head].astype("<u8")
        return [
            (s, b[i:j].tobytes() + c[i:j].tobytes() + count[i:j].tobytes())
            for s, i, j in bl.by_shard(shard)
        ]

    def _second(self, texts, answers):
        st, bucket, cls, order, new = self._first(texts)
        head = order[new]
        code = np.zeros(len(head), np.uint8)
        for s, i, j in bl.by_shard((bucket[head] % _U(self.n)).astype(np.int32)):
            code[i:j] = np.frombuffer(answers[1, s], np.uint8)
        said = code[_numbered(order, new)] if len(head) else code
        first = np.zeros(len(cls), bool)
        first[head] = True
        speaks = np.flatnonzero((said == OPEN) | ((said == ALL_SERVES) & first))
        start, ids, side = st.strings(speaks)
        order, new = _told(side, ids, self.n)
        return st, said, start, ids, side, order, new

    def refined(self, texts, answers):
        _, _, start, ids, side, order, new = self._second(texts, answers)
        head = order[new]
        count = np.minimum(np.diff(np.append(np.flatnonzero(new), len(order))), 2).astype(np.uint8)
        shard = (side[head] % _U(self.n)).astype(np.int32)
        # a shard's messages are compared by identifier, so order inside does not matter
        sent = ids[head].astype("<u8")
        return [(s, sent[i:j].tobytes() + count[i:j].tobytes()) for s, i, j in bl.by_shard(shard)]

    def removed(self, texts, answers):
        st, said, start, ids, side, order, new = self._second(texts, answers)
        head = order[new]
        again = np.zeros(len(head), bool)
        for s, i, j in bl.by_shard((side[head] % _U(self.n)).astype(np.int32)):
            again[i:j] = np.unpackbits(np.frombuffer(answers[2, s], np.uint8), count=j - i).astype(bool)
        edge = np.zeros(len(texts.data) + 1, np.int32)
        sure = (said == ALL) | (said == ALL_SERVES)
        np.add.at(edge, st.low[sure], 1)
        np.add.at(edge, st.high[sure] + self.length - 1, -1)
        if len(head):
            hit = start[again[_numbered(order, new)]]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + self.length, -1)
        return self.result(texts, np.cumsum(edge[:-1]) > 0)


def _digest(texts, gone: np.ndarray) -> pa.RecordBatch:
    """Per document: bytes, removed bytes, maximal removed runs, hash of the rest."""
    out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    for doc, low, high in zip(texts.ids, texts.limits[:-1].tolist(), texts.limits[1:].tolist()):
        mask, data = gone[low:high], texts.data[low:high]
        n = int(mask.sum())
        out["doc_id"].append(doc)
        out["n_bytes"].append(high - low)
        out["n_removed"].append(n)
        out["n_spans"].append(len(bl.runs_of(mask)[0]) if n else 0)
        out["kept_sha256"].append(hashlib.sha256((data[~mask] if n else data).tobytes()).hexdigest())
    return pa.RecordBatch.from_pydict(
        {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
    )


def _spans(texts, gone: np.ndarray) -> pa.RecordBatch:
    """One row per maximal removed run: byte offsets inside its document."""
    rows = [
        (doc, i, j)
        for doc, low, high in zip(texts.ids, texts.limits[:-1].tolist(), texts.limits[1:].tolist())
        for i, j in zip(*(x.tolist() for x in bl.runs_of(gone[low:high])))
    ]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "stop"]
    )


def _refine(docs: DataFrame, length: int, result, schema: str) -> DataFrame:
    blocks = bl.pack(docs)
    refiner = Refiner(length, bl.shards(blocks), result)
    past = bl.materialize(bl.answer(bl.ask(blocks, refiner.initial), _buckets, 1), "buckets")
    later = bl.answer(bl.ask(blocks, refiner.refined, past), _repeated, 2)
    past = past.unionByName(bl.materialize(later, "strings"))
    return bl.conclude(blocks, past, refiner.removed, schema)


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Maximal byte runs covered by strings of ``length`` bytes that start elsewhere too.

    ``docs``: ``doc_id``, ``text``. Returns ``doc_id, start, stop`` (bytes, stop
    excluded); documents without a repeat have no row.
    """
    return _refine(docs, length, _spans, SPANS)


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per row of ``docs`` what is left after all repeated strings of ``length`` bytes are removed.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. Null and empty
    texts count 0 bytes; texts shorter than ``length`` lose nothing. Every copy of
    a repeated string goes, the first included. Repeated rows are separate
    documents, also with one ``doc_id``; a null ``doc_id`` stays null. An empty
    table gives an empty result. Other columns are ignored.
    """
    return _refine(docs, length, _digest, RESULT)
