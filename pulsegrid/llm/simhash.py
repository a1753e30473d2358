"""SimHash fingerprints, and near-duplicate groups by tiled exact comparison.

Fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit
bands, so only those that share a band are compared; none is missed. A band
bucket is cut into tiles of bounded size by population count. Tile pairs whose
population counts differ by more than the radius are skipped, the others are
compared with exclusive-or and bit counts in numpy. A large bucket (much of a
corpus may share a band) becomes many tile pairs in many tasks. From each unit only a
spanning forest of its links goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.graph import components
from pulsegrid.workspace import materialize

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a tile, and of the pieces of a tile that are compared at once.
TILE = 2048
PIECE = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    high = np.cumsum([len(w) + 1 for w in words])
    low = np.concatenate(([0], high[:-1]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(low.tolist(), (high[shingle - 1 :] - 1).tolist())], "<u8"
    )
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every row of ``docs`` (``doc_id``, ``text``)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"]
            )
            del batch
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def _units(fps: DataFrame, radius: int) -> DataFrame:
    """``unit, side, fp``: what is compared together; side 0 with side 1, or all pairs where there is no side 1."""
    bands = radius + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    keys = [
        f"named_struct('band', {i}, 'bits', shiftrightunsigned(shiftleft(fp, {64 - b}), {64 - b + a}))"
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    rows = fps.selectExpr("fp", "bit_count(fp) AS ones", f"inline(array({', '.join(keys)}))")
    sized = rows.groupBy("band", "bits", "ones").agg(F.count("*").alias("n"))
    buckets = sized.groupBy("band", "bits").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("counts")
    )  # at most 65 entries: one per population count
    held = rows.join(buckets.where("total > 1"), ["band", "bits"])
    tile = "pmod(xxhash64(fp), ceil(counts[{0}] / {1}))"
    own = tile.format("ones", TILE)
    small = held.where(f"total <= {TILE}").selectExpr("xxhash64(band, bits) AS unit", "band", "bits", "'' AS pair", "0 AS side", "fp")
    # a row goes to each tile of a near population count; the pair's smaller tile is side 0
    other = (
        held.where(f"total > {TILE}")
        .selectExpr("*", f"{own} AS tile", f"explode(sequence(ones - {radius}, ones + {radius})) AS near")
        .where("counts[near] IS NOT NULL")
        .selectExpr("*", f"explode(sequence(0L, CAST(ceil(counts[near] / {TILE}) AS LONG) - 1)) AS other")
        .selectExpr(
            "band", "bits", "fp",
            "format_string('%02d.%d', ones, tile) AS me", "format_string('%02d.%d', near, other) AS you",
        )
        .selectExpr("band", "bits", "concat(least(me, you), '/', greatest(me, you)) AS pair", "int(me > you) AS side", "fp")
        .selectExpr("xxhash64(band, bits, pair) AS unit", "band", "bits", "pair", "side", "fp")
    )
    return small.unionByName(other)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node reachable from each of ``n`` nodes by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[new])
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def links(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one unit, as pairs of fingerprints."""
    ones = np.bitwise_count(fp)
    order = np.lexsort((ones, side))
    fp, side, ones = fp[order], side[order], ones[order]
    cut = int((side == 0).sum())
    root = np.arange(len(fp))
    pieces = [(a, min(a + PIECE, top)) for low, top in ((0, cut), (cut, len(fp))) for a in range(low, top, PIECE)]
    for a, b in pieces:
        for c, d in pieces:
            across = cut < len(fp)
            if c < a or (across and not (b <= cut <= c)):
                continue
            if int(ones[c]) - int(ones[b - 1]) > radius or int(ones[a]) - int(ones[d - 1]) > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(fp[a:b, None] ^ fp[None, c:d]) <= radius)
            i, j = i + a, j + c
            use = i < j
            if use.any():
                root = forest(len(fp), np.concatenate((np.arange(len(fp)), i[use])), np.concatenate((root, j[use])))
    hung = np.flatnonzero(root != np.arange(len(fp)))
    return fp[hung], fp[root[hung]]


def _compare(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def units(batch_fp, batch_side, batch_unit):
        cut = np.flatnonzero(np.diff(batch_unit)) + 1
        start, stop = np.concatenate(([0], cut)), np.concatenate((cut, [len(batch_unit)]))
        a, b = [], []
        # small units, the usual case, are compared together: each row with the d-th after it
        few = stop - start <= 32
        plain = few & (np.maximum.reduceat(batch_side, start) == 0)
        room = np.repeat(np.where(plain, stop, 0), stop - start) - np.arange(len(batch_unit))
        for d in range(1, 32):
            i = np.flatnonzero(room > d)
            if not len(i):
                break
            i = i[np.bitwise_count(batch_fp[i] ^ batch_fp[i + d]) <= radius]
            a.append(batch_fp[i + d])
            b.append(batch_fp[i])
        for s, e in zip(start[~plain].tolist(), stop[~plain].tolist()):
            x, y = links(batch_fp[s:e], batch_side[s:e], radius)
            a.append(x)
            b.append(y)
        a, b = (np.concatenate(x or [np.zeros(0, np.uint64)]).view(np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last unit may go on in the next batch
        for batch in batches:
            fp, side, unit = (batch[c].to_numpy(zero_copy_only=False) for c in ("fp", "side", "unit"))
            now = [fp.view(np.uint64), side, unit]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[2]):
                continue
            last = int(np.searchsorted(-(now[2] != now[2][-1]).astype(np.int8), 0))
            rest = [x[last:] for x in now]
            if last:
                yield units(*(x[:last] for x in now))
        if rest is not None:
            yield units(*rest)

    return compare


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest ``doc_id`` reachable by links.

    Two fingerprints link at ``radius`` or fewer differing bits. Texts lose case A-Z;
    words are ``[^\\x20\\x09-\\x0D]+``; shorter texts are one shingle, and null, empty and
    blank texts have fingerprint zero, which links like any other. Repeated rows
    stay repeated. A null ``doc_id`` takes no part in the minimum. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    units = _units(fps.select("fp"), radius)
    compared = (
        units.repartition("unit").sortWithinPartitions("unit", "side").select("unit", "side", "fp")
        .mapInArrow(_compare(radius), "a long, b long")
    )
    roots = components(compared)
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").selectExpr(
        "fp", "rep", "coalesce(root, fp) AS root"
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialize(named.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")
