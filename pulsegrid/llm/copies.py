"""Near copies by word-shingle Jaccard similarity: SimHash fingerprints compared in buckets, exact verification, components.

Two texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Texts of equal sets are one class.

1. *Fingerprints.* A class has a SimHash of ``BITS`` bits: a bit is 1 if it is set in over half of the shingles' hashes.
   A pair at 0.8 differs in about 15 percent of the bits, one at 0.5 in 27, unlike ones in 50.
2. *Buckets.* At that radius bands of fingerprint bits would hold much of a corpus by chance, so the buckets are those of
   ``BANDS`` keys, each of ``ROWS`` of ``VALUES`` MinHash values: a pair at 0.8 shares a key with probability
   0.98 (0.999 at 0.85), one at 0.6 with 0.2, one at 0.5 with 0.04.
3. *Tiles.* Inside a bucket all fingerprints are compared in numpy, a large bucket as pairs of tiles in many tasks. A
   spanning forest of the pairs within the radius goes on, so the rows that leave grow with the members.
4. *Exact check.* The components of those pairs are cut into tiles again, now with the whole shingle sets, and every pair of
   a component is decided by its shared shingles. Again a spanning forest goes on; its components are the groups.

So no text goes by an estimate alone, and a group of near copies that are nearly, but not, similar costs rows for its
members and tiles, never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.graph import components
from pulsegrid.llm.simhash import forest
from pulsegrid.workspace import materialize, scope

SHINGLE = 5
SEED = 42
VALUES = 256
BANDS = 40
ROWS = 10
#: More rows than this (of 16 bytes) are looked up by a shuffle instead of being sent to every task.
FEW_ROWS = 100_000
#: Shingles that are hashed by all functions at once.
PIECE = 4096
#: Bits of a fingerprint, and those in which two may differ: a fifth, and more for sets of a few shingles.
BITS = 512
#: Members of a tile, shingles of a tile, and fingerprints that are compared at once.
TILE = 1024
TILE_SHINGLES = 1 << 18
BLOCK = 128
#: A shingle of more members than this is counted by a matrix product, any other one pair by pair.
COMMON = 16

_draw = np.random.default_rng(SEED)
_ODD = _draw.integers(0, 1 << 32, (VALUES, 1), np.uint32) | np.uint32(1)
_FLIP = _draw.integers(0, 1 << 32, (VALUES, 1), np.uint32)
_CHOSEN = np.stack([_draw.choice(VALUES, ROWS, replace=False) for _ in range(BANDS)])
_WORD_ODD = _draw.integers(0, 1 << 63, (2, BITS // 64), np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_FLIP = _draw.integers(0, 1 << 63, BITS // 64, np.uint64)


def row_key(text: str = "text") -> str:
    """SQL that names a row by its id and its content in 16 bytes; null is an id, and a text, like any other."""
    whole = f"concat(coalesce(CAST(doc_id AS STRING), 'null'), IF({text} IS NULL, ' -', ' +'), coalesce({text}, ''))"
    return f"substring(unhex(sha2({whole}, 256)), 1, 16)"


def hidden(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def few(table: DataFrame, most: int | None = None) -> bool:
    """Whether a written table is small enough to be sent to every task."""
    most = FEW_ROWS if most is None else most
    return table.limit(most + 1).count() <= most


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the shingles; up to five words are one shingle, no words none."""
    words = text.lower().split()
    joined = b" ".join(words)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    high = np.cumsum([len(w) + 1 for w in words])
    low = np.concatenate(([0], high[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.unique(
        np.array([digest(joined[a:b], SEED) for a, b in zip(low.tolist(), (high[SHINGLE - 1 :] - 1).tolist())], np.uint64)
    )


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), PIECE):
        np.minimum(least, ((short[i : i + PIECE] ^ _FLIP) * _ODD).min(axis=1), out=least)
    rows = least[_CHOSEN]
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def simhash(hashes: np.ndarray) -> bytes:
    """The fingerprint: the bits set in over half of the hashes, each of them stretched to ``BITS`` bits."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), PIECE):
        x = (hashes[i : i + PIECE, None] ^ _WORD_FLIP) * _WORD_ODD[0]
        x = (x ^ (x >> np.uint64(32))) * _WORD_ODD[1]
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def near(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether fingerprints (last axis: words) of sets of ``n`` and ``m`` shingles are within the radius, and the sizes allow 0.8."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (5 * low >= 4 * high) & (apart <= BITS // 5 + BITS // (4 * low))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker makes little at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            yield batch.slice(i, 1024)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, row, set_id, n, print, bands`` of every row of ``docs`` (``doc_id``, ``text``)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, prints, bands = [], [], [], []
            for t in batch["text"]:
                hashes = shingle_set(t.as_py() or b"")
                ids.append(set_id(hashes))
                sizes.append(len(hashes))
                prints.append(simhash(hashes))
                bands.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["row"], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "row", "set_id", "n", "print", "bands"],
            )
            del batch
        pa.default_memory_pool().release_unused()

    rows = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", f"{row_key()} AS row", "CAST(text AS BINARY) AS text")
    return rows.mapInArrow(signed, "doc_id long, row binary, set_id long, n long, print binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set_id, hashes`` of the rows named in ``wanted`` (``row``), once each."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py() or b"") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["set_id", "hashes"],
            )
            del batch
        pa.default_memory_pool().release_unused()

    rows = docs.selectExpr(f"{row_key()} AS row", "CAST(text AS BINARY) AS text")
    rows = rows.join(F.broadcast(wanted) if few(wanted) else wanted, "row", "left_semi").select("text")
    return rows.mapInArrow(hashed, "set_id long, hashes array<long>").dropDuplicates(["set_id"])


def tiled(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (``set_id, tiles`` and the column ``group``) with ``unit, side``, once for each tile that its own one meets.

    A unit is one tile of a group, side 0, or two tiles; then side 0 is to meet side 1.
    """
    own = "pmod(xxhash64(set_id), tiles)"
    met = rows.selectExpr("*", f"{own} AS own", "explode(sequence(0L, tiles - 1)) AS other")
    return met.selectExpr(
        "*", f"xxhash64({group}, least(own, other), greatest(own, other)) AS unit", "int(own > other) AS side"
    ).drop("own", "other", "tiles", group)


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units, from batches in the order of ``unit``."""
    rest, last = [], None
    for batch in batches:
        unit = batch["unit"].to_numpy()
        if not len(unit):
            continue
        start = int(np.searchsorted(unit, unit[-1]))
        if rest and (start or unit[0] != last):
            head = [batch.slice(0, start)] if start else []
            yield pa.Table.from_batches(rest + head)
            rest = []
        elif start:
            yield pa.Table.from_batches([batch.slice(0, start)])
        rest.append(batch.slice(start))
        last = unit[-1]
    if rest:
        yield pa.Table.from_batches(rest)


def ends(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units start and stop."""
    cut = np.flatnonzero(np.diff(unit)) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(unit)]))


def near_forest(prints: np.ndarray, n: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of places, of the near pairs of a unit whose rows come by side."""
    cut, root = int((side == 0).sum()), np.arange(len(n))
    across = cut < len(n)
    for a in range(0, cut, BLOCK):
        b = min(a + BLOCK, cut)
        for c in range(cut if across else a, len(n), BLOCK):
            d = min(c + BLOCK, len(n))
            i, j = np.nonzero(near(prints[a:b, None], n[a:b, None], prints[None, c:d], n[None, c:d]))
            i, j = i + a, j + c
            use = root[i] != root[j]
            if use.any():
                root = forest(len(n), np.concatenate((np.arange(len(n)), i[use])), np.concatenate((root, j[use])))
    hung = np.flatnonzero(root != np.arange(len(n)))
    return hung, root[hung]


def near_pairs(units: DataFrame) -> DataFrame:
    """Pairs (``a, b``) that connect what is near within a unit; ``units``: ``unit, side, set_id, n, print``."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches):
            ids, n, side, unit = (rows[c].to_numpy() for c in ("set_id", "n", "side", "unit"))
            prints = np.frombuffer(b"".join(rows["print"].to_pylist()), np.uint64).reshape(len(n), -1)
            start, stop = ends(unit)
            # small units, the usual case, together: each row with the d-th after it
            small = (stop - start <= 8) & (np.maximum.reduceat(side, start) == 0)
            room = np.repeat(np.where(small, stop, 0), stop - start) - np.arange(len(n))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, 8):
                i = np.flatnonzero(room > d)
                i = i[near(prints[i], n[i], prints[i + d], n[i + d])]
                a.append(i + d)
                b.append(i)
            for s, e in zip(start[~small].tolist(), stop[~small].tolist()):
                i, j = near_forest(prints[s:e], n[s:e], side[s:e])
                a.append(i + s)
                b.append(j + s)
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(x)], pa.int64()) for x in (a, b)], ["a", "b"])

    rows = units.select("unit", "side", "set_id", "n", "print").repartition("unit").sortWithinPartitions("unit", "side")
    return rows.mapInArrow(compared, "a long, b long")


def similar_forest(values: np.ndarray, n: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of places, of the pairs of a unit at 0.8 or more.

    ``values`` are the sets of ``n`` hashes one after another, those of side 0 first.
    """
    size, cut = len(n), int((side == 0).sum())
    across = cut < size
    left, right = (cut, cut) if across else (size, 0)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(size), n)
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    start, stop = ends(values)
    held = stop - start
    shared = np.zeros((left, size - right), np.float32)
    # rare shingles: each member with the d-th after it
    room = np.repeat(np.where(held <= COMMON, stop, 0), held) - np.arange(len(owner))
    for d in range(1, COMMON):
        i = np.flatnonzero(room > d)
        if not len(i):
            break
        x, y = owner[i], owner[i + d]
        use = (x < left) & (y >= right)
        np.add.at(shared.ravel(), x[use] * shared.shape[1] + y[use] - right, np.float32(1))
    # common ones: members by shingles, some shingles at once
    common = np.flatnonzero(held > COMMON)
    for k in range(0, len(common), 1024):
        some = common[k : k + 1024]
        table = np.zeros((size, len(some)), np.float32)
        which = np.repeat(np.arange(len(some)), held[some])
        table[owner[np.concatenate([np.arange(s, e) for s, e in zip(start[some], stop[some])])], which] = 1
        shared += table[:left] @ table[right:].T
    # shared s of sets of n and m: at 0.8 if 5 s >= 4 (n + m - s), all whole numbers below 2^24
    i, j = np.nonzero(9 * shared.astype(np.int64) >= 4 * (n[:left, None] + n[None, right:]))
    j = j + right
    use = i < j
    root = forest(size, i[use], j[use])
    hung = np.flatnonzero(root != np.arange(size))
    return hung, root[hung]


def verified(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a, b``) that connect what is similar within a unit; ``units``: ``unit, side, set_id``, ``sets``: ``set_id, hashes``."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(slices(batches)):
            ids, side, unit = (rows[c].to_numpy() for c in ("set_id", "side", "unit"))
            lists = rows["hashes"].combine_chunks()
            places = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(*(x.tolist() for x in ends(unit))):
                if e - s > 1:
                    i, j = similar_forest(values[places[s] : places[e]], np.diff(places[s : e + 1]).astype(np.int64), side[s:e])
                    a.append(i + s)
                    b.append(j + s)
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(x)], pa.int64()) for x in (a, b)], ["a", "b"])

    rows = units.select("unit", "side", "set_id").join(sets, "set_id").select("unit", "side", "set_id", "hashes")
    return rows.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(decided, "a long, b long")


def buckets(classes: DataFrame) -> DataFrame:
    """The written table ``key, set_id, tiles`` of the keys that several classes share; one key of those with the same classes.

    ``classes`` has ``set_id, bands``.
    """
    with scope(classes.sparkSession) as tables:
        keyed = materialize(classes.selectExpr("set_id", "explode(bands) AS key"), "keyed")
        members = keyed.groupBy("key").agg(
            F.count("*").alias("total"), F.min("set_id").alias("least"), F.max("set_id").alias("most"),
            F.bit_xor(F.xxhash64("set_id")).alias("mark"),
        )
        shared = members.where("total > 1").groupBy("total", "least", "most", "mark").agg(F.min("key").alias("key"))
        shared = materialize(shared.selectExpr("key", f"CAST(ceil(total / {TILE}) AS LONG) AS tiles"), "shared")
        return tables.keep(materialize(keyed.join(shared, "key"), "buckets"))


def groups(docs: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """The written table ``set_id, root`` of all classes that are similar to another one: the least class connected to it.

    ``rows`` are the signatures of ``docs``; ``named`` has ``set_id, row``, a row of each class.
    """
    classes = rows.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "print", "bands")])
    classes = materialize(classes, "classes")
    held = buckets(classes)
    met = tiled(held, "key").join(classes.select("set_id", "n", "print"), "set_id")
    loose = materialize(components(materialize(near_pairs(met), "near")), "loose").withColumnRenamed("node", "set_id")
    wanted = materialize(named.join(loose, "set_id", "left_semi").select("row"), "wanted")
    sets = materialize(shingle_sets(docs, wanted), "sets")
    members = loose.join(classes.select("set_id", "n"), "set_id")
    tiles = members.groupBy("root").agg(F.expr(f"CAST(ceil(greatest(count(*) / {TILE}, sum(n) / {TILE_SHINGLES})) AS LONG) AS tiles"))
    units = materialize(tiled(loose.join(materialize(tiles, "tiles"), "root"), "root"), "units")
    found = materialize(verified(units, sets), "links")
    return materialize(components(found), "roots").withColumnRenamed("node", "set_id")


def stays(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables of row keys of ``docs``: ``gone``, near copies of a row that stays, and ``again``,
    those that stay but occur several times."""
    with scope(docs.sparkSession) as tables:
        rows = materialize(signatures(docs), "signatures")
        reps = rows.groupBy("set_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("rep"))
        reps = materialize(reps, "reps")
        roots = groups(docs, rows, reps.select("set_id", "rep.row"))
        named = reps.join(roots, "set_id", "left").selectExpr("set_id", "rep", "coalesce(root, set_id) AS root")
        named = materialize(named, "named")
        best = named.groupBy("root").agg(F.min("rep").alias("best"))
        # the one row of each group of classes, by class
        chosen = materialize(named.join(best, "root").selectExpr("set_id", "best.row AS best"), "chosen")
        keys = rows.groupBy("set_id", "row").agg(F.count("*").alias("times")).join(chosen, "set_id")
        keys = materialize(keys.selectExpr("row", "row = best AS stays", "times"), "keys")
        gone = materialize(keys.where("NOT stays").select("row"), "gone")
        again = materialize(keys.where("stays AND times > 1").select("row"), "again")
        return tables.keep(gone), tables.keep(again)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of the smallest ``doc_id``.

    Groups are the components of links. Texts lose case A-Z; words are
    ``[^\\x20\\x09-\\x0D]+``; null, empty and blank texts are one class. A null ``doc_id`` comes after all
    others. Rows of one ``doc_id`` are told apart by their texts, and the row that stays stays once. An empty table stays
    empty; all columns, whatever their names, are returned unchanged. A very long text is held
    whole by the task that reads it, with 8 bytes a word for its shingles.
    """
    gone, again = stays(docs)
    key, nth = hidden(docs, "row_key"), hidden(docs, "nth")
    named = docs.withColumn(key, F.expr(row_key()))
    small = few(gone) and few(again)

    def table(keys: DataFrame) -> DataFrame:
        keys = keys.withColumnRenamed("row", key)
        return F.broadcast(keys) if small else keys

    rest = [f"`{c}`" for c in ("source", "lang") if c in docs.columns] or ["doc_id"]
    once = F.row_number().over(Window.partitionBy(key).orderBy(*rest))
    if small:
        # only what occurs several times is shuffled
        single = named.join(table(gone.unionByName(again)), key, "left_anti").select(*docs.columns)
        repeated = named.join(table(again), key, "left_semi")
        return single.unionByName(repeated.withColumn(nth, once).where(f"{nth} = 1").select(*docs.columns))
    # rows of one key lie together after the join, so texts are shuffled once
    kept = named.join(gone.withColumnRenamed("row", key), key, "left_anti")
    return kept.withColumn(nth, once).where(f"{nth} = 1").select(*docs.columns)
