"""What filters remove, alone and in every order, with exact duplicates found by radix tries.

Duplicates: texts are dealt out by ranges of adaptive prefixes. A prefix of a few bytes whose texts weigh more than a range
should hold is cut finer, by longer prefixes, until no range weighs too much or all its texts are one. Each task inserts
whole texts into a compressed trie, whose terminals hold the least id met so far; a row that is, or becomes, larger than
its terminal's id is a duplicate and leaves at once, and a last traversal gives the rest. Tasks that
read do so first for themselves, by some megabytes at a time, so a text found in a third of all
rows is shuffled once for each such trie.

Counts: a row's failures are a mask of bits. Masks are counted by part and label, and every count of
every order follows from those few sums.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight (text bytes, and so many more for each row) above which a prefix is cut finer; with more than MOST_RANGES times that, ranges grow.
RANGE_BYTES, ROW_BYTES, MOST_RANGES = 8 << 20, 512, 100_000
#: Ranges that one task's trie holds on average, and bytes of distinct text in a reading task's trie.
RANGES_A_TASK, LOCAL_BYTES = 4, 16 << 20
#: Bytes of the first prefix; each next one is four times as long.
SHORTEST = 4

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 100


def same_words(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 80 * len(words)


def upper_case(text: bytes, words: list[bytes]) -> bool:
    """More than a tenth of the code points are A-Z."""
    return 100 * len(text.translate(None, _NOT_UPPER)) > 10 * len(text.translate(None, _CONTINUED))


def marks(text: bytes, words: list[bytes]) -> bool:
    return _MARKS.search(text) is not None


Test = Callable[[bytes, list[bytes]], bool]
#: Filters by letter; ``None`` is the one for duplicates.
FILTERS: dict[str, Test | None] = {"A": few_words, "B": same_words, "C": upper_case, "D": marks, "E": None}


class Trie:
    """A compressed trie of byte strings; a terminal holds its least id and the rows of that id.

    A node is ``[edge, children by first byte, held]``, with ``held`` as ``(id, {row: count})``. Ids are ``(is null, value)``.
    """

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.size = 0

    def _terminal(self, text: bytes) -> list:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = child = [text[at:], {}, None]
                self.size += len(text) - at + ROW_BYTES
                return child
            edge = child[0]
            if not text.startswith(edge, at):
                n = _common(edge, text, at)
                upper = [edge[:n], {edge[n]: child}, None]
                child[0] = edge[n:]
                node[1][text[at]] = child = upper
                self.size += ROW_BYTES
            node, at = child, at + len(child[0])
        return node

    def insert(self, text: bytes, name: tuple, row: tuple, n: int) -> Iterator[tuple[tuple, tuple, int]]:
        """Add ``n`` rows; gives the rows ``(id, row, n)`` that this shows to be duplicates."""
        node = self._terminal(text)
        held = node[2]
        if held is None or name < held[0]:
            node[2] = (name, {row: n})
            if held is not None:
                yield from ((held[0], r, c) for r, c in held[1].items())
        elif name == held[0]:
            held[1][row] = held[1].get(row, 0) + n
        else:
            yield name, row, n

    def walk(self) -> Iterator[tuple[bytes, tuple, dict]]:
        """Every text with its least id and that id's rows."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, *node[2]
            stack.extend((text, child) for child in node[1].values())


def _common(edge: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``edge`` and of ``text`` from ``at`` on; they differ before the edge's end, or the text ends."""
    n = min(len(edge), len(text) - at)
    a, b = np.frombuffer(edge, np.uint8, n), np.frombuffer(text, np.uint8, n, at)
    differ = a != b
    return int(differ.argmax()) if differ.any() else n


def _binary(column: str = "text") -> str:
    return f"CAST(coalesce({column}, '') AS BINARY)"


def prefixes(docs: DataFrame) -> list[tuple[int, set[int]]]:
    """``(length, prefixes that are cut finer, as hashes)``, shortest first; at most ``MOST_RANGES`` a length."""
    spark = docs.sparkSession
    texts = docs.selectExpr(f"{_binary()} AS t")
    whole = texts.agg(F.sum(F.length("t") + ROW_BYTES)).first()[0] or 0
    limit = max(RANGE_BYTES, whole // MOST_RANGES)
    out: list[tuple[int, set[int]]] = []
    length = SHORTEST
    rows = texts
    while whole > limit:
        weighed = rows.selectExpr(f"xxhash64(substring(t, 1, {length})) AS p", f"length(t) + {ROW_BYTES} AS w", "xxhash64(t) AS h")
        heavy = weighed.groupBy("p").agg(F.sum("w").alias("w"), F.min("h").alias("low"), F.max("h").alias("high"))
        found = [r.p for r in heavy.where(f"w > {limit} AND low < high").select("p").collect()]
        if not found:
            break
        out.append((length, set(found)))
        cut = spark.createDataFrame([(p,) for p in found], "p long")
        rows = texts.withColumn("p", F.expr(f"xxhash64(substring(t, 1, {length}))")).join(F.broadcast(cut), "p", "left_semi").select("t")
        length *= 4
    return out


def _range_of(text: bytes, cuts: list[tuple[int, set[int]]]) -> int:
    length = SHORTEST
    for length, finer in cuts:
        h = _signed(xxhash.xxh64_intdigest(text[:length], 42))
        if h not in finer:
            return h
        length *= 4
    return _signed(xxhash.xxh64_intdigest(text[:length], 42))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_DEALT = "range long, text binary, id long, part string, mask int, n long, spread int"
_ROWS = "id long, part string, mask int, n long, spread int"


def _batches(rows: Iterator[tuple], names: str, text_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of some thousand rows or some megabytes; adds the column ``spread``, which counts rows."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in names.split(", ")])
    held, size, spread = [], 0, 0
    for row in rows:
        held.append((*row, spread))
        spread = (spread + 1) & 0xFFFF
        size += len(row[1] or b"") if "text" in names else 0
        if len(held) >= 8192 or size > text_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def masks(docs: DataFrame, part: str = "lang", filters: dict[str, Test | None] | None = None) -> DataFrame:
    """``id, part, mask, n`` for the rows of ``docs`` (``doc_id``, ``text`` and ``part``): bit i is set if filter i fails.

    Equal rows may come back as one with their number ``n``; ``spread`` is a small number to salt null ids with.
    """
    filters = FILTERS if filters is None else filters
    tests = [(1 << i, test) for i, test in enumerate(filters.values()) if test]
    again = sum(1 << i for i, test in enumerate(filters.values()) if not test)
    cuts = prefixes(docs) if again else []
    limit = RANGE_BYTES * RANGES_A_TASK

    def flushed(trie: Trie) -> Iterator[tuple]:
        for text, (null, value), held in trie.walk():
            where = _range_of(text, cuts)
            for (kind, mask), n in held.items():
                yield where, text, None if null else value, kind, mask, n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, nth = Trie(), 0
        for batch in batches:
            for name, kind, text in zip(batch["id"].to_pylist(), batch["part"].to_pylist(), batch["t"]):
                text = text.as_py()
                words = text.split()
                mask = sum(bit for bit, test in tests if test(text, words))
                del words
                for (null, value), row, n in trie.insert(text, (name is None, name or 0), (kind, mask), 1):
                    nth += 1
                    yield _signed(xxhash.xxh64_intdigest(nth.to_bytes(8, "little"))), None, None if null else value, row[0], row[1] | again, n
                if trie.size > LOCAL_BYTES:
                    yield from flushed(trie)
                    trie = Trie()
        yield from flushed(trie)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = Trie()
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("id", "part", "mask", "n")]
            for text, name, kind, mask, n in zip(batch["text"], *columns):
                text = text.as_py()
                if text is None:
                    yield name, kind, mask, n
                    continue
                for (null, value), row, c in trie.insert(text, (name is None, name or 0), (kind, mask), n):
                    yield None if null else value, row[0], row[1] | again, c
        for _, (null, value), held in trie.walk():
            for (kind, mask), n in held.items():
                yield None if null else value, kind, mask, n

    narrow = docs.selectExpr("CAST(doc_id AS LONG) AS id", f"coalesce(CAST({part} AS STRING), '') AS part", f"{_binary()} AS t")
    dealt = narrow.mapInArrow(lambda b: _batches(read(b), _DEALT), _DEALT)
    if not again:
        return dealt.select("id", "part", "mask", "n", "spread")
    weight = docs.agg(F.sum(F.length(F.expr(_binary())) + ROW_BYTES)).first()[0] or 0
    tasks = max(-(-weight // limit), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.drop("spread").repartition(tasks, "range").mapInArrow(lambda b: _batches(merged(b), _ROWS), _ROWS)


def _orders(letters: str) -> str:
    """SQL for all orders of the filters, as an array of strings."""
    return "split('" + ",".join("".join(o) for o in permutations(letters)) + "', ',')"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Test | None] | None = None) -> DataFrame:
    """Counts per part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``.

    ``docs``: ``doc_id, text`` and ``part``; ``labels``: ``doc_id, quality, toxic``; ``filters``: up to five letters with tests of the text and its words
    ``[^\\x20\\x09-\\x0D]+`` that say whether it fails, ``None`` for copies of a text with a smaller id anywhere in the table.
    ``shapley`` is the sum of what the step's filter removes over all orders.

    A null text is empty; empty texts are copies of each other. A null id comes after all others, rows of one id
    and text are no copies of each other, and repeated rows count as often as given. A document is good or
    toxic if any of its labels says so; null labels say nothing. A null part is the empty string. Empty documents give no rows. Other columns are ignored.
    A very long text is held whole by the task that reads it and by its trie.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters)
    marked = labels.selectExpr("doc_id AS id", "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(*map(F.expr, (
        "coalesce(max(quality = 1), false) AS good", "coalesce(max(toxic = 1), false) AS bad", "0 AS salt",
    )))
    rows = masks(docs, part, filters).withColumn("salt", F.expr("IF(id IS NULL, 1 + spread, 0)"))
    cells = rows.join(marked, ["id", "salt"], "left").groupBy("part", "mask").agg(*map(F.expr, (
        "sum(n) AS n", "sum(IF(good, n, 0L)) AS good", "sum(IF(bad, n, 0L)) AS bad",
    )))
    # at most 2^5 cells a part
    each = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))
    count = len(letters)
    steps = each.selectExpr("part", "cells", f"explode({_orders(letters)}) AS filter_order").selectExpr(
        "part", "cells", "filter_order", f"explode(sequence(1, {count})) AS step"
    )
    earlier = " + ".join(f"IF(instr(substring(filter_order, 1, step - 1), '{c}') > 0, {1 << i}, 0)" for i, c in enumerate(letters))
    steps = steps.selectExpr("*", f"shiftleft(1, instr('{letters}', substring(filter_order, step, 1)) - 1) AS bit", f"{earlier} AS earlier")

    def total(what: str, test: str) -> str:
        return f"aggregate(cells, 0L, (s, c) -> s + IF({test}, {what}, 0L))"

    fails, passed = "(c.mask & bit) <> 0", "(c.mask & earlier) = 0"
    ways = len(list(permutations(letters)))
    return steps.selectExpr(
        "part", "filter_order", "step",
        f"{total('c.n', f'{passed} AND (c.mask & bit) = 0')} AS kept",
        f"{total('c.n', f'{passed} AND {fails}')} AS removed",
        f"{total('c.n', f'{fails} AND (c.mask & earlier) <> 0')} AS redundant",
        f"{total('c.n', 'c.mask = bit')} AS unique_fails",
        f"{total('c.good', f'{passed} AND {fails}')} AS good_lost",
        f"{total('c.bad', f'{passed} AND {fails}')} AS toxic_lost",
        # of the orders, those with this filter first among the failing ones
        f"{total(f'c.n * ({ways} div bit_count(c.mask))', fails)} AS shapley",
    )
