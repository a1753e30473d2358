"""Token ids of documents as wavelet-matrix shards, in ascending ``doc_id`` order.

Documents are encoded where they are read; their ids are shuffled once, to
ranges of ``doc_id``; every range is cut into shards. A shard is one self-contained
compressed byte string (documents, lengths, wavelet matrix) in a Parquet file of
its own, written by Spark's committer, so it works on any store and a lost
executor leaves no half file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.wavelet import WaveletMatrix
from pulsegrid.workspace import materialize

END = 1
#: Text bytes of a range of documents, and tokens after which a shard is closed (a longer document is one shard).
RANGE_BYTES = 16 << 20
#: A small corpus is still cut into this many ranges, of a megabyte or more.
LEAST_RANGES, LEAST_BYTES = 64, 1 << 20
SHARD_TOKENS = 1 << 22
#: Bytes of text that are encoded together.
GROUP_BYTES = 8 << 20
#: Units (pieces of words) whose ids a worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 250_000, 16 << 20
#: Pieces that the library's model gets in one call.
AT_ONCE = 4096

#: Words of these characters alone are cut by a plain pattern; others go through the whole tokenizer.
_PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+)"
#: Marks a unit that is a whole word; no piece begins with it.
_WHOLE = "\0"
_encoders: dict[str, Encoder] = {}


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where lists of these sizes begin, one after the other."""
    return np.cumsum(sizes) - sizes


def _gather(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the lists ``which``, one list after the other, and where each list ends.

    List i has the entries ``starts[i]`` to ``starts[i] + sizes[i]``.
    """
    each = sizes[which]
    ends = np.cumsum(each)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, int(starts.max(initial=0))) < 1 << 31 else np.int64
    return np.arange(n, dtype=kind) + np.repeat((starts[which] - (ends - each)).astype(kind), each), ends


class Encoder:
    """Ids of whole texts with a file of the ``tokenizers`` library, by units looked up once per group of texts.

    Its pre-tokenizer never joins what white space separates, so the ids of a
    text are those of its words. Distinct words of plain characters are normalised and cut into pieces
    here, and distinct pieces looked up in the library's model; any other word is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        # the byte alphabet of byte-level models: printable bytes stand for themselves
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in seen]
        self.letters = {**{b: chr(b) for b in seen}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        # the model alone, over pieces in the byte alphabet that blanks part
        self.pieces = Tokenizer(self.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab, suffix = self.whole.get_vocab(), getattr(self.model, "end_of_word_suffix", None)
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.closing[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # unit -> its number; the ids of unit k are sizes[k] of ids from starts[k] on
        self.units: dict[str, int] = {}
        self.chars = 0
        self.ids, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, inner: list[str]) -> tuple[list[int], np.ndarray]:
        """The ids of pieces in the byte alphabet, one after the other, and the number of each."""
        ids = self.pieces.encode_batch_fast([" ".join(inner)], add_special_tokens=False)[0].ids
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) == len(inner) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        # a model whose last ids of words cannot be told from others
        lists = [[t.id for t in self.model.tokenize(x)] for x in inner]
        return list(chain.from_iterable(lists)), np.array([len(x) for x in lists], np.int64)

    def _look_up(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces and marked words, one after the other, and the number of each."""
        sizes = np.zeros(len(units), np.int64)
        which = [i for i, u in enumerate(units) if u and not u.startswith(_WHOLE)]
        marked = [i for i, u in enumerate(units) if u.startswith(_WHOLE)]
        found = []
        for low in range(0, len(which), AT_ONCE):
            some = which[low : low + AT_ONCE]
            inner = [u if (u := units[i]).isascii() else u.encode().decode("latin-1").translate(self.letters) for i in some]
            ids, sizes[some] = self._pieces(inner)
            found.append(np.array(ids, self.kind))
        for i in marked:
            ids = self.whole.encode(units[i][1:], add_special_tokens=False).ids
            sizes[i] = len(ids)
            found.append(np.array(ids, self.kind))
        flat = np.concatenate([np.zeros(0, self.kind), *found])
        # found came pieces first, then marked words
        order = np.array(which + marked, np.int64)
        starts = np.zeros(len(units), np.int64)
        starts[order] = _starts(sizes[order])
        return flat[_gather(starts, sizes, np.arange(len(units)))[0]], sizes

    def _numbers(self, units: list[str]) -> np.ndarray:
        """The number in memory of each of some distinct units; those not met before are looked up."""
        get = self.units.get
        at = np.array([get(u, -1) for u in units], np.int64)
        places = np.flatnonzero(at < 0)
        new = [units[i] for i in places.tolist()]
        if not new:
            return at
        chars = sum(map(len, new))
        if len(self.units) + len(new) > REMEMBERED or self.chars + chars > REMEMBERED_CHARS:
            # forget all but the units of this call
            kept = np.flatnonzero(at >= 0)
            which = at[kept]
            self.ids, self.sizes = self.ids[_gather(self.starts, self.sizes, which)[0]], self.sizes[which]
            self.starts = _starts(self.sizes)
            names = [units[i] for i in kept.tolist()]
            self.units, self.chars = dict(zip(names, range(len(names)))), sum(map(len, names))
            at[kept] = np.arange(len(kept))
        n = len(self.units)
        at[places] = np.arange(n, n + len(new))
        ids, sizes = self._look_up(new)
        self.units.update(zip(new, range(n, n + len(new))))
        self.chars += chars
        self.starts = np.concatenate((self.starts, _starts(sizes) + len(self.ids)))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        return at

    def _cut(self, words: pa.Array) -> pa.Array:
        """The units of each distinct word."""
        plain = pc.match_substring_regex(words, _PLAIN)
        risky = pc.indices_nonzero(pc.and_(plain, pc.match_substring(words, "<"))).to_pylist()
        if bad := [i for i in risky if any(s in words[i].as_py() for s in self.special)]:
            held = plain.to_numpy(zero_copy_only=False).copy()
            held[bad] = False
            plain = pa.array(held)
        pieces = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, words, "")), _PIECE, "\\1 "), " ")
        marked = pc.binary_join_element_wise(_WHOLE, words, "")
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1), pa.int32()), marked)
        return pc.if_else(plain, pieces, whole)

    def encode(self, text: str) -> bytes:
        """The ids of one text, however long, some megabytes at a time."""
        out, at = [], 0
        while at < len(text):
            stop = text.find(" ", at + GROUP_BYTES)
            stop = len(text) if stop < 0 else stop
            out += self.encode_all(pa.array([text[at:stop]]), b"")
            at = stop + 1
        return b"".join(out)

    def encode_all(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """The ids of each text, followed by ``end``."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        cut = self._cut(words.dictionary)
        units = cut.flatten().dictionary_encode()
        at = self._numbers(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        n_units = pc.list_value_length(cut).to_numpy().astype(np.int64)
        place, word_ends = _gather(_starts(n_units), n_units, words.indices.to_numpy())
        width = np.dtype(self.kind).itemsize
        place, unit_ends = _gather(self.starts[at], self.sizes[at], units.indices.to_numpy()[place])
        flat = self.ids[place].tobytes()
        limits = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)))
        cuts = np.concatenate(([0], unit_ends))[np.concatenate(([0], word_ends))[limits]] * width
        return [flat[a:b] + end for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        # Spark deals out the work; the library's own threads would only wait
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(docs: DataFrame, path: str, cuts: list[int], group_bytes: int | None) -> DataFrame:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END], enc.kind).tobytes()
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                before = int(sizes[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, before + (group_bytes or GROUP_BYTES), "right")))
                rows = batch.slice(low, high - low)
                one = high == low + 1 and rows["text"][0].as_py()
                ids = [enc.encode(one) + end] if one else enc.encode_all(rows["text"], end)
                doc = rows["doc_id"]
                part = np.searchsorted(cuts, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, pa.array(ids, pa.binary())], schema=schema)
                low = high
            del batch, rows, ids
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "part int, doc_id long, ids binary"
    )


def _pack(ids: list, docs: list, kind: str) -> bytes:
    """A shard: documents and lengths, then the wavelet matrix of all ids."""
    sizes = np.array([len(x) for x in ids], np.int64) // np.dtype(kind).itemsize
    known = np.array([d is not None for d in docs], np.uint8)
    names = np.array([d or 0 for d in docs], "<i8")
    head = zstandard.ZstdCompressor(level=3).compress(
        known.tobytes() + np.diff(names, prepend=0).astype("<i8").tobytes() + sizes.astype("<i8").tobytes()
    )
    matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), kind))
    return struct.pack("<QQ", len(docs), len(head)) + head + matrix.to_bytes()


class Shard:
    """A shard read back from its bytes."""

    def __init__(self, data: bytes):
        n, size = struct.unpack_from("<QQ", data)
        head = zstandard.ZstdDecompressor().decompress(data[16 : 16 + size])
        known = np.frombuffer(head, np.uint8, n)
        names = np.cumsum(np.frombuffer(head, "<i8", n, n))
        self.docs = [int(d) if k else None for d, k in zip(names, known)]
        self.sizes = np.frombuffer(head, "<i8", n, 9 * n)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.tokens = WaveletMatrix.from_bytes(data[16 + size :])


SHARDS = "part int, seq int, n_docs long, n_tokens long, shard binary"


def write(docs: DataFrame, path: str, tokenizer: str, group_bytes: int | None = None) -> None:
    """Write the shards of ``docs`` (``doc_id``, ``text``) below ``path``, one file each.

    Every document ends with id 1. A null or empty text is the end id alone; null
    ids come first; rows of one ``doc_id`` are ordered by their ids. An empty table
    writes no shard. Other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // RANGE_BYTES), min(LEAST_RANGES, -(-size // LEAST_BYTES)), 1)
    cuts = docs.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS LONG) AS doc_id")
    cuts = cuts.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        width = np.dtype(kind).itemsize
        ids, names, size, part, seq = [], [], 0, None, 0

        def closed() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "n_docs": len(names), "n_tokens": size, "shard": _pack(ids, names, kind)}
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.binary()),
            ]))

        for batch in batches:
            for p, name, held in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"]):
                held = held.as_py()
                more = len(held) // width
                if names and (p != part or size + more > SHARD_TOKENS):
                    yield closed()
                    ids, names, size, seq = [], [], 0, seq + 1 if p == part else 0
                part = p
                ids.append(held)
                names.append(name)
                size += more
        if names:
            yield closed()

    ranges = _encoded(docs, tokenizer, cuts, group_bytes).repartition("part").sortWithinPartitions("part", "doc_id", "ids")
    ranges.mapInArrow(shards, SHARDS).write.option("maxRecordsPerFile", 1).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def offsets(shards: DataFrame) -> DataFrame:
    """``part, seq, before``: tokens of all earlier shards, by running sums in two levels."""
    sized = shards.select("part", "seq", "n_tokens").withColumn("run", F.expr("part div 1024"))
    runs = sized.groupBy("run").agg(F.sum("n_tokens").alias("total"))
    # one row per 1024 ranges of documents
    behind = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("total").over(behind), F.lit(0)).alias("base"))
    inside = Window.partitionBy("run").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("here", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(runs, "run").selectExpr(
        "part", "seq", "base + here AS before"
    )


def digests(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the shards alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["shard"]):
                shard = Shard(data.as_py())
                ids = shard.tokens.decode().astype("<u4")
                limits = shard.starts.tolist()
                n = len(shard.docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.docs, pa.int64()),
                        pa.array(limits[:-1], pa.int64()), pa.array(shard.sizes, pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(limits, limits[1:])], pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "seq", "shard").mapInArrow(
        rows, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    before = materialize(offsets(shards), "offsets")
    return found.join(before, ["part", "seq"]).selectExpr("doc_id", "before + at AS start", "n_tokens", "ids_crc32")
