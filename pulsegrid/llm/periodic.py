"""Runs of repeated words: seeds on the diagonals of a document's own dot plot, extended once.

A run is a stretch of words of smallest period q, ``least_exponent`` periods and ``least_length`` words
long at least, that no neighbouring word extends. Words q apart are equal, so the run is a stretch of
matches on the diagonal of lag q, of ``max(least_length - q, (least_exponent - 1) q)`` words at least.

1. *Index.* k-grams of the overlap that every run of a band of periods guarantees are numbered by
   doubling: a 2k-gram is a pair of k-grams. Grams that occur once drop out, so later levels sort only what repeats. The first k is the
   power of two below the least overlap of all periods and serves the periods up to k; each next level
   serves the periods in (k / 2, k].
2. *Seeds.* Since k >= q, neighbouring occurrences of a run's k-gram lie q apart (Fine and Wilf: a smaller
   distance would be a smaller period), so pairs of neighbouring occurrences find every run, and no
   gram lists all its pairs. Such a pair's lag is the smallest period, likewise.
3. *Extension.* A seed is extended both ways by comparing words. For each lag a table keeps how far
   matches are covered; seeds below that are skipped, so every stretch is walked once.

Documents are independent. A worker holds some megabytes of text at a time, a longer document by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Bytes of text that are indexed together.
GROUP_BYTES = 4 << 20

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _repeated(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose key occurs again and a number for their key, by number, then position."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=1)[group] > 1
    return at[order][many], group[many]


def _agree(words: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on agree, walking up (step 1) or down (step -1)."""
    n, size = 0, 64
    while n < most:
        m = min(size, most - n)
        if step > 0:
            differ = words[a + n : a + n + m] != words[b + n : b + n + m]
        else:
            differ = (words[a - n - m + 1 : a - n + 1] != words[b - n - m + 1 : b - n + 1])[::-1]
        if differ.any():
            return n + int(differ.argmax())
        n, size = n + m, size * 2
    return n


def first_gram(least_length: int, least_exponent: int) -> int:
    """The power of two that no run's overlap falls below."""
    if least_exponent < 3 or least_length < least_exponent:
        raise ValueError("runs need three periods and as many words as periods")
    overlap = min(max(least_length - p, (least_exponent - 1) * p) for p in range(1, least_length + 1))
    return 1 << (overlap.bit_length() - 1)


def find_runs(words: np.ndarray, limits: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """``start, length, period`` rows of all runs, by start, then period.

    ``words``: word numbers of some documents in a row; ``limits``: where each begins, and the end.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    longest = int(np.diff(limits).max(initial=0))
    first = first_gram(least_length, least_exponent)
    found: list[tuple[int, int, int]] = []
    at, gram = _repeated(np.arange(n), doc * (int(words.max(initial=0)) + 1) + words)
    k = 1
    # a band is empty once its periods cannot repeat often enough in the longest document
    while len(at) and (k <= first or k // 2 * least_exponent < longest):
        if k >= first:
            lag = at[1:] - at[:-1]
            seed = (gram[1:] == gram[:-1]) & (lag <= k)
            if k > first:
                seed &= lag > k // 2
            found += _extended(words, limits, doc, at[:-1][seed], lag[seed], k, least_length, least_exponent)
        number = np.full(n, -1)
        number[at] = gram
        low = np.flatnonzero(number >= 0)
        low = low[low + k < n]
        low = low[(number[low + k] >= 0) & (doc[low] == doc[low + k])]
        at, gram = _repeated(low, number[low] * (int(gram.max()) + 1) + number[low + k])
        k *= 2
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _extended(words, limits, doc, seeds, lags, k, least_length, least_exponent) -> Iterator[tuple[int, int, int]]:
    order = np.lexsort((seeds, lags))
    seeds, lags = seeds[order], lags[order]
    bounds = np.flatnonzero(np.diff(lags, prepend=-1, append=-1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        q, here, covered = int(lags[a]), seeds[a:b], -1
        i = 0
        while i < len(here):
            s = int(here[i])
            low, high = int(limits[doc[s]]), int(limits[doc[s] + 1])
            start = s - _agree(words, s - 1, s - 1 + q, s - low, -1)
            covered = s + k + _agree(words, s + k, s + k + q, high - q - s - k, 1)
            length = covered + q - start
            if length >= max(least_length, least_exponent * q):
                yield start, length, q
            i = int(np.searchsorted(here, covered))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in a row, and where each text's words begin, and the end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, limits = lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)))
    real = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(real), counts[limits]


def collapsed(texts: pa.Array, least_length: int, least_exponent: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, runs and kept text of each text."""
    flat, limits = _split(texts)
    words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = find_runs(words, limits, least_length, least_exponent)
    owner = np.searchsorted(limits, runs[:, 0], "right") - 1
    drops = np.zeros(len(words) + 1, np.int64)
    np.add.at(drops, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drops, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(drops[:-1]) == 0
    ends = np.concatenate(([0], np.cumsum(keep)))[limits]
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep))), " ")
    # an owner's runs follow each other, since documents do
    listed = pa.StructArray.from_arrays([pa.array(runs[:, 0] - limits[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN))
    cuts = np.searchsorted(owner, np.arange(len(limits)))
    return pa.array(np.diff(limits)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), listed), kept


def collapse(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``doc_id, n_words, runs, kept`` of every row of ``docs`` (``doc_id``, ``text``).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0, case-sensitive. ``runs`` has every run's ``start``,
    ``length`` and smallest ``period``, by start, then period; ``kept`` the text without the words that some
    run holds after its first period, joined by one space. ``least_exponent`` is a whole number from 3 on.

    Null, empty and blank texts have no words, no runs and an empty ``kept``. Rows are judged each by itself:
    repeated rows and null ids come back as often as given, and an empty table gives none. A very long text
    is indexed alone, in some 80 bytes of memory a word. Other columns are ignored, whatever their names.
    """
    first_gram(least_length, least_exponent)  # complains before the job

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                before = int(sizes[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, before + GROUP_BYTES, "right")))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *collapsed(part["text"], least_length, least_exponent)], ["doc_id", "n_words", "runs", "kept"]
                )
                low = high
            del batch
        pa.default_memory_pool().release_unused()

    narrow = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text")
    return narrow.mapInArrow(rows, f"doc_id long, n_words long, runs {RUNS}, kept string")
