"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives longest-match lengths:
a text is parsed from left to right into the longest phrases that occur in the
language's text, and the language that needs the fewest phrases per character wins.

Training text is the one bounded sample here: documents, or pieces of long ones, in hash order until
``SAMPLE_CHARS`` normalised characters per language, drawn evenly at any corpus
size. Every worker builds the automata from that sample once. Parsing is done for
many texts at once: a text is a row of stretches of ``STRETCH`` characters, each
stretch begins a phrase, and one numpy step moves all stretches of a batch in all
languages by one character.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training characters per language, drawn from texts of at most a quarter of that where there are any.
SAMPLE_CHARS = 24_000
#: Languages that can be learned; the labels with most documents, if there are more.
MOST_LANGS = 500
#: Documents, long or short, that are drawn of each language on average at least; all, where it has fewer.
LEAST_DOCS = 30
STRETCH = 512
#: Characters that are moved together.
BATCH_CHARS = 1 << 19
#: Rows that a worker returns together.
ROWS_BACK = 1024
UNDETERMINED = "und"

_models: dict[str, Model] = {}
_LETTER = np.zeros(0, bool)


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def normalised(text: str) -> np.ndarray:
    """Lower-case code points, with one space for what lies between letters; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return points[:0]
    before = np.concatenate(([True], is_letter[:-1]))
    return np.where(is_letter, points, 0x20)[is_letter | before].astype(np.uint32)


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        now = len(move)
        move.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return move


class Model:
    """The automata of all languages in one transition table.

    An entry is the next state's row, plus ``END`` where the character does not
    continue the phrase and begins the next one.
    """

    END = 1 << 30  # above any row

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        codes = {lang: np.frombuffer(samples[lang].encode("utf-32-le"), "<u4") for lang in self.langs}
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *codes.values()]))
        self.width = len(known) + 2  # and characters of no language, and the padding of short stretches
        self.symbol = np.full(0x110000, len(known), np.int32)
        self.symbol[known] = np.arange(len(known))
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            move = automaton(self.symbol[codes[lang]].tolist())
            lost = len(move)  # after a character that this language doesn't have
            first = np.full(self.width, lost)
            first[list(move[0])] = list(move[0].values())
            table = np.empty((lost + 1, self.width), np.int32)
            table[:] = (base + first) * self.width + self.END
            for s, out in enumerate(move):
                table[s, list(out)] = (base + np.fromiter(out.values(), np.int64, len(out))) * self.width
            table[0][table[0] >= self.END] -= self.END  # a stretch's first phrase ends none
            table[:, -1] = base * self.width  # padding ends nothing
            tables.append(table.ravel())
            self.roots.append(base * self.width)
            base += lost + 1
        if base * self.width >= self.END:
            raise ValueError("the samples are too large for one table: choose a smaller sample or fewer languages")
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text (not empty) in every language."""
        sizes = np.array([len(t) for t in texts])
        rows = -(-sizes // STRETCH)
        total = int(rows.sum())
        grid = np.full((total, STRETCH), self.width - 1, np.int32)
        owner = np.repeat(np.arange(len(texts)), rows)
        first = np.concatenate(([0], np.cumsum(rows)[:-1]))
        place = np.arange(sizes.sum()) + np.repeat(first * STRETCH - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        grid.reshape(-1)[place] = self.symbol[np.concatenate(texts)]
        length = np.full(total, STRETCH)
        length[first + rows - 1] = sizes - (rows - 1) * STRETCH
        order = np.argsort(-length, kind="stable")
        steps = np.ascontiguousarray(grid[order].T)
        active = np.searchsorted(-length[order], -np.arange(1, STRETCH + 1), "right")
        state = np.repeat(np.array(self.roots)[:, None], total, axis=1)
        count = np.ones((len(self.langs), total), np.int32)
        for t in range(int(length.max())):
            n = active[t]
            now = self.table.take(state[:, :n] + steps[t, :n])
            count[:, :n] += now >= self.END
            state[:, :n] = now & (self.END - 1)
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        for k in range(len(self.langs)):
            out[k] = np.bincount(owner[order], count[k], len(texts))
        return out.T

    def predict(self, texts: Iterable[str | None], n: int) -> tuple[list[str], list[float]]:
        """The language of each text, and how clearly it won: 1 - best / second best phrase count."""
        lang, score = [UNDETERMINED] * n, [0.0] * n
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(chain(texts, [None])):
            points = normalised(text) if text and self.langs else None
            if held and (i == n or (points is not None and size + len(points) > BATCH_CHARS)):
                counts = self.phrases([p for _, p in held])
                best = np.argmin(counts, axis=1)
                for (k, _), b, row in zip(held, best.tolist(), np.sort(counts, axis=1)):
                    lang[k] = self.langs[b]
                    score[k] = float(1 - row[0] / row[1]) if len(row) > 1 else 1.0
                held, size = [], 0
            if points is not None and len(points):
                held.append((i, points))
                size += max(STRETCH, len(points))
        return lang, score


def is_held_out(column: str = "doc_id") -> F.Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Training text per language: documents in hash order until ``chars`` characters of each.

    Labels are counted first, so that a few times the bound is read to the driver, whatever the
    corpus holds. Short texts come first and whole, so that a sample has several authors. Of long ones, where the
    short ones are too few, some ``LEAST_DOCS`` give a piece each, larger ones if there are only a few.
    """
    part = chars // 4
    # null ids are drawn by their texts
    drawn = F.xxhash64("doc_id", F.lit("sample"), F.when(F.col("doc_id").isNull(), F.col("text")))
    labelled = docs.where(~is_held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", "text", (F.pmod(drawn, F.lit(1 << 30)) / (1 << 30)).alias("u"),
        (F.length("text") > part).alias("long"), F.length("text").alias("n"),
    )
    totals = labelled.groupBy("lang").agg(
        F.coalesce(F.sum(F.when(~F.col("long"), F.col("n"))), F.lit(0)).alias("short"),
        F.count("*").alias("docs"), F.count(F.when(F.col("long"), 1)).alias("longs"),
    )
    chance, room, share = F.lit(0.0), F.lit(part), {}
    for lang, short, n, longs in totals.orderBy(F.desc("docs"), "lang").limit(MOST_LANGS).collect():
        # long texts only where the short ones are too few
        odds = F.when(F.col("long"), LEAST_DOCS / max(longs, 1) if short < chars else 0.0).otherwise(
            max(4.0 * chars / max(short, 1), LEAST_DOCS / max(n - longs, 1))
        )
        chance = F.when(F.col("lang") == lang, odds).otherwise(chance)
        share[lang] = max(part, -(-chars // max(longs, 1)))
        if longs < 16:
            room = F.when(F.col("lang") == lang, max(part, -(-4 * chars // max(longs, 1)))).otherwise(room)
    held: dict[str, list[str]] = {}
    spare: dict[str, list[str]] = {}  # what long texts have beyond their share
    size: dict[str, int] = {}
    # the piece of a long text begins anywhere that leaves it whole
    begin = F.when(F.col("long"), F.floor(F.pmod(F.xxhash64("text"), F.greatest(F.col("n") - room, F.lit(0)) + 1))).otherwise(F.lit(0))
    piece = F.substring("text", (begin + 1).cast("int"), F.when(F.col("long"), room).otherwise(F.col("n")).cast("int"))
    rows = labelled.where(F.col("u") < chance).select("lang", "long", "u", "n", F.xxhash64("text").alias("h"), piece.alias("text"))
    for lang, long, text in rows.orderBy("long", "u", "n", "h").select("lang", "long", "text").toLocalIterator():
        if size.get(lang, 0) < chars:
            piece = normalised(text).astype("<u4").tobytes().decode("utf-32-le")
            if long:
                spare.setdefault(lang, []).append(piece[share[lang] :])
                piece = piece[: share[lang]]
            held.setdefault(lang, []).append(piece)
            size[lang] = size.get(lang, 0) + len(piece)
    full = {lang: " ".join([*pieces, *filter(None, spare.get(lang, []))])[:chars] for lang, pieces in held.items()}
    return {lang: text for lang, text in full.items() if text.strip()}


def identify(docs: DataFrame, trained: dict[str, str] | None = None) -> DataFrame:
    """``docs`` (``doc_id, text, lang``) with ``lang_pred`` and ``score``; other columns unchanged.

    ``lang_pred`` is ``und`` (score 0) for a text that is null or has no letter, and for
    all texts where nothing is labelled. Equal counts go to the first language in code point order. Only
    ``text`` decides; repeated rows get equal results. ``trained`` replaces the sample drawn from ``docs``.
    """
    texts = samples(docs) if trained is None else trained
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = docs.select(*kept).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Model(sent.value)
        for batch in batches:
            lang, score = _models[key].predict((t.as_py() for t in batch["text"]), batch.num_rows)
            found = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )
            # in pieces, as the executor holds a whole batch that comes back
            for i in range(0, found.num_rows, ROWS_BACK):
                yield found.slice(i, ROWS_BACK)
            del batch, found
        pa.default_memory_pool().release_unused()

    schema = fields.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept).mapInArrow(predict, schema)
