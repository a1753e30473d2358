"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character;
dynamic programming carries the best score and the number of pieces of the best
path, nothing else. Ties are broken as the unigram tokenizers do: a path
replaces another only if its score is higher, and at one end the longer piece comes
first. A character that no piece of length one covers may stand alone at the lowest
score less ten; it counts as its UTF-8 bytes where the vocabulary has byte pieces, and
otherwise neighbouring ones count as one.

No piece crosses from a word into the space after it, so a text's count is the sum of
its words' counts, and a worker remembers those of the words it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers.
REMEMBERED = 500_000

_counters: dict[str, Counter] = {}


class Counter:
    """Counts for one vocabulary: ``pieces`` with scores, and whether it has byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], by_bytes: bool):
        self.by_bytes = by_bytes
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        # the first of equal pieces counts
        for piece, score in reversed(pieces):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.empty = not pieces
        # a cut before a space is safe if no piece has a space after another character
        plain = any(p == SPACE for p, _ in pieces) and all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p, _ in pieces)
        # a character in no piece stands alone, so texts can be cut around it as well
        lonely = "".join(c for c in "\n\t" if by_bytes and not any(c in p for p, _ in pieces))
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{lonely}]*|[^{SPACE}{lonely}]+|[{lonely}]" if lonely else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.whole = not plain
        self.known: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Counter:
        """The ordinary pieces of a sentencepiece model; control and byte pieces match no text."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [
            (model.id_to_piece(i), float(model.get_score(i)))
            for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        return cls(pieces, any(model.is_byte(i) for i in ids))

    def viterbi(self, text: str) -> int:
        """Pieces of the best path through ``text``, spaces already marked."""
        n = len(text)
        best, count, at = [0.0] + [None] * n, [0] * (n + 1), 0
        stray = bytearray(n + 1)  # whether the best path to here ends in an unknown character

        def lone(end: int) -> None:
            """Ends up to ``end`` that no match has closed yet may be reached by an unknown character."""
            nonlocal at
            while at < end:
                at += 1
                if not single[at] and (best[at] is None or best[at - 1] + self.unknown > best[at]):
                    best[at] = best[at - 1] + self.unknown
                    more = len(text[at - 1].encode("utf-8", "replace")) if self.by_bytes else 1 - stray[at - 1]
                    count[at], stray[at] = count[at - 1] + more, 1

        single = bytearray(n + 1)
        if not self.empty:
            for last, (size, score) in self.automaton.iter(text):
                end = last + 1
                lone(end - 1)
                if size == 1:
                    single[end] = 1
                score += best[end - size]
                if best[end] is None or score > best[end]:
                    best[end], count[end] = score, count[end - size] + 1
        lone(n)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.whole:
            return self.viterbi(text)
        known, total = self.known, 0
        for chunk in self.cut.findall(text):
            n = known.get(chunk)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[chunk] = self.viterbi(chunk)
            total += n
        return total


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs`` (``doc_id``, ``text``), whole texts, without a shuffle.

    ``vocabulary`` is the path of a model file on every worker. A text is counted with one
    space before it; null and empty texts have no tokens. Repeated rows are
    counted each; other columns are ignored; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter.from_file(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")
