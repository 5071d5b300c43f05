"""Operator 5, token counts: a Viterbi search that carries only scores and counts.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character, longest first; the dynamic
programme keeps the best score of each prefix and its number of pieces, never the pieces.  A longer last piece wins
a tie, as in the tokenizers library, whose counts this equals.  No piece of the vocabulary has a mark or an
unknown character inside, so a text falls into segments that are counted once for each task and looked up after.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Segments remembered by a task; when there are more, it starts over.
REMEMBERED = 400_000
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counting:
    """Counts the pieces of the best segmentation under a unigram vocabulary with byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        pieces = {p: s for p, s in vocabulary if p}
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        inner = {p for p in pieces if MARK in p.lstrip(MARK)}
        # A mark after another character starts a segment unless some piece holds both.
        self.splitter = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n" if not inner and not any("\n" in p for p in pieces) else r"(?s).+")
        self.known: dict[str, int] = {}

    def _segment(self, text: str) -> int:
        n = len(text)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        matches = {}
        for end, match in self.automaton.iter(text):
            matches.setdefault(end + 1, []).append(match)
        for end in range(1, n + 1):
            best, at, pieces = None, 0, 0
            # candidates in order of their start: the first of equal scores stays
            found = matches.get(end, ())
            for length, s in sorted(found, reverse=True):
                if (c := score[end - length] + s) is not None and (best is None or c > best):
                    best, at, pieces = c, end - length, 1
            if text[end - 1] not in self.single:
                c = score[end - 1] + self.unknown
                if best is None or c > best:
                    best, at, pieces = c, end - 1, len(text[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, count[at] + pieces
        return count[n]

    def count(self, text: str | None) -> int:
        """The pieces of a text; none for a null or empty one."""
        if not text:
            return 0
        total, known = 0, self.known
        if len(known) > REMEMBERED:
            known.clear()
        for segment, times in Counter(self.splitter.findall(MARK + text.replace(" ", MARK))).items():
            n = known.get(segment)
            if n is None:
                n = known[segment] = self._segment(segment)
            total += n * times
        return total


@lru_cache(maxsize=2)
def _counting(path: str) -> Counting:
    return Counting(read_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens of each document.

    ``docs`` has doc_id and text; ``vocabulary`` is a sentencepiece model file whose pieces and scores are read as
    a unigram vocabulary.  Spaces become marks, one more stands in front; characters outside the vocabulary count
    as their bytes.  A null or empty text has no tokens; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        counting = _counting(path)
        for batch in batches:
            texts = batch.column("text")
            n = pa.array([counting.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), n], names=["doc_id", "n_chars", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
