"""Word-level measures of whole texts as SQL expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .store import let

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ leaves it out.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; an empty array for none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Hashes of the windows tell at once that a text repeats none; only texts with an equal pair are
    sorted, by the windows themselves, so that the count is exact.
    """

    def exact(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("x"), i.alias("i")))
        return let(F.sort_array(windows), lambda s: let(F.sort_array(_shared(s)), _covered))

    def _shared(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
        return F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])

    def _covered(p: Column) -> Column:
        reach = F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(w: Column) -> Column:
        repeats = let(hashed(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < 4, F.lit(0)).when(repeats, exact(w)).otherwise(F.lit(0))

    return let(words, count)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (all long).

    A null text has no words.  n_lines counts the lines with a word, n_dup_lines those of them that
    equal an earlier line.
    """

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        dup = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("k")))
        kept = F.length(F.translate(t, SPACE, ""))
        rows = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
        return let(
            F.struct(rows.alias("w"), dup.alias("d")),
            lambda s: F.struct(
                s["w"]["n"].cast("long").alias("n_words"),
                kept.cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (s["d"]["n"] - s["d"]["k"]).cast("long").alias("n_dup_lines"),
                s["w"]["r"].cast("long").alias("n_repeat_words"),
                s["d"]["n"].cast("long").alias("n_lines"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)
