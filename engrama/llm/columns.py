"""Column-level building blocks that stay inside the JVM.

Every function takes and returns ``Column`` objects, treats a null text as a
text without words, and works on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate plain words.
GAPS = " \t\n\x0b\x0c\r"
#: A regular expression for runs of those characters.
GAP_RUN = "[ \\t-\\r]+"
#: Runs of characters that are no part of a normalised word.
NORMAL_GAP_RUN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once per row.

    A column that a lambda refers to is evaluated again for each element; a
    lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(text, F.lit(""))


def plain_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order."""
    return F.array_remove(F.split(whole(text), GAP_RUN), "")


def normal_words(text: Column) -> Column:
    """A-Z lower-cased; runs of a-z, 0-9 and everything beyond ASCII."""
    lowered = F.translate(whole(text), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NORMAL_GAP_RUN), "")


def count_of(text: Column, characters: str) -> Column:
    """How many code points of the text are among ``characters``."""
    return (F.length(whole(text)) - F.length(F.translate(whole(text), characters, ""))).cast("long")


def word_hashes(words: Column) -> Column:
    """xxhash64 of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def hash_windows(singles: Column, width: int) -> Column:
    """xxhash64 of each run of ``width`` consecutive words, by position.

    ``singles`` has the hash of each word. Built by doubling: hashes of 1, 2,
    4, ... words are combined, so a window costs log2(width) hashes of two
    longs instead of one of ``width`` strings. A text of fewer words has no
    window.
    """

    def joined(left: Column, right: Column, by: int) -> Column:
        ahead = F.slice(right, F.lit(by + 1), F.size(right))
        return F.zip_with(left, ahead, lambda a, b: F.xxhash64(a, b))

    def grow(level: Column, size: int, done: Column | None, covered: int) -> Column:
        """level: hashes of ``size`` words; done: of the ``covered`` words that the lower bits of width ask for."""
        if width & size:
            done, covered = (level, size) if done is None else (joined(done, level, covered), covered + size)
        if size * 2 > width:
            return done
        up = joined(level, level, size).alias("up")
        if not covered:
            return let(F.struct(up), lambda pair: grow(pair["up"], size * 2, None, 0))
        return let(F.struct(up, done.alias("done")), lambda pair: grow(pair["up"], size * 2, pair["done"], covered))

    return let(singles, lambda h: F.slice(grow(h, 1, None, 0), F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0))))
