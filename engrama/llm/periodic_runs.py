"""Runs of words that repeat with a period, by probing a harmonic grid.

A run of period p and exponent EXPONENT holds, of the places 0, p, 2p, ... of its
text, three in a row at which the word equals the one p places on. All periods
of a text together have about n ln n such places, so they are probed at once,
vectorised over many texts. A streak of three equal probes survives; its words are
compared in growing chunks to both sides until they differ. Periods ascend, and
a place inside a run found before whose period divides p is passed over: all
that lies around it has the smaller period.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.columns import let, plain_words
from engrama.llm.hashing import chunks, thrifty, word_values

#: A run is at least so many times its period long, and so many words.
EXPONENT, LEAST = 4, 6
#: Probes that are made at once; words in the first chunk of a comparison.
LOAD, FIRST_CHUNK = 1 << 20, 64

_OUT = "id {}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def streaks(values: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period, first and last place of streaks of three or more equal probes; by text, then period.

    Text t has the words ``first[t]`` to ``first[t + 1]``; places count from the first word of all.
    """
    sizes = np.diff(first)
    longest = np.where(sizes >= LEAST, sizes // EXPONENT, 0)
    ends = np.cumsum(longest)
    at = 0
    while at < (ends[-1] if len(ends) else 0):
        group = np.arange(at, min(at + LOAD // EXPONENT, ends[-1]))
        text = np.searchsorted(ends, group, "right")
        period = group - (ends - longest)[text] + 1
        probes = (sizes[text] - 1) // period
        total = np.cumsum(probes)
        n = max(1, int(np.searchsorted(total, LOAD, "right")))
        text, period, probes, total = text[:n], period[:n], probes[:n], total[:n]
        at += n
        own = np.repeat(np.arange(n), probes)
        place = (np.arange(total[-1]) - np.repeat(total - probes, probes)) * period[own] + first[text][own]
        equal = values[place] == values[place + period[own]]
        three = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:] & (own[:-2] == own[2:]))
        if not len(three):
            continue
        fresh = np.ones(len(three), bool)
        fresh[1:] = (np.diff(three) != 1) | (own[three[1:]] != own[three[:-1]])
        begin = three[fresh]
        end = three[np.append(np.flatnonzero(fresh)[1:], len(three)) - 1] + 2
        yield text[own[begin]], period[own[begin]], place[begin], place[end]


def _equal_on(values: np.ndarray, at: int, end: int, period: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``period`` on, or ``end - period``."""
    step, last = FIRST_CHUNK, end - period
    while at < last:
        upto = min(at + step, last)
        same = values[at:upto] == values[at + period : upto + period]
        if not same.all():
            return at + int(same.argmin())
        at, step = upto, step * 2
    return last


def _equal_back(values: np.ndarray, at: int, begin: int, period: int) -> int:
    """The least place from which on, up to ``at``, words equal those ``period`` on."""
    step = FIRST_CHUNK
    while at > begin:
        downto = max(at - step, begin)
        same = values[downto:at] == values[downto + period : at + period]
        if not same.all():
            return at - int(same[::-1].argmin())
        at, step = downto, step * 2
    return begin


def _passed(found: dict[int, tuple[list[int], list[int]]], place: int, period: int) -> int:
    """Where a run ends that was found before, holds ``place`` and the place ``period`` on, and whose period divides ``period``; else 0."""
    for q, (begins, ends) in found.items():
        if period % q == 0 and (k := bisect_right(begins, place) - 1) >= 0 and ends[k] > place + period:
            return ends[k]
    return 0


def runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Text, start, length and period of all runs, a row each, by text, start and period; starts count within the text."""
    out: list[tuple[int, int, int, int]] = []
    now, found = -1, {}
    for block in streaks(values, first):
        for text, period, place, last in zip(*(x.tolist() for x in block), strict=True):
            if text != now:
                now, found = text, {}
                begin, end = int(first[text]), int(first[text + 1])
            while place <= last:
                beyond = _passed(found, place, period)
                if beyond:
                    place += ((beyond - 1 - period - place) // period + 1) * period
                    continue
                right = _equal_on(values, place, end, period)
                left = _equal_back(values, min(place, right), begin, period)
                length = right - left + period
                if right > left and length >= max(LEAST, EXPONENT * period):
                    begins, ends = found.setdefault(period, ([], []))
                    begins.append(left)
                    ends.append(right + period)
                    out.append((text, left - begin, length, period))
                place += max(1, -(-(right - place) // period)) * period
    rows = np.array(out, np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, n: int) -> pa.Array:
    """Words (of ascending texts) joined by one space; n texts."""
    last = np.append(texts[1:] != texts[:-1], True) if len(texts) else np.zeros(0, bool)
    sizes = ends - starts + ~last
    upto = np.cumsum(sizes)
    body = np.append(data, np.uint8(32))[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)]
    body[upto[~last] - 1] = 32
    offsets = np.append(0, upto)[np.searchsorted(texts, np.arange(n + 1))]
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to id, number of words, runs, and the text without what repeats."""
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            values, starts, ends, first = word_values(data, offsets)
            n = len(offsets) - 1
            found = runs(values, first)
            of = first[found[:, 0]] + found[:, 1]
            depth = np.zeros(len(values) + 1, np.int64)
            np.add.at(depth, of + found[:, 3], 1)
            np.add.at(depth, of + found[:, 2], -1)
            kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
            texts = np.searchsorted(first, kept, "right") - 1
            fields = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(n + 1)), pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(first), pa.int64()), listed, _joined(data, starts[kept], ends[kept], texts, n)], names=["id", "n_words", "runs", "collapsed"])


def collapse(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``row_id``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the words kept, joined by one space.

    Words are what ASCII white space parts. A run is a longest stretch of words in which
    words ``period`` apart are equal, of the smallest such period, at least 4 periods
    and 6 words long. A word goes if some run holds it after its first period.

    A null or blank text has no words, no runs and an empty ``collapsed``. Rows are
    judged one by one, so repeated rows and null ids give a row each; an empty table
    gives none. Texts are worked on whole, some 256 KB of them at a time, or one longer text. Other
    columns, whatever their names, have no effect.
    """
    slim = docs.select(docs[row_id].alias("id"), docs[text].alias("text"))
    out = slim.mapInArrow(thrifty(_collapsed), _OUT.format(slim.schema["id"].dataType.simpleString()))
    return out.withColumnRenamed("id", row_id)


def looped(row_id: Column, text: Column) -> Column:
    """The text, in which one row in ten, by the CRC-32 of its id, goes on from some word in a loop.

    With h the CRC-32, g = h // 10 and n words, words from a = g % n on repeat with the
    period 1 + (n - a) // (3 + g % 8). A text without words, or of a null id, stays.
    """
    h = F.crc32(row_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def told(w: Column) -> Column:
        n = F.size(w)

        def loop(c: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")), lambda i: F.get(w, F.when(i < c["a"], i).otherwise(c["a"] + F.pmod(i - c["a"], c["p"])).cast("int"))), " ")

        a = F.pmod(g, n.cast("long"))
        return F.when(n > 0, let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p")), loop)).otherwise(F.lit(""))

    return F.when(F.pmod(h, F.lit(10)) == 0, let(plain_words(text), told)).otherwise(text)
