"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Patterns give the base spans. Beyond them every token of 16 or more characters
is tested in the encoding that its characters tell. Three tests, each against
ordinary writing and against even, independent draws from the alphabet:

* uniformity of the alphabet. Against writing: the likelihood ratio of evenly
  drawn letters to the corpus's letters; against draws: chi-squared.
* runs. Against writing: at most TEXT_CHANGES of a token's inner places change
  between digits, lower and upper case; against draws: runs about the middle of
  the alphabet.
* serial correlation. Against writing: the ratio of independent letters to the
  corpus's pairs; against draws: the lag-one correlation.

The two ratios multiply to one whose mean under writing is 1 whatever the runs
are, so the p-value of the runs over that ratio is a p-value of all three. These
p-values enter the length-weighted Benjamini-Hochberg rule (weights follow the
length, mean 1), encoding by encoding, over all tokens of the corpus, at a rate
of FALSE_DISCOVERIES. The p-values against draws are combined by Fisher's method;
among an encoding's discoveries the same rule at a rate of FALSE_REJECTIONS takes
out those that are not random either.

The null needs one table of letter pairs over the corpus, the two cut-offs one
histogram, both of a bounded size; the texts are read three times and never
shuffled.
"""

from __future__ import annotations

import hashlib
import math
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.hashing import thrifty

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run shorter than 32 is no match; a longer one is taken whole.
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Padding stands at the end only: another '=' parts a name from a value.
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
#: What one of the two alphabets with signs holds, for parts that mix the signs of both.
ONE_ALPHABET = (re.compile(r"[A-Za-z0-9_=-]{16,}"), re.compile(r"[A-Za-z0-9+/=]{16,}"))
#: Alphabets by increasing size: the first that has all characters is inferred.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]
_CLASSES = str.maketrans({**{c: "d" for c in "0123456789"}, **{chr(c): "l" for c in range(97, 123)}, **{chr(c): "u" for c in range(65, 91)}, **{c: None for c in "+/_=-"}})
TEXT_CHANGES = 0.05
FALSE_DISCOVERIES = 0.01
FALSE_REJECTIONS = 0.001
#: Steps of -log10(p / weight) against writing in the histogram, and the last of them.
STEP, LAST = 0.02, 3000
#: Steps of -log10(p) against even draws, and the last of them.
RANDOM_STEP, RANDOM_LAST = 0.1, 100
#: Per encoding the least step against writing and the greatest against even draws that a discovery has.
Cuts = dict[str, tuple[int, int]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in WORDS_OF_ASSIGN):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def runs_log_p(token: str) -> float:
    """Log of the chance that ordinary writing changes class as often as the token does; 0 up to what it does on average."""
    classes = token.translate(_CLASSES)
    places = len(classes) - 1
    changes = sum(map(operator.ne, classes, classes[1:]))
    if changes <= max(0, places * TEXT_CHANGES):
        return 0.0
    q = TEXT_CHANGES / (1 - TEXT_CHANGES)
    first = math.lgamma(places + 1) - math.lgamma(changes + 1) - math.lgamma(places - changes + 1) + changes * math.log(TEXT_CHANGES) + (places - changes) * math.log1p(-TEXT_CHANGES)
    term, total = 1.0, 0.0  # beyond the average each term is less than the one before
    for k in range(changes, places + 1):
        total += term
        term *= (places - k) / (k + 1) * q
        if term < total * 1e-12:
            break
    return min(0.0, first + math.log(total))


#: Of a byte: its letter without case, or 26 for what is none.
_LETTER = np.full(256, 26, np.int16)
_LETTER[65:91] = _LETTER[97:123] = np.arange(26)
_PIECE = 1 << 20


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each letter follows each, 26 standing for what is none, for the texts of a partition."""
    count = np.zeros(27 * 27, np.int64)
    for batch in batches:
        data = np.frombuffer("\n".join(["", *(t for t in batch.column(0).to_pylist() if t)]).encode(), np.uint8)
        for at in range(0, len(data) - 1, _PIECE):
            letters = _LETTER[data[at : at + _PIECE + 1]]
            count += np.bincount(letters[:-1] * 27 + letters[1:], minlength=27 * 27)
    yield pa.RecordBatch.from_pydict({"pair": pa.array(range(27 * 27), pa.int32()), "n": pa.array(count, pa.int64())})


@dataclass(frozen=True)
class Writing:
    """Letters of the corpus, logs: of each letter, and of each after another over what it is by itself."""

    letter: list[float]
    pair: list[float]


def writing(docs: DataFrame, text: str = "text") -> Writing:
    """The null of ordinary writing, from all texts; the driver gets 729 sums."""
    rows = docs.select(docs[text].alias("text")).mapInArrow(thrifty(_pairs), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(27 * 27)
    for r in rows:
        count[r["pair"]] = r["n"]
    pairs = count.reshape(27, 27)[:, :26] + 1
    letter = pairs.sum(axis=0) / pairs.sum()
    given = pairs / pairs.sum(axis=1, keepdims=True)
    after = np.zeros((27, 27))
    after[:, :26] = np.log(given / letter)
    return Writing([*np.log(letter).tolist(), 0.0], after.ravel().tolist())


#: Letters, whatever their case, that an encoding draws from: those of hexadecimal numbers, or all.
_DRAWN = (math.log(6), math.log(26))


def writing_log_p(token: str, null: Writing) -> float:
    """Log of the p-value of all three tests against ordinary writing."""
    letters = [26, *_LETTER[np.frombuffer(token.encode(), np.uint8)].tolist()]
    n = sum(x < 26 for x in letters)
    if not n:
        return 0.0
    uniformity = sum(null.letter[x] for x in letters) + n * _DRAWN[max(x for x in letters if x < 26) > 5]
    serial = sum(null.pair[27 * a + b] for a, b in zip(letters, letters[1:], strict=False))
    # the alternative of the two is chosen by the token: the ratio counts half
    return min(0.0, runs_log_p(token) + uniformity + serial + math.log(2))


def _upper_tail(chi: float, df: int) -> float:
    """Of the chi-squared distribution, by Wilson and Hilferty."""
    z = ((max(chi, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that has all characters of the token."""
    held = set(token)
    return next(((name, index) for name, chars, index in _SETS if held <= chars), None)


def random_p(token: str, index: dict[str, int]) -> float:
    """Of the hypothesis that the token is drawn evenly and independently from its alphabet; three tests, combined by Fisher's method."""
    values, k, n = [index[c] for c in token], len(index), len(token)
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    uniform = _upper_tail(k / n * sum(c * c for c in counts.values()) - n, k - 1)
    high = [2 * v >= k for v in values]
    ups = sum(high)
    runs_p = 1.0 if n < 3 else 0.0
    if 0 < ups < n:
        runs = 1 + sum(map(operator.ne, high, high[1:]))
        mean = 1 + 2 * ups * (n - ups) / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    middle = sum(values) / n
    square = sum((v - middle) ** 2 for v in values)
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:], strict=False)) / square if square else 1.0
    serial_p = _two_sided((serial + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs_p, serial_p))
    return _upper_tail(fisher, 6)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens to be tested, in order.

    Those that mix the signs of both alphabets are tested by the parts that
    either holds; such parts may overlap.
    """
    out: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        for part in PART.finditer(text, *m.span()) if "=" in m.group() else (m,):
            a, b = part.span()
            token = text[a:b]
            if b - a < 16:
                continue
            if ("+" in token or "/" in token) and ("-" in token or "_" in token):
                out += sorted(x.span() for signs in ONE_ALPHABET for x in signs.finditer(text, a, b))
            else:
                out.append((a, b))
    return out


def tested(token: str, null: Writing) -> tuple[str, int, int] | None:
    """Encoding and steps in the histogram: of -log10 of the p-value against writing over a weight in proportion to the length, and against even draws.

    None without an encoding, or where less than 8 characters are no signs at the ends.
    """
    core = token.strip("=-_/+")
    inferred = encoding(core) if len(core) >= 8 else None
    if inferred is None:
        return None
    log_p = writing_log_p(token, null)
    if log_p >= 0:  # as like writing as can be: counts as a test only
        return inferred[0], 0, RANDOM_LAST
    step = max(0, min(LAST, int((math.log10(len(token)) - log_p / math.log(10)) / STEP)))
    p = random_p(core, inferred[1])
    return inferred[0], step, min(RANDOM_LAST, int(-math.log10(max(p, 1e-300)) / RANDOM_STEP))


def _tests(null: Writing) -> Callable:
    """Number of tokens and their total length by encoding and steps, for the texts of a partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for a, b in candidates(text) if text else ():
                    if found := tested(text[a:b], null):
                        one = seen.setdefault(found, [0, 0])
                        one[0] += 1
                        one[1] += b - a
        encodings, steps, randoms = ([k[i] for k in seen] for i in range(3))
        yield pa.RecordBatch.from_pydict({"encoding": pa.array(encodings, pa.string()), "step": pa.array(steps, pa.int32()), "random": pa.array(randoms, pa.int32()), "n": pa.array([x for x, _ in seen.values()], pa.int64()), "length": pa.array([x for _, x in seen.values()], pa.int64())})

    return rows


def cut(rows: list[tuple[int, int, int, int]], rate: float = FALSE_DISCOVERIES, rejections: float = FALSE_REJECTIONS) -> tuple[int, int]:
    """Of one encoding's histogram (step, random step, tokens, length): the least step of a discovery and the greatest random step.

    A step beyond LAST says that there are no discoveries.
    """
    tests, by_step = sum(n for _, _, n, _ in rows), Counter()
    for step, _, n, _ in rows:
        by_step[step] += n
    mean, best, found = sum(x for *_, x in rows) / max(tests, 1), LAST + 1, 0
    for step in sorted(by_step, reverse=True):
        found += by_step[step]
        # p / weight at the weak end of the step, times the tests, over the discoveries
        if 10 ** (-step * STEP) * mean * tests <= rate * found:
            best = step
    by_random = Counter()
    for step, random, n, _ in rows:
        if step >= best:
            by_random[random] += n
    discoveries, not_random, most = sum(by_random.values()), 0, RANDOM_LAST
    for random in sorted(by_random, reverse=True):
        not_random += by_random[random]
        if random and 10 ** (-random * RANDOM_STEP) * discoveries <= rejections * not_random:
            most = random - 1
    return best, most


def cuts(docs: DataFrame, null: Writing, text: str = "text") -> Cuts:
    """The cuts by encoding. All tokens of the corpus are tested; the driver gets sums by encoding and steps, the number of which is bounded."""
    return {name: cut(rows) for name, rows in histogram(docs, null, text).items()}


def histogram(docs: DataFrame, null: Writing, text: str = "text") -> dict[str, list[tuple[int, int, int, int]]]:
    """By encoding: step, random step, tokens, total length."""
    seen = docs.select(docs[text].alias("text")).mapInArrow(thrifty(_tests(null)), "encoding string, step int, random int, n long, length long")
    by_encoding: dict[str, list] = {}
    for r in seen.groupBy("encoding", "step", "random").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect():
        by_encoding.setdefault(r["encoding"], []).append((r["step"], r["random"], r["n"], r["length"]))
    return by_encoding


def all_spans(text: str | None, least: Cuts, null: Writing) -> list[tuple[int, int, int]]:
    """Base spans and the discoveries outside them, by start and kind."""
    if not text:
        return []
    spans = base_spans(text)
    found: list[tuple[int, int, int]] = []
    for a, b in candidates(text):
        if any(x < b and a < y for x, _, y in spans):
            continue
        result = tested(text[a:b], null)
        if result is None:
            continue
        encoded, step, random = result
        step_cut, random_cut = least.get(encoded, (LAST + 1, 0))
        if not step or step < step_cut or random > random_cut:
            continue
        if found and a < found[-1][2]:  # parts of one token
            found[-1] = (found[-1][0], 3, max(b, found[-1][2]))
        else:
            found.append((a, 3, b))
    return sorted(spans + found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``row_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``, ``spans``.

    Positions count code points, ends are exclusive. A null or empty text has
    no spans; very long texts and tokens are tested whole. Repeated rows are
    scanned each on its own; other columns are not looked at. An empty table
    gives no rows.
    """
    null = writing(docs, text)
    least = cuts(docs, null, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, least, null) for t in batch.column(1).to_pylist()]
            kinds = [[k for _, k, _ in f] for f in found]
            counts = {f"n_{name}": pa.array([k.count(i) for k in kinds], pa.int64()) for i, name in enumerate(KINDS)}
            base = [hashlib.sha256(_joined([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **counts, "base_sha256": pa.array(base, pa.string()), "spans": pa.array([_joined(f) for f in found], pa.string())})

    slim = docs.select(docs[row_id].alias("id"), docs[text].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(thrifty(rows), f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    return out.withColumnRenamed("id", row_id)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans count as one.

    All columns and rows stay; a null text stays null.
    """
    null = writing(docs, text)
    least = cuts(docs, null, text)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else _without(t, all_spans(t, least, null), mark) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, cleaned(docs[text]))


def _without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    end = 0
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = at = max(end, b)
    return "".join(out) + text[at:]
