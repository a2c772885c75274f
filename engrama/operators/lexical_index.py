"""A stored inverted index: BM25's best notes without reading every posting.

Postings lie in blocks of notes of like length, one row per term and block, with the
greatest frequency and the least length in it. From these follows, under any average
length, what the block can give at most. A query reads these bounds first, scores
the most promising blocks, and then only those others that can still reach the k-th
best score found so far.

An index is a folder of segments. Refreshing adds one with the new and changed notes
and the names of those that no longer count, so what it writes grows with the change.
Term counts are kept as differences, so statistics are those of a new build.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions.text import content_hash, tokens
from engrama.operators.graph import refresh_plan
from engrama.operators.lexical import Tokenizer, idf, query_terms
from engrama.settings import Settings
from engrama.sources.shared import drop, move, names_in, stash

#: Notes of a block, about; folders that terms are dealt into. The layout's number changes when either does, or the tables, or the tokens.
BLOCK, BUCKETS, LAYOUT = 128, 16, 3
#: Query terms and blocks up to which they are pushed into the scan, and bounds up to which the driver picks the blocks; beyond, all of this is joined.
MOST_TERMS, MOST_BLOCKS, MOST_BOUNDS = 2000, 5000, 100_000
#: Blocks per query that are scored first.
PROBED = 4


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.crc32(F.col(term) if isinstance(term, str) else term), F.lit(BUCKETS)).cast("int")


def _length_class(dl: Column) -> Column:
    """Lengths that differ by a tenth or less are one class."""
    return F.floor(F.log(F.greatest(dl, F.lit(1)).cast("double")) * 10).cast("int")


#: Columns of a segment's tables, for a type of id.
TABLES = {
    "blocks": "term string, block long, n long, max_tf int, min_dl int, ids array<{0}>, tfs array<int>, dls array<int>, bucket int",
    "terms": "term string, df long, bucket int",
    "notes": "id {0}, content_hash string, dl int, terms array<string>",
    "dead": "id {0}",
    "meta": "notes long, words long",
}


class Index:
    """An opened index: its folder and the segments that were complete when it was opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.segments = sorted(int(n[4:]) for n in names_in(spark, folder) if n.startswith("seg-"))
        self.kind = spark.read.parquet(f"{folder}/seg-{self.segments[0]}/notes").schema["id"].dataType.simpleString()
        size = self.table("meta").agg(F.sum("notes").alias("notes"), F.sum("words").alias("words")).first()
        self.notes, self.words = size["notes"] or 0, size["words"] or 0

    def table(self, name: str) -> DataFrame:
        """The rows of all segments, with their ``seg``."""
        out = None
        for n in self.segments:
            part = self.spark.read.schema(TABLES[name].format(self.kind)).parquet(f"{self.folder}/seg-{n}/{name}").withColumn("seg", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out

    def dead(self) -> DataFrame:
        """id, until: what segments before ``until`` say about a note no longer counts."""
        return self.table("dead").groupBy("id").agg(F.max("seg").alias("until"))

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, seg, ...) that still count."""
        if len(self.segments) == 1:
            return rows
        return rows.join(self.dead(), "id", "left").filter("until is null or seg >= until").drop("until")

    def of_terms(self, name: str, terms: list[str] | None, wanted: DataFrame) -> DataFrame:
        """Rows of a table for the wanted terms; few terms are pushed into the scan."""
        rows = self.table(name)
        if terms is None:
            return rows.join(wanted.select("term", _bucket("term").alias("bucket")).distinct(), ["bucket", "term"])
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        return rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Notes with their words ``w`` to their length, their terms and how often each stands there."""
    for batch in batches:
        lengths, words = pc.list_value_length(batch["w"]), batch["w"].flatten().dictionary_encode()
        size, terms = max(len(words.dictionary), 1), words.dictionary
        note = np.repeat(np.arange(batch.num_rows), lengths.fill_null(0).to_numpy())
        keys, tf = np.unique(note * size + words.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * size).astype("int32"))
        lists = pa.ListArray.from_arrays(ends, terms.take(pa.array(keys % size))), pa.ListArray.from_arrays(ends, pa.array(tf.astype("int32")))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["content_hash"], lengths.cast(pa.int32()), *lists], names=["id", "content_hash", "dl", "terms", "tfs"])


def _packed(rows: pa.Table) -> pa.Table:
    """A block's notes to a row per term with its postings by id."""
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending")])).combine_chunks()
    lists, tf = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks().flatten().to_numpy()
    words, n = lists.flatten().dictionary_encode(), pc.list_value_length(lists).fill_null(0).to_numpy()
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    code, note = words.indices.to_numpy()[order], np.repeat(np.arange(len(rows)), n)[order]
    tf, dl = tf[order].astype("int32"), np.repeat(rows["dl"].fill_null(0).to_numpy(), n)[order].astype("int32")
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, "int64")
    ends = pa.array(np.append(begin, len(code)).astype("int32"))
    most, least = (f.reduceat(x, begin) if len(code) else x for f, x in ((np.maximum, tf), (np.minimum, dl)))
    postings = [pa.ListArray.from_arrays(ends, x) for x in (rows["id"].combine_chunks().take(pa.array(note)), pa.array(tf), pa.array(dl))]
    block = rows["block"].combine_chunks().take(pa.array(np.zeros(len(begin), "int64")))
    names = ["term", "block", "n", "max_tf", "min_dl", "ids", "tfs", "dls"]
    return pa.table([words.dictionary.take(pa.array(code[begin])), block, pa.array(np.diff(np.append(begin, len(code)))), pa.array(most), pa.array(least), *postings], names=names)


def _write(index_folder: str, segment: int, notes: DataFrame, text: Column, cut: Tokenizer, dead: DataFrame, dead_terms: DataFrame, gone: tuple[int, int]) -> None:
    """A segment with these notes (id, ...), written aside and moved into place whole."""
    spark = notes.sparkSession
    at = f"{index_folder}/.writing-{uuid.uuid4().hex}"
    kind = notes.schema["id"].dataType.simpleString()
    cols = f"id {kind}, content_hash string, dl int, terms array<string>, tfs array<int>"
    # what a note says is counted in the task that reads it, and lies there once
    notes.select("id", content_hash(text).alias("content_hash"), cut(text).alias("w")).mapInArrow(_counted, cols).write.parquet(f"{at}/notes")
    own = spark.read.schema(cols).parquet(f"{at}/notes")
    # notes of one length class are dealt into blocks of about BLOCK; there are as many classes as lengths have orders of magnitude
    classes = own.groupBy(_length_class(F.col("dl")).alias("c")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = own.withColumn("c", _length_class(F.col("dl"))).join(F.broadcast(classes), "c")
    placed = placed.select("id", "dl", "terms", "tfs", (F.col("c").cast("long") * (1 << 40) + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"))
    # notes are shuffled once, to their block; its postings are written by the task that packs them
    packed = placed.groupBy("block").applyInArrow(_packed, f"term string, block long, n long, max_tf int, min_dl int, ids array<{kind}>, tfs array<int>, dls array<int>")
    blocks = packed.withColumn("bucket", _bucket("term"))
    blocks.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/blocks")
    written = spark.read.schema(blocks.schema).parquet(f"{at}/blocks")
    counted = written.select("term", F.col("n").alias("df")).unionByName(dead_terms.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).withColumn("bucket", _bucket("term"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
    dead.select("id").write.parquet(f"{at}/dead")
    own.agg((F.count(F.lit(1)) - gone[0]).alias("notes"), (F.coalesce(F.sum("dl"), F.lit(0)) - gone[1]).alias("words")).write.parquet(f"{at}/meta")
    move(spark, at, f"{index_folder}/seg-{segment}")


def build(notes: DataFrame, text: Column, folder: str, cut: Tokenizer = tokens) -> Index:
    """The index of ``notes`` (id and what ``text`` reads) in a new folder."""
    spark, kind = notes.sparkSession, notes.schema["id"].dataType.simpleString()
    _write(folder, 0, notes, text, cut, spark.createDataFrame([], f"id {kind}"), spark.createDataFrame([], "term string, df long"), (0, 0))
    return Index(spark, folder)


def refresh(index: Index, notes: DataFrame, text: Column, cut: Tokenizer = tokens) -> Index:
    """The index with a segment for what is new, changed (by content hash) or gone; without changes the same."""
    held = index.live(index.table("notes"))
    plan = stash(refresh_plan(held, notes.select("id", content_hash(text).alias("content_hash"))).filter("action != 'keep'"))
    if plan.isEmpty():
        drop(plan)
        return index
    gone = stash(held.join(plan.select("id"), "id", "left_semi"))
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    fresh = notes.join(plan.filter("action = 'embed'").select("id"), "id", "left_semi")
    lost = gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    _write(index.folder, index.segments[-1] + 1, fresh, text, cut, gone, lost, (size["n"], size["words"]))
    drop(plan, gone)
    return Index(index.spark, index.folder)


def _part(tf: str, dl: str, average: float, settings: Settings) -> Column:
    k1, b = settings.k1, settings.b
    return F.col("w") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / average))


class Search:
    """The best notes of some queries, and how many blocks were read for them."""

    def __init__(self, index: Index, queries: DataFrame, query_text: Column, k: int, settings: Settings = Settings(), cut: Tokenizer = tokens):
        self.index, self.k, self.settings, spark = index, k, settings, index.spark
        self.average = max(index.words / max(index.notes, 1), 1.0)
        wanted = query_terms(queries, query_text, cut)
        few = wanted.limit(MOST_TERMS + 1).collect()
        self.terms = sorted({r.term for r in few}) if len(few) <= MOST_TERMS else None
        self.postings = index.of_terms("blocks", self.terms, wanted)
        heads = self.postings.select("term", "seg", "block", "n", "max_tf", "min_dl")
        known = heads.limit(MOST_BOUNDS + 1).collect() if self.terms is not None else []
        self.few = self.terms is not None and len(known) * max(Counter(r.term for r in few).values(), default=1) <= MOST_BOUNDS
        if self.few:
            self._bounded(few, known, wanted)
            return
        wanted = wanted if self.terms is None else spark.createDataFrame(few, wanted.schema)
        df = index.of_terms("terms", self.terms, wanted).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        self.weights = wanted.join(df, "term").select("query_id", "term", (F.col("times") * idf(F.col("df"), F.lit(index.notes))).alias("w"))
        #: query_id, seg, block, rows (terms that the block has) and what a note of the block can score at most.
        self.bounds = heads.join(self.weights, "term").groupBy("query_id", "seg", "block").agg(F.sum(_part("max_tf", "min_dl", self.average, settings)).alias("most"), F.count(F.lit(1)).alias("rows"))

    def _bounded(self, few: list, heads: list, wanted: DataFrame) -> None:
        """Weights and bounds of a few terms in a few blocks."""
        index, df = self.index, Counter()
        if len(index.segments) == 1:
            for h in heads:
                df[h.term] += h.n
        else:
            df.update({r.term: r.df for r in index.of_terms("terms", self.terms, wanted).groupBy("term").agg(F.sum("df").alias("df")).collect()})
        weights = [(r.query_id, r.term, r.times * math.log(1 + (index.notes - df[r.term] + 0.5) / (df[r.term] + 0.5))) for r in few if df[r.term] > 0]
        kind = wanted.schema["query_id"].dataType.simpleString()
        self.weights = index.spark.createDataFrame(weights, f"query_id {kind}, term string, w double")
        by_term, most, rows = defaultdict(list), defaultdict(float), Counter()
        for q, term, w in weights:
            by_term[term].append((q, w))
        k1, b = self.settings.k1, self.settings.b
        for h in heads:
            part = h.max_tf * (k1 + 1) / (h.max_tf + k1 * (1 - b + b * h.min_dl / self.average))
            for q, w in by_term[h.term]:
                most[q, h.seg, h.block] += w * part
                rows[q, h.seg, h.block] += 1
        self.kept = [(*key, x, rows[key]) for key, x in most.items()]
        self.bounds = index.spark.createDataFrame(self.kept, f"query_id {kind}, seg int, block long, most double, rows long")

    def scored(self, chosen: DataFrame | list[tuple]) -> DataFrame:
        """query_id, id, bm25, matched of the notes in the chosen blocks (query_id, seg, block)."""
        kind = self.weights.schema["query_id"].dataType.simpleString()
        few = chosen if isinstance(chosen, list) else [tuple(r) for r in chosen.select("query_id", "seg", "block").limit(MOST_BLOCKS + 1).collect()]
        rows = self.postings
        if len(few) <= MOST_BLOCKS or isinstance(chosen, list):
            chosen = F.broadcast(self.index.spark.createDataFrame(few, f"query_id {kind}, seg int, block long"))
        if len(few) <= MOST_BLOCKS:
            rows = rows.filter(F.col("block").isin(sorted({block for _, _, block in few})))
        each = rows.join(self.weights, "term").join(chosen.select("query_id", "seg", "block"), ["query_id", "seg", "block"])
        each = each.select("query_id", "seg", "term", "w", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("query_id", "seg", "term", "w", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        own = each.groupBy("query_id", "seg", "id").agg(F.sum(_part("tf", "dl", self.average, self.settings)).alias("bm25"), F.sort_array(F.collect_set("term")).alias("matched"))
        return self.index.live(own).select("query_id", "id", "bm25", "matched")

    def wanted_blocks(self) -> DataFrame:
        """query_id, seg, block, rows: the blocks that can still hold one of the k best notes."""
        if self.few:
            kind = self.weights.schema["query_id"].dataType.simpleString()
            return self.index.spark.createDataFrame(self._picked(), f"query_id {kind}, seg int, block long, rows long")
        order = W.partitionBy("query_id").orderBy(F.desc("most"), "seg", "block")
        probe = self.scored(self.bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= PROBED))
        last = probe.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25")))).filter(F.col("r") == self.k).select("query_id", (F.col("bm25") * (1 - 1e-9)).alias("least"))
        return self.bounds.join(last, "query_id", "left").filter("least is null or most >= least").select("query_id", "seg", "block", "rows")

    def _picked(self) -> list[tuple]:
        """The same of few blocks: those of each query whose bound is highest are scored for the k-th best."""
        first, seen = [], Counter()
        for q, seg, block, _, _ in sorted(self.kept, key=lambda x: -x[3]):
            seen[q] += 1
            if seen[q] <= PROBED:
                first.append((q, seg, block))
        if len(first) == len(self.kept):
            return [(q, seg, block, rows) for q, seg, block, _, rows in self.kept]
        probe = self.scored(first).select("query_id", "bm25").withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25"))))
        least = {r.query_id: r.bm25 * (1 - 1e-9) for r in probe.filter(F.col("r") == self.k).collect()}
        return [(q, seg, block, rows) for q, seg, block, most, rows in self.kept if most >= least.get(q, 0.0)]

    def top(self) -> DataFrame:
        """query_id, id, bm25, matched of each query's k best notes, ties by id."""
        order = W.partitionBy("query_id").orderBy(F.desc("bm25"), "id")
        picked = [x[:3] for x in self._picked()] if self.few else self.wanted_blocks()
        best = self.scored(picked).withColumn("r", F.row_number().over(order))
        return best.filter(F.col("r") <= self.k).drop("r")


_opened: dict[tuple[str, str], Index] = {}


def stored(notes: DataFrame, text: Column, folder: str, cut: Tokenizer = tokens) -> Index:
    """The index in the folder, built there first if it isn't yet; opened once an application as long as no segment is added."""
    spark, folder = notes.sparkSession, f"{folder}-layout{LAYOUT}"
    key = spark.sparkContext.applicationId, folder
    there = sorted(int(n[4:]) for n in names_in(spark, folder) if n.startswith("seg-"))
    if key not in _opened or _opened[key].segments != there:
        _opened[key] = Index(spark, folder) if there else build(notes, text, folder, cut)
    return _opened[key]
