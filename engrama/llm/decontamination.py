"""Benchmark passages in documents: a prefix-filtered set join.

Each item is cut into windows of ``width`` consecutive words (an item of fewer
is one window). A window is a set of two-word shingles that a document must
contain entirely, so by the prefix filter it is enough to join on one of them;
the rarest over the corpus gives the fewest candidates. The length bound
(enough words left in the document) and the positional bound (enough words
before) are applied in the join, and each candidate is verified word by word.

One pass over the texts keeps, per document, the places of the benchmark's
shingles with their words. Rarity, candidates and verification all read those
postings; a text is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.columns import let, normal_words, word_hashes
from engrama.llm.shared import stash

WIDTH = 10
#: Rows of the benchmark side that are broadcast (some 150 bytes each); a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Shingles of the benchmark up to which they are part of the scan's expression.
LITERALS = 20_000
#: Keys over which the places of a shingle are dealt in such a shuffle.
SALTS = 8
#: Stands for a document itself among its shingles.
ITSELF = -1


def item_windows(benchmark: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``words`` array, ``items`` array of item ids.

    A null or empty item has no words and no window.
    """
    words = benchmark.select(benchmark[item_id].cast("string").alias("item"), normal_words(benchmark[text]).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def shingle_hashes(words: Column) -> Column:
    """Hashes of two-word shingles by position; the last position has its word alone."""
    return let(word_hashes(words), lambda h: F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b)))


def single_hashes(words: Column) -> Column:
    """Hashes of the words alone, as the last position of a shingle row has them."""
    return F.transform(words, lambda w: F.xxhash64(F.xxhash64(w), F.lit(None).cast("long")))


def _candidates(windows: DataFrame) -> DataFrame:
    """A row per window and shingle: ``window`` hash, ``offset``, ``shingle``, and the window itself."""
    own = F.when(F.size("words") == 1, single_hashes(F.col("words"))).otherwise(F.slice(shingle_hashes(F.col("words")), F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))))
    return windows.select(F.xxhash64("words").alias("window"), "words", "items", F.posexplode(own).alias("offset", "shingle"))


def _joined(places: DataFrame, table: DataFrame, rows: int) -> DataFrame:
    """``places`` (id, hash, at, shingle, ...) whose shingle is in ``table``, with its columns, and those that stand for a document (``at`` 0), with nulls."""
    others = [c for c in table.columns if c != "shingle"]
    if rows <= BROADCAST_ROWS:
        itself = table.sparkSession.range(1).select(*[F.lit(ITSELF).cast("long").alias(c) if c == "shingle" else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
        return places.join(F.broadcast(table.unionByName(itself)), "shingle")
    # a common shingle's places are dealt over several keys; a document's own row has a key of its own, or all of them would meet in one task
    own = F.col("at") == 0
    keyed = places.withColumn("key", F.when(own, F.xxhash64("hash", "id")).otherwise(F.col("shingle"))).withColumn("salt", F.when(own, -1).otherwise(F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")))
    spread = table.withColumnRenamed("shingle", "key").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("met"))
    met = keyed.join(spread, ["key", "salt"], "left").filter(own | F.col("met"))
    return met.select(*places.columns, *others)


def postings(docs: DataFrame, wanted: DataFrame, lone: bool) -> DataFrame:
    """Where the documents have shingles of ``wanted``: the only pass over the texts.

    A row per document (``at`` 0, shingle ITSELF, its number of words) and one
    per place: ``at`` from 1, ``word`` and the word after it. ``lone``: whether
    some item is a single word, for which each word counts as a shingle too;
    those stand at minus their place.
    """
    rows = wanted.count()
    marker = F.array(F.struct(F.lit(0).alias("at"), F.lit(ITSELF).cast("long").alias("shingle")))
    placed = F.transform(shingle_hashes(F.col("w")), lambda h, i: F.struct((i + 1).alias("at"), h.alias("shingle")))
    if lone:
        placed = F.concat(placed, F.transform(single_hashes(F.col("w")), lambda h, i: F.struct((-1 - i).alias("at"), h.alias("shingle"))))
    base = docs.select("id", "hash", normal_words(docs["text"]).alias("w"))
    place = F.abs("at")
    told = ["id", "hash", "at", "shingle", F.when(place > 0, F.get("w", place - 1)).alias("word"), F.when(place > 0, F.get("w", place)).alias("after"), F.when(place == 0, F.size("w").cast("long")).alias("n_words")]
    if rows <= LITERALS:  # a set lookup inside the row instead of a join of all rows
        known = [r[0] for r in wanted.collect()] + [ITSELF]
        return base.select("*", F.inline(F.filter(F.concat(marker, placed), lambda x: x["shingle"].isin(known)))).select(*told)
    each = base.select("*", F.inline(F.concat(marker, placed)))
    if rows <= BROADCAST_ROWS:
        return _joined(each, wanted, rows).select(*told)
    # a place takes its two words along, never those of its whole text
    return _joined(each.select(*told), wanted, rows)


def prefixes(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """For each window, its rarest shingle over all documents and where it stands.

    Rarity is the number of places in the corpus, counted in full; ties go to
    the earlier shingle. A window with a shingle that no document has is
    dropped: it can't occur.
    """
    seen = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    df = F.coalesce("df", F.lit(0))
    rarest = F.min_by(F.struct("offset", "shingle", "words", "items"), F.struct(df, "offset"))
    return cut.join(seen, "shingle", "left").groupBy("window").agg(rarest.alias("p"), F.min(df).alias("least")).filter("least > 0").select("p.*")


def _per_text(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per id and text of ``docs``: ``id``, ``hash`` of the text, ``copies``, ``n_words``, ``hits``."""
    slim = docs.select(docs[row_id].alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))
    cut = stash(_candidates(item_windows(benchmark, width, item_id, item_text)))
    shape = cut.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.size("words") == 1), F.lit(False)).alias("lone")).first()
    placed = stash(postings(slim, cut.select("shingle").distinct(), shape["lone"]))
    table = prefixes(cut, placed)
    if shape["n"] > BROADCAST_ROWS:
        table = stash(table)
    own = F.struct("at", "shingle", "word", "after")
    per = placed.groupBy("id", "hash").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set(own)).alias("p"))
    if shape["n"] > BROADCAST_ROWS:
        per = stash(per)
    each = per.select("*", F.posexplode("p").alias("i", "one")).select("*", F.col("one.at").alias("at"), F.col("one.shingle").alias("shingle"))
    if shape["n"] <= BROADCAST_ROWS:
        met = _joined(each, table, shape["n"])
    else:
        # the places alone are joined; what is near enough is held against the postings of its document, which are shuffled once
        start, need = F.abs("at") - F.col("offset"), F.size("words")
        likely = _joined(each.select("id", "hash", "i", "at", "shingle", "n_words"), table, shape["n"]).filter(F.col("words").isNull() | ((start >= 1) & (start + need - 1 <= F.col("n_words"))))
        own_p = per.select(F.col("id").alias("of"), F.col("hash").alias("by"), "copies", "p")
        met = likely.join(own_p, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("by"))).withColumn("one", F.get("p", F.col("i")))
    itself, need = F.col("words").isNull(), F.size("words")
    start = F.abs("at") - F.col("offset")  # of the window, counted from 1
    bounded = (start >= 1) & (start + need - 1 <= F.col("n_words")) & (F.col("i") >= F.col("offset"))
    run = F.slice("p", F.greatest(F.col("i") - F.col("offset"), F.lit(0)) + 1, F.greatest(need - 1, F.lit(1)))
    side_by_side = (F.size(run) == F.greatest(need - 1, F.lit(1))) & (F.get(run, F.lit(0))["at"] == start) & (F.element_at(run, -1)["at"] == start + need - 2)
    spelled = F.concat(F.transform(run, lambda x: x["word"]), F.array(F.element_at(run, -1)["after"])) == F.col("words")
    alone = F.array(F.col("one.word")) == F.col("words")
    exact = F.when(need == 1, alone).otherwise(F.when((F.col("at") > 0) & side_by_side, spelled).otherwise(False))
    true = met.filter(itself | F.when(~itself & bounded, exact).when(~itself & (need == 1), alone).otherwise(False))
    hit = F.when(~itself, F.struct((start - 1).cast("int").alias("start"), need.alias("len"), "items"))
    return true.groupBy("id", "hash", "copies").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"))


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, **names: str) -> DataFrame:
    """Per row of ``docs``: ``row_id``, ``n_words``, ``hits`` (sorted array of start, len, items).

    A null or empty text has no words and no hits. Repeated rows are alike:
    they are worked on together and come out as often as they went in.
    """
    got = _per_text(docs, benchmark, width, **names)
    return got.select(F.col("id").alias(names.get("row_id", "doc_id")), "n_words", "hits", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).drop("__copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs."""
    bad = _per_text(docs, benchmark, width, row_id=row_id, text=text).filter(F.size("hits") > 0).select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    bad = stash(bad)
    return docs.join(bad, docs[row_id].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["__hash"]), "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, **names: str) -> DataFrame:
    """Per row of ``docs``: ``row_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A word inside any occurrence of a window is hit. Without words a row has 0
    hits and the hash of an empty list. An empty benchmark contaminates
    nothing. Items without an id mark words but are not listed.
    """
    row_id = names.get("row_id", "doc_id")
    per = occurrences(docs, benchmark, width, **names)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    end = lambda h: h["start"] + h["len"]
    covered = F.aggregate("hits", zero, lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), end(h) - F.greatest(acc["end"], h["start"]))).alias("n"), F.greatest(acc["end"], end(h)).alias("end")))["n"]
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return per.select(row_id, "n_words", covered.cast("long").alias("n_hit"), items.alias("items")).select(
        row_id,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
