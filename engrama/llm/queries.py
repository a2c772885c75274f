"""Registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    from engrama.llm.surrogates import pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that speaks in control strings, read back from the packed forest."""
    from engrama.llm.chat_trie import digests, pack

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return digests(*pack(rows.unionByName(hostile)))


def op3_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into bins of 2048 words."""
    from engrama.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the verdict of the strict policy."""
    from engrama.llm.quality_ledger import BASE, STRICT, ledger, passes

    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(STRICT).alias("kept"), "failure_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule contributes to each policy, from the ledger of every document."""
    from engrama.llm.quality_ledger import ablations, ledger

    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    from engrama.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in 400-byte strings that occur elsewhere."""
    from engrama.llm.bwt_merge import drop_repeated_bytes

    return drop_repeated_bytes(table(spark, sf_dir, "documents"))


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in 35-word windows that occur elsewhere."""
    from engrama.llm.automata import drop_repeated_words

    return drop_repeated_words(table(spark, sf_dir, "documents"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document dealt into eight shards."""
    from engrama.llm.feistel_sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8)


def op9_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from engrama.llm.secret_battery import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from engrama.llm.probminhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op11_vafile_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every embedding, by codebooks trained on all of them."""
    from engrama.llm.vafile_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """Digests of the periodic runs of ``docs``, a tenth of which are looped."""
    from engrama.llm.periodic_runs import collapse, looped

    rows = collapse(docs.select("doc_id", looped(docs["doc_id"], docs["text"]).alias("text")))
    by_length = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = rows.withColumn("best", by_length)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("(1000 * best.length) div -best.short").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and its text without their repetitions."""
    return runs_digest(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of similar shingle sets."""
    from engrama.llm.ngram_join import join_classes

    return join_classes(table(spark, sf_dir, "documents"))


#: A fixed key for reproducible queries; a deployment passes its own.
SURROGATE_KEY = b"engrama demonstration key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_surrogates, op2_prefix_forest, op3_conflict_packing, op4_rule_ledger, rule_ablations, op5_prefix_join, op6_bwt_merge, op7_suffix_automata, op8_feistel_shards, op9_secret_battery, op10_probminhash, op11_vafile_codes, op12_periodic_runs, op13_ngram_join)
}
