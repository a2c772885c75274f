import collections

from engrama.llm.quality_ledger import BASE, RULE_BITS, STRICT, ablations, apply_policy, ledger
from engrama.llm.queries import op4_rule_ledger

from .helpers import documents, hostile_texts, repeated_windows, words


def measured(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    inside = {i + k for i in repeated_windows([w], 8)[0] for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_measurements_equal_plain_python(spark):
    texts = [*hostile_texts(), "a b c d e f g h " * 3, "x\n\x0b\ny\nx\n", "**bold** #1 <b>\t|\x0c|"]
    got = ledger(documents(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failure_bits").collect()
    assert len(got) == len(texts) + 3
    for row in got:
        assert tuple(row)[1:6] == measured(texts[row.doc_id]), texts[row.doc_id]
        n, _, _, _, repeated = measured(texts[row.doc_id])
        assert bool(row.failure_bits & BASE.mask) == (n < 20 or 100 * repeated > 30 * n)


def test_policies_and_ablations_agree_with_the_ledger(spark):
    rows = ledger(documents(spark, hostile_texts()))
    bits = [r[0] for r in rows.select("failure_bits").collect()]
    assert apply_policy(rows, STRICT).count() == sum(not b & STRICT.mask for b in bits)
    for r in ablations(rows, [BASE, STRICT]).collect():
        mask, bit = (BASE if r.policy == "base" else STRICT).mask, 1 << RULE_BITS[r.rule]
        count = collections.Counter()
        for b in bits:
            count["kept"] += not b & mask
            count["failing"] += bool(b & bit)
            count["alone"] += b & mask == bit
            count["without"] += not b & mask & ~bit
        assert (r.documents, r.kept, r.failing, r.failing_alone, r.kept_without) == (len(bits), count["kept"], count["failing"], count["alone"], count["without"])


def test_empty_table(spark):
    rows = ledger(documents(spark, []))
    assert rows.count() == 0 and ablations(rows, [BASE]).count() == 0


def test_labels_are_met(spark):
    folder = "/root/testdata/sf0.01"
    got = op4_rule_ledger(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("not base_failed")
    assert got.filter("kept and quality = 0").count() == 0
    assert got.filter("not kept and quality = 1").count() == 0


def test_any_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 1, 2, 3, 4, 5.0)], "doc_id long, text string, __w long, counted long, `Lined` long, N_WORDS long, `a.b` double")
    got = ledger(rows)
    assert got.columns[:6] == ["doc_id", "text", "__w", "counted", "Lined", "a.b"]
    assert tuple(got.select("__w", "counted", "Lined", "n_words").first()) == (1, 2, 3, 2)
