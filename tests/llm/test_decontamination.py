import engrama.llm.decontamination as d

from .helpers import documents, hostile_texts, normal, sha


def brute(texts, items, width):
    windows = {}
    for item, text in items:
        w = normal(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = {}
    for i, text in enumerate(texts):
        w, hit, found = normal(text), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def items_from(texts):
    long = next(t for t in texts if t and len(t) > 20000).split(" ")
    return [(1, " ".join(long[100:112])), (2, " ".join(long[3000:3030]).upper()), (10, " ".join(long[3005:3017])), (3, "two words"), (4, "one"), (5, None), (6, ""), (7, "la la la la la la la la la la la"), (8, "absent entirely"), (9, "--")]


def check(spark, texts, items, width):
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = d.decontaminate(docs, bench, width).collect()
    expected = brute(texts, items, width)
    assert len(got) == docs.count()
    for row in got:
        assert tuple(row)[1:] == expected[row.doc_id], (row, expected[row.doc_id])
    kept = [r.doc_id for r in d.without_contaminated(docs, bench, width).select("doc_id").collect()]
    assert sorted(kept) == sorted(r.doc_id for r in docs.select("doc_id").collect() if not expected[r.doc_id][4])


def test_equals_brute_force(spark):
    texts = hostile_texts()
    check(spark, texts, items_from(texts), 10)
    check(spark, texts, items_from(texts)[:3], 3)


def test_blocks_and_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", 12)
    monkeypatch.setattr(d, "LITERALS", 0)
    texts = hostile_texts(n=15)
    check(spark, texts, items_from(texts), 10)


def test_empty_tables(spark):
    docs, bench = documents(spark, ["a b c"]), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:] for r in d.decontaminate(docs, bench).collect()] == [(3, 0, 0, sha(""), False)] * 4
    assert d.decontaminate(documents(spark, []), bench).count() == 0


def test_a_large_benchmark_shuffles_words_in_proportion(spark, monkeypatch, capsys):
    """No exchange holds a document's words or postings once per place, with nothing broadcast."""
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(d, "LITERALS", 0)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [*hostile_texts(n=10), " ".join(f"w{i % 5000}" for i in range(20_000)), "w1 w2 " * 5000]
        items = [*items_from(texts), (20, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1"), (21, " ".join(f"w{i}" for i in range(700, 715)))]
        check(spark, texts, items, 10)
        slim = documents(spark, texts).selectExpr("doc_id as id", "text", "xxhash64(text) as hash")
        wanted = spark.createDataFrame([(1,), (2,)], "shingle long")
        d.postings(slim, wanted, True).explain("formatted")
        shuffled = [line for part in capsys.readouterr().out.split("\n(")[1:] if part.split(")")[1].strip().startswith("Exchange") for line in part.split("\n") if line.startswith("Input")]
        assert shuffled and not any("w#" in line.replace("word#", "") or " p#" in line for line in shuffled)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
