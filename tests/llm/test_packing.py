import random

from engrama.llm.packing import pack, pack_group

from .helpers import documents, hostile_texts, words


def naive(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (c is None or c not in b["clusters"]) and (s is None or b["sources"].count(s) < per_source)]
        if not fits:
            bins.append({"left": capacity, "clusters": [], "sources": []})
        i = min(fits)[1] if fits else len(bins) - 1
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["clusters"].append(c)
        bins[i]["sources"].append(s)
    return out


def test_equals_exhaustive_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(0, 60)
        sizes = [rng.randint(0, 20) for _ in range(n)]
        sources = [rng.choice([None, "a", "a", "a", "b"]) for _ in range(n)]
        clusters = [rng.choice([None, *range(5)]) for _ in range(n)]
        limit = rng.randint(1, 3)
        assert pack_group(sizes, sources, clusters, 20, limit) == naive(sizes, sources, clusters, 20, limit)


def test_bins_hold_their_promises(spark):
    texts = hostile_texts()
    docs = documents(spark, texts)
    got = pack(docs, capacity=100).collect()
    total, bins = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin, []).append(r)
    copies = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert total == {i: n * len(words(texts[i])) for i, n in copies.items()}
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert at <= 100
        own = [texts[r.doc_id] for r in held if texts[r.doc_id]]
        assert len(set(own)) == len(own)


def placed(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_every_group_equals_exhaustive_best_fit(spark):
    texts = hostile_texts(n=60)
    docs = documents(spark, texts)
    got = pack(docs, capacity=100, group_rows=16)
    assert placed(got) == placed(pack(docs.repartition(7), capacity=100, group_rows=16))
    source = {r.doc_id: r.source for r in docs.collect()}
    groups = {}
    for r in got.collect():
        if not r.bin.startswith("whole"):
            groups.setdefault(r.bin.split("-")[0], []).append(r)
    assert len(groups) > 2
    cluster = {r.doc_id: r.c for r in docs.selectExpr("doc_id", "if(length(text) > 0, hex(xxhash64(text)), null) c").collect()}
    for name, rows in groups.items():
        rows.sort(key=lambda r: (-r.length, str(r.doc_id), cluster[r.doc_id] or "", source[r.doc_id] or ""))
        expected = naive([r.length for r in rows], [source[r.doc_id] for r in rows], [cluster[r.doc_id] for r in rows], 100, 2)
        # of repeated rows either may be the first
        assert sorted((r.doc_id, r.bin, r.offset) for r in rows) == sorted((r.doc_id, f"{name}-{b}", at) for r, (b, at) in zip(rows, expected))


def test_clusters_of_a_column_conflict(spark):
    docs = spark.createDataFrame([(i, f"text {i}", None, i // 4) for i in range(40)], "doc_id long, text string, source string, class_id long")
    bins = {}
    for r in pack(docs, capacity=100, cluster="class_id").collect():
        bins.setdefault(r.bin, []).append(r.doc_id // 4)
    assert len(bins) == 4 and all(len(set(held)) == len(held) for held in bins.values())


def test_empty(spark):
    assert pack(documents(spark, [])).count() == 0
