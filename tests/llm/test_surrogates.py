import re

import engrama.llm.surrogates as s

from .helpers import documents, hostile_texts

KEY = b"test"
PERSONAL = [
    "write to ann.lee+7@mail3.acme.org or call +1 (579) 555-6331, host 78.241.210.149.",
    "again ann.lee+7@mail3.acme.org; card 4111111111111111 and 4111 1111 1111 1111, id 123-45-6789",
    "Mr John Smith met Mrs. Anna Smith and Frau Müller; Господин Иванов came. DE89 3704 0044 0532 0130 00",
    "Version 2.0. of 2024-01-15 costs 1,000.50 and 3.5 percent; the mail@ sign",
]


def test_shape_and_coreference():
    made = lambda kind, x, n=0: s.surrogate(KEY, kind, x, n)
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}\+\d@[a-z]{4}\d\.[a-z]{4}\.org", made("email", "ann.lee+7@mail3.acme.org"))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", made("phone", "+1 (579) 555-6331"))
    card = made("account", "4111111111111111")
    assert card[0] == "4" and s.luhn([int(c) for c in card[:-1]]) == int(card[-1])
    assert s._valid_iban(made("iban", "DE89 3704 0044 0532 0130 00").replace(" ", ""))
    assert made("given_f", "Anna") in s.GIVEN["latin", "f"].split() and made("given_m", "Иван") in s.GIVEN["cyrillic", "m"].split()
    assert all(0 <= int(x) < 256 for x in made("ipv4", "78.241.210.149").split("."))
    texts = [s.replaced(KEY, t, {})[0] for t in PERSONAL]
    assert s.surrogate(KEY, "email", "ann.lee+7@mail3.acme.org", 0) in texts[0] and s.surrogate(KEY, "email", "ann.lee+7@mail3.acme.org", 0) in texts[1]
    assert texts[3] == PERSONAL[3]
    assert made("family", "Smith") != s.surrogate(b"other", "family", "Smith", 0)


def test_numbers_side_by_side():
    text = "a +1 (836) 555-9331 4913187196670932 53.121.55.90 44.144.126.223 +1 (906) 555-7738 b"
    assert [(text[a:b], k) for a, b, k in s.entities(text)] == [("+1 (836) 555-9331", "phone"), ("4913187196670932", "account"), ("53.121.55.90", "ipv4"), ("44.144.126.223", "ipv4"), ("+1 (906) 555-7738", "phone")]
    assert s.entities("built 2024-01-15 in 1.2.3 at 12:30, 1,000 of 10 000 000") == []


def test_permutation_is_one_to_one():
    for radix, n in ((10, 1), (10, 2), (10, 3), (3, 5)):
        values = {tuple(s.permuted(KEY, [i // radix**k % radix for k in range(n)], radix, "0")) for i in range(radix**n)}
        assert len(values) == radix**n


def check(spark, texts):
    docs = documents(spark, texts)
    got = s.pseudonymize(docs, KEY).collect()
    assert len(got) == docs.count() and set(got[0].asDict()) == {*docs.columns, "n_entities"}
    for r in got:
        found = s.entities(texts[r.doc_id])
        assert r.n_entities == len(found) and r.n_words == 7
        if not found:
            assert r.text == texts[r.doc_id]
        for a, b, _ in found:
            assert len(texts[r.doc_id][a:b]) < 5 or texts[r.doc_id][a:b] not in r.text
    return {r.doc_id: r.text for r in got}


def test_documents(spark):
    check(spark, [*hostile_texts(n=10), *PERSONAL])


def test_collisions_are_resolved_and_both_ways_agree(spark, monkeypatch):
    names = ["".join(x) for x in zip("ABCDEFGHIJKLMNOPQRST", "aeiouaeiouaeiouaeiou", "bcdfgbcdfgbcdfgbcdfg")]
    texts = [f"Mrs {n} {n}son met 10.0.0.{i}" for i, n in enumerate(names * 3)]
    docs = documents(spark, texts)
    attempts = {(r.kind, r.entity): r.attempt for r in s.exceptions(docs, KEY).collect()}
    known = {(k, t[a:b]) for t in texts for a, b, k in s.entities(t)}
    made = {(k, e): s.surrogate(KEY, k, e, attempts.get((k, e), 0)) for k, e in known}
    for kind in ("given_f", "family", "ipv4"):
        own = [v for (k, _), v in made.items() if k == kind]
        assert len(set(own)) == len(own) and not set(own) & {e for k, e in known if k == kind}
    first = check(spark, texts)
    monkeypatch.setattr(s, "EXCEPTIONS", -1)
    assert check(spark, texts) == first


def test_addresses_without_a_free_surrogate_of_their_form(spark):
    users = [*"abcdefghijklmnopqrstuvwxyz", "иван", "漢字", "²", "_"]
    texts = [f"to {u}@example.com" for u in users]
    docs = documents(spark, texts, repeat=False)
    # each attempt of an address differs, or the search for a free one has no end
    for u in users:
        assert len({s.surrogate(KEY, "email", f"{u}@example.com", n) for n in range(2, 12)}) == 10
        assert s.surrogate(KEY, "email", f"{u}@example.com", 3) != f"{u}@example.com"
    got = [r.text for r in s.pseudonymize(docs, KEY).collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)


def test_further_mentions_and_one_surrogate_a_name(spark, monkeypatch):
    texts = [
        "Mr John Smith came. Smith said that John Smith's dog left; Smith-Jones and Smithers stay, johnny too.",
        "Dr John Smith wrote. Mr. John Brown read, Mrs Smith's friend.",
        "Yes, Sir. The end of the day. The other one.",
    ]
    docs = documents(spark, texts, repeat=False)
    for most in (s.EXCEPTIONS, -1):
        monkeypatch.setattr(s, "EXCEPTIONS", most)
        got = {r.doc_id: r.text for r in s.pseudonymize(docs, KEY).collect()}
        first = re.fullmatch(r"Mr ([\w-]+) (\w+) came. (\w+) said that ([\w-]+) (\w+)'s dog left; (\w+)-Jones and Smithers stay, johnny too.", got[0])
        john, smith = first[1], first[2]
        assert (john, smith, smith, john, smith, smith) == (*first.groups(),) and "John" != john != "Smith" != smith
        assert john.split("-")[0] in s.GIVEN["latin", "m"].split()
        assert re.fullmatch(rf"Dr {john} {smith} wrote. Mr. {john} \w+ read, Mrs {smith}'s friend.", got[1])
        assert got[2].endswith(" end of the day. The other one.")


def test_mentions_in_compounds():
    text = "Mr Luke O'Brien, Frau Anna-Maria Voss. O'Brien's, Anna-Maria's, Voss-O'Brien, l'Voss and Voss' or Voss’s"
    assert [text[a:b] for a, b, _ in s.entities(text)] == ["Luke", "O'Brien", "Anna-Maria", "Voss", "O'Brien", "Anna-Maria", "Voss", "O'Brien", "Voss", "Voss", "Voss"]


def test_capitals_are_the_same_name():
    text = "Mr JOHN SMITH and Mrs Smith; SMITH's dog, John, O'BRIEN"
    out, n = s.replaced(KEY, text, {})
    m = re.fullmatch(r"Mr (\w+) (\w+) and Mrs (\w+); (\w+)'s dog, (\w+), O'BRIEN", out)
    john, smith = m[5], m[3]
    assert n == 5 and (m[1], m[2], m[4]) == (john.upper(), smith.upper(), smith.upper()) and john != john.upper()


def test_ip_addresses():
    text = "at 2001:db8::8a2e:370:7334, FE80:0:0:0:202:B3FF:FE1E:8329 not 12:30:45, a::b, std::x, 1:2:3 or ::"
    assert [(text[a:b], k) for a, b, k in s.entities(text)] == [("2001:db8::8a2e:370:7334", "ipv6"), ("FE80:0:0:0:202:B3FF:FE1E:8329", "ipv6")]
    made = s.surrogate(KEY, "ipv6", "2001:db8::8a2e:370:7334", 0)
    assert s._valid_ipv6(made) and [len(x) for x in made.split(":")] == [4, 3, 0, 4, 3, 4]


def test_a_full_space_comes_to_an_end(spark, monkeypatch):
    monkeypatch.setattr(s, "PATIENCE", 3)
    # numbers of which all others of their shape are in the corpus: no surrogate is free
    monkeypatch.setattr(s, "_alone", lambda *_: True)
    monkeypatch.setattr(s, "PHONE", re.compile(r"\+\d{1,3} \d{2}(?!\d)"))
    monkeypatch.setattr(s, "NUMBER", re.compile(r"\+\d{1,3} \d{2}"))
    texts = [f"call +49 {i:02d} now" for i in range(100)]
    found = spark.createDataFrame([("phone", f"+49 {i:02d}", "phone") for i in range(100)], "kind string, entity string, resolved string")
    attempts = {r.entity: r.attempt for r in s.exceptions(documents(spark, texts), KEY, found=found).collect()}
    made = [s.surrogate(KEY, "phone", f"+49 {i:02d}", attempts.get(f"+49 {i:02d}", 0)) for i in range(100)]
    assert len(set(made)) == 100


def test_whole_table_by_brute_force(spark):
    """Every entity of a small table, over all its texts: one surrogate each, no two alike, none real, nothing else touched."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (docs, s.pseudonymize(docs, KEY)))
    made = {}
    for i, text in before.items():
        at, rest = 0, after[i]
        for a, b, kind in s.entities(text):
            assert rest.startswith(text[at:a])
            rest = rest[a - at :]
            following = next((x for x, _, _ in s.entities(text) if x >= b), len(text))
            end = rest.index(text[b:following]) if following > b else None
            kind = "given" if kind.startswith("given") else kind
            made.setdefault((kind, s.entity_of(kind, text[a:b])), set()).add(s.entity_of(kind, rest[:end]))
            rest, at = rest[end:], b
        assert rest == text[at:]
    assert len(made) > 50 and all(len(x) == 1 for x in made.values())
    for kind in {k for k, _ in made}:
        real, new = {e for k, e in made if k == kind}, [next(iter(x)) for (k, _), x in made.items() if k == kind]
        assert len(set(new)) == len(new) and not real & set(new)


def test_extra_columns_of_any_name(spark, monkeypatch):
    table = spark.createDataFrame([(1, "Mr John Smith at 78.241.210.149", *"abcdefgh"), (2, None, *"abcdefgh")], "doc_id long, text string, h string, __h string, __out string, made string, digest string, own string, kind string, `a.b` string")
    for most in (s.EXCEPTIONS, -1):
        monkeypatch.setattr(s, "EXCEPTIONS", most)
        got = s.pseudonymize(table, KEY)
        assert got.columns == [*table.columns, "n_entities"]
        rows = {r.doc_id: r for r in got.collect()}
        assert tuple(rows[1])[2:] == (*"abcdefgh", 3) and tuple(rows[2])[1:] == (None, *"abcdefgh", 0) and "Smith" not in rows[1].text


def test_empty(spark):
    assert s.pseudonymize(documents(spark, []), KEY).count() == 0
