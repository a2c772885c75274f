import random

import engrama.llm.chat_trie as c

from .helpers import sha


def test_escape_and_parse_round_trip():
    rng = random.Random(4)
    pieces = ["<", ">", "/", "s", "[", "]", "INST", "\\", "SYS", "|", "role", "text", "none", " ", "\n", *c.CONTROL]
    for _ in range(1500):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 10)))
        assert c.unescape(c.escape(text)) == text and not any(x in c.escape(text) for x in c.CONTROL)
        turns = [(rng.choice(["user", "assistant", "system", None, "", "tool", text]), rng.choice([text, text[::-1], ""])) for _ in range(4)]
        assert c.parse("".join(c.format_turn(*t)[0] for t in turns)) == turns


def conversations():
    rng = random.Random(6)
    rows = []
    for conv in range(80):
        turns = [("system", "shared start")] if conv % 3 else []
        turns += [("user", f"question {rng.randint(0, 2)}"), ("assistant", f"answer </s> {rng.randint(0, 2)}\\"), ("user", rng.choice([None, "", "more"])), (None, "odd")][: rng.randint(1, 4)]
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]
    rows += [(500 + i, t, "user" if t % 2 == 0 else "assistant", f"same {t}") for i in range(40) for t in range(3)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [(r if has else None, t) for _, _, has, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r or ''}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(c.format_turn(r, t)[0]) for r, t in turns))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_read_back_equals_the_conversations(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", "y", b"z") for r in rows], SCHEMA + ", part string, path string, node binary")
    got = {r.conv_id: tuple(r)[1:] for r in c.digests(*c.pack(table)).collect()}
    assert got == expected(rows)
    # conversations may have names
    named = spark.createDataFrame([(None if r[0] is None else f"n{r[0]}", *r[1:]) for r in rows], SCHEMA.replace("conv_id long", "conv_id string"))
    assert {r.conv_id: tuple(r)[1:] for r in c.digests(*c.pack(named)).collect()} == {None if k is None else f"n{k}": v for k, v in expected(rows).items()}


def test_the_forest_equals_a_trie_built_by_hand(spark):
    rows = conversations()
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    paths = {tuple(c.format_turn(r if has else None, t)[0] for _, _, has, r, t in sorted(turns)[:k]) for turns in convs.values() for k in range(1, len(turns) + 1)}
    forest, leaves = c.pack(spark.createDataFrame(rows, SCHEMA))
    nodes = sorted(forest.collect(), key=lambda n: n.start)
    packed = "".join(n.text for n in nodes)
    assert [n.start for n in nodes] == [sum(len(m.text) for m in nodes[:i]) for i in range(len(nodes))]
    seen, open_nodes, cut, turns = set(), [], {}, 0
    for n in nodes:
        assert n.end == n.start + len(n.text)
        assert n.position == sum(x.end - x.start for x in n.attends)
        above = [cut[x.start] for x in n.attends]
        cut[n.start] = [packed[a:b] for a, b in zip(n.turns, [*n.turns[1:], n.end])]
        turns += len(n.turns)
        for k in range(1, len(n.turns) + 1):
            seen.add((*(t for x in above for t in x), *cut[n.start][:k]))
        for x in n.losses:
            assert any(a < x.start <= x.end < b for a, b in zip(n.turns, [*n.turns[1:], n.end]))
        # depth first: what a node attends to are the nodes still open
        while open_nodes and open_nodes[-1] not in [(x.start, x.end) for x in n.attends]:
            open_nodes.pop()
        assert open_nodes == [(x.start, x.end) for x in n.attends]
        open_nodes.append((n.start, n.end))
    assert turns == len(seen) and seen == paths  # every shared turn once
    assert leaves.count() == len(convs)


def test_a_hot_turn_is_emitted_once_whatever_follows(spark):
    hot = "one system prompt for all " * 20
    for sharers in (2500, 5000):
        rows = [(i, t, *turn) for i in range(sharers) for t, turn in enumerate([("system", hot), ("user", f"question {i % (sharers - 100)}"), ("assistant", "the same")])]
        forest, leaves = c.pack(spark.createDataFrame(rows, SCHEMA))
        texts = [n.text for n in forest.select("text").collect()]
        assert sum(hot in t for t in texts) == 1
        assert sum("question" in t for t in texts) == sum("the same" in t for t in texts) == sharers - 100
        assert leaves.count() == sharers


def test_a_long_conversation_is_few_nodes(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 900 - 300 * i else f"turn {t} of {i}") for i in range(3) for t in range(1000)]
    forest, leaves = c.pack(spark.createDataFrame(rows, SCHEMA))
    nodes = forest.collect()
    assert sorted(len(n.turns) for n in nodes) == [300, 300, 400, 400, 700] and max(len(n.attends) for n in nodes) == 2
    assert {r.conv_id: tuple(r)[1:] for r in c.digests(forest, leaves).collect()} == expected(rows)


def test_empty(spark):
    forest, leaves = c.pack(spark.createDataFrame([], SCHEMA))
    assert forest.count() == leaves.count() == c.digests(forest, leaves).count() == 0
