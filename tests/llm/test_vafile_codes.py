import hashlib
import math
import random

import numpy as np

from engrama.llm.vafile_codes import Entries, compress, integers


def naive(rows):
    """rows: (vec_id, components, label); every entry, every round."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in held.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = {}, {}
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(4)]
        out[i] = ["".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label]
        by_label[label] = by_label.get(label, 0) + out[i][1]
    return {i: (code, error, by_label[label], digest) for i, (code, error, label) in out.items()}


KIND = "vec_id long, embedding array<float>, label int, components string, code string, id long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "d", 1) for i, v, label in rows], KIND)


def test_equals_every_entry(spark):
    rng = random.Random(4)
    near = [[rng.gauss(0, 0.3) for _ in range(16)] for _ in range(20)]
    rows = []
    for i in range(400):
        v = [float(np.float32(x + rng.gauss(0, 0.02))) for x in rng.choice(near)] if i % 3 else [rng.choice([-0.5, 0.0, 0.25]) for _ in range(16)]
        rows.append((1000 - i, v, rng.choice([None, 0, 1, 2])))
    rows += [(2000, None, 1), (1, [None] + [0.0] * 15, 1), (2, [float("nan")] + [0.0] * 15, 1), (3, [float("inf")] + [0.0] * 15, 1), (4, [-float("inf")] + [0.0] * 15, 1)]
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in compress(table(spark, rows)).collect()}
    assert got == naive(rows)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(1)
    for width, n in ((16, 256), (3, 7), (1, 1), (5, 256)):
        entries = rng.integers(-300, 300, (n, width))
        entries[n // 2] = entries[0]
        x = np.concatenate([rng.integers(-400, 400, (500, width)), entries])
        apart = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        at, distance, taken = Entries(entries).nearest(x)
        assert (at == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
        assert taken < len(x) * n / 2 or n < 10


def test_defined_cases(spark):
    assert compress(table(spark, [])).count() == 0
    assert compress(table(spark, [(1, None, 1)])).count() == 0
    same = [0.5] * 8
    got = compress(table(spark, [(1, same, 1), (1, same, 1), (None, same, None), (7, [0.5] * 4, 2), (8, [], 2)])).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == [(0, "00000000", 0, 0), (1, "00000000", 0, 0), (1, "00000000", 0, 0)]
    odd = compress(table(spark, [(1, [0.1, 0.2, 0.3], 1), (2, [9e9, -9e9, 1.0], 1)])).collect()
    assert sorted(r.code for r in odd) == ["00000000", "01010100"]
    assert [r.code for r in compress(table(spark, [(1, [], 1)])).collect()] == ["00000000"]
    wide = integers(table(spark, [(1, [9e9, -9e9, 1.0, -0.0001], 1)])).first()
    assert wide.components == [1 << 22, -(1 << 22), 1024, -1]
