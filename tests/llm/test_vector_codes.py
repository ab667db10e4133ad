"""Vector codes against a scalar version with Python's integers."""

import hashlib
import math

import pytest

from heatfield.llm import vector_codes as V


def brute(rows, rounds=6, parts=8, entries=16):
    """rows of (vec_id, vector, label), all of one length."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2**40 else int(x) * 4096 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]

    def assign(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return min(range(len(book)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                part = cut(v)[p]
                held[assign(part, books[p])[0]].append(part)
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(held, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        got = [assign(part, b) for part, b in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{c:02x}" for c, _ in got), sum(f for _, f in got), lab))
    sums = {}
    for _, _, e, lab in out:
        sums[lab] = sums.get(lab, 0) + e
    fit = lambda x: x if x < 2**63 else None
    return sorted((i, c, fit(e), fit(sums[lab]), sha) for i, c, e, lab in out)


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return sorted((tuple(r) for r in V.compress(df, **more).collect()), key=lambda r: (r[0] is None, *map(str, r)))


def made(n, dim, seed=1):
    import random

    r = random.Random(seed)
    f32 = lambda x: round(x * 1024) / 1024
    return [(i, [f32(r.gauss(0, 1)) for _ in range(dim)], r.choice([0, 1, 2, None])) for i in range(n)]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in V.QUERIES["op13_vector_codes"](spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)


@pytest.mark.parametrize("n,dim", [(120, 16), (5, 8), (40, 24)])
def test_small(spark, n, dim):
    rows = made(n, dim)
    rows += [(n + 1, None, 1), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, None), (-7, [float("inf"), *[0.0] * (dim - 1)], 2)]
    rows += [rows[2]] * 3 + [(3, rows[0][1], 5)]
    assert sorted(run(spark, rows)) == brute(rows)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [0.5] * 8, 1) for i in range(300)] + [(i, [0.25 if i % 2 else -0.25] * 8, None) for i in range(300, 330)]
    assert sorted(run(spark, rows)) == brute(rows)


def test_large_components_are_exact(spark):
    rows = made(30, 8) + [(100, [1e9, -1e9, 0.0, 0.0, 1e12, 3.5, 0.0, 0.0], 1), (101, [1e300] * 8, 3)]
    assert sorted(run(spark, rows, "double"), key=lambda r: r[0]) == brute(rows)


def test_lengths_null_ids_and_empty(spark):
    rows = made(40, 16)
    out = run(spark, [*rows, (50, [1.0] * 5, 1), (51, [], 0)])
    assert len(out) == 42 and {r[0] for r in out if r[1] is None} == {50, 51} and all(r[2] is None for r in out if r[0] in (50, 51))
    out = run(spark, [(None, v, lab) for _, v, lab in rows[:3]] + rows[3:])
    assert len(out) == 40 and sum(r[0] is None and r[1] is not None for r in out) == 3
    out = run(spark, [(i, [float(i)] * 11, 0) for i in range(20)])
    assert len(out) == 20 and all(len(r[1]) == 16 for r in out)
    assert run(spark, []) == [] == run(spark, [(1, None, 1)])
    extra = spark.createDataFrame([(1, [1.0] * 8, 1, "x", 2)], "vec_id long, embedding array<float>, label int, code string, n int")
    assert V.compress(extra).count() == 1
