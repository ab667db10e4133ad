"""Spelling variants against a plain search through all one-step changes."""

import collections
import random
import re
import zlib

import pyarrow as pa

from heatfield.llm import spelling as S

SF = "/root/testdata/sf0.001"
ALPHABET = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]


def counts(rows):
    c = collections.Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def changes(w):
    for i in range(len(w) + 1):
        for a in ALPHABET:
            yield w[:i] + a + w[i:]
            if i < len(w):
                yield w[:i] + a + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


def brute(rows):
    c, form, out = counts(rows), {}, []
    near = {w: {v for v in changes(w) if v in c and v != w} for w in c}
    for w in c:
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        form[w] = best if best and c[best] >= 2 * c[w] else None
    for w in c:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c[w], len(near[w]), c[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows):
    got = S.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in S.QUERIES["op11_spelling"](spark, SF).collect())
    assert got == brute(rows) and any(r[1] for r in got) and any(r[1] != r[2] and r[1] for r in got)


def test_dense_words_ties_and_chains(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abÀ") for _ in range(r.choice([5, 6]))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(120)]
    rows += [(1000 + i, "colours " * 3 + "colour " * 6 + "color " * 12 + "colör " * 12 + "Colour-COLOUR") for i in range(2)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (5, None), (6, ""), (7, "÷×÷×÷ ab1cd x" * 3)]
    assert run(spark, rows) == brute(rows)


def test_long_words(spark):
    r = random.Random(5)
    base = "".join(r.choice("abc") for _ in range(64))
    long = "".join(r.choice("ab") for _ in range(5000))
    lines = [base] * 9 + [base[:10] + base[11:]] * 4 + [base + "x"] * 3 + [base[:-1] + "z"] * 3 + [base + "xy"] * 3 + [base + "xz"] * 7
    lines += [long] * 8 + [long[:77] + "q" + long[78:]] * 3 + [long + "q"] * 3 + ["a" * 300] * 6 + ["a" * 299] * 3 + ["a" * 301] * 3
    rows = [(i, t) for i, t in enumerate(lines)]
    c = counts(rows)
    near = {w: {v for v in c if abs(len(v) - len(w)) < 2 and v != w and _one(w, v)} for w in c}
    got = {x[0]: x for x in run(spark, rows)}
    assert set(got) == set(c) and {w: got[w][4] for w in c} == {w: len(v) for w, v in near.items()}
    for w in c:
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        assert got[w][1] == (best if best and c[best] >= 2 * c[w] else None)


def _one(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def test_collisions_join_nothing():  # keys that are all alike: only the strings decide
    words = ["abcde", "abcdf", "abcd", "zzzzz", "zzyzz", "abXde"]
    table = [(0, i, w, 5) for w in words for i in range(-1, len(w))]
    out = S._runs(pa.table(dict(zip(("key", "at", "word", "n"), map(list, zip(*table, strict=True)), strict=True)), schema=pa.schema([("key", pa.int64()), ("at", pa.int32()), ("word", pa.string()), ("n", pa.int64())]))).to_pylist()
    near = collections.Counter()
    for r in out:
        near[r["word"]] += r["near"]
    assert near == {w: sum(_one(w, v) for v in words if v != w and abs(len(v) - len(w)) < 2) for w in words}


def test_empty_and_other_columns(spark):
    assert run(spark, []) == [] == run(spark, [(1, None), (2, "a b c")])
    df = spark.createDataFrame([(1, "spell spell spell", 2, "x")], "doc_id long, text string, n int, word string")
    assert [tuple(r) for r in S.variants(df).collect()] == [("spell", None, "spell", 3, 0, None)]
