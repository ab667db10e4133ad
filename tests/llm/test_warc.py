"""Archives written and read back, against a plain account of the pages."""

import base64
import gzip
import hashlib
import os
import zlib

import pytest

from heatfield.llm import warc as W
from heatfield.llm.common import scratch

SF = "/root/testdata/sf0.001"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def account(pages, least=0):
    """pages(page_id, url, html) with distinct numbers."""
    data = {i: (h or "").encode() for i, _, h in pages}
    first = {}
    for i in sorted(data):
        first.setdefault(data[i], i)
    out = []
    for i, d in data.items():
        again = len(d) >= least and first[d] != i
        out.append((i, len(d), b32(d), "revisit" if again else "response", first[d] if again else None))
    return sorted(out)


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.repartition(3)


def back(spark, folder):
    return sorted((tuple(r) for r in W.read_archive(spark, folder).collect()), key=repr)


def files(folder):
    root = folder.removeprefix("file://")
    return {n: open(f"{root}/{n}", "rb").read() for n in sorted(os.listdir(root)) if n.endswith(".gz")}


def made(n=60):
    rows = [(i * 3 % 61, f"https://h{i % 4}.example/{i}?a=b c\n", f"<p>text {i % 7} é</p>" * (i % 7)) for i in range(n)]
    return [*rows, (1000, None, None), (1001, "", ""), (-5, "x", "<p>text 3 é</p>" * 3)]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(tuple(r) for r in W.QUERIES["op12_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == account(rows)


@pytest.mark.parametrize("least", [0, 30])
def test_revisits_rolls_and_determinism(spark, least):
    one, two = scratch(spark, "a"), scratch(spark, "b")
    W.write_archive(table(spark, made()), one, least, roll=3000, shard=4000)
    W.write_archive(table(spark, made()[::-1]).coalesce(1), two, least, roll=3000, shard=4000)
    assert back(spark, one) == sorted(account(made(), least), key=repr)
    a, b = files(one), files(two)
    assert a == b and len(a) > 3 and len({n[:11] for n in a}) > 1 and any("-0001" in n for n in a)
    assert all(len(x) <= 3000 for x in a.values())
    listed = {r.file: r for r in W.manifest(spark, one).collect()}
    assert set(listed) == set(a) and all(listed[n].sha256 == hashlib.sha256(x).hexdigest() and listed[n].bytes == len(x) for n, x in a.items())
    order = [r for n in a for r in map(W.parsed, W.members(open(f"{one.removeprefix('file://')}/{n}", "rb"))) if r[0]["warc-type"] != "warcinfo"]
    pages = [W.page_of(*r)[0] for r in order]
    assert pages == sorted(pages) and len({r[0]["warc-record-id"] for r in order}) == len(pages)
    assert all(gzip.decompress(x).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for x in a.values())


def test_repeated_rows_null_ids_and_urls(spark):
    rows = [(1, "u", "x")] * 5 + [(1, "t", "x"), (2, "u", "x"), (None, "u", "x"), (None, None, "y"), (None, None, "y"), (3, "u", "z")]
    folder = scratch(spark, "a")
    W.write_archive(table(spark, rows), folder)
    got = back(spark, folder)
    x, y, z = b32(b"x"), b32(b"y"), b32(b"z")
    assert got == sorted([(1, 1, x, "response", None)] + [(1, 1, x, "revisit", 1)] * 5 + [(2, 1, x, "revisit", 1), (None, 1, x, "revisit", 1), (None, 1, y, "response", None), (None, 1, y, "revisit", None), (3, 1, z, "response", None)], key=repr)
    W.write_archive(table(spark, rows), other := scratch(spark, "b"), least=100)
    assert {r[3] for r in back(spark, other)} == {"response"} and len(back(spark, other)) == len(rows)


def test_many_groups_take_the_hot_join(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 2)
    folder = scratch(spark, "a")
    W.write_archive(table(spark, made()), folder)
    assert back(spark, folder) == sorted(account(made()), key=repr)


def test_empty_extra_columns_and_a_long_page(spark):
    folder = scratch(spark, "a")
    W.write_archive(table(spark, []), folder)
    assert back(spark, folder) == []
    df = table(spark, [(1, "u", "a" * 3_000_000), (2, "u", "")]).selectExpr("*", "1 AS sha", "2 AS head", "3 AS shard", "4 AS copies")
    W.write_archive(df, other := scratch(spark, "b"))
    assert [r[:2] for r in back(spark, other)] == [(1, 3_000_000), (2, 0)]


def test_damage_is_an_error(spark):
    folder = scratch(spark, "a")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        back(spark, folder)
    W.write_archive(table(spark, made()), folder)
    name, data = next(iter(files(folder).items()))
    path = f"{folder.removeprefix('file://')}/{name}"
    parts = list(W.members(open(path, "rb")))
    changed = b"".join(gzip.compress(p.replace(b"text 3", b"text 4"), 6, mtime=0) for p in parts)
    for bad in (changed, data[:-40], data[: len(data) // 2]):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match="damaged|manifest|ends within|zlib"):
            back(spark, folder)
    with pytest.raises(OSError):
        W.commit(spark.createDataFrame([], W.MANIFEST), folder)
    assert zlib.crc32(data)
