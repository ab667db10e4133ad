import json
import os

import pytest
from pyspark.sql import functions as F

from heatfield.sources import columns

KINDS = "a:u8,b:i16,c:u16,d:u32,e:i8,f:i32"


def table(spark, n=1000):
    id_ = F.col("id")
    cols = {"a": id_ % 255, "b": id_ % 60_000 - 30_000, "c": F.when(id_ % 3 > 0, id_ % 65_535), "d": id_ * 4_000_000 % 4_294_967_295, "e": F.when(id_ % 2 > 0, id_ % 250 - 125), "f": id_ - 500}
    return spark.range(0, n, numPartitions=3).select(*[c.cast("long").alias(k) for k, c in cols.items()])


def save(df, path, kinds=KINDS, mode="append", **options):
    df.write.format("typed_columns").option("kinds", kinds).options(**options).mode(mode).save(path)


@pytest.fixture(scope="module")
def source(spark):
    columns.register(spark)
    return spark


@pytest.mark.parametrize("gzip", ["false", "true"])
def test_round_trip(source, tmp_path, monkeypatch, gzip):
    path, df = str(tmp_path / "t"), table(source)
    save(df, path, gzip=gzip)
    back = source.read.format("typed_columns").load(path)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    said = json.loads((tmp_path / "t" / "columns.json").read_text())
    assert said["rows"] == 1000 and len(said["chunks"]) == 3 and all(c["offset"] % 8 == 0 for x in said["chunks"] for c in x["columns"])
    with pytest.raises(Exception, match="holds columns"):
        save(df, path)
    assert back.count() == 1000
    save(df.limit(7), path, mode="overwrite")
    assert source.read.format("typed_columns").load(path).count() == 7
    assert {n for n in os.listdir(path) if n.endswith(".bin")} == {c["file"] for c in json.loads((tmp_path / "t" / "columns.json").read_text())["chunks"]}


def test_values_that_do_not_fit(source, tmp_path):
    for k, (kind, value) in enumerate([("u8", 255), ("u8", -1), ("u8", 300), ("i16", -32768), ("i16", 40_000), ("u16", 65_535)]):
        df = source.createDataFrame([(1,), (value,), (None,)], "a long")
        with pytest.raises(Exception, match="cannot hold"):
            save(df, str(tmp_path / f"t{k}"), f"a:{kind}")
        assert not os.path.exists(tmp_path / f"t{k}" / "columns.json")
    with pytest.raises(Exception, match="no such columns"):
        save(df, str(tmp_path / "x"), "a:u9")


def test_cut_and_changed_files(source, tmp_path):
    path = tmp_path / "t"
    save(table(source), str(path))
    said = json.loads((path / "columns.json").read_text())
    name = said["chunks"][0]["file"]
    data = (path / name).read_bytes()
    (path / name).write_bytes(data[:-1])
    with pytest.raises(Exception, match="bytes, not"):
        source.read.format("typed_columns").load(str(path)).collect()
    (path / name).write_bytes(data)
    kinds = said["kinds"]
    part = said["chunks"][0]
    for change in ({"offset": 8_000_000}, {"offset": 4}, {"length": 1}, {"type": "u32"}, {"name": "b"}):
        bad = json.loads(json.dumps(part))
        bad["columns"][0] |= change
        with pytest.raises(ValueError):
            columns.views(data, bad, kinds)
    (path / "columns.json").write_text(json.dumps(said | {"rows": 5}))
    with pytest.raises(Exception, match="does not agree"):
        source.read.format("typed_columns").load(str(path)).collect()


def test_no_rows(source, tmp_path):
    save(table(source).limit(0), str(tmp_path / "t"))
    back = source.read.format("typed_columns").load(str(tmp_path / "t"))
    assert back.count() == 0 and back.columns == ["a", "b", "c", "d", "e", "f"]
