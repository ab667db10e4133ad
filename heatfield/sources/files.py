"""Small files of the driver through Hadoop's file systems: created once, replaced, listed."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def fs(spark: SparkSession, path: str):
    """The file system of a path, the path, and the JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    system, p, _ = fs(spark, path)
    return system.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there. Unfinished files (with a dot) are left out."""
    system, p, _ = fs(spark, folder)
    return sorted(n for x in system.listStatus(p) if "." not in (n := x.getPath().getName())) if system.exists(p) else []


def read(spark: SparkSession, path: str) -> str:
    system, p, jvm = fs(spark, path)
    source = system.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def delete(spark: SparkSession, path: str) -> None:
    system, p, _ = fs(spark, path)
    system.delete(p, True)


def _beside(spark: SparkSession, path: str, text: str):
    system, to, jvm = fs(spark, path)
    system.mkdirs(to.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    return system, to, beside, jvm


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a whole file in place if there is none of the name, in one step; False if there is one. Of several writers one succeeds."""
    system, to, beside, _ = _beside(spark, path, text)
    try:
        if system.getUri().getScheme() == "file":  # a rename would replace the file there, a link does not
            local = lambda p: unquote(urlsplit(p.toUri().toString()).path)
            try:
                os.link(local(beside), local(to))
                return True
            except FileExistsError:
                return False
        return not system.exists(to) and system.rename(beside, to)
    finally:
        system.delete(beside, False)


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Puts a whole file in place of the one there, in one step."""
    _, to, beside, jvm = _beside(spark, path, text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(beside), context.makeQualified(to), options)


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file of a name that is never written twice. False if it is there with the same text; another text is an error."""
    if create(spark, path, text):
        return True
    if read(spark, path).strip() != text.strip():
        raise FileExistsError(f"{path} holds something else")
    return False


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='heatfield-')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder; a cluster, whose executors would not share one, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/heatfield/{name}-{uuid.uuid4().hex}"
