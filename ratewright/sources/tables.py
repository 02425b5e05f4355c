"""Tables that are replaced at once.

A table is a folder of versions. A version is written in full into a folder of its own; then one
small file under ``_manifest`` names it. Readers follow the manifest of the highest number, so
they see the old version until that file is there, and a job that dies before leaves the old table
as it was. Creating a manifest that exists fails, so of two writers of one number one stops. Older
versions, and folders that no manifest names, are removed after the new one is in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    store = _store(spark, path)
    if not store.exists(_path(spark, path)):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(_path(spark, path)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    _store(spark, path).delete(_path(spark, path), True)


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """What the manifests say, oldest first. One that is not whole counts as not there."""
    store, out = _store(spark, path), []
    for name in _names(spark, f"{path}/_manifest"):
        file = _path(spark, f"{path}/_manifest/{name}")
        stream = store.open(file)
        try:
            content = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            out.append({"name": name, **json.loads(content)})
        except ValueError:
            continue
    return out


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest readers follow: number, folder and schema."""
    found = _manifests(spark, path)
    return found[-1] if found else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no version of {path} is complete")
    return spark.read.schema(T.StructType.fromJson(now["schema"])).parquet(f"{path}/{now['folder']}")


def replace_table(df: DataFrame, path: str, keep: int = 1) -> DataFrame:
    """Make ``df`` the table at ``path`` and read it back. ``df`` may read the version it replaces.

    The last ``keep`` versions stay; readers that opened an older one have to open it anew.
    """
    spark = df.sparkSession
    before = current(spark, path)
    number = before["number"] + 1 if before else 1
    folder = f"v{number:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    content = json.dumps({"number": number, "folder": folder, "schema": df.schema.jsonValue()})
    stream = _store(spark, path).create(_path(spark, f"{path}/_manifest/{number:08d}.json"), False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    _tidy(spark, path, keep)
    return read_table(spark, path)


def _tidy(spark: SparkSession, path: str, keep: int) -> None:
    known = _manifests(spark, path)
    kept = {m["folder"] for m in known[-keep:]}
    oldest = known[-keep:][0]["number"]
    for m in known[:-keep]:
        remove(spark, f"{path}/_manifest/{m['name']}")
    for name in _names(spark, path):
        # a folder of a higher number may be a writer's that is still at work
        if name.startswith("v") and name not in kept and int(name[1:9]) <= max(oldest, known[-1]["number"]):
            remove(spark, f"{path}/{name}")
