"""A table whose partitions are replaced whole, under a manifest that is committed last.

Data folders are never changed once a manifest names them.  The newest
manifest says which folder holds each partition, and which batch of which
query was applied last, so that a replayed batch is recognised.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

EMPTY = {"query": None, "batch": -1, "partitions": {}}


def _store(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def _manifests(spark: SparkSession, path: str) -> list[str]:
    store, folder = _store(spark, f"{path}/_manifest")
    if not store.exists(folder):
        return []
    return sorted(f.getPath().toString() for f in store.listStatus(folder) if f.getPath().getName().endswith(".json"))


def _read(spark: SparkSession, file: str) -> dict:
    store, jvm_path = _store(spark, file)
    stream = store.open(jvm_path)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> dict:
    """The newest manifest: ``query``, ``batch`` and ``partitions`` (value: folder)."""
    files = _manifests(spark, path)
    return _read(spark, files[-1]) if files else dict(EMPTY)


def commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Add a manifest.  It is written aside and renamed, and of two writers one fails."""
    number = len(_manifests(spark, path)) and int(_manifests(spark, path)[-1].rsplit("/", 1)[1][:-5]) + 1
    store, aside = _store(spark, f"{path}/_manifest/{number:012d}.tmp")
    _, final = _store(spark, f"{path}/_manifest/{number:012d}.json")
    out = store.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if store.exists(final) or not store.rename(aside, final):
        raise RuntimeError(f"another writer has committed manifest {number}")


def folders(manifest: dict, only=None) -> list[str]:
    return [f for value, f in sorted(manifest["partitions"].items()) if only is None or value in only]


def read_table(spark: SparkSession, path: str, schema: str, only=None) -> DataFrame:
    """The table, or some partitions of it, as committed."""
    found = folders(current(spark, path), only)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete data and manifests that the newest ``keep`` manifests do not need; the number of folders deleted.

    Not while a batch is being written: its folder is not in a manifest yet.
    """
    files = _manifests(spark, path)
    needed = {f for file in files[-keep:] for f in folders(_read(spark, file))}
    store, root = _store(spark, f"{path}/data")
    deleted = 0
    for run in store.listStatus(root) if store.exists(root) else ():
        parts = [p.getPath() for p in store.listStatus(run.getPath()) if p.isDirectory()]
        stale = [p for p in parts if f"{path}/data/{run.getPath().getName()}/{p.getName()}" not in needed]
        for p in stale:
            store.delete(p, True)
        deleted += len(stale)
        if len(stale) == len(parts):
            store.delete(run.getPath(), True)
    for file in files[:-keep]:
        store.delete(_store(spark, file)[1], False)
    return deleted
