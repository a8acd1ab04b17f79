"""File corpora: one row per file, one row per line.

A *files* DataFrame has ``repo, path, is_link, size, content``; ``path`` is
relative to the repository.  Corpora usually arrive as tables of that shape;
:func:`src_file_corpus` builds one from directories that every executor can
reach.  Spark's own file sources leave out names that start with a dot, and
those (``.env``) are what the scan is after, so the walk runs in tasks.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.text import basename, contains_any, file_ext, fold, in_dirs, unify_newlines
from ..rules.scan_limits import (
    MANIFEST_SKIP_DIRS, MANIFESTS, MAX_FILE_BYTES, MAX_LINE_CHARS, SCAN_EXTENSIONS, SCAN_SKIP_DIRS)
from .listing import CHUNK_BYTES, SUBTREES, CorpusListing, Spares, Store

#: Files that lie on the disk at once as trees of a larger table, and how many trees these are.
TREE_FILES, TREES = 200_000, 2
FILE_SCHEMA = "repo string, path string, is_link boolean, size bigint, content string"


def scannable(path: Column, size: Column) -> Column:
    """Extension, directory and size rule of the secret scan."""
    return (file_ext(path).isin(*SCAN_EXTENSIONS) & (size <= MAX_FILE_BYTES)
            & ~in_dirs(path, SCAN_SKIP_DIRS))


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*MANIFESTS) & ~in_dirs(path, MANIFEST_SKIP_DIRS)


def list_corpus(spark: SparkSession, repos: dict[str, str], skip_dirs=(), subtrees: int = SUBTREES,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every file below the repositories' directories, listed by tasks of a subtree each; ``skip_dirs`` are not entered.

    ``error`` says what could not be listed.
    """
    spark.dataSource.register(CorpusListing)
    return (spark.read.format("corpus_listing").option("roots", json.dumps(repos)).option("skip", json.dumps(sorted(skip_dirs)))
            .option("subtrees", subtrees).option("chunkBytes", chunk_bytes)
            .option("tasks", min(2 * subtrees, 8 * spark.sparkContext.defaultParallelism)).load())


def _read_files(batches):
    """Listed files -> the same with content, or with an error; a bounded number of bytes at once."""
    import pyarrow as pa

    names, stores = ["repo", "path", "is_link", "size", "content", "error"], {}
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    for listed in batches:
        rows, held = [], 0
        for repo, root, path, is_link, size, error in zip(*(listed[c].to_pylist() for c in ("repo", "root", "path", "is_link", "size", "error"))):
            text = None
            if error is None:
                try:
                    if root not in stores:
                        stores[root] = Store(root)
                    text = stores[root].read(path, size).decode("utf-8", "replace")
                except OSError as problem:
                    error = f"{type(problem).__name__}: {problem.strerror}"
            rows.append((repo, path, is_link, size, text, error))
            held += len(text or "")
            if held >= 4 << 20 or len(rows) >= 10_000:
                yield batch(rows)
                rows, held = [], 0
        yield batch(rows)


def read_corpus(spark: SparkSession, repos: dict[str, str], selected=None, subtrees: int = SUBTREES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Files of the repositories in ``{name: directory}`` with their content, and what could not be listed or read: ``error``.

    Only files that pass ``selected(path, size)`` are opened; by default those
    that the secret scan or the manifest search wants.  Files are dealt out by
    chunks of about ``chunk_bytes``, so that one huge repository is read by
    many tasks.
    """
    path, size = F.col("path"), F.col("size")
    wanted = selected(path, size) if selected else (scannable(path, size) | is_manifest(path))
    skipped = () if selected else tuple(set(SCAN_SKIP_DIRS) & set(MANIFEST_SKIP_DIRS))
    listed = list_corpus(spark, repos, skipped, subtrees, chunk_bytes).filter(wanted | F.col("error").isNotNull())
    # The rows are short, their files are not: as many tasks as are named, where Spark would join them by the rows' bytes.
    tasks = 3 * spark.sparkContext.defaultParallelism
    return listed.repartition(tasks, "chunk").mapInArrow(_read_files, FILE_SCHEMA + ", error string")


def src_file_corpus(spark: SparkSession, repos: dict[str, str], selected=None, **how) -> DataFrame:
    """The files of :func:`read_corpus` that could be read."""
    return read_corpus(spark, repos, selected, **how).filter("error is null").drop("error")


def corpus_rejects(spark: SparkSession, repos: dict[str, str], selected=None, **how) -> DataFrame:
    """``repo, path, error``: the directories and files of :func:`read_corpus` that could not be listed or read."""
    return read_corpus(spark, repos, selected, **how).filter("error is not null").select("repo", "path", "error")


def _put_tree(files: DataFrame, root: str, attempts: str | None = None, spare_root: str | None = None) -> list:
    """Write each file as ``root/repo/path``; ``repo, n, attempt`` of each task and repository.

    Every attempt of a task leaves its name in the folder ``attempts``.  Rows
    with ``spare`` are the task's files below ``spare_root``, which come first
    and are used for the others.
    """

    def write(batches):
        import pyarrow as pa

        attempt, store, spares, found, waiting = uuid.uuid4().hex, Store(root), spare_root and Spares(spare_root), Counter(), True
        if attempts:
            Store(attempts).write(attempt, b"")
        for rows in batches:
            for repo, path, content, spare in zip(*(c.to_pylist() for c in rows.columns)):
                if spare:
                    spares.add(f"{repo}/{path}")
                    continue
                if waiting and spares:
                    spares.sort()
                waiting = False
                store.write(f"{repo}/{path}", content or b"", spares)
                found[repo] += 1
        found = found or {None: 0}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()),
                                          pa.array([attempt] * len(found), pa.string())], ["repo", "n", "attempt"])

    spare = F.col("spare") if spare_root else F.lit(False).alias("spare")
    return files.select("repo", "path", F.col("content").cast("binary"), spare).mapInArrow(write, "repo string, n bigint, attempt string").collect()


def write_tree(files: DataFrame, root: str) -> int:
    """Write each file as ``root/repo/path``; the number of files.  Rows with one path overwrite each other."""
    return sum(r["n"] for r in _put_tree(files, root))


def remove_tree(spark: SparkSession, root: str, repos: list[str]) -> None:
    """Remove ``root/repo`` for each of the repositories, a task's share each."""

    def remove(batches):
        import pandas as pd

        store = Store(root)
        for pdf in batches:
            for repo in pdf["repo"]:
                store.remove(f"{repo}")
            yield pd.DataFrame({"n": [len(pdf)]})

    if repos:
        tasks = min(len(repos), max(2, spark.sparkContext.defaultParallelism // 2))  # they mostly wait
        spark.createDataFrame([(r,) for r in repos], "repo string").repartition(tasks, "repo").mapInPandas(remove, "n bigint").agg(F.sum("n")).first()


def through_trees(spark: SparkSession, files: DataFrame, root: str, read, tree_files: int = TREE_FILES, names: DataFrame | None = None) -> DataFrame:
    """``read(repos)`` of the files written as trees below the new folder ``root``, ``repos`` being ``{name: directory}``.

    A file takes up a block or two of the disk, however short it is.  So the
    files are dealt by path into parts, and some trees of together
    ``tree_files`` lie on the disk at once.  Each tree's files and directories
    are used under new names for another part once they are read, and what
    ``read`` returns is kept.  If a task had another attempt, which might use
    or still write the same files, its tree is written anew, and is removed
    rather than used.  ``names`` are the files without content, where that is
    less work to count.
    """
    count = (files if names is None else names).select("repo").count()
    parts = 1 if count <= tree_files else -(-count * TREES // tree_files)
    part = F.pmod(F.xxhash64("repo", "path"), F.lit(parts)).cast("int")
    files.select("repo", "path", "content", part.alias("part")).write.partitionBy("part").parquet(f"{root}/files")
    dealt = spark.read.schema("repo string, path string, content string, part int").parquet(f"{root}/files")
    tasks = spark.sparkContext.defaultParallelism

    def put(rows, name, spare_root=None):
        at, attempts = f"{root}/tree-{name}", f"{root}/attempts-{name}"
        Store(attempts).write("none", b"")
        wrote = _put_tree(rows.repartition(tasks, "repo", "path").sortWithinPartitions(F.desc("spare")), at, attempts, spare_root)
        once = {"none", *(r["attempt"] for r in wrote)} == {name for name, *_ in Store(attempts).entries("")}
        return at, list(dict.fromkeys(r["repo"] for r in wrote if r["n"])), once

    def one_after_another(first):
        left, found = None, None
        for n in range(first, parts, TREES):
            here = dealt.filter(F.col("part") == n).drop("part").withColumn("spare", F.lit(False))
            if left:
                old, old_at, old_repos = left
                at, repos, once = put(here.unionByName(old.withColumns({"content": F.lit(None).cast("string"), "spare": F.lit(True)})), n, old_at)
                remove_tree(spark, old_at, old_repos)
                if not once:
                    remove_tree(spark, at, repos)
            if not left or not once:
                at, repos, once = put(here, f"{n}-anew" if left else n)
            found = read({r: f"{at}/{r}" for r in repos})
            found.write.parquet(f"{root}/found/part={n}")
            left = (here, at, repos)
            if parts > 1 and (n + TREES >= parts or not once or Store(at).remote):
                remove_tree(spark, at, repos)
                left = None
        return found

    with ThreadPoolExecutor(TREES) as trees:
        found = list(trees.map(inheritable_thread_target(spark)(one_after_another), range(min(parts, TREES))))[0]
    return spark.read.schema(found.schema).parquet(f"{root}/found").select(*found.columns)


def scan_files(files: DataFrame) -> DataFrame:
    return files.filter(scannable(F.col("path"), F.col("size")))


def src_manifests(files: DataFrame) -> DataFrame:
    """Manifest files, wherever they lie outside the skipped directories."""
    return files.filter(is_manifest(F.col("path"))).withColumn("manifest", basename(F.col("path")))


def src_lines(files: DataFrame, max_chars: int = MAX_LINE_CHARS, hints=None) -> DataFrame:
    """Numbered lines (from 1); lines over ``max_chars`` are left out.

    The length counts the line end, as the line is read with it.  With
    ``hints``, files and lines that contain none of them (after folding) are
    dropped early; that is for callers whose later steps need one.
    """
    keys = [c for c in files.columns if c not in ("content", "size", "is_link")]
    if hints:
        files = bind(files, _fold=fold(F.col("content"))).filter(contains_any("_fold", hints))
    # No CR is left after unify_newlines, so one marks the last line.
    marked = F.concat(unify_newlines(F.col("content")), F.lit("\r"))
    lines = files.select(*keys, F.posexplode(F.split(marked, "\n")).alias("_pos", "_raw"))
    last = F.endswith("_raw", F.lit("\r"))
    length = F.char_length("_raw") + F.when(last, -1).otherwise(1)
    lines = lines.filter((F.col("_raw") != "\r") & (length <= max_chars)).withColumn(
        "text", F.when(last, F.replace("_raw", F.lit("\r"), F.lit(""))).otherwise(F.col("_raw")))
    if hints:
        lines = bind(lines, text=F.col("text"), _fold=fold(F.col("text"))).filter(
            contains_any("_fold", hints))
    return lines.select(*keys, (F.col("_pos") + 1).alias("line"), "text")
