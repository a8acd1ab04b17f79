"""Trees of a corpus use the files of those that are read; the rows stay."""

import os

from pyspark.sql import functions as F

from ironquill.sources import files as src
from ironquill.sources.listing import CorpusReader, Spares, Store


def _tree(at):
    return {os.path.relpath(f"{d}/{n}", at): (os.stat(f"{d}/{n}").st_ino, open(f"{d}/{n}").read()) for d, _, names in os.walk(at) for n in names}


def _files(spark, n=240):
    path = F.expr("concat(array('', 'src/', 'src/app/', 'a/b/c/')[id % 4], 'f', id, array('.py', '/.env', '/deep/er/x.js', '.lock', '')[id % 5])")
    text = F.when(F.col("id") % 7 != 0, F.repeat(F.concat(F.col("id"), F.lit("é\n")), F.pmod(F.col("id") * 37, F.lit(50)).cast("int")))
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo"), path.alias("path"), F.lit(False).alias("is_link"),
                                 F.lit(1).cast("bigint").alias("size"), text.alias("content"))


def test_spares_get_new_names_and_contents(tmp_path):
    old, new = Store(f"file://{tmp_path}/old"), Store(f"file://{tmp_path}/new")
    was = ["r/a.py", "r/d/b.py", "r/d/c.py", "r/own/.env", "r/two/.env", "r/held/x.py"]
    for path in was:
        old.write(path, b"old content of " + path.encode())
    (tmp_path / "old/r/held/other").write_text("of another task")
    before, own = _tree(tmp_path / "old"), os.stat(tmp_path / "old/r/own").st_ino
    spares = Spares(f"file://{tmp_path}/old")
    for path in [*was, "r/gone.py"]:
        spares.add(path)
    spares.sort()
    want = {"r/k/.env": b"1", "r/k/z.py": b"22", "q/deep/er/n.js": "é".encode(), "q/deep/er/n2.js": b"", "q/w.py": b"longer than any old content " * 9,
            "q/v.py": b"v", "q/u.py": b"u", "q/t.py": b"t", "q/k/s.py": b"s"}
    for path, data in want.items():
        new.write(path, data, spares)
    new.write("r/k/z.py", b"3")  # written again, and shorter
    got = _tree(tmp_path / "new")
    assert {p: c.encode() for p, (_, c) in got.items()} == want | {"r/k/z.py": b"3"}
    inodes = [i for i, _ in got.values()]
    assert len(set(inodes)) == len(inodes) and len(set(inodes) & {i for i, _ in before.values()}) == len(was)
    assert own in {os.stat(d).st_ino for d, _, _ in os.walk(tmp_path / "new")}
    assert {p: c for p, (_, c) in _tree(tmp_path / "old").items()} == {"r/held/other": "of another task"}
    old.remove("r")
    assert not (tmp_path / "old/r").exists()


def _through(spark, files, root, tree_files, seen):
    def read(roots):
        at = {os.path.dirname(d.removeprefix("file://")) for d in roots.values()}.pop()
        seen.append(_tree(at))
        return src.src_file_corpus(spark, roots, lambda path, size: F.lit(True)).select("repo", "path", "size", "content")

    return sorted(map(tuple, src.through_trees(spark, files, f"file://{root}", read, tree_files).collect()))


def test_each_tree_holds_its_own_files_only(spark, tmp_path):
    files = _files(spark)
    want = sorted((r.repo, r.path, len((r.content or "").encode()), r.content or "") for r in files.collect())
    seen = []
    assert _through(spark, files, tmp_path / "p", 60, seen) == want and len(seen) == 8
    held = [(*p.split("/", 1), c) for tree in seen for p, (_, c) in tree.items()]
    assert sorted(held) == [(r, p, c) for r, p, _, c in want]
    assert len({i for tree in seen for i, _ in tree.values()}) < 0.75 * len(want)
    assert _through(spark, files, tmp_path / "w", 1000, whole := []) == want and len(whole) == 1


def test_trees_of_second_attempts_are_written_anew(spark, tmp_path, monkeypatch):
    put, roots = src._put_tree, []

    def tried_twice(files, root, attempts=None, spare_root=None):
        out = put(files, root, attempts, spare_root)
        roots.append((os.path.basename(root), spare_root is not None))
        if spare_root:
            Store(root).write("r0/left.py", b"of another attempt")
            Store(attempts).write("another", b"")
        return out

    monkeypatch.setattr(src, "_put_tree", tried_twice)
    files = _files(spark, 60)
    got = _through(spark, files, tmp_path / "p", 30, [])
    assert got == sorted((r.repo, r.path, len((r.content or "").encode()), r.content or "") for r in files.collect())
    assert sum(name.endswith("-anew") for name, _ in roots) == sum(spared for _, spared in roots) == 2
    assert [n for d, _, names in os.walk(tmp_path / "p") for n in names if "tree-" in d] == []


def test_listing_by_as_many_tasks_as_named(tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.py").write_text("x")
    reader = CorpusReader({"r": str(tmp_path)}, (), 16, 1 << 20, 3)
    tasks = reader.partitions()
    assert len(tasks) == 3 and sorted(row[2] for t in tasks for row in reader.read(t)) == sorted(f"d{i}/f.py" for i in range(40))


def test_files_are_read_by_all_cores(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.py").write_text(f"x = {i}")
    ids = src.src_file_corpus(spark, {"r": str(tmp_path)}).select("content", F.spark_partition_id().alias("n")).collect()
    assert len({r.content for r in ids}) == 60 and len({r.n for r in ids}) > 4
