"""Listing of directory trees as a data source: a partition is a subtree, a row is a file or what could not be listed."""

from __future__ import annotations

import itertools
import json
import os
import shutil
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING_SCHEMA = "repo string, root string, path string, is_link boolean, size bigint, chunk string, error string"
#: Bytes of files that are read together, and subtrees that the driver looks for before tasks walk them.
CHUNK_BYTES, SUBTREES = 64 << 20, 256
#: A file counts as this many bytes more: opening it takes time, however short it is.
FILE_BYTES = 4096


def make_folder(path: str, tries: int = 20) -> None:
    """A local directory and those above it; an empty one may go while another task puts a spare one in its place."""
    for _ in range(tries):
        try:
            return os.makedirs(path, exist_ok=True)
        except FileNotFoundError:
            pass
    os.makedirs(path, exist_ok=True)


class Store:
    """Local directories by path or ``file:`` address; others as Arrow's file systems know them (s3, gs, hdfs, abfs)."""

    def __init__(self, root: str):
        self.remote, self.root, self.made = None, root, set()
        if root.startswith("file:"):
            self.root = "/" + root[5:].lstrip("/")
        elif "://" in root:
            from pyarrow import fs

            self.remote, self.root = fs.FileSystem.from_uri(root)

    def at(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}" if path else self.root

    def entries(self, path: str) -> Iterator[tuple[str, bool, bool, int, str | None]]:
        """Name, is directory, is link, size, error of everything in a directory, by name.  Links to directories are not followed."""
        if self.remote is None:
            with os.scandir(self.at(path)) as found:
                for e in sorted(found, key=lambda e: e.name):
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield e.name, True, False, 0, None
                        elif not e.is_dir():
                            yield e.name, False, e.is_symlink(), e.stat().st_size, None
                    except OSError as problem:
                        yield e.name, False, e.is_symlink(), 0, f"{type(problem).__name__}: {problem.strerror}"
            return
        from pyarrow import fs

        for e in sorted(self.remote.get_file_info(fs.FileSelector(self.at(path))), key=lambda e: e.base_name):
            yield e.base_name, e.type == fs.FileType.Directory, False, e.size or 0, None

    def directories(self, path: str) -> list[str]:
        """Names of the directories in a directory, in order; nothing is asked about its files."""
        if self.remote is None:
            with os.scandir(self.at(path)) as found:
                return sorted(e.name for e in found if e.is_dir(follow_symlinks=False))
        return [name for name, is_dir, *_ in self.entries(path) if is_dir]

    def read(self, path: str, size: int = 0) -> bytes:
        """A file's content; ``size`` bytes are asked for at first."""
        if self.remote is None:
            f = os.open(self.at(path), os.O_RDONLY | os.O_CLOEXEC)
            try:
                pieces = [os.read(f, size + 1)]
                while pieces[-1]:
                    pieces.append(os.read(f, 1 << 20))
                return b"".join(pieces)
            finally:
                os.close(f)
        with self.remote.open_input_stream(self.at(path)) as f:
            return f.read()

    def remove(self, path: str, at_once: int = 32) -> None:
        """A directory with all that it holds; so many files at once, as file systems may wait for the disk with each."""
        if self.remote is not None:
            return self.remote.delete_dir(self.at(path))
        with os.scandir(self.at(path)) as found:
            below = [(e.path, e.is_dir(follow_symlinks=False)) for e in found]
        with ThreadPoolExecutor(at_once) as several:
            list(several.map(lambda e: shutil.rmtree(e[0]) if e[1] else os.unlink(e[0]), below))
        shutil.rmtree(self.at(path))

    def write(self, path: str, data: bytes, spares: Spares | None = None) -> None:
        """A file and the directories above it; local ones may come from ``spares``."""
        folder = self.at(path).rsplit("/", 1)[0]
        if self.remote is not None:
            self.remote.create_dir(folder, recursive=True)
            with self.remote.open_output_stream(self.at(path)) as f:
                f.write(data)
            return
        used = False
        if folder not in self.made:
            if spares:
                used = spares.give_folder(folder, self.at(path))
            if not used:
                make_folder(folder)
            if len(self.made) > 100_000:
                self.made.clear()
            self.made.add(folder)
        used = used or (spares is not None and spares.give_file(self.at(path)))
        # A file that is emptied and written again is put on the disk at once by some file systems; one that is cut is not.
        how = os.O_WRONLY | os.O_CREAT | os.O_CLOEXEC | (0 if used else os.O_TRUNC)
        for n in range(20):
            try:
                f = os.open(self.at(path), how, 0o666)
                break
            except FileNotFoundError:  # another task has put a spare directory in the place of an empty one
                if n == 19:
                    raise
                make_folder(folder)
        try:
            left = memoryview(data)
            while left:
                left = left[os.write(f, left):]
            if used:
                os.ftruncate(f, len(data))
        finally:
            os.close(f)


class Spares:
    """One task's share of the files of a local tree that nobody reads or writes any more, to be used under new names.

    New names and contents cost a file system a fraction of what new files and
    the removal of the old ones cost.  File systems do one rename between
    directories at a time, but any number of links: only directories are
    renamed.  Two attempts of a task could take one file twice; a tree that
    had two is to be written anew.
    """

    def __init__(self, root: str):
        self.store, self.left = Store(root), Counter()
        self.files, self.alone, self.empty = [], [], []

    def add(self, path: str) -> None:
        self.files.append(path)
        self.left[path.rpartition("/")[0]] += 1

    def sort(self) -> None:
        """Set apart the files that seem to be alone in a directory, unless it is an uppermost one: those stay, for remove_tree."""
        folders = [path.rpartition("/")[0] for path in self.files]
        alone = [self.left[f] == 1 and "/" in f for f in folders]
        self.alone, self.files = ([p for p, a in zip(self.files, alone) if a is which] for which in (True, False))

    def holds(self, folder: str, *names: str) -> bool:
        """Whether a directory holds these names and no others."""
        try:
            with os.scandir(self.store.at(folder)) as found:
                return [e.name for e in itertools.islice(found, 2)] == [*names]
        except OSError:
            return False

    def give_file(self, to: str) -> bool:
        """Whether ``to`` is now one of the files, with its old content."""
        some = self.files or self.alone
        if not some:
            return False
        path = some.pop()
        folder = path.rpartition("/")[0]
        self.left[folder] -= 1
        try:
            os.link(self.store.at(path), to)
            os.unlink(self.store.at(path))
        except OSError:
            return False
        if not self.left[folder] and "/" in folder and self.holds(folder):
            self.empty.append(folder)
        return True

    def give_folder(self, to: str, file: str) -> bool:
        """Make the directory ``to`` from one of the old ones, if there is one; whether it has brought ``file``, with its old content."""
        while self.alone:
            path = self.alone.pop()
            folder, _, name = path.rpartition("/")
            if not self.holds(folder, name):
                self.files.append(path)
            elif self._moved(folder, to):
                os.rename(f"{to}/{name}", file)
                return True
            else:
                self.alone.append(path)
                return False
        if self.empty and self._moved(self.empty[-1], to):
            self.empty.pop()
        return False

    def _moved(self, folder: str, to: str) -> bool:
        for _ in range(0 if os.path.isdir(to) else 2):
            try:
                os.rename(self.store.at(folder), to)
                return True
            except FileNotFoundError:
                make_folder(to.rpartition("/")[0])
            except OSError:  # it is there
                break
        return False


class Subtrees(InputPartition):
    """What one task lists: repository, root, path, and whether all below or the directory's own files."""

    def __init__(self, number: int, parts: list[tuple[str, str, str, bool]]):
        self.number, self.parts = number, parts


class CorpusReader(DataSourceReader):
    def __init__(self, roots: dict[str, str], skip: tuple[str, ...], subtrees: int, chunk_bytes: int, tasks: int = 0):
        self.roots, self.skip, self.subtrees, self.chunk_bytes, self.tasks = roots, skip, subtrees, chunk_bytes, tasks or 2 * subtrees

    def partitions(self) -> list[Subtrees]:
        """Subtrees, and the files of the directories above them.

        The driver opens the uppermost directories until there are enough
        subtrees; it opens at most twice as many.  One directory may hold any
        number of others: they are dealt over so many tasks.
        """
        waiting, found, opened = sorted((repo, root, "") for repo, root in self.roots.items()), [], 0
        while waiting and len(waiting) < self.subtrees and opened < 2 * self.subtrees:
            repo, root, path = waiting.pop(0)
            opened += 1
            found.append((repo, root, path, False))
            try:
                waiting += [(repo, root, f"{path}/{name}" if path else name)
                            for name in Store(root).directories(path) if name not in self.skip]
            except OSError:
                pass  # the task that lists it reports it
        found += [(*w, True) for w in waiting]
        tasks = min(len(found), max(1, self.tasks))
        return [Subtrees(n, found[n::tasks]) for n in range(tasks)]

    def read(self, partition: Subtrees | None) -> Iterator[tuple]:
        stores, size_before = {}, 0
        for repo, root, top, deep in partition.parts if partition else ():  # none: Spark asks all the same
            store, waiting = stores.setdefault(root, Store(root)), [top]
            row = lambda path, is_link, size, error: (
                repo, root, path, is_link, size, f"{partition.number}-{size_before // self.chunk_bytes}", error)  # noqa: B023
            while waiting:
                here = waiting.pop()
                try:
                    for name, is_dir, is_link, size, error in store.entries(here):
                        path = f"{here}/{name}" if here else name
                        if is_dir:
                            if deep and name not in self.skip:
                                waiting.append(path)
                        else:
                            yield row(path, is_link, size, error)
                            size_before += size + FILE_BYTES
                except OSError as problem:
                    yield row(here, False, 0, f"{type(problem).__name__}: {problem.strerror}")


class CorpusBatches(CorpusReader):
    """The same rows in Arrow batches."""

    def read(self, partition: Subtrees | None) -> Iterator:
        import pyarrow as pa

        text, rows = pa.string(), super().read(partition)
        kinds = {"repo": text, "root": text, "path": text, "is_link": pa.bool_(), "size": pa.int64(), "chunk": text, "error": text}
        while some := list(itertools.islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), kinds.values())], list(kinds))


class CorpusListing(DataSource):
    """``spark.read.format("corpus_listing")`` with options ``roots`` (JSON: name to directory), ``skip`` (JSON list of
    directory names that are not entered), ``subtrees``, ``chunkBytes`` and ``tasks``.

    ``chunk`` names files of a subtree that together have about ``chunkBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_listing"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> CorpusReader:
        o = self.options
        return CorpusBatches(json.loads(o["roots"]), tuple(json.loads(o.get("skip", "[]"))), int(o.get("subtrees", SUBTREES)),
                             int(o.get("chunkBytes", CHUNK_BYTES)), int(o.get("tasks", 0)))
