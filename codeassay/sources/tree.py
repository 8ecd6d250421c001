"""Trees of source files, listed, read and written in tasks.

Spark's own file listing goes through the driver, takes ``[ ] { } * ?`` in a
path for patterns and leaves out names that begin with ``_`` or a dot, which
repositories are full of (``app/[locale]/_page.tsx``, ``__init__.py``).  Here
folders are rows: a round walks each folder up to a number of entries and hands
back the folders it did not get to, which the next round spreads anew.  Ignored
folders are never listed and contents of ignored files never read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.session import cut_lineage

#: Entries after which a walk hands its other folders back, and bytes of a batch of contents.
ENTRIES, BATCH_BYTES = 20_000, 16 << 20
#: Bytes of files that one task reads, about.
TASK_BYTES = 64 << 20
SCHEME = re.compile(r"^([A-Za-z][\w+.-]*):(?://([^/]*))?(?=/)")


def without_scheme(path: str) -> str:
    """The path inside its store, as it is written: nothing in it is decoded or a pattern."""
    return SCHEME.sub("", path)


def store(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a root: a local path, ``file:`` or any address that pyarrow opens (object stores, HDFS)."""
    m = SCHEME.match(root)
    if not m or m[1].lower() == "file":
        return pafs.LocalFileSystem(), without_scheme(root).rstrip("/") or "/"
    fs, base = pafs.FileSystem.from_uri(f"{m[1]}://{m[2] or ''}")
    return fs, (base.rstrip("/") + without_scheme(root)).rstrip("/")


def children(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, size); links to folders are not followed, so a walk ends."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield x.name, True, 0
                elif x.is_file():
                    yield x.name, False, x.stat().st_size
        return
    for x in fs.get_file_info(pafs.FileSelector(folder)):
        if x.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield x.base_name, x.type == pafs.FileType.Directory, x.size or 0


def is_ignored_path(path: str, patterns) -> bool:
    """A pattern matches as a whole segment or as ``*.x`` suffix, as ``operators.corpus.is_ignored`` has it."""
    path = path.replace("\\", "/")
    return any(f"/{x}/" in path or path.endswith(f"/{x}") or (x.startswith("*.") and path.endswith(x[1:])) for x in patterns)


def list_tree(spark: SparkSession, root: str, ignore=(), entries: int = ENTRIES) -> DataFrame:
    """(path, size) of the files below ``root``, paths relative to it.

    An ignored folder is left out with all it holds.  A missing root is an
    error, an empty one has no rows.  Rounds follow the size of the tree, not
    its depth; nothing but the number of open folders reaches the driver.
    """
    fs, base = store(root)
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no folder {root}")
    ignore, n = tuple(ignore), spark.sparkContext.defaultParallelism

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                todo, seen, rows = [first], 0, []
                while todo and seen < entries:
                    folder = todo.pop()
                    for name, is_folder, size in children(fs, base + folder):
                        seen += 1
                        path = f"{folder}/{name}"
                        if is_ignored_path(path, ignore):
                            continue
                        if is_folder:
                            todo.append(path)
                        else:
                            rows.append((path, size, False))
                        if len(rows) >= entries:
                            yield _listed(rows)
                            rows = []
                yield _listed(rows + [(x, 0, True) for x in todo])

    found, todo = None, spark.createDataFrame([("",)], "path string")
    while True:
        listed = cut_lineage(todo.mapInArrow(walk, "path string, size bigint, open boolean"))
        files = listed.filter("not open").select(F.substr("path", F.lit(2)).alias("path"), "size")
        found = files if found is None else found.unionByName(files)
        todo = listed.filter("open").select("path")
        if todo.isEmpty():
            return found
        todo = todo.repartition(4 * n)


def _listed(rows: list) -> pa.RecordBatch:
    path, size, todo = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(todo, pa.bool_())], names=["path", "size", "open"])


def read_files(files: DataFrame, root: str) -> DataFrame:
    """(path, content, size) of files listed below ``root``; text is UTF-8, other bytes become U+FFFD.

    Tasks get about the same number of files, as many tasks as the bytes ask for.
    """
    spark = files.sparkSession
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        for batch in batches:
            paths, texts, sizes, held = [], [], [], 0
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                paths.append(path)
                texts.append(data.decode("utf-8", "replace"))
                sizes.append(len(data))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _contents(paths, texts, sizes)
                    paths, texts, sizes, held = [], [], [], 0
            yield _contents(paths, texts, sizes)

    return files.select("path").repartition(int(tasks), "path").mapInArrow(read, "path string, content string, size bigint")


def _contents(paths: list, texts: list, sizes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["path", "content", "size"])


def write_tree(files: DataFrame, root: str) -> None:
    """Writes (path, content) below ``root``, one file a row, under the very names that the paths have.

    A task that runs again writes the same files again.  Of rows that share a
    path any one stays; a null content is an empty file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        known = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{base}/{path}"
                if (folder := at.rsplit("/", 1)[0]) not in known:
                    fs.create_dir(folder, recursive=True)
                    known.add(folder)
                with fs.open_output_stream(at) as f:
                    f.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
