"""Source trees on storage → ``site_files`` (project_id, path, content).

``root`` holds one folder per project, on any storage that pyarrow names by
an address (a path, ``file:``, ``s3:``, ``hdfs:``, ``gs:``).  The project is
the first folder under the root and ``path`` the rest, ``/``-separated.

Listing and reading are two steps.  The ``source_tree`` data source lists
files: a few upper folders on the driver, everything below them in tasks.
Excluded folders are never entered, and filters on ``project_id`` and the
start of ``path`` choose the folders to walk.  The files found are dealt anew
by address, so that a large project is read by many tasks; only then are they
opened, in batches bounded by bytes.

Defined results: bytes are decoded as UTF-8 (invalid ones replaced); a file
that is no text by its name is not opened, its content is null; a file that
vanishes between the two steps has null content.  Files right under the root
belong to no project and are left out, linked folders are not followed, names
that start with a dot or an underscore count like others.  An empty root
gives no rows, a missing one an error.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    StringStartsWith)

from sitelens.functions import constants as C

TEXT_FILE = r"\.(jsx?|tsx?|mjs|cjs|html?|json|css|s[ac]ss|less|mdx?|txt|vue|svelte|xml|svg|ya?ml|toml)$|/[^/.]+$"
LISTED = "project_id string, path string, size long"
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1024
# The audit looks for robots.txt and sitemap.xml in public/; sources there are left out later (F2).
SKIPPED = tuple(d for d in C.EXCLUDE_DIRS if d != "public")


def storage(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(root)
    address = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/*", "file:///", root))
    fs, top = pafs.FileSystem.from_uri(address)
    return fs, top.rstrip("/")


class Folder(NamedTuple):
    path: str   # relative to the root
    deep: bool  # with all that lies below


class Walk(InputPartition):
    def __init__(self, folders: list[Folder]):
        super().__init__(None)
        self.folders = folders


class SourceTree(DataSource):
    """Files below ``path``: options ``exclude`` (folder or file names, joined
    by ``/``) and ``splits`` (how many folders to deal)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("exclude", ""), int(self.options.get("splits", "64")))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, exclude: str, splits: int):
        self.root, self.splits = root, splits
        self.exclude = {x for x in exclude.split("/") if x}
        self.projects: set[str] | None = None  # None: all
        self.starts: list[str] = []            # of ``path``; all must hold

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Projects are chosen exactly; a path's start only prunes folders, and
        Spark still tests it."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("project_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.projects = wanted if self.projects is None else self.projects & wanted
                continue
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.starts.append(f.value)
            yield f

    def _walked(self, folder: str) -> bool:
        """Whether a folder (relative) may hold rows."""
        project, _, inside = folder.partition("/")
        if inside and inside.rsplit("/", 1)[-1] in self.exclude:
            return False
        if self.projects is not None and project not in self.projects:
            return False
        here = inside + "/" if inside else ""
        return all(s.startswith(here) or here.startswith(s) for s in self.starts)

    def _list(self, fs: pafs.FileSystem, top: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """(folders to walk, files with their sizes) of one folder, sorted."""
        where = f"{top}/{folder}" if folder else top
        folders, files = [], []
        for info in fs.get_file_info(pafs.FileSelector(where)):
            name = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == pafs.FileType.Directory:
                linked = fs.type_name == "local" and os.path.islink(info.path)
                if not linked and self._walked(name):
                    folders.append(name)
            elif info.type == pafs.FileType.File and folder and info.base_name not in self.exclude:
                files.append((name, info.size))
        return sorted(folders), sorted(files)

    def partitions(self) -> Sequence[Walk]:
        """Folders by breadth until there are ``splits`` of them; each listing
        gives way to its folder's files and its subfolders."""
        fs, top = storage(self.root)
        shallow, deep = [], self._list(fs, top, "")[0]
        while deep and len(shallow) + len(deep) < self.splits:
            below = [f for folder in deep for f in self._list(fs, top, folder)[0]]
            shallow += [Folder(f, False) for f in deep]
            deep = below
        units = shallow + [Folder(f, True) for f in deep]
        n = max(1, min(self.splits, len(units)))
        return [Walk(units[i::n]) for i in range(n)]

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        fs, top = storage(self.root)
        for start, deep in partition.folders:
            open_ = [start]
            while open_:
                folders, files = self._list(fs, top, open_.pop())
                if deep:
                    open_ += folders
                for at in range(0, len(files), BATCH_ROWS):
                    part = files[at:at + BATCH_ROWS]
                    split = [f.split("/", 1) for f, _ in part]
                    yield pa.RecordBatch.from_pydict({
                        "project_id": [p for p, _ in split], "path": [q for _, q in split],
                        "size": pa.array([s for _, s in part], pa.int64())})


def list_source_tree(spark: SparkSession, root: str, exclude: Sequence[str] = SKIPPED,
                     splits: int | None = None) -> DataFrame:
    """(project_id, path, size) of all files; none is opened.  ``exclude`` ()
    walks every folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    splits = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (spark.read.format("source_tree").option("exclude", "/".join(exclude))
            .option("splits", str(splits)).load(root))


def _open(root: str, log: str | None):
    def run(batches):
        fs, top = storage(root)
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                text = None
                if r["is_text"]:
                    try:
                        with fs.open_input_stream(f"{top}/{r['project_id']}/{r['path']}") as f:
                            text = f.read().decode("utf-8", "replace")
                    except FileNotFoundError:
                        pass
                    if log:
                        with open(os.path.join(log, str(os.getpid())), "a") as out:
                            out.write(f"{r['project_id']}/{r['path']}\n")
                rows.append((r["project_id"], r["path"], text))
                size += len(text or "")
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        k: pa.array([r[i] for r in rows], pa.string()) for i, k in enumerate(("project_id", "path", "content"))})


def read_source_tree(spark: SparkSession, root: str, where: Column | None = None,
                     exclude: Sequence[str] = SKIPPED, splits: int | None = None,
                     log: str | None = None) -> DataFrame:
    """``site_files`` of a tree.  ``where`` chooses files by project_id, path
    and size before any is opened; ``splits`` is the number of listing and
    of reading tasks (the session's shuffle partitions); ``log`` names a folder
    where tasks note each file they open."""
    found = list_source_tree(spark, root, exclude, splits)
    if where is not None:
        found = found.where(where)
    n = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.lower(F.concat(F.lit("/"), F.col("path")))
    dealt = (found.repartition(n, "project_id", "path")
             .select("project_id", "path", name.rlike(TEXT_FILE).alias("is_text")))
    return dealt.mapInArrow(_open(root, log), "project_id string, path string, content string")
