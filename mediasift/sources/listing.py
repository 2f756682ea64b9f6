"""Listing of directory trees by executors: a data source whose partitions are directories.

The driver lists directories from the top only until there are enough of them to deal out, and keeps no files; each task walks its
part of the tree and gives files as it meets them. Folders that are left out are not walked, and sizes and extensions are
tested where files are listed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, dir string, ext string, size bigint, mtime double, root string"
#: Schemes of file systems that can be reached from Python.
SCHEMES = ("", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
#: Directories that the driver looks for before it deals them out.
PREFIXES = 512
BATCH = 4096


def reachable(root: str) -> bool:
    return urlparse(root).scheme in SCHEMES if "://" in root or root.startswith("file:") else True


def _opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before paths of that file system)."""
    if "://" not in root:
        return fs.LocalFileSystem(), root.removeprefix("file:").rstrip("/") or "/", ""
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/") or "/", "" if root.startswith("file:") else root.rstrip("/").removesuffix(path.rstrip("/"))


def _lower_ext(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and "." not in ext else ""


@dataclass
class Branch(InputPartition):
    """A directory of a root: the whole tree below, or its own files alone."""

    root: str
    path: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.deep = options.get("recursive", "true") == "true"
        self.extensions = set(json.loads(options.get("extensions", "[]")))
        self.exclude = {x.lower() for x in json.loads(options.get("exclude", "[]"))}
        self.least, most = int(options.get("least", "0")), options.get("most")
        self.most = int(most) if most else None
        self.wanted = int(options.get("prefixes", PREFIXES))

    def _walked(self, name: str) -> bool:
        return name.lower() not in self.exclude

    def partitions(self) -> list[Branch]:
        level, out = [(root, *_opened(root)[:2]) for root in self.roots], []
        level = [x for x in level if not any(p.lower() in self.exclude for p in x[2].split("/"))]
        if not self.deep:
            return [Branch(root, path, False) for root, _, path in level]
        while level and len(out) + len(level) < self.wanted:
            below = []
            for root, system, path in level:
                inner = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory and self._walked(x.base_name)]
                out.append(Branch(root, path, False))
                below += [(root, system, x) for x in inner]
            level = below
        return out + [Branch(root, path, True) for root, _, path in level]

    def read(self, partition: Branch) -> Iterator[pa.RecordBatch]:
        system, _, before = _opened(partition.root)
        rows, waiting = [], [partition.path]
        while waiting:
            dir = waiting.pop()
            for x in system.get_file_info(fs.FileSelector(dir)):
                if x.type == fs.FileType.Directory:
                    if partition.deep and self._walked(x.base_name):
                        waiting.append(x.path)
                    continue
                ext = _lower_ext(x.base_name)
                if self.extensions and ext not in self.extensions or x.size < self.least or self.most is not None and x.size > self.most:
                    continue
                rows.append((before + x.path, x.base_name, before + dir, ext, x.size, x.mtime_ns / 1e9 if x.mtime_ns else None, partition.root))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.float64(), pa.string()]
    names = ["path", "name", "dir", "ext", "size", "mtime", "root"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaListing(DataSource):
    """``spark.read.format("media_listing")`` with the options roots, extensions, exclude (JSON lists), recursive, least, most, prefixes."""

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
