"""A data source that crawls directory trees: spark.read.format("filetree").option("root", ...).

Partitions are subtrees. entry_id follows the order of a depth-first walk: each partition has a range of its own, in
the order of the subtrees. Directories that cannot be read have no entries; an ignored directory is an entry without a
subtree, except for the root, which is always read; a slow subtree is one partition however large it is.
"""

from __future__ import annotations

import grp
import os
import pwd
import re
import stat as st
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.compiler import ENTRIES, WANTED
from ..shipping import ship

#: Subtrees are split until there are about so many, and rows of a batch.
SUBTREES, ROWS = 64, 8192
#: Bytes of a file that are searched for a zero byte; contents read before they are passed on.
HEAD, READ_BYTES = 4096, 16 << 20
#: entry_ids that a partition may give out.
SPAN = 1 << 40


@lru_cache(4096)
def _has_user(uid: int) -> bool:
    try:
        pwd.getpwuid(uid)
        return True
    except KeyError:
        return False


@lru_cache(4096)
def _has_group(gid: int) -> bool:
    try:
        grp.getgrgid(gid)
        return True
    except KeyError:
        return False


def shown(name: str) -> str:
    """A name as valid text: bytes that are not UTF-8 become \\xNN."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def hidden(path: str) -> str:
    """The name that a shown one stands for: \\xNN of a byte that is no UTF-8 becomes that byte, if there is such a file."""
    if "\\x" in path and not os.path.lexists(path):
        raw = re.sub(rb"\\x([89a-f][0-9a-f])", lambda m: bytes([int(m[1], 16)]), path.encode())
        return os.fsdecode(raw)
    return path


def kind_of(mode: int) -> str:
    for test, kind in ((st.S_ISDIR, "d"), (st.S_ISLNK, "l"), (st.S_ISCHR, "c"), (st.S_ISBLK, "b"), (st.S_ISFIFO, "p"), (st.S_ISSOCK, "s")):
        if test(mode):
            return kind
    return "f"


def listing(path: str) -> list[str]:
    """Names in a directory, in order; none if it cannot be read."""
    try:
        with os.scandir(path) as found:
            return sorted(e.name for e in found)
    except OSError:
        return []


def row_of(path: str, parent: str | None, depth: int, entry_id: int, is_root: bool, children: int | None) -> tuple:
    """One entry; children: their number for a directory that is not entered here."""
    try:
        own = os.lstat(path)
        ftype = kind_of(own.st_mode)
    except OSError:
        own, ftype = None, "f"
    try:
        s = os.stat(path)  # of a link's target
    except OSError:
        s = None
    link = None
    if ftype == "l":
        try:
            link = shown(os.readlink(path))
        except OSError:
            pass
    name = "/" if path == "/" else shown(os.path.basename(path))
    n = len(listing(path)) if ftype == "d" and children is None else children
    access = [os.access(path, m) for m in (os.R_OK, os.W_OK, os.X_OK)]
    fields = (s.st_size, s.st_ino, s.st_mode & 0o7777, s.st_uid, s.st_gid, s.st_atime, s.st_mtime, s.st_ctime) if s else (None,) * 8
    known = (_has_user(s.st_uid), _has_group(s.st_gid)) if s else (None, None)
    return (entry_id, ftype, shown(path), name, None if parent is None else shown(parent), depth, is_root, n if ftype == "d" else None, *fields[:5], *(None if t is None else int(t * 1e6) for t in fields[5:]), link, *access, *known, s is not None)


def walk(path: str, parent: str | None, depth: int, ignored: frozenset[str], take: Iterator[int]) -> Iterator[tuple]:
    """The rows of a subtree in depth-first order, with a stack of its own rather than recursion."""
    stack = [(path, parent, depth)]
    while stack:
        here, above, level = stack.pop()
        is_dir = os.path.isdir(here) and not os.path.islink(here)
        names = listing(here) if is_dir else None
        yield row_of(here, above, level, next(take), False, None if names is None else len(names))
        if is_dir and here not in ignored:
            stack += [(os.path.join(here, name), here, level + 1) for name in reversed(names)]


class Subtree(InputPartition):
    """A piece of the walk: entries alone, or whole subtrees."""

    def __init__(self, first: int, pieces: list[tuple[str, str | None, int, bool, bool]]):
        self.first, self.pieces = first, pieces


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["root"])
        split = lambda key: frozenset(p for p in options.get(key, "").split("\n") if p)
        self.ignored, self.slow = split("ignored"), split("slow")

    def partitions(self) -> list[Subtree]:
        # (path, parent, depth, whole subtree?, root?): opened level by level until there are enough
        pieces = [(self.root, None, 0, True, True)]
        opened = True
        while opened and sum(p[3] for p in pieces) < SUBTREES:
            opened, more = False, []
            for piece in pieces:
                path, _, depth, whole, is_root = piece
                if not whole or path in self.slow or (path in self.ignored and not is_root) or os.path.islink(path) or not os.path.isdir(path):
                    more.append(piece)
                    continue
                more.append((*piece[:3], False, is_root))
                more += [(os.path.join(path, name), path, depth + 1, True, False) for name in listing(path)]
                opened = True
            pieces = more
        per = max(1, -(-len(pieces) // SUBTREES))
        return [Subtree(i * SPAN, pieces[a : a + per]) for i, a in enumerate(range(0, len(pieces), per))]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(ENTRIES)
        take = iter(range(partition.first, partition.first + SPAN))
        rows: list[tuple] = []
        for path, parent, depth, whole, is_root in partition.pieces:
            for row in walk(path, parent, depth, self.ignored, take) if whole else [row_of(path, parent, depth, next(take), is_root, None)]:
                rows.append(row)
                if len(rows) >= ROWS:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class FileTree(DataSource):
    """Options: root, ignored and slow (paths, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self):
        return ENTRIES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def crawl(spark: SparkSession, root: str, ignored: list[str] = (), slow: list[str] = ()):
    """The entries below a root, and the root."""
    ship(spark)
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("root", root).option("ignored", "\n".join(ignored)).option("slow", "\n".join(slow)).load()


def _mapped(rows, load, schema):
    """mapInArrow under bounded batches, by workers that have this package."""
    spark = rows.sparkSession
    ship(spark)
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    if most is None or not 0 < int(most) <= ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return rows.mapInArrow(load, schema)


def with_contents(rows, whole: bool):
    """The rows with the bytes of regular files, read by the workers where WANTED; null elsewhere and where they cannot
    be. Of a file with a zero byte in its head only that is read, unless whole."""
    from pyspark.sql import types as T

    def bytes_of(path: str, kind: str, wanted: bool) -> bytes | None:
        if kind != "f" or not wanted:
            return None
        try:
            with open(hidden(path), "rb") as f:
                head = f.read(HEAD)
                return head if not whole and b"\0" in head else head + f.read()
        except OSError:
            return None

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, size, at = [], 0, 0
            for i, (path, kind, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "ftype", WANTED)), strict=True), 1):
                data.append(bytes_of(path, kind, wanted))
                size += len(data[-1] or b"")
                if size >= READ_BYTES or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, i - at).columns, pa.array(data, pa.binary())], [*batch.schema.names, "content"])
                    data, size, at = [], 0, i

    return _mapped(rows, load, T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())]))


def refreshed(rows):
    """The rows with what stat and access say now, where WANTED; entries that are gone have nulls."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(ENTRIES)
        live = ENTRIES.fieldNames()[ENTRIES.fieldNames().index("n_children") :]
        for batch in batches:
            at = np.flatnonzero(batch.column(WANTED).to_numpy(zero_copy_only=False))
            fresh = [row_of(hidden(p), None, 0, 0, False, None) for p in batch.column("path").take(pa.array(at)).to_pylist()]
            new = dict(zip(arrow.names, _batch(fresh, arrow).columns, strict=True)) if fresh else {}
            place = np.zeros(batch.num_rows, np.int64)
            place[at] = np.arange(len(at)) + batch.num_rows
            place = pa.array(np.where(place, place, np.arange(batch.num_rows)))
            columns = [pa.concat_arrays([c, new[name].cast(c.type)]).take(place) if name in new and name in live else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return _mapped(rows, load, rows.schema)
