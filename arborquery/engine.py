"""The engine: settings, versions of the index, searches, pages and actions."""

from __future__ import annotations

import atexit
import itertools
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from functools import reduce
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .actions import Runner
from .operators import trigram
from .plans import nodes as n
from .plans.compiler import Compiler, Context, below, with_all_columns
from .plans.parser import parse
from .plans.tokens import tokenize
from .shared import remove, shared_dir
from .sources import crawler

# Keywords of the settings file.
_KEYWORDS = {"DB_PATH": "db_path", "ROOT_PATH": "root_path", "IGNORED_PATH": "ignored", "SLOW_PATH": "slow"}
#: Results of an action that the driver holds before it writes them.
RESULTS = 100_000
LINUX_IGNORED = ["/proc", "/run", "/media", "/mnt", "/tmp", "/var/tmp"]


class SettingsError(ValueError):
    """A settings file that cannot be read."""


class EmptyTree(RuntimeError):
    """A crawl that found too little to be right; the index before it stays."""


def rectify(path: str) -> str:
    """An absolute path without a slash at its end."""
    return "/" + path.strip("/") if path.strip("/") else "/"


def quoted(path: str) -> str:
    """The path as one word of a settings file, in the first quotes that it does not contain, else with them escaped."""
    for mark in "`'\"":
        if mark not in path:
            return f"{mark}{path}{mark}"
    return "".join(f"\\{c}" if c in "`'\" \t\n\\" else c for c in path)


@dataclass
class Settings:
    """Where the index is, what it covers, and where searches start."""

    db_path: str = ""
    root_path: str = "/"
    ignored: list[str] = field(default_factory=list)
    slow: list[str] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)

    @classmethod
    def default(cls) -> Settings:
        home = os.path.expanduser("~/.config/arborquery")
        return cls(os.path.join(home, "default.db"), "/", list(LINUX_IGNORED))

    @classmethod
    def load(cls, path: str) -> Settings:
        """Keywords and values in turn; DB_PATH comes first, words that are no keyword are skipped."""
        with open(path) as f:
            tokens = tokenize(f.read())
        out = cls()
        it = iter(tokens)
        for word in it:
            name = _KEYWORDS.get(word)
            if name is None:
                continue
            value = next(it, None)
            if value is None:
                raise SettingsError(f"{word} without a value")
            if name != "db_path" and not out.db_path:
                raise SettingsError("DB_PATH must come first")
            if name == "db_path":
                out.db_path = value
            elif name == "root_path":
                out.root_path = rectify(value)
            else:
                getattr(out, name).append(rectify(value))
        if not out.db_path:
            raise SettingsError("no DB_PATH")
        return out

    def save(self, path: str) -> None:
        lines = [f"DB_PATH {quoted(self.db_path)}", f"ROOT_PATH {quoted(self.root_path)}"]
        lines += [f"IGNORED_PATH {quoted(p)}" for p in self.ignored] + [f"SLOW_PATH {quoted(p)}" for p in self.slow]
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")

    def add(self, kind: str, path: str) -> Settings:
        """Adds a path to ignored, slow or starts."""
        self._list(kind).append(rectify(path))
        return self

    def erase(self, kind: str, path: str) -> Settings:
        found = self._list(kind)
        found[:] = [p for p in found if p != rectify(path)]
        return self

    def _list(self, kind: str) -> list[str]:
        if kind not in {f.name for f in fields(self)} - {"db_path", "root_path"}:
            raise KeyError(kind)
        return getattr(self, kind)


class Store:
    """Versions of an index in a folder of any file system Spark knows; a pointer names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The current version's folder: the pointer with the greatest number."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        pointers = sorted(x for x in names if x.startswith("current-"))
        return f"{self.path}/version-{pointers[-1].removeprefix('current-')}" if pointers else None

    def new(self) -> str:
        return f"{self.path}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def switch(self, version: str, keep: int = 2) -> None:
        """Makes a finished version current; searches under way keep theirs, older ones but a few go."""
        name = version.rpartition("/version-")[2]
        self._fs.create(self._path(f"{self.path}/current-{name}")).close()
        root = self._path(self.path)
        pointers = sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.getPath().getName().startswith("current-"))
        for old in pointers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/version-{old.removeprefix('current-')}"), True)
            self._fs.delete(self._path(f"{self.path}/{old}"), False)

    def drop(self, version: str) -> None:
        self._fs.delete(self._path(version), True)


class Engine:
    """Searches an index of a file tree, or any table of entries."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, entries: DataFrame | None = None):
        self.spark, self.settings, self.own = spark, settings or Settings(), entries

    @classmethod
    def default(cls, spark: SparkSession) -> Engine:
        return cls(spark, Settings.default())

    # the index

    @property
    def store(self) -> Store:
        return Store(self.spark, self.settings.db_path)

    def has_data(self) -> bool:
        return self.own is not None or bool(self.settings.db_path and self.store.current())

    def update(self, with_postings: bool = True) -> str:
        """Crawls the tree into a new version and makes it current; if that fails the one before stays."""
        store = self.store
        version = store.new()
        try:
            found = crawler.crawl(self.spark, self.settings.root_path, self.settings.ignored, self.settings.slow)
            # sorted by path within files: a start path and a name's prefix skip row groups
            found.sortWithinPartitions("path").write.option("compression", "zstd").parquet(f"{version}/entries")
            entries = self.spark.read.parquet(f"{version}/entries")
            if entries.limit(3).count() < 3:
                raise EmptyTree(self.settings.root_path)
            if with_postings:
                trigram.postings(entries.filter("NOT is_root")).sort("trigram", "entry_id").write.option("compression", "zstd").parquet(f"{version}/postings")
        except BaseException:
            store.drop(version)
            raise
        store.switch(version)
        return version

    def entries(self) -> DataFrame:
        """The current version's entries."""
        if self.own is not None:
            return self.own
        version = self.store.current()
        if version is None:
            raise FileNotFoundError(f"no index in {self.settings.db_path}")
        return self.spark.read.parquet(f"{version}/entries")

    def postings(self) -> DataFrame:
        version = None if self.own is not None else self.store.current()
        return trigram.postings(self.entries()) if version is None else self.spark.read.parquet(f"{version}/postings")

    # searching

    def starts(self, starts: list[str] | None = None) -> list[str]:
        """Start paths, those above the root replaced by it."""
        root = rectify(self.settings.root_path)
        out = []
        for path in map(rectify, starts if starts is not None else self.settings.starts or [root]):
            out.append(root if root == path or root.startswith(path.rstrip("/") + "/") else path)
        return out

    def context(self, live: bool = False, **options) -> Context:
        own = self.own is not None
        return Context(with_all_columns(self.entries()), load_content=None if own else crawler.with_contents, load_stats=crawler.refreshed if live and not own else None, **options)

    def _each(self, tree: n.Expr, starts: list[str] | None, use_index: bool, options: dict) -> list[DataFrame]:
        context = self.context(**options)
        out = []
        for path in self.starts(starts):
            start = None if path == rectify(self.settings.root_path) and self.own is None else below(path)
            proposed = trigram.indexed(context.entries, self.postings(), tree) if use_index else None
            out.append(Compiler(context).search(tree, start, proposed))
        return out

    def search(self, expression: str | list[str] | n.Expr, starts: list[str] | None = None, use_index: bool = False, **options) -> DataFrame:
        """The matches below each start, one after the other; nested starts repeat what they share.

        use_index: what the trigram index proposes is searched instead of all entries, with the same rows.
        Options: now, inclusive_quit, live (sizes, times, owners and permissions of now instead of the index's).
        """
        tree = expression if isinstance(expression, n.Expr) else parse(expression)
        return reduce(DataFrame.unionByName, self._each(tree, starts, use_index, options))

    def children(self, path: str) -> DataFrame:
        """The entries directly in a directory."""
        parent = rectify(path)
        return self.entries().filter((F.col("parent_path") == parent) & ~F.coalesce(F.col("is_root"), F.lit(False)))

    def pages(self, expression: str | list[str] | n.Expr, size: int, starts: list[str] | None = None, **options) -> Iterator[list]:
        """The matches in order of the walk, a page at a time; the search is run and sorted once, and the driver holds a
        page and one partition of what is sorted."""
        tree = expression if isinstance(expression, n.Expr) else parse(expression)
        for found in self._each(tree, starts, False, options):
            rows = found.orderBy("entry_id").toLocalIterator()
            while page := list(itertools.islice(rows, size)):
                yield page

    def run(self, expression: str | list[str] | n.Expr, callback: Callable | None = None, starts: list[str] | None = None, out: TextIO | None = None, confirm: Callable[[str], bool] | None = None, tag: str | None = None, **options) -> int:
        """Does what the expression's actions say, or prints the matches, or calls back with them; how many there were.

        A tag names the jobs, so that cancel(tag) ends them from another thread.
        """
        tree = expression if isinstance(expression, n.Expr) else parse(expression)
        if tag:
            self.spark.addTag(tag)
        try:
            total = 0
            for path in self.starts(starts):
                start = None if path == rectify(self.settings.root_path) and self.own is None else below(path)
                total += self._run_below(tree, start, callback, out, confirm, options)
            return total
        finally:
            if tag:
                self.spark.removeTag(tag)

    def _run_below(self, tree, start, callback, out, confirm, options) -> int:
        context = self.context(**options)
        compiler = Compiler(context)
        actions = compiler.reached(tree, n.Action)
        order = [x for x, _ in compiler.reached(tree, n.Action | n.Quit)]
        for action, reach in actions:
            late = any(isinstance(x, n.Quit) for x in order[order.index(action) :])
            context.inclusive_quit = options.get("inclusive_quit", False) or late  # what stands before -quit sees the entry that ends it
            rows = self._rows(compiler, tree, start)
            found = compiler.filtered(rows, reach).orderBy("entry_id").select("entry_id", "path", "ftype").toLocalIterator()
            context.done[id(action)] = self._kept(Runner(action, out, confirm).over(found))
        context.inclusive_quit = options.get("inclusive_quit", False)
        matches = compiler.filtered(self._rows(compiler, tree, start), tree)
        if callback is None and actions:
            return matches.count()
        total = 0
        for row in matches.orderBy("entry_id").toLocalIterator():
            total += 1
            callback(row) if callback else (out or __import__("sys").stdout).write(row.path + "\n")
        return total

    def _kept(self, results: Iterator[tuple[int, bool]]) -> DataFrame:
        """The entries that an action succeeded for; the driver holds RESULTS of them at a time."""
        schema, path = "entry_id long, ok boolean", f"{shared_dir(self.spark)}/action-{uuid.uuid4().hex}"
        atexit.register(remove, self.spark, path)
        good = (r for r in results if r[1])
        part = list(itertools.islice(good, RESULTS))
        if len(part) < RESULTS:
            return self.spark.createDataFrame(part, schema)
        while part:
            self.spark.createDataFrame(part, schema).write.mode("append").parquet(path)
            part = list(itertools.islice(good, RESULTS))
        return self.spark.read.schema(schema).parquet(path)

    @staticmethod
    def _rows(compiler: Compiler, tree: n.Expr, start) -> DataFrame:
        rows = compiler.context.entries.filter(~F.coalesce(F.col("is_root"), F.lit(False)))
        return compiler.visited(tree, rows if start is None else rows.filter(start))

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)
