"""From trees to DataFrames over the entries table.

Predicates become columns. -updir and -downdir look at other entries: where they are plain conjuncts they become semi
joins, elsewhere left joins that add a boolean marker. -prune and -quit depend on the order of evaluation: each gets
the condition under which it is reached, from its left neighbours; pruned subtrees go by an anti join on directories,
whose ancestors are looked up by an equi-join; -quit cuts at the entry_id of its n-th hit. Below a negation leaves are made sure, null being false; elsewhere they
may be null, which selects nothing just so and lets filters reach the scan.
"""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy, glob
from . import nodes as n
from .errors import IncompletePredicate, InvalidParameter
from .rewrite import flatten, optimize

#: Columns of entries; what a table lacks is taken as null, and the predicates that need it do not hold.
_TYPES = {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
ENTRIES = T.StructType(
    [
        T.StructField(name, _TYPES[kind])
        for kind, names in (
            ("long", "entry_id"), ("string", "ftype path basename parent_path"), ("int", "depth"), ("boolean", "is_root"), ("int", "n_children"), ("long", "size inode"), ("int", "mode uid gid"),
            ("timestamp", "atime mtime ctime"), ("string", "link_target"), ("boolean", "r_ok w_ok x_ok user_known group_known stat_ok"),
        )
        for name in names.split()
    ]
)

_ids = itertools.count()

CONTENTS = n.ContentContains | n.ContentRegex | n.ContentFuzzy
STATS = n.Empty | n.Access | n.Perm | n.Unowned
WANTED = "_wanted"


def needs_stats(node: n.Expr) -> bool:
    return isinstance(node, STATS) or (isinstance(node, n.Number) and node.field != "depth")


def needs_content(node: n.Expr) -> bool:
    return isinstance(node, CONTENTS)


def bound(node: n.Expr, unknown: Callable[[n.Expr], bool], upper: bool) -> n.Expr:
    """What holds whenever the tree may hold (upper), or only where it must hold, whatever the unknown leaves say."""
    if isinstance(node, n.UpDir | n.DownDir):  # other rows' predicates are worked out apart
        return node
    if unknown(node):
        return n.Const(upper)
    if isinstance(node, n.Not):
        return n.Not(bound(node.child, unknown, not upper))
    if isinstance(node, n.And | n.Or):
        return type(node)(bound(node.left, unknown, upper), bound(node.right, unknown, upper))
    if isinstance(node, n.Xor):
        return n.Const(upper) if _open(node, unknown) else node
    if isinstance(node, n.Quit):
        return bound(node.child, unknown, upper)
    return node


def _open(node: n.Expr, unknown: Callable[[n.Expr], bool]) -> bool:
    """Whether the tree has an unknown leaf of the row's own."""
    return unknown(node) or (not isinstance(node, n.UpDir | n.DownDir) and any(_open(c, unknown) for c in node.children))


@dataclass
class Context:
    """What a query is compiled with: all entries (roots included), the time it runs at, and how what the table lacks, or
    had when it was made, is read.

    load_content and load_stats take rows with a boolean column WANTED. They come after every predicate that can do
    without them: load_content(rows, whole) adds contents, of binary files their head alone unless whole;
    load_stats(rows) puts what the file system says now in place of the table's columns.
    """

    entries: DataFrame
    now: float = field(default_factory=time.time)
    load_content: Callable[[DataFrame, bool], DataFrame] | None = None
    load_stats: Callable[[DataFrame], DataFrame] | None = None
    inclusive_quit: bool = False
    #: Markers of actions that have run: (entry_id, column) tables by action.
    done: dict[int, DataFrame] = field(default_factory=dict)


def with_all_columns(df: DataFrame) -> DataFrame:
    """The table with every column of entries, null where it has none; others stay."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRIES if f.name not in df.columns]
    return df.select("*", *missing) if missing else df


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def regex_source(pattern: str, icase: bool, exact: bool = False, flags: str = "") -> str:
    flags += "i" if icase else ""
    body = f"\\A(?:{pattern})\\z" if exact else pattern
    return f"(?{flags}){body}" if flags else body


def number(column: Column, node: n.Number) -> Column:
    """A size in units, rounded up, against a number: as a range of the column, so that scans can skip."""
    value, unit = node.value, node.unit
    if unit == 1:
        return {"": column == value, "+": column > value, "-": column < value}[node.sign]
    if node.sign == "+":
        return column > value * unit
    if node.sign == "-":
        return column <= (value - 1) * unit
    return (column > (value - 1) * unit) & (column <= value * unit)


def age(column: Column, node: n.Number, now: float) -> Column:
    """The whole units since a time against a number, as a range of the time."""
    at = lambda units: F.timestamp_seconds(F.lit(float(now) - units * node.unit))
    value = node.value
    if node.sign == "+":
        return column <= at(value + 1)
    if node.sign == "-":
        return column > at(value)
    return (column > at(value + 1)) & (column <= at(value))


def ancestors(path: Column) -> Column:
    """The paths of all proper ancestors of an absolute path, the root directory's own among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


class Compiler:
    def __init__(self, context: Context):
        self.context = context
        self.markers: dict[tuple, str] = {}
        self.plain = True

    def sure(self, c: Column) -> Column:
        """A leaf: false for null where something negates it."""
        return c if self.plain else _sure(c)

    # leaves

    def leaf(self, node: n.Expr) -> Column:
        c = F.col
        if isinstance(node, n.Const):
            return F.lit(node.value)
        if isinstance(node, n.Glob | n.Contains | n.Regex | n.Fuzzy):
            return self.name(node)
        if isinstance(node, n.Type):
            return self.sure(c("ftype").isin(*node.kinds))
        if isinstance(node, n.Number):
            if node.field.endswith("time"):
                return self.sure(age(c(node.field), node, self.context.now))
            return self.sure(number(c(node.field), node))
        if isinstance(node, n.Empty):
            return self.sure(F.when(c("ftype") == "d", c("n_children") == 0).otherwise(c("size") == 0))
        if isinstance(node, n.Access):
            modes = [c(f"{m}_ok") for m, on in (("r", node.read), ("w", node.write), ("x", node.execute)) if on]
            return self.sure(self._all_of(modes))
        if isinstance(node, n.Perm):
            bits = c("mode").bitwiseAND(0o7777)
            own = bits.bitwiseAND(node.bits)
            return self.sure({"": bits == node.bits, "-": own == node.bits, "/": own != 0}[node.how])
        if isinstance(node, n.Unowned):
            return ~F.coalesce(c("group_known" if node.group else "user_known"), F.lit(True))
        if isinstance(node, n.ContentContains | n.ContentRegex | n.ContentFuzzy):
            return self.content(node)
        if isinstance(node, n.Custom):
            return self.sure(node.build(c, *node.arguments))
        raise TypeError(type(node).__name__)

    @staticmethod
    def _all_of(columns: list[Column]) -> Column:
        out = columns[0]
        for x in columns[1:]:
            out &= x
        return out

    def name(self, node) -> Column:
        if isinstance(node, n.Regex):
            try:
                re.compile(node.pattern)
            except re.error as e:
                if not re.search(r"\\[pPzZGQEhHvVRX]|\(\?<|[*+?}]\+", node.pattern):  # what only the JVM's dialect knows
                    raise InvalidParameter(f"{node.pattern}: {e}") from None
        column = F.col({"basename": "basename", "path": "path", "link": "link_target"}[node.target])
        if isinstance(node, n.Glob):
            held = glob.matches(column, node.pattern, node.icase)
        elif isinstance(node, n.Contains):
            held = glob.fold_ascii(column).contains(glob.fold_literal(node.needle)) if node.icase else column.contains(node.needle)
        elif isinstance(node, n.Regex):
            held = column.rlike(regex_source(node.pattern, node.icase, node.exact))
        else:
            if not node.needle:
                raise IncompletePredicate("-fuzz")
            score = fuzzy.similarity(column, node.needle) if len(node.needle) <= fuzzy.LONGEST else fuzzy.similarity_udf(node.needle)(column)
            held = (F.length(column) >= len(node.needle) - 2) & (score > node.cutoff)
        if node.target == "link":  # a link that cannot be read matches
            return self.sure((F.col("ftype") == "l") & F.coalesce(held, F.lit(True)))
        return self.sure(held)

    def content(self, node) -> Column:
        content = F.col("content")
        text = F.decode(content, "UTF-8") if self.binary_content else content
        head = F.substring(content if self.binary_content else F.encode(content, "UTF-8"), 1, 4096)
        plain = F.instr(F.decode(head, "ISO-8859-1"), "\0") == 0
        if isinstance(node, n.ContentContains):
            held = glob.fold_ascii(text).contains(glob.fold_literal(node.needle)) if node.icase else text.contains(node.needle)
        elif isinstance(node, n.ContentRegex):
            held = text.rlike(regex_source(node.pattern, node.icase, flags="m"))
        else:
            if not node.needle:
                raise IncompletePredicate("-content-fuzz")
            # a UDF is run on whatever reaches it, so files alone are given to it
            given = F.when((F.col("ftype") == "f") & (plain | node.binary), text)
            held = (F.octet_length(text) >= 5) & (fuzzy.similarity_udf(node.needle)(given) >= node.cutoff)
        return self.sure((F.col("ftype") == "f") & (held if node.binary else plain & held))

    # trees

    def column(self, df: DataFrame, node: n.Expr) -> tuple[DataFrame, Column]:
        """The table with what markers the tree needs, and the tree as a column."""
        if isinstance(node, n.Not | n.Xor):
            before, self.plain = self.plain, False
            try:
                df, *both = self._operands(df, node)
            finally:
                self.plain = before
            return df, ~both[0] if isinstance(node, n.Not) else both[0] != both[1]
        if isinstance(node, n.And | n.Or):
            df, x, y = self._operands(df, node)
            return df, x & y if isinstance(node, n.And) else x | y
        if isinstance(node, n.UpDir | n.DownDir):
            keys, key = self.keys(node)
            keys = keys.distinct()
            name = self.markers.setdefault((node, key), f"_marker{next(_ids)}")
            if name not in df.columns:
                df = df.join(keys.select(F.col("key").alias(f"{name}_key"), F.lit(True).alias(name)), F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
            return df, _sure(F.col(name))
        if isinstance(node, n.Prune):
            return df, F.lit(True)
        if isinstance(node, n.Quit):
            return self.column(df, node.child)
        if isinstance(node, n.Action):
            if id(node) in self.context.done:
                name = f"_done{next(_ids)}"
                table = self.context.done[id(node)].select(F.col("entry_id").alias(f"{name}_id"), F.col("ok").alias(name))
                return df.join(table, F.col("entry_id") == F.col(f"{name}_id"), "left").drop(f"{name}_id"), _sure(F.col(name))
            return df, F.lit(True)
        return df, self.leaf(node)

    def _operands(self, df: DataFrame, node: n.Expr) -> tuple:
        """The table with their markers, and the children as columns."""
        columns = []
        for child in node.children:
            df, x = self.column(df, child)
            columns.append(x)
        return df, *columns

    def keys(self, node: n.UpDir | n.DownDir) -> tuple[DataFrame, str]:
        """The keys for which the modifier holds, and the column that they are looked up by; some may come again."""
        inner = self.filtered(self.context.entries, node.child)
        if isinstance(node, n.UpDir):
            return inner.select(F.col("path").alias("key")), "parent_path"
        inner = inner.filter(~_sure(F.col("is_root"))).select(F.col("parent_path").alias("key"))
        if node.least <= 1 and node.most is None:
            return inner.filter("key IS NOT NULL"), "path"
        counts = inner.groupBy("key").agg(F.count("*").alias("children"))
        held = F.col("children") >= max(1, node.least)
        if node.most is not None:
            held &= F.col("children") <= node.most
        return counts.filter(held).select("key"), "path"

    def filtered(self, df: DataFrame, node: n.Expr) -> DataFrame:
        """The rows for which the tree holds: conjuncts that look at other entries as semi joins, the rest in order;
        what is not in the table is read for rows that all else lets pass, where it decides."""
        before, self.plain = self.plain, True
        try:
            return self._filtered(df, node)
        finally:
            self.plain = before

    def _filtered(self, df: DataFrame, node: n.Expr) -> DataFrame:
        columns = df.columns
        parts = flatten(node, n.And)
        loads = [(needs_stats, lambda rows, _: self.context.load_stats(rows))] if self.context.load_stats else []
        if "content" not in columns:
            loads.append((needs_content, self.load_content))
        for i, (_, load) in enumerate(loads):
            later = [test for test, _ in loads[i:]]
            unknown = lambda x, later=later: any(test(x) for test in later)
            rest = [p for p in parts if _open(p, unknown)]
            df = self._held(df, [p for p in parts if p not in rest])
            parts = rest
            if any(_open(p, later[0]) for p in rest):
                df = self._held(df, [optimize(bound(p, unknown, True)) for p in rest])
                df, sure = self.column(df, optimize(self._all([bound(p, unknown, False) for p in rest])))
                df = load(df.withColumn(WANTED, ~_sure(sure)), node).drop(WANTED)
        df = self._held(df, parts)
        return df.drop(*(c for c in df.columns if c not in columns))

    def _held(self, df: DataFrame, parts: list[n.Expr]) -> DataFrame:
        """The rows for which all parts hold."""
        held = None
        for part in parts:
            if not isinstance(part, n.UpDir | n.DownDir):
                df, x = self.column(df, part)
                held = x if held is None else held & x
        if held is not None:
            df = df.filter(held)
        for part in parts:
            if isinstance(part, n.UpDir | n.DownDir):
                keys, key = self.keys(part)
                df = df.join(keys, df[key] == keys["key"], "left_semi")
        return df

    def load_content(self, df: DataFrame, tree: n.Expr) -> DataFrame:
        if self.context.load_content is None:
            raise InvalidParameter("this table has no contents")
        return self.context.load_content(df, any(isinstance(x, CONTENTS) and x.binary for x in tree.walk()))

    @property
    def binary_content(self) -> bool:
        entries = self.context.entries
        return "content" not in entries.columns or isinstance(entries.schema["content"].dataType, T.BinaryType)

    def reached(self, tree: n.Expr, kind: type) -> list[tuple[n.Expr, n.Expr]]:
        """(node, the condition under which it is evaluated) of every node of a kind, in order of evaluation."""
        out: list[tuple[n.Expr, n.Expr]] = []

        def walk(node: n.Expr, reach: list[n.Expr]) -> None:
            if isinstance(node, kind):
                out.append((node, n.And(*reach) if len(reach) == 2 else self._all(reach)))
            if isinstance(node, n.And | n.Or | n.Xor):
                walk(node.left, reach)
                more = [node.left] if isinstance(node, n.And) else [n.Not(node.left)] if isinstance(node, n.Or) else []
                walk(node.right, [*reach, *more])
            elif isinstance(node, n.Not | n.Quit | n.Prune):
                walk(node.child, reach)

        walk(tree, [])
        return out

    @staticmethod
    def _all(parts: list[n.Expr]) -> n.Expr:
        out: n.Expr = n.Const(True)
        for p in parts:
            out = p if isinstance(out, n.Const) else n.And(out, p)
        return out

    def visited(self, tree: n.Expr, start: DataFrame) -> DataFrame:
        """The rows of start outside pruned subtrees and before the search quits."""
        rows = start
        for prune, reach in self.reached(tree, n.Prune):
            pruned = self.filtered(start.filter("ftype = 'd'"), optimize(n.And(reach, prune.child))).select(F.col("path").alias("pruned"))
            # of directories alone, which are few, all ancestors are looked up; their entries then go by parent
            folders = rows.select("parent_path").distinct()
            above = F.array_append(ancestors(F.col("parent_path")), F.col("parent_path"))
            cut = folders.select(F.col("parent_path").alias("below"), F.explode(above).alias("pruned")).join(pruned, "pruned", "left_semi")
            rows = rows.join(cut, rows["parent_path"] == cut["below"], "left_anti")
        for quit_, reach in self.reached(tree, n.Quit):
            hits = self.filtered(rows, optimize(n.And(reach, quit_.child))).select("entry_id").orderBy("entry_id").limit(quit_.n)
            # the n-th hit, or null: a scalar subquery
            last = hits.agg(F.when(F.count("*") >= quit_.n, F.max("entry_id"))).scalar()
            here = F.col("entry_id")
            rows = rows.filter(last.isNull() | (here <= last if self.context.inclusive_quit else here < last))
        return rows

    def search(self, tree: n.Expr, start: Column | None = None, proposed: DataFrame | None = None) -> DataFrame:
        """The entries below a start that the tree holds for; proposed: some rows that have them all."""
        tree = optimize(tree)
        rows = (self.context.entries if proposed is None else proposed).filter(~_sure(F.col("is_root")))
        if start is not None:
            rows = rows.filter(start)
        return self.filtered(self.visited(tree, rows), tree)


def below(path: str) -> Column:
    """Whether an entry lies below a directory; a range on path, so that scans can skip."""
    return F.lit(True) if path == "/" else F.col("path").startswith(f"{path}/")


def compile_search(entries: DataFrame, tree: n.Expr, start: Column | None = None, **options) -> DataFrame:
    """The matching entries of a table."""
    return Compiler(Context(with_all_columns(entries), **options)).search(tree, start)
