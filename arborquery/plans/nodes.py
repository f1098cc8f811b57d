"""Expressions as immutable trees. Every node knows what Spark has to do for it, so that the least comes first."""

from __future__ import annotations

from dataclasses import dataclass, field


#: What is done for a row: numbers are compared, substrings sought, patterns matched, scores worked out, other rows
#: looked at, contents read.
COMPARE, SEEK, MATCH, SCORE, LOOK_AROUND, READ = range(6)


class Expr:
    """Joined by & | ^ and ~, as the keywords do."""

    #: Whether evaluating the node can be seen, so that nothing may move across it.
    barrier = False
    #: The dearest thing done for a row by the node itself.
    effort = COMPARE

    def __and__(self, other: Expr) -> Expr:
        return And(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Or(self, other)

    def __xor__(self, other: Expr) -> Expr:
        return Xor(self, other)

    def __invert__(self) -> Expr:
        return Not(self)

    @property
    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    @property
    def has_action(self) -> bool:
        return any(isinstance(n, Action) for n in self.walk())

    @property
    def fixed(self) -> bool:
        """Whether the node or any below is a barrier."""
        return any(n.barrier for n in self.walk())

    @property
    def whole_effort(self) -> int:
        """The dearest thing done by the node or any below."""
        return max(n.effort for n in self.walk())


@dataclass(frozen=True)
class Const(Expr):
    value: bool


@dataclass(frozen=True)
class Glob(Expr):
    pattern: str
    target: str = "basename"
    icase: bool = False
    effort = SEEK


@dataclass(frozen=True)
class Contains(Expr):
    needle: str
    target: str = "basename"
    icase: bool = False
    effort = SEEK


@dataclass(frozen=True)
class Regex(Expr):
    pattern: str
    target: str = "path"
    icase: bool = False
    exact: bool = False
    effort = MATCH


@dataclass(frozen=True)
class Fuzzy(Expr):
    needle: str
    target: str = "basename"
    cutoff: float = 85.0
    effort = SCORE


@dataclass(frozen=True)
class Type(Expr):
    kinds: str


@dataclass(frozen=True)
class Number(Expr):
    """field in units against a number: sign "+" for more, "-" for less, "" for as many."""

    field: str
    sign: str
    value: int
    unit: int = 1


@dataclass(frozen=True)
class Empty(Expr):
    """A directory without entries, or a file without bytes."""


@dataclass(frozen=True)
class Access(Expr):
    read: bool = False
    write: bool = False
    execute: bool = False


@dataclass(frozen=True)
class Perm(Expr):
    """Mode bits: how is "" for exactly these, "-" for all of them, "/" for any."""

    bits: int
    how: str = ""


@dataclass(frozen=True)
class Unowned(Expr):
    """No user, or no group, has the entry's id."""

    group: bool = False


@dataclass(frozen=True)
class ContentContains(Expr):
    needle: str
    icase: bool = False
    binary: bool = False
    effort = READ


@dataclass(frozen=True)
class ContentRegex(Expr):
    pattern: str
    icase: bool = False
    binary: bool = False
    effort = READ


@dataclass(frozen=True)
class ContentFuzzy(Expr):
    needle: str
    cutoff: float = 90.0
    binary: bool = False
    effort = READ


@dataclass(frozen=True)
class Custom(Expr):
    """A registered predicate: a function from the entries' columns to a boolean Column."""

    name: str
    arguments: tuple[str, ...]
    build: object = field(compare=False, hash=False, default=None)
    effort = SCORE


@dataclass(frozen=True)
class _Pair(Expr):
    left: Expr
    right: Expr

    @property
    def children(self):
        return self.left, self.right


class And(_Pair):
    """Both hold; the right one is not looked at where the left one fails."""


class Or(_Pair):
    """One holds; the right one is not looked at where the left one does."""


class Xor(_Pair):
    """Exactly one holds."""


def nand(a: Expr, b: Expr) -> Expr:
    return Not(And(a, b))


def nor(a: Expr, b: Expr) -> Expr:
    return Not(Or(a, b))


def xnor(a: Expr, b: Expr) -> Expr:
    return Not(Xor(a, b))


@dataclass(frozen=True)
class _Over(Expr):
    child: Expr

    @property
    def children(self):
        return (self.child,)


class Not(_Over):
    """The child does not hold."""


class UpDir(_Over):
    """The child holds for the entry's parent."""

    effort = LOOK_AROUND


@dataclass(frozen=True)
class DownDir(_Over):
    """The number of direct children for which the child holds is in [least, most]."""

    least: int = 1
    most: int | None = None
    effort = LOOK_AROUND


@dataclass(frozen=True)
class Prune(_Over):
    """Always holds; below a directory for which the child holds nothing is visited."""

    barrier = True


@dataclass(frozen=True)
class Quit(_Over):
    """Holds as the child does; the n-th time that it holds ends the search."""

    n: int = 1
    barrier = True


@dataclass(frozen=True)
class Action(Expr):
    """Something done with every entry that gets here: print, print0, fprint, fprint0, exec, execdir, ok, okdir, delete."""

    kind: str
    arguments: tuple[str, ...] = ()
    batch: bool = False
    dry: bool = False
    barrier = True

