"""Tokens, trees and mistakes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborquery.plans import errors as e
from arborquery.plans import nodes as n
from arborquery.plans.parser import mode_bits, parse, register_predicate, signed
from arborquery.plans.rewrite import flatten, optimize
from arborquery.plans.tokens import tokenize


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("", []),
        ("a  b\tc\n", ["a", "b", "c"]),
        ("'a b' \"c d\" `e f`", ["a b", "c d", "e f"]),
        (r"a\ b 'c\d' \'", ["a b", r"c\d", "'"]),
        ("a'b'c ''", ["abc", ""]),
        ("\"it's\"", ["it's"]),
    ],
)
def test_tokens(text, tokens):
    assert tokenize(text) == tokens


@pytest.mark.parametrize("text", ["'a", 'b"', "`", "a\\"])
def test_unbalanced_quotes(text):
    with pytest.raises(e.UnbalancedQuotes):
        tokenize(text)


def value(tree):
    if isinstance(tree, n.Const):
        return tree.value
    if isinstance(tree, n.Not):
        return not value(tree.child)
    a, b = value(tree.left), value(tree.right)
    return {n.And: a and b, n.Or: a or b, n.Xor: a != b}[type(tree)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("-true", True),
        ("! -true", False),
        ("-not -not -true", True),
        ("-true -false", False),
        ("-true -a -false -o -true", True),
        ("-true -o -false -a -false", True),
        ("( -true -o -false ) -a -false", False),
        ("! ( -true -a -false )", True),
        ("! -false -a -true", True),
        ("( ( -false ) -or ( -true ) ) -and ! ( -false )", True),
    ],
)
def test_constant_expressions(text, expected):
    tree = parse(text)
    assert value(tree) is expected and value(parse(text.split())) is expected
    assert optimize(tree) == n.Const(expected)


@pytest.mark.parametrize(
    "text, error",
    [
        ("-nothing", e.UnknownPredicate),
        ("word", e.UnknownPredicate),
        ("-context x", e.UnknownPredicate),
        ("-true -a", e.MissingPredicate),
        ("-a -true", e.MissingPredicate),
        ("-true -o -o -true", e.MissingPredicate),
        ("!", e.MissingPredicate),
        ("-updir", e.MissingPredicate),
        ("( -true", e.UnbalancedParentheses),
        ("-true )", e.UnbalancedParentheses),
        (")", e.UnbalancedParentheses),
        ("( )", e.EmptyParentheses),
        ("-size", e.IncompletePredicate),
        ("-name", e.IncompletePredicate),
        ("-size x", e.NotANumber),
        ("-size 1.5k", e.NotANumber),
        ("-uid 5x", e.NotANumber),
        ("-user no-such-user-here", e.NotANumber),
        ("-perm 99", e.NotANumber),
        ("-perm u+q", e.InvalidParameter),
        ("-type xyz", e.InvalidParameter),
        ("-name --wrong x", e.InvalidParameter),
        ("-fuzz --cutoff 101 x", e.InvalidParameter),
        ("-fuzz --cutoff x x", e.NotANumber),
        ("-access", e.IncompletePredicate),
        ("-exec", e.IncompletePredicate),
        ("-exec echo {}", e.IncompletePredicate),
        ("-printf %p", e.UnsupportedPredicate),
        ("-ls", e.UnsupportedPredicate),
    ],
)
def test_mistakes(text, error):
    with pytest.raises(error):
        parse(text)


def test_joining_can_be_switched_off():
    with pytest.raises(e.MissingOperator):
        parse("-true -false", implicit=False)
    assert parse("-true -a -false", implicit=False) == n.And(n.Const(True), n.Const(False))


def test_options_and_numbers():
    assert parse("-name --full --ignore-case x") == n.Glob("x", "path", True)
    assert parse("-lname x") == parse("-name --readlink x") == n.Glob("x", "link")
    assert parse("-ipath x") == n.Glob("x", "path", True)
    assert parse("-regex x") == n.Regex("x", "path") and parse("-ibregex --exact x") == n.Regex("x", "basename", True, True)
    assert parse("-size +3M") == n.Number("size", "+", 3, 1 << 20) and parse("-size 3") == n.Number("size", "", 3, 512)
    assert parse("-mnewer -5") == parse("-mmin -5") == n.Number("mtime", "-", 5, 60)
    assert parse("-downdir +2 -5 -true") == n.DownDir(n.Const(True), 3, 5) and parse("-downdir 2 -true") == n.DownDir(n.Const(True), 2, 2)
    assert parse("-content-strstr --allow-binary --blocked x") == n.ContentContains("x", False, True)
    assert parse("-exec rm {} + -a -print") == n.And(n.Action("exec", ("rm", "{}"), True), n.Action("print"))
    assert parse("-delete --dryrun").has_action and not parse("-true").has_action
    assert signed("+7") == ("+", 7)
    assert mode_bits("-755") == (0o755, "-") and mode_bits("u+rw,g+r,o+r") == (0o644, "") and mode_bits("/a=x") == (0o111, "/") and mode_bits("000") == (0, "")


def test_python_operators_and_registration():
    a, b = parse("-true"), parse("-false")
    assert (a & b, a | b, a ^ b, ~a) == (n.And(a, b), n.Or(a, b), n.Xor(a, b), n.Not(a))
    register_predicate("-longer", 1, lambda c, text: c("basename") > text)
    assert parse("-longer x").arguments == ("x",)


LEAVES = st.sampled_from([n.Const(True), n.Const(False), n.Glob("a*"), n.Type("f"), n.Regex("x"), n.Contains("long needle"), n.Prune(n.Const(True)), n.Quit(n.Glob("q"), 2)])
TREES = st.recursive(LEAVES, lambda c: st.one_of(st.builds(n.And, c, c), st.builds(n.Or, c, c), st.builds(n.Xor, c, c), st.builds(n.Not, c)), max_leaves=10)


@settings(max_examples=400, deadline=None)
@given(TREES, st.dictionaries(st.sampled_from(["a*", "f", "x", "long needle", "q"]), st.booleans()))
def test_optimizing_changes_no_value(tree, truth):
    def held(t):
        if isinstance(t, n.And | n.Or | n.Xor | n.Not | n.Const) and type(t) is not n.Const:
            if isinstance(t, n.Not):
                return not held(t.child)
            a, b = held(t.left), held(t.right)
            return {n.And: a and b, n.Or: a or b, n.Xor: a != b}[type(t)]
        if isinstance(t, n.Const):
            return t.value
        if isinstance(t, n.Prune):
            return True
        key = t.child.pattern if isinstance(t, n.Quit) else getattr(t, "pattern", getattr(t, "kinds", getattr(t, "needle", "")))
        return truth.get(key, False)

    assert held(optimize(tree)) == held(tree)


def test_cheap_predicates_go_first_but_not_past_barriers():
    tree = optimize(parse("-content-regex x -a -name abcdef* -a -type d"))
    assert [type(p) for p in flatten(tree, n.And)] == [n.Type, n.Glob, n.ContentRegex]
    tree = optimize(parse("-content-regex x -a -print -a -type d"))
    assert [type(p) for p in flatten(tree, n.And)] == [n.ContentRegex, n.Action, n.Type]
