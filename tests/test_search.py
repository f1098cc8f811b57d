"""Searches over a crawled tree against known counts."""

import os
import random
import time

import pytest

from arborquery.engine import Engine, Settings
from arborquery.operators import trigram
from arborquery.plans.compiler import WANTED
from arborquery.plans.parser import parse

from .tree import make_tree, write


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree") / "root")
    os.umask(0o022)
    make_tree(root, 5)
    write(f"{root}/dir1/file0", "z" * 5000 + "\nHello\nWorld\n")
    write(f"{root}/dir2/file0", "z" * 10000 + "\nHello\nWorld\n")
    write(f"{root}/dir3/file0", "Hello\nWorld!\n\0" * 10)
    write(f"{root}/dir0/largeSize", " " * 69420)
    os.remove(f"{root}/dir0/largeSize")
    out = Engine(spark, Settings(str(tmp_path_factory.mktemp("db") / "index"), root))
    out.update()
    return out


def count(engine, expression, **options):
    return engine.search(expression, **options).count()


# Expressions and how many entries of the tree they hold for.
@pytest.mark.parametrize(
    "expression, rows",
    [
        ("", 64),
        ("-name file?", 31),
        ("-strstr ymli", 2),
        (r"-bregex 'file\d'", 31),
        ("-fuzz symlink", 2),
        ("-fuzz simlynk", 0),
        ("-fuzz --cutoff 65 simlynk", 2),
        ("-name --ignore-case --full *DiR4*", 32),
        ("-iregex .*DiR[0-4].*", 59),
        ("-strstr --readlink file1", 2),
        ("-lname *file1", 2),
        ("-bregex --readlink file1", 2),
        ("-type f", 31),
        ("-type l", 2),
        ("-type d", 31),
        ("-type l,f", 33),
        ("-type f,d", 62),
        ("-type f,l,d", 64),
        ("-mmin +0", 0),
        ("-amin -2", 64),
        ("-perm u+rw,g+r,o+r", 33),
        ("-perm /go+w,", 0),
        ("-perm -0555", 31),
        ("-updir -strstr dir2", 16),
        ("-updir ( -strstr dir2 ) -a -type f", 8),
        ("-downdir -type l", 2),
        ("-downdir -true", 15),
        ("-downdir -downdir -type l", 1),
        ("( -name dir4 -a -prune -a -false ) -o -name file0", 8),
        ("-prunemod -name dir4 -a -name file0", 8),
        ("-name file0 -a -quit 6", 5),
        ("-quitmod 4 -name file0", 3),
        ("-quitmod -name file0", 0),
        ("-quitmod 6 -name dir3", 2),
        ("-content-strstr 'Hello\nWorld'", 2),
        ("-content-strstr --binary --ignore-case 'hello\nworld'", 3),
        ("-content-regex --ignore-case He.lO", 2),
        ("-content-regex z{5001}", 1),
        ("-content-fuzz --binary HelloWorld", 3),
        ("-content-fuzz HalloWould", 0),
        ("-content-fuzz --cutoff 65 HalloWould", 2),
        ("-empty -a -type d", 16),
        ("-readable", 64),
        ("-nouser", 0),
        ("-depth 1", 10),
    ],
)
def test_counts(engine, expression, rows):
    assert count(engine, expression) == rows


def test_sizes(spark, tmp_path):
    root = str(tmp_path / "root")
    make_tree(root, 5)
    write(f"{root}/dir1/file0", " " * 69420)
    engine = Engine(spark, Settings(str(tmp_path / "db"), root))
    engine.update()
    files = "-type f -a "
    assert [count(engine, files + e) for e in ("-size 68k", "-size 136", "-size +60k", "-size -68k", "-size 0", "-empty")] == [1, 1, 1, 30, 30, 30]
    inode = os.stat(f"{root}/dir1/file0").st_ino
    assert count(engine, f"-inode {inode}") == 1 and count(engine, f"-samefile {root}/dir1/file0") == 1
    assert count(engine, f"-uid {os.getuid()}") == 64


def test_now_and_inclusive_quit(engine):
    assert count(engine, "-mtime +9", now=time.time() + 11 * 86400) == 64
    assert count(engine, "-quitmod 4 -name file0", inclusive_quit=True) == 4


def test_index_equals_scan(engine):
    for expression in ("-name file?", "-strstr ymli", "-fuzz symlink", "-fuzz --cutoff 65 simlynk", "-iname *SYM*", "-path *dir4/file0", "-type f -a -istrstr ILE0", "-name x"):
        assert sorted(r.path for r in engine.search(expression, use_index=True).collect()) == sorted(r.path for r in engine.search(expression).collect()), expression


def test_entry_ids_follow_the_walk(engine):
    rows = engine.search("").orderBy("entry_id").collect()
    order = [r.path for r in rows]
    assert sorted(order, key=lambda p: p.split("/")) == order
    assert len({r.entry_id for r in rows}) == 64


def test_starts(spark, tmp_path):
    root = str(tmp_path / "root")
    make_tree(root, 6)
    engine = Engine(spark, Settings(str(tmp_path / "db"), root))
    engine.update()
    whole = count(engine, "-name dir1", starts=[root])
    assert count(engine, "-name dir1", starts=["/"]) == whole
    nested = [f"{root}/dir5", f"{root}/dir5/dir4", f"{root}/dir5/dir4/dir3"]
    assert count(engine, "-name dir1", starts=nested) == sum(count(engine, "-name dir1", starts=[p]) for p in nested)
    assert count(engine, "-true", starts=[f"{root}/nowhere", f"{root}/file0"]) == 0
    assert engine.children(f"{root}/dir2").count() == 4
    pages = list(engine.pages("-type f", 10))
    assert [len(p) for p in pages] == [10] * (len(pages) - 1) + [63 - 10 * (len(pages) - 1)]
    assert [r.entry_id for p in pages for r in p] == sorted(r.entry_id for r in engine.search("-type f").collect())


def test_ignored_directories_are_entries_without_subtrees(spark, tmp_path):
    root = str(tmp_path / "root")
    make_tree(root, 7)
    settings = Settings(str(tmp_path / "db"), root).add("ignored", f"{root}/dir6").add("ignored", root).add("slow", f"{root}/dir5")
    engine = Engine(spark, settings)
    engine.update()
    assert count(engine, "-path */root/dir6/*") == 0 and count(engine, "-name dir6") == 1
    assert count(engine, "-true") == 262 - 130
    settings.erase("ignored", f"{root}/dir6")
    engine.update()
    assert count(engine, "-true") == 262


def test_versions(spark, tmp_path):
    root = str(tmp_path / "root")
    make_tree(root, 3)
    engine = Engine(spark, Settings(str(tmp_path / "db"), root))
    assert not engine.has_data()
    engine.update()
    before = engine.search("")
    n = before.count()
    write(f"{root}/more", "")
    engine.update()
    assert count(engine, "") == n + 1 and before.count() == n  # searches keep their version
    engine.settings.root_path = str(tmp_path / "nothing")
    with pytest.raises(RuntimeError):
        engine.update()
    engine.settings.root_path = root
    assert count(engine, "") == n + 1


def test_trigram_bounds():
    assert trigram.trigrams("Hello") == ["HEL", "ELL", "LLO"]
    assert trigram.glob_trigrams("ab*cdef?gh[i]jkl") == ["CDE", "DEF", "JKL"]
    assert trigram.path_trigrams("*/abc/*") == [] and trigram.path_trigrams("/home/us?rname") == ["RNA", "NAM", "AME"]
    for barred in ("-quitmod -name abcdef", "-name ab", "-name abcdef -o -name a*", "! -name abcdef", "-updir -name abcdef"):
        assert trigram.proposal(None, parse(barred)) is None, barred
    assert len(trigram._wanted(parse("( -name abcdef -o -strstr ghi ) -a -updir -name x"))) == 2
    assert trigram._wanted(parse("-name abc* -a -name abcdef*")) == [(("ABC", "BCD", "CDE", "DEF"), 4)]


def test_slow_and_long_needles(engine):
    needle = "dir" * 30
    assert count(engine, f"-fuzz {needle}") == 0


def test_path_wildcards_may_stand_for_separators():
    """'/x/abc/def' matches both patterns, so a name need not have what stands left of ? or a set."""
    for pattern in ("*abc?def", "*abc[^x]def"):
        assert trigram.path_trigrams(pattern) == ["DEF"]


def test_contents_are_read_for_what_all_else_lets_pass(engine, spark, monkeypatch):
    """Of files that other predicates reject, or that match without them, nothing is read."""
    from arborquery.sources import crawler

    read, plain = [], crawler.with_contents

    def spied(rows, whole):
        wanted = rows.filter(WANTED)
        read.append(sorted(r.path.partition("/root/")[2] for r in wanted.filter("ftype = 'f'").collect()))
        return plain(rows, whole)

    monkeypatch.setattr(crawler, "with_contents", spied)
    for expression, rows, opened in (
        ("-content-strstr Hello -a -name file0 -a -path '*root/dir2/file*'", 1, ["dir2/file0"]),
        ("-updir -name dir1 -a -content-strstr Hello", 1, None),
        ("-name file1 -o ( -path '*/dir1/file0' -a -content-strstr Hello )", None, 1),
        ("! ( -name file* -a ! -content-strstr Hello ) -a -path '*/dir2/*'", None, None),
        ("-type d -a -content-strstr Hello", 0, []),
    ):
        read.clear()
        found = sorted(r.path for r in engine.search(expression).collect())
        assert rows is None or len(found) == rows, expression
        if isinstance(opened, list):
            assert read == [opened], (expression, read)
        elif opened:
            assert all(p.endswith("dir1/file0") for p in read[0]), (expression, read)
        root = engine.settings.root_path
        every = [(r.path, r.ftype) for r in engine.search("").collect()]
        hello = {p for p, k in every if k == "f" and b"Hello" in open(p, "rb").read() and b"\0" not in open(p, "rb").read(4096)}
        name = lambda p: os.path.basename(p)
        want = {
            "-updir": lambda p, k: name(os.path.dirname(p)) == "dir1" and p in hello,
            "-name file1": lambda p, k: name(p) == "file1" or (p.endswith("/dir1/file0") and p in hello),
            "! ( -name": lambda p, k: "/dir2/" in p.removeprefix(root) and not (name(p).startswith("file") and p not in hello),
        }
        for start, test in want.items():
            if expression.startswith(start):
                assert found == sorted(p for p, k in every if test(p, k)), expression


def test_filters_stand_below_the_reader_of_contents(engine):
    engine.spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = engine.search("-content-strstr Hello -a -name 'fi*' -a -type f -a -size +1k", starts=[f"{engine.settings.root_path}/dir4"])._jdf.queryExecution().executedPlan().toString()
    scan = text[text.rindex("PushedFilters") :]
    for pushed in ("StringStartsWith(basename,fi)", "EqualTo(ftype,f)", "GreaterThan(size,1024)", "StringStartsWith(path,"):
        assert pushed in scan.split("ReadSchema")[0], pushed
    assert text.index("MapInArrow") < text.index("FileScan")
    engine.spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_live_values(spark, tmp_path):
    root = str(tmp_path / "root")
    make_tree(root, 4)
    engine = Engine(spark, Settings(str(tmp_path / "db"), root))
    engine.update()
    write(f"{root}/file1", " " * 5000)
    os.chmod(f"{root}/file2", 0o400)
    os.remove(f"{root}/file3")
    assert [count(engine, e) for e in ("-size +4k", "-perm 0400", "-type f -a -size 0")] == [0, 0, 15]
    assert [count(engine, e, live=True) for e in ("-type f -a -size +4k", "-perm 0400", "-type f -a -size 0", "-type f ! -size 0", "-name file1 -a -content-strstr '  ' -a -size +4k")] == [1, 1, 13, 2, 1]


def test_index_equals_scan_for_any_pattern(spark):
    """Random names, paths and patterns, with wildcards that may stand for separators, in conjuncts and alternatives."""
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("abcA.") for _ in range(rng.randint(1, 6)))
    paths = sorted({"/" + "/".join(part() for _ in range(rng.randint(1, 3))) for _ in range(300)})
    rows = [(i, "d" if any(q.startswith(p + "/") for q in paths) else "f", p, p.rpartition("/")[2], p.rpartition("/")[0]) for i, p in enumerate(paths)]
    engine = Engine(spark, entries=spark.createDataFrame(rows, "entry_id long, ftype string, path string, basename string, parent_path string").cache())
    served = 0

    def pattern():
        base = list(rng.choice(paths) if rng.random() < 0.7 else part() + part())
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(("?", "*", "[!a]", "[a-c]", "/", "\\a"))
        return "".join(base) if rng.random() < 0.5 else "*" + "".join(base) + rng.choice(("", "*"))

    def leaf():
        kind = rng.choice(("-name", "-iname", "-path", "-ipath", "-strstr", "-istrstr", "-fuzz", "-updir -name"))
        text = pattern() if "str" not in kind and "fuzz" not in kind else part() + part()
        return f"{kind} '{text}'"

    for _ in range(25):
        expression = leaf()
        for _ in range(rng.randint(0, 2)):
            expression = f"( {expression} ) {rng.choice(('-a', '-o', '-a !'))} {leaf()}"
        served += trigram.proposal(engine.postings(), parse(expression)) is not None
        by_index, by_scan = (sorted(r.entry_id for r in engine.search(expression, use_index=use).select("entry_id").collect()) for use in (True, False))
        assert by_index == by_scan, expression
    assert served >= 5
