"""What the compiled plans look like: filters reach scans, columns are pruned, hierarchy tests are equi-joins."""

import pytest

from arborquery import queries
from arborquery.plans.compiler import compile_search, with_all_columns
from arborquery.plans.parser import parse


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "entries")
    rows = [(i, "d" if i % 3 else "f", f"/a/n{i}", f"n{i}", "/a", 2, i * 100, 493) for i in range(100)]
    spark.createDataFrame(rows, "entry_id long, ftype string, path string, basename string, parent_path string, depth int, size long, mode int").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "expression, pushed",
    [
        ("-name 'ab*'", "StringStartsWith(basename,ab)"),
        ("-name '*ab'", "StringEndsWith(basename,ab)"),
        ("-name '*ab*'", "StringContains(basename,ab)"),
        ("-name ab", "EqualTo(basename,ab)"),
        ("-path '/a/*'", "StringStartsWith(path,/a/)"),
        ("-size +4k", "GreaterThan(size,4096)"),
        ("-size -4k", "LessThanOrEqual(size,3072)"),
        ("-type f", "EqualTo(ftype,f)"),
        ("-size 1k", "GreaterThan(size,0), LessThanOrEqual(size,1024)"),
    ],
)
def test_filters_reach_the_scan(entries, expression, pushed):
    text = plan(compile_search(entries, parse(expression)).select("path"))
    assert pushed in text.split("PushedFilters")[1]


def test_only_needed_columns_are_read(entries):
    schema = plan(compile_search(entries, parse("-name 'a*'")).select("path")).split("ReadSchema: ")[1]
    assert schema.startswith("struct<path:string,basename:string>") or schema.startswith("struct<basename:string,path:string>")


def test_conjuncts_on_the_hierarchy_are_semi_joins(entries):
    for expression in ("-updir -name a", "-downdir -name a", "-type d -a -downdir +2 -type f"):
        assert "LeftSemi" in plan(compile_search(entries, parse(expression)))
    text = plan(compile_search(entries, parse("-name x -o -updir -name a")))
    assert "LeftOuter" in text and "LeftSemi" not in text
    assert "LeftAnti" in plan(compile_search(entries, parse("-prunemod -name a")))


def test_constants_fold(entries):
    assert "Scan parquet" not in plan(compile_search(entries, parse("-name a -a -false")))


def test_no_registered_search_multiplies_its_input(spark):
    for key in ("flagship", "prune", "updir_in_not", "quit", "multi_start_union_all", "trigram_index_search"):
        text = plan(queries.queries()[key](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key


def test_columns_that_are_missing_are_null(entries):
    full = with_all_columns(entries)
    assert full.filter("uid IS NULL AND content_known IS NULL" if "content_known" in full.columns else "uid IS NULL").count() == 100
    assert compile_search(entries, parse("-uid 0 -o -mmin -5 -o -nouser -o -lname '*'")).count() == 0


@pytest.mark.parametrize("key, most", [("updir_nested", 3), ("flagship", 5), ("prune", 4), ("downdir_nested", 3)])
def test_hierarchies_are_read_as_often_as_they_are_looked_at(spark, key, most):
    """A search that looks at parents of parents reads the catalog once for each level."""
    text = plan(queries.queries()[key](spark, "/root/testdata/sf0.001"))
    assert text.count("FileScan parquet") <= most, text
    assert "business-tree" in text


def test_semi_joins_need_no_distinct_keys(entries):
    text = plan(compile_search(entries, parse("-updir -name a -a -downdir -name b")))
    assert "HashAggregate" not in text and text.count("LeftSemi") == 2
