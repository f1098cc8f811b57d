import io
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborquery.llm import warc as w


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.text(max_size=20), st.binary(max_size=300)), max_size=8), st.booleans())
def test_round_trip_by_ranges(rows, zip64):
    package = w.Package()
    for page, url, payload in rows:
        package.add(page, url, payload, None)
    data = package.build(zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [w.DATA, w.INDEX]
    got = [(int(r.headers["x-page-id"]), r.payload) for _, r in w.records(w.Buffer(data))]
    assert sorted(got) == sorted((p, x) for p, _, x in rows)


def test_reads_packages_of_others_by_range(tmp_path):
    package = w.Package()
    package.add(1, "u", b"one", None)
    package.add(2, "v", b"two", None)
    with zipfile.ZipFile(tmp_path / "p.wacz", "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05 a comment"
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr(w.INDEX, "\n".join(package.lines))
        z.writestr(w.DATA, b"".join(package.parts))
    reads = []

    class Watched(w.File):
        def read_at(self, offset, size):
            reads.append(size)
            return super().read_at(offset, size)

    source = Watched(str(tmp_path / "p.wacz"))
    assert [r.payload for _, r in w.records(source)] == [b"one", b"two"]
    assert [len(p) for p in package.parts] == reads[-2:]


def test_compressed_members_and_broken_files_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(w.INDEX, "x" * 1000)
    with pytest.raises(ValueError):
        list(w.records(w.Buffer(out.getvalue())))
    with pytest.raises(ValueError):
        w.members(w.Buffer(b"no archive"))
    with pytest.raises(ValueError):
        w.Buffer(b"abc").read_at(2, 2)


def test_query_equals_its_sql(spark, sf, tmp_path):
    long = "<p>" + "long " * 50_000
    rows = [(i, f"u{i}", t, "x") for i, t in enumerate(["a", "b", "a", None, "", "ü漢", "a", long, long, "c"])]
    pages = spark.createDataFrame([*rows, (None, None, "b", None)], "page_id long, url string, html string, data string")
    folder = sf(pages=pages)
    got = sorted(map(tuple, w.op5_warc(spark, folder).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(w.SQL).fetchall(), key=str)
    assert w.op5_warc(spark, sf(pages=pages.limit(0))).collect() == []


def test_packages_are_bounded(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 3000) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    packages = w.packed(w.with_responses(pages).coalesce(1), 2000)
    assert packages.count() > 1 and w.read_back(packages).count() == 50
