import corpus_pipeline as p
from arborquery.llm import bpe, registry
from arborquery.llm.common import written


def test_stages_on_small_tables(spark, prose, odd_docs, sf):
    item = prose(30)
    base = prose(200)
    docs = [(i, f"{prose(60)} {'vilefoo ' * (i % 3 == 0)}{prose(20)}", "en", "s", 1) for i in range(300)]
    docs += [(1000, base, "en", "s", 1), (1001, base + " end", "en", "s", 1), (1002, f"{prose(40)} {item}", "en", "s", 1), (1003, "write a@b.cd or 1.2.3.4", "en", "s", 1), (1004, None, None, None, None)]
    tables = sf(
        documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        labels=spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"),
    )
    assert [name for name, _ in p.STAGES] == ["toxic documents", "near duplicates", "benchmark leaks", "private data", "token ids"]
    kept, columns = spark.read.parquet(f"{tables}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = []
    for _, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, tables)
        assert kept.columns == columns
        seen.append({r.doc_id: r.text for r in kept.collect()})
    assert {i for i in range(300) if i % 3} <= seen[0].keys() and sum(i % 3 == 0 for i in seen[0] if i < 300) < 5
    assert seen[0].keys() - seen[1].keys() == {1001}
    assert seen[1].keys() - seen[2].keys() == {1002}
    assert seen[3] == seen[2] | {1003: "write [email] or [ip]"}
    rows = {r.doc_id: r.n_tokens for r in p.run(spark, tables).collect()}
    encoder = bpe.load(bpe.default_vocabulary(), bpe.default_pattern())
    assert rows == {i: len(encoder.encode(t or "")) for i, t in seen[3].items()}


def test_stages_on_odd_tables(spark, prose, odd_docs, no_docs, sf):
    """Nulls, empty and very long texts, repeated rows, extra columns with the operators' names: each stage keeps the
    columns, drops only what it should, and gives nothing for an empty table."""
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(40)), (2, None), (None, "")], "item_id long, text string")
    tables = sf(documents=odd_docs, labels=labels, benchmark=items)
    kept = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = kept.collect()
        kept = written(stage(spark, kept, tables), "odd")
        assert kept.columns == odd_docs.columns, name
        after = kept.collect()
        if name == "near duplicates":  # of the two long texts that differ by a word; a repeated row stays with its twin
            assert sorted(r.doc_id or -1 for r in before if r not in after) == ([6] if {5, 6} <= {r.doc_id for r in before} else [])
        if name == "private data":
            assert len(after) == len(before) and [r.data for r in after] == ["extra"] * len(after)
    rows = p.STAGES[-1][1](spark, kept, tables).collect()
    assert len(rows) == len(after)
    empty = sf(documents=no_docs, labels=labels.limit(0), benchmark=items.limit(0))
    assert p.run(spark, empty).collect() == []


def test_registry_has_ten_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
    assert registry.oracle_sql().keys() <= registry.queries().keys()
