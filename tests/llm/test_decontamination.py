import re

from arborquery.llm import decontamination as d


def brute(docs, items):
    word = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    out = set()
    for item, text in items:
        w = word(text)
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for doc, t in docs:
            v = word(t)
            common = len(own & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}) if own else 0
            if own and 5 * common >= 4 * len(own):
                out.add((doc, item, len(own), common))
    return out


def test_finds_equal_brute_force(spark, prose, odd_docs, sf):
    items = [prose(n) for n in (1, 3, 5, 6, 9, 20, 33, 60, 200)] + [None, "", "...", "no id here at all"]
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    for i, text in enumerate(items[:9]):
        w = text.split()
        for cut in range(0, len(w) // 3 + 1, max(1, len(w) // 12)):  # whole items and ever shorter parts
            rows.append((1000 + 50 * i + cut, f"{prose(300)} {' '.join(w[cut:]).upper()}!\n{prose(40)}"))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.op6_decontamination(spark, sf(documents=docs, benchmark=benchmark)).collect()
    want = brute(rows, enumerate(items))
    assert {tuple(r)[:4] for r in got} == want and len(want) > 20
    left = {r.doc_id for r in d.clean(docs, benchmark).collect()}
    assert left == {i for i, _ in rows} - {w[0] for w in want}


def test_blocks_of_items_together_find_the_same(spark, prose, monkeypatch):
    items = [prose(12) for _ in range(30)]
    docs = spark.createDataFrame([(i, f"{prose(50)} {t} {prose(9)}", "x") for i, t in enumerate(items)], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    once = {tuple(r) for r in d.contained(docs, benchmark).collect()}
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    assert {tuple(r) for r in d.contained(docs, benchmark).collect()} == once and len(once) >= 30
    assert d.clean(docs, benchmark).count() == 0


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.contained(odd_docs, none).count() == 0 and d.contained(no_docs, one).count() == 0
    assert d.clean(odd_docs, none).count() == odd_docs.count() and d.clean(odd_docs, one).columns == odd_docs.columns
