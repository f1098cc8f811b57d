"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Settings
from .operators import trigram
from .plans import nodes as n
from .plans.compiler import Context, Compiler, below, compile_search, with_all_columns
from .plans.parser import parse
from .sources.tables import business_catalog, file_entries, table

#: The time that ages are counted from: 2024-02-01 00:00:00 UTC.
NOW = 1706745600

# tables as entries, and the same in SQL

_TREE = """
WITH na AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), cu AS (SELECT * FROM customer JOIN na ON c_nationkey = n_nationkey),
od AS (SELECT * FROM orders JOIN cu ON o_custkey = c_custkey), e AS (
SELECT CAST(r_regionkey AS BIGINT) * 100 * 10000000 * 1000000000 AS entry_id, 'd' AS ftype, '/' || r_name AS path, r_name AS basename, '' AS parent_path, 1 AS depth, CAST(NULL AS BIGINT) AS size, CAST(NULL AS TIMESTAMP) AS mtime FROM region
UNION ALL SELECT (CAST(r_regionkey AS BIGINT) * 100 + n_nationkey + 1) * 10000000 * 1000000000, 'd', '/' || r_name || '/' || n_name, n_name, '/' || r_name, 2, NULL, NULL FROM na
UNION ALL SELECT ((CAST(r_regionkey AS BIGINT) * 100 + n_nationkey + 1) * 10000000 + c_custkey + 1) * 1000000000, 'd', '/' || r_name || '/' || n_name || '/' || c_name, c_name, '/' || r_name || '/' || n_name, 3, NULL, NULL FROM cu
UNION ALL SELECT ((CAST(r_regionkey AS BIGINT) * 100 + n_nationkey + 1) * 10000000 + c_custkey + 1) * 1000000000 + o_orderkey + 1, 'f', '/' || r_name || '/' || n_name || '/' || c_name || '/o' || o_orderkey || '.' || o_orderpriority,
  'o' || o_orderkey || '.' || o_orderpriority, '/' || r_name || '/' || n_name || '/' || c_name, 4, CAST(floor(o_totalprice) AS BIGINT), o_orderdate FROM od)
"""
_PARTS = """WITH e AS (SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 7 = 3 THEN 'l' ELSE 'f' END AS ftype, '/' || p_brand || '/' || p_name AS path, p_name AS basename, '/' || p_brand AS parent_path,
  CAST(p_retailprice AS BIGINT) AS size, CASE WHEN p_partkey % 7 = 3 THEN '../' || p_type || '/' || p_name END AS link_target, (p_size * 37) % 512 AS mode, p_size % 5 AS uid, p_size % 3 AS gid, p_partkey % 9 AS inode, p_size % 3 <> 1 AS group_known FROM part) """
_DOCS = """WITH e AS (SELECT d.doc_id AS entry_id, 'f' AS ftype, '/' || source || '/' || d.doc_id || '.' || lang AS path, d.doc_id || '.' || lang AS basename, '/' || source AS parent_path, n_chars AS size,
  text AS content, l.doc_id IS NOT NULL AS user_known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) """
_TALK = """WITH e AS (SELECT conv_id * 10000 + turn AS entry_id, 'f' AS ftype, '/' || conv_id || '/' || turn || '.' || role AS path, turn || '.' || role AS basename, text AS content FROM conversations) """
_EVENTS = """WITH e AS (SELECT event_id AS entry_id, 'f' AS ftype, '/' || event_type || '/' || event_id AS path, CAST(event_id AS VARCHAR) AS basename, ts AS mtime,
  ts + to_days(CAST(user_id % 5 AS INTEGER)) AS atime, ts - to_hours(CAST(user_id % 7 AS INTEGER)) AS ctime FROM events) """
_MIXED = """WITH e AS (SELECT page_id AS entry_id, 'f' AS ftype, '/' || page_id AS path, length(html) % 3 = 0 AS early, html AS content FROM pages) """
_PAGES = """WITH e AS (SELECT page_id AS entry_id, 'f' AS ftype, url AS path, html AS content FROM pages) """


def _text(c: str):
    return F.col(c).cast("string")


def tree(s: SparkSession, d: str) -> DataFrame:
    return business_catalog(s, d)


def parts(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    link = c("p_partkey") % 7 == 3
    out = file_entries(
        table(s, d, "part"), "p_partkey", F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name"), size=F.rint("p_retailprice").cast("long"),
        link_target=F.when(link, F.concat(F.lit("../"), "p_type", F.lit("/"), "p_name")), mode=(c("p_size") * 37 % 512).cast("int"), uid=(c("p_size") % 5).cast("int"), gid=(c("p_size") % 3).cast("int"),
        inode=c("p_partkey") % 9, group_known=c("p_size") % 3 != 1,
    )
    return out.withColumn("ftype", F.when(c("link_target").isNotNull(), "l").otherwise("f"))


def docs(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "labels").select("doc_id").distinct().withColumn("user_known", F.lit(True))
    both = table(s, d, "documents").join(known, "doc_id", "left").withColumn("user_known", F.coalesce("user_known", F.lit(False)))
    return file_entries(both, "doc_id", F.concat(F.lit("/"), "source", F.lit("/"), _text("doc_id"), F.lit("."), "lang"), size=F.col("n_chars"), content=F.col("text"), user_known=F.col("user_known"))


def talk(s: SparkSession, d: str) -> DataFrame:
    keyed = table(s, d, "conversations").withColumn("key", F.col("conv_id") * 10000 + F.col("turn"))
    return file_entries(keyed, "key", F.concat(F.lit("/"), _text("conv_id"), F.lit("/"), _text("turn"), F.lit("."), "role"), content=F.col("text"))


def events(s: SparkSession, d: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return file_entries(table(s, d, "events"), "event_id", F.concat(F.lit("/"), "event_type", F.lit("/"), _text("event_id")), mtime=at, atime=at + F.make_dt_interval(days=F.col("user_id") % 5), ctime=at - F.make_dt_interval(hours=F.col("user_id") % 7))


def pages(s: SparkSession, d: str) -> DataFrame:
    return file_entries(table(s, d, "pages"), "page_id", F.col("url"), content=F.col("html"))


def mixed(s: SparkSession, d: str) -> DataFrame:
    """Pages as bytes: every third has a zero byte at its start, the others have one after their first 4096 bytes."""
    html = F.col("html").cast("string")
    data = F.when(F.length(html) % 3 == 0, F.concat(F.lit("\0"), html)).otherwise(F.concat(html, F.repeat(F.lit(" "), 4096), F.lit("\0")))
    return file_entries(table(s, d, "pages"), "page_id", F.concat(F.lit("/"), _text("page_id")), content=F.encode(data, "UTF-8"))


_SOURCES = {mixed: _MIXED, tree: _TREE, parts: _PARTS, docs: _DOCS, talk: _TALK, events: _EVENTS, pages: _PAGES}


def partial_ratio_sql(column: str, needle: str) -> str:
    """The score of a column for a needle, window by window."""
    size, full = len(needle), (1 << len(needle)) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(needle):
        masks[c] = masks.get(c, 0) | 1 << i
    case = "CASE c " + " ".join(f"WHEN '{c}' THEN {m}" for c, m in masks.items()) + " ELSE 0 END"
    window = f"substr({column}, greatest(w, 0) + 1, least(w + {size}, length({column})) - greatest(w, 0))"
    rest = f"list_reduce(list_transform(string_split({window}, ''), lambda c: CAST({case} AS BIGINT)), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, CAST({full} AS BIGINT))"
    return f"list_max(list_transform(range(1 - {size}, length({column})), lambda w: 200.0 * ({size} - bit_count({rest})) / ({size} + length({window}))))"


#: key: (entries, expression, condition in SQL on e). The result is entry_id and path.
_FIND: dict[str, tuple[Callable, str, str]] = {
    "glob_basename": (tree, "-name 'o*5.[!1-3]*'", "ftype = 'f' AND regexp_matches(basename, '^o.*5\\.[^1-3].*$')"),
    "glob_prefix": (tree, "-name 'NATION_*' -a -type d", "starts_with(basename, 'NATION_')"),
    "glob_path": (tree, "-path '*/NATION_1*/*URGENT'", "path GLOB '*/NATION_1*/*URGENT'"),
    "glob_icase": (tree, "-iname '*urgent' -a -ipath '/asia/*'", "upper(basename) GLOB '*URGENT' AND upper(path) GLOB '/ASIA/*'"),
    "glob_full_option": (tree, "-name --ignore-case --full '*nation_2*4-not*'", "upper(path) GLOB '*NATION_2*4-NOT*'"),
    "link_glob": (parts, "-lname '*/ECONOMY/*'", "ftype = 'l' AND link_target GLOB '*/ECONOMY/*'"),
    "link_negated": (parts, "! -lname '*ECONOMY*'", "NOT (ftype = 'l' AND contains(link_target, 'ECONOMY'))"),
    "strstr_name": (parts, "-strstr widget", "contains(basename, 'widget')"),
    "strstr_icase": (parts, "-istrstr WiDgEt -a -strstr --full '#1'", "contains(upper(basename), 'WIDGET') AND contains(path, '#1')"),
    "strstr_link": (parts, "-strstr --readlink SMALL", "ftype = 'l' AND contains(link_target, 'SMALL')"),
    "regex_path": (tree, r"-regex 'NATION_[0-9]/.*[37]\.[15]-'", r"regexp_matches(path, 'NATION_[0-9]/.*[37]\.[15]-')"),
    "regex_icase": (pages, r"-iregex '^HTTPS://[^/]*\.EXAMPLE\.(com|org)/EN/'", r"regexp_matches(path, '^https://[^/]*\.example\.(com|org)/en/', 'i')"),
    "regex_basename_exact": (tree, r"-bregex --exact 'o[0-9]{2,3}\.[1-2].*'", r"regexp_full_match(basename, 'o[0-9]{2,3}\.[1-2].*')"),
    "regex_basename_icase": (parts, "-ibregex '^(RED|BLUE) '", "regexp_matches(basename, '^(red|blue) ', 'i')"),
    "fuzzy_name": (parts, "-fuzz widgett", f"length(basename) >= 5 AND {partial_ratio_sql('basename', 'widgett')} > 85"),
    "fuzzy_cutoff": (parts, "-fuzz --cutoff 70 wdiget", f"length(basename) >= 4 AND {partial_ratio_sql('basename', 'wdiget')} > 70"),
    "type_list": (parts, "-type l,d", "ftype IN ('l', 'd')"),
    "constants": (parts, "( -false -o -true ) -a ! -false -a -type l", "ftype = 'l'"),
    "size_kilobytes": (docs, "-size +4k", "ceil(size / 1024.0) > 4"),
    "size_blocks": (docs, "-size 5", "ceil(size / 512.0) = 5"),
    "size_below": (docs, "-size -2000c", "size < 2000"),
    "age_days": (events, "-mtime +10", f"floor((epoch({{now}}) - epoch(mtime)) / 86400) > 10"),
    "age_minutes": (events, "-mmin -30000 -a -mmin +29000", f"floor((epoch({{now}}) - epoch(mtime)) / 60) < 30000 AND floor((epoch({{now}}) - epoch(mtime)) / 60) > 29000"),
    "age_day_exact": (events, "-mtime 20", f"floor((epoch({{now}}) - epoch(mtime)) / 86400) = 20"),
    "access_days": (events, "-atime -12 -o -atime 40", "floor((epoch({now}) - epoch(atime)) / 86400) < 12 OR floor((epoch({now}) - epoch(atime)) / 86400) = 40"),
    "change_days": (events, "-ctime +25", "floor((epoch({now}) - epoch(ctime)) / 86400) > 25"),
    "access_minutes": (events, "-amin -20000", "floor((epoch({now}) - epoch(atime)) / 60) < 20000"),
    "change_minutes": (events, "-cmin +40000", "floor((epoch({now}) - epoch(ctime)) / 60) > 40000"),
    "inode_number": (parts, "-inode 4 -o -inode +7", "inode = 4 OR inode > 7"),
    "gid_number": (parts, "-gid -2", "gid < 2"),
    "group_number": (parts, "-group 1 ! -gid 0", "gid = 1"),
    "no_group": (parts, "-nogroup", "NOT group_known"),
    "content_text_only": (mixed, "-content-strstr '<p>'", "NOT early AND contains(content, '<p>')"),
    "content_binary": (mixed, "-content-regex --binary '<h[12]>[A-Z]' -a ! -content-strstr '<p>'", "regexp_matches(content, '<h[12]>[A-Z]') AND NOT (NOT early AND contains(content, '<p>'))"),
    "uid_number": (parts, "-uid 3 -o -uid +3", "uid >= 3"),
    "user_number": (parts, "-user 2", "uid = 2"),
    "permission_all": (parts, "-perm -044", "(mode & 36) = 36"),
    "permission_any": (parts, "-perm /u+w,o+x", "(mode & 129) <> 0"),
    "permission_exact": (parts, "-perm 0157", "mode = 111"),
    "no_user": (docs, "-nouser", "NOT user_known"),
    "depth_number": (tree, "-depth 2 -o -depth -2", "depth <= 2"),
    "and_or_not": (tree, "-type f ( -name '*LOW' -o -name '*HIGH' ) ! -path '*/ASIA/*'", "ftype = 'f' AND (basename GLOB '*LOW' OR basename GLOB '*HIGH') AND NOT path GLOB '*/ASIA/*'"),
    "updir": (tree, "-updir -name NATION_3", "parent_path IN (SELECT path FROM e WHERE basename = 'NATION_3')"),
    "updir_nested": (tree, "-updir -updir -name NATION_3", "parent_path IN (SELECT path FROM e WHERE parent_path IN (SELECT path FROM e WHERE basename = 'NATION_3'))"),
    "updir_in_not": (tree, "! -updir -name 'Customer*' -o -updir -name 'Customer*7'", "NOT parent_path IN (SELECT path FROM e WHERE starts_with(basename, 'Customer')) OR parent_path IN (SELECT path FROM e WHERE basename GLOB 'Customer*7')"),
    "downdir_any": (tree, "-downdir -name '*URGENT'", "path IN (SELECT parent_path FROM e WHERE basename GLOB '*URGENT')"),
    "downdir_more": (tree, "-downdir +2 -name '*URGENT'", "path IN (SELECT parent_path FROM e WHERE basename GLOB '*URGENT' GROUP BY parent_path HAVING count(*) > 2)"),
    "downdir_range": (tree, "-downdir +1 -4 -type f", "path IN (SELECT parent_path FROM e WHERE ftype = 'f' GROUP BY parent_path HAVING count(*) BETWEEN 2 AND 4)"),
    "downdir_nested": (tree, "-downdir +5 -downdir +14 -type f", "path IN (SELECT parent_path FROM e WHERE path IN (SELECT parent_path FROM e WHERE ftype = 'f' GROUP BY parent_path HAVING count(*) > 14) GROUP BY parent_path HAVING count(*) > 5)"),
    "prune": (tree, "( -name ASIA -a -prune -a -false ) -o -name '*LOW'", "basename GLOB '*LOW' AND NOT EXISTS (SELECT 1 FROM (SELECT path AS p FROM e WHERE basename = 'ASIA') WHERE starts_with(e.path, p || '/'))"),
    "prune_modifier": (tree, "-prunemod -name 'NATION_1*' -a -type f", "ftype = 'f' AND NOT EXISTS (SELECT 1 FROM (SELECT path AS p FROM e WHERE basename GLOB 'NATION_1*' AND ftype = 'd') WHERE starts_with(e.path, p || '/'))"),
    "quit": (tree, "-name '*URGENT' -a -quit 40", "basename GLOB '*URGENT' AND entry_id < coalesce((SELECT max(entry_id) FROM (SELECT entry_id FROM e WHERE basename GLOB '*URGENT' ORDER BY entry_id LIMIT 40) HAVING count(*) = 40), 9223372036854775807)"),
    "quit_modifier": (docs, "-quitmod 100 -size +2k", "size > 2048 AND entry_id < coalesce((SELECT max(entry_id) FROM (SELECT entry_id FROM e WHERE size > 2048 ORDER BY entry_id LIMIT 100) HAVING count(*) = 100), 9223372036854775807)"),
    "content_strstr": (docs, "-content-strstr 'the th'", "contains(content, 'the th')"),
    "content_icase": (docs, "-content-strstr --ignore-case 'LICENSED under'", "contains(upper(content), 'LICENSED UNDER')"),
    "content_regex": (docs, "-content-regex '^[A-Z][a-z]+ing\\.$'", "regexp_matches(content, '(?m)^[A-Z][a-z]+ing\\.$')"),
    "content_regex_icase": (pages, "-content-regex --ignore-case '<H1>[^<]*THE'", "regexp_matches(content, '(?im)<h1>[^<]*the')"),
    "content_fuzzy": (talk, "-content-fuzz --cutoff 80 'thingrend'", f"octet_length(encode(content)) >= 5 AND {partial_ratio_sql('content', 'thingrend')} >= 80"),
    "content_after_name": (docs, "-name '*.fr' -a -content-strstr 'les ' -a -size -8k", "basename GLOB '*.fr' AND contains(content, 'les ') AND ceil(size / 1024.0) < 8"),
}


def _found(df: DataFrame) -> DataFrame:
    return df.select("entry_id", "path")


def _find(source: Callable, expression: str) -> Callable:
    return lambda s, d: _found(compile_search(source(s, d), parse(expression), now=NOW))


def _find_sql(source: Callable, condition: str) -> str:
    return f"{_SOURCES[source]} SELECT entry_id, path FROM e WHERE {condition.replace('{now}', f'make_timestamp({NOW}000000)')}"


_FLAGSHIP = "( -name ASIA -a -prune -a -false ) -o ( -type f -a -name '*1-URGENT' -a -updir -updir -name 'NATION_1*' )"


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Urgent orders of nations by name, outside a pruned region."""
    return compile_search(tree(s, d), parse(_FLAGSHIP)).select("entry_id", "path", "size")


def _columns(entries: DataFrame, tree_: n.Expr) -> DataFrame:
    return _found(compile_search(entries, tree_))


def _xor(s, d):
    return _columns(parts(s, d), parse("-strstr red") ^ parse("-size +1500c"))


def _nand_nor(s, d):
    a, b = parse("-type l"), parse("-uid 1")
    return _columns(parts(s, d), n.And(n.nand(a, b), n.Not(n.nor(a, b))))


def _empty(s, d):
    """Empty files and directories: customers without orders, and orders of less than twenty thousand."""
    e = tree(s, d)
    kids = e.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").cast("int").alias("n_children"))
    full = e.withColumn("size", F.floor(F.col("size") / 20000)).join(kids, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return _found(compile_search(full, parse("-empty")))


def _access(s, d):
    e = parts(s, d)
    bits = lambda m: F.col("mode").bitwiseAND(m) != 0
    return _found(compile_search(e.withColumn("r_ok", bits(256)).withColumn("w_ok", bits(128)).withColumn("x_ok", bits(64)), parse("-access --readable --executable -a ! -writable")))


def _by_type(s, d):
    return compile_search(tree(s, d), parse("-true")).groupBy("ftype", "depth").agg(F.count("*").alias("n"))


def _starts(s, d):
    """Nested starts repeat what they share."""
    e, t = with_all_columns(tree(s, d)), parse("-type f")
    out = None
    for path in ("/ASIA", "/ASIA/NATION_2", "/ASIA/NATION_12", "/nowhere"):
        part = Compiler(Context(e)).search(t, below(path))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path").agg(F.count("*").alias("times"))


def _children(s, d):
    return _found(tree(s, d).filter(F.col("parent_path") == "/ASIA"))


def _scores(s, d):
    from .functions.fuzzy import similarity

    return parts(s, d).select("entry_id", F.round(similarity(F.col("basename"), "bolts"), 6).alias("score"))


def _by_index(s, d, expression: str) -> DataFrame:
    """A search of an engine over a table of entries, by its trigram index."""
    return _found(Engine(s, entries=parts(s, d)).search(expression, use_index=True))


def _newer(s, d):
    """Events accessed after another one was changed, the path's own entry being looked up."""
    e = events(s, d)
    at = e.filter("path LIKE '/%/500'").agg(F.max("mtime")).scalar()
    return _found(e.filter(F.col("atime") > at))


def _above_root(s, d):
    """Starts above the root are the root, and one beside it has nothing."""
    engine = Engine(s, Settings(root_path="/ASIA"), entries=tree(s, d).filter("path LIKE '/ASIA/%'"))
    return _found(engine.search("-type d", starts=["/", "/ASIA/", "/EUROPE"])).groupBy("entry_id", "path").agg(F.count("*").alias("times"))


def _ignored(s, d):
    """What a crawl that ignores two subtrees keeps: their roots without what is below."""
    e = tree(s, d)
    return _found(compile_search(e, parse("( ( -path /ASIA -o -path /EUROPE ) -a -prune ) -o -true")))


def _index_intersection(s, d):
    return trigram.intersection(trigram.postings(parts(s, d)), trigram.trigrams("gear"))


def _index_frequency(s, d):
    return trigram.candidates(trigram.postings(parts(s, d)), trigram.trigrams("blue widget"), 4)


#: Patterns whose wildcards stand for separators, alternatives, and conjuncts that look at parents.
_INDEXED = ("-name '*9.2-HIGH'", "-path '*/NATION_1?Customer*'", "-path '*ATION_1[!a]Customer#00000*'", "-iname '*urgent' -o -name 'Customer*77'", "-updir -name 'Customer*7' -a -name '*LOW'")


def _index_equals_scan(s, d):
    """Of each pattern, how many matches a search by stored postings and a scan find, and how many are not in common."""
    e = with_all_columns(tree(s, d))
    index, out = trigram.postings(e), None
    for i, text in enumerate(_INDEXED):
        t = parse(text)
        found = Compiler(Context(e)).search(t, proposed=trigram.indexed(e, index, t)).select("entry_id", F.lit(1).alias("by_index"), F.lit(0).alias("by_scan"))
        both = found.unionAll(compile_search(e, t).select("entry_id", F.lit(0), F.lit(1))).groupBy("entry_id").agg(F.sum("by_index").alias("a"), F.sum("by_scan").alias("b"))
        row = both.agg(F.lit(i).alias("pattern"), F.count("*").alias("n"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("apart"))
        out = row if out is None else out.unionAll(row)
    return out


def _postings(s, d):
    return trigram.postings(parts(s, d)).groupBy("trigram").agg(F.count("*").alias("n"))


def _quit_inclusive(s, d):
    return _found(compile_search(docs(s, d), parse("-name '*.de' -a -quit 30"), inclusive_quit=True))


def _page(s, d):
    """The second page of twenty matches."""
    found = compile_search(docs(s, d), parse("-name '*.es'"))
    first = found.orderBy("entry_id").limit(20).agg(F.max("entry_id")).scalar()
    return _found(found.filter(F.col("entry_id") > first).orderBy("entry_id").limit(20))


_TRIGRAMS = "SELECT DISTINCT entry_id, substr(upper(basename), i, 3) AS trigram FROM (SELECT entry_id, basename, unnest(range(1, length(basename) - 1)) AS i FROM e)"

#: key: (query, SQL).
_OTHER: dict[str, tuple[Callable, str]] = {
    "flagship": (flagship, f"{_TREE} SELECT entry_id, path, size FROM e WHERE ftype = 'f' AND basename GLOB '*1-URGENT' AND NOT starts_with(path, '/ASIA/') AND parent_path IN (SELECT path FROM e WHERE parent_path IN (SELECT path FROM e WHERE basename GLOB 'NATION_1*'))"),
    "tree_count_by_type": (_by_type, f"{_TREE} SELECT ftype, depth, count(*) AS n FROM e GROUP BY ftype, depth"),
    "xor": (_xor, f"{_PARTS} SELECT entry_id, path FROM e WHERE contains(basename, 'red') <> (size > 1500)"),
    "nand_nor": (_nand_nor, f"{_PARTS} SELECT entry_id, path FROM e WHERE (ftype = 'l') <> (uid = 1)"),
    "empty": (_empty, f"{_TREE} SELECT entry_id, path FROM e WHERE CASE WHEN ftype = 'd' THEN path NOT IN (SELECT parent_path FROM e) ELSE size < 20000 END"),
    "access": (_access, f"{_PARTS} SELECT entry_id, path FROM e WHERE (mode & 256) <> 0 AND (mode & 64) <> 0 AND (mode & 128) = 0"),
    "multi_start_union_all": (_starts, f"{_TREE} SELECT path, count(*) AS times FROM (SELECT path FROM e WHERE ftype = 'f' AND starts_with(path, '/ASIA/') UNION ALL SELECT path FROM e WHERE ftype = 'f' AND starts_with(path, '/ASIA/NATION_2/') UNION ALL SELECT path FROM e WHERE ftype = 'f' AND starts_with(path, '/ASIA/NATION_12/')) GROUP BY path"),
    "child_scan": (_children, f"{_TREE} SELECT entry_id, path FROM e WHERE parent_path = '/ASIA'"),
    "fuzzy_scores": (_scores, f"{_PARTS} SELECT entry_id, round({partial_ratio_sql('basename', 'bolts')}, 6) AS score FROM e"),
    "accessed_after": (_newer, f"{_EVENTS} SELECT entry_id, path FROM e WHERE atime > (SELECT max(mtime) FROM e WHERE basename = '500')"),
    "start_above_root": (_above_root, f"{_TREE} SELECT entry_id, path, CAST(2 AS BIGINT) AS times FROM e WHERE ftype = 'd' AND starts_with(path, '/ASIA/')"),
    "ignored_subtrees": (_ignored, f"{_TREE} SELECT entry_id, path FROM e WHERE NOT starts_with(path, '/ASIA/') AND NOT starts_with(path, '/EUROPE/')"),
    "trigram_or_search": (lambda s, d: _by_index(s, d, "-iname '*widget' -o -strstr 'bolt' -o -fuzz 'blue widgt'"), f"{_PARTS} SELECT entry_id, path FROM e WHERE upper(basename) GLOB '*WIDGET' OR contains(basename, 'bolt') OR (length(basename) >= 8 AND {partial_ratio_sql('basename', 'blue widgt')} > 85)"),
    "trigram_index_search": (lambda s, d: _by_index(s, d, "-iname '*widget'"), f"{_PARTS} SELECT entry_id, path FROM e WHERE upper(basename) GLOB '*WIDGET'"),
    "trigram_intersection": (_index_intersection, f"{_PARTS} SELECT entry_id FROM e WHERE contains(upper(basename), 'GEA') AND contains(upper(basename), 'EAR')"),
    "trigram_frequency": (_index_frequency, f"{_PARTS}, t AS ({_TRIGRAMS}) SELECT entry_id FROM t WHERE trigram IN ('BLU', 'LUE', 'UE ', 'E W', ' WI', 'WID', 'IDG', 'DGE', 'GET') GROUP BY entry_id HAVING count(*) >= 4"),
    "trigram_fuzzy": (lambda s, d: _by_index(s, d, "-fuzz 'blue widgt'"), f"{_PARTS} SELECT entry_id, path FROM e WHERE length(basename) >= 8 AND {partial_ratio_sql('basename', 'blue widgt')} > 85"),
    "trigram_postings": (_postings, f"{_PARTS}, t AS ({_TRIGRAMS}) SELECT trigram, count(*) AS n FROM t GROUP BY trigram"),
    "index_equals_scan": (_index_equals_scan, _TREE + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS pattern, count(*) AS n, CAST(0 AS BIGINT) AS apart FROM e WHERE {w}"
        for i, w in enumerate((
            "basename GLOB '*9.2-HIGH'", "regexp_matches(path, '/NATION_1.Customer')", "regexp_matches(path, 'ATION_1[^a]Customer#00000')",
            "upper(basename) GLOB '*URGENT' OR basename GLOB 'Customer*77'", "basename GLOB '*LOW' AND parent_path IN (SELECT path FROM e WHERE basename GLOB 'Customer*7')",
        ))
    )),
    "quit_inclusive": (_quit_inclusive, f"{_DOCS} SELECT entry_id, path FROM e WHERE basename GLOB '*.de' ORDER BY entry_id LIMIT 30"),
    "keyset_page": (_page, f"{_DOCS} SELECT entry_id, path FROM e WHERE basename GLOB '*.es' ORDER BY entry_id LIMIT 20 OFFSET 20"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _find(source, expression) for k, (source, expression, _) in _FIND.items()} | {k: q for k, (q, _) in _OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _find_sql(source, condition) for k, (source, _, condition) in _FIND.items()} | {k: sql for k, (_, sql) in _OTHER.items()}
