"""Entries made from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stamp, written

#: Catalogs written in this process, by application, tables and the state of their files.
_catalogs: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_entries(df: DataFrame, entry_id: str, path: Column, **columns: Column) -> DataFrame:
    """Rows as regular files: path gives basename and parent_path."""
    base = df.select(F.col(entry_id).cast("long").alias("entry_id"), path.alias("path"), F.lit("f").alias("ftype"), *(c.alias(name) for name, c in columns.items()))
    return base.withColumn("basename", F.substring_index("path", "/", -1)).withColumn("parent_path", F.regexp_replace("path", "/[^/]*$", ""))


def business_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/region/nation/customer/order.priority: regions, nations and customers are directories, orders are files.

    entry_id is the place in a depth-first walk by keys. Sizes and times are those of orders.
    """
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    c = F.col

    def place(*keys: str) -> Column:
        out = c(keys[0]).cast("long") * 100
        if len(keys) > 1:
            out += c(keys[1]) + 1
        out *= F.lit(10**7).cast("long")
        if len(keys) > 2:
            out += c(keys[2]) + 1
        out *= F.lit(10**9).cast("long")
        return out + c(keys[3]) + 1 if len(keys) > 3 else out

    def rows(df: DataFrame, id_: Column, kind: str, depth: int, parent: Column, name: Column, size: Column, mtime: Column) -> DataFrame:
        return df.select(
            id_.alias("entry_id"), F.lit(kind).alias("ftype"), F.concat(parent, F.lit("/"), name).alias("path"), name.alias("basename"), parent.alias("parent_path"), F.lit(depth).alias("depth"),
            F.lit(False).alias("is_root"), size.alias("size"), mtime.alias("mtime"),
        )

    none, never = F.lit(None).cast("long"), F.lit(None).cast("timestamp")
    nations = nation.join(F.broadcast(region), c("n_regionkey") == c("r_regionkey"))  # 5 and 25 rows at any scale
    customers = customer.join(F.broadcast(nations), c("c_nationkey") == c("n_nationkey"))
    placed = orders.join(customers, c("o_custkey") == c("c_custkey"))
    top, second = F.concat(F.lit("/"), c("r_name")), F.concat(F.lit("/"), c("r_name"), F.lit("/"), c("n_name"))
    third = F.concat(second, F.lit("/"), c("c_name"))
    named = F.concat(F.lit("o"), c("o_orderkey").cast("string"), F.lit("."), c("o_orderpriority"))
    out = rows(region, place("r_regionkey"), "d", 1, F.substring("r_name", 1, 0), c("r_name"), none, never)
    out = out.unionAll(rows(nations, place("r_regionkey", "n_nationkey"), "d", 2, top, c("n_name"), none, never))
    out = out.unionAll(rows(customers, place("r_regionkey", "n_nationkey", "c_custkey"), "d", 3, second, c("c_name"), none, never))
    files = rows(placed, place("r_regionkey", "n_nationkey", "c_custkey", "o_orderkey"), "f", 4, third, named, F.floor("o_totalprice").cast("long"), c("o_orderdate").cast("timestamp"))
    return out.unionAll(files)


def business_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business tree as an index of its own, as a crawl would be: written once while its tables stay as they are,
    sorted by path within files, so that searches that look at it several times read it rather than join it anew."""
    state = tuple(stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "orders"))
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _catalogs:
        _catalogs[key] = written(business_tree(spark, sf_dir).sortWithinPartitions("path"), "business-tree")
    return _catalogs[key]
