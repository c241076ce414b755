"""The driver's tables seen as a repository of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.text import display_keywords, normalise_sequence
from partloom.session import partitions_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = F.when(F.col("lang") == "de", F.lit("Sequence")).otherwise(F.col("lang"))
    role = F.when(F.col("quality") == 1, F.concat(F.lit("http://roles.example.org/q"), F.col("quality").cast("string"))).when(F.col("quality") == 0, F.lit("http://identifiers.org/so/SO:0000167"))
    return d.select(
        "doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("subject"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("displayId"), F.lit("1").alias("version"),
        F.split("text", "\n")[0].alias("name"), F.col("text").alias("description"), kind.alias("type"), F.col("source").alias("graph"), role.alias("role"), F.lit(None).cast("string").alias("sboltype"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents; the rank is made of the id so that it is easy to state in SQL."""
    p = parts(spark, sf_dir)
    return p.withColumns({"pagerank": (1 + F.pmod("doc_id", F.lit(97))) / 97.0, "keywords": display_keywords(F.col("displayId"))})


def rank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return c.union(p)


def rank_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the edges: they grow with the lines, not the tasks."""
    return partitions_for(table(spark, sf_dir, "lineitem"))


def rank_edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Customers to parts they ordered, parts back to customers of the same key; no loops, so some nodes dangle."""
    n = rank_partitions(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(n, "l_orderkey")
    bought = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    back = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("dst"))
    e = bought.union(back)
    return e.distinct() if distinct else e


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about nations, customers and suppliers; suppliers and nations are top level, customers are not."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    s = F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"))
    n = F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"))
    c = F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"))

    def statements(df: DataFrame, subject, *pairs) -> DataFrame:
        arr = F.array(*(F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")) for p, o in pairs))
        return df.select(F.lit("public").alias("g"), subject.alias("s"), F.explode(arr).alias("x")).select("g", "s", "x.p", "x.o").where("o is not null")

    a = statements(nation, n, ("type", F.lit("Nation")), ("topLevel", n), ("title", F.col("n_name")))
    b = statements(supplier, s, ("type", F.lit("Supplier")), ("topLevel", s), ("title", F.col("s_name")), ("role", F.when(F.col("s_acctbal") > 0, F.lit("creditor"))), ("role", F.when(F.col("s_suppkey") % 3 == 0, F.lit("third"))), ("in", F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string"))))
    d = statements(customer, c, ("type", F.lit("Customer")), ("of", F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"))))
    e = statements(supplier, s, ("serves", F.concat(F.lit("customer/"), F.col("s_suppkey").cast("string"))))
    return a.union(b).union(d).union(e)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("subject"), normalise_sequence(F.col("text")).alias("sequence"))
