"""Stand-in views: the relational tables read as symbols, call edges, text lines, requests and vectors.

There is no source code in the tables, so each concept of the engine gets a relational stand-in: parts are
symbols, consecutive parts of an order are call edges, documents are files of the project ``source``, events
are a request log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.snapshots import EdgeIndex

#: Types that stand for a language family; PROMO is unknown, SMALL is a file that can't define symbols.
FAMILIES = {"ECONOMY": "python", "STANDARD": "ts-js", "MEDIUM": "go", "LARGE": "jvm"}
FUNCTION_TYPES = ("ECONOMY", "STANDARD", "PROMO")
EDGE_TYPES = {"R": "CALLS", "A": "USAGE", "N": "TESTS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(keys: dict[str, str], of: Column, other: str = "") -> Column:
    out = F.lit(other)
    for k, v in keys.items():
        out = F.when(of == k, F.lit(v)).otherwise(out)
    return out


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, file, label, family, non_code, complexity, lines``: one row for each part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"),
        F.when(F.col("p_type").isin(*FUNCTION_TYPES), "Function").otherwise("Method").alias("label"),
        lookup(FAMILIES, F.col("p_type")).alias("family"), (F.col("p_type") == "SMALL").alias("non_code"),
        F.col("p_size").alias("complexity"), F.floor("p_retailprice").cast("int").alias("lines"),
    )


def edge_index(spark: SparkSession, sf_dir: str) -> EdgeIndex:
    """The index of call edges: the first question builds it, later ones read it and follow the changes of the table."""
    items = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")]
    return EdgeIndex(spark, "edges", f"{sf_dir}/lineitem.parquet", items, _neighbours, "l_orderkey")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, type``, distinct: a part and the next part of its order, for large quantities."""
    return edge_index(spark, sf_dir).open().edges


def kept_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, type, i, o``: distinct edges into and out of each node, which the index keeps."""
    return edge_index(spark, sf_dir).open().degrees


def built_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edges`` without the index."""
    return _neighbours(table(spark, sf_dir, "lineitem")).distinct()


def _neighbours(items: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    item = items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), lookup(EDGE_TYPES, F.col("l_returnflag"), "TESTS").alias("type"), "l_quantity")
    return item.where("l_quantity >= 40 and dst is not null and src <> dst").select("src", "dst", "type")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with their ``norm``, which a catalogue keeps with each."""
    e = F.col("embedding")
    square = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.sqrt(square).alias("norm"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, us, root, op, latency, generation``: a request log; ``us`` is microseconds since 1970."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select("event_id", us.alias("us"), F.col("user_id").alias("root"), F.col("event_type").alias("op"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("int").alias("generation"))


def text_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lines``, its text cut at line ends; a line end at the very end opens no further line."""
    parts = F.split("text", "\\r\\n|\\r|\\n", -1)
    whole = F.when(F.col("text") == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.withColumn("lines", whole)
