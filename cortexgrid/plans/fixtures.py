"""Voxel, log and graph views over the star-schema tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5))).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("z"), "label", F.transform("embedding", value).alias("r"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is an 8 x 8 section."""
    flat = _sections(spark, sf_dir).select("z", F.posexplode("r").alias("p", "raw"))
    return flat.select(F.lit(0).alias("volume_id"), "z", F.expr("cast(p div 8 as bigint)").alias("y"), (F.col("p") % 8).cast("bigint").alias("x"), "raw")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("cast(if(raw < 112, 0, 1 + x div 4 + 2 * (y div 4) + 4 * (z div 25)) as bigint)")
    return raw(spark, sf_dir).withColumn("label", label)


def labels_bg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).withColumn("label", F.when(F.col("label") == 0, F.lit(-3)).otherwise(F.col("label")).cast("bigint"))


def raw0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).withColumn("raw", F.greatest(F.col("raw") - 120, F.lit(0)))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).withColumn("mask", (F.col("raw") >= 165).cast("int"))


def affs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affinities (z, y, x) from the differences of neighbouring values; 0 at the border."""
    own = _sections(spark, sf_dir).select("z", "r")
    back = own.select((F.col("z") + 1).alias("z"), F.col("r").alias("b"))
    # whole sections meet, and the neighbours along y and x are in the same one
    flat = own.join(back, "z", "left").select("z", "r", "b", F.posexplode("r").alias("p", "raw"))
    step = lambda before: F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.col("raw") - before) / 40.0), F.lit(0.0))
    near = F.array(step(F.get("b", F.col("p"))), step(F.get("r", F.col("p") - 8)), step(F.when(F.col("p") % 8 > 0, F.get("r", F.col("p") - 1))))
    return flat.select(F.lit(0).alias("volume_id"), "z", F.expr("cast(p div 8 as bigint)").alias("y"), (F.col("p") % 8).cast("bigint").alias("x"), near.alias("affs"))


def lsds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten channels from consecutive values; values over 150 become NaN in channel 0."""
    flat = _sections(spark, sf_dir).select("z", "r", F.posexplode("r").alias("p", "raw"))
    channels = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.get("r", (F.col("p") + i) % 64) / 255.0)
    return flat.select(F.lit(0).alias("volume_id"), "z", F.expr("cast(p div 8 as bigint)").alias("y"), (F.col("p") % 8).cast("bigint").alias("x"), channels.alias("lsds"))


def coarse_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raw(spark, sf_dir).select("volume_id", F.expr("z div 5 as z"), F.expr("y div 2 as y"), F.expr("x div 2 as x"), "raw")
    return cells.groupBy("volume_id", "z", "y", "x").agg((F.avg("raw") >= 127).cast("int").alias("mask"))


def source(spark: SparkSession, sf_dir: str, odd: int = 0) -> DataFrame:
    chosen = _sections(spark, sf_dir).where(F.col("label") % 2 == odd).select("z")
    return raw0(spark, sf_dir).join(chosen, "z", "left_semi").select("volume_id", "z", "y", "x", "raw")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, 1)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw(spark, sf_dir).withColumn("pair_id", F.expr("z div 2"))
    both = df.groupBy("pair_id", "y", "x").agg(F.max(F.when(F.col("z") % 2 == 0, F.col("raw"))).alias("a"), F.max(F.when(F.col("z") % 2 == 1, F.col("raw"))).alias("b"))
    return both.where("a is not null and b is not null")


def syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("z"), F.transform("embedding", lambda e: e.cast("double")).alias("e"))
    flat = flat.select("z", "e", F.posexplode("e").alias("p", "v"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get("e", (F.col("p") + i) % 64) * 100)
    return flat.select(F.lit(0).alias("volume_id"), "z", F.expr("cast(p div 8 as bigint)").alias("y"), (F.col("p") % 8).cast("bigint").alias("x"), ((F.col("v") + 1) / 2).alias("indicator"), vec.alias("vec"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("block_id"), F.col("ts").alias("start"), F.col("value").alias("duration"), F.col("user_id").alias("worker"), F.col("event_type").alias("status"))


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("status in ('purchase', 'view')")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("bigint").alias("u"), (F.lit(1000000) + F.col("l_suppkey")).cast("bigint").alias("v"))
    e = e.agg(F.min("l_discount").cast("double").alias("d"), F.count(F.lit(1)).alias("contacts"))
    return e.select("u", "v", F.when(F.col("u") % 13 != 0, F.col("d") * 10).alias("merge_score"), "contacts")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("node"), F.col("p_size").cast("double").alias("center_z"), F.col("p_retailprice").cast("double").alias("center_y"), (F.col("p_partkey") % 100).cast("double").alias("center_x"))
    s = table(spark, sf_dir, "supplier").select((F.lit(1000000) + F.col("s_suppkey")).cast("bigint").alias("node"), F.col("s_nationkey").cast("double").alias("center_z"), F.col("s_acctbal").cast("double").alias("center_y"), (F.col("s_suppkey") % 100).cast("double").alias("center_x"))
    return p.unionByName(s)


_RAW = "CAST(greatest(0, least(255, floor((CAST(embedding[{}] AS DOUBLE) + 1) * 127.5))) AS INT)"
_AT = "0 AS volume_id, vec_id AS z, CAST((p - 1) // 8 AS BIGINT) AS y, CAST((p - 1) % 8 AS BIGINT) AS x"
_FROM = "FROM embeddings, (SELECT unnest(range(1, 65)) AS p)"

SQL = {
    "fx_raw": f"SELECT {_AT}, {_RAW.format('p')} AS raw {_FROM}",
    "fx_labels": "SELECT *, CASE WHEN raw < 112 THEN 0 ELSE 1 + x // 4 + 2 * (y // 4) + 4 * (z // 25) END AS label FROM fx_raw",
    "fx_labels_bg": "SELECT volume_id, z, y, x, raw, CASE WHEN label = 0 THEN -3 ELSE label END AS label FROM fx_labels",
    "fx_raw0": "SELECT volume_id, z, y, x, greatest(raw - 120, 0) AS raw FROM fx_raw",
    "fx_mask": "SELECT *, CASE WHEN raw >= 165 THEN 1 ELSE 0 END AS mask FROM fx_raw",
    "fx_affs": "SELECT r.volume_id, r.z, r.y, r.x, [coalesce(greatest(0.0::DOUBLE, 1 - abs(r.raw - a.raw) / 40.0::DOUBLE), 0), coalesce(greatest(0.0::DOUBLE, 1 - abs(r.raw - b.raw) / 40.0::DOUBLE), 0), coalesce(greatest(0.0::DOUBLE, 1 - abs(r.raw - c.raw) / 40.0::DOUBLE), 0)] AS affs FROM fx_raw r LEFT JOIN fx_raw a ON (a.z, a.y, a.x) = (r.z - 1, r.y, r.x) LEFT JOIN fx_raw b ON (b.z, b.y, b.x) = (r.z, r.y - 1, r.x) LEFT JOIN fx_raw c ON (c.z, c.y, c.x) = (r.z, r.y, r.x - 1)",
    "fx_lsds": f"SELECT {_AT}, list_transform(range(0, 10), lambda i: greatest(0, least(255, floor((CAST(embedding[(p - 1 + i) % 64 + 1] AS DOUBLE) + 1) * 127.5))) / 255.0::DOUBLE) AS lsds {_FROM}",
    "fx_coarse_mask": "SELECT volume_id, z // 5 AS z, y // 2 AS y, x // 2 AS x, CASE WHEN avg(raw) >= 127 THEN 1 ELSE 0 END AS mask FROM fx_raw GROUP BY ALL",
    "fx_source": "SELECT * FROM fx_raw0 WHERE z IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)",
    "fx_target": "SELECT * FROM fx_raw0 WHERE z IN (SELECT vec_id FROM embeddings WHERE label % 2 = 1)",
    "fx_pairs": "SELECT a.z // 2 AS pair_id, a.y, a.x, a.raw AS a, b.raw AS b FROM fx_raw a JOIN fx_raw b ON (b.z, b.y, b.x) = (a.z + 1, a.y, a.x) WHERE a.z % 2 = 0",
    "fx_syn": f"SELECT {_AT}, (CAST(embedding[p] AS DOUBLE) + 1) / 2 AS indicator, list_transform(range(0, 3), lambda i: CAST(embedding[(p - 1 + i) % 64 + 1] AS DOUBLE) * 100) AS vec {_FROM}",
    "fx_log": "SELECT event_id AS block_id, ts AS start, value AS duration, user_id AS worker, event_type AS status FROM events",
    "fx_done": "SELECT * FROM fx_log WHERE status IN ('purchase', 'view')",
    "fx_rag_edges": "SELECT CAST(l_partkey AS BIGINT) AS u, CAST(1000000 + l_suppkey AS BIGINT) AS v, CASE WHEN l_partkey % 13 <> 0 THEN CAST(min(l_discount) AS DOUBLE) * 10 END AS merge_score, count(*) AS contacts FROM lineitem GROUP BY l_partkey, l_suppkey",
    "fx_rag_nodes": "SELECT CAST(p_partkey AS BIGINT) AS node, CAST(p_size AS DOUBLE) AS center_z, CAST(p_retailprice AS DOUBLE) AS center_y, CAST(p_partkey % 100 AS DOUBLE) AS center_x FROM part UNION ALL SELECT 1000000 + s_suppkey, s_nationkey, s_acctbal, s_suppkey % 100 FROM supplier",
}
_NEEDS = {"fx_labels": ["fx_raw"], "fx_labels_bg": ["fx_labels"], "fx_raw0": ["fx_raw"], "fx_mask": ["fx_raw"], "fx_affs": ["fx_raw"], "fx_coarse_mask": ["fx_raw"], "fx_source": ["fx_raw0"], "fx_target": ["fx_raw0"], "fx_pairs": ["fx_raw"], "fx_done": ["fx_log"]}


def with_views(sql: str, recursive: bool = False) -> str:
    """sql (a query, or CTEs and a query after 'WITH') with the fx_ views it names in front."""
    todo, need = [n for n in SQL if n in sql], []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in need:
            need.append(name)

    for n in todo:
        add(n)
    body = sql.strip()
    if not need:
        return body
    rest = ", " + body[4:].strip() if body.upper().startswith("WITH") else " " + body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in need) + rest
