"""Operator 5: document fingerprints, bottom-k sketches of shingle hashes. DataFrame functions only.

A sketch is the sorted array of the K smallest 64-bit hashes of a text's distinct word shingles. Sketches of parts merge
into that of the whole (the K smallest of their union), as columns or in a grouped aggregation, and give resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes kept: the standard error of a resemblance r is sqrt(r * (1 - r) / K).
K = 128
SHINGLE = 5
#: Rows of one bucket of neighbours in the order of doc_id; the driver holds a bound for each.
BUCKET_ROWS = 5_000
SPACE = r"[\x20\x09-\x0D]+"
_RANGE = 2.0**64


def sketch(text: Column, words: int = SHINGLE, k: int = K) -> Column:
    """Bottom-k sketch of a text: array<bigint>, ascending; empty for null texts and texts without words.

    Words are runs of other characters than space and \\t-\\r, compared as they are. A text of fewer words than a shingle
    is one shingle.
    """
    ws = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words)))
    # the words are made once, as the element of a one-element array
    made = F.transform(F.array(ws), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes(w))), 1, k)))
    return F.get(made, F.lit(0))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """by and column: the merged sketch of each group's rows.

    Hashes are made distinct, then ranked within (group, salt) and among the k best of each salt, so no task gathers a
    large group. Groups whose sketches are all empty or null have no row.
    """
    hashes = df.select(*by, F.explode(column).alias("_h")).distinct().withColumn("_salt", F.pmod("_h", F.lit(64)))
    few = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy("_h"))).where(F.col("_r") <= k)
    best = few.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= k)
    return best.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance, 0 to 1: the share of the union's sketch that both have. 1 for two empty sketches."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + _RANGE / 2) / _RANGE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, at most 1; null if a is empty."""
    return F.when(F.size(a) == 0, F.lit(None)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash of a sketch."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """docs (doc_id, text) with columns computed for each row, and next_<column> (text too) of the row that follows.

    The order is (doc_id, text); a null doc_id comes last, and the first row follows the last. Rows are bucketed by
    doc_id quantiles, a partition each, and the first row of each bucket is also laid at the end of the one before, so
    no sort gathers the table in one task. Rows that repeat one doc_id share a bucket: a doc_id is taken to be near unique.
    """
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    steps = [i / buckets for i in range(1, buckets)]
    found = docs.where("doc_id is not null").approxQuantile("doc_id", steps, 0.2 / buckets) if steps else []
    bounds = sorted({int(b) for b in found})
    # steps of at most 256 comparisons each find the bucket
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    inside = F.lit(0)
    if bounds:
        fine = [bounds[i : i + 256] for i in range(0, len(bounds), 256)]
        coarse = upto(longs([f[0] for f in fine[1:]]))
        inside = coarse * 256 + upto(F.get(F.array(*map(longs, fine)), coarse))
    placed = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(inside).cast("int")).withColumn("_kind", F.lit(0))
    whole = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text"))
    heads = placed.groupBy("_bucket").agg(F.min(whole).alias("_head"))
    # each head goes to the bucket with rows before it, the first one to the last bucket; a row of two numbers a bucket
    order = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    last = F.max("_bucket").over(Window.partitionBy(F.lit(0)))
    moves = placed.select("_bucket").distinct().withColumn("_to", F.coalesce(F.lag("_bucket").over(order), last))
    moved = heads.join(moves, "_bucket").select(F.col("_head.*"), F.col("_to").alias("_bucket"), F.lit(1).alias("_kind")).drop("none")
    rows = placed.unionByName(moved).repartitionById(len(bounds) + 2, F.col("_bucket")).withColumns(columns)
    by = Window.partitionBy("_bucket").orderBy("_kind", F.col("doc_id").asc_nulls_last(), "text")
    return rows.withColumns({f"next_{c}": F.lead(c).over(by) for c in ["text", *columns]}).where("_kind = 0").drop("_bucket", "_kind")


def edited_texts(docs: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """with_next of docs' doc_id and text (null: empty), and edited: the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return with_next(given, columns or {}).withColumn("edited", edited)


def document_fingerprints(docs: DataFrame, words: int = SHINGLE, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next) for each row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by doc_id. Null texts are empty; empty texts have an empty sketch and resemble each other only. Equal texts
    have equal sketches, a single row is its own next one, rows that repeat a doc_id follow each other by text, and
    other columns are ignored. Empty docs give no rows.
    """
    both = edited_texts(docs, {"sketch": sketch(F.col("text"), words, k)}).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited_sketch", sketch(F.col("edited"), words, k))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
