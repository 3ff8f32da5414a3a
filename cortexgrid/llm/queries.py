"""One query per operator, with production parameters, over its whole table; an empty table gives no rows in any of them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexgrid.llm import alignment, bpe, conversations, fingerprints, jaccard, language, licenses, lines, mixing, rules, shards, substrings, warc


def pieces_path() -> str:
    """The published sentencepiece model; PIECE_MODEL names another file."""
    if named := os.environ.get("PIECE_MODEL"):
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenizer_path() -> str:
    """The published vocabulary; BPE_VOCABULARY names another file."""
    if named := os.environ.get("BPE_VOCABULARY"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); null texts count as empty, repeated rows stay, no rows give none."""
    back = bpe.bpe_round_trip(docs.select("doc_id", "text"), tokenizer_path())
    return back.select(
        "doc_id",
        bpe.n_ids("bpe_ids").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the text they decode to; null texts count as empty, repeated rows stay, very long words are encoded like others."""
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document; null and wordless texts have empty sets and are linked with nothing."""
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document; texts without a letter, null ones too, have none, ties go to the language listed first, repeated rows get equal results."""
    found = language.document_languages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "kept")


def op2_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of pages, with priors of the address's host and suffix; null pages have no language, a null address is a value of its own."""
    return language.page_languages(_table(spark, sf_dir, "pages")).withColumn("confidence", F.round("confidence", 6))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each document; null and empty texts have no words and fail the base rules; repeated rows get equal verdicts."""
    return rules.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record as read back from its archive; null pages are empty payloads."""
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text; null texts count as empty, equal texts have equal fingerprints, one document alone is its own next one."""
    found = fingerprints.document_fingerprints(_table(spark, sf_dir, "documents"))
    text = fingerprints.as_text
    return found.select("doc_id", "n_chars", "edited_sha256", text(F.col("sketch")).alias("fingerprint"), text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; null texts have size 0; null sources come last; rows that repeat share copies evenly."""
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; null and empty texts stay as they are, repeated rows keep the same lines."""
    docs = _table(spark, sf_dir, "documents")
    return lines.dedup_lines(docs.withColumn("old_chars", F.length("text"))).select("doc_id", "text", "lang", "source", "n_chars", "old_chars")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; null texts have size 8; equal rows are told apart by a number."""
    return shards.document_shards(_table(spark, sf_dir, "documents"), 24)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of each document; null and empty texts have none; repeated rows share their spans."""
    return licenses.document_licenses(_table(spark, sf_dir, "documents"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 35 words that start twice; null texts are empty, repeated rows repeat each other."""
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=35)
    return kept.select("doc_id", "n_words", "n_removed", substrings.digest("text").alias("kept_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of each document; null and empty texts, and those that don't come back whole, have zeros; repeated rows count each."""
    found = alignment.align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path(), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost and repair of each damaged conversation; nulls read as one space, a null conv_id is one conversation."""
    given = _table(spark, sf_dir, "conversations")
    return conversations.conversation_digests(given, conversations.damaged(given))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_quality_rules counts before any rule is learned."""
    counted = rules.with_features(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed().alias("base_failed"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that op5_fingerprints compares."""
    return fingerprints.edited_texts(_table(spark, sf_dir, "documents")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_licenses finds by phrases alone."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op2_language_pages": op2_language_pages,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_fingerprints": op5_fingerprints,
    "op6_mix_sources": op6_mix_sources,
    "op7_line_dedup": op7_line_dedup,
    "op8_shards": op8_shards,
    "op9_licenses": op9_licenses,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_substrings": op11_substrings,
    "op12_alignment": op12_alignment,
    "op13_conversations": op13_conversations,
    "quality_base": quality_base,
    "fingerprint_edits": fingerprint_edits,
    "license_phrases": license_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS low FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS fives FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM v
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.sh) + len(sb.sh) - n)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reach FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(reach) AS low FROM r GROUP BY 1) m ON m.doc_id = s.doc_id
""",
    "op11_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY run) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "quality_base": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM w),
v AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS run FROM e),
g AS (SELECT doc_id, i, array_to_string(run, ' ') AS run FROM v WHERE len(run) = 8),
twice AS (SELECT doc_id, run FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM g JOIN twice USING (doc_id, run)) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
""",
    "fingerprint_edits": r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS after FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(after, 1, length(t) // 2)) AS edited_sha256 FROM n
""",
    "license_phrases": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(range(0, len(ws))) AS place, unnest(ws) AS a FROM w),
n AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
hit AS (SELECT doc_id, place, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'reserved' END AS label FROM n),
s AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM hit WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN s USING (doc_id)
""",
}
