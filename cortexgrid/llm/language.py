"""Operator 2: language identification by Bayesian evidence fusion.

Text likelihoods come from byte-bigram profiles, summed over all documents by declared language; an even profile stands
for text in none of the languages. The posterior adds how far declared languages can be trusted, and a prior of the
host, smoothed towards its address suffix and that towards the whole corpus. Both are grouped counts of the text's own
verdicts. Only short evidence rows are joined, never texts; profiles are 65,536 numbers a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortexgrid.llm.tokens import tidy
from cortexgrid.plans import materialize

LANGUAGES = ("en", "fr", "de", "es")
OTHER = "und"
#: Log probability of a byte pair in text of no known language.
OTHER_LOG = -9.0
#: A text counts as so many byte pairs at most: they depend on each other.
EVIDENCE_PAIRS = 200
#: Pseudo-counts: of a byte pair, of the level above a host or suffix, and of a declared language.
PAIR_COUNT, PRIOR_COUNT, DECLARED_COUNT = 0.5, 20.0, 20.0


#: Three-letter codes of languages.
CODES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es"}


def declared_code(declared: str) -> Column:
    """The language of a tag such as en-GB, de_AT or spa, in two letters where it has some."""
    code = F.lower(F.trim(F.get(F.split(declared, "[-_]"), F.lit(0))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), code), code, F.lit(""))


def _pairs(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    return b[:-1] * 256 + b[1:]


def _bytes(text: str | None) -> bytes:
    """Lower-cased text with a space at both ends; nothing if it has no letter."""
    text = (text or "").lower()
    return b" " + text.encode() + b" " if any(map(str.isalpha, text)) else b""


def byte_pair_counts(df: DataFrame, text: str, declared: str, languages: tuple[str, ...]) -> DataFrame:
    """(language, pair, n) over all rows whose declared language is known; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), 65536), np.int64)
        for batch in batches:
            for t, d in zip(batch.column(0), batch.column(1)):
                if (d := d.as_py()) in languages and (data := _bytes(t.as_py())):
                    pairs = _pairs(data)
                    if len(pairs) > 8192:
                        sums[languages.index(d)] += np.bincount(pairs, minlength=65536)
                    else:
                        np.add.at(sums[languages.index(d)], pairs, 1)
        which, pair = np.nonzero(sums)
        if len(which):
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(sums[which, pair])], names=["language", "pair", "n"])

    return df.select(text, declared).mapInArrow(tidy(run), "language int, pair int, n long").groupBy("language", "pair").agg(F.sum("n").alias("n"))


def _profiles(counts: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probabilities, 65,536 x (languages and OTHER)."""
    sums = np.zeros((65536, len(languages) + 1))
    for r in counts.collect():  # at most 65,536 rows a language
        sums[r.pair, r.language] = r.n
    logs = np.log((sums + PAIR_COUNT) / (sums.sum(axis=0) + 65536 * PAIR_COUNT))
    logs[:, -1] = OTHER_LOG
    return logs.astype(np.float32)


def text_evidence(df: DataFrame, text: str, profiles: np.ndarray, evidence_pairs: int = EVIDENCE_PAIRS) -> DataFrame:
    """df without text but with _lid_logs, the log likelihood of each language and OTHER; null where the text has no letter."""
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType([*df.drop(text).schema.fields, T.StructField("_lid_logs", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            made = []
            for t in batch.column(at):
                data = _bytes(t.as_py())
                if not data:
                    made.append(None)
                    continue
                total = np.zeros(logs.shape[1])
                for i in range(0, len(data) - 1, 1 << 20):
                    total += logs[_pairs(data[i : i + (1 << 20) + 1])].sum(axis=0, dtype=np.float64)
                made.append((total * min(1.0, evidence_pairs / (len(data) - 1))).tolist())
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(made, pa.list_(pa.float64()))], names=[*names, "_lid_logs"])

    return df.mapInArrow(tidy(run), schema)


def _best(scores: Column, n: int) -> Column:
    """Position of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def _counts(n: int) -> Column:
    return F.array(*(F.sum(F.when(F.col("_lid_best") == i + 1, 1).otherwise(0)).cast("double") for i in range(n)))


def _smoothed(own: Column, above: Column, weight: float) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda x, p: (x + F.lit(weight) * p) / (total + F.lit(weight)))


def identify_languages(df: DataFrame, text: str, declared: str, host: str | None = None, suffix: Column | None = None, languages: tuple[str, ...] = LANGUAGES, threshold: float = 0.5, evidence_pairs: int = EVIDENCE_PAIRS) -> DataFrame:
    """df without text, plus language, confidence (posterior of language) and kept.

    Texts without a letter, null ones too, have a null language and confidence 0. kept is true if the language is one
    of languages and its confidence reaches threshold. A null or unknown declared language, host or suffix is a value
    of its own. Repeated rows get equal results, ties go to the language listed first, an empty df gives no rows.
    The log likelihood of a longer text is scaled down to that of evidence_pairs byte pairs, as neighbouring pairs depend
    on each other: a text that long or longer outweighs declarations and priors by as much as a text of that length.
    Names beginning with _lid are used inside; the three result names must be new.
    """
    names = [*languages, OTHER]
    n = len(names)
    rest = [c for c in df.columns if c != text]
    given = df.withColumn("_lid_declared", declared_code(declared))
    given = given.withColumn("_lid_host", F.coalesce(F.col(host), F.lit("")) if host else F.lit(""))
    given = given.withColumn("_lid_suffix", F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit(""))
    profiles = _profiles(byte_pair_counts(given, text, "_lid_declared", languages), languages)
    rows = materialize(text_evidence(given, text, profiles, evidence_pairs).withColumn("_lid_best", _best(F.col("_lid_logs"), n)), "evidence")
    seen = rows.where("_lid_logs is not null")
    even = F.array(*(F.lit(1.0 / n) for _ in names))
    hosts = materialize(seen.groupBy("_lid_suffix", "_lid_host").agg(_counts(n).alias("own")), "hosts")
    add = lambda of: F.array(*(F.coalesce(F.sum(F.get(of, F.lit(i))), F.lit(0.0)) for i in range(n)))
    suffixes = hosts.groupBy("_lid_suffix").agg(add(F.col("own")).alias("suffix"))
    corpus = hosts.agg(add(F.col("own")).alias("corpus")).first().corpus
    prior = hosts.join(suffixes, "_lid_suffix").withColumn("corpus", F.array(*map(F.lit, corpus)))
    prior = prior.withColumn("corpus", _smoothed(F.col("corpus"), even, 1.0)).withColumn("suffix", _smoothed(F.col("suffix"), F.col("corpus"), PRIOR_COUNT))
    prior = materialize(prior.select("_lid_suffix", "_lid_host", _smoothed(F.col("own"), F.col("suffix"), PRIOR_COUNT).alias("_lid_prior")), "prior")
    said = seen.groupBy("_lid_declared").agg(_counts(n).alias("own"), F.count(F.lit(1)).cast("double").alias("all"))
    totals = said.agg(add(F.col("own")).alias("each"), F.coalesce(F.sum("all"), F.lit(0.0)).alias("rows")).first()
    trust = said.withColumn("each", F.array(*map(F.lit, totals.each))).withColumn("rows", F.lit(totals.rows))
    trust = trust.select("_lid_declared", F.zip_with("own", "each", lambda x, t: (x + DECLARED_COUNT * F.col("all") / F.col("rows")) / (t + DECLARED_COUNT)).alias("_lid_trust"))
    trust = materialize(trust, "trust")
    joined = rows.join(prior, ["_lid_suffix", "_lid_host"], "left").join(trust, "_lid_declared", "left")
    scores = F.zip_with(F.zip_with("_lid_logs", "_lid_prior", lambda a, p: a + F.log(p)), "_lid_trust", lambda a, p: a + F.log(p))
    joined = joined.withColumn("_lid_scores", scores)
    best = _best(F.col("_lid_scores"), n)
    top = F.array_max("_lid_scores")
    mass = F.aggregate("_lid_scores", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    out = joined.withColumn("language", F.get(F.array(*map(F.lit, names)), best - 1)).withColumn("confidence", F.coalesce(1.0 / mass, F.lit(0.0)))
    kept = F.col("language").isin(*languages) & (F.col("confidence") >= threshold)
    return out.select(*rest, "language", "confidence", F.coalesce(kept, F.lit(False)).alias("kept"))


def document_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, language, confidence, kept) for each row: lang is the declared language, source the host.

    A source's last part, after a dot or hyphen, is its address suffix. Nulls, repeated rows and empty docs as in
    identify_languages; other columns are ignored.
    """
    given = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text", "lang", "source").alias("text_hash"))
    return identify_languages(given, "text", "lang", "source", F.regexp_extract("source", r"([^.\-]*)$", 1)).select("doc_id", "text_hash", "language", "confidence", "kept")


def page_languages(pages: DataFrame) -> DataFrame:
    """(page_id, language, confidence, kept) for each row: evidence from html's text, its lang attribute, and the address.

    A null html has no text and no attribute, a null url no host; repeated rows and empty pages as in identify_languages.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    given = pages.select("page_id", plain.alias("text"), F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]+)", 1).alias("declared"), host.alias("host"))
    return identify_languages(given, "text", "declared", "host", F.regexp_extract("host", r"([^.]*)$", 1)).select("page_id", "language", "confidence", "kept")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language isn't identified: those without a letter, null texts too, go.

    Repeated rows go or stay together; an empty docs gives no rows. Names beginning with _lid must not be in docs.
    """
    gone = document_languages(docs).where("not kept").select(F.col("doc_id").alias("_lid_gone"), F.col("text_hash").alias("_lid_text")).distinct()
    gone = materialize(gone, "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_lid_gone")) & (F.xxhash64("text", "lang", "source") == F.col("_lid_text")), "left_anti")
