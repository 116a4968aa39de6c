"""Queries of the text problems over the registry's tables, whole tables and whole texts throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import garbled, lookalikes, mixing, name_links, packing, pii, survivors, tokens
from shelfmark.session import cut_lineage, read_table


def _authors(spark: SparkSession, base: str) -> DataFrame:
    """(value, n): distinct author strings of both columns with their rows."""
    stored = read_table(spark, base, "documents").select(F.col("metadata_author").alias("value"))
    suggested = read_table(spark, base, "llm_document_suggestions").select(F.col("suggested_author").alias("value"))
    return cut_lineage(stored.unionByName(suggested).filter("value is not null").groupBy("value").agg(F.count("*").alias("n")))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return name_links.linked_pairs(name_links.name_classes(_authors(spark, base)))


def p1_canonical(spark: SparkSession, base: str) -> DataFrame:
    """Every author string that names one person or organisation, with its canonical spelling."""
    return name_links.canonical_names(name_links.name_classes(_authors(spark, base)))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    values = lookalikes.name_values(read_table(spark, base, "documents"), read_table(spark, base, "document_paths"))
    return lookalikes.find_unusual(values).select("field", "row_id").distinct()


def p3_forms(spark: SparkSession, base: str) -> DataFrame:
    """Every unusual name or path with its consistent form."""
    values = lookalikes.name_values(read_table(spark, base, "documents"), read_table(spark, base, "document_paths"))
    return lookalikes.find_unusual(values)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return garbled.find_garbled(read_table(spark, base, "documents")).select("doc_id", "field").distinct()


def p4_repairs(spark: SparkSession, base: str) -> DataFrame:
    """Every garbled value with its repair, null where characters are lost."""
    return garbled.find_garbled(read_table(spark, base, "documents"))


def _records(spark: SparkSession, base: str) -> DataFrame:
    return survivors.surviving_records(*(read_table(spark, base, t) for t in ("documents", "document_paths", "scan_jobs", "corpus_sources")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return survivors.dominant_rows(_records(spark, base))


def p5_records(spark: SparkSession, base: str) -> DataFrame:
    """The surviving record of every group of copies, also where no row dominates."""
    return _records(spark, base)


def _text_sizes(spark: SparkSession, base: str) -> DataFrame:
    """(key, tokens) of every non-empty text, counted once and kept in the shared folder."""
    texts = read_table(spark, base, "documents").filter("text <> ''")
    return cut_lineage(texts.select(F.col("doc_id").alias("key"), tokens.token_count(F.col("text")).alias("tokens")))


def p6_containers(spark: SparkSession, base: str) -> DataFrame:
    """The container of every text, or piece of one, for each profile; shorter profiles' lengths are permitted too."""
    # a row per profile written by hand
    profiles = sorted((r["capacity_tokens"], r["profile"]) for r in read_table(spark, base, "pack_profiles").filter("capacity_tokens > 0").collect())
    packed = packing.pack_profiles(_text_sizes(spark, base), [(p, c) for c, p in profiles], [c for c, _ in profiles])
    return packed.withColumnRenamed("key", "doc_id").join(F.broadcast(read_table(spark, base, "pack_profiles").select("profile", "capacity_tokens")), "profile")


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    """Per profile: containers, tokens held, space in full and in downsized containers, and the shares used."""
    bins = p6_containers(spark, base).groupBy("profile", "capacity_tokens", "container").agg(F.max("container_tokens").alias("length"), F.sum("n_tokens").alias("used"))
    sums = bins.groupBy("profile", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("length").alias("space"))
    return sums.withColumn("used_of_space", F.col("tokens") / F.col("space")).withColumn("used_of_capacity", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def _mix_sizes(spark: SparkSession, base: str) -> DataFrame:
    """(key, source, language, topic, tokens): the topic is the first label of the document's latest suggestion."""
    docs = read_table(spark, base, "documents").filter("text <> ''")
    labels = read_table(spark, base, "llm_document_suggestions").select("sha256", "updated_at", "id", F.get(F.from_json("suggested_labels_json", "array<string>"), F.lit(0)).alias("topic"))
    latest = labels.filter("topic is not null").groupBy("sha256").agg(F.max_by("topic", F.struct("updated_at", "id")).alias("topic"))
    sized = docs.select(F.col("doc_id").alias("key"), "source", F.col("lang").alias("language"), "sha256", tokens.token_count(F.col("text")).alias("tokens"))
    return cut_lineage(sized.join(latest, "sha256", "left").drop("sha256"))


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix(_mix_sizes(spark, base), read_table(spark, base, "mix_targets")).withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, base), read_table(spark, base, "mix_targets"))


def p7_marginals(spark: SparkSession, base: str) -> DataFrame:
    """The shares of languages and topics in each mix, with those wanted."""
    sizes, targets = _mix_sizes(spark, base), read_table(spark, base, "mix_targets")
    return mixing.marginals(mixing.mix(sizes, targets), sizes, targets)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.find_segments(read_table(spark, base, "documents")).select("doc_id", "kind", "start_pos").distinct()


def p8_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every text with placeholders in the place of personal information."""
    return pii.redact_texts(read_table(spark, base, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_canonical": p1_canonical,
        "p3_found": p3_found,
        "p3_forms": p3_forms,
        "p4_found": p4_found,
        "p4_repairs": p4_repairs,
        "p5_found": p5_found,
        "p5_records": p5_records,
        "p6_containers": p6_containers,
        "p6_report": p6_report,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p7_marginals": p7_marginals,
        "p8_found": p8_found,
        "p8_redacted": p8_redacted,
    }


_FILLED = " + ".join(f"(coalesce(trim(lower({c})) NOT IN ({', '.join(repr(x) for x in survivors.PLACEHOLDERS)}), false))::INT" for c in survivors.METADATA)
P5_SQL = f"""
WITH rows_ AS (
  SELECT d.sha256, d.doc_id, d.file_name, {_FILLED} AS filled, coalesce(epoch(j.run_at), -1e18) AS run_s, coalesce(s.trust_rank, 1000000000) AS trust
  FROM documents d LEFT JOIN scan_jobs j ON j.job_id = d.last_seen_job LEFT JOIN corpus_sources s ON s.source = d.source
  WHERE d.sha256 IN (SELECT sha256 FROM documents GROUP BY 1 HAVING count(*) > 1)
), best AS (
  SELECT a.* FROM rows_ a WHERE NOT EXISTS (
    SELECT 1 FROM rows_ b WHERE b.sha256 = a.sha256 AND b.doc_id <> a.doc_id
      AND NOT (a.filled >= b.filled AND a.run_s >= b.run_s AND a.trust <= b.trust AND (a.filled > b.filled OR a.run_s > b.run_s OR a.trust < b.trust)))
)
SELECT b.sha256, b.doc_id, min(p.id) AS path_id
FROM best b LEFT JOIN document_paths p ON regexp_extract(lower(p.sha256), '[0-9a-f]{{64}}') = b.sha256 AND ends_with(p.rel_path, '/' || b.file_name)
GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL}
