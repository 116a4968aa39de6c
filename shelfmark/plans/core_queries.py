"""All core queries: the registry's own, and those of the general (not text) problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import instants
from shelfmark.plans import registry_queries, taxonomy_queries, workflow_queries
from shelfmark.session import read_table


def _seen(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """(doc_id, seen_s): when the job ran that first saw a row."""
    runs = jobs.select(F.col("job_id").alias("first_seen_job"), F.unix_seconds(F.col("run_at").cast("timestamp")).alias("seen_s"))
    return documents.select("doc_id", "first_seen_job").join(runs, "first_seen_job").select("doc_id", "seen_s")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    documents, sources = read_table(spark, base, "documents"), read_table(spark, base, "corpus_sources")
    return instants.to_instants(documents, sources, _seen(documents, read_table(spark, base, "scan_jobs"))).distinct()


def p2_zones(spark: SparkSession, base: str) -> DataFrame:
    """(source, from_day, zone, violations, evidence, estimated_zone, declared_zone): the offset history of each source's clock.

    ``estimated_zone`` is what the evidence alone gives.
    """
    documents, sources = read_table(spark, base, "documents"), read_table(spark, base, "corpus_sources")
    fields = ("metadata_created", "metadata_modified")
    values, declared = instants.source_values(documents, sources, "doc_id", fields, "source")
    return instants.estimate_zones(instants.offset_evidence(values, _seen(documents, read_table(spark, base, "scan_jobs")), "doc_id", "source", *fields), "source", declared)


_CATALOGS = (registry_queries.catalog, taxonomy_queries.catalog, workflow_queries.catalog)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for c in _CATALOGS for name, q in c.all.items()} | {"p2_found": p2_found, "p2_zones": p2_zones}


def oracle_sql() -> dict[str, str]:
    return {name: sql for c in _CATALOGS for name, sql in c.sql.items()}
