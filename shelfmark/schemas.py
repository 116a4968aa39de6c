"""Explicit schemas of the registry's tables and checks of the constraints that storage doesn't enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()
_LIFECYCLE = {"reasoning_summary": _S, "status": _S, "applied": _B, "created_at": _TS, "updated_at": _TS}
TOC_ENTRY = T.StructType([T.StructField("level", _I), T.StructField("title", _S), T.StructField("page", _I)])
METADATA = T.StructType([T.StructField(c, _S) for c in ("title", "author", "creator", "created", "modified")] + [T.StructField("extra", T.MapType(_S, _S))])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "documents": _table(sha256=_S, md5=_S, file_name=_S, normalised_name=_S, llm_enriched_name=_S, metadata_title=_S, metadata_author=_S, metadata_creator=_S, metadata_created=_S, metadata_modified=_S, metadata_extra_json=_S, languages_json=_S, is_digital=_B, toc_valid=_B, toc_invalid_reason=_S, extraction_status=_S, force_extracted=_B, first_seen_job=_S, last_seen_job=_S),
    "document_paths": _table(id=_L, sha256=_S, rel_path=_S),
    "document_toc": _table(id=_L, sha256=_S, level=_I, title=_S, page=_I, position=_I),
    "scanned_file_in_job": _table(rel_path=_S, sha256=_S, size_bytes=_L, mtime=_D, last_scanned_job=_S),
    "scan_jobs": _table(job_id=_S, run_at=_TS, root_path=_S, added=_I, updated=_I, removed=_I, duplicates=_I, skipped=_I),
    "prompts": _table(id=_L, workflow_name=_S, prompt_text=_S, model_provider=_S, model=_S, prompt_version=_S, active=_B, created_at=_TS, updated_at=_TS),
    "taxonomy_nodes": _table(id=_L, parent_id=_L, name=_S, path=_S, depth=_I),
    "taxonomy_node_documents": _table(node_id=_L, sha256=_S),
    "taxonomy_node_topic_terms": _table(node_id=_L, term=_S),
    "taxonomy_assignments": _table(node_id=_L, sha256=_S, assigned_child_id=_L, confidence=_S, reasoning_summary=_S, status=_S, created_at=_TS, updated_at=_TS),
    "llm_document_suggestions": _table(id=_L, sha256=_S, prompt_id=_L, suggested_file_name=_S, suggested_author=_S, suggested_publisher=_S, suggested_edition=_S, suggested_labels_json=_S, **_LIFECYCLE),
    "llm_taxonomy_suggestions": _table(id=_L, sha256=_S, prompt_id=_L, suggested_taxonomy_path=_S, suggested_document_type=_S, suggested_new_subcategory=_S, confidence=_D, **_LIFECYCLE),
    "llm_toc_review_suggestions": _table(id=_L, sha256=_S, prompt_id=_L, toc_is_valid=_B, toc_matches_document=_B, toc_invalid_reason=_S, preface_page=_I, preface_label=_S, confidence=_D, **_LIFECYCLE),
}
#: table -> the column sets that identify a row
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "documents": (("sha256",),), "document_paths": (("id",), ("rel_path",)), "document_toc": (("id",),), "scanned_file_in_job": (("rel_path",),), "scan_jobs": (("job_id",),),
    "prompts": (("id",), ("workflow_name", "model_provider", "model", "prompt_version")), "taxonomy_nodes": (("id",), ("parent_id", "name"), ("path",)), "taxonomy_node_documents": (("node_id", "sha256"),),
    "taxonomy_node_topic_terms": (("node_id", "term"),), "taxonomy_assignments": (("node_id", "sha256"),), "llm_document_suggestions": (("id",), ("sha256", "prompt_id")),
    "llm_taxonomy_suggestions": (("id",), ("sha256", "prompt_id")), "llm_toc_review_suggestions": (("id",), ("sha256", "prompt_id")),
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """(key..., n) of keys that occur more than once; rows with a null in the key are exempt, as in SQL."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return df.filter(known).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null foreign key isn't a key of ``parents``."""
    return df.filter(F.col(column).isNotNull()).join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")
