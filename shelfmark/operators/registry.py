"""The registry as tables: flattening and nesting, scan merge, upserts, backfill, duplicates and carry-over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas
from shelfmark.functions import text as X


def metadata_projection(raw: DataFrame, key: str, metadata: str) -> DataFrame:
    """(key, title, author, creator, created, modified, extra) from a map of raw metadata; empty strings are null.

    ``extra`` holds the keys that aren't one of the five and have a value.
    """
    names = {"title": "title", "author": "author", "creator": "creator", "creationDate": "created", "modDate": "modified"}
    m = F.col(metadata)
    extra = F.map_filter(m, lambda k, v: ~k.isin(*names) & v.isNotNull() & (v != ""))
    return raw.select(key, *[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")).alias(n) for k, n in names.items()], extra.alias("extra"))


def digital_flag(pages: DataFrame, key: str, page: str, text: str, first: int = 3, least: int = 100) -> DataFrame:
    """(key, is_digital): whether the first pages hold enough characters besides white space at their ends."""
    size = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return pages.groupBy(key).agg((F.coalesce(F.sum(F.when(F.col(page) < first, size)), F.lit(0)) >= least).alias("is_digital"))


def flatten_paths(records: DataFrame) -> DataFrame:
    """(sha256, rel_path) of records with an array of paths."""
    return records.select("sha256", F.explode("paths").alias("rel_path"))


def flatten_toc(records: DataFrame) -> DataFrame:
    """(sha256, position, level, title, page) of records with an array of outline entries; titles cleaned."""
    return records.select("sha256", F.posexplode("toc").alias("position", "_e")).select("sha256", "position", F.col("_e.level").alias("level"), X.clean_text(F.col("_e.title")).alias("title"), F.col("_e.page").alias("page"))


def nest(documents: DataFrame, paths: DataFrame, toc: DataFrame) -> DataFrame:
    """Documents with their sorted paths and their outline in order of position."""
    p = paths.groupBy("sha256").agg(F.sort_array(F.collect_set("rel_path")).alias("paths"))
    t = toc.groupBy("sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "level", "title", "page"))), lambda e: F.struct(e["level"].alias("level"), e["title"].alias("title"), e["page"].alias("page"))).alias("toc"))
    return documents.join(p, "sha256", "left").join(t, "sha256", "left")


def duplicates(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """(sha256, file_name, path_count, paths) of documents with more than one path."""
    many = paths.groupBy("sha256").agg(F.count("*").alias("path_count"), F.sort_array(F.collect_list("rel_path")).alias("paths")).filter("path_count > 1")
    return documents.select("sha256", "file_name").join(many, "sha256")


def candidates(documents: DataFrame, toc: DataFrame, require_digital: bool = False, require_toc: bool = False) -> DataFrame:
    """Documents that a workflow may take up."""
    out = documents.filter("is_digital") if require_digital else documents
    return out.join(toc.select("sha256"), "sha256", "left_semi") if require_toc else out


def exclude_by_keyword(documents: DataFrame, paths: DataFrame, keywords: list[str]) -> DataFrame:
    """Documents none of whose paths holds one of the keywords."""
    hit = paths.filter(X.contains_any(F.col("rel_path"), keywords)).select("sha256")
    return documents.join(hit, "sha256", "left_anti")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in or in place by key; ``new`` must be unique in it."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new.select(*old.columns))


def carry_over(suggestions: DataFrame, known: DataFrame) -> DataFrame:
    """Suggestions of documents that are still known, to be kept when a registry is imported anew."""
    return suggestions.join(known.select("sha256"), "sha256", "left_semi")


def document_rows(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the documents table from extracted or nested records: metadata and languages as their columns, all else by name."""
    meta = {f"metadata_{c}": F.col(f"metadata.{c}") for c in ("title", "author", "creator", "created", "modified")}
    own = meta | {"metadata_extra_json": F.to_json("metadata.extra"), "languages_json": F.to_json("languages")}
    return records.select(*[own[f.name].alias(f.name) if f.name in own else F.col(f.name).cast(f.dataType) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def nested_records(nested: DataFrame) -> DataFrame:
    """Nested documents with their metadata as one field and their languages as an array: ``document_rows`` the other way round."""
    names = ("title", "author", "creator", "created", "modified")
    have = set(nested.columns)
    extra = F.from_json("metadata_extra_json", "map<string,string>") if "metadata_extra_json" in have else F.lit(None).cast("map<string,string>")
    fields = [F.col(f"metadata_{c}").alias(c) if f"metadata_{c}" in have else F.lit(None).cast("string").alias(c) for c in names]
    languages = F.from_json("languages_json", "array<string>") if "languages_json" in have else F.lit(None).cast("array<string>")
    return nested.withColumn("metadata", F.struct(*fields, extra.alias("extra"))).withColumn("languages", languages)


def import_tables(registry: dict[str, DataFrame], suggestions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a registry of nested records (``sources.files.read_registry``), and the suggestions that are carried over to it.

    Ids of paths and outline entries are hashes of what they stand for, so that an import that is repeated gives the same.
    """
    nested = registry["documents"]
    paths = flatten_paths(nested.filter("paths is not null")).distinct()
    toc = flatten_toc(nested.filter("toc is not null"))
    jobs = registry["scan_jobs"]
    out = {
        "documents": document_rows(nested, schemas.TABLES["documents"]),
        "document_paths": paths.select(F.xxhash64("rel_path").alias("id"), "sha256", "rel_path"),
        "document_toc": toc.select(F.xxhash64("sha256", "position").alias("id"), "sha256", "level", "title", "page", "position"),
        "scanned_file_in_job": registry["scanned_files_in_job"].select(*schemas.TABLES["scanned_file_in_job"].names),
        "scan_jobs": jobs.select(*[F.try_to_timestamp(F.col("run_at")).cast("timestamp_ntz").alias("run_at") if c == "run_at" else F.col(c) for c in schemas.TABLES["scan_jobs"].names]),
    }
    if suggestions is not None:
        out["llm_document_suggestions"] = carry_over(suggestions, out["documents"])
    return out


def import_summary(documents: DataFrame, paths: DataFrame, toc: DataFrame, state: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts; each table is counted where it is, only counts are moved."""
    tables = {"documents": documents, "paths": paths, "toc_entries": toc, "scanned_files": state, "scan_jobs": jobs}
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])
    return counts.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in tables])


def backfill(documents: DataFrame) -> DataFrame:
    """(doc_id, stored, recomputed) of rows whose stored normalised name isn't what the rules give."""
    rows = documents.select("doc_id", F.col("normalised_name").alias("stored"), X.normalise_file_name(F.col("file_name")).alias("recomputed"))
    return rows.filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


# -- scan merge ------------------------------------------------------------------------------------------------------


def merge_rows(paths: DataFrame, state: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch (rel_path, sha256, size_bytes, mtime) with what each row does to the registry.

    A row is ``added`` if no prior path has its digest and it is the first of that digest in path order; otherwise it is
    ``duplicate`` if the digest doesn't have the path yet, and ``updated`` or ``skipped`` by whether the prior scan state of the path is
    missing or of another time.  The first of a digest is found by aggregation, so a digest that a third of the rows share
    needs no window.
    """
    known = paths.select("sha256").distinct().withColumn("_known", F.lit(True))
    first = batch.groupBy("sha256").agg(F.min("rel_path").alias("_first"))
    pairs = paths.select("sha256", "rel_path").distinct().withColumn("_owned", F.lit(True))
    prior = state.select("rel_path", F.col("sha256").alias("prior_sha256"), F.col("mtime").alias("prior_mtime"), F.lit(True).alias("_seen"))
    rows = batch.join(known, "sha256", "left").join(first, "sha256").join(pairs, ["sha256", "rel_path"], "left").join(prior, "rel_path", "left")
    added = F.col("_known").isNull() & (F.col("rel_path") == F.col("_first"))
    fresh = F.col("_seen").isNull() | ~F.col("mtime").eqNullSafe(F.col("prior_mtime"))
    flags = {"added": added, "duplicate": ~added & F.col("_owned").isNull(), "updated": ~added & fresh, "skipped": ~added & ~fresh}
    return rows.select("rel_path", "sha256", "size_bytes", "mtime", "prior_sha256", *[f.alias(n) for n, f in flags.items()])


def merge_stats(rows: DataFrame, state: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: added, updated, removed (documents that had a path no longer in the batch), duplicates, skipped."""
    names = {"added": "added", "updated": "updated", "duplicate": "duplicates", "skipped": "skipped"}
    sums = rows.agg(*[F.count_if(F.col(f)).alias(n) for f, n in names.items()]).withColumn("removed", F.lit(None).cast("bigint"))
    gone = state.join(batch.select("rel_path"), "rel_path", "left_anti").agg(F.count_distinct("sha256").alias("removed"))
    both = sums.unionByName(gone, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in ("added", "updated", "removed", "duplicates", "skipped")])


def merge_paths(paths: DataFrame, rows: DataFrame, strict: bool = False) -> DataFrame:
    """(sha256, rel_path) after the merge.

    A path belongs to the digest last seen at it.  With ``strict`` the prior owner loses it only to a newly added
    document, so that a path may have two owners.
    """
    if strict:
        lost = rows.filter(F.col("added") & (F.col("prior_sha256") != F.col("sha256"))).select(F.col("prior_sha256").alias("sha256"), "rel_path")
        kept = paths.join(lost, ["sha256", "rel_path"], "left_anti")
    else:
        kept = paths.join(rows.select("rel_path"), "rel_path", "left_anti")
    return kept.select("sha256", "rel_path").unionByName(rows.select("sha256", "rel_path")).distinct()


def merge_state(state: DataFrame, rows: DataFrame, job_id: str) -> DataFrame:
    """Scan state after the merge: new rows for added and updated paths, the job alone for skipped ones."""
    cols = ["rel_path", "sha256", "size_bytes", "mtime", "last_scanned_job"]
    new = rows.filter(F.col("added") | F.col("updated")).select("rel_path", "sha256", "size_bytes", "mtime", F.lit(job_id).alias("last_scanned_job"))
    kept = state.join(new.select("rel_path"), "rel_path", "left_anti")
    seen = rows.filter("skipped").select("rel_path", F.lit(True).alias("_seen"))
    job = F.when(F.col("_seen"), F.lit(job_id)).otherwise(F.col("last_scanned_job")).alias("last_scanned_job")
    return kept.join(seen, "rel_path", "left").select(*cols[:4], job).unionByName(new)


def merge_documents(documents: DataFrame, rows: DataFrame, job_id: str, records: DataFrame | None = None) -> DataFrame:
    """Documents with all their columns after the merge; a new document is named after its first path.

    ``records``: (rel_path, any columns of documents) of the batch, from which a new document takes what it is not given here; columns that
    neither has are null.
    """
    job = F.lit(job_id)
    seen = rows.groupBy("sha256").agg(F.max(F.when(F.col("added"), F.col("rel_path"))).alias("_path"))
    old = documents.join(seen.select("sha256", F.lit(True).alias("_seen")), "sha256", "left")
    kept = old.select(*[F.when(F.col("_seen"), job).otherwise(F.col(c)).alias(c) if c == "last_seen_job" else F.col(c) for c in documents.columns])
    fresh = seen.filter("_path is not null").join(documents.select("sha256"), "sha256", "left_anti")
    given = {"sha256": F.col("sha256"), "file_name": X.basename(F.col("_path")), "first_seen_job": job, "last_seen_job": job}
    if records is not None:
        extra = [c for c in records.columns if c in documents.columns and c not in given]
        one = records.groupBy(F.col("rel_path").alias("_path")).agg(F.first(F.struct(F.lit(0).alias("_"), *extra)).alias("_r"))
        fresh = fresh.join(one, "_path", "left")
        given |= {c: F.col(f"_r.{c}") for c in extra}
    return kept.unionByName(fresh.select(*[given.get(c, F.lit(None)).cast(documents.schema[c].dataType).alias(c) for c in documents.columns]))


def keyword_dedup(keywords: DataFrame, keyword: str, position: str) -> DataFrame:
    """(position, keyword): trimmed, non-blank, the first spelling of each keyword whatever its case."""
    rows = keywords.select(F.trim(keyword).alias("keyword"), F.col(position).alias("position")).filter("keyword <> ''")
    return rows.groupBy(F.lower("keyword").alias("_k")).agg(F.min(F.struct("position", "keyword")).alias("_f")).select("_f.position", "_f.keyword")


def message_level(message: Column) -> Column:
    """Level of a message of the extraction library: its harmless kinds are for debugging."""
    return F.when(F.lower(message).rlike(r"^(?:ignoring |font |cmap |embedded icc)"), "DEBUG").otherwise("WARNING")
