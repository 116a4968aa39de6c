"""Paths: what storage and registry disagree on, what to do about it, and deleting and moving paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X


def drift(disk: DataFrame, registry: DataFrame) -> DataFrame:
    """(rel_path, disk_sha256, registry_sha256, class) of every path on which storage and registry differ.

    Classes: ``missing_on_disk``, ``hash_mismatch``, ``known_hash_missing_path`` (the content is known under another path) and
    ``missing_hash`` (the content is new).  One full outer join on the path, one join on the digest.
    """
    d = disk.select("rel_path", F.col("sha256").alias("disk_sha256"))
    r = registry.select("rel_path", F.col("sha256").alias("registry_sha256"))
    known = registry.select(F.col("sha256").alias("disk_sha256")).distinct().withColumn("_known", F.lit(True))
    both = d.join(r, "rel_path", "full_outer").filter(~F.col("disk_sha256").eqNullSafe(F.col("registry_sha256"))).join(known, "disk_sha256", "left")
    kind = F.when(F.col("disk_sha256").isNull(), "missing_on_disk").when(F.col("registry_sha256").isNotNull(), "hash_mismatch").when(F.col("_known"), "known_hash_missing_path").otherwise("missing_hash")
    return both.select("rel_path", "disk_sha256", "registry_sha256", kind.alias("class"))


def reconcile_plan(drifted: DataFrame) -> DataFrame:
    """(rel_path, action): paths to discover and to remove; mismatches of content are only reported."""
    action = F.when(F.col("class").isin("missing_hash", "known_hash_missing_path"), "discover").when(F.col("class") == "missing_on_disk", "remove")
    return drifted.select("rel_path", action.alias("action")).filter("action is not null")


def guard(requested: DataFrame, path: str) -> DataFrame:
    """(asked, rel_path, verdict): whether a requested path stays inside its root and is a PDF."""
    normal = X.normal_path(F.col(path))
    verdict = F.when(normal.isNull() | (normal == ""), "outside").when(~F.lower(normal).endswith(".pdf"), "not_pdf").otherwise("ok")
    return requested.select(F.col(path).alias("asked"), normal.alias("rel_path"), verdict.alias("verdict"))


def delete_report(requested: DataFrame, disk: DataFrame, registry: DataFrame) -> DataFrame:
    """(rel_path, outcome) of requested deletions: done only where both file and row exist."""
    asked = requested.select("rel_path").distinct()
    both = asked.join(disk.select("rel_path", F.lit(True).alias("_file")).distinct(), "rel_path", "left").join(registry.select("rel_path", F.lit(True).alias("_row")).distinct(), "rel_path", "left")
    outcome = F.when(F.col("_file") & F.col("_row"), "deleted").when(F.col("_file"), "only_on_disk").when(F.col("_row"), "only_in_registry").otherwise("unknown")
    return both.select("rel_path", outcome.alias("outcome"))


def delete_paths(paths: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths left, report of (rel_path, sha256, remaining)) after the paths in ``gone`` are deleted."""
    left = paths.join(gone.select("rel_path"), "rel_path", "left_anti").select(*paths.columns)
    hit = paths.join(gone.select("rel_path").distinct(), "rel_path", "left_semi")
    counts = left.groupBy("sha256").agg(F.count("*").alias("remaining"))
    return left, hit.join(counts, "sha256", "left").select("rel_path", "sha256", F.coalesce("remaining", F.lit(0)).alias("remaining"))


def delete_scans(state: DataFrame, report: DataFrame) -> DataFrame:
    """Scan state without the rows of deleted paths (``rel_path`` of the report)."""
    return state.join(report.select("rel_path"), "rel_path", "left_anti").select(*state.columns)


def move_paths(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """(old_path, new_path, sha256, outcome) of moves: the old path must be known and the new one free.

    ``dropped``: the new path already belongs to the same document; ``refused``: to another one; ``unknown``: no such old path.
    """
    old = paths.select(F.col("rel_path").alias("old_path"), "sha256")
    new = paths.select(F.col("rel_path").alias("new_path"), F.col("sha256").alias("_owner"))
    both = moves.select("old_path", "new_path").join(old, "old_path", "left").join(new, "new_path", "left")
    outcome = F.when(F.col("sha256").isNull(), "unknown").when(F.col("_owner").isNull(), "moved").when(F.col("_owner") == F.col("sha256"), "dropped").otherwise("refused")
    return both.select("old_path", "new_path", "sha256", outcome.alias("outcome"))


def resolve_targets(listing: DataFrame, path: str) -> DataFrame:
    """(rel_path): distinct PDF files of a listing, inside the root."""
    return guard(listing, path).filter("verdict = 'ok'").select("rel_path").distinct()


def upsert_paths(paths: DataFrame, new: DataFrame) -> DataFrame:
    """Paths with new ones put in; a path that is there already stays with its document."""
    fresh = new.select("sha256", "rel_path").join(paths.select("rel_path"), "rel_path", "left_anti")
    return paths.select("sha256", "rel_path").unionByName(fresh.groupBy("rel_path").agg(F.min("sha256").alias("sha256")).select("sha256", "rel_path"))


def moved_paths(paths: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(sha256, rel_path) after the moves that ``move_paths`` judged: moved ones renamed, dropped ones gone."""
    gone = outcomes.filter("outcome in ('moved', 'dropped')").select(F.col("old_path").alias("rel_path"))
    new = outcomes.filter("outcome = 'moved'").select("sha256", F.col("new_path").alias("rel_path"))
    return paths.select("sha256", "rel_path").join(gone, "rel_path", "left_anti").select("sha256", "rel_path").unionByName(new)


def moved_scans(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Scan state after the moves that ``move_paths`` judged: rows of moved paths are renamed, in place of any that lay there."""
    moves = outcomes.filter("outcome = 'moved'").select(F.col("old_path").alias("rel_path"), F.col("new_path").alias("_new"))
    hit = state.join(moves, "rel_path").select(*[F.col("_new").alias(c) if c == "rel_path" else F.col(c) for c in state.columns])
    rest = state.join(moves.select("rel_path"), "rel_path", "left_anti").join(hit.select("rel_path"), "rel_path", "left_anti")
    return rest.select(*state.columns).unionByName(hit)


def moved_names(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents named after the path they were moved to; of several the last in path order."""
    names = outcomes.filter("outcome = 'moved'").groupBy("sha256").agg(X.basename(F.max("new_path")).alias("_name"))
    return documents.join(names, "sha256", "left").select(*[F.coalesce("_name", "file_name").alias("file_name") if c == "file_name" else F.col(c) for c in documents.columns])
