"""The registry as the operators expect it, derived from the stored tables; each view in DataFrame form and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import read_table

#: Jobs up to this place in the order of (run_at, job_id) are the registry's past; later ones form the batch that is merged.
PAST_JOBS = 100
JOB_ID = "merged-job"
ROOT = "/data"
KEYWORDS = ["backup", "intake/2021"]


def _digest(c: str):
    return F.regexp_extract(F.lower(c), "[0-9a-f]{64}", 0)


def documents(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """One row per digest: that of the smallest id; found in one pass."""
    docs = read_table(spark, base, "documents").filter("sha256 is not null")
    if not columns:
        return docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct(*columns), "doc_id").alias("_d"))
    return first.select("sha256", "doc_id", *[F.col(f"_d.{c}").alias(c) for c in columns])


def paths(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "document_paths").select(_digest("sha256").alias("sha256"), "rel_path").distinct()


def toc(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "document_toc").select("sha256", "position", "level", "title", "page")


def _scans(spark: SparkSession, base: str) -> DataFrame:
    jobs = read_table(spark, base, "scan_jobs")
    ranked = jobs.select(F.col("job_id").alias("last_scanned_job"), F.row_number().over(Window.orderBy("run_at", "job_id")).alias("n"))
    rows = read_table(spark, base, "scanned_file_in_job").select("rel_path", _digest("sha256").alias("sha256"), "size_bytes", "mtime", "last_scanned_job")
    return rows.join(ranked, "last_scanned_job")


def _latest(rows: DataFrame) -> DataFrame:
    pick = F.max(F.struct("n", "sha256", "size_bytes", F.coalesce("mtime", F.lit(-1.0)).alias("_m"), "mtime", "last_scanned_job")).alias("r")
    return rows.groupBy("rel_path").agg(pick).select("rel_path", "r.sha256", "r.size_bytes", "r.mtime", "r.last_scanned_job")


def prior_state(spark: SparkSession, base: str) -> DataFrame:
    return _latest(_scans(spark, base).filter(F.col("n") <= PAST_JOBS))


def prior_paths(spark: SparkSession, base: str) -> DataFrame:
    return _scans(spark, base).filter(F.col("n") <= PAST_JOBS).select("sha256", "rel_path").distinct()


def batch(spark: SparkSession, base: str) -> DataFrame:
    return _latest(_scans(spark, base).filter(F.col("n") > PAST_JOBS)).drop("last_scanned_job")


def nodes(spark: SparkSession, base: str) -> DataFrame:
    region, nation = read_table(spark, base, "region"), read_table(spark, base, "nation")
    long = lambda c: c.cast("bigint")
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("Root").alias("name"), F.lit("Root").alias("path"), F.lit(0).alias("depth"))
    regions = region.select(long(F.col("r_regionkey") + 10).alias("id"), F.lit(1).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"), F.concat(F.lit("Root/"), "r_name").alias("path"), F.lit(1).alias("depth"))
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    nations = joined.select(long(F.col("n_nationkey") + 100).alias("id"), long(F.col("n_regionkey") + 10).alias("parent_id"), F.col("n_name").alias("name"), F.concat(F.lit("Root/"), "r_name", F.lit("/"), "n_name").alias("path"), F.lit(2).alias("depth"))
    return root.unionByName(regions).unionByName(nations)


def _customers(spark: SparkSession, base: str) -> DataFrame:
    nation = read_table(spark, base, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return read_table(spark, base, "customer").join(nation, "c_nationkey").withColumn("sha256", F.sha2("c_name", 256))


def customer_paths(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "customer").select(F.sha2("c_name", 256).alias("sha256"), F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(".pdf")).alias("rel_path"))


def members(spark: SparkSession, base: str) -> DataFrame:
    c = _customers(spark, base)
    both = F.array((F.col("c_nationkey") + 100).cast("bigint"), (F.col("n_regionkey") + 10).cast("bigint"))
    return c.select(F.explode(both).alias("node_id"), "sha256").distinct()


def terms(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "customer").select((F.col("c_nationkey") + 100).cast("bigint").alias("node_id"), F.col("c_mktsegment").alias("term")).distinct()


def assignments(spark: SparkSession, base: str) -> DataFrame:
    k = F.col("c_custkey")
    confidence = F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low")
    status = F.when(k % 5 < 3, "pending").when(k % 5 == 3, "applied").otherwise("stay")
    child = F.when(k % 5 != 4, (F.col("c_nationkey") + 100).cast("bigint"))
    return _customers(spark, base).select((F.col("n_regionkey") + 10).cast("bigint").alias("node_id"), "sha256", child.alias("assigned_child_id"), confidence.alias("confidence"), status.alias("status"))


def events(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("bigint"))
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "moved").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    end = F.when(F.col("k") % 7 == 0, ".txt").otherwise(".PDF")
    src = F.when(F.col("k") % 5 == 0, F.concat(F.lit("/outside/f"), "k", F.lit(".pdf"))).otherwise(F.concat(F.lit("/data/Root/u"), "user_id", F.lit("/f"), "k", end))
    out = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("/outside/f"), "k", F.lit(".pdf"))).otherwise(F.concat(F.lit("/data/Root/u"), (F.col("user_id") + 1).cast("string"), F.lit("/f"), "k", F.lit(".pdf")))
    return e.select("event_id", kind.alias("kind"), (F.col("event_type") == "view").alias("is_directory"), src.alias("src_path"), F.when(F.col("event_type") == "purchase", out).alias("dest_path"))


def known_paths(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "events").select("user_id", F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"))
    return e.filter("user_id % 2 = 0 and k < 50").select(F.concat(F.lit("Root/u"), "user_id", F.lit("/f"), "k", F.lit(".PDF")).alias("rel_path")).distinct()


SQL = {
    "v_docs": "SELECT d.* FROM documents d JOIN (SELECT sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1) f ON f.sha256 = d.sha256 AND f.doc_id = d.doc_id",
    "v_paths": "SELECT DISTINCT regexp_extract(lower(sha256), '[0-9a-f]{64}') AS sha256, rel_path FROM document_paths",
    "v_toc": "SELECT sha256, position, level, title, page FROM document_toc",
    "v_jobs": "SELECT job_id, row_number() OVER (ORDER BY run_at, job_id) AS n FROM scan_jobs",
    "v_scans": "SELECT s.rel_path, regexp_extract(lower(s.sha256), '[0-9a-f]{64}') AS sha256, s.size_bytes, s.mtime, s.last_scanned_job, j.n FROM scanned_file_in_job s JOIN v_jobs j ON j.job_id = s.last_scanned_job",
    "v_state": f"SELECT rel_path, sha256, size_bytes, mtime, last_scanned_job FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY n DESC, sha256 DESC, size_bytes DESC NULLS LAST, coalesce(mtime, -1) DESC) AS r FROM v_scans WHERE n <= {PAST_JOBS}) WHERE r = 1",
    "v_prior": f"SELECT DISTINCT sha256, rel_path FROM v_scans WHERE n <= {PAST_JOBS}",
    "v_batch": f"SELECT rel_path, sha256, size_bytes, mtime FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY n DESC, sha256 DESC, size_bytes DESC NULLS LAST, coalesce(mtime, -1) DESC) AS r FROM v_scans WHERE n > {PAST_JOBS}) WHERE r = 1",
    "v_merge": """SELECT b.*, s.sha256 AS prior_sha256,
        (NOT EXISTS (SELECT 1 FROM v_prior p WHERE p.sha256 = b.sha256) AND b.rel_path = min(b.rel_path) OVER (PARTITION BY b.sha256)) AS added,
        EXISTS (SELECT 1 FROM v_prior p WHERE p.sha256 = b.sha256 AND p.rel_path = b.rel_path) AS owned,
        (s.rel_path IS NULL OR s.mtime IS DISTINCT FROM b.mtime) AS fresh
        FROM v_batch b LEFT JOIN v_state s ON s.rel_path = b.rel_path""",
    "v_nodes": """SELECT 1::BIGINT AS id, NULL::BIGINT AS parent_id, 'Root' AS name, 'Root' AS path, 0 AS depth
        UNION ALL SELECT (10 + r_regionkey)::BIGINT, 1, r_name, 'Root/' || r_name, 1 FROM region
        UNION ALL SELECT (100 + n_nationkey)::BIGINT, (10 + n_regionkey)::BIGINT, n_name, 'Root/' || r_name || '/' || n_name, 2 FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "v_customers": "SELECT c.*, n.n_regionkey, sha256(c.c_name) AS sha256 FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey",
    "v_cpaths": "SELECT sha256(c_name) AS sha256, c_mktsegment || '/' || c_name || '.pdf' AS rel_path FROM customer",
    "v_members": "SELECT DISTINCT unnest([(100 + c_nationkey)::BIGINT, (10 + n_regionkey)::BIGINT]) AS node_id, sha256 FROM v_customers",
    "v_terms": "SELECT DISTINCT (100 + c_nationkey)::BIGINT AS node_id, c_mktsegment AS term FROM customer",
    "v_assign": """SELECT (10 + n_regionkey)::BIGINT AS node_id, sha256, CASE WHEN c_custkey % 5 <> 4 THEN (100 + c_nationkey)::BIGINT END AS assigned_child_id,
        CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence,
        CASE WHEN c_custkey % 5 < 3 THEN 'pending' WHEN c_custkey % 5 = 3 THEN 'applied' ELSE 'stay' END AS status FROM v_customers""",
    "v_ev0": "SELECT *, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k FROM events",
    "v_events": """SELECT event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'moved' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, event_type = 'view' AS is_directory,
        CASE WHEN k % 5 = 0 THEN '/outside/f' || k || '.pdf' ELSE '/data/Root/u' || user_id || '/f' || k || CASE WHEN k % 7 = 0 THEN '.txt' ELSE '.PDF' END END AS src_path,
        CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN '/outside/f' || k || '.pdf' ELSE '/data/Root/u' || (user_id + 1) || '/f' || k || '.pdf' END END AS dest_path FROM v_ev0""",
    "v_known": "SELECT DISTINCT 'Root/u' || user_id || '/f' || k || '.PDF' AS rel_path FROM v_ev0 WHERE user_id % 2 = 0 AND k < 50",
    "v_norm": """SELECT * FROM (SELECT event_id, kind, CASE WHEN src_path LIKE '/data/%' AND lower(src_path) LIKE '%.pdf' THEN substr(src_path, 7) END AS src,
        CASE WHEN dest_path LIKE '/data/%' AND lower(dest_path) LIKE '%.pdf' THEN substr(dest_path, 7) END AS dest FROM v_events WHERE NOT is_directory) WHERE src IS NOT NULL OR dest IS NOT NULL""",
    "v_route": """SELECT event_id, operation, CASE WHEN src IS NULL THEN dest ELSE src END AS path, CASE WHEN operation = 'path_moved' THEN dest END AS dest FROM (
        SELECT *, CASE WHEN kind = 'moved' THEN CASE WHEN src IS NOT NULL AND dest IS NOT NULL THEN 'path_moved' WHEN src IS NOT NULL THEN 'path_missing' ELSE 'path_discovered' END
          WHEN src IS NULL THEN NULL WHEN kind = 'deleted' THEN 'path_missing' WHEN kind = 'created' THEN 'path_discovered'
          WHEN kind = 'modified' AND src NOT IN (SELECT rel_path FROM v_known) THEN 'path_discovered' END AS operation FROM v_norm) WHERE operation IS NOT NULL""",
    # In these events a path that something is moved to is never the source of an event, and has one source; so what an event does follows from the
    # first move of its path and the last event before it.
    "v_ops": """SELECT event_id, operation, CASE WHEN src IS NULL THEN dest ELSE src END AS path, CASE WHEN operation = 'path_moved' THEN dest END AS dest FROM (
        SELECT *, CASE WHEN kind = 'moved' THEN CASE WHEN src IS NOT NULL AND dest IS NOT NULL THEN 'path_moved' WHEN src IS NOT NULL THEN 'path_missing' ELSE 'path_discovered' END
          WHEN src IS NULL THEN NULL WHEN kind = 'deleted' THEN 'path_missing' WHEN kind = 'created' THEN 'path_discovered' WHEN kind = 'modified' THEN 'path_changed' END AS operation FROM v_norm) WHERE operation IS NOT NULL""",
    "v_play": """SELECT *, CASE WHEN event_id <= coalesce(m1, event_id) OR NOT coalesce(alive_m1, true) THEN coalesce(by_rest, known) ELSE coalesce(by_all, known) END AS alive FROM (
        SELECT *, max(CASE WHEN event_id = m1 THEN coalesce(by_rest, known) END) OVER (PARTITION BY path) AS alive_m1 FROM (
          SELECT *, path IN (SELECT rel_path FROM v_known) AS known, min(CASE WHEN operation = 'path_moved' THEN event_id END) OVER (PARTITION BY path) AS m1,
            last_value(CASE operation WHEN 'path_discovered' THEN true WHEN 'path_changed' THEN true WHEN 'path_missing' THEN false END IGNORE NULLS) OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_rest,
            lag(operation IN ('path_discovered', 'path_changed')) OVER (PARTITION BY path ORDER BY event_id) AS by_all FROM v_ops))""",
    "v_fx": """SELECT event_id, 'discovered' AS effect, path, NULL AS dest, sha256(path) AS sha256 FROM v_play WHERE operation = 'path_discovered' OR operation = 'path_changed' AND NOT alive
        UNION ALL SELECT event_id, 'deleted', path, NULL, sha256(path) FROM v_play WHERE operation = 'path_missing' AND alive
        UNION ALL SELECT event_id, CASE WHEN event_id = m1 THEN 'renamed' ELSE 'dropped' END, path, dest, sha256(path) FROM v_play WHERE operation = 'path_moved' AND alive AND alive_m1
        UNION ALL SELECT event_id, 'discovered', dest, NULL, sha256(dest) FROM v_play WHERE operation = 'path_moved' AND NOT (alive AND alive_m1)""",
    "v_now": """SELECT path AS rel_path, sha256 FROM (SELECT coalesce(dest, path) AS path, sha256, row_number() OVER (PARTITION BY coalesce(dest, path) ORDER BY event_id) AS r FROM v_fx WHERE dest IS NOT NULL OR path LIKE '%.pdf' AND effect = 'discovered') WHERE r = 1
        UNION ALL SELECT rel_path, sha256(rel_path) FROM (SELECT k.rel_path FROM v_known k WHERE NOT EXISTS (SELECT 1 FROM v_fx f WHERE f.path = k.rel_path) UNION ALL SELECT path FROM (SELECT path, effect, row_number() OVER (PARTITION BY path ORDER BY event_id DESC) AS r FROM v_fx WHERE path NOT LIKE '%.pdf') WHERE r = 1 AND effect = 'discovered')""",
}
_NEEDS = {"v_scans": ["v_jobs"], "v_state": ["v_scans"], "v_prior": ["v_scans"], "v_batch": ["v_scans"], "v_merge": ["v_batch", "v_state", "v_prior"], "v_members": ["v_customers"], "v_assign": ["v_customers"], "v_events": ["v_ev0"], "v_known": ["v_ev0"], "v_norm": ["v_events"], "v_route": ["v_norm", "v_known"], "v_ops": ["v_norm"], "v_play": ["v_ops", "v_known"], "v_fx": ["v_play"], "v_now": ["v_fx", "v_known"]}


def with_views(query: str) -> str:
    """``query`` with the views it names, and those they need, as common table expressions in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", query):
            need(name)
    if not order:
        return query
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    own = re.match(r"\s*WITH( RECURSIVE)?\b", query)
    return f"WITH{own[1] or ''} {views}, {query[own.end() :]}" if own else f"WITH {views} {query}"
