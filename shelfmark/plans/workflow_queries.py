"""Queries of prompts, suggestions and file-change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import effects
from shelfmark.operators import registry as R
from shelfmark.operators import suggestions as S
from shelfmark.operators import taxonomy as T
from shelfmark.plans import views as V
from shelfmark.plans.catalog import Catalog
from shelfmark.schemas import empty_table
from shelfmark.session import cut_lineage, read_table
from shelfmark.streaming import watch as W

catalog = Catalog()
query = catalog.query
PROMPT, MOST_TOC = 4, 3


def _suggestions(spark, base):
    """One suggestion per (sha256, prompt_id): that of the greatest id."""
    s = read_table(spark, base, "llm_document_suggestions")
    last = s.groupBy("sha256", "prompt_id").agg(F.max("id").alias("id"))
    return s.join(last, ["sha256", "prompt_id", "id"])


_SUGGESTIONS = "(SELECT s.* FROM llm_document_suggestions s JOIN (SELECT sha256, prompt_id, max(id) AS id FROM llm_document_suggestions GROUP BY ALL) l USING (id))"


@query("active_prompt", "SELECT workflow_name, id, prompt_version FROM (SELECT *, row_number() OVER (PARTITION BY workflow_name ORDER BY updated_at DESC, id DESC) AS r FROM prompts WHERE active) WHERE r = 1")
def active_prompt(spark, base):
    return S.active_prompts(read_table(spark, base, "prompts")).select("workflow_name", "id", "prompt_version")


# Every prompt anew: active ones in a next version, the others with another text.
_NEW_PROMPTS = "SELECT workflow_name, model_provider, model, CASE WHEN active THEN prompt_version || '-next' ELSE prompt_version END AS prompt_version, 'new text ' || id AS prompt_text, NOT active AS active, updated_at FROM prompts"


def _new_prompts(spark, base):
    p = read_table(spark, base, "prompts")
    version = F.when(F.col("active"), F.concat("prompt_version", F.lit("-next"))).otherwise(F.col("prompt_version"))
    return p.select("workflow_name", "model_provider", "model", version.alias("prompt_version"), F.concat(F.lit("new text "), "id").alias("prompt_text"), (~F.col("active")).alias("active"), "updated_at")


@query("prompt_upsert", f"""WITH n AS ({_NEW_PROMPTS}) SELECT p.id, p.prompt_version, coalesce(n.prompt_text, p.prompt_text) AS prompt_text, coalesce(n.active, p.active) AS active FROM prompts p LEFT JOIN n ON n.workflow_name = p.workflow_name AND n.model_provider = p.model_provider AND n.model = p.model AND n.prompt_version = p.prompt_version
    UNION ALL SELECT (SELECT max(id) FROM prompts) + row_number() OVER (ORDER BY workflow_name, model_provider, model, prompt_version), prompt_version, prompt_text, active FROM n WHERE prompt_version LIKE '%-next'""")
def prompt_upsert(spark, base):
    return S.upsert_prompts(read_table(spark, base, "prompts"), _new_prompts(spark, base)).select("id", "prompt_version", "prompt_text", "active")


@query("prompt_inputs", """SELECT d.sha256, p.current_path, coalesce(p.paths, '') AS paths, d.file_name, d.metadata_title AS title, d.metadata_author AS author, coalesce(t.toc, '') AS toc FROM v_docs d
    LEFT JOIN (SELECT sha256, min(rel_path) AS current_path, string_agg(rel_path, '|' ORDER BY rel_path) AS paths FROM v_paths GROUP BY 1) p ON p.sha256 = d.sha256
    LEFT JOIN (SELECT sha256, string_agg(title, '|' ORDER BY position, title) AS toc FROM v_toc GROUP BY 1) t ON t.sha256 = d.sha256""")
def prompt_inputs(spark, base):
    docs = V.documents(spark, base, "file_name", "metadata_title", "metadata_author")
    rows = S.prompt_inputs(docs, V.paths(spark, base), V.toc(spark, base))
    return rows.withColumn("paths", F.coalesce(F.array_join("paths", "|"), F.lit(""))).withColumn("toc", F.array_join("toc", "|"))


@query("toc_prompt_inputs", f"SELECT d.sha256, d.file_name, array_to_string(t.titles[1:{MOST_TOC}], '|') AS toc FROM v_docs d JOIN (SELECT sha256, list(title ORDER BY position, title) AS titles FROM v_toc GROUP BY 1) t ON t.sha256 = d.sha256")
def toc_prompt_inputs(spark, base):
    toc = V.toc(spark, base)
    docs = R.candidates(V.documents(spark, base, "file_name", "metadata_title", "metadata_author"), toc, require_toc=True)
    return S.prompt_inputs(docs, V.paths(spark, base), toc, MOST_TOC).select("sha256", "file_name", F.array_join("toc", "|").alias("toc"))


@query("prompt_payloads")
def prompt_payloads(spark, base):
    docs = V.documents(spark, base, "file_name", "metadata_title", "metadata_author")
    return S.payload(S.prompt_inputs(docs, V.paths(spark, base), V.toc(spark, base), MOST_TOC))


@query("suggestion_gate", f"SELECT sha256 FROM v_docs WHERE sha256 NOT IN (SELECT sha256 FROM llm_document_suggestions WHERE prompt_id = {PROMPT} AND sha256 IS NOT NULL)")
def suggestion_gate(spark, base):
    return S.gate(V.documents(spark, base), read_table(spark, base, "llm_document_suggestions"), PROMPT).select("sha256")


@query("suggestion_restore", "SELECT id, sha256, prompt_id FROM llm_document_suggestions WHERE sha256 IN (SELECT sha256 FROM v_docs WHERE is_digital)")
def suggestion_restore(spark, base):
    known = V.documents(spark, base, "is_digital").filter("is_digital")
    return R.carry_over(read_table(spark, base, "llm_document_suggestions"), known).select("id", "sha256", "prompt_id")



def _responses(spark, base):
    s = _suggestions(spark, base)
    known = s.filter("status = 'pending'").select("sha256", (F.col("prompt_id") + F.col("id") % 2).alias("prompt_id"), F.concat(F.lit("Revised "), F.coalesce("suggested_author", F.lit("?"))).alias("suggested_author"), "updated_at", "id")
    known = known.groupBy("sha256", "prompt_id").agg(F.max(F.struct("id", "suggested_author", "updated_at")).alias("r")).select("sha256", "prompt_id", "r.suggested_author", "r.updated_at")
    lost = read_table(spark, base, "llm_document_suggestions").filter("status = 'rejected'").select(F.concat(F.lit("unknown-"), "id").alias("sha256"), "prompt_id", F.lit("Nobody").alias("suggested_author"), "updated_at")
    return known.unionByName(lost)


@query("suggestion_upsert", f"""WITH s AS {_SUGGESTIONS}, r AS (SELECT sha256, prompt_id, suggested_author FROM (SELECT *, row_number() OVER (PARTITION BY sha256, prompt_id ORDER BY id DESC) AS k FROM (SELECT id, sha256, prompt_id + id % 2 AS prompt_id, 'Revised ' || coalesce(suggested_author, '?') AS suggested_author FROM s WHERE status = 'pending')) WHERE k = 1 AND sha256 IN (SELECT sha256 FROM v_docs))
    SELECT s.sha256, s.prompt_id, coalesce(r.suggested_author, s.suggested_author) AS suggested_author, CASE WHEN r.sha256 IS NOT NULL THEN 'pending' ELSE s.status END AS status, s.applied FROM s LEFT JOIN r ON r.sha256 = s.sha256 AND r.prompt_id = s.prompt_id
    UNION ALL SELECT r.sha256, r.prompt_id, r.suggested_author, 'pending', false FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.sha256 = r.sha256 AND s.prompt_id = r.prompt_id)""")
def suggestion_upsert(spark, base):
    new, _ = S.upsert_suggestions(_suggestions(spark, base), _responses(spark, base), V.documents(spark, base))
    return new.select("sha256", "prompt_id", "suggested_author", "status", "applied")


_STATUS = f"SELECT sha256, CASE WHEN sha256 NOT IN (SELECT sha256 FROM v_toc) THEN 'skipped_ineligible' WHEN sha256 IN (SELECT sha256 FROM llm_document_suggestions WHERE prompt_id = {PROMPT}) THEN 'skipped_existing' ELSE 'pending' END AS status FROM v_docs"


@query("batch_status", _STATUS)
def batch_status(spark, base):
    return S.batch_status(V.documents(spark, base), V.toc(spark, base), read_table(spark, base, "llm_document_suggestions"), PROMPT, True)


@query("batch_status_counts", f"SELECT status, count(*) AS documents FROM ({_STATUS}) GROUP BY 1")
def batch_status_counts(spark, base):
    return batch_status(spark, base).groupBy("status").agg(F.count("*").alias("documents"))


@query("response_violations", """SELECT id, CASE WHEN NOT coalesce(decision IN ('child', 'stay'), false) THEN 'unknown decision' WHEN NOT coalesce(confidence IN ('high', 'medium', 'low'), false) THEN 'unknown confidence' WHEN coalesce(trim(reasoning), '') = '' THEN 'reasoning missing'
    WHEN decision = 'stay' AND child IS NOT NULL THEN 'stay with child' WHEN decision = 'child' AND NOT coalesce(child IN ('beacon', 'lattice', 'harvest', 'membrane'), false) THEN 'unknown child' END AS assignment,
    CASE WHEN NOT valid AND coalesce(trim(reasoning), '') = '' THEN 'reason missing' WHEN page IS NULL AND child IS NOT NULL THEN 'label without page' WHEN score IS NOT NULL AND NOT score BETWEEN 0 AND 1 THEN 'confidence out of range' END AS toc_review
    FROM (SELECT id, CASE id % 7 WHEN 0 THEN 'stay' WHEN 1 THEN 'move' ELSE 'child' END AS decision, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'sure' WHEN 2 THEN 'low' ELSE 'high' END AS confidence, reasoning_summary AS reasoning,
      nullif(regexp_extract(suggested_labels_json, '"([^"]+)"', 1), '') AS child, id % 3 = 0 AS valid, CASE WHEN id % 4 = 0 THEN id END AS page, CASE WHEN id % 6 = 0 THEN NULL ELSE (id % 13) / 10.0 END AS score FROM llm_document_suggestions)""")
def response_violations(spark, base):
    k = F.col("id")
    r = read_table(spark, base, "llm_document_suggestions").select(
        "id", F.when(k % 7 == 0, "stay").when(k % 7 == 1, "move").otherwise("child").alias("decision"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "sure").when(k % 5 == 2, "low").otherwise("high").alias("confidence"),
        F.col("reasoning_summary").alias("reasoning"), F.get(F.from_json("suggested_labels_json", "array<string>"), F.lit(0)).alias("child"), (k % 3 == 0).alias("valid"), F.when(k % 4 == 0, k).alias("page"), F.when(k % 6 != 0, (k % 13) / 10.0).alias("score"),
    )
    options = F.array(*[F.lit(x) for x in ("beacon", "lattice", "harvest", "membrane")])
    a = S.assignment_violation(F.col("decision"), F.col("child"), options, F.col("confidence"), F.col("reasoning"))
    t = S.toc_review_violation(F.col("valid"), F.col("reasoning"), F.col("page"), F.col("child"), F.col("score"))
    return r.select("id", a.alias("assignment"), t.alias("toc_review"))


@query("retry_schedule", "SELECT * FROM (VALUES (2::BIGINT, 2.0::DOUBLE), (3::BIGINT, 4.0::DOUBLE)) t(attempt, wait_s)")
def retry_schedule(spark, base):
    return spark.createDataFrame([(i + 2, w) for i, w in enumerate(S.retry_waits())], "attempt bigint, wait_s double")


# -- events ----------------------------------------------------------------------------------------------------------


@query("watch_normalise", "SELECT event_id, kind, src, dest FROM v_norm")
def watch_normalise(spark, base):
    return W.normalise(V.events(spark, base), V.ROOT)


@query("watch_route", "SELECT event_id, operation, path, dest FROM v_route")
def watch_route(spark, base):
    return W.route(watch_normalise(spark, base), V.known_paths(spark, base))


def _registry(spark, base):
    """The known paths as a registry: each of a document of its own, in the root and its folder's node, with a pending assignment."""
    paths = V.known_paths(spark, base).select(F.sha2("rel_path", 256).alias("sha256"), "rel_path")
    nodes = cut_lineage(T.ensure_nodes(empty_table(spark, "taxonomy_nodes"), paths.select(X.parent_path(F.col("rel_path")).alias("p")), "p"))
    at = paths.select("sha256", F.explode(F.array(F.lit("Root"), X.parent_path(F.col("rel_path")))).alias("path")).join(nodes.select("path", F.col("id").alias("node_id")), "path").select("node_id", "sha256")
    own = paths.select(F.lit(1).cast("bigint").alias("node_id"), "sha256", F.lit(None).cast("bigint").alias("assigned_child_id"), F.lit("high").alias("confidence"), F.lit("pending").alias("status"))
    state = paths.select("rel_path", "sha256", F.lit(1).cast("bigint").alias("size_bytes"), F.lit(0.0).alias("mtime"), F.lit("j").alias("last_scanned_job"))
    return {"documents": paths.select("sha256", X.basename(F.col("rel_path")).alias("file_name")), "paths": paths, "state": state, "nodes": nodes, "members": at, "assignments": own}


def _after(spark, base):
    operations = cut_lineage(W.route(watch_normalise(spark, base)))
    content = operations.select(F.explode(F.array_compact(F.array("path", "dest"))).alias("rel_path")).distinct().withColumn("sha256", F.sha2("rel_path", 256))
    return effects.apply(_registry(spark, base), operations, content)


@query("watch_apply", "SELECT rel_path, sha256 FROM v_now")
def watch_apply(spark, base):
    return _after(spark, base)["paths"].select("rel_path", "sha256")


@query("watch_documents", """SELECT sha256, regexp_extract(max_by(place, event_id), '[^/]*$') AS file_name FROM (SELECT sha256, event_id, coalesce(dest, path) AS place FROM v_fx WHERE effect IN ('discovered', 'renamed') UNION ALL SELECT sha256(rel_path), -1, rel_path FROM v_known) GROUP BY 1""")
def watch_documents(spark, base):
    return _after(spark, base)["documents"].select("sha256", "file_name")


@query("watch_state", """SELECT coalesce(f.dest, k.rel_path) AS rel_path, sha256(k.rel_path) AS sha256 FROM v_known k LEFT JOIN (SELECT path, effect, dest, row_number() OVER (PARTITION BY path ORDER BY event_id) AS r FROM v_fx WHERE effect IN ('renamed', 'deleted')) f ON f.path = k.rel_path AND f.r = 1
    WHERE coalesce(f.effect, '') <> 'deleted'""")
def watch_state(spark, base):
    return _after(spark, base)["state"].select("rel_path", "sha256")


@query("watch_memberships", """WITH moves AS (SELECT event_id, sha256, 'Root' AS node, 1 AS there FROM v_fx WHERE effect = 'discovered' UNION ALL SELECT event_id, sha256, regexp_replace(path, '/[^/]*$', ''), CASE WHEN effect = 'discovered' THEN 1 ELSE 0 END FROM v_fx
      UNION ALL SELECT event_id, sha256, regexp_replace(dest, '/[^/]*$', ''), 1 FROM v_fx WHERE dest IS NOT NULL UNION ALL SELECT -1, sha256(rel_path), unnest(['Root', regexp_replace(rel_path, '/[^/]*$', '')]), 1 FROM v_known),
    last AS (SELECT node, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY node, sha256 ORDER BY event_id DESC, there DESC) AS r FROM moves) WHERE r = 1 AND there = 1)
    SELECT node AS node_path, sha256 FROM last WHERE NOT (node = 'Root' AND sha256 IN (SELECT sha256 FROM v_fx WHERE effect = 'deleted') AND sha256 NOT IN (SELECT sha256 FROM v_now))""")
def watch_memberships(spark, base):
    after = _after(spark, base)
    return after["members"].join(after["nodes"].select(F.col("id").alias("node_id"), F.col("path").alias("node_path")), "node_id").select("node_path", "sha256")


@query("watch_assignments", "SELECT sha256(rel_path) AS sha256, CASE WHEN sha256(rel_path) IN (SELECT sha256 FROM v_fx WHERE effect IN ('renamed', 'dropped')) THEN 'manual_touched' ELSE 'pending' END AS status FROM v_known")
def watch_assignments(spark, base):
    return _after(spark, base)["assignments"].select("sha256", "status")


_MSG = "CASE id % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'skipping file due to error' ELSE 'other' END"


@query("log_progress", f"SELECT rel_path AS path FROM document_paths WHERE {_MSG} <> 'other' AND id % 9 <> 0")
def log_progress(spark, base):
    k = F.col("id")
    msg = F.when(k % 4 == 0, "processed").when(k % 4 == 1, "skipping file due to error").otherwise("other")
    line = F.when(k % 9 == 0, F.lit("no json at all")).otherwise(F.to_json(F.struct(msg.alias("msg"), F.col("rel_path").alias("path"))))
    return W.log_progress(read_table(spark, base, "document_paths").select(line.alias("value")))


@query("log_progress_running", f"SELECT id, path, row_number() OVER (ORDER BY id) AS attempts FROM (SELECT id, rel_path AS path FROM document_paths WHERE {_MSG} <> 'other' AND id % 9 <> 0)")
def log_progress_running(spark, base):
    k = F.col("id")
    msg = F.when(k % 4 == 0, "processed").when(k % 4 == 1, "skipping file due to error").otherwise("other")
    line = F.when(k % 9 == 0, F.lit("no json at all")).otherwise(F.to_json(F.struct(msg.alias("msg"), F.col("rel_path").alias("path"))))
    return W.running_progress(read_table(spark, base, "document_paths").select("id", line.alias("value")), "id")
