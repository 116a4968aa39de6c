"""Whole runs composed of the operators: a scan, a batch of suggestions, a partition and an assignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfmark.functions import text as X
from shelfmark.operators import partitioning as B
from shelfmark.operators import registry as R
from shelfmark.operators import suggestions as S
from shelfmark.operators import taxonomy as T
from shelfmark.session import cut_lineage
from shelfmark.sources import files as sources
from shelfmark.sources.store import Store

Responder = Callable[[str], dict]


def scan(documents: DataFrame, paths: DataFrame, state: DataFrame, jobs: DataFrame, batch: DataFrame, job_id: str, run_at: str, root: str, records: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next documents, paths, state and jobs after a batch (rel_path, sha256, size_bytes, mtime) is merged.

    ``job_id`` and ``run_at`` are given, so that a run that is repeated gives the same tables.  ``records``: see ``registry.merge_documents``.
    """
    rows = cut_lineage(R.merge_rows(paths, state, batch))
    stats = R.merge_stats(rows, state, batch)
    job = stats.select(F.lit(job_id).alias("job_id"), F.lit(run_at).cast("timestamp_ntz").alias("run_at"), F.lit(root).alias("root_path"), *[F.col(c).cast("int").alias(c) for c in ("added", "updated", "removed", "duplicates", "skipped")])
    return {
        "documents": R.merge_documents(documents, rows, job_id, records),
        "paths": R.merge_paths(paths, rows),
        "state": R.merge_state(state, rows, job_id),
        "jobs": jobs.unionByName(job),
    }


def inventory(tables: dict[str, DataFrame], files: DataFrame, extractor: Callable[[str, bytes], dict], job_id: str, run_at: str, root: str, normalise: bool = True, on_progress: Callable[[DataFrame], None] | None = None, **extraction) -> tuple[dict[str, DataFrame], DataFrame]:
    """(next tables, errors): listing -> extraction -> merge.

    ``files``: (path, modified, content) of the PDFs below ``root``; ``tables``: documents, paths, state, jobs.  Files that fail are rows of
    ``errors`` (rel_path, error) and stop no other.  ``on_progress`` gets (rel_path, error) of all attempted files.
    """
    records = cut_lineage(sources.extract(files, extractor, root, **extraction))
    attempts = records.select("rel_path", "error")
    if on_progress is not None:
        on_progress(attempts)
    good = records.filter("error is null")
    named = good.withColumn("normalised_name", X.normalise_file_name(X.basename(F.col("rel_path"))) if normalise else F.lit(None).cast("string"))
    schema = tables["documents"].schema
    keyed = R.document_rows(named, schema if "rel_path" in schema.names else StructType([*schema.fields, StructField("rel_path", StringType())]))
    toc = R.flatten_toc(good.filter("toc is not null").drop_duplicates(["sha256"]))
    after = scan(tables["documents"], tables["paths"], tables["state"], tables["jobs"], good.select("rel_path", "sha256", "size_bytes", "mtime"), job_id, run_at, root, keyed)
    if "toc" in tables:
        new = toc.join(tables["documents"].select("sha256"), "sha256", "left_anti")
        after["toc"] = tables["toc"].unionByName(new.select(F.xxhash64("sha256", "position").alias("id"), "sha256", "level", "title", "page", "position").select(*tables["toc"].columns))
    return after, attempts.filter("error is not null")


def import_registry(store: Store, registry: dict[str, DataFrame], replace: bool = False) -> dict:
    """Counts of a registry brought into a store; an error if the store has documents, unless they are to be replaced.

    Prompts stay as they are; suggestions stay for documents that are still known.
    """
    number, now = store.current()
    if not replace and (number or store.read("documents").limit(1).count()):
        raise FileExistsError(f"{store.base} holds a registry; ask for it to be replaced")
    tables = R.import_tables(registry, store.read("llm_document_suggestions"))
    store.commit(tables)
    counts = R.import_summary(store.read("documents"), store.read("document_paths"), store.read("document_toc"), store.read("scanned_file_in_job"), store.read("scan_jobs"))
    return counts.first().asDict()


def migrate(store: Store, path: str, replace: bool = False) -> dict:
    """Counts of a registry in a JSON file brought into a store, with the file's place."""
    return {"source": path, **import_registry(store, sources.read_registry(store.spark, path), replace)}


def detect_languages(df: DataFrame, key: str, text: str, detector: Callable[[str], Sequence[str]]) -> DataFrame:
    """(key, languages) by a given detector; blank texts and errors give none."""

    def detect(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(list(detector(t.strip())) if t and t.strip() else [])
            except Exception:  # a text that can't be judged has no language
                out.append([])
        return pd.Series(out)

    return df.select(key, F.pandas_udf(detect, "array<string>")(F.col(text)).alias("languages"))


def system_prompt(role: str, scope: str, goals: Sequence[str], rules: Sequence[str], evidence: Sequence[str] = ()) -> str:
    """Instructions in sections: who answers, what is given, goals, evidence in order of weight, rules."""
    parts = [role, f"Given: {scope}. Nothing else is known of the documents."]
    for title, items in (("Goals", goals), ("Evidence, weightiest first", evidence), ("Rules", rules)):
        if items:
            parts.append(f"{title}:\n" + "\n".join(f"- {i}" for i in items))
    return "\n\n".join(parts)


def suggest(documents: DataFrame, paths: DataFrame, toc: DataFrame, suggestions: DataFrame, prompt_id: int, responder: Responder, needs_toc: bool = False, limit: int | None = None, most_toc: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(status per document, responses): the gate first, then one request for each document that is left.

    Responses are written to the shared folder before they are used, so that nothing is requested twice.
    """
    status = S.batch_status(documents, toc, suggestions, prompt_id, needs_toc, limit)
    inputs = S.prompt_inputs(documents.join(status.filter("status = 'pending'").select("sha256"), "sha256", "left_semi"), paths, toc, most_toc)
    answers = cut_lineage(S.respond(S.payload(inputs), responder))
    outcome = answers.select("sha256", F.when(F.col("error").isNull(), "persisted").otherwise("failed").alias("_outcome"))
    done = status.join(outcome, "sha256", "left").select("sha256", F.coalesce("_outcome", "status").alias("status"))
    return done, answers


def suggest_and_store(store: Store, table: str, status: DataFrame, answers: DataFrame, prompt_id: int, answer: str, at: str, trace: str | None = None) -> tuple[int, DataFrame]:
    """(number of the commit, rejected answers): the good answers of ``suggest`` put into a table of suggestions, and a trace line for each document.

    ``answer``: schema of the response, whose fields are columns of the table.
    """
    if trace is not None:
        sources.append_trace(S.trace_lines(status.withColumn("prompt_id", F.lit(prompt_id))), trace)
    good = answers.filter("error is null").withColumn("a", F.from_json("response", answer)).select("sha256", F.lit(prompt_id).cast("bigint").alias("prompt_id"), "a.*", F.lit(at).cast("timestamp_ntz").alias("updated_at"))
    after, rejected = S.upsert_suggestions(store.read(table), good, store.read("documents"))
    fresh = after.withColumn("id", F.coalesce("id", F.xxhash64("sha256", "prompt_id"))) if "id" in after.columns else after
    return store.commit({table: fresh}), rejected


def status_counts(status: DataFrame) -> DataFrame:
    """One row: total, requested, persisted, skipped_existing, skipped_ineligible, failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return status.agg(F.count("*").alias("total"), n("persisted", "failed").alias("requested"), n("persisted").alias("persisted"), n("skipped_existing").alias("skipped_existing"), n("skipped_ineligible").alias("skipped_ineligible"), n("failed").alias("failed"))


PROPOSAL = "categories array<string>, groups array<struct<name string, topics array<string>>>"


def in_scope(answers: DataFrame, node_path: str) -> DataFrame:
    """Answers (response) without names of the node's ancestors, on any level; answers of another form stay as they are."""
    names = [p.strip() for p in node_path.split("/")[1:] if p.strip()]
    read = answers.withColumn("_p", F.from_json("response", PROPOSAL)).select("*", F.coalesce("_p.categories", F.array().cast("array<string>")).alias("categories"), F.coalesce("_p.groups", F.array().cast("array<struct<name string, topics array<string>>>")).alias("groups"))
    kept = B.filter_scope(read, "categories", "groups", names)
    has = F.col("_p.categories").isNotNull() | F.col("_p.groups").isNotNull()
    return kept.withColumn("response", F.when(has, F.to_json(F.struct("categories", "groups"))).otherwise(F.col("response"))).select(*answers.columns)


def partition(summaries: DataFrame, seed: str, chunk: int, node_path: str, responder: Responder, merger: Responder | None = None, offset: int = 0, count: int | None = None) -> DataFrame:
    """(sha256, response, error): a node's documents in batches, a proposal for each, and one answer that merges them; nothing for no documents."""
    n = summaries.select("sha256").distinct().count()
    if not n:
        return summaries.sparkSession.createDataFrame([], "sha256 string, response string, error string")
    return generalise(propose(summaries, seed, chunk, offset, -(-n // chunk) - offset if count is None else count, node_path, responder), node_path, merger or responder)


def propose(summaries: DataFrame, seed: str, chunk: int, offset: int, count: int, node_path: str, responder: Responder) -> DataFrame:
    """(sha256, response, error) with the batch as key: one proposal for each of ``count`` batches of document summaries, without names of ancestors.

    ``summaries``: (sha256, summary).  A batch has at most ``chunk`` documents, so what is gathered for a request is bounded.
    """
    batched = cut_lineage(B.batches(summaries, "sha256", seed, chunk))
    B.check_range(batched, offset, count)
    rows = batched.filter(F.col("batch_index").between(offset, offset + count - 1)).join(summaries, "sha256")
    documents = F.transform(F.sort_array(F.collect_list(F.struct("rank", "summary"))), lambda d: d["summary"])
    packed = rows.groupBy("batch_index").agg(documents.alias("documents"))
    requests = packed.select(F.concat(F.lit("batch-"), "batch_index").alias("sha256"), F.to_json(F.struct(F.lit(node_path).alias("node_path"), "documents")).alias("payload"))
    return in_scope(cut_lineage(S.respond(requests, responder)), node_path)


def generalise(proposals: DataFrame, node_path: str, responder: Responder) -> DataFrame:
    """One request that merges the proposals; there are as many as batches were asked for, which the caller bounds."""
    good = proposals.filter("error is null")
    request = good.agg(F.sort_array(F.collect_list(F.struct("sha256", "response"))).alias("p")).select(F.lit("merged").alias("sha256"), F.to_json(F.struct(F.lit(node_path).alias("node_path"), F.transform("p", lambda x: x["response"]).alias("proposals"))).alias("payload"))
    return in_scope(cut_lineage(S.respond(request, responder)), node_path)


ANSWER = "decision string, child string, confidence string, reasoning string"


def assign(nodes: DataFrame, members: DataFrame, terms: DataFrame, assignments: DataFrame, paths: DataFrame, node_path: str, responder: Responder, keywords: Sequence[str] = (), offset: int = 0, limit: int | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next assignments, problems): asks for each document of a node which child it belongs to.

    Documents are taken in order of their digest, filtered by keyword and cut before the gate.  An answer that breaks a rule is a
    problem and changes nothing; ``stay`` has that status, a child is pending until it is reviewed.
    """
    node = T.lookup(nodes, node_path).select(F.col("id").alias("node_id"))
    docs = members.join(node, "node_id").select("node_id", "sha256").join(paths.filter(X.contains_any(F.col("rel_path"), list(keywords))).select("sha256"), "sha256", "left_anti").orderBy("sha256")
    docs = docs.offset(offset)
    docs = docs if limit is None else docs.limit(limit)
    if not force:
        docs = docs.join(assignments.select("node_id", "sha256"), ["node_id", "sha256"], "left_anti")
    options = T.child_options(nodes, terms).groupBy(F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("name", "terms", "id"))).alias("options"))
    asked = cut_lineage(docs.join(T.first_paths(paths), "sha256", "left").join(options, "node_id", "left"))
    payload = F.to_json(F.struct(F.col("path").alias("current_path"), F.transform("options", lambda o: F.struct(o["name"].alias("name"), o["terms"].alias("terms"))).alias("children")))
    answers = cut_lineage(S.respond(asked.select("sha256", payload.alias("payload")), responder))
    read = asked.join(answers, "sha256").withColumn("a", F.from_json("response", ANSWER))
    names = F.transform("options", lambda o: o["name"])
    wrong = S.assignment_violation(F.col("a.decision"), F.col("a.child"), names, F.col("a.confidence"), F.col("a.reasoning"))
    judged = read.withColumn("problem", F.coalesce(F.col("error"), wrong))
    child = F.when(F.col("a.decision") == "child", F.get(F.filter("options", lambda o: o["name"] == F.col("a.child")), F.lit(0))["id"])
    good = judged.filter("problem is null").select("node_id", "sha256", child.alias("assigned_child_id"), F.col("a.confidence").alias("confidence"), F.when(child.isNull(), "stay").otherwise("pending").alias("status"))
    return T.upsert_assignments(assignments.select("node_id", "sha256", "assigned_child_id", "confidence", "status"), good), judged.filter("problem is not null").select("sha256", "problem")
