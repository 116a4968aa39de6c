"""Command line over a registry kept as versioned tables: ``python -m shelfmark.cli COMMAND --base FOLDER ...``.

Read commands print JSON lines.  Commands that change tables make their next versions current in one commit (``sources.store``) and
print its number; nothing is overwritten.  Extractors and models are given as ``module:function``.  ``probe-`` commands ask for what the ``run-``
commands of the same name ask for, print the answers and change nothing.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import uuid
from datetime import datetime, timezone
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import Config, merge_keywords
from shelfmark.operators import partitioning as B
from shelfmark.operators import paths as P
from shelfmark.operators import effects, runs
from shelfmark.operators import registry as R
from shelfmark.operators import suggestions as S
from shelfmark.operators import taxonomy as T
from shelfmark.session import cut_lineage
from shelfmark.sources import files
from shelfmark.sources.store import Store
from shelfmark.streaming import watch as W

#: Rows that a read command prints unless ``--limit`` says otherwise.
SHOWN = 100


class Tables:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base, self.store = spark, base, Store(spark, base)

    def __getattr__(self, name: str) -> DataFrame:
        return self.store.read(name)

    def parts(self) -> dict[str, DataFrame]:
        return {part: self.store.read(name) for part, name in W.PARTS.items()}

    def keep(self, **tables: DataFrame) -> list[dict]:
        number = self.store.commit(tables)
        return [{"table": name, "commit": number} for name in tables]


def _given(name: str | None) -> Callable:
    """The function called ``module:function``."""
    if not name or ":" not in name:
        raise SystemExit("give module:function")
    module, function = name.split(":", 1)
    return getattr(importlib.import_module(module), function)


def _model(a: argparse.Namespace) -> Callable:
    """The model's function; refused unless requests are switched on in the settings."""
    if not a.offline_model:
        Config.from_env().require_online()
    return _given(a.responder)


def _now(a: argparse.Namespace) -> str:
    return a.at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _node_id(t: Tables, path: str) -> int:
    row = T.lookup(t.taxonomy_nodes, path).first()
    if row is None:
        raise SystemExit(f"no node {path}")
    return row["id"]


def _readable(t: Tables, root: str) -> Callable[[DataFrame], DataFrame]:
    """(rel_path, sha256, md5) of the readable ones among paths below a root."""

    def read(asked: DataFrame) -> DataFrame:
        names = [f"{root.rstrip('/')}/{r['rel_path']}" for r in asked.collect()]  # the paths of one batch of events
        fs = t.spark._jvm.org.apache.hadoop.fs
        there = [n for n in names if (p := fs.Path(n)).getFileSystem(t.spark._jsc.hadoopConfiguration()).exists(p)]
        if not there:
            return t.spark.createDataFrame([], "rel_path string, sha256 string, md5 string")
        found = t.spark.read.format("binaryFile").load(there)
        rel = F.substr(F.regexp_replace("path", "^file:(?=/)", ""), F.lit(len(root.rstrip("/")) + 2))
        return found.select(rel.alias("rel_path"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))

    return read


def _page(df: DataFrame, a: argparse.Namespace, *order: str) -> list[dict]:
    rows = df.orderBy(*order).offset(a.offset).limit(a.limit)
    return [json.loads(x) for x in rows.toJSON().collect()]  # at most --limit rows


def duplicates(t: Tables, a: argparse.Namespace):
    return _page(R.duplicates(t.documents, t.document_paths), a, "sha256")


def drift(t: Tables, a: argparse.Namespace):
    return _page(P.drift(t.disk, t.scanned_file_in_job), a, "rel_path")


def reconcile(t: Tables, a: argparse.Namespace):
    plan = P.reconcile_plan(P.drift(t.disk, t.scanned_file_in_job))
    if not a.apply:
        return _page(plan, a, "rel_path")
    plan = cut_lineage(plan)
    after, failed = effects.reconcile(t.parts(), plan, t.disk.select("rel_path", "sha256"), a.tree_root)
    rows = _page(failed, a, "rel_path")
    return [*rows, *t.keep(**{W.PARTS[part]: df for part, df in after.items()})]


def backfill(t: Tables, a: argparse.Namespace):
    return [{"changed": R.backfill(t.documents).count()}]


def export_json(t: Tables, a: argparse.Namespace):
    nested = R.nested_records(R.nest(t.documents, t.document_paths, t.document_toc))
    if a.lines:
        files.write_registry_lines(nested, a.output)
        return [{"documents": nested.count(), "output": a.output}]
    n = files.write_registry({"documents": nested, "scanned_files_in_job": t.scanned_file_in_job, "scan_jobs": t.scan_jobs}, a.output)
    return [{"documents": n, "output": a.output}]


def delete_paths(t: Tables, a: argparse.Namespace):
    asked = files.read_path_list(t.spark, a.input, comments=True)
    left, report = P.delete_paths(t.document_paths, asked)
    report = cut_lineage(report)
    return [*_page(report, a, "rel_path"), *t.keep(document_paths=left, scanned_file_in_job=P.delete_scans(t.scanned_file_in_job, report))]


def move_paths(t: Tables, a: argparse.Namespace):
    asked = t.spark.read.option("sep", "\t").schema("old_path string, new_path string").csv(a.input)
    outcomes = cut_lineage(P.move_paths(t.document_paths, asked))
    return [*_page(outcomes, a, "old_path"), *t.keep(document_paths=P.moved_paths(t.document_paths, outcomes), scanned_file_in_job=P.moved_scans(t.scanned_file_in_job, outcomes), documents=P.moved_names(t.documents, outcomes))]


def scan(t: Tables, a: argparse.Namespace):
    listed = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,PDF}").load(a.root)
    found = listed.select("path", F.col("modificationTime").alias("modified"), "content")
    tables = {"documents": t.documents, "paths": t.document_paths.select("sha256", "rel_path"), "state": t.scanned_file_in_job, "jobs": t.scan_jobs, "toc": t.document_toc}
    after, errors = runs.inventory(tables, found, _given(a.extractor), a.job or uuid.uuid4().hex, _now(a), a.root, Config(a.root).normalise_names)
    names = {"documents": "documents", "paths": "document_paths", "state": "scanned_file_in_job", "jobs": "scan_jobs", "toc": "document_toc"}
    failed = _page(errors, a, "rel_path")
    t.keep(**{names[part]: df.withColumn("id", F.xxhash64("rel_path")) if part == "paths" else df for part, df in after.items()})
    last = t.scan_jobs.orderBy(F.desc("run_at"), F.desc("job_id")).limit(1)
    return [*failed, *[json.loads(x) for x in last.toJSON().collect()]]


def watch(t: Tables, a: argparse.Namespace):
    W.watch(t.spark, a.input, a.root, t.store, _readable(t, a.root), a.checkpoint, a.tree_root).awaitTermination()
    return [{"commit": t.store.current()[0]}]


def migrate(t: Tables, a: argparse.Namespace):
    return [runs.migrate(t.store, a.input, a.replace)]


def _suggest(table: str, answer: str, needs_toc: bool, store: bool):
    def run(t: Tables, a: argparse.Namespace):
        docs = R.exclude_by_keyword(R.candidates(t.documents, t.document_toc, require_digital=not needs_toc, require_toc=needs_toc), t.document_paths, merge_keywords(Config("."), a.keyword))
        if a.sha256:
            docs = docs.filter(F.col("sha256").isin(a.sha256))
        status, answers = runs.suggest(docs, t.document_paths, t.document_toc, t.store.read(table), a.prompt, _model(a), needs_toc, a.documents, Config(".").most_toc)
        status = cut_lineage(status)
        out = [runs.status_counts(status).first().asDict()]
        if store:
            number, rejected = runs.suggest_and_store(t.store, table, status, answers, a.prompt, answer, _now(a), a.trace)
            return [*out, {"commit": number}, *_page(rejected, a, "sha256")]
        return [*out, *_page(answers, a, "sha256")]

    return run


def _assign(store: bool):
    def run(t: Tables, a: argparse.Namespace):
        _node_id(t, a.node)
        after, problems = runs.assign(t.taxonomy_nodes, t.taxonomy_node_documents, t.taxonomy_node_topic_terms, t.taxonomy_assignments, t.document_paths, a.node, _model(a), merge_keywords(Config("."), a.keyword), a.offset, a.documents, a.force)
        if not store:
            return [*_page(after, a, "sha256"), *_page(problems, a, "sha256")]
        rows = _page(problems, a, "sha256")
        return [*rows, *t.keep(taxonomy_assignments=after)]

    return run


def _partition(stage: str):
    def run(t: Tables, a: argparse.Namespace):
        node = _node_id(t, a.node)
        docs = t.taxonomy_node_documents.filter(F.col("node_id") == node).select("sha256")
        docs = R.exclude_by_keyword(docs, t.document_paths, merge_keywords(Config("."), a.keyword)) if a.keyword else docs
        inputs = S.prompt_inputs(t.documents.join(docs, "sha256", "left_semi"), t.document_paths, t.document_toc, Config(".").most_toc)
        summaries = S.payload(inputs).withColumnRenamed("payload", "summary")
        model = _model(a)
        if stage == "proposals":
            return _page(runs.propose(summaries, a.seed, a.chunk, a.offset, a.batches, a.node, model), a, "sha256")
        merged = runs.partition(summaries, a.seed, a.chunk, a.node, model, None, a.offset, a.batches if a.batches > 0 else None)
        rows = _page(merged, a, "sha256")
        if stage == "probe" or not rows or rows[0].get("error"):
            return rows
        groups = {g["name"]: g["topics"] for g in json.loads(rows[0]["response"]).get("groups", [])}
        names = groups or dict.fromkeys(json.loads(rows[0]["response"]).get("categories", []), [])
        after = T.replace_children(t.taxonomy_nodes, t.taxonomy_node_documents, t.taxonomy_node_topic_terms, t.taxonomy_assignments, a.node, names)
        return [*rows, *t.keep(taxonomy_nodes=after["nodes"], taxonomy_node_documents=after["members"], taxonomy_node_topic_terms=after["terms"], taxonomy_assignments=after["assignments"].select(*t.taxonomy_assignments.columns))]

    return run


def rename_node(t: Tables, a: argparse.Namespace):
    _node_id(t, a.node)
    return t.keep(taxonomy_nodes=T.rename_node(t.taxonomy_nodes, a.node, a.name))


def delete_node(t: Tables, a: argparse.Namespace):
    _node_id(t, a.node)
    after = T.delete_node(t.taxonomy_nodes, t.taxonomy_node_documents, t.taxonomy_node_topic_terms, t.taxonomy_assignments, a.node)
    return t.keep(taxonomy_nodes=after["nodes"], taxonomy_node_documents=after["members"], taxonomy_node_topic_terms=after["terms"], taxonomy_assignments=after["assignments"])


def node_stats(t: Tables, a: argparse.Namespace):
    rows = T.stats(t.taxonomy_nodes, t.taxonomy_node_documents)
    rows = rows if a.depth is None else rows.filter(F.col("depth") == a.depth)
    return _page(rows.withColumn("_n", -F.col("documents")), a, "_n", "path")


def node_documents(t: Tables, a: argparse.Namespace):
    return _page(T.node_documents(T.lookup(t.taxonomy_nodes, a.node), t.taxonomy_node_documents, t.document_paths), a, "sha256")


def node_terms(t: Tables, a: argparse.Namespace):
    nodes = T.lookup(t.taxonomy_nodes, a.node) if a.node else t.taxonomy_nodes
    return _page(T.node_terms(nodes, t.taxonomy_node_topic_terms), a, "node_path", "term")


def assignments(t: Tables, a: argparse.Namespace):
    rows = T.assignment_views(t.taxonomy_nodes, t.taxonomy_assignments, t.document_paths, a.status)
    return _page(rows.filter(F.col("node_path") == a.node) if a.node else rows, a, "node_path", "sha256")


def apply_assignments(t: Tables, a: argparse.Namespace):
    node = _node_id(t, a.node) if a.node else None
    judged = cut_lineage(T.classify(t.taxonomy_assignments, t.document_paths, a.minimum, a.keyword, node))
    at = _now(a) if "updated_at" in t.taxonomy_assignments.columns else None
    return [T.apply_summary(judged).first().asDict(), *t.keep(taxonomy_node_documents=T.apply_members(t.taxonomy_node_documents, judged), taxonomy_assignments=T.apply_statuses(t.taxonomy_assignments, judged, at))]


def bootstrap_root(t: Tables, a: argparse.Namespace):
    """The root is made if it isn't there, and gets every document; any other node must be there."""
    if a.node and a.node != a.tree_root:
        return [{"node": a.node, "id": _node_id(t, a.node)}]
    nodes = cut_lineage(T.ensure_nodes(t.taxonomy_nodes, t.spark.createDataFrame([(a.tree_root,)], "path string"), "path"))
    root_id = T.lookup(nodes, a.tree_root).first()["id"]
    return t.keep(taxonomy_nodes=nodes, taxonomy_node_documents=T.sync_root(t.taxonomy_node_documents, root_id, t.documents))


def batches(t: Tables, a: argparse.Namespace):
    return _page(B.batches(t.documents.select("sha256").distinct(), "sha256", a.seed, a.chunk), a, "rank")


def scan_stats(t: Tables, a: argparse.Namespace):
    paths = t.document_paths.select("sha256", "rel_path")
    rows = R.merge_rows(paths, t.scanned_file_in_job, t.disk)
    return [R.merge_stats(rows, t.scanned_file_in_job, t.disk).first().asDict()]


SUGGESTION = "suggested_file_name string, suggested_author string, suggested_publisher string, suggested_edition string, suggested_labels_json string, reasoning_summary string"
TOC_REVIEW = "toc_is_valid boolean, toc_matches_document boolean, toc_invalid_reason string, preface_page int, preface_label string, confidence double, reasoning_summary string"
COMMANDS: dict[str, Callable[[Tables, argparse.Namespace], list[dict]]] = {
    "show-duplicates": duplicates, "show-drift": drift, "reconcile": reconcile, "backfill": backfill, "export-json": export_json, "delete-paths": delete_paths, "show-node-stats": node_stats, "show-node-documents": node_documents,
    "show-node-terms": node_terms, "show-assignments": assignments, "apply-assignments": apply_assignments, "bootstrap-root": bootstrap_root, "show-batches": batches, "scan-stats": scan_stats,
    "scan": scan, "watch": watch, "migrate": migrate, "move-paths": move_paths, "rename-node": rename_node, "delete-node": delete_node,
    "probe-suggest": _suggest("llm_document_suggestions", SUGGESTION, False, False), "run-suggest": _suggest("llm_document_suggestions", SUGGESTION, False, True),
    "probe-toc-review": _suggest("llm_toc_review_suggestions", TOC_REVIEW, True, False), "run-toc-review": _suggest("llm_toc_review_suggestions", TOC_REVIEW, True, True),
    "probe-assign": _assign(False), "run-assign": _assign(True), "probe-proposals": _partition("proposals"), "probe-partition": _partition("probe"), "run-partition": _partition("run"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--base", required=True)
    p.add_argument("--limit", type=int, default=SHOWN)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--node")
    p.add_argument("--depth", type=int)
    p.add_argument("--status")
    p.add_argument("--minimum", choices=("low", "medium", "high"), default="medium")
    p.add_argument("--keyword", action="append", default=[])
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--seed", default="shelfmark-partition-v1")
    p.add_argument("--chunk", type=int, default=50)
    p.add_argument("--batches", type=int, default=0)
    p.add_argument("--root")
    p.add_argument("--tree-root", default="Root")
    p.add_argument("--extractor")
    p.add_argument("--responder")
    p.add_argument("--offline-model", action="store_true", help="the responder asks no model outside")
    p.add_argument("--checkpoint")
    p.add_argument("--job")
    p.add_argument("--at")
    p.add_argument("--name")
    p.add_argument("--prompt", type=int, default=0)
    p.add_argument("--documents", type=int)
    p.add_argument("--sha256", action="append", default=[])
    p.add_argument("--trace")
    for flag in ("apply", "replace", "lines", "force"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("shelfmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = COMMANDS[a.command](Tables(spark, a.base), a)
    for r in rows:
        sys.stdout.write(json.dumps(r, ensure_ascii=False) + "\n")
    return rows


if __name__ == "__main__":
    main()
