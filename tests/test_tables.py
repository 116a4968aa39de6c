"""Paths, taxonomy, partitioning, suggestions, sources and streaming on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import partitioning as B
from shelfmark.operators import paths as P
from shelfmark.operators import suggestions as S
from shelfmark.operators import taxonomy as T
from shelfmark.sources import files
from shelfmark.streaming import watch as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_drift_and_plan(spark):
    d = spark.createDataFrame([("same", "1"), ("new", "9"), ("copy", "1"), ("changed", "8")], "rel_path string, sha256 string")
    r = spark.createDataFrame([("same", "1"), ("gone", "2"), ("changed", "3")], "rel_path string, sha256 string")
    got = P.drift(d, r)
    assert {x.rel_path: x["class"] for x in got.collect()} == {"new": "missing_hash", "copy": "known_hash_missing_path", "gone": "missing_on_disk", "changed": "hash_mismatch"}
    assert rows(P.reconcile_plan(got)) == [("copy", "discover"), ("gone", "remove"), ("new", "discover")]


def test_moves_and_deletes(spark):
    p = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "sha256 string, rel_path string")
    m = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z"), ("q", "z")], "old_path string, new_path string")
    assert rows(P.move_paths(p, m).select("old_path", "new_path", "outcome")) == [("a", "b", "dropped"), ("a", "c", "refused"), ("a", "z", "moved"), ("q", "z", "unknown")]
    left, report = P.delete_paths(p, spark.createDataFrame([("a",), ("c",), ("nope",)], "rel_path string"))
    assert rows(left) == [("1", "b")] and rows(report) == [("a", "1", 1), ("c", "2", 0)]


def tree(spark):
    return spark.createDataFrame([(1, None, "Root", "Root", 0), (2, 1, "Physics", "Root/Physics", 1), (3, 2, "Quanta", "Root/Physics/Quanta", 2), (4, 1, "Art", "Root/Art", 1)], "id bigint, parent_id bigint, name string, path string, depth int")


def test_tree(spark):
    n = tree(spark)
    assert rows(T.descendants(n, "Root/Physics").select("id")) == rows(T.descendants_by_parent(n, 2)) == [(3,)]
    assert rows(T.descendants_by_parent(n, 1)) == [(2,), (3,), (4,)]
    m = spark.createDataFrame([(2, "a"), (2, "b")], "node_id bigint, sha256 string")
    assert {r.path: r.documents for r in T.stats(n, m).collect()} == {"Root": 0, "Root/Physics": 2, "Root/Physics/Quanta": 0, "Root/Art": 0}
    made = T.partition_children(n, "Root/Physics", [" Waves", "Waves", "", "Heat"])
    assert rows(made.filter("depth = 2").select("id", "parent_id", "path")) == [(5, 2, "Root/Physics/Waves"), (6, 2, "Root/Physics/Heat")]


def test_apply(spark):
    a = spark.createDataFrame([(2, "a", 3, "high", "pending"), (2, "b", 3, None, "pending"), (2, "c", 3, "high", "applied"), (2, "d", None, "high", "pending"), (2, "e", 3, "medium", "pending")], "node_id bigint, sha256 string, assigned_child_id bigint, confidence string, status string")
    p = spark.createDataFrame([("e", "Archive/e.pdf"), ("a", "x/a.pdf")], "sha256 string, rel_path string")
    c = T.classify(a, p, "medium", ["archive"])
    assert {r.sha256: r.outcome for r in c.collect()} == {"a": "applied", "b": "skipped", "c": "skipped", "d": "skipped", "e": "excluded"}
    m = spark.createDataFrame([(2, "a"), (2, "b")], "node_id bigint, sha256 string")
    assert rows(T.apply_members(m, c)) == [(2, "b"), (3, "a")]
    assert T.apply_summary(c).first().asDict() == {"applied": 1, "excluded": 1, "skipped": 3}
    up = T.upsert_assignments(a, a.withColumn("status", F.lit("stay")))
    assert {r.sha256: r.status for r in up.collect()}["c"] == "applied"


def test_seeded_order(spark):
    keys = [f"k{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "sha256 string")
    want = sorted(keys, key=lambda k: (hashlib.sha256(f"s:{k}".encode()).hexdigest(), k))
    got = B.batches(df, "sha256", "s", 50)
    assert [r.sha256 for r in got.orderBy("rank").collect()] == want
    assert {r.batch_index: r["count"] for r in got.groupBy("batch_index").count().collect()} == dict.fromkeys(range(10), 50)
    B.check_range(got, 8, 2)
    with pytest.raises(ValueError):
        B.check_range(got, 9, 2)


def test_batch_and_upsert(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "sha256 string")
    toc = spark.createDataFrame([("a",), ("b",)], "sha256 string")
    old = spark.createDataFrame([(1, "a", 4, "x", "rejected", True, "t0", "t0")], "id bigint, sha256 string, prompt_id bigint, suggested_author string, status string, applied boolean, created_at string, updated_at string")
    assert rows(S.batch_status(docs, toc, old, 4, True)) == [("a", "skipped_existing"), ("b", "pending"), ("c", "skipped_ineligible")]
    assert rows(S.batch_status(docs, toc, old, 4, False, 1)) == [("a", "skipped_existing")]
    new = spark.createDataFrame([("a", 4, "y", "t1"), ("b", 4, "z", "t1"), ("q", 4, "w", "t1")], "sha256 string, prompt_id bigint, suggested_author string, updated_at string")
    kept, rejected = S.upsert_suggestions(old, new, docs)
    got = {r.sha256: r for r in kept.collect()}
    assert (got["a"].id, got["a"].suggested_author, got["a"].status, got["a"].applied, got["a"].created_at) == (1, "y", "pending", True, "t0")
    assert (got["b"].status, got["b"].applied) == ("pending", False) and [r.sha256 for r in rejected.collect()] == ["q"]


def test_responder_retries(spark):
    def responder(text):
        if "bad" in text:
            raise RuntimeError("down")
        return {"ok": True}

    df = spark.createDataFrame([("a", "{}"), ("b", '{"bad": 1}')], "sha256 string, payload string")
    got = {r.sha256: r for r in S.respond(df, responder, first_wait=0.0).collect()}
    assert json.loads(got["a"].response) == {"ok": True} and got["b"].error == "RuntimeError: down"
    assert S.retry_waits() == [2.0, 4.0]


def test_scope_filter(spark):
    df = spark.createDataFrame([(["Optics", " physics"], [("Physics", ["x"]), ("Waves", ["Root", "y"])])], "categories array<string>, groups array<struct<name string, topics array<string>>>")
    r = B.filter_scope(df, "categories", "groups", ["Physics", "root"]).first()
    assert r.categories == ["Optics"] and [(g.name, g.topics) for g in r.groups] == [("Waves", ["y"])]


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.pdf\n\n# note\n b.pdf \n")
    assert rows(files.read_path_list(spark, str(tmp_path / "list.txt"), True)) == [("a.pdf",), ("b.pdf",)]
    (tmp_path / "r.json").write_text(json.dumps({"documents": {"h": {"sha256": "h", "paths": ["a.pdf"], "file_name": "a.pdf", "toc": [{"level": 1, "title": "T", "page": 2}]}}, "file_stats": {"a.pdf": {"rel_path": "a.pdf", "sha256": "h", "mtime": 1.5}}, "jobs": [{"job_id": "j", "stats": {"added": 1}}]}))
    got = files.read_registry(spark, str(tmp_path / "r.json"))
    assert got["documents"].first().paths == ["a.pdf"] and got["scanned_files_in_job"].first().mtime == 1.5 and got["scan_jobs"].first().added == 1
    root = tmp_path / "docs" / "sub"
    root.mkdir(parents=True)
    (root / "x.pdf").write_bytes(b"hello")
    (root / "y.pdf").write_bytes(b"-")
    (root / "z.txt").write_bytes(b"no")
    assert files.list_files(spark, str(tmp_path / "docs")).count() == 2

    def extractor(rel, content):
        if content == b"-":
            raise ValueError("empty")
        return {"metadata": {"title": "X"}, "is_digital": True, "languages": ["en"], "toc": []}

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(str(tmp_path / "docs"))
    recs = {r.rel_path: r for r in files.extract(found, extractor, str(tmp_path / "docs")).collect()}
    assert recs["sub/x.pdf"].sha256 == hashlib.sha256(b"hello").hexdigest() and recs["sub/x.pdf"].error is None
    assert recs["sub/y.pdf"].error == "ValueError: empty"
    one, two = (files.save_version(spark.range(n), str(tmp_path / "v")) for n in (1, 2))
    assert one != two and spark.read.parquet(one).count() == 1


def test_routing(spark):
    events = [(1, "created", False, "/data/a.pdf", None), (2, "moved", False, "/data/a.pdf", "/data/b.PDF"), (3, "modified", False, "/data/known.pdf", None), (4, "deleted", False, "/data/c.pdf", None), (5, "moved", False, "/else/x.pdf", "/data/d.pdf"), (6, "created", True, "/data/dir", None), (7, "created", False, "/data/x.txt", None), (8, "modified", False, "/data/new.pdf", None), (9, "moved", False, "/data/c.pdf", "/else/c.pdf")]
    normal = W.normalise(spark.createDataFrame(events, W.EVENT_SCHEMA), "/data")
    got = rows(W.route(normal, spark.createDataFrame([("known.pdf",)], "rel_path string")))
    assert got == [(1, "path_discovered", "a.pdf", None), (2, "path_moved", "a.pdf", "b.PDF"), (4, "path_missing", "c.pdf", None), (5, "path_discovered", "d.pdf", None), (8, "path_discovered", "new.pdf", None), (9, "path_missing", "c.pdf", None)]
    later = rows(W.route(normal))
    assert (3, "path_changed", "known.pdf", None) in later and (8, "path_changed", "new.pdf", None) in later and len(later) == len(got) + 1
