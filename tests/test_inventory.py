"""Inventory runs, registries as JSON, imports, applied assignments, and the commands that change a registry."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfmark import cli, schemas
from shelfmark.operators import paths as P
from shelfmark.operators import registry as R
from shelfmark.operators import runs
from shelfmark.operators import taxonomy as T
from shelfmark.sources import files
from shelfmark.sources.store import Store
from tests import fakes


def collection(tmp_path):
    root = tmp_path / "docs"
    for name, text in {"Root/a/One.pdf": "Alpha\n" + "text " * 40, "Root/b/two.pdf": "Beta\nshort", "copy.pdf": "Beta\nshort", "bad.pdf": "broken", "note.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def found(spark, root):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path", F.col("modificationTime").alias("modified"), "content")


def empty(spark):
    names = {"documents": "documents", "paths": "document_paths", "state": "scanned_file_in_job", "jobs": "scan_jobs", "toc": "document_toc"}
    out = {part: schemas.empty_table(spark, name) for part, name in names.items()}
    return out | {"paths": out["paths"].drop("id")}


def test_inventory_keeps_all_columns_and_isolates_faults(spark, tmp_path):
    root = collection(tmp_path)
    attempted = []
    after, errors = runs.inventory(empty(spark), found(spark, root), fakes.extractor, "j1", "2024-01-01 00:00:00", root, on_progress=lambda df: attempted.append(df.count()), detector=lambda text: ["en"])
    assert attempted == [4] and [(r.rel_path, r.error) for r in errors.collect()] == [("bad.pdf", "ValueError: cannot read")]
    docs = {r.metadata_title: r for r in after["documents"].collect()}
    one, two = docs["Alpha"], docs["Beta"]
    assert (one.file_name, one.is_digital, two.is_digital, two.file_name) == ("One.pdf", True, False, "two.pdf")
    assert one.normalised_name == "one" or one.normalised_name, one.normalised_name
    assert (json.loads(one.languages_json), one.metadata_author, one.metadata_created, json.loads(one.metadata_extra_json), one.first_seen_job) == (["en"], None, "D:2020", {"producer": "p"}, "j1")
    assert after["jobs"].first().added == 2 and after["jobs"].first().duplicates == 1
    assert after["toc"].count() == 2 and after["toc"].first().title == "One"
    os.remove(f"{root}/copy.pdf")
    again, _ = runs.inventory({k: v for k, v in after.items()}, found(spark, root), fakes.extractor, "j2", "2024-01-02 00:00:00", root)
    kept = {r.metadata_title: r for r in again["documents"].collect()}
    assert kept["Alpha"].asDict() | {"last_seen_job": "j1"} == one.asDict() and kept["Alpha"].last_seen_job == "j2"
    assert {r.job_id: (r.added, r.removed, r.skipped) for r in again["jobs"].collect()}["j2"] == (0, 1, 2)


def test_extraction_guards(spark, tmp_path):
    rows = spark.createDataFrame([("/c/ok.pdf", bytearray(b"T\nx")), ("/d/out.pdf", bytearray(b"x")), ("/c/x.txt", bytearray(b"x")), ("/c/../e.pdf", bytearray(b"x"))], "path string, content binary")
    got = {r.rel_path: r.error for r in files.extract(rows, fakes.extractor, "/c").collect()}
    assert got == {"ok.pdf": None, "/d/out.pdf": "ValueError: outside the root", "x.txt": "ValueError: no PDF", "../e.pdf": "ValueError: outside the root"}


def test_registry_json_round_trip_and_import(spark, tmp_path):
    root = collection(tmp_path)
    after, _ = runs.inventory(empty(spark), found(spark, root), fakes.extractor, "j1", "2024-01-01 00:00:00", root)
    nested = R.nest(after["documents"], after["paths"], after["toc"])
    registry = {"documents": R.nested_records(nested), "scanned_files_in_job": after["state"], "scan_jobs": after["jobs"]}
    path = str(tmp_path / "registry.json")
    assert files.write_registry(registry, path) == 2
    assert set(json.load(open(path))) == {"documents", "scanned_files_in_job", "scan_jobs"}
    read = files.read_registry(spark, path)
    assert sorted(r.sha256 for r in read["documents"].collect()) == sorted(r.sha256 for r in nested.collect())
    assert sorted(map(tuple, read["scanned_files_in_job"].select("rel_path", "sha256").collect())) == sorted(map(tuple, after["state"].select("rel_path", "sha256").collect()))
    files.write_registry_lines(registry["documents"], str(tmp_path / "lines"))
    assert files.read_registry_lines(spark, str(tmp_path / "lines")).count() == 2
    assert {k: v.count() for k, v in files.read_registry(spark, str(tmp_path / "absent.json")).items()} == {"documents": 0, "scanned_files_in_job": 0, "scan_jobs": 0}
    (tmp_path / "wrong.json").write_text("{nonsense")
    with pytest.raises(Exception):
        files.read_registry(spark, str(tmp_path / "wrong.json"))["documents"].collect()

    store = Store(spark, str(tmp_path / "store"))
    known = nested.first().sha256
    old = spark.createDataFrame([(1, known, 4), (2, "gone", 4)], "id bigint, sha256 string, prompt_id bigint")
    store.commit({"llm_document_suggestions": old, "prompts": spark.createDataFrame([(4,)], "id bigint")})
    with pytest.raises(FileExistsError):
        runs.migrate(store, path)
    counts = runs.migrate(store, path, replace=True)
    assert (counts["source"], counts["documents"], counts["paths"], counts["toc_entries"], counts["scanned_files"], counts["scan_jobs"]) == (path, 2, 3, 2, 3, 1)
    assert [r.sha256 for r in store.read("llm_document_suggestions").collect()] == [known] and store.read("prompts").count() == 1
    assert {r.metadata_title for r in store.read("documents").collect()} == {"Alpha", "Beta"}
    assert runs.migrate(Store(spark, str(tmp_path / "fresh")), str(tmp_path / "absent.json"))["documents"] == 0


def test_applied_assignments_are_not_applied_again(spark):
    a = spark.createDataFrame([(1, "a", 2, "high", "pending"), (1, "b", 2, "low", "pending"), (5, "a", 6, "high", "pending")], "node_id bigint, sha256 string, assigned_child_id bigint, confidence string, status string").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    none = spark.createDataFrame([], "sha256 string, rel_path string")
    judged = T.classify(a, none, "medium", node_id=1)
    after = T.apply_statuses(a, judged, "2024-01-01 00:00:00")
    assert {(r.node_id, r.sha256): (r.status, r.updated_at is not None) for r in after.collect()} == {(1, "a"): ("applied", True), (1, "b"): ("pending", False), (5, "a"): ("pending", False)}
    assert T.apply_summary(T.classify(after, none, "medium", node_id=1)).first().asDict() == {"applied": 0, "excluded": 0, "skipped": 2}


def test_replaced_children_and_moved_scans(spark):
    nodes = spark.createDataFrame([(1, None, "Root", "Root", 0), (2, 1, "Old", "Root/Old", 1)], "id bigint, parent_id bigint, name string, path string, depth int")
    members, terms = spark.createDataFrame([(1, "a"), (2, "a")], "node_id bigint, sha256 string"), spark.createDataFrame([(2, "x"), (1, "top")], "node_id bigint, term string")
    assigned = spark.createDataFrame([(1, "a", 2, "high", "pending"), (1, "b", None, "low", "stay")], "node_id bigint, sha256 string, assigned_child_id bigint, confidence string, status string")
    got = T.replace_children(nodes, members, terms, assigned, "Root", {"New": [" t ", "t", ""], "": ["no"], "Other": []})
    assert sorted(r.path for r in got["nodes"].collect()) == ["Root", "Root/New", "Root/Other"]
    new = T.lookup(got["nodes"], "Root/New").first().id
    assert sorted(map(tuple, got["terms"].collect())) == [(1, "top"), (new, "t")] and [tuple(r) for r in got["members"].collect()] == [(1, "a")] and [r.sha256 for r in got["assignments"].collect()] == ["b"]
    paths = spark.createDataFrame([("s", "a.pdf"), ("s", "b.pdf")], "sha256 string, rel_path string")
    state = spark.createDataFrame([("a.pdf", "s", 1), ("x/z.pdf", "q", 2)], "rel_path string, sha256 string, size_bytes bigint")
    out = P.move_paths(paths, spark.createDataFrame([("a.pdf", "x/z.pdf")], "old_path string, new_path string"))
    assert [tuple(r) for r in P.moved_scans(state, out).collect()] == [("x/z.pdf", "s", 1)]
    assert [tuple(r) for r in P.moved_names(spark.createDataFrame([("s", "a.pdf")], "sha256 string, file_name string"), out).collect()] == [("s", "z.pdf")]
    left, report = P.delete_paths(paths, spark.createDataFrame([("a.pdf",)], "rel_path string"))
    assert left.count() == 1 and [r.rel_path for r in P.delete_scans(state, report).collect()] == ["x/z.pdf"]


def test_answers_are_kept_in_scope(spark):
    answers = spark.createDataFrame([("m", json.dumps({"categories": ["Law", "Art"], "groups": [{"name": "law ", "topics": ["x"]}, {"name": "Art", "topics": ["Law", "y"]}]}), None), ("e", None, "down"), ("o", '{"n": 1}', None)], "sha256 string, response string, error string")
    got = {r.sha256: r.response for r in runs.in_scope(answers, "Root/Law").collect()}
    assert json.loads(got["m"]) == {"categories": ["Art"], "groups": [{"name": "Art", "topics": ["y"]}]} and got["e"] is None and got["o"] == '{"n": 1}'


def test_commands_that_change_a_registry(spark, tmp_path):
    root, base = collection(tmp_path), str(tmp_path / "registry")
    run = lambda c, *more: cli.main([c, "--base", base, *more], spark)
    model = ("--responder", "tests.fakes:model", "--offline-model")
    got = run("scan", "--root", root, "--extractor", "tests.fakes:extractor", "--job", "j1", "--at", "2024-01-01 00:00:00")
    assert got[0]["error"] == "ValueError: cannot read" and (got[1]["added"], got[1]["duplicates"]) == (2, 1)
    assert len(run("show-duplicates")) == 1 and len(run("bootstrap-root")) == 2
    with pytest.raises(SystemExit):
        run("bootstrap-root", "--node", "Root/absent")
    incoming = tmp_path / "in"
    incoming.mkdir()
    os.rename(f"{root}/Root/a/One.pdf", f"{root}/Root/b/Uno.pdf")
    (incoming / "e.json").write_text(json.dumps({"event_id": 1, "kind": "moved", "is_directory": False, "src_path": f"{root}/Root/a/One.pdf", "dest_path": f"{root}/Root/b/Uno.pdf"}))
    run("watch", "--root", root, "--input", str(incoming), "--checkpoint", str(tmp_path / "cp"))
    assert "Uno.pdf" in {r.file_name for r in Store(spark, base).read("documents").collect()} and {r["path"] for r in run("show-node-stats")} == {"Root", "Root/b"}
    assert run("probe-partition", "--node", "Root/b", *model)[0]["sha256"] == "merged"
    assert len(run("probe-proposals", "--node", "Root", "--batches", "1", *model)) == 1
    run("run-partition", "--node", "Root", *model)
    assert {r["path"] for r in run("show-node-stats")} >= {"Root", "Root/Rivers"}
    assert run("probe-assign", "--node", "Root", *model) and run("run-assign", "--node", "Root", *model)[-1]["table"] == "taxonomy_assignments"
    assert run("apply-assignments", "--node", "Root")[0]["applied"] == 2 and run("apply-assignments", "--node", "Root")[0]["applied"] == 0
    first = run("run-suggest", "--prompt", "4", "--trace", str(tmp_path / "trace"), *model)
    assert first[0]["persisted"] == 1 and run("run-suggest", "--prompt", "4", *model)[0]["skipped_existing"] == 1
    assert Store(spark, base).read("llm_document_suggestions").first().suggested_author == "Alpha"
    assert run("run-toc-review", "--prompt", "5", *model)[0]["persisted"] == 2 and run("probe-toc-review", "--prompt", "6", *model)[0]["persisted"] == 2
    run("rename-node", "--node", "Root/Rivers", "--name", "Streams")
    run("delete-node", "--node", "Root/Streams")
    (tmp_path / "moves.tsv").write_text("copy.pdf\tkopie.pdf\n")
    assert run("move-paths", "--input", str(tmp_path / "moves.tsv"))[0]["outcome"] == "moved"
    out = str(tmp_path / "out.json")
    assert run("export-json", "--output", out)[0]["documents"] == 2 and len(json.load(open(out))["documents"]) == 2
    with pytest.raises(FileExistsError):
        run("migrate", "--input", out)
    assert run("migrate", "--input", out, "--replace")[0]["documents"] == 2
    assert {r.metadata_title for r in Store(spark, base).read("documents").collect()} == {"Alpha", "Beta"}
    spark.createDataFrame([("kopie.pdf", "zz", 1, 1.0), ("neu.pdf", "n", 1, 1.0)], "rel_path string, sha256 string, size_bytes bigint, mtime double").write.parquet(f"{base}/disk.parquet")
    assert run("reconcile", "--apply")[-1]["commit"] > 1
    assert "neu.pdf" in {r.rel_path for r in Store(spark, base).read("document_paths").collect()}
