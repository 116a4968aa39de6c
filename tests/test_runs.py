"""Configuration, whole runs with a fake model, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark import cli
from shelfmark.config import Config, merge_keywords
from shelfmark.operators import paths as P
from shelfmark.operators import runs
from shelfmark.operators import taxonomy as T


def test_config():
    env = {"SHELFMARK_ROOT": "/c", "SHELFMARK_NORMALISE_NAMES": " Off ", "SHELFMARK_ONLINE": "yes", "SHELFMARK_PARTITION_CHUNK": "7", "SHELFMARK_EXCLUDE_KEYWORDS": " a, ,B ,b"}
    c = Config.from_env(env)
    assert (c.normalise_names, c.online, c.partition_chunk, c.exclude_keywords) == (False, True, 7, ("a", "B", "b"))
    assert merge_keywords(c) == ["a", "B"] and merge_keywords(c, [" x ", "X", ""]) == ["x"]
    with pytest.raises(ValueError):
        Config.from_env({})
    with pytest.raises(RuntimeError):
        c.require_online()
    assert Config.from_env({"SHELFMARK_ROOT": "/c", "SHELFMARK_ONLINE": "perhaps"}).online is False
    Config(root="/c", online=True, model_key="k").require_online()


def test_scan_twice(spark):
    docs = spark.createDataFrame([], "sha256 string, file_name string, first_seen_job string, last_seen_job string")
    paths = spark.createDataFrame([], "sha256 string, rel_path string")
    state = spark.createDataFrame([], "rel_path string, sha256 string, size_bytes bigint, mtime double, last_scanned_job string")
    jobs = spark.createDataFrame([], "job_id string, run_at timestamp_ntz, root_path string, added int, updated int, removed int, duplicates int, skipped int")
    batch = spark.createDataFrame([("a.pdf", "h1", 1, 1.0), ("b.pdf", "h1", 1, 1.0), ("c.pdf", "h2", 1, 1.0)], "rel_path string, sha256 string, size_bytes bigint, mtime double")
    one = runs.scan(docs, paths, state, jobs, batch, "j1", "2024-01-01 00:00:00", "/c")
    two = runs.scan(one["documents"], one["paths"], one["state"], one["jobs"], batch.filter("rel_path <> 'c.pdf'"), "j2", "2024-01-02 00:00:00", "/c")
    got = {r.job_id: (r.added, r.updated, r.removed, r.duplicates, r.skipped) for r in two["jobs"].collect()}
    assert got == {"j1": (2, 1, 0, 1, 0), "j2": (0, 0, 1, 0, 2)}
    assert {r.sha256: (r.file_name, r.first_seen_job, r.last_seen_job) for r in two["documents"].collect()} == {"h1": ("a.pdf", "j1", "j2"), "h2": ("c.pdf", "j1", "j1")}


def test_suggest(spark):
    docs = spark.createDataFrame([("a", "a.pdf", "T", None), ("b", "b.pdf", None, None), ("c", "bad.pdf", None, None)], "sha256 string, file_name string, metadata_title string, metadata_author string")
    paths = spark.createDataFrame([("a", "x/a.pdf"), ("b", "x/b.pdf"), ("c", "x/bad.pdf")], "sha256 string, rel_path string")
    toc = spark.createDataFrame([("a", 0, "I"), ("c", 0, "I")], "sha256 string, position int, title string")
    old = spark.createDataFrame([("a", 1)], "sha256 string, prompt_id bigint")

    def responder(payload):
        if json.loads(payload)["file_name"] == "bad.pdf":
            raise ValueError("no")
        return {"name": json.loads(payload)["current_path"]}

    import shelfmark.operators.suggestions as S

    wait, S.FIRST_WAIT = S.FIRST_WAIT, 0.0
    S.respond.__defaults__ = (S.ATTEMPTS, 0.0, 0.0)
    try:
        status, answers = runs.suggest(docs, paths, toc, old, 1, responder, needs_toc=False)
        assert {r.sha256: r.status for r in status.collect()} == {"a": "skipped_existing", "b": "persisted", "c": "failed"}
        assert runs.status_counts(status).first().asDict() == {"total": 3, "requested": 2, "persisted": 1, "skipped_existing": 1, "skipped_ineligible": 0, "failed": 1}
        summaries = spark.createDataFrame([(f"d{i}", f"s{i}") for i in range(7)], "sha256 string, summary string")
        proposals = runs.propose(summaries, "s", 3, 0, 2, "Root", lambda p: {"n": len(json.loads(p)["documents"])})
        assert sorted(json.loads(r.response)["n"] for r in proposals.collect()) == [3, 3]
        merged = runs.generalise(proposals, "Root", lambda p: {"got": len(json.loads(p)["proposals"])})
        assert json.loads(merged.first().response) == {"got": 2}
    finally:
        S.FIRST_WAIT = wait
        S.respond.__defaults__ = (S.ATTEMPTS, wait, 0.0)


NODES = "id bigint, parent_id bigint, name string, path string, depth int"


def tree(spark):
    return spark.createDataFrame([(1, None, "Root", "Root", 0), (2, 1, "Art", "Root/Art", 1), (3, 1, "Law", "Root/Law", 1)], NODES)


def test_assign(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "e")], "node_id bigint, sha256 string")
    terms = spark.createDataFrame([(2, "paint")], "node_id bigint, term string")
    old = spark.createDataFrame([(1, "d", 2, "high", "applied")], "node_id bigint, sha256 string, assigned_child_id bigint, confidence string, status string")
    paths = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf"), ("c", "c.pdf"), ("d", "d.pdf"), ("e", "Archive/e.pdf")], "sha256 string, rel_path string")
    answers = {"a.pdf": {"decision": "child", "child": "Art", "confidence": "high", "reasoning": "r"}, "b.pdf": {"decision": "stay", "child": None, "confidence": "low", "reasoning": "r"}, "c.pdf": {"decision": "child", "child": "Nowhere", "confidence": "low", "reasoning": "r"}}
    new, problems = runs.assign(tree(spark), members, terms, old, paths, "Root", lambda p: answers[json.loads(p)["current_path"]], ["archive"])
    assert {r.sha256: (r.assigned_child_id, r.status) for r in new.collect()} == {"a": (2, "pending"), "b": (None, "stay"), "d": (2, "applied")}
    assert [tuple(r) for r in problems.collect()] == [("c", "unknown child")]


def test_tree_changes(spark):
    n = tree(spark)
    made = T.ensure_nodes(n, spark.createDataFrame([("Root/Law/Sea",), ("Root/Art",)], "p string"), "p")
    assert [(r.id, r.parent_id, r.path) for r in made.filter("id > 3").collect()] == [(4, 3, "Root/Law/Sea")]
    assert {r.path for r in T.rename_node(made, "Root/Law", "Acts").collect()} == {"Root", "Root/Art", "Root/Acts", "Root/Acts/Sea"}
    m, t = spark.createDataFrame([(4, "a"), (2, "a")], "node_id bigint, sha256 string"), spark.createDataFrame([(4, "x")], "node_id bigint, term string")
    a = spark.createDataFrame([(1, "a", 4, "high", "pending"), (1, "b", None, "low", "stay")], "node_id bigint, sha256 string, assigned_child_id bigint, confidence string, status string")
    left = T.delete_node(made, m, t, a, "Root/Law")
    assert {k: v.count() for k, v in left.items()} == {"nodes": 2, "members": 1, "terms": 0, "assignments": 1}
    assert {r.sha256: r.status for r in T.mark_touched(a, m).collect()} == {"a": "manual_touched", "b": "stay"}
    assert T.remove_members(m, m.filter("node_id = 4")).count() == 1


def test_path_changes(spark):
    p = spark.createDataFrame([("1", "a"), ("1", "b")], "sha256 string, rel_path string")
    up = P.upsert_paths(p, spark.createDataFrame([("2", "a"), ("2", "c"), ("2", "c")], "sha256 string, rel_path string"))
    assert sorted(map(tuple, up.collect())) == [("1", "a"), ("1", "b"), ("2", "c")]
    out = P.move_paths(p, spark.createDataFrame([("a", "z"), ("b", "a")], "old_path string, new_path string"))
    assert sorted(map(tuple, P.moved_paths(p, out).collect())) == [("1", "z")]


def test_languages_and_prompt(spark):
    df = spark.createDataFrame([(1, " text "), (2, ""), (3, None), (4, "boom")], "id int, text string")
    got = runs.detect_languages(df, "id", "text", lambda t: ["en"] if t == "text" else 1 / 0)
    assert {r.id: r.languages for r in got.collect()} == {1: ["en"], 2: [], 3: [], 4: []}
    text = runs.system_prompt("A librarian.", "titles", ["name it"], ["answer in JSON"])
    assert text.startswith("A librarian.") and "Goals:\n- name it" in text and "Evidence" not in text


def test_command_line(spark, tmp_path, capsys):
    tables = {
        "documents": spark.createDataFrame([("1", "A b.pdf", "x.pdf"), ("2", "c.pdf", "C.pdf")], "sha256 string, file_name string, normalised_name string").withColumn("doc_id", F.monotonically_increasing_id()),
        "document_paths": spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "sha256 string, rel_path string"),
        "document_toc": spark.createDataFrame([("1", 0, 1, "T", 3)], "sha256 string, position int, level int, title string, page int"),
        "scanned_file_in_job": spark.createDataFrame([("a", "1", 1, 1.0, "j")], "rel_path string, sha256 string, size_bytes bigint, mtime double, last_scanned_job string"),
        "disk": spark.createDataFrame([("b", "1", 1, 1.0)], "rel_path string, sha256 string, size_bytes bigint, mtime double"),
        "taxonomy_nodes": tree(spark), "taxonomy_node_documents": spark.createDataFrame([(1, "1")], "node_id bigint, sha256 string"), "taxonomy_node_topic_terms": spark.createDataFrame([(2, "t")], "node_id bigint, term string"),
        "taxonomy_assignments": spark.createDataFrame([(1, "1", 2, "high", "pending")], "node_id bigint, sha256 string, assigned_child_id bigint, confidence string, status string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "gone.txt").write_text("# these\nb\n")
    run = lambda c, *more: cli.main([c, "--base", str(tmp_path), *more], spark)
    assert run("show-duplicates") == [{"sha256": "1", "file_name": "A b.pdf", "path_count": 2, "paths": ["a", "b"]}]
    assert {r["class"] for r in run("show-drift")} == {"missing_on_disk", "known_hash_missing_path"}
    assert {r["action"] for r in run("reconcile")} == {"remove", "discover"}
    assert run("backfill") == [{"changed": 1}]
    assert run("scan-stats")[0]["removed"] == 1
    assert run("export-json", "--output", str(tmp_path / "out"))[0]["documents"] == 2
    assert run("delete-paths", "--input", str(tmp_path / "gone.txt"))[0] == {"rel_path": "b", "sha256": "1", "remaining": 1}
    assert run("show-node-stats", "--depth", "0")[0]["documents"] == 1
    assert run("show-node-documents", "--node", "Root")[0]["path"] == "a"
    assert run("show-node-terms")[0]["term"] == "t"
    assert run("show-assignments", "--status", "pending")[0]["child_path"] == "Root/Art"
    assert run("apply-assignments")[0] == {"applied": 1, "excluded": 0, "skipped": 0}
    assert len(run("bootstrap-root")) == 2 and len(run("show-batches", "--chunk", "1")) == 2
    assert capsys.readouterr().out
