"""Scan merge against the sequential loop it replaces, and the registry's other table operators."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmark import schemas
from shelfmark.operators import registry as R


def model(docs, state, batch):
    """One scan, row by row: docs {sha: set of paths}, state {rel: (sha, mtime)}, batch [(rel, sha, mtime)]."""
    docs = {k: set(v) for k, v in docs.items()}
    state, stats = dict(state), dict.fromkeys(("added", "updated", "removed", "duplicates", "skipped"), 0)
    prior = dict(state)
    for rel, sha, mtime in batch:
        if sha not in docs:
            if rel in state and state[rel][0] != sha:
                docs.get(state[rel][0], set()).discard(rel)
            docs[sha] = {rel}
            state[rel] = (sha, mtime)
            stats["added"] += 1
            continue
        if rel not in docs[sha]:
            docs[sha].add(rel)
            stats["duplicates"] += 1
        if rel not in state or state[rel][1] != mtime:
            state[rel] = (sha, mtime)
            stats["updated"] += 1
        else:
            stats["skipped"] += 1
    seen = {b[0] for b in batch}
    stats["removed"] = len({s for rel, (s, _) in prior.items() if rel not in seen})
    return docs, state, stats


def merged(spark, docs, state, batch):
    p = spark.createDataFrame([(s, r) for s, rs in docs.items() for r in rs], "sha256 string, rel_path string")
    s = spark.createDataFrame([(r, h, 1, m, "old") for r, (h, m) in state.items()], "rel_path string, sha256 string, size_bytes bigint, mtime double, last_scanned_job string")
    b = spark.createDataFrame([(r, h, 1, m) for r, h, m in batch], "rel_path string, sha256 string, size_bytes bigint, mtime double")
    rows = R.merge_rows(p, s, b)
    got_docs = {}
    for r in R.merge_paths(p, rows, strict=True).collect():
        got_docs.setdefault(r.sha256, set()).add(r.rel_path)
    got_state = {r.rel_path: (r.sha256, r.mtime) for r in R.merge_state(s, rows, "new").collect()}
    return got_docs, got_state, R.merge_stats(rows, s, b).first().asDict()


PATHS, HASHES = [f"p{i}.pdf" for i in range(6)], ["h0", "h1", "h2", "h3"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_merge_is_the_loop(spark, seed):
    r = random.Random(seed)
    docs, state = {}, {}
    for _ in range(2):
        batch = sorted((p, r.choice(HASHES), float(r.randrange(3))) for p in r.sample(PATHS, r.randrange(1, 6)))
        want = model(docs, state, batch)
        got = merged(spark, docs, state, batch)
        assert got[0] == {k: v for k, v in want[0].items() if v}
        assert got[1] == want[1] and got[2] == want[2]
        docs, state = want[0], want[1]


def test_merge_null_mtime_and_empty(spark):
    docs, state, stats = merged(spark, {"h": {"a.pdf"}}, {"a.pdf": ("h", None)}, [("a.pdf", "h", None)])
    assert stats == {"added": 0, "updated": 0, "removed": 0, "duplicates": 0, "skipped": 1}
    assert merged(spark, {}, {}, [])[2] == {"added": 0, "updated": 0, "removed": 0, "duplicates": 0, "skipped": 0}


def test_default_merge_gives_a_path_one_owner(spark):
    p = spark.createDataFrame([("h0", "a.pdf"), ("h1", "b.pdf")], "sha256 string, rel_path string")
    s = spark.createDataFrame([("a.pdf", "h0", 1, 1.0, "old")], schemas.TABLES["scanned_file_in_job"])
    b = spark.createDataFrame([("a.pdf", "h1", 1, 2.0)], "rel_path string, sha256 string, size_bytes bigint, mtime double")
    rows = R.merge_rows(p, s, b)
    assert sorted(map(tuple, R.merge_paths(p, rows).collect())) == [("h1", "a.pdf"), ("h1", "b.pdf")]
    assert sorted(map(tuple, R.merge_paths(p, rows, strict=True).collect())) == [("h0", "a.pdf"), ("h1", "a.pdf"), ("h1", "b.pdf")]


def test_constraints(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert [tuple(r) for r in schemas.duplicate_keys(t, "k").collect()] == [("a", 2)]
    assert schemas.orphans(t, "k", spark.createDataFrame([("b",)], "id string"), "id").count() == 2
    assert schemas.empty_table(spark, "prompts").columns[0] == "id"
    assert set(schemas.UNIQUE) == set(schemas.TABLES) and len(schemas.TABLES) == 13


def test_digital_flag(spark):
    pages = spark.createDataFrame([("a", 0, "x" * 60), ("a", 1, " " + "y" * 40 + " "), ("a", 9, "z" * 500), ("b", 0, None), ("b", 3, "q" * 400)], "k string, page int, text string")
    assert {r.k: r.is_digital for r in R.digital_flag(pages, "k", "page", "text").collect()} == {"a": True, "b": False}


def test_metadata_and_levels(spark):
    raw = spark.createDataFrame([("d", {"title": "", "author": "A", "creationDate": "D:1", "producer": "P", "empty": ""}), ("e", None)], "k string, m map<string,string>")
    got = {r.k: r for r in R.metadata_projection(raw, "k", "m").collect()}
    assert (got["d"].title, got["d"].author, got["d"].created, got["d"].extra) == (None, "A", "D:1", {"producer": "P"})
    assert got["e"].author is None
    m = spark.createDataFrame([("Ignoring x",), ("FONT y",), ("cannot open",)], "m string")
    from pyspark.sql import functions as F

    assert [r[0] for r in m.select(R.message_level(F.col("m"))).collect()] == ["DEBUG", "DEBUG", "WARNING"]
