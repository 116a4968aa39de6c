"""Effects of file events against a model that plays them one by one; the stream; the versions of tables."""

import json
import random

import pytest

from shelfmark.operators import effects as E
from shelfmark.sources.store import Conflict, Store
from shelfmark.streaming import watch as W

DOC = "sha256 string, file_name string, md5 string"
PATH = "sha256 string, rel_path string"
STATE = "rel_path string, sha256 string, size_bytes bigint, mtime double, last_scanned_job string"
NODE = "id bigint, parent_id bigint, name string, path string, depth int"
MEMBER = "node_id bigint, sha256 string"
ASSIGN = "node_id bigint, sha256 string, assigned_child_id bigint, confidence string, status string"
OPS = "event_id bigint, operation string, path string, dest string"


class Model:
    """Plays events one after another on plain Python state."""

    def __init__(self, docs, paths, state, members, assignments, content):
        self.docs, self.paths, self.state, self.content = dict(docs), dict(paths), dict(state), content
        self.members, self.assignments, self.nodes = set(members), dict(assignments), {"Root", "Root/a"}

    @staticmethod
    def node(path):
        return path.rsplit("/", 1)[0] if path.startswith("Root/") else None

    def ensure(self, node):
        parts = node.split("/")
        self.nodes |= {"/".join(parts[: i + 1]) for i in range(len(parts))}

    def discovered(self, path):
        sha = self.content.get(path)
        if sha is None:
            return
        self.docs[sha] = path.rsplit("/", 1)[-1]
        self.paths.setdefault(path, sha)
        for node in ("Root", self.node(path)):
            if node:
                self.ensure(node)
                self.members.add((node, sha))

    def moved(self, old, new):
        sha = self.paths.get(old)
        if sha is None or self.paths.get(new, sha) != sha:
            return self.discovered(new)
        if old == new:
            return None
        del self.paths[old]
        if new not in self.paths:
            self.paths[new] = sha
            self.docs[sha] = new.rsplit("/", 1)[-1]
            if old in self.state:
                self.state[new] = self.state.pop(old)
        if self.node(old) or self.node(new):
            self.members.discard((self.node(old), sha))
            if sha in self.assignments:
                self.assignments[sha] = "manual_touched"
            if self.node(new):
                self.ensure(self.node(new))
                self.members.add((self.node(new), sha))
        return None

    def missing(self, path):
        sha = self.paths.pop(path, None)
        if sha is None:
            return
        self.state.pop(path, None)
        self.members.discard((self.node(path), sha))
        if sha not in self.paths.values():
            self.members.discard(("Root", sha))

    def play(self, operation, path, dest):
        if operation == "path_changed":
            operation = "path_discovered" if path not in self.paths else ""
        getattr(self, {"path_discovered": "discovered", "path_missing": "missing"}.get(operation, "_none"), self._none)(path) if operation != "path_moved" else self.moved(path, dest)

    def _none(self, path):
        pass


def start(spark, docs, paths, state, members, assignments):
    ids = {"Root": 1, "Root/a": 2}
    return {
        "documents": spark.createDataFrame([(s, n, "m") for s, n in docs.items()], DOC), "paths": spark.createDataFrame([(s, p) for p, s in paths.items()], PATH),
        "state": spark.createDataFrame([(p, s, 1, 1.0, "j") for p, s in state.items()], STATE), "nodes": spark.createDataFrame([(1, None, "Root", "Root", 0), (2, 1, "a", "Root/a", 1)], NODE),
        "members": spark.createDataFrame([(ids[n], s) for n, s in members], MEMBER), "assignments": spark.createDataFrame([(1, s, 2, "high", v) for s, v in assignments.items()], ASSIGN),
    }


def read(after):
    ids = {r.id: r.path for r in after["nodes"].collect()}
    assert len(set(ids.values())) == len(ids)
    return {
        "docs": {r.sha256: r.file_name for r in after["documents"].collect()}, "paths": {r.rel_path: r.sha256 for r in after["paths"].collect()}, "state": {r.rel_path: r.sha256 for r in after["state"].collect()},
        "members": {(ids[r.node_id], r.sha256) for r in after["members"].collect()}, "assignments": {r.sha256: r.status for r in after["assignments"].collect()}, "nodes": set(ids.values()),
    }


def same(after, model):
    got = read(after)
    for part in got:
        assert got[part] == getattr(model, part), part


FILES = ["Root/a/1.pdf", "Root/a/2.pdf", "Root/b/1.pdf", "Root/3.pdf", "out/1.pdf", "out/x/2.pdf"]


@pytest.mark.parametrize("seed", range(8))
def test_against_playing_one_by_one(spark, seed):
    r = random.Random(seed)
    docs = {"s1": "1.pdf", "s2": "2.pdf", "s3": "zero.pdf"}
    paths = {"Root/a/1.pdf": "s1", "Root/b/1.pdf": "s1", "out/x/2.pdf": "s2"}
    state = {"Root/a/1.pdf": "s1", "out/x/2.pdf": "s2"}
    members, assignments = {("Root", "s1"), ("Root/a", "s1"), ("Root", "s2")}, {"s1": "pending", "s2": "applied"}
    content = {p: r.choice(["s1", "s2", "s4", "s5", None]) for p in FILES}
    content = {p: s for p, s in content.items() if s}
    ops = []
    for i in range(r.randrange(1, 16)):
        kind = r.choice(["path_discovered", "path_missing", "path_moved", "path_moved", "path_changed"])
        ops.append((i, kind, r.choice(FILES), r.choice(FILES) if kind == "path_moved" else None))
    model = Model(docs, paths, state, members, assignments, content)
    for _, *op in ops:
        model.play(*op)
    held = spark.createDataFrame([(p, s, "read") for p, s in content.items()], "rel_path string, sha256 string, md5 string")
    after = E.apply(start(spark, docs, paths, state, members, assignments), spark.createDataFrame(r.sample(ops, len(ops)), OPS), held)
    same(after, model)
    assert {x.sha256: x.md5 for x in after["documents"].collect()} == {s: "m" if s in docs else "read" for s in model.docs}


def test_no_events_and_a_long_chain_of_moves(spark):
    tables = start(spark, {"s": "0.pdf"}, {"Root/a/0.pdf": "s"}, {"Root/a/0.pdf": "s"}, {("Root", "s"), ("Root/a", "s")}, {"s": "pending"})
    none = spark.createDataFrame([], "rel_path string, sha256 string")
    before = read(tables)
    assert read(E.apply(tables, spark.createDataFrame([], OPS), none)) == before
    ops = [(i, "path_moved", f"Root/a/{i}.pdf", f"Root/a/{i + 1}.pdf") for i in range(40)]
    got = read(E.apply(tables, spark.createDataFrame(ops, OPS), none))
    assert got["paths"] == got["state"] == {"Root/a/40.pdf": "s"} and got["docs"] == {"s": "40.pdf"} and got["assignments"] == {"s": "manual_touched"}


def test_reconcile(spark):
    tables = start(spark, {"s": "1.pdf"}, {"out/1.pdf": "s"}, {"out/1.pdf": "s"}, {("Root", "s")}, {})
    plan = spark.createDataFrame([("out/1.pdf", "remove"), ("Root/a/n.pdf", "discover"), ("Root/a/broken.pdf", "discover")], "rel_path string, action string")
    after, failed = E.reconcile(tables, plan, spark.createDataFrame([("Root/a/n.pdf", "t")], "rel_path string, sha256 string"))
    got = read(after)
    assert got["paths"] == {"Root/a/n.pdf": "t"} and got["state"] == {} and got["members"] == {("Root", "t"), ("Root/a", "t")}
    assert [r.rel_path for r in failed.collect()] == ["Root/a/broken.pdf"]


def test_stream_commits_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "registry"))
    assert store.current() == (0, {}) and store.read("documents").count() == 0
    incoming = tmp_path / "events"
    incoming.mkdir()
    files = {"Root/a/1.pdf": "s1", "Root/b/1.pdf": "s1"}

    def act(*events):
        (incoming / f"{events[0]['event_id']}.json").write_text("\n".join(map(json.dumps, events)))
        held = spark.createDataFrame(list(files.items()), "rel_path string, sha256 string")
        W.watch(spark, str(incoming), "/data", store, lambda asked: held.join(asked, "rel_path", "left_semi"), str(tmp_path / "checkpoint")).awaitTermination()

    event = lambda i, kind, src, dest=None: {"event_id": i, "kind": kind, "is_directory": False, "src_path": f"/data/{src}", "dest_path": dest and f"/data/{dest}"}
    act(event(1, "created", "Root/a/1.pdf"), event(2, "created", "Root/a/no.txt"))
    assert store.current()[0] == 1 and [r.file_name for r in store.read("documents").collect()] == ["1.pdf"]
    act(event(3, "moved", "Root/a/1.pdf", "Root/b/1.pdf"))
    nodes = {r.id: r.path for r in store.read("taxonomy_nodes").collect()}
    assert {nodes[r.node_id] for r in store.read("taxonomy_node_documents").collect()} == {"Root", "Root/b"}
    act(event(4, "deleted", "Root/b/1.pdf"))
    assert store.read("document_paths").count() == 0 and store.read("taxonomy_node_documents").count() == 0 and store.current()[0] == 3


def test_two_writers_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([("r", "t")], PATH)
    assert store.commit({"document_paths": df}) == 1

    class Late(Store):
        def current(self):
            return 0, {}

    with pytest.raises(Conflict):
        Late(spark, str(tmp_path)).commit({"document_paths": df})
    assert store.current()[0] == 1


def test_running_progress(spark, tmp_path):
    lines = [(i, json.dumps({"msg": m, "path": f"p{i}"}) if m else "no json") for i, m in enumerate(["processed", "", "other", "skipping file due to error", "processed"] * 20)]
    got = W.running_progress(spark.createDataFrame(lines, "n bigint, value string"), "n", parts=7).orderBy("n").collect()
    assert [r.attempts for r in got] == list(range(1, 61)) and got[1].path == "p3"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("\n".join(x for _, x in lines))
    W.watch_progress(spark, str(tmp_path / "log"), "progress_so_far").awaitTermination()
    assert spark.table("progress_so_far").first().attempts == 60
    assert W.running_progress(spark.createDataFrame([], "n bigint, value string"), "n").count() == 0
