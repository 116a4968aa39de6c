"""What file events do to the registry: documents, paths, scan state, topic tree, memberships and assignments.

Events act one after another, but only those that touch the same paths depend on each other.  Moves tie paths together; the
paths so tied form a component (``components``), and each component's events are played in their order by one task (``resolve``), from the
owners that its paths have.  All that follows from the resolved effects is found by aggregation, the last effect by event id winning.

Defined results: an event without a readable file behind it (no row in ``content``) discovers nothing; a path that another document owns
isn't taken from it; events of equal id are played in the order of their paths; no events change nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import taxonomy as T
from shelfmark.session import cut_lineage

#: Events that one call plays, on average.
PLAYED = 20_000
EFFECTS = "event_id bigint, effect string, path string, dest string, sha256 string"


def components(operations: DataFrame) -> DataFrame:
    """(rel_path, component): paths that moves tie together, named after the least; paths without moves aren't listed."""
    moves = operations.filter("operation = 'path_moved' and path <> dest").select(F.col("path").alias("a"), F.col("dest").alias("b")).distinct()
    both = cut_lineage(moves.unionByName(moves.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.select(F.col("a").alias("rel_path")).distinct().withColumn("component", F.col("rel_path")))
    while True:
        near = both.join(label.select(F.col("rel_path").alias("b"), "component"), "b").groupBy(F.col("a").alias("rel_path")).agg(F.min("component").alias("_near"))
        step = label.join(near, "rel_path").select("rel_path", F.least("component", "_near").alias("component"), F.col("component").alias("_before"))
        # labels are followed to the label of their own path, which halves the way that is left
        jump = step.join(step.select(F.col("rel_path").alias("component"), F.col("component").alias("_next")), "component").select("rel_path", F.least("component", "_next").alias("component"), "_before")
        label = cut_lineage(jump)
        if not label.filter("component <> _before").limit(1).count():
            return label.select("rel_path", "component")
        label = label.drop("_before")


def _play(rows: pd.DataFrame) -> pd.DataFrame:
    """The effects of the events of whole components, then where each path's owner and scan state are in the end."""
    owner: dict[str, str | None] = {}
    content: dict[str, str | None] = {}
    scan: dict[str, str] = {}
    out: list[tuple] = []

    def discover(event: int, path: str) -> None:
        if (sha := content[path]) is not None:
            if owner[path] is None:
                owner[path] = sha
            out.append((event, "discovered", path, None, sha))

    rows = rows.astype(object).where(rows.notna(), None).sort_values(["event_id", "path"], kind="stable")
    for r in rows.itertuples(index=False):
        for path, own, holds in ((r.path, r.path_owner, r.path_holds), (r.dest, r.dest_owner, r.dest_holds)):
            if path is not None and path not in owner:
                owner[path], content[path], scan[path] = own, holds, path
    where = {p: p for p in scan}  # path -> the path whose scan row it has
    for r in rows.itertuples(index=False):
        event, path, dest = int(r.event_id), r.path, r.dest
        sha = owner[path]
        if r.operation == "path_discovered" or r.operation == "path_changed" and sha is None:
            discover(event, path)
        elif r.operation == "path_missing" and sha is not None:
            owner[path] = None
            where.pop(path, None)
            out.append((event, "deleted", path, None, sha))
        elif r.operation == "path_moved":
            if sha is None or owner[dest] is not None and owner[dest] != sha:
                discover(event, dest)
            elif path == dest:
                pass
            elif owner[dest] == sha:
                owner[path] = None
                out.append((event, "dropped", path, dest, sha))
            else:
                owner[dest], owner[path] = sha, None
                if path in where:
                    where[dest] = where.pop(path)
                out.append((event, "renamed", path, dest, sha))
    out += [(0, "owns", p, None, sha) for p, sha in sorted(owner.items())]
    now = {o: p for p, o in where.items()}
    out += [(0, "scan", p, now.get(p), None) for p in sorted(scan)]
    return pd.DataFrame(out, columns=["event_id", "effect", "path", "dest", "sha256"])


def resolve(paths: DataFrame, operations: DataFrame, content: DataFrame) -> DataFrame:
    """(event_id, effect, path, dest, sha256): what each operation (event_id, operation, path, dest) does.

    Effects: ``discovered``, ``renamed``, ``dropped`` (the destination was the document's already) and ``deleted``; besides these a row ``owns``
    for each path touched, with its owner in the end, and a row ``scan``, with the path that its scan row has in the end.
    ``content``: (rel_path, sha256) of the files that can be read.
    """
    tied = components(operations)
    owners = paths.groupBy("rel_path").agg(F.min("sha256").alias("owner"))
    holds = content.groupBy("rel_path").agg(F.min("sha256").alias("holds"))
    rows = operations.select("event_id", "operation", "path", "dest").join(tied.withColumnRenamed("rel_path", "path"), "path", "left").withColumn("component", F.coalesce("component", "path"))
    for side in ("path", "dest"):
        for table, column in ((owners, "owner"), (holds, "holds")):
            rows = rows.join(table.select(F.col("rel_path").alias(side), F.col(column).alias(f"{side}_{column}")), side, "left")
    # components don't touch each other's paths, so that many are played together at no more cost than one
    parts = max(1, -(-operations.count() // PLAYED))
    return rows.groupBy(F.pmod(F.xxhash64("component"), F.lit(parts)).alias("part")).applyInPandas(lambda group: _play(group), EFFECTS)


def _node(path, root: str):
    """The tree's path of a file's folder, null outside the tree's root folder."""
    return F.when(path.startswith(root + "/"), X.parent_path(path))


def apply(tables: dict[str, DataFrame], operations: DataFrame, content: DataFrame, root: str = "Root") -> dict[str, DataFrame]:
    """The next documents, paths, state, nodes, members and assignments after the operations.

    ``content``: (rel_path, sha256) of readable files, with any other columns of documents, which new ones take.
    """
    effects = cut_lineage(resolve(tables["paths"], operations, content))
    acts = effects.filter(F.col("effect").isin("discovered", "renamed", "dropped", "deleted"))
    owns = effects.filter("effect = 'owns'")
    out = {"paths": tables["paths"].select("sha256", "rel_path").join(owns.select(F.col("path").alias("rel_path")), "rel_path", "left_anti").select("sha256", "rel_path").unionByName(owns.filter("sha256 is not null").select("sha256", F.col("path").alias("rel_path")))}

    scans = effects.filter("effect = 'scan'").select(F.col("path").alias("rel_path"), F.col("dest").alias("_now"), F.lit(True).alias("_touched"))
    state = tables["state"]
    kept = state.join(scans, "rel_path", "left").filter("_touched is null or _now is not null")
    kept = kept.select(*[F.coalesce("_now", "rel_path").alias("rel_path") if c == "rel_path" else F.col(c) for c in state.columns], F.col("_now").isNotNull().alias("_moved"))
    # a row that was moved to a path wins over one that lay there
    out["state"] = kept.groupBy("rel_path").agg(F.max_by(F.struct(*[c for c in state.columns if c != "rel_path"]), "_moved").alias("_r")).select(*[F.col("rel_path") if c == "rel_path" else F.col(f"_r.{c}").alias(c) for c in state.columns])

    named = acts.filter("effect in ('discovered', 'renamed')").select("sha256", "event_id", "path", F.coalesce("dest", "path").alias("_at"), (F.col("effect") == "discovered").alias("_seen"))
    last = named.groupBy("sha256").agg(X.basename(F.max_by("_at", F.struct("event_id", "_at"))).alias("_name"), F.max_by("path", F.struct("_seen", "event_id", "path")).alias("_path"), F.max("_seen").alias("_seen"))
    documents = tables["documents"]
    old = documents.join(last.select("sha256", "_name"), "sha256", "left").select(*[F.coalesce("_name", "file_name").alias("file_name") if c == "file_name" else F.col(c) for c in documents.columns])
    extra = [c for c in content.columns if c in documents.columns and c not in ("sha256", "file_name")]
    records = content.groupBy("rel_path").agg(F.min(F.struct("sha256", *extra)).alias("_r")) if extra else content.groupBy("rel_path").agg(F.min(F.struct("sha256")).alias("_r"))
    fresh = last.filter("_seen").join(documents.select("sha256"), "sha256", "left_anti").join(records.select(F.col("rel_path").alias("_path"), "_r"), "_path")
    given = {"sha256": F.col("sha256"), "file_name": F.col("_name")} | {c: F.col(f"_r.{c}") for c in extra}
    out["documents"] = old.unionByName(fresh.select(*[given.get(c, F.lit(None)).cast(documents.schema[c].dataType).alias(c) for c in documents.columns]))

    put = F.array_compact(F.array(
        F.when(F.col("effect") == "discovered", F.struct(F.lit(root).alias("node"), F.lit(True).alias("there"))),
        F.when(F.col("effect") == "discovered", F.struct(_node(F.col("path"), root).alias("node"), F.lit(True).alias("there"))),
        F.when(F.col("effect") != "discovered", F.struct(_node(F.col("path"), root).alias("node"), F.lit(False).alias("there"))),
        F.when(F.col("effect").isin("renamed", "dropped"), F.struct(_node(F.col("dest"), root).alias("node"), F.lit(True).alias("there"))),
    ))
    moves = cut_lineage(acts.select("event_id", "sha256", F.inline(put)).filter("node is not null").groupBy("node", "sha256").agg(F.max_by("there", F.struct("event_id", "there")).alias("there")))
    found = acts.filter("effect = 'discovered'").limit(1)
    wanted = moves.filter("there").select("node").unionByName(found.select(F.lit(root).alias("node")))
    out["nodes"] = cut_lineage(T.ensure_nodes(tables["nodes"], wanted, "node"))
    ids = out["nodes"].select(F.col("path").alias("node"), F.col("id").alias("node_id"))
    moves = moves.join(ids, "node")
    lost = acts.filter("effect = 'deleted'").select("sha256").distinct().join(out["paths"].select("sha256"), "sha256", "left_anti").join(ids.filter(F.col("node") == root).select("node_id"), F.lit(True))  # the root is one row
    members = tables["members"].select("node_id", "sha256")
    both = members.join(moves.select("node_id", "sha256"), ["node_id", "sha256"], "left_anti").unionByName(moves.filter("there").select("node_id", "sha256")).distinct()
    out["members"] = both.join(lost.select("node_id", "sha256"), ["node_id", "sha256"], "left_anti").select("node_id", "sha256")

    touched = acts.filter("effect in ('renamed', 'dropped')").filter(F.col("path").startswith(root + "/") | F.col("dest").startswith(root + "/"))
    out["assignments"] = T.mark_touched(tables["assignments"], touched)
    return out


def reconcile(tables: dict[str, DataFrame], plan: DataFrame, content: DataFrame, root: str = "Root") -> tuple[dict[str, DataFrame], DataFrame]:
    """(next tables, failures): a plan (rel_path, action) carried out; a path to discover that can't be read is a failure and stops no other."""
    operations = plan.select(F.xxhash64("rel_path").alias("event_id"), F.when(F.col("action") == "remove", "path_missing").otherwise("path_discovered").alias("operation"), F.col("rel_path").alias("path"), F.lit(None).cast("string").alias("dest"))
    failed = plan.filter("action = 'discover'").join(content.select("rel_path"), "rel_path", "left_anti").select("rel_path", F.lit("unreadable").alias("problem"))
    return apply(tables, operations, content, root), failed
