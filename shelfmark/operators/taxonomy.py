"""The topic tree: nodes, memberships, terms, assignments, and applying reviewed assignments.

Nodes (id, parent_id, name, path, depth), memberships (node_id, sha256), terms (node_id, term) and assignments (node_id,
sha256, assigned_child_id, confidence, status) are tables; every change returns the next version of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators.partitioning import seeded_order
from shelfmark.session import cut_lineage

#: Statuses that a later suggestion must not overwrite.
STICKY = ("applied", "manual_touched")


def children(nodes: DataFrame, parent_id: int | None = None) -> DataFrame:
    """Roots, or the children of a node."""
    return nodes.filter(F.col("parent_id").isNull() if parent_id is None else F.col("parent_id") == parent_id)


def lookup(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path") == path)


def descendants(nodes: DataFrame, path: str) -> DataFrame:
    """All nodes below a path; the materialised path makes this a filter that reaches the scan."""
    return nodes.filter(F.col("path").startswith(path + "/"))


def descendants_by_parent(nodes: DataFrame, node_id: int, most: int = 100) -> DataFrame:
    """All nodes below a node by parent links alone, level by level, for trees whose paths aren't trusted."""
    spark = nodes.sparkSession
    nodes.createOrReplaceTempView("_tree_nodes")
    return spark.sql(f"WITH RECURSIVE below(id, level) MAX RECURSION LEVEL {int(most)} AS (SELECT id, 1 FROM _tree_nodes WHERE parent_id = {int(node_id)} UNION ALL SELECT n.id, b.level + 1 FROM _tree_nodes n JOIN below b ON n.parent_id = b.id) SELECT id FROM below")


def chain(paths: DataFrame, path: str) -> DataFrame:
    """(path, name, parent_path, depth) of every node that the given paths need, root first."""
    all_paths = paths.filter(F.col(path).isNotNull() & (F.col(path) != "")).select(F.explode(X.path_prefixes(F.col(path))).alias("path")).distinct()
    parent = F.nullif(X.parent_path(F.col("path")), F.lit(""))
    return all_paths.select("path", X.basename(F.col("path")).alias("name"), parent.alias("parent_path"), (F.size(F.split("path", "/")) - 1).cast("int").alias("depth"))


def stats(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(id, path, depth, documents) with direct members only; empty nodes have 0.  Members are counted before the join."""
    counts = members.groupBy(F.col("node_id").alias("id")).agg(F.count("sha256").alias("documents"))
    return nodes.join(counts, "id", "left").select("id", "path", "depth", F.coalesce("documents", F.lit(0)).alias("documents"))


def first_paths(paths: DataFrame) -> DataFrame:
    return paths.groupBy("sha256").agg(F.min("rel_path").alias("path"))


def node_documents(nodes: DataFrame, members: DataFrame, paths: DataFrame) -> DataFrame:
    """(node_path, sha256, path): members with their node and smallest path."""
    n = nodes.select(F.col("id").alias("node_id"), F.col("path").alias("node_path"))
    return members.join(n, "node_id").join(first_paths(paths), "sha256", "left").select("node_path", "sha256", "path")


def node_terms(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.join(nodes.select(F.col("id").alias("node_id"), F.col("path").alias("node_path")), "node_id").select("node_path", "term")


def assignment_views(nodes: DataFrame, assignments: DataFrame, paths: DataFrame, status: str | None = None) -> DataFrame:
    """(node_path, child_path, sha256, path, confidence, status) for review."""
    rows = assignments if status is None else assignments.filter(F.col("status") == status)
    n = nodes.select(F.col("id").alias("node_id"), F.col("path").alias("node_path"))
    c = nodes.select(F.col("id").alias("assigned_child_id"), F.col("path").alias("child_path"))
    return rows.join(n, "node_id").join(c, "assigned_child_id", "left").join(first_paths(paths), "sha256", "left").select("node_path", "child_path", "sha256", "path", "confidence", "status")


def child_options(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(parent_id, id, name, terms): children with their sorted terms, as a request to assign offers them."""
    t = terms.groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    kids = nodes.filter("parent_id is not null").join(t, "id", "left")
    return kids.select("parent_id", "id", "name", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def add_members(members: DataFrame, requested: DataFrame, documents: DataFrame) -> DataFrame:
    """Memberships with the requested (node_id, sha256) of known documents added."""
    wanted = requested.select("node_id", "sha256").join(documents.select("sha256"), "sha256", "left_semi").select("node_id", "sha256")
    return members.select("node_id", "sha256").unionByName(wanted).distinct()


def replace_members(members: DataFrame, node_id: int, requested: DataFrame, documents: DataFrame) -> DataFrame:
    """Memberships in which a node has exactly the requested known documents."""
    wanted = requested.select("sha256").join(documents.select("sha256"), "sha256", "left_semi").distinct().select(F.lit(node_id).cast("bigint").alias("node_id"), "sha256")
    return members.filter(F.col("node_id") != node_id).select("node_id", "sha256").unionByName(wanted)


def sync_root(members: DataFrame, root_id: int, documents: DataFrame) -> DataFrame:
    """Memberships in which the root has every document."""
    return replace_members(members, root_id, documents, documents)


def replace_terms(terms: DataFrame, node_id: int, new: list[str]) -> DataFrame:
    """Terms in which a node has exactly the new ones, trimmed, non-blank and distinct."""
    own = terms.sparkSession.createDataFrame([(new,)], "t array<string>").select(F.explode(X.clean_terms(F.col("t"))).alias("term"))
    return terms.filter(F.col("node_id") != node_id).select("node_id", "term").unionByName(own.select(F.lit(node_id).cast("bigint").alias("node_id"), "term"))


def delete_subtree(nodes: DataFrame, members: DataFrame, terms: DataFrame, assignments: DataFrame, path: str) -> dict[str, DataFrame]:
    """The four tables without the nodes below ``path``, what hangs on them, and assignments that point to them."""
    gone = descendants(nodes, path).select("id")
    by = lambda df, c: df.join(gone.select(F.col("id").alias(c)), c, "left_anti").select(*df.columns)
    return {"nodes": by(nodes, "id"), "members": by(members, "node_id"), "terms": by(terms, "node_id"), "assignments": by(by(assignments, "node_id"), "assigned_child_id")}


def upsert_assignments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assignments with new ones put in; those already applied or touched by hand stay as they are."""
    key = ["node_id", "sha256"]
    fixed = old.filter(F.col("status").isin(*STICKY))
    allowed = new.join(fixed.select(*key), key, "left_anti").select(*old.columns)
    return old.join(allowed.select(*key), key, "left_anti").select(*old.columns).unionByName(allowed)


def resolve_children(responses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, sha256, label, child_id, problem): answers whose label isn't a child's name have a problem."""
    kids = nodes.select(F.col("parent_id").alias("node_id"), F.col("name").alias("label"), F.col("id").alias("child_id"))
    problem = F.when(F.col("label").isNotNull() & F.col("child_id").isNull(), "unknown child")
    return responses.join(kids, ["node_id", "label"], "left").select("node_id", "sha256", "label", "child_id", problem.alias("problem"))


def classify(assignments: DataFrame, paths: DataFrame, minimum: str = "medium", keywords: list[str] | None = None, node_id: int | None = None) -> DataFrame:
    """Assignments (of one node, or of all) with ``outcome``: applied, excluded (a path holds a keyword) or skipped.

    Only pending ones with a child and enough confidence can be applied.
    """
    assignments = assignments if node_id is None else assignments.filter(F.col("node_id") == node_id)
    rank = {"low": 0, "medium": 1, "high": 2}[minimum]
    hit = paths.filter(X.contains_any(F.col("rel_path"), keywords or [])).select("sha256", F.lit(True).alias("_hit")).distinct()
    ready = (F.col("status") == "pending") & F.col("assigned_child_id").isNotNull() & (X.confidence_rank(F.col("confidence")) >= rank)
    rows = assignments.join(hit, "sha256", "left")
    return rows.withColumn("outcome", F.when(~ready, "skipped").when(F.col("_hit"), "excluded").otherwise("applied")).select(*assignments.columns, "outcome")


def apply_members(members: DataFrame, classified: DataFrame) -> DataFrame:
    """Memberships after applied documents have moved from their node to the assigned child."""
    done = classified.filter("outcome = 'applied'")
    kept = members.select("node_id", "sha256").join(done.select("node_id", "sha256"), ["node_id", "sha256"], "left_anti")
    return kept.unionByName(done.select(F.col("assigned_child_id").alias("node_id"), "sha256")).distinct()


def apply_statuses(assignments: DataFrame, classified: DataFrame, at: str | None = None) -> DataFrame:
    """Assignments in which those that were applied say so, with the time ``at`` of the change, so that none is applied twice."""
    done = classified.filter("outcome = 'applied'").select("node_id", "sha256", F.lit(True).alias("_done"))
    rows = assignments.join(done, ["node_id", "sha256"], "left")
    now = {"status": F.lit("applied")} | ({} if at is None else {"updated_at": F.lit(at).cast("timestamp_ntz")})
    return rows.select(*[F.when(F.col("_done"), now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in assignments.columns])


def apply_summary(classified: DataFrame) -> DataFrame:
    return classified.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "excluded", "skipped")])


def partition_children(nodes: DataFrame, parent_path: str, names: list[str]) -> DataFrame:
    """Nodes in which the parent's subtree is replaced by children of the given names.

    Ids follow the greatest id there is, in the order of the names; blank and repeated names are left out.
    """
    fresh = list(dict.fromkeys(n.strip() for n in names if n.strip()))
    kept = nodes.join(descendants(nodes, parent_path).select("id"), "id", "left_anti").select(*nodes.columns)
    new = nodes.sparkSession.createDataFrame(list(enumerate(fresh, 1)), "_i bigint, _name string")
    top = nodes.agg(F.max("id").alias("_max"), F.max(F.when(F.col("path") == parent_path, F.struct("id", "depth"))).alias("_parent"))  # one row
    row = new.join(F.broadcast(top), F.lit(True))
    made = row.select((F.col("_max") + F.col("_i")).cast("bigint").alias("id"), F.col("_parent.id").alias("parent_id"), F.col("_name").alias("name"), F.concat(F.lit(parent_path + "/"), F.col("_name")).alias("path"), (F.col("_parent.depth") + 1).cast("int").alias("depth"))
    return kept.unionByName(made)


def replace_children(nodes: DataFrame, members: DataFrame, terms: DataFrame, assignments: DataFrame, parent_path: str, names: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The four tables in which a node's subtree is replaced by children with these terms (name -> terms).

    Members, terms and assignments of the old subtree go with it; each new child has its terms, trimmed, non-blank and distinct.
    """
    left = delete_subtree(nodes, members, terms, assignments, parent_path)
    made = partition_children(nodes, parent_path, list(names))
    spark = nodes.sparkSession
    given = spark.createDataFrame([(f"{parent_path}/{n.strip()}", list(t)) for n, t in names.items() if n.strip()], "path string, t array<string>")
    fresh = given.join(made.select("path", F.col("id").alias("node_id")), "path").select("node_id", F.explode(X.clean_terms(F.col("t"))).alias("term")).distinct()
    return {"nodes": made, "members": left["members"], "terms": left["terms"].select("node_id", "term").unionByName(fresh), "assignments": left["assignments"]}


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Memberships without the given (node_id, sha256)."""
    return members.select("node_id", "sha256").join(gone.select("node_id", "sha256"), ["node_id", "sha256"], "left_anti")


def mark_touched(assignments: DataFrame, documents: DataFrame) -> DataFrame:
    """Assignments in which all of the given documents are marked as touched by hand."""
    hit = documents.select("sha256", F.lit(True).alias("_hit")).distinct()
    rows = assignments.join(hit, "sha256", "left")
    return rows.select(*[F.when(F.col("_hit"), "manual_touched").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in assignments.columns])


def rename_node(nodes: DataFrame, path: str, name: str) -> DataFrame:
    """Nodes with one of another name, and the paths of all below it after it."""
    new = "/".join([*path.split("/")[:-1], name])
    moved = F.concat(F.lit(new), F.substr(F.col("path"), F.lit(len(path) + 1)))
    under = (F.col("path") == path) | F.col("path").startswith(path + "/")
    return nodes.select(*[F.when(under, moved).otherwise(F.col("path")).alias("path") if c == "path" else F.when(F.col("path") == path, name).otherwise(F.col("name")).alias("name") if c == "name" else F.col(c) for c in nodes.columns])


def delete_node(nodes: DataFrame, members: DataFrame, terms: DataFrame, assignments: DataFrame, path: str) -> dict[str, DataFrame]:
    """The four tables without a node, all below it, and what hangs on them."""
    left = delete_subtree(nodes, members, terms, assignments, path)
    gone = lookup(nodes, path).select("id")
    by = lambda df, c: df.join(gone.select(F.col("id").alias(c)), c, "left_anti").select(*df.columns)
    return {"nodes": by(left["nodes"], "id"), "members": by(left["members"], "node_id"), "terms": by(left["terms"], "node_id"), "assignments": by(by(left["assignments"], "node_id"), "assigned_child_id")}


def ensure_nodes(nodes: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """Nodes with those that the paths in ``wanted`` still need; ids follow the greatest there is, in order of the hash of the path.

    Ranks come from counts per part of the hash and small windows within, so that no task holds all new nodes.
    """
    fresh = cut_lineage(chain(wanted, path).join(nodes.select("path"), "path", "left_anti"))
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))  # one row
    ranked = fresh.join(seeded_order(fresh, "path", "node"), "path").join(F.broadcast(top), F.lit(True))
    made = ranked.select((F.col("_max") + F.col("rank")).cast("bigint").alias("id"), "parent_path", "name", "path", "depth")
    ids = nodes.select("id", "path").unionByName(made.select("id", "path")).select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path"))
    return nodes.unionByName(made.join(ids, "parent_path", "left").select("id", "parent_id", "name", "path", "depth"))
