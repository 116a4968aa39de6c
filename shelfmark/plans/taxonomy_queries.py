"""Queries of the topic tree and of partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import partitioning as B
from shelfmark.operators import taxonomy as T
from shelfmark.plans import views as V
from shelfmark.plans.catalog import Catalog
from shelfmark.session import read_table

catalog = Catalog()
query = catalog.query
PARENT, SEED, CHUNK = "Root/EUROPE", "seed-1", 50
NEW_CHILDREN = ["Coasts", " Rivers ", "Coasts", "", "Lakes"]
TERMS = [" tide", "tide", "", "salt ", "gauge"]


@query("node_lookup", f"SELECT id, parent_id, name, depth FROM v_nodes WHERE path = '{PARENT}'")
def node_lookup(spark, base):
    return T.lookup(V.nodes(spark, base), PARENT).select("id", "parent_id", "name", "depth")


@query("node_children", "SELECT id, name, path FROM v_nodes WHERE parent_id = 1 UNION ALL SELECT id, name, path FROM v_nodes WHERE parent_id IS NULL")
def node_children(spark, base):
    n = V.nodes(spark, base)
    return T.children(n, 1).unionByName(T.children(n)).select("id", "name", "path")


@query("node_descendants", f"SELECT id, path FROM v_nodes WHERE path LIKE '{PARENT}/%'")
def node_descendants(spark, base):
    return T.descendants(V.nodes(spark, base), PARENT).select("id", "path")


@query("node_descendants_by_parent", "WITH RECURSIVE below AS (SELECT id FROM v_nodes WHERE parent_id = 1 UNION ALL SELECT n.id FROM v_nodes n JOIN below b ON n.parent_id = b.id) SELECT id FROM below")
def node_descendants_by_parent(spark, base):
    return T.descendants_by_parent(V.nodes(spark, base), 1)


_PREFIXES = "SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT string_split(regexp_replace(rel_path, '/[^/]*$', ''), '/') AS parts FROM document_paths WHERE contains(rel_path, '/')))"


@query("node_chain", f"SELECT path, regexp_extract(path, '[^/]*$') AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent_path, (len(string_split(path, '/')) - 1)::INT AS depth FROM ({_PREFIXES})")
def node_chain(spark, base):
    from shelfmark.functions.text import parent_path

    dirs = read_table(spark, base, "document_paths").select(parent_path(F.col("rel_path")).alias("dir"))
    return T.chain(dirs, "dir")


@query("node_stats", "SELECT n.id, n.path, n.depth, count(m.sha256) AS documents FROM v_nodes n LEFT JOIN v_members m ON m.node_id = n.id GROUP BY ALL")
def node_stats(spark, base):
    return T.stats(V.nodes(spark, base), V.members(spark, base))


@query("node_terms", "SELECT n.path AS node_path, t.term FROM v_terms t JOIN v_nodes n ON n.id = t.node_id")
def node_terms(spark, base):
    return T.node_terms(V.nodes(spark, base), V.terms(spark, base))


_FIRST = "(SELECT sha256, min(rel_path) AS path FROM v_cpaths GROUP BY 1)"


@query("node_documents", f"SELECT n.path AS node_path, m.sha256, p.path FROM v_members m JOIN v_nodes n ON n.id = m.node_id LEFT JOIN {_FIRST} p ON p.sha256 = m.sha256")
def node_documents(spark, base):
    return T.node_documents(V.nodes(spark, base), V.members(spark, base), V.customer_paths(spark, base))


@query("assignment_views", f"SELECT n.path AS node_path, c.path AS child_path, a.sha256, p.path, a.confidence, a.status FROM v_assign a JOIN v_nodes n ON n.id = a.node_id LEFT JOIN v_nodes c ON c.id = a.assigned_child_id LEFT JOIN {_FIRST} p ON p.sha256 = a.sha256 WHERE a.status = 'pending'")
def assignment_views(spark, base):
    return T.assignment_views(V.nodes(spark, base), V.assignments(spark, base), V.customer_paths(spark, base), "pending")


@query("child_options", "SELECT n.parent_id, n.id, n.name, coalesce(t.terms, '') AS terms FROM v_nodes n LEFT JOIN (SELECT node_id, string_agg(term, '|' ORDER BY term) AS terms FROM v_terms GROUP BY 1) t ON t.node_id = n.id WHERE n.parent_id IS NOT NULL")
def child_options(spark, base):
    return T.child_options(V.nodes(spark, base), V.terms(spark, base)).withColumn("terms", F.array_join("terms", "|"))


_WANTED = "SELECT 13::BIGINT AS node_id, sha256(c_name) AS sha256 FROM customer WHERE c_mktsegment = 'MACHINERY'"


def _wanted(spark, base):
    return read_table(spark, base, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.lit(13).cast("bigint").alias("node_id"), F.sha2("c_name", 256).alias("sha256"))


def _known(spark, base):
    return read_table(spark, base, "customer").filter("c_acctbal >= 0").select(F.sha2("c_name", 256).alias("sha256"))


_KNOWN = "SELECT sha256(c_name) FROM customer WHERE c_acctbal >= 0"


@query("membership_add", f"SELECT node_id, sha256 FROM v_members UNION SELECT node_id, sha256 FROM ({_WANTED}) WHERE sha256 IN ({_KNOWN})")
def membership_add(spark, base):
    return T.add_members(V.members(spark, base), _wanted(spark, base), _known(spark, base))


@query("membership_replace", f"SELECT node_id, sha256 FROM v_members WHERE node_id <> 13 UNION SELECT node_id, sha256 FROM ({_WANTED}) WHERE sha256 IN ({_KNOWN})")
def membership_replace(spark, base):
    return T.replace_members(V.members(spark, base), 13, _wanted(spark, base), _known(spark, base))


@query("root_sync", "SELECT node_id, sha256 FROM v_members UNION SELECT 1::BIGINT, sha256 FROM v_docs")
def root_sync(spark, base):
    return T.sync_root(V.members(spark, base), 1, V.documents(spark, base))


@query("topic_terms", "SELECT node_id, term FROM v_terms WHERE node_id <> 106 UNION ALL SELECT 106::BIGINT, unnest(['gauge', 'salt', 'tide'])")
def topic_terms(spark, base):
    return T.replace_terms(V.terms(spark, base), 106, TERMS)


@query("subtree_delete", f"""WITH gone AS (SELECT id FROM v_nodes WHERE path LIKE '{PARENT}/%'), left_ AS (SELECT * FROM v_assign WHERE node_id NOT IN (SELECT id FROM gone) AND (assigned_child_id IS NULL OR assigned_child_id NOT IN (SELECT id FROM gone)))
    SELECT 'nodes' AS name, count(*) AS n FROM v_nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'members', count(*) FROM v_members WHERE node_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'terms', count(*) FROM v_terms WHERE node_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'assignments', count(*) FROM left_""")
def subtree_delete(spark, base):
    left = T.delete_subtree(V.nodes(spark, base), V.members(spark, base), V.terms(spark, base), V.assignments(spark, base), PARENT)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_ANEW = "SELECT node_id, sha256, assigned_child_id, 'high' AS confidence, 'pending' AS status FROM v_assign WHERE confidence IS DISTINCT FROM 'high'"


@query("assignment_upsert", f"SELECT * FROM v_assign WHERE status = 'applied' OR confidence IS NOT DISTINCT FROM 'high' UNION ALL SELECT n.* FROM ({_ANEW}) n JOIN v_assign a ON a.node_id = n.node_id AND a.sha256 = n.sha256 WHERE a.status <> 'applied'")
def assignment_upsert(spark, base):
    old = V.assignments(spark, base)
    new = old.filter(~F.col("confidence").eqNullSafe("high")).withColumn("confidence", F.lit("high")).withColumn("status", F.lit("pending"))
    return T.upsert_assignments(old, new)


_ANSWERS = "SELECT (10 + n_regionkey)::BIGINT AS node_id, sha256, CASE c_custkey % 6 WHEN 0 THEN 'NOWHERE' WHEN 1 THEN NULL ELSE n.n_name END AS label FROM v_customers c JOIN nation n USING (n_regionkey) WHERE n.n_nationkey = c.c_nationkey"


@query("assignment_resolve", f"SELECT a.node_id, a.sha256, a.label, k.id AS child_id, CASE WHEN a.label IS NOT NULL AND k.id IS NULL THEN 'unknown child' END AS problem FROM ({_ANSWERS}) a LEFT JOIN v_nodes k ON k.parent_id = a.node_id AND k.name = a.label")
def assignment_resolve(spark, base):
    nation = read_table(spark, base, "nation")
    c = read_table(spark, base, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 6
    answers = c.select((F.col("n_regionkey") + 10).cast("bigint").alias("node_id"), F.sha2("c_name", 256).alias("sha256"), F.when(k == 0, "NOWHERE").when(k == 1, F.lit(None)).otherwise(F.col("n_name")).alias("label"))
    return T.resolve_children(answers, V.nodes(spark, base))


_OUTCOME = "SELECT a.*, CASE WHEN NOT (status = 'pending' AND assigned_child_id IS NOT NULL AND confidence IN ('high', 'medium')) OR confidence IS NULL THEN 'skipped' WHEN sha256 IN (SELECT sha256 FROM v_cpaths WHERE contains(lower(rel_path), 'machinery')) THEN 'excluded' ELSE 'applied' END AS outcome FROM v_assign a"


def _classified(spark, base):
    return T.classify(V.assignments(spark, base), V.customer_paths(spark, base), "medium", ["Machinery"])


@query("apply_rows", f"SELECT node_id, sha256, assigned_child_id, outcome FROM ({_OUTCOME})")
def apply_rows(spark, base):
    return _classified(spark, base).select("node_id", "sha256", "assigned_child_id", "outcome")


@query("apply_memberships", f"WITH o AS ({_OUTCOME}) SELECT node_id, sha256 FROM v_members m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.outcome = 'applied' AND o.node_id = m.node_id AND o.sha256 = m.sha256) UNION SELECT assigned_child_id, sha256 FROM o WHERE outcome = 'applied'")
def apply_memberships(spark, base):
    return T.apply_members(V.members(spark, base), _classified(spark, base))


@query("apply_assignments", f"WITH o AS ({_OUTCOME}) SELECT node_id, sha256, assigned_child_id, CASE WHEN outcome = 'applied' THEN 'applied' ELSE status END AS status FROM o")
def apply_assignments(spark, base):
    return T.apply_statuses(V.assignments(spark, base), _classified(spark, base)).select("node_id", "sha256", "assigned_child_id", "status")


@query("apply_summary", f"SELECT count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'excluded') AS excluded, count(*) FILTER (outcome = 'skipped') AS skipped FROM ({_OUTCOME})")
def apply_summary(spark, base):
    return T.apply_summary(_classified(spark, base))


@query("partition_children", f"""SELECT * FROM v_nodes WHERE path NOT LIKE '{PARENT}/%' UNION ALL SELECT m.top + i, p.id, name, '{PARENT}/' || name, p.depth + 1
    FROM (SELECT unnest([1, 2, 3]) AS i, unnest(['Coasts', 'Rivers', 'Lakes']) AS name), (SELECT max(id) AS top FROM v_nodes) m, (SELECT id, depth FROM v_nodes WHERE path = '{PARENT}') p""")
def partition_children(spark, base):
    return T.partition_children(V.nodes(spark, base), PARENT, NEW_CHILDREN)


# -- partitioning ----------------------------------------------------------------------------------------------------

_RANKED = f"SELECT sha256, row_number() OVER (ORDER BY sha256('{SEED}:' || sha256), sha256) AS rank FROM v_docs"


@query("seeded_order", _RANKED)
def seeded_order(spark, base):
    return B.seeded_order(V.documents(spark, base), "sha256", SEED)


@query("partition_batches", f"SELECT sha256, rank, ((rank - 1) // {CHUNK})::BIGINT AS batch_index FROM ({_RANKED})")
def partition_batches(spark, base):
    return B.batches(V.documents(spark, base), "sha256", SEED, CHUNK)


@query("batch_payloads", f"SELECT ((r.rank - 1) // {CHUNK})::BIGINT AS batch_index, count(*) AS documents, string_agg(d.file_name, '|' ORDER BY r.rank) AS files FROM ({_RANKED}) r JOIN v_docs d ON d.sha256 = r.sha256 GROUP BY 1")
def batch_payloads(spark, base):
    docs = V.documents(spark, base, "file_name")
    rows = B.batches(docs, "sha256", SEED, CHUNK).join(docs, "sha256")
    # a batch is a request, so its size is bounded by CHUNK
    files = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file_name"))), lambda x: x["file_name"]), "|")
    return rows.groupBy("batch_index").agg(F.count("*").alias("documents"), files.alias("files"))


@query("ancestor_names", "SELECT id, array_to_string(list_filter(list_transform(string_split(rel_path, '/'), lambda p: trim(p)), lambda p: p <> '')[2:], '|') AS names FROM document_paths")
def ancestor_names(spark, base):
    return read_table(spark, base, "document_paths").select("id", F.array_join(B.ancestor_names(F.col("rel_path")), "|").alias("names"))


_LABELS = "list_filter(regexp_extract_all(suggested_labels_json, '\"([^\"]+)\"', 1), lambda x: lower(trim(x)) NOT IN ('lattice', 'harvest'))"


@query("ancestor_filter", f"SELECT id, array_to_string(coalesce({_LABELS}, []), '|') AS labels, CASE WHEN len(coalesce({_LABELS}, [])) > 0 THEN array_to_string(coalesce({_LABELS}, []), '|') ELSE '' END AS topics FROM llm_document_suggestions")
def ancestor_filter(spark, base):
    labels = F.coalesce(F.from_json("suggested_labels_json", "array<string>"), F.array().cast("array<string>"))
    rows = read_table(spark, base, "llm_document_suggestions").select("id", labels.alias("labels"), F.array(F.struct(F.lit("own").alias("name"), labels.alias("topics")), F.struct(F.lit(" Harvest").alias("name"), labels.alias("topics"))).alias("groups"))
    kept = B.filter_scope(rows, "labels", "groups", ["Lattice ", "HARVEST"])
    return kept.select("id", F.array_join("labels", "|").alias("labels"), F.array_join(F.flatten(F.transform("groups", lambda g: g["topics"])), "|").alias("topics"))


_OPEN = "SELECT sha256 FROM v_customers EXCEPT SELECT sha256 FROM v_assign WHERE status = 'applied'"


@query("assignment_gate", _OPEN)
def assignment_gate(spark, base):
    done = V.assignments(spark, base).filter("status = 'applied'").select("sha256")
    return V.customer_paths(spark, base).select("sha256").distinct().join(done, "sha256", "left_anti")


@query("assignment_inputs", f"SELECT o.sha256, p.path AS current_path, k.n AS options FROM ({_OPEN}) o JOIN {_FIRST} p ON p.sha256 = o.sha256 JOIN v_customers c ON c.sha256 = o.sha256 JOIN (SELECT parent_id, count(*) AS n FROM v_nodes WHERE parent_id IS NOT NULL GROUP BY 1) k ON k.parent_id = 10 + c.n_regionkey")
def assignment_inputs(spark, base):
    gate = assignment_gate(spark, base)
    options = T.child_options(V.nodes(spark, base), V.terms(spark, base)).groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("options"))
    own = V.assignments(spark, base).select("sha256", "node_id").distinct().join(options, "node_id")
    return gate.join(T.first_paths(V.customer_paths(spark, base)), "sha256").join(own, "sha256").select("sha256", F.col("path").alias("current_path"), "options")
