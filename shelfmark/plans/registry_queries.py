"""Queries of the registry, of names and text, of the scan merge and of paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import paths as P
from shelfmark.operators import registry as R
from shelfmark.operators import suggestions as S
from shelfmark.plans import views as V
from shelfmark.plans.catalog import Catalog
from shelfmark.session import read_table

catalog = Catalog()
query = catalog.query
_SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\x{{00}}-\x{{1f}}·\x{{FFFD}}]', '', 'g'), '{_SPACES}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return rf"CASE WHEN contains(regexp_replace({x}, '^\.+', ''), '.') THEN regexp_replace({x}, '\.[\p{{L}}\p{{N}}]{{1,8}}$', '') ELSE {x} END"


def _line(x: str) -> str:
    return rf"trim(replace(coalesce({x}, ''), chr(10), ' '))"


_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
NAMES_SQL = rf"""
n0 AS (SELECT doc_id, normalised_name AS stored, file_name AS x, regexp_extract(replace(file_name, '\', '/'), '[^/]*$') AS b FROM documents),
n1 AS (SELECT *, CASE WHEN {_strip('b')} <> b THEN b ELSE x END AS y FROM n0),
n2 AS (SELECT *, regexp_replace({_clean('(' + _strip('y') + ')')}, '^\.+', '') AS z FROM n1),
n3 AS (SELECT *, array_to_string(list_transform(list_filter(string_split(regexp_replace(z, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: replace(replace(upper(substr(w, 1, 1)), 'ﬁ', 'FI'), 'ﬂ', 'FL') || lower(substr(w, 2))), ' ') AS t FROM n2),
n4 AS (SELECT *, regexp_extract(substr(t, 1, 120), '(?s)^(.*)[^{_CJK}][{_CJK}]*$', 1) AS p FROM n3),
n5 AS (SELECT doc_id, stored, x, (CASE WHEN length(t) <= 120 THEN t WHEN length(p) BETWEEN 101 AND 119 THEN rtrim(p) ELSE substr(t, 1, 120) END) || CASE WHEN lower(x) LIKE '%.pdf' THEN '.pdf' ELSE '' END AS normalised FROM n4)
"""


# -- registry --------------------------------------------------------------------------------------------------------


@query("content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, md5(coalesce(text, '')) AS text_md5 FROM documents")
def content_hashes(spark, base):
    text = F.coalesce("text", F.lit(""))
    return read_table(spark, base, "documents").select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.md5(text).alias("text_md5"))


@query("document_keys", "SELECT DISTINCT sha256 FROM documents")
def document_keys(spark, base):
    return V.documents(spark, base).select("sha256")


@query("candidate_docs", "SELECT sha256, file_name FROM v_docs WHERE is_digital AND sha256 IN (SELECT sha256 FROM v_toc)")
def candidate_docs(spark, base):
    return R.candidates(V.documents(spark, base, "file_name", "is_digital"), V.toc(spark, base), True, True).select("sha256", "file_name")


@query("document_paths", "SELECT d.sha256, d.file_name, p.rel_path FROM v_docs d JOIN v_paths p ON p.sha256 = d.sha256")
def document_paths(spark, base):
    return V.documents(spark, base, "file_name").join(V.paths(spark, base), "sha256").select("sha256", "file_name", "rel_path")


@query("flatten_paths", "SELECT DISTINCT sha256, rel_path FROM v_paths WHERE sha256 IN (SELECT sha256 FROM documents)")
def flatten_paths(spark, base):
    nested = R.nest(V.documents(spark, base), V.paths(spark, base), V.toc(spark, base))
    return R.flatten_paths(nested)


@query("toc_entries", f"SELECT sha256, (row_number() OVER (PARTITION BY sha256 ORDER BY position, level, title, page) - 1)::INT AS position, level, {_clean('title')} AS title, page FROM v_toc WHERE sha256 IN (SELECT sha256 FROM documents)")
def toc_entries(spark, base):
    return R.flatten_toc(R.nest(V.documents(spark, base), V.paths(spark, base), V.toc(spark, base)))


@query("registry_nested", """SELECT d.sha256, d.file_name, coalesce(p.paths, '') AS paths, coalesce(t.toc, '') AS toc FROM v_docs d
    LEFT JOIN (SELECT sha256, string_agg(rel_path, '|' ORDER BY rel_path) AS paths FROM v_paths GROUP BY 1) p ON p.sha256 = d.sha256
    LEFT JOIN (SELECT sha256, string_agg(title, '|' ORDER BY position, level, title) AS toc FROM v_toc GROUP BY 1) t ON t.sha256 = d.sha256""")
def registry_nested(spark, base):
    n = R.nest(V.documents(spark, base, "file_name"), V.paths(spark, base), V.toc(spark, base))
    titles = F.array_join(F.transform("toc", lambda e: e["title"]), "|")
    return n.select("sha256", "file_name", F.coalesce(F.array_join("paths", "|"), F.lit("")).alias("paths"), F.coalesce(titles, F.lit("")).alias("toc"))


_DUPLICATES = "SELECT d.sha256, d.file_name, p.n AS path_count, p.paths FROM v_docs d JOIN (SELECT sha256, count(*) AS n, string_agg(rel_path, '|' ORDER BY rel_path) AS paths FROM v_paths GROUP BY 1 HAVING count(*) > 1) p ON p.sha256 = d.sha256"


@query("duplicate_documents", _DUPLICATES)
def duplicate_documents(spark, base):
    return R.duplicates(V.documents(spark, base, "file_name"), V.paths(spark, base)).withColumn("paths", F.array_join("paths", "|"))


@query("duplicate_page", _DUPLICATES.replace("SELECT d.sha256", "SELECT * FROM (SELECT d.sha256", 1) + ") ORDER BY sha256 LIMIT 20 OFFSET 10")
def duplicate_page(spark, base):
    return duplicate_documents(spark, base).orderBy("sha256").offset(10).limit(20)


@query("digital_flag", rf"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^{_SPACES}+|{_SPACES}+$', '', 'g')) >= 100 AS is_digital FROM documents")
def digital_flag(spark, base):
    pages = read_table(spark, base, "documents").select("doc_id", F.lit(0).alias("page"), "text")
    return R.digital_flag(pages, "doc_id", "page", "text")


@query("languages", "SELECT language, count(*) AS documents FROM (SELECT unnest(regexp_extract_all(languages_json, '[a-z]{2,3}')) AS language FROM v_docs) GROUP BY 1")
def languages(spark, base):
    rows = V.documents(spark, base, "languages_json").select(F.explode(F.from_json("languages_json", "array<string>")).alias("language"))
    return rows.groupBy("language").agg(F.count("*").alias("documents"))


@query("metadata_projection", """SELECT sha256, nullif(metadata_title, '') AS title, nullif(metadata_author, '') AS author, nullif(metadata_creator, '') AS creator, nullif(metadata_created, '') AS created,
    nullif(metadata_modified, '') AS modified, nullif(regexp_extract(metadata_extra_json, '"producer": "([^"]+)"', 1), '') AS producer FROM v_docs""")
def metadata_projection(spark, base):
    names = {"metadata_title": "title", "metadata_author": "author", "metadata_creator": "creator", "metadata_created": "creationDate", "metadata_modified": "modDate"}
    docs = V.documents(spark, base, *names, "metadata_extra_json")
    fixed = F.create_map(*[x for c, k in names.items() for x in (F.lit(k), F.col(c))])
    extra = F.coalesce(F.from_json("metadata_extra_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    raw = docs.select("sha256", F.map_concat(fixed, extra).alias("m"))
    return R.metadata_projection(raw, "sha256", "m").select("sha256", "title", "author", "creator", "created", "modified", F.try_element_at("extra", F.lit("producer")).alias("producer"))


@query("import_summary", "SELECT (SELECT count(*) FROM v_docs) AS documents, (SELECT count(*) FROM v_paths) AS paths, (SELECT count(*) FROM v_toc) AS toc_entries, (SELECT count(*) FROM v_state) AS scanned_files, (SELECT count(*) FROM scan_jobs) AS scan_jobs")
def import_summary(spark, base):
    return R.import_summary(V.documents(spark, base), V.paths(spark, base), V.toc(spark, base), V.prior_state(spark, base), read_table(spark, base, "scan_jobs"))


@query("backfill_names", f"WITH {NAMES_SQL} SELECT doc_id, stored, normalised AS recomputed FROM n5 WHERE stored IS DISTINCT FROM normalised")
def backfill_names(spark, base):
    return R.backfill(read_table(spark, base, "documents"))


@query("resolve_targets", "SELECT DISTINCT rel_path FROM document_paths WHERE lower(rel_path) LIKE '%.pdf'")
def resolve_targets(spark, base):
    return P.resolve_targets(read_table(spark, base, "document_paths"), "rel_path")


@query("document_upsert", """SELECT sha256, file_name, is_digital FROM v_docs WHERE sha256 NOT IN (SELECT sha256 FROM v_batch)
    UNION ALL SELECT sha256, regexp_extract(min(rel_path), '[^/]*$') AS file_name, true FROM v_batch GROUP BY sha256""")
def document_upsert(spark, base):
    new = V.batch(spark, base).groupBy("sha256").agg(X.basename(F.min("rel_path")).alias("file_name")).withColumn("is_digital", F.lit(True))
    return R.upsert(V.documents(spark, base, "file_name", "is_digital").drop("doc_id"), new, "sha256")


# -- text ------------------------------------------------------------------------------------------------------------


@query("clean_text", f"SELECT id, {_clean('title')} AS title FROM document_toc")
def clean_text(spark, base):
    return read_table(spark, base, "document_toc").select("id", X.clean_text(F.col("title")).alias("title"))


@query("normalise_names", f"WITH {NAMES_SQL} SELECT doc_id, normalised FROM n5")
def normalise_names(spark, base):
    return read_table(spark, base, "documents").select("doc_id", X.normalise_file_name(F.col("file_name")).alias("normalised"))


_SHORT = _line("reasoning_summary")


@query("rendered_rows", f"SELECT id, CASE WHEN length({_SHORT}) > 24 THEN substr({_SHORT}, 1, 23) || '…' ELSE {_SHORT} END AS reasoning, {_line('suggested_author')} AS author FROM llm_document_suggestions")
def rendered_rows(spark, base):
    return read_table(spark, base, "llm_document_suggestions").select("id", X.shorten(F.col("reasoning_summary"), 24).alias("reasoning"), X.one_line(F.col("suggested_author")).alias("author"))


_MESSAGE = "CASE id % 5 WHEN 0 THEN 'Ignoring ' WHEN 1 THEN 'font ' WHEN 2 THEN 'CMap ' WHEN 3 THEN 'embedded ICC ' ELSE '' END || coalesce(title, '')"


@query("message_levels", f"SELECT id, CASE WHEN regexp_matches(lower({_MESSAGE}), '^(ignoring |font |cmap |embedded icc)') THEN 'DEBUG' ELSE 'WARNING' END AS level FROM document_toc")
def message_levels(spark, base):
    k = F.col("id") % 5
    prefix = F.when(k == 0, "Ignoring ").when(k == 1, "font ").when(k == 2, "CMap ").when(k == 3, "embedded ICC ").otherwise("")
    return read_table(spark, base, "document_toc").select("id", R.message_level(F.concat(prefix, F.coalesce("title", F.lit("")))).alias("level"))


@query("keyword_dedup", "SELECT position, keyword FROM (SELECT id AS position, trim(title) AS keyword, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY id) AS r FROM document_toc WHERE trim(title) <> '') WHERE r = 1")
def keyword_dedup(spark, base):
    return R.keyword_dedup(read_table(spark, base, "document_toc"), "title", "id")


_HIT = " OR ".join(f"contains(lower(rel_path), '{k}')" for k in V.KEYWORDS)


@query("keyword_exclusion", f"SELECT sha256 FROM v_docs WHERE sha256 NOT IN (SELECT sha256 FROM v_paths WHERE {_HIT})")
def keyword_exclusion(spark, base):
    return R.exclude_by_keyword(V.documents(spark, base), V.paths(spark, base), V.KEYWORDS).select("sha256")


@query("path_guard", """SELECT id, CASE id % 4 WHEN 0 THEN rel_path WHEN 1 THEN regexp_replace(rel_path, '^[^/]*/', '') WHEN 2 THEN NULL ELSE rel_path || '.txt' END AS rel_path,
    CASE WHEN id % 4 = 2 THEN 'outside' WHEN id % 4 = 3 OR lower(rel_path) NOT LIKE '%.pdf' THEN 'not_pdf' ELSE 'ok' END AS verdict FROM document_paths""")
def path_guard(spark, base):
    k, p = F.col("id") % 4, F.col("rel_path")
    asked = F.when(k == 0, F.concat(F.lit("./"), p)).when(k == 1, F.concat(F.regexp_extract(p, "^[^/]*", 0), F.lit("/../"), F.regexp_replace(p, "^[^/]*/", ""))).when(k == 2, F.concat(F.lit("../"), p)).otherwise(F.concat(p, F.lit(".txt")))
    rows = read_table(spark, base, "document_paths").select("id", asked.alias("asked"))
    return rows.join(P.guard(rows, "asked").distinct(), "asked").select("id", "rel_path", "verdict")


@query("path_to_node", "SELECT id, CASE WHEN rel_path LIKE 'Books/%' THEN regexp_replace(rel_path, '/[^/]*$', '') END AS node_path, regexp_extract(rel_path, '[^/]*$') AS name FROM document_paths")
def path_to_node(spark, base):
    p = F.col("rel_path")
    return read_table(spark, base, "document_paths").select("id", F.when(p.startswith("Books/"), X.parent_path(p)).alias("node_path"), X.basename(p).alias("name"))


# -- scan merge ------------------------------------------------------------------------------------------------------


def _rows(spark, base):
    return R.merge_rows(V.prior_paths(spark, base), V.prior_state(spark, base), V.batch(spark, base))


_FLAGS = "(NOT added AND NOT owned)::INT::BIGINT AS duplicate, (NOT added AND fresh)::INT::BIGINT AS updated, (NOT added AND NOT fresh)::INT::BIGINT AS skipped"


@query("scan_merge_rows", f"SELECT rel_path, sha256, added::INT::BIGINT AS added, {_FLAGS} FROM v_merge")
def scan_merge_rows(spark, base):
    return _rows(spark, base).select("rel_path", "sha256", *[F.col(c).cast("bigint").alias(c) for c in ("added", "duplicate", "updated", "skipped")])


@query("scan_merge_stats", """SELECT count(*) FILTER (added) AS added, count(*) FILTER (NOT added AND fresh) AS updated,
    (SELECT count(DISTINCT sha256) FROM v_state WHERE rel_path NOT IN (SELECT rel_path FROM v_batch)) AS removed,
    count(*) FILTER (NOT added AND NOT owned) AS duplicates, count(*) FILTER (NOT added AND NOT fresh) AS skipped FROM v_merge""")
def scan_merge_stats(spark, base):
    return R.merge_stats(_rows(spark, base), V.prior_state(spark, base), V.batch(spark, base))


@query("scan_merge_paths", "SELECT sha256, rel_path FROM v_prior WHERE rel_path NOT IN (SELECT rel_path FROM v_batch) UNION SELECT sha256, rel_path FROM v_batch")
def scan_merge_paths(spark, base):
    return R.merge_paths(V.prior_paths(spark, base), _rows(spark, base))


@query("scan_merge_paths_strict", """SELECT p.sha256, p.rel_path FROM v_prior p WHERE NOT EXISTS (SELECT 1 FROM v_merge m WHERE m.added AND m.prior_sha256 <> m.sha256 AND m.prior_sha256 = p.sha256 AND m.rel_path = p.rel_path)
    UNION SELECT sha256, rel_path FROM v_batch""")
def scan_merge_paths_strict(spark, base):
    return R.merge_paths(V.prior_paths(spark, base), _rows(spark, base), strict=True)


@query("scan_merge_state", f"""SELECT rel_path, sha256, size_bytes, mtime, '{V.JOB_ID}' AS last_scanned_job FROM v_merge WHERE added OR fresh
    UNION ALL SELECT s.rel_path, s.sha256, s.size_bytes, s.mtime, CASE WHEN m.rel_path IS NULL THEN s.last_scanned_job ELSE '{V.JOB_ID}' END FROM v_state s
    LEFT JOIN v_merge m ON m.rel_path = s.rel_path WHERE m.rel_path IS NULL OR NOT (m.added OR m.fresh)""")
def scan_merge_state(spark, base):
    return R.merge_state(V.prior_state(spark, base), _rows(spark, base), V.JOB_ID)


@query("scan_merge_documents", f"""WITH prior_docs AS (SELECT sha256, regexp_extract(min(rel_path), '[^/]*$') AS file_name FROM v_prior GROUP BY 1)
    SELECT sha256, file_name, 'earlier' AS first_seen_job, CASE WHEN sha256 IN (SELECT sha256 FROM v_batch) THEN '{V.JOB_ID}' ELSE 'earlier' END AS last_seen_job FROM prior_docs
    UNION ALL SELECT sha256, regexp_extract(rel_path, '[^/]*$'), '{V.JOB_ID}', '{V.JOB_ID}' FROM v_merge WHERE added""".replace("WITH prior_docs AS (", "WITH prior_docs AS ("))
def scan_merge_documents(spark, base):
    old = V.prior_paths(spark, base).groupBy("sha256").agg(X.basename(F.min("rel_path")).alias("file_name")).withColumn("first_seen_job", F.lit("earlier")).withColumn("last_seen_job", F.lit("earlier"))
    return R.merge_documents(old, _rows(spark, base), V.JOB_ID)


# -- paths -----------------------------------------------------------------------------------------------------------

_DRIFT = """SELECT coalesce(b.rel_path, s.rel_path) AS rel_path, b.sha256 AS disk_sha256, s.sha256 AS registry_sha256,
    CASE WHEN b.sha256 IS NULL THEN 'missing_on_disk' WHEN s.sha256 IS NOT NULL THEN 'hash_mismatch' WHEN b.sha256 IN (SELECT sha256 FROM v_state) THEN 'known_hash_missing_path' ELSE 'missing_hash' END AS class
    FROM v_batch b FULL OUTER JOIN v_state s ON s.rel_path = b.rel_path WHERE b.sha256 IS DISTINCT FROM s.sha256"""


@query("path_drift", _DRIFT)
def path_drift(spark, base):
    return P.drift(V.batch(spark, base), V.prior_state(spark, base))


@query("reconcile_plan", f"SELECT rel_path, CASE WHEN class = 'missing_on_disk' THEN 'remove' ELSE 'discover' END AS action FROM ({_DRIFT}) WHERE class <> 'hash_mismatch'")
def reconcile_plan(spark, base):
    return P.reconcile_plan(path_drift(spark, base))


# A request to delete: everything under two folders, and paths that were never there.
_ASKED = "SELECT DISTINCT rel_path FROM document_paths WHERE rel_path LIKE 'Backup/%' OR rel_path LIKE 'Intake/%' UNION SELECT 'no/such/' || rel_path FROM document_paths WHERE rel_path LIKE 'Manuals/%'"


def _asked(spark, base):
    p = read_table(spark, base, "document_paths").select("rel_path")
    there = p.filter(F.col("rel_path").startswith("Backup/") | F.col("rel_path").startswith("Intake/"))
    lost = p.filter(F.col("rel_path").startswith("Manuals/")).select(F.concat(F.lit("no/such/"), "rel_path").alias("rel_path"))
    return there.unionByName(lost).distinct()


@query("delete_report", f"""SELECT a.rel_path, CASE WHEN b.rel_path IS NOT NULL AND s.rel_path IS NOT NULL THEN 'deleted' WHEN b.rel_path IS NOT NULL THEN 'only_on_disk' WHEN s.rel_path IS NOT NULL THEN 'only_in_registry' ELSE 'unknown' END AS outcome
    FROM ({_ASKED}) a LEFT JOIN v_batch b ON b.rel_path = a.rel_path LEFT JOIN v_state s ON s.rel_path = a.rel_path""")
def delete_report(spark, base):
    return P.delete_report(_asked(spark, base), V.batch(spark, base), V.prior_state(spark, base))


@query("path_delete", f"""WITH gone AS ({_ASKED}) SELECT p.rel_path, p.sha256, (SELECT count(*) FROM v_paths q WHERE q.sha256 = p.sha256 AND q.rel_path NOT IN (SELECT rel_path FROM gone)) AS remaining
    FROM v_paths p WHERE p.rel_path IN (SELECT rel_path FROM gone)""")
def path_delete(spark, base):
    return P.delete_paths(V.paths(spark, base), _asked(spark, base))[1]


# Moves of every path: out of the backup, or onto the path of the next row; and of paths that were never there.
_MOVES = """SELECT DISTINCT a.rel_path AS old_path, CASE WHEN a.rel_path LIKE 'Backup/%' THEN 'Moved/' || a.rel_path ELSE b.rel_path END AS new_path FROM document_paths a JOIN document_paths b ON b.id = a.id + 1
    UNION SELECT 'no/such/' || rel_path, rel_path FROM document_paths WHERE rel_path LIKE 'Intake/%'"""
_OWNERS = "SELECT rel_path, min(sha256) AS sha256 FROM v_paths GROUP BY 1"


@query("path_move", f"""WITH owners AS ({_OWNERS}), moves AS ({_MOVES}) SELECT m.old_path, m.new_path, o.sha256, CASE WHEN o.sha256 IS NULL THEN 'unknown' WHEN n.sha256 IS NULL THEN 'moved' WHEN n.sha256 = o.sha256 THEN 'dropped' ELSE 'refused' END AS outcome
    FROM moves m LEFT JOIN owners o ON o.rel_path = m.old_path LEFT JOIN owners n ON n.rel_path = m.new_path""")
def path_move(spark, base):
    p = read_table(spark, base, "document_paths").select("id", "rel_path")
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("rel_path").alias("_next"))
    new = F.when(F.col("rel_path").startswith("Backup/"), F.concat(F.lit("Moved/"), "rel_path")).otherwise(F.col("_next"))
    moves = p.join(nxt, "id").select(F.col("rel_path").alias("old_path"), new.alias("new_path"))
    lost = p.filter(F.col("rel_path").startswith("Intake/")).select(F.concat(F.lit("no/such/"), "rel_path").alias("old_path"), F.col("rel_path").alias("new_path"))
    moves = moves.unionByName(lost).distinct()
    owners = V.paths(spark, base).groupBy("rel_path").agg(F.min("sha256").alias("sha256"))
    return P.move_paths(owners, moves)


@query("job_summary_text", "SELECT job_id, printf('added %d, updated %d, removed %d, duplicates %d, skipped %d', added, updated, removed, duplicates, skipped) AS summary FROM scan_jobs")
def job_summary_text(spark, base):
    lines = read_table(spark, base, "scan_jobs").select("job_id", F.to_json(F.struct("added", "updated", "removed", "duplicates", "skipped")).alias("line"))
    j = F.from_json("line", "added int, updated int, removed int, duplicates int, skipped int")
    text = F.format_string("added %d, updated %d, removed %d, duplicates %d, skipped %d", *[j[c] for c in ("added", "updated", "removed", "duplicates", "skipped")])
    return lines.select("job_id", F.coalesce(text, "line").alias("summary"))


@query("table_lines")
def table_lines(spark, base):
    return S.table_lines(read_table(spark, base, "corpus_sources"), ["source", "home_zone", "date_order"])


@query("ndjson_trace")
def ndjson_trace(spark, base):
    return S.trace_lines(read_table(spark, base, "llm_document_suggestions").select("sha256", "prompt_id", "status", "reasoning_summary"))
