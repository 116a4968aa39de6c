"""Sources and sinks: file listings, path lists, registries as JSON, versioned tables, NDJSON traces, extraction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas

RECORD = T.StructType([
    T.StructField("rel_path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("md5", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("mtime", T.DoubleType()),
    T.StructField("metadata", schemas.METADATA), T.StructField("toc", T.ArrayType(schemas.TOC_ENTRY)), T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("is_digital", T.BooleanType()), T.StructField("error", T.StringType()),
])
_S, _I = T.StringType(), T.IntegerType()
_DOCUMENT = T.StructType([T.StructField(c, _S) for c in ("sha256", "md5", "file_name", "normalised_name", "toc_invalid_reason", "first_seen_job", "last_seen_job")] + [
    T.StructField("paths", T.ArrayType(_S)), T.StructField("metadata", schemas.METADATA), T.StructField("toc", T.ArrayType(schemas.TOC_ENTRY)), T.StructField("languages", T.ArrayType(_S)),
    T.StructField("is_digital", T.BooleanType()), T.StructField("toc_valid", T.BooleanType()), T.StructField("force_extracted", T.BooleanType()),
])
_STATE = schemas.TABLES["scanned_file_in_job"]
_JOB = T.StructType([T.StructField(c, _S) for c in ("job_id", "run_at", "root_path")] + [T.StructField("stats", T.StructType([T.StructField(c, _I) for c in ("added", "updated", "removed", "duplicates", "skipped")]))])
#: A registry file; two of its parts have an older name that is still read.
REGISTRY = T.StructType([
    T.StructField("documents", T.MapType(_S, _DOCUMENT)), T.StructField("scanned_files_in_job", T.MapType(_S, _STATE)), T.StructField("file_stats", T.MapType(_S, _STATE)),
    T.StructField("scan_jobs", T.ArrayType(_JOB)), T.StructField("jobs", T.ArrayType(_JOB)),
])


def list_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size_bytes, modified): files below a root whose names match; contents aren't read.

    Spark's file sources leave out empty files, so this does too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def read_path_list(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(rel_path): the non-blank lines of a text file, trimmed; lines that start with '#' are left out if ``comments``."""
    lines = spark.read.text(path).select(F.trim("value").alias("rel_path")).filter("rel_path <> ''")
    return lines.filter(~F.col("rel_path").startswith("#")) if comments else lines


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, scanned_files_in_job and scan_jobs of a registry in one JSON file; an absent file is an empty registry, malformed JSON an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        jobs = T.StructType([T.StructField(c, _S) for c in ("job_id", "run_at", "root_path")] + [T.StructField(c, _I) for c in ("added", "updated", "removed", "duplicates", "skipped")])
        return {"documents": spark.createDataFrame([], _DOCUMENT), "scanned_files_in_job": spark.createDataFrame([], _STATE), "scan_jobs": spark.createDataFrame([], jobs)}
    doc = spark.read.schema(REGISTRY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    state = F.coalesce("scanned_files_in_job", "file_stats")
    jobs = F.coalesce("scan_jobs", "jobs")
    return {
        "documents": doc.select(F.explode(F.map_values("documents")).alias("d")).select("d.*"),
        "scanned_files_in_job": doc.select(F.explode(F.map_values(state)).alias("s")).select("s.*"),
        "scan_jobs": doc.select(F.explode(jobs).alias("j")).select("j.job_id", "j.run_at", "j.root_path", "j.stats.*"),
    }


def write_registry_lines(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested documents as JSON lines, a file per partition."""
    documents.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_registry_lines(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents of ``write_registry_lines``."""
    return spark.read.schema(_DOCUMENT).option("mode", "FAILFAST").json(path)


def write_registry(registry: dict[str, DataFrame], path: str) -> int:
    """Write a registry as one indented JSON file that ``read_registry`` reads back; the number of documents.

    One file is written by one process: rows pass through it a partition at a time and are never held together.  Large registries go
    to ``write_registry_lines``.
    """
    jobs = registry["scan_jobs"].select("job_id", F.col("run_at").cast("string").alias("run_at"), "root_path", F.struct("added", "updated", "removed", "duplicates", "skipped").alias("stats"))
    keep = {"ignoreNullFields": "false"}
    parts = (
        ("documents", "{}", registry["documents"].select(F.col("sha256").alias("k"), F.to_json(F.struct(*[c for c in _DOCUMENT.names if c in registry["documents"].columns]), keep).alias("v")).orderBy("k")),
        ("scanned_files_in_job", "{}", registry["scanned_files_in_job"].select(F.col("rel_path").alias("k"), F.to_json(F.struct(*_STATE.names), keep).alias("v")).orderBy("k")),
        ("scan_jobs", "[]", jobs.select("job_id", "run_at", F.lit(None).cast("string").alias("k"), F.to_json(F.struct("job_id", "run_at", "root_path", "stats"), keep).alias("v")).orderBy("run_at", "job_id").select("k", "v")),
    )
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("{\n")
        for i, (name, ends, rows) in enumerate(parts):
            out.write(f"  {json.dumps(name)}: {ends[0]}")
            for j, r in enumerate(rows.toLocalIterator()):
                text = json.dumps(json.loads(r["v"]), ensure_ascii=False, indent=2).replace("\n", "\n    ")
                out.write((",\n    " if j else "\n    ") + (f"{json.dumps(r['k'], ensure_ascii=False)}: {text}" if r["k"] is not None else text))
                n += i == 0
            out.write(f"\n  {ends[1]}" + (",\n" if i + 1 < len(parts) else "\n"))
        out.write("}\n")
    return n


def append_trace(lines: DataFrame, path: str) -> None:
    """Append JSON lines (column value) to a trace folder."""
    lines.select("value").write.mode("append").text(path)


def save_version(df: DataFrame, base: str) -> str:
    """Write a table to a new version folder under ``base`` and return it; readers of older versions aren't disturbed."""
    path = f"{base.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def extract(files: DataFrame, extractor: Callable[[str, bytes], dict], root: str, detector: Callable[[str], Sequence[str]] | None = None, digital_pages: int = 3, digital_chars: int = 100) -> DataFrame:
    """Records (``RECORD``) of files (path, content, and modified if there): what ``extractor(rel_path, content)`` gives, and what follows from it.

    The extractor gives ``metadata`` (a map of raw keys, or the record's own fields), ``toc``, and ``pages`` (their texts), or ``languages`` and
    ``is_digital`` itself.  From pages it is told whether the first ``digital_pages`` hold ``digital_chars`` characters, and ``detector`` tells
    the languages of their text.  Digests are computed in the JVM.  A path outside the root, one that is no PDF, and a file that fails give a
    row with ``error`` and nulls; none stops another.
    """
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^file:(?=/)", "")
    inside = F.when(rel.startswith(prefix), F.substr(rel, F.lit(len(prefix) + 1)))
    mtime = F.unix_micros("modified") / 1e6 if "modified" in files.columns else F.lit(None).cast("double")
    base = files.select(F.coalesce(inside, rel).alias("rel_path"), inside.isNotNull().alias("inside"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.length("content").cast("bigint").alias("size_bytes"), mtime.alias("mtime"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                got: dict = {}
                error = None
                try:
                    if not r.inside or ".." in r.rel_path.split("/"):
                        raise ValueError("outside the root")
                    if not r.rel_path.lower().endswith(".pdf"):
                        raise ValueError("no PDF")
                    got = dict(extractor(r.rel_path, bytes(r.content)))
                    pages = got.get("pages")
                    if pages is not None:
                        got.setdefault("is_digital", sum(len((p or "").strip()) for p in pages[:digital_pages]) >= digital_chars)
                        if detector is not None and "languages" not in got:
                            text = "\n".join(p for p in pages if p).strip()
                            got["languages"] = list(detector(text)) if text else []
                except Exception as e:  # reported in the row
                    got, error = {}, f"{type(e).__name__}: {e}"
                rows.append((r.rel_path, r.sha256, r.md5, r.size_bytes, r.mtime, _metadata(got.get("metadata")), got.get("toc"), got.get("languages"), got.get("is_digital"), error))
            yield pd.DataFrame(rows, columns=RECORD.names)

    return base.mapInPandas(run, RECORD)


def _metadata(raw: dict | None) -> dict | None:
    """The record's metadata from a map of raw keys: five named fields, empty ones null, and all others that have a value."""
    if raw is None:
        return None
    # fixed values: keys of PDF metadata and the fields they fill
    names = {"title": "title", "author": "author", "creator": "creator", "creationDate": "created", "modDate": "modified"}
    out = {field: raw.get(key) or raw.get(field) or None for key, field in names.items()}
    return out | {"extra": {k: str(v) for k, v in raw.items() if k not in names and k not in names.values() and v}}
