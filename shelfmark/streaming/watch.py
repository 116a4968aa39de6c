"""File-change events: normalise, route and apply, on batches and streams alike; the progress that log lines tell of.

Normalising and routing are stateless, so they are the same expressions in a batch and in a stream.  What events do to the registry
is in ``operators.effects``; a stream applies its batches one after another to the current version of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators import effects
from shelfmark.session import cut_lineage
from shelfmark.sources.store import Store

#: The parts of the registry that events change, and their tables.
PARTS = {"documents": "documents", "paths": "document_paths", "state": "scanned_file_in_job", "nodes": "taxonomy_nodes", "members": "taxonomy_node_documents", "assignments": "taxonomy_assignments"}

EVENT_SCHEMA = "event_id bigint, kind string, is_directory boolean, src_path string, dest_path string"


def _relative(path: Column, root: str) -> Column:
    inside = path.startswith(root.rstrip("/") + "/")
    rel = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    return F.when(inside & F.lower(path).endswith(".pdf"), rel)


def normalise(events: DataFrame, root: str) -> DataFrame:
    """(event_id, kind, src, dest): events of PDF files inside the root, with paths relative to it."""
    rows = events.filter(~F.col("is_directory")).select("event_id", "kind", _relative(F.col("src_path"), root).alias("src"), _relative(F.col("dest_path"), root).alias("dest"))
    return rows.filter(F.col("src").isNotNull() | F.col("dest").isNotNull())


def route(normalised: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(event_id, operation, path, dest): what to do; a change of a known path is nothing to do.

    ``known``: (rel_path); a static table, joined from the side of the stream.  Without it a change is routed as ``path_changed``, for
    ``effects.resolve`` to decide by what is known when the event's turn comes.
    """
    src, dest, kind = F.col("src"), F.col("dest"), F.col("kind")
    if known is None:
        rows, changed = normalised, F.when(kind == "modified", "path_changed")
    else:
        k = known.select(F.col("rel_path").alias("src"), F.lit(True).alias("_known")).distinct()
        rows, changed = normalised.join(k, "src", "left"), F.when((kind == "modified") & F.col("_known").isNull(), "path_discovered")
    moved = F.when(src.isNotNull() & dest.isNotNull(), "path_moved").when(src.isNotNull(), "path_missing").otherwise("path_discovered")
    op = F.when(kind == "moved", moved).when(src.isNull(), F.lit(None)).when(kind == "deleted", "path_missing").when(kind == "created", "path_discovered").otherwise(changed)
    path = F.when(src.isNull(), dest).otherwise(src)
    return rows.select("event_id", op.alias("operation"), path.alias("path"), F.when(op == "path_moved", dest).alias("dest")).filter("operation is not null")


def watch(spark: SparkSession, source: str, root: str, store: Store, read: Callable[[DataFrame], DataFrame], checkpoint: str, tree_root: str = "Root") -> StreamingQuery:
    """Apply the JSON events that arrive in a folder to the registry, once for all that is there.

    Each batch of events is normalised, routed and applied to the store's current tables, and its outcome is committed as their next version, so a
    batch that fails half way leaves no trace.  A batch that comes again after a failure is applied to the version it left, which gives
    the same registry: what an event says has then been done.  ``read``: gives (rel_path, sha256, ...) of the readable ones among (rel_path).
    """
    events = spark.readStream.schema(EVENT_SCHEMA).json(source)

    def act(batch: DataFrame, _: int) -> None:
        operations = cut_lineage(route(normalise(batch, root)))
        if not operations.limit(1).count():
            return
        touched = operations.select(F.explode(F.array_compact(F.array("path", "dest"))).alias("rel_path")).distinct()
        tables = {part: store.read(name) for part, name in PARTS.items()}
        after = effects.apply(tables, operations, cut_lineage(read(touched)), tree_root)
        store.commit({PARTS[part]: df for part, df in after.items()})

    return events.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path) of the log lines that tell of an attempt; lines that are no JSON objects are left out."""
    parsed = lines.select(*[c for c in lines.columns if c != value], F.from_json(value, "msg string, path string", {"mode": "PERMISSIVE"}).alias("j"))
    return parsed.filter(F.col("j.msg").isin("processed", "skipping file due to error")).select(*[c for c in lines.columns if c != value], "j.path")


def log_progress(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path) of the attempts that log lines tell of."""
    return progress_lines(lines, value).select("path")


def running_progress(lines: DataFrame, order: str, value: str = "value", parts: int = 256) -> DataFrame:
    """(order, path, attempts): each attempt with the number of attempts up to it.

    ``order``: a column of whole numbers.  Attempts are counted by range of it, and only counted one by one within a range.
    """
    rows = cut_lineage(progress_lines(lines.select(order, value), value))
    width = rows.agg(F.min(order).alias("_low"), F.greatest(F.ceil((F.max(order) - F.min(order) + 1) / parts), F.lit(1)).alias("_width"))  # one row
    ranged = rows.join(F.broadcast(width), F.lit(True)).withColumn("_part", F.floor((F.col(order) - F.col("_low")) / F.col("_width")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(order, "path")
    return ranged.join(starts, "_part").select(order, "path", (F.col("_start") + F.row_number().over(inside)).alias("attempts"))


def watch_progress(spark: SparkSession, source: str, sink: str) -> StreamingQuery:
    """A stream of log lines (text files in a folder) counted: the table ``sink`` in memory has the attempts so far in total."""
    attempts = progress_lines(spark.readStream.text(source)).agg(F.count("*").alias("attempts"))
    return attempts.writeStream.format("memory").queryName(sink).outputMode("complete").trigger(availableNow=True).start()
