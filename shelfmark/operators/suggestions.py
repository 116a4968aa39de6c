"""Prompts and suggestions: identity, idempotency gate, upserts, batch status, checks of responses and requests."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X

PROMPT_KEY = ("workflow_name", "model_provider", "model", "prompt_version")
#: Attempts for one request, and the wait in seconds before the second; it doubles from there.
ATTEMPTS, FIRST_WAIT = 3, 2.0


def upsert_prompts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Prompts by identity: text, activity and time of change are taken from ``new``, id and creation stay.

    New identities get ids after the greatest there is, in the order of their identity.
    """
    key = list(PROMPT_KEY)
    n = new.select(*key, F.col("prompt_text").alias("_text"), F.col("active").alias("_active"), F.col("updated_at").alias("_at"))
    both = old.join(n, key, "left")
    hit = F.col("_at").isNotNull()
    kept = both.select(*[F.when(hit, F.col(a)).otherwise(F.col(c)).alias(c) if (a := {"prompt_text": "_text", "active": "_active", "updated_at": "_at"}.get(c)) else F.col(c) for c in old.columns])
    fresh = new.join(old.select(*key), key, "left_anti")
    # identities are written by hand, so they are few; ids are dense ranks among the new ones
    ranked = fresh.groupBy(*key).agg(F.max(F.struct("updated_at", "prompt_text", "active")).alias("_r"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    order = ranked.agg(F.sort_array(F.collect_list(F.struct(*key, "_r"))).alias("_all")).join(F.broadcast(top), F.lit(True)).select("_max", F.posexplode("_all").alias("_i", "_p"))
    made = order.select((F.col("_max") + F.col("_i") + 1).cast("bigint").alias("id"), *[F.col(f"_p.{k}").alias(k) for k in key], F.col("_p._r.prompt_text").alias("prompt_text"), F.col("_p._r.active").alias("active"), F.col("_p._r.updated_at").alias("created_at"), F.col("_p._r.updated_at").alias("updated_at"))
    return kept.unionByName(made.select(*old.columns))


def active_prompts(prompts: DataFrame) -> DataFrame:
    """The latest active prompt of each workflow; ties go to the greatest id."""
    rest = [c for c in prompts.columns if c != "workflow_name"]
    best = prompts.filter("active").groupBy("workflow_name").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "id")).alias("_p"))
    return best.select("workflow_name", *[F.col(f"_p.{c}").alias(c) for c in rest])


def gate(documents: DataFrame, suggestions: DataFrame, prompt_id: int) -> DataFrame:
    """Documents that have no suggestion for the prompt yet."""
    return documents.join(suggestions.filter(F.col("prompt_id") == prompt_id).select("sha256"), "sha256", "left_anti")


def upsert_suggestions(old: DataFrame, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next suggestions, rejected): responses by (sha256, prompt_id).

    An update takes the response's fields, sets the status to pending and keeps id, ``applied`` and creation time;
    responses for unknown documents are rejected.
    """
    key = ["sha256", "prompt_id"]
    known = new.join(documents.select("sha256"), "sha256", "left_semi")
    rejected = new.join(documents.select("sha256"), "sha256", "left_anti")
    fields = [c for c in new.columns if c in old.columns and c not in (*key, "id", "status", "applied", "created_at")]
    n = known.select(*key, *[F.col(c).alias("_" + c) for c in fields], F.lit(True).alias("_new"))
    both = old.join(n, key, "left")
    kept = both.select(*[F.when(F.col("_new"), F.col("_" + c)).otherwise(F.col(c)).alias(c) if c in fields else F.when(F.col("_new"), "pending").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in old.columns])
    fresh = known.join(old.select(*key), key, "left_anti")
    given = {"status": F.lit("pending"), "applied": F.lit(False), "created_at": F.col("updated_at")}
    made = fresh.select(*[given[c].alias(c) if c in given else F.col(c) if c in fresh.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    return kept.unionByName(made), rejected


def batch_status(documents: DataFrame, toc: DataFrame, suggestions: DataFrame, prompt_id: int, needs_toc: bool, limit: int | None = None) -> DataFrame:
    """(sha256, rank, status): what a batch run does with each selected document.

    Documents are taken in the order of their digest and cut at ``limit`` before the gate, so a run may request fewer.
    """
    picked = documents.select("sha256").distinct().orderBy("sha256")
    if limit is not None:
        picked = picked.limit(limit)
    with_toc = toc.select("sha256").distinct().withColumn("_toc", F.lit(True))
    done = suggestions.filter(F.col("prompt_id") == prompt_id).select("sha256").distinct().withColumn("_done", F.lit(True))
    rows = picked.join(with_toc, "sha256", "left").join(done, "sha256", "left")
    status = F.when(F.lit(needs_toc) & F.col("_toc").isNull(), "skipped_ineligible").when(F.col("_done"), "skipped_existing").otherwise("pending")
    return rows.select("sha256", status.alias("status"))


def toc_review_violation(is_valid: Column, reason: Column, page: Column, label: Column, confidence: Column) -> Column:
    """What is wrong with a reviewed outline, or null."""
    out = F.when(~is_valid & (F.coalesce(F.trim(reason), F.lit("")) == ""), "reason missing")
    out = out.when(page.isNull() & label.isNotNull(), "label without page")
    return out.when(confidence.isNotNull() & ~confidence.between(0, 1), "confidence out of range")


def assignment_violation(decision: Column, child: Column, options: Column, confidence: Column, reasoning: Column) -> Column:
    """What is wrong with an assignment, or null."""
    out = F.when(~F.coalesce(decision.isin("child", "stay"), F.lit(False)), "unknown decision")
    out = out.when(~F.coalesce(confidence.isin("high", "medium", "low"), F.lit(False)), "unknown confidence")
    out = out.when(F.coalesce(F.trim(reasoning), F.lit("")) == "", "reasoning missing")
    out = out.when((decision == "stay") & child.isNotNull(), "stay with child")
    return out.when((decision == "child") & ~F.coalesce(F.array_contains(options, child), F.lit(False)), "unknown child")


def prompt_inputs(documents: DataFrame, paths: DataFrame, toc: DataFrame, most_toc: int | None = None) -> DataFrame:
    """(sha256, current_path, paths, file_name, title, author, toc): the allow-listed fields of a request."""
    p = paths.groupBy("sha256").agg(F.sort_array(F.collect_set("rel_path")).alias("paths"))
    t = toc.groupBy("sha256").agg(F.sort_array(F.collect_list(F.struct("position", "title"))).alias("_t"))
    entries = F.transform("_t", lambda e: e["title"])
    entries = entries if most_toc is None else F.slice(entries, 1, most_toc)
    rows = documents.join(p, "sha256", "left").join(t, "sha256", "left")
    return rows.select("sha256", F.array_min("paths").alias("current_path"), "paths", "file_name", F.col("metadata_title").alias("title"), F.col("metadata_author").alias("author"), F.coalesce(entries, F.array().cast("array<string>")).alias("toc"))


def payload(inputs: DataFrame) -> DataFrame:
    """(sha256, payload): the request as JSON, without the digest."""
    return inputs.select("sha256", F.to_json(F.struct(*[c for c in inputs.columns if c != "sha256"])).alias("payload"))


def retry_waits(attempts: int = ATTEMPTS, first: float = FIRST_WAIT) -> list[float]:
    """Seconds to wait before each further attempt."""
    return [first * 2**i for i in range(attempts - 1)]


def respond(requests: DataFrame, responder: Callable[[str], dict], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, interval: float = 0.0) -> DataFrame:
    """(sha256, response, error): one call of ``responder`` for each payload, with retries inside the task.

    ``interval`` is the least time between two calls of one task; divide the rate allowed by the number of partitions.  Store the
    result before using it, as a task that runs again calls again; turn speculation off.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for frame in frames:
            rows = []
            for sha, text in zip(frame["sha256"], frame["payload"]):
                error = None
                for wait in [0.0, *retry_waits(attempts, first_wait)]:
                    time.sleep(max(wait, interval - (time.monotonic() - last) if interval else 0.0))
                    last = time.monotonic()
                    try:
                        rows.append((sha, json.dumps(responder(text), ensure_ascii=False, sort_keys=True), None))
                        break
                    except Exception as e:  # the reason is part of the result
                        error = f"{type(e).__name__}: {e}"
                else:
                    rows.append((sha, None, error))
            yield pd.DataFrame(rows, columns=["sha256", "response", "error"])

    return requests.select("sha256", "payload").mapInPandas(run, "sha256 string, response string, error string")


def trace_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON line per row, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def table_lines(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """(line): rows as text, each column as wide as its longest cell, at least its heading and ``least``."""
    cells = df.select(*[X.one_line(F.col(c).cast("string")).alias(c) for c in columns])
    widths = cells.agg(*[F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(max(least, len(c)))).alias(f"_w_{c}") for c in columns])  # one row
    rows = cells.join(F.broadcast(widths), F.lit(True))
    padded = [F.rpad(F.col(c), F.col(f"_w_{c}"), F.lit(" ")) for c in columns]
    return rows.select(F.rtrim(F.concat_ws(" | ", *padded)).alias("line"))
