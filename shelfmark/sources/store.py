"""A registry's tables in versions: each commit makes new versions of some tables current, all at once.

A version is a folder of parquet files that is never changed.  A commit is one small file with a number, which names the current version
of every table; it is created only if no file of that number is there, so of two writers that started from the same state one fails and
nothing is lost.  Readers take the commit of the greatest number and aren't disturbed by later ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark import schemas


class Conflict(RuntimeError):
    """Another commit was made since the tables were read."""


class Store:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.base, *parts)))

    def current(self) -> tuple[int, dict[str, str]]:
        """(number of the last commit, table -> folder of its current version); 0 and none before the first."""
        if not self._fs.exists(self._path("commits")):
            return 0, {}
        numbers = [int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(self._path("commits")) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, {}
        last = max(numbers)
        stream = self._fs.open(self._path("commits", f"{last:012}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return last, json.loads(text)

    def read(self, name: str) -> DataFrame:
        """The current version of a table; before its first, ``<name>.parquet`` in the base folder, or an empty table."""
        found = self.current()[1].get(name)
        if found is None and self._fs.exists(self._path(f"{name}.parquet")):
            found = f"{self.base}/{name}.parquet"
        if found is not None:
            return self.spark.read.parquet(found)
        return schemas.empty_table(self.spark, name)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write new versions of the tables and make them current; the number of the commit."""
        number, now = self.current()
        now = dict(now)
        for name, df in tables.items():
            now[name] = f"{self.base}/versions/{name}/v={uuid.uuid4().hex}"
            df.write.mode("errorifexists").parquet(now[name])
        self._fs.mkdirs(self._path("commits"))
        try:
            out = self._fs.create(self._path("commits", f"{number + 1:012}.json"), False)  # fails if it is there
        except Exception as e:
            raise Conflict(f"commit {number + 1} was made by another writer") from e
        try:
            out.write(json.dumps(now, sort_keys=True).encode())
        finally:
            out.close()
        return number + 1
