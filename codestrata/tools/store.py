"""Parquet tables of a project, each change a new version; logs are appended and read through their latest rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.relational import latest_per_key

LOGS = {
    "module_info": "id long, module_name string, directory string, orchestrator string, file_count long, class_count long, style string",
    "design_critic_subtree": "id long, subtree_root string, prompt string, raw_response string, parsed_json string, graph_hash string",
    "design_critic_module": "id long, module_name string, prompt string, raw_response string, parsed_json string, graph_hash string",
    "arch_audit": "id long, payload_json string, graph_hash string",
    "arch_module_review": "id long, module_name string, parsed_json string, graph_hash string",
}
#: When a log's row was written, and when an answer was cached.
CREATED, CACHED = "created", "cached_at"
#: Segments of a version, beyond which they are put together.
SEGMENTS = 32
KEYED = {"llm_cache": (f"prompt_hash string, model string, response string, {CACHED} timestamp", ["prompt_hash", "model"])}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(conf), path

    def _parts(self, name: str) -> list[tuple[int, int]]:
        """(version, segment) of all that was written to its end; segment 0 is a version's own rows, the others were added to it."""
        fs, path = self._files()
        at = path(f"{self.path}/{name}")
        if not fs.exists(at):
            return []
        found = [(m, f"{self.path}/{name}/{m[0]}/_SUCCESS") for f in fs.listStatus(at) if (m := re.fullmatch(r"v(\d+)(?:s(\d+))?", f.getPath().getName()))]
        return sorted((int(m[1]), int(m[2] or 0)) for m, done in found if fs.exists(path(done)))

    def _current(self, name: str) -> list[str]:
        """The folders of the latest version: its rows and what was added to them."""
        parts = self._parts(name)
        top = max((v for v, _ in parts), default=0)
        return [f"{self.path}/{name}/v{v}" + (f"s{k}" if k else "") for v, k in parts if v == top]

    def write(self, name: str, df: DataFrame) -> None:
        """A new version; readers of the old one are not disturbed."""
        df.write.parquet(f"{self.path}/{name}/v{max((v for v, _ in self._parts(name)), default=0) + 1}")

    def add(self, name: str, df: DataFrame) -> None:
        """Rows added to the latest version as a segment of their own: nothing else is written, and an add that breaks off is not seen. Many segments are put together as a new version."""
        parts = self._parts(name)
        top = max((v for v, _ in parts), default=0)
        taken = [int(m[1]) for f in self._listed(name) if (m := re.fullmatch(rf"v{top}s(\d+)", f))]  # broken off ones, too
        df.write.parquet(f"{self.path}/{name}/v{top}s{max(taken, default=0) + 1}")
        if sum(v == top for v, _ in parts) >= SEGMENTS:
            self.write(name, self.table(name))

    def _listed(self, name: str) -> list[str]:
        fs, path = self._files()
        at = path(f"{self.path}/{name}")
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def read(self, name: str) -> DataFrame | None:
        paths = self._current(name)
        return self.spark.read.parquet(*paths) if paths else None

    def table(self, name: str) -> DataFrame:
        """The table, empty if it was never written; only for logs and keyed tables, whose schemas are fixed."""
        schema = f"{LOGS[name]}, {CREATED} timestamp" if name in LOGS else KEYED[name][0]
        paths = self._current(name)
        held = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return held if name in LOGS else latest_per_key(held, KEYED[name][1], [F.col(CACHED), F.col("response")])

    def append(self, name: str, rows: list[tuple]) -> None:
        """Add rows (without id) to a log, numbered on. Logs hold what people and models wrote, so a call brings few rows."""
        top = self.table(name).agg(F.max("id")).first()[0] or 0
        self.add(name, self.spark.createDataFrame([(top + i + 1, *r) for i, r in enumerate(rows)], LOGS[name]).withColumn(CREATED, F.current_timestamp()).coalesce(1))

    def put(self, name: str, rows: DataFrame) -> None:
        """Upsert into a keyed table: the rows are added, and reading takes the last of each key."""
        self.add(name, rows.withColumn(CACHED, F.current_timestamp()).select(*self.spark.createDataFrame([], KEYED[name][0]).columns))

    def latest(self, name: str, key: str) -> DataFrame:
        """A log's last row of each key."""
        return latest_per_key(self.table(name), [key], [F.col("id")])

    def clear(self, *names: str) -> None:
        """An empty new version of each table that exists."""
        for n in names:
            held = self.read(n)
            if held is not None:
                self.write(n, held.limit(0))

    def clear_graph(self) -> None:
        """Forget the graph; module_info and caches stay."""
        self.clear("entities", "relationships")

    def clear_all(self) -> None:
        """Forget the graph and all that was derived from it; caches stay."""
        self.clear("entities", "relationships", *LOGS)
