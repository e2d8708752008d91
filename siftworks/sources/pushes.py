"""A sink of what an external table is to be told: `pending_pushes`, and reading it back.

Each run that has something to say is a folder <path>/run=<id> of JSON lines beside a manifest of what was created, refreshed and skipped.
Tasks write aside; the run appears when all of them are done, and a run that fails leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.sync import written_wrong
from .captured import _store, remove

ACTIONS = {"create": "created", "refresh": "refreshed", "skip_resolved": "skipped"}


@dataclass
class Told(WriterCommitMessage):
    """What a task has written, and where."""

    file: str | None
    created: int
    refreshed: int
    skipped: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], options["run"]

    def write(self, rows: Iterator) -> Told:
        store, root = _store(self.path)
        counts, file, out = dict.fromkeys(ACTIONS.values(), 0), None, None
        try:
            for row in rows:
                counts[ACTIONS[row["action"]]] += 1
                if row["action"] == "skip_resolved":
                    continue
                if out is None:
                    store.create_dir(f"{root}/_staging-{self.run}")
                    file = f"{root}/_staging-{self.run}/{uuid.uuid4().hex}.json"
                    out = store.open_output_stream(file)
                line = {"url": row["url"], "action": row["action"], "digest": row["digest"], "properties": json.loads(row["properties"])}
                out.write((json.dumps(line, ensure_ascii=False) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Told(file, **counts)

    def commit(self, messages: list[Told | None]) -> None:
        """A run is what its manifest lists; it is written last."""
        store, root = _store(self.path)
        done = [m for m in messages if m]
        totals = {name: sum(getattr(m, name) for m in done) for name in ACTIONS.values()}
        files = [m.file for m in done if m.file]
        if files:
            to = f"{root}/run={self.run}"
            store.create_dir(to)
            for file in files:
                store.move(file, f"{to}/{file.rsplit('/', 1)[1]}")
            with store.open_output_stream(f"{to}/_manifest.json") as out:
                out.write(json.dumps(totals | {"files": sorted(f.rsplit("/", 1)[1] for f in files)}).encode())
        self.abort(messages)

    def abort(self, messages: list) -> None:
        remove(self.path, f"_staging-{self.run}")


class PendingPushes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pending_pushes"

    def schema(self) -> str:
        return "url string, action string, digest string, properties string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def manifest(path: str, run: str) -> dict:
    """created, refreshed, skipped and files of a run; all zero if it had nothing to tell."""
    from pyarrow import fs

    store, root = _store(path)
    file = f"{root}/run={run}/_manifest.json"
    if store.get_file_info(file).type == fs.FileType.NotFound:
        return dict.fromkeys(ACTIONS.values(), 0) | {"files": []}
    with store.open_input_stream(file) as stream:
        return json.loads(stream.readall())


def pushed(spark: SparkSession, path: str) -> DataFrame:
    """What all whole runs have told: url, action, digest, properties (JSON), run."""
    from pyarrow import fs

    store, root = _store(path)
    schema, runs = "url string, action string, digest string, properties string, run string", []
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("run=") and store.get_file_info(f"{root}/{f.base_name}/_manifest.json").type != fs.FileType.NotFound:
            runs.append(f"{path.rstrip('/')}/{f.base_name}")
    if not runs:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(runs, pathGlobFilter="*.json").where(~F.col("_metadata.file_name").startswith("_")).select("value", F.regexp_extract("_metadata.file_path", "/run=([^/]+)/", 1).alias("run"))
    get = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return lines.select(get("url"), get("action"), get("digest"), get("properties"), "run")


def push_pending(acted: DataFrame, path: str, properties: list[str], url: str = "url", run: str | None = None) -> dict:
    """Tell what acted (sync.actions) creates or refreshes: each url with the named properties, unless an earlier run has told the very
    same of it. Of rows that repeat a url the one whose properties' text is greatest is told. What was written is read back and held
    against what was sent; a difference is an error. Returns the run's manifest with its id."""
    spark, run = acted.sparkSession, run or uuid.uuid4().hex
    spark.dataSource.register(PendingPushes)
    known = acted.where(F.col("action").isin(*ACTIONS)).select(F.col(url).alias("url"), "action", F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}).alias("properties"))
    known = known.groupBy("url").agg(F.max(F.struct("properties", "action")).alias("_r")).select("url", "_r.action", "_r.properties").withColumn("digest", F.sha2(F.concat_ws("|", "url", "properties"), 256))
    told = pushed(spark, path).select("url", "digest").distinct()
    new = known.join(told, ["url", "digest"], "left_anti").select("url", "action", "digest", "properties")
    new.write.format("pending_pushes").option("run", run).mode("append").save(path)
    out = manifest(path, run) | {"run": run}
    if out["files"]:
        sent = known.where("action <> 'skip_resolved'").join(told, ["url", "digest"], "left_anti").select("url", "digest")
        back = pushed(spark, path).where(F.col("run") == run).select("url", "digest")
        # pushed() has this run by now, so what was sent is told by its digests alone.
        wrong = written_wrong(sent.join(back.select("url"), "url", "left_semi"), back, ["url"], ["digest"]).count()
        if wrong or back.count() != out["created"] + out["refreshed"]:
            raise RuntimeError(f"run {run}: {wrong} urls are not there as they were sent")
    return out
