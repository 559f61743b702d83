"""Training samples by session: appends that count once, a catalog, finishing and removing.

A data source of its own (``session_samples``) writes appends. Each task
writes one file, under a name that no other attempt has, and says so in its
commit message; when all tasks are done, one small entry of the log lists
the files. Only listed files count, so the files of failed, repeated or
speculative tasks are never seen. An entry has the append's name: the same
append again finds its entry and throws its own files away, appends at the same
time have entries of their own, and a reader sees whole appends only.

Reading joins the files with the log by their names, both as Spark tables:
neither files nor sessions are listed on the driver, and counts read one
column. Removing a session is an entry, too, that hides what was appended
before it. An entry holds one file name a task; appends that are small and
very many should be merged by the caller (append the rows read, under one name,
to a new folder).

Defined results: samples without a session belong to session ''; a null
sample is the JSON null. Rows that repeat are samples each. A folder without
an append has no sessions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILE = "session_id string, sample string"
_ENTRY = "id string, at double, files array<string>, removed string"


class SessionNotFound(LookupError):
    """A session that has no sample."""


@dataclass
class Written(WriterCommitMessage):
    """The file of one task; none if it had no row."""

    file: str | None


def _store(path: str):
    """The file system of a path and the path in it; for what Python itself writes (local and shared folders, and all that Arrow can open)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def _put(path: str, entry: dict) -> None:
    """An entry of the log: there as a whole or not at all."""
    store, root = _store(path)
    store.create_dir(f"{root}/log", recursive=True)
    draft, final = f"{root}/log/_{uuid.uuid4().hex}", f"{root}/log/{entry['id']}.json"
    with store.open_output_stream(draft) as out:
        out.write((json.dumps(entry) + "\n").encode())
    store.move(draft, final)


class SampleWriter(DataSourceArrowWriter):
    def __init__(self, path: str, append_id: str):
        self.path, self.append_id = path, append_id

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, root = _store(self.path)
        name, out = f"{self.append_id}-{uuid.uuid4().hex}.parquet", None
        schema = pa.schema([("session_id", pa.string()), ("sample", pa.string())])
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(f"{root}/data", recursive=True)
                out = pq.ParquetWriter(store.open_output_stream(f"{root}/data/{name}"), schema, compression="zstd")
            out.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())], schema=schema))
        if out is None:
            return Written(None)
        sink = out.file_handle or None
        out.close()
        if sink is not None:
            sink.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/log/{self.append_id}.json").type == fs.FileType.File:
            self.abort(messages)  # this append is there already
        else:
            _put(self.path, {"id": self.append_id, "at": time.time(), "files": [m.file for m in messages if m is not None and m.file], "removed": None})

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/data/{m.file}")


class SessionSamples(DataSource):
    """Writes (session_id, sample) to a folder; options: path, append_id."""

    @classmethod
    def name(cls) -> str:
        return "session_samples"

    def schema(self) -> str:
        return FILE

    def writer(self, schema, overwrite: bool) -> SampleWriter:
        if overwrite:
            raise ValueError("samples are appended; remove_session takes them away")
        return SampleWriter(self.options["path"], self.options["append_id"])


def append_samples(df: DataFrame, path: str, append_id: str) -> DataFrame:
    """Append (session_id, sample) once, whatever the number of tries under this name; (session_id, samples) so far of the sessions appended to."""
    spark = df.sparkSession
    if not append_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError("an append's name is letters, digits, - and _")
    spark.dataSource.register(SessionSamples)
    rows = df.select(F.coalesce(F.col("session_id").cast("string"), F.lit("")).alias("session_id"), F.coalesce("sample", F.lit("null")).alias("sample"))
    rows.write.format("session_samples").option("path", path).option("append_id", append_id).mode("append").save()
    touched = rows.select("session_id").distinct()
    return touched.join(catalog(spark, path), "session_id").select("session_id", "samples")


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(_ENTRY).json(f"{path}/log") if there else None


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, sample, append_id, at) of all that counts."""
    log = _log(spark, path)
    if log is None:
        return spark.createDataFrame([], f"{FILE}, append_id string, at double")
    listed = log.where("removed is null").select(F.col("id").alias("append_id"), "at", F.explode("files").alias("file_"))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{FILE}, append_id string, at double")
    rows = spark.read.schema(FILE).parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("file_"))
    rows = rows.join(listed, "file_").drop("file_")
    gone = log.where("removed is not null").groupBy(F.col("removed").alias("r_")).agg(F.max("at").alias("until"))
    return rows.join(gone, F.col("session_id") == F.col("r_"), "left").where("until is null or at > until").drop("r_", "until")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, samples, appends, created_at, updated_at) of every session."""
    rows = samples(spark, path).groupBy("session_id")
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("append_id").alias("appends"), F.timestamp_seconds(F.min("at")).alias("created_at"), F.timestamp_seconds(F.max("at")).alias("updated_at"))


def session_info(spark: SparkSession, path: str, session_id: str) -> dict | None:
    """A session's row of the catalog, or None."""
    found = catalog(spark, path).where(F.col("session_id") == session_id).first()
    return found.asDict() if found else None


def sample_count(spark: SparkSession, path: str, session_id: str) -> int:
    info = session_info(spark, path, session_id)
    return info["samples"] if info else 0


def session_exists(spark: SparkSession, path: str, session_id: str) -> bool:
    return not samples(spark, path).where(F.col("session_id") == session_id).isEmpty()


def finalize(spark: SparkSession, path: str, session_id: str) -> str:
    """Write a session's samples, one JSON value a line, and return their folder; ``SessionNotFound`` if it has none."""
    if not session_exists(spark, path, session_id):
        raise SessionNotFound(f"no session {session_id!r}")
    target = f"{path}/finished/{uuid.uuid5(uuid.NAMESPACE_URL, session_id).hex}/train.jsonl"
    samples(spark, path).where(F.col("session_id") == session_id).select(F.col("sample").alias("value")).write.mode("overwrite").text(target)
    return target


def remove_session(path: str, session_id: str) -> bool:
    """Hide all samples that a session has now; true, also for sessions that never were."""
    _put(path, {"id": f"removal-{uuid.uuid4().hex}", "at": time.time(), "files": [], "removed": session_id})
    return True
