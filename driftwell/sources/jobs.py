"""Saved jobs in a shared folder: discovery, batches of finished tickets, finalizing, and results of three shapes.

A job's folder is ``<label>__job-<32 hex digits>``.  A repetition under way is ``run-NNN.partial.jsonl`` (lines as they
come, in as many files as there were batches); a finished one is ``run-NNN.json`` with one line a ticket, in order.
All paths go through the cluster's file systems.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JOB_ID = re.compile(r"[0-9a-f]{32}")


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def create_job(spark: SparkSession, root: str, label: str, configuration: dict) -> tuple[str, str]:
    """A new job's id and folder, with its configuration beside the runs."""
    job = uuid.uuid4().hex
    name = re.sub(r"[^a-zA-Z0-9._=-]+", "-", label).strip("-") or "job"
    folder = f"{root.rstrip('/')}/{name}__job-{job}"
    write_json(spark, f"{folder}/metadata.json", {"id": job, "configuration": configuration})
    return job, folder


def find_job(spark: SparkSession, root: str, job: str) -> str:
    """The one folder of this job; a malformed id, no folder and several folders are errors."""
    if not JOB_ID.fullmatch(job):
        raise ValueError("a job id is 32 lower-case hex digits")
    fs, place = _fs(spark, f"{root.rstrip('/')}/*__job-{job}")
    found = [s.getPath().toString() for s in fs.globStatus(place) or [] if s.isDirectory()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} folders of job {job}, one expected")
    return found[0]


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON file; readers see the old one or the whole new one, on file systems whose rename can replace (HDFS, a local disk)."""
    fs, place = _fs(spark, path)
    text, temporary = json.dumps(value, indent=2, ensure_ascii=False), f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    if fs.getUri().getScheme() == "file":
        # Hadoop's local rename deletes first, and keeps checksums beside the file.
        to, made = Path(place.toUri().getPath()), Path(_path(spark, temporary).toUri().getPath())
        to.parent.mkdir(parents=True, exist_ok=True)
        made.write_text(text, encoding="utf-8")
        to.with_name(f".{to.name}.crc").unlink(missing_ok=True)
        os.replace(made, to)
        return
    out = fs.create(_path(spark, temporary), True)
    out.write(text.encode())
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, temporary), place, overwrite)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        raise ValueError(f"{path} is missing")
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def run_path(folder: str, run: int) -> str:
    return f"{folder}/run-{run:03d}.json"


def partial_path(folder: str, run: int) -> str:
    return f"{folder}/run-{run:03d}.partial.jsonl"


def commit_batch(rows: DataFrame, folder: str, number: int) -> bool:
    """Write one numbered batch of JSON lines as ``batch=<number>``; whether it was new.

    The batch appears by one rename, whole.  A batch that is there stays as it is, so whoever repeats a number after a
    crash, with whatever rows, adds nothing.  Numbers belong to one writer at a time.
    """
    spark = rows.sparkSession
    fs, place = _fs(spark, f"{folder}/batch={number}")
    if fs.exists(place):
        return False
    temporary = f"{folder}/_tmp-{number}-{uuid.uuid4().hex[:8]}"
    rows.write.json(temporary)
    if not fs.rename(_path(spark, temporary), place):
        raise OSError(f"cannot rename to {place}")
    return True


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of the committed batches with their number as ``batch``; none where nothing has been committed."""
    fs, place = _fs(spark, f"{folder}/batch=*")
    if not fs.globStatus(place):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", folder).option("mode", "FAILFAST").json(f"{folder}/batch=*")


def append_tickets(tickets: DataFrame, folder: str, run: int, batch: int | None = None) -> None:
    """One batch of finished tickets of a repetition under way; a numbered one that is there already adds nothing."""
    if batch is None:
        tickets.write.mode("append").json(partial_path(folder, run))
    else:
        commit_batch(tickets, partial_path(folder, run), batch)


def finalize_run(spark: SparkSession, folder: str, run: int, position: str = "global_position") -> str:
    """Lines of the partial run become the finished one, in order; the partial goes last, so a crash loses nothing.

    Lines are moved as they are; a repeated position (a batch written twice) counts once, lines without one all stay, first.
    """
    partial, final = partial_path(folder, run), run_path(folder, run)
    fs, source = _fs(spark, partial)
    if not fs.exists(source):
        if fs.exists(_path(spark, final)):
            return final
        raise ValueError(f"run {run} has no tickets")
    lines = spark.read.option("recursiveFileLookup", "true").text(partial).filter(F.trim("value") != "")
    place = F.get_json_object("value", f"$.{position}").cast("long").alias("p")
    lines = lines.select(place, "value")
    rows = lines.filter("p is not null").groupBy("p").agg(F.min("value").alias("value")).unionByName(lines.filter("p is null"))
    temporary = f"{folder}/_tmp-run-{run:03d}-{uuid.uuid4().hex[:8]}"
    rows.repartitionByRange(1, "p").sortWithinPartitions("p").select("value").write.text(temporary)  # one repetition, one file
    fs.delete(_path(spark, final), True)
    if not fs.rename(_path(spark, temporary), _path(spark, final)):
        raise OSError(f"cannot rename to {final}")
    fs.delete(source, True)
    return final


def read_result(spark: SparkSession, path: str, schema: str, condition: int = 1, repetition: int = 1) -> DataFrame:
    """Tickets of a saved result, whichever shape it has.

    Lines of tickets (a partial or finished run), one object with ``tickets`` (a run), or one object with ``conditions``
    of ``repetitions`` of ``tickets`` (a suite; numbers count from 1).  No tickets is an error.
    """
    if path.rstrip("/").endswith(".jsonl"):
        rows = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    else:
        whole = spark.read.text(path, wholetext=True).withColumnRenamed("value", "v")
        kinds = whole.select(F.get_json_object("v", "$.tickets").isNotNull().alias("run"), F.get_json_object("v", "$.conditions").isNotNull().alias("suite"))
        found = kinds.agg(F.max("run"), F.max("suite")).first()
        if found[0] or found[1]:
            place = "$.tickets" if found[0] else f"$.conditions[{condition - 1}].repetitions[{repetition - 1}].tickets"
            text = F.get_json_object("v", place)
            rows = whole.select(F.explode(F.from_json(text, f"array<struct<{_struct(schema)}>>", {"mode": "FAILFAST"})).alias("t")).select("t.*")
        else:
            rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no tickets in {path}")
    return rows


def _struct(schema: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def run_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """``(files, bytes)`` of a job's finished runs; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/run-*.json").select("path", "length")
    return files.filter(~F.col("path").rlike(r"/[_.][^/]*$")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def artifact_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes, sha256)`` of every file of a folder, hashed where it is read, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def iso_text(t: Column) -> Column:
    """A timestamp as ISO-8601 in UTC, to the microsecond."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def iso_time(c: Column) -> Column:
    """An ISO-8601 text with any offset as a timestamp; null where it is none."""
    return c.try_cast("timestamp")
