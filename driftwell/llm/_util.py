"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.session import delete, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null text as empty; whatever else the table carries is not read."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: A group of more than one in ``HOT`` rows is hot; there are at most ``HOT`` of them.
HOT = 4096


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group, null where there is none; ``groups`` holds ``size`` members for each key.

    A group of more than one in ``HOT`` of the ``total`` rows comes by broadcast, at most ``HOT`` rows by that, so its
    members stay where they are; in the shuffle of the others no key has more rows than that.  ``rows`` is read
    twice: pass a table.
    """
    groups = groups.withColumnRenamed(key, "_group_key")
    is_hot = F.col(size) * F.lit(HOT) > F.lit(total)
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    same = F.col(key) == F.col("_group_key")
    near = rows.join(F.broadcast(hot), same)
    far = rows.join(F.broadcast(hot.select("_group_key")), same, "left_anti").join(cold, same, "left")
    return near.unionByName(far).drop("_group_key")


LIGHT_BYTES = 8 << 20


def light(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """A stored table of numbers, marked for broadcast if its rows, counted, take at most ``LIGHT_BYTES``."""
    return F.broadcast(df) if df.count() * row_bytes <= LIGHT_BYTES else df


class Scratch:
    """Tables in the shared folder for one operator's steps, deleted as soon as what was made of them is written.

    ``keep`` writes a table and reads it back, so a lost executor costs a reread; ``drop`` deletes tables.
    """

    def __init__(self):
        self.paths: set[str] = set()

    def keep(self, df: DataFrame, label: str, compression: str = "snappy", fewer: int = 1) -> DataFrame:
        """``fewer`` divides the number of files: narrow tables of numbers need no task for each partition of a shuffle."""
        path = shared_dir(df.sparkSession, label)
        if fewer > 1:
            df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // fewer))
        out = stored(df, label, compression, path)
        out._scratch = path
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = None if df is None else df.__dict__.get("_scratch")
            if path in self.paths:
                self.paths.remove(path)
                delete(df.sparkSession, path)


def commit(folder: str, moves: dict[str, str], manifest: object) -> None:
    """Give the files that successful tasks reported their names, drop those of failed attempts, then write the manifest."""
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    stale = [x.path for x in files.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith("_tmp-") and x.base_name not in moves]
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda m: files.move(f"{root}/{m[0]}", f"{root}/{m[1]}"), moves.items()))
        list(pool.map(files.delete_file, stale))
    with files.open_output_stream(f"{root}/_tmp-manifest") as f:
        f.write(json.dumps(manifest).encode())
    files.move(f"{root}/_tmp-manifest", f"{root}/_MANIFEST.json")


def release_memory() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow; at a task's end its worker, which lives on, gives freed memory back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped
