"""File-system steps on whatever storage the path names (local, HDFS, object store)."""

from __future__ import annotations

import csv
import time
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted; none if the folder is missing."""
    path, fs = _path(spark, pattern)
    found = fs.globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The path itself, or the visible files of a folder, sorted."""
    made, fs = _path(spark, path)
    if not fs.exists(made):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(made).isDirectory():
        return [path]
    found = [s.getPath() for s in fs.listStatus(made) if s.isFile()]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))


def stamps(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Bytes and time of change (milliseconds) of each file, which tell whether it is still the same."""
    found = {}
    for path in paths:
        made, fs = _path(spark, path)
        status = fs.getFileStatus(made)
        found[path] = (status.getLen(), status.getModificationTime())
    return found


def folders_of(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, sorted; none if it is missing."""
    made, fs = _path(spark, path)
    if not fs.exists(made):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(made) if s.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    made, fs = _path(spark, path)
    fs.delete(made, True)


# Larger than any file, so that a file is one partition of a scan.
_WHOLE_FILE = 1 << 40


def csv_headers(spark: SparkSession, files: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Column names in the first line that is not blank, of each CSV file that has one; compressed ones too.

    A Spark job with a task per file, which ends with the file's first lines; the driver opens no file and
    gets one line of each. The job runs in a session of its own, as its partitions have other sizes.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE_FILE)
    own.conf.set("spark.sql.files.openCostInBytes", _WHOLE_FILE)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)

    def first_lines(batches):
        sought = True
        for number, batch in enumerate(batches):
            for at, line in enumerate(batch.column(0).to_pylist() if sought else []):
                if line.strip():
                    yield batch.slice(at, 1)
                    sought = False
                    break
            # Small files are read to their end, as a worker that leaves rows unread is not used again.
            if not sought and number > 10:
                return

    lines = own.read.text(list(files)).select("value", "_metadata.file_path", "_metadata.file_block_start")
    begins = lines.where("file_block_start = 0").select("value", "file_path")
    found = begins.mapInArrow(first_lines, "value string, file_path string").collect()
    # Spark gives paths as addresses.
    by_path = {unquote(r.file_path): r.value for r in found}
    named = {f: by_path.get(_path(spark, f)[1].makeQualified(_path(spark, f)[0]).toString()) for f in files}
    return {f: tuple(next(csv.reader([line.lstrip("\ufeff")]))) for f, line in named.items() if line is not None}


def exists(spark: SparkSession, path: str) -> bool:
    made, fs = _path(spark, path)
    return fs.exists(made)


# Name of the file that says which snapshot of a table is current.
POINTER = "_current"
DEAD_SECONDS = 4


class SnapshotConflict(OSError):
    """Another writer has replaced the table in the meantime."""


def _read_text(fs, path) -> str | None:
    jvm_path = path
    if not fs.exists(jvm_path):
        return None
    stream = fs.open(jvm_path)
    try:
        # Pointers are a few dozen bytes.
        return bytes(stream.readNBytes(4096)).decode()
    finally:
        stream.close()


def _version_of(name: str) -> int:
    return int(name.split("-")[1])


def current_snapshot(spark: SparkSession, table: str) -> str | None:
    """The name of the table's current snapshot; null if it has none.

    Snapshots are folders ``v-<number>-<writer>``. A pointer file ``_current-<number>`` holds the name;
    the highest number counts. Pointers are made with create-if-absent, which one writer of a number
    wins, and never changed, so a reader sees an old table or a new one and nothing between.
    """
    folder, fs = _path(spark, table)
    if not fs.exists(folder):
        return None
    numbers = [n for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith(f"{POINTER}-")]
    for name in sorted(numbers, key=_version_of, reverse=True):
        found = _read_text(fs, _path(spark, f"{table}/{name}")[0])
        # A pointer without its text is of a writer that stopped before it had committed.
        if found and found.endswith("\n"):
            return found[:-1]
    return None


def read_snapshot(spark: SparkSession, table: str, name: str | None = None) -> DataFrame:
    """The rows of the current snapshot, or of a named one that is still there."""
    chosen = name or current_snapshot(spark, table)
    if chosen is None:
        raise FileNotFoundError(f"{table} has no snapshot")
    return spark.read.parquet(f"{table}/{chosen}")


def replace_snapshot(df: DataFrame, table: str, expected: str | None = None, check: bool = False, keep: int = 2) -> str:
    """Write ``df`` as the table's next snapshot and make it the current one; returns its name.

    The rows may come from the table itself. Everything is written before the pointer, so a writer
    that fails leaves the table as it was. ``check``: only replace the snapshot ``expected`` (null for
    a new table). Two writers that started from one snapshot cannot both win; the one that comes
    second gets a ``SnapshotConflict`` and its rows go. The last ``keep`` snapshots stay for readers that
    have begun on them.
    """
    spark = df.sparkSession
    folder, fs = _path(spark, table)
    base = current_snapshot(spark, table)
    if check and base != expected:
        raise SnapshotConflict(f"{table} is at {base}, not at {expected}")
    number = 1 + (_version_of(base) if base else 0)
    name = f"v-{number:012d}-{uuid.uuid4().hex}"
    written, _ = _path(spark, f"{table}/{name}")
    try:
        df.write.mode("errorifexists").parquet(f"{table}/{name}")
        _commit(spark, fs, table, number, name)
    except BaseException:
        fs.delete(written, True)
        raise
    _forget(spark, fs, table, keep)
    return name


def _commit(spark: SparkSession, fs, table: str, number: int, name: str) -> None:
    """Make the pointer of this number, unless another writer has it.

    A pointer that stays without text for ``DEAD_SECONDS`` is of a writer that has died, and goes.
    """
    pointer, _ = _path(spark, f"{table}/{POINTER}-{number:012d}")
    for turn in range(10):
        try:
            stream = fs.create(pointer, False)
            break
        except Exception as taken:
            if turn == 9 or _read_text(fs, pointer):
                raise SnapshotConflict(f"snapshot {number} of {table} is another writer's") from taken
            time.sleep(DEAD_SECONDS / 8)
            if turn == 8:
                fs.delete(pointer, False)
    try:
        stream.write(bytearray(f"{name}\n".encode()))
    finally:
        stream.close()


def _forget(spark: SparkSession, fs, table: str, keep: int) -> None:
    """Delete snapshots and pointers older than the last ``keep``; unfinished newer ones stay."""
    newest = _version_of(current_snapshot(spark, table))
    for status in fs.listStatus(_path(spark, table)[0]):
        name = status.getPath().getName()
        if name.startswith(("v-", f"{POINTER}-")) and _version_of(name) <= newest - keep:
            fs.delete(status.getPath(), True)
