"""A national load that goes on where it stopped, and reads again only what has changed.

The cells of a file are sums, so they are kept per file below ``cells_by_file`` in the library, in waves
of files that are read together. A wave is a folder of partial cells; a row per file in ``loaded_files``,
written after it, makes it count. A load that is killed leaves whole waves, and a wave without rows is
read again. The cells of the library are the merged partials of the files that are there now.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.functions.recode import recode_microdata
from censemble.operators.cells import merged_cells, weighted_cells
from censemble.plans.library import VERSIONS
from censemble.sources import readers, schemas, writers
from censemble.sources.files import delete, exists, files_of, folders_of, stamps

# Bytes of files that are read together; at most this much is read twice after a loss of the driver.
WAVE_BYTES = 1 << 38


def _parts(library: str) -> str:
    return f"{library.rstrip('/')}/cells_by_file"


def loaded_files(spark: SparkSession, library: str) -> DataFrame:
    """The files whose partial cells are kept, one row for every time a file was read."""
    path = f"{library.rstrip('/')}/loaded_files"
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.LOADED_FILES)
    return spark.read.schema(schemas.LOADED_FILES).parquet(path)


def present_files(spark: SparkSession, folder: str) -> dict[str, tuple[str, int, int]]:
    """Key of a file, from its path, bytes and time of change: (path, bytes, time). Names only, no file is opened."""
    paths = [f for p in readers.national_files(spark, folder) for f in files_of(spark, p)]
    found = {}
    for path, (size, modified) in stamps(spark, paths).items():
        key = hashlib.md5(f"{path}:{size}:{modified}".encode()).hexdigest()
        found[key] = (path, size, modified)
    return found


def waves(files: dict[str, tuple[str, int, int]], wave_bytes: int) -> list[list[str]]:
    """Keys in groups of at most ``wave_bytes``; a longer file is a group of its own."""
    out: list[list[str]] = []
    held = 0
    for key in sorted(files, key=lambda k: files[k]):
        size = files[key][1]
        if not out or held + size > wave_bytes:
            out.append([])
            held = 0
        out[-1].append(key)
        held += size
    return out


def _load_wave(spark: SparkSession, library: str, files: dict[str, tuple[str, int, int]], strict: bool) -> None:
    """Partial cells of these files as one folder, then the rows that make them count."""
    wave = f"w-{uuid.uuid4().hex}"
    people = readers.read_microdata(spark, [path for path, _, _ in files.values()], strict, with_file=True)
    partial = weighted_cells(recode_microdata(people, [readers.FILE]), [readers.FILE])
    partial.withColumnRenamed(readers.FILE, "file").write.parquet(f"{_parts(library)}/{wave}")
    _record(spark, library, [(key, *entry, wave) for key, entry in files.items()])


def _record(spark: SparkSession, library: str, rows: list[tuple]) -> None:
    """Rows that make a wave count, as a single file, which is there as a whole or not at all."""
    record = spark.createDataFrame(rows, schemas.LOADED_FILES).coalesce(1)
    record.write.mode("append").parquet(f"{library.rstrip('/')}/loaded_files")


def _counted(spark: SparkSession, library: str, present: Iterable[str]) -> DataFrame:
    """(wave, file) of the present files, one wave each, if a file was read twice."""
    keys = spark.createDataFrame([(k,) for k in present], "file_key string")
    return (
        loaded_files(spark, library).join(keys, "file_key")
        .groupBy("file_key").agg(F.max(F.struct("wave", F.col("path").alias("file"))).alias("of"))
        .select("of.*")
    )


def _waves_of(counted: DataFrame) -> list[str]:
    return [r.wave for r in counted.select("wave").distinct().collect()]


def _merge(spark: SparkSession, library: str, present: Iterable[str]) -> DataFrame:
    """Cells of the present files. The table of files has a row per file, which the driver has listed anyway, so it
    is broadcast and the cells stay where they are until they are merged."""
    counted = _counted(spark, library, present)
    parts = spark.read.schema(f"file string, {schemas.CELLS}").parquet(
        *[f"{_parts(library)}/{w}" for w in _waves_of(counted)]
    )
    placed = parts.withColumn("wave", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return merged_cells(placed.join(F.broadcast(counted), ["wave", "file"]))


def load_national(
    spark: SparkSession, library: str, folder: str, strict: bool = True, wave_bytes: int = WAVE_BYTES, keep_cells: bool = True,
) -> list[str]:
    """Bring the cells of the library up to the national files in the folder; returns the paths read.

    Files that are loaded and have not changed since are not read; a file that changed replaces its own
    partial cells only; one that is gone no longer counts. ``keep_cells=False`` deletes the waves of which no
    file is present any more. Two loads of one library at once are not meant: the later merge counts.
    """
    present = present_files(spark, folder)
    there = {p.rsplit("/", 1)[-1] for p in folders_of(spark, _parts(library))}
    loaded = loaded_files(spark, library).select("file_key", "wave").collect()
    have = {r.file_key for r in loaded if r.wave in there}
    missing = {k: v for k, v in present.items() if k not in have}
    for keys in waves(missing, wave_bytes):
        _load_wave(spark, library, {k: present[k] for k in keys}, strict)
    writers.replace_cells(_merge(spark, library, present), library)
    writers.record_version(spark, library, "acs", VERSIONS["acs"])
    if not keep_cells:
        forget_waves(spark, library, present)
    return sorted(missing[k][0] for k in missing)


def forget_waves(spark: SparkSession, library: str, present: Iterable[str]) -> list[str]:
    """Delete waves of partial cells that no present file counts from, unfinished ones too."""
    used = set(_waves_of(_counted(spark, library, present)))
    old = [p for p in folders_of(spark, _parts(library)) if p.rsplit("/", 1)[-1] not in used]
    for path in old:
        delete(spark, path)
    return old
