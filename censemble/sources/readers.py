"""Readers: microdata, surveys, measures, library tables and run artifacts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censemble.functions import fixed
from censemble.functions.parsing import strip_text
from censemble.functions.text import bare_measure_id
from censemble.sources import schemas
from censemble.sources.files import csv_headers, current_snapshot, exists, files_of, matching


# Helper columns of a whole scan: the file, and the line if it has too few or too many fields.
FILE, LINE = "__file", "__line"


def _file_name() -> Column:
    """The file of a row. Spark gives an address, in which some characters are numbers; a plus is a plus."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _named_csv(spark: SparkSession, paths: Sequence[str], needed: Sequence[str], whole: bool = False) -> DataFrame:
    """Only the needed columns, by header name and as text; a missing one is an error.

    Spark takes the places of columns from one header, so files are grouped by theirs: each group
    is read with its own schema. Folders stand for their files; files without any line have no rows.
    ``whole``: all fields of a line are parsed, and ``FILE`` and ``LINE`` are added.
    """
    files = [file for path in paths for file in files_of(spark, path)]
    if not files:
        raise FileNotFoundError(f"no files at {list(paths)}")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, header in csv_headers(spark, files).items():
        by_header.setdefault(header, []).append(file)
    # Files without a line say nothing; if none has any, all columns are missing.
    frames = []
    for header, group in (by_header or {(): files}).items():
        missing = [c for c in needed if c not in header]
        if missing:
            raise KeyError(f"columns not found in {group[0]}: {missing}; check the variable names against the codebook")
        # Columns that are not needed may have any names, equal ones too.
        fields = [c if c in needed and header.index(c) == i else f"__{i}" for i, c in enumerate(header)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in fields])
        reader = spark.read.option("header", True)
        if whole:
            reader = reader.schema(schema.add(LINE, T.StringType())).option("columnNameOfCorruptRecord", LINE)
            frames.append(
                reader.option("columnPruning", False).csv(group)
                .select(*needed, _file_name().alias(FILE), LINE)
            )
        else:
            frames.append(reader.schema(schema).csv(group).select(*needed))
    return reduce(DataFrame.unionByName, frames)


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _missing(text: Column) -> Column:
    return text.isNull() | F.trim(text).isin(fixed.MISSING_MARKS)


def _parsed(field: T.StructField, text: Column) -> Column:
    """The number in a text that is not missing; '3.0' reads as 3. Null if it cannot be read."""
    number = text.try_cast("double")
    return number if isinstance(field.dataType, T.DoubleType) else number.try_cast(field.dataType)


def _unreadable(field: T.StructField) -> Column:
    """Whether a text is neither missing nor a number of the column's type."""
    if isinstance(field.dataType, T.StringType):
        return F.lit(False)
    text = F.col(field.name)
    return ~_missing(text) & _parsed(field, text).isNull()


def _typed(frame: DataFrame, ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    """Text columns to declared types. A number that cannot be read is an error when its row is worked
    out; in lenient columns it is null.

    A cell is read inside a ``transform``, which Spark does not compile into one long method with the
    filters and recodes that follow; above 8000 bytes the JVM interprets such a method, at 70 us a row.
    """

    def cast(field: T.StructField, text: Column) -> Column:
        number = _parsed(field, text)
        if field.name not in fixed.LENIENT_COLUMNS:
            told = F.concat(F.lit(f"{field.name}: no number: "), text)
            number = F.coalesce(number, F.raise_error(told).cast(field.dataType))
        return F.when(~_missing(text), number)

    def cell(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StringType):
            return F.col(field.name)
        return F.get(F.transform(F.array(field.name), lambda text: cast(field, text)), 0)

    return frame.select(*[cell(f).alias(f.name) for f in _fields(ddl)], *keep)


def _readable(whole: DataFrame, ddl: str) -> DataFrame:
    """Rows whose line has all its fields and whose numbers can be read."""
    bad = reduce(lambda a, b: a | b, [_unreadable(f) for f in _fields(ddl) if f.name not in fixed.LENIENT_COLUMNS])
    return whole.where(F.col(LINE).isNull() & ~bad)


def _scan(spark: SparkSession, paths: Sequence[str], ddl: str, strict: bool, keep: Sequence[str] = ()) -> DataFrame:
    names = [f.name for f in _fields(ddl)]
    whole = _named_csv(spark, paths, names, whole=not strict or bool(keep))
    return _typed(whole if strict else _readable(whole, ddl), ddl, keep)


def _reasons(spark: SparkSession, paths: Sequence[str], ddl: str) -> DataFrame:
    """What ``strict=False`` leaves out or reads as null: (file, column, text, kept), a row per bad cell.

    A line with too few or too many fields is one row without a column, and its text is the line.
    ``kept``: only a lenient column cannot be read, so the row stays.
    """
    fields = _fields(ddl)
    whole = _named_csv(spark, paths, [f.name for f in fields], whole=True)
    none = F.lit(None).cast("string")
    cells = F.array(*[
        F.when(_unreadable(f), F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("text"))) for f in fields
    ])
    line = F.array(F.struct(none.alias("column"), F.col(LINE).alias("text")))
    bad = F.when(F.col(LINE).isNotNull(), line).otherwise(F.filter(cells, lambda c: c.isNotNull()))
    kept = F.forall("__bad", lambda c: F.coalesce(c["column"].isin(fixed.LENIENT_COLUMNS), F.lit(False)))
    return (
        whole.select(F.col(FILE).alias("file"), bad.alias("__bad"))
        .where(F.size("__bad") > 0)
        .withColumn("kept", kept)
        .select("file", F.inline("__bad"), "kept")
        .select("file", "column", "text", "kept")
    )


def read_microdata(spark: SparkSession, paths: Sequence[str], strict: bool = True, with_file: bool = False) -> DataFrame:
    """Person records from CSV files with a header. Files are split and read in parallel.

    A number that cannot be read is an error when its row is worked out. ``strict=False`` leaves such
    rows out, and lines with too few or too many fields, which only a parse of the whole line shows;
    ``unreadable_microdata`` lists both. ``with_file`` adds the file in ``FILE``.
    """
    return _scan(spark, paths, schemas.MICRODATA, strict, [FILE] if with_file else [])


def unreadable_microdata(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Cells and lines of person files that cannot be read: (file, column, text, kept)."""
    return _reasons(spark, paths, schemas.MICRODATA)


def read_state_microdata(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """One state's person file, psam_p<code>.csv."""
    codes = {usps: f"{code:02d}" for code, usps in fixed.FIPS_STATES.items()}
    if state not in codes:
        raise ValueError(f"unknown state {state!r}")
    path = f"{folder.rstrip('/')}/psam_p{codes[state]}.csv"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_microdata(spark, [path])


def national_files(spark: SparkSession, folder: str) -> list[str]:
    """All psam_pus*.csv files, from the csv_pus folder if it has any."""
    for place in (f"{folder.rstrip('/')}/csv_pus", folder.rstrip("/")):
        found = matching(spark, f"{place}/psam_pus*.csv")
        if found:
            return found
    raise FileNotFoundError(f"no psam_pus*.csv below {folder}")


def read_national_microdata(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Person records of all national files."""
    return read_microdata(spark, national_files(spark, folder), strict)


def read_label_survey(spark: SparkSession, path: str) -> DataFrame:
    """Text-label survey, the mapped columns only; refuses to guess if one is missing."""
    return _named_csv(spark, [path], list(fixed.LABEL_SURVEY.values()))


_CODED = ", ".join(f"{n} double" for n in fixed.CODED_SURVEY.values())


def read_coded_survey(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Numeric-coded survey from Parquet or CSV, as doubles. CSV text that is no number is an error, or
    with ``strict=False`` its row is left out and listed by ``unreadable_coded_survey``."""
    names = list(fixed.CODED_SURVEY.values())
    if path.rstrip("/").endswith(".csv"):
        return _scan(spark, [path], _CODED, strict)
    frame = spark.read.parquet(path)
    missing = [c for c in names if c not in frame.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}; check the variable names against the codebook")
    return frame.select(*[F.col(n).cast("double").alias(n) for n in names])


def unreadable_coded_survey(spark: SparkSession, path: str) -> DataFrame:
    """Cells and lines of a coded survey in CSV that cannot be read: (file, column, text, kept)."""
    return _reasons(spark, [path], _CODED)


def with_measure_defaults(raw: DataFrame) -> DataFrame:
    """Measure definitions with trimmed text and defaults for what is left out."""
    none = F.array().cast("array<string>")
    truth = F.col("ground_truth")
    return raw.select(
        "measure_id",
        bare_measure_id(F.col("measure_id")).alias("file_id"),
        "title",
        strip_text(F.col("framing")).alias("framing"),
        strip_text(F.col("briefing")).alias("briefing"),
        *[F.coalesce(F.col(c), none).alias(c) for c in ("briefing_sources", "pro_arguments", "con_arguments")],
        F.coalesce(F.col("n_rounds"), F.lit(fixed.DEFAULT_ROUNDS)).alias("n_rounds"),
        F.coalesce(truth["yes_pct"], F.lit(50.0)).alias("yes_pct"),
        F.coalesce(truth["no_pct"], F.lit(50.0)).alias("no_pct"),
        F.coalesce(truth["passed"], F.lit(False)).alias("passed"),
        "segment_results", "state", "year", "topic",
    )


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    """Measures from JSON lines."""
    return with_measure_defaults(spark.read.schema(schemas.MEASURES).json(path))


def list_measures(measures: DataFrame) -> DataFrame:
    """Distinct measure file ids in order."""
    return measures.select(F.col("file_id").alias("measure_id")).distinct().orderBy("measure_id")


def read_table(spark: SparkSession, library: str, name: str) -> DataFrame:
    """A persona-library table; an absent one reads as empty with its declared schema."""
    path = f"{library.rstrip('/')}/{name}"
    ddl = schemas.TABLES[name]
    if name in schemas.SNAPSHOTS and (snapshot := current_snapshot(spark, path)):
        path = f"{path}/{snapshot}"
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version per source; equal times go to the greater version text."""
    newest = F.max(F.struct("loaded_at", "version")).alias("__last")
    return versions.groupBy("source_name").agg(newest).select(
        "source_name", F.col("__last.version").alias("version"), F.col("__last.loaded_at").alias("loaded_at")
    )


def versions_map(versions: DataFrame) -> DataFrame:
    """One row with a map source -> newest version. The number of sources is that of the loaders."""
    entries = F.array_sort(F.collect_list(F.struct("source_name", "version")))
    return latest_versions(versions).agg(F.map_from_entries(entries).alias("source_versions"))


def source_versions(spark: SparkSession, library: str) -> dict[str, str]:
    """The newest versions as a driver-side dict, one entry per loader."""
    found = versions_map(read_table(spark, library, "source_versions")).first()
    return dict(found["source_versions"] or {})


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Run artifacts written by ``write_artifacts``."""
    return spark.read.schema(schemas.ARTIFACT).json(path)


def artifact_votes(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("measure_id", "seed", F.inline("votes"))


def artifact_statements(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("measure_id", "seed", F.inline("statements"))


def artifact_personas(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("measure_id", "seed", F.inline("personas")).select(
        "measure_id", "seed", "draw_no", "persona_id", "demographics.*", "priors.*"
    )
