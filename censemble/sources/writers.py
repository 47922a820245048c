"""Writers: library tables, source versions, run artifacts and gated reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censemble.functions.policy import OUTPUT, gate_output, with_first_match
from censemble.operators.skew import lookup_join
from censemble.sources import schemas
from censemble.sources.files import exists, replace_snapshot

# Entries and bytes of text of one kind per artifact record. Most runs fit one record; longer ones
# go on in further parts, and long texts in further slices of a part, so no record grows with its run.
ARTIFACT_PART = 10_000
ARTIFACT_BYTES = 32_000_000


def _as_table(df: DataFrame, name: str) -> DataFrame:
    fields = T.StructType.fromDDL(schemas.TABLES[name]).fields
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fields])


def create_library(spark: SparkSession, library: str) -> None:
    """Make every library table that is not there yet, empty."""
    for name, ddl in schemas.TABLES.items():
        path = f"{library.rstrip('/')}/{name}"
        if not exists(spark, path):
            empty = spark.createDataFrame([], ddl)
            if name in schemas.SNAPSHOTS:
                replace_snapshot(empty, path)
            # A partitioned write of no rows leaves no folder, so cells start on first load.
            elif name != "cells":
                empty.write.parquet(path)


def replace_states(cells: DataFrame, library: str) -> None:
    """Replace the cells of the states that occur in ``cells``; other states stay."""
    (
        _as_table(cells, "cells")
        .repartition("state", F.pmod(F.xxhash64("puma"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("state")
        .parquet(f"{library.rstrip('/')}/cells")
    )


def replace_cells(cells: DataFrame, library: str) -> None:
    """Replace the whole cell table, as a national load does."""
    (
        _as_table(cells, "cells")
        .repartition("state", F.pmod(F.xxhash64("puma"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("state")
        .parquet(f"{library.rstrip('/')}/cells")
    )


def replace_table(df: DataFrame, library: str, name: str) -> str:
    """Replace a whole table that is kept in snapshots; returns the new snapshot's name.

    The rows may come from the table itself. Readers see the old rows until the new ones are
    complete, and a writer that fails, or that another one has overtaken, changes nothing.
    """
    if name not in schemas.SNAPSHOTS:
        raise ValueError(f"{name} is not kept in snapshots")
    return replace_snapshot(_as_table(df, name), f"{library.rstrip('/')}/{name}")


def record_version(
    spark: SparkSession, library: str, source_name: str, version: str, loaded_at: Column | None = None
) -> None:
    """Append a version row; readers take the newest per source, which makes this an upsert."""
    row = spark.range(1).select(
        F.lit(source_name).alias("source_name"),
        F.lit(version).alias("version"),
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("loaded_at"),
    )
    _as_table(row, "source_versions").write.mode("append").parquet(
        f"{library.rstrip('/')}/source_versions"
    )


def run_artifacts(
    reports: DataFrame, statements: DataFrame, votes: DataFrame, personas: DataFrame,
    part_size: int = ARTIFACT_PART, slice_bytes: int = ARTIFACT_BYTES,
) -> DataFrame:
    """Nested records per run (measure_id, seed), part and slice: report, statements, votes, personas.

    ``reports``: measure_id, seed, report (JSON text). Entries go to part seq div part_size, and
    within a part to a further slice each time ``slice_bytes`` of text are full, so every list is
    bounded and in order; only a single longer text makes a longer record. A run whose report text
    is refused has no record at all.
    """
    run = ["measure_id", "seed"]

    def listed(df: DataFrame, order: str, ddl: str, out: str, text: str | None) -> DataFrame:
        entry_type = T.StructType.fromDDL(f"x {ddl}").fields[0].dataType
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in entry_type.fields]
        entry = F.struct(F.col(order).cast("bigint").alias(order), *columns[1:])
        parted = df.withColumn("part", F.floor(F.col(order) / part_size).cast("bigint"))
        if text is None:
            sliced = parted.withColumn("slice", F.lit(0))
        else:
            # A part has at most part_size rows, so this window is bounded.
            upto = W.partitionBy(*run, "part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
            bytes_before = F.coalesce(F.sum(F.octet_length(text)).over(upto), F.lit(0))
            sliced = parted.withColumn("slice", F.floor(bytes_before / slice_bytes).cast("int"))
        return sliced.groupBy(*run, "part", "slice").agg(F.sort_array(F.collect_list(entry)).alias(out))

    nested = personas.select(
        *run, "draw_no", "persona_id",
        F.struct("age_band", "sex", "race_eth", "education", "income_band", "puma", "state").alias("demographics"),
        F.struct(
            "party_id", "p_climate_action_support", "p_gun_restriction_support",
            "p_tax_on_rich_support", "ideology_score",
        ).alias("priors"),
    )
    key = [*run, "part", "slice"]
    kinds = [
        listed(statements, "seq", schemas.STATEMENT, "statements", "text"),
        listed(votes, "seq", schemas.VOTE, "votes", "rationale"),
        listed(nested, "draw_no", schemas.PERSONA, "personas", None),
    ]
    names = ["statements", "votes", "personas"]
    # Each kind has one row per key already, so one grouped union puts them side by side.
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    lists = tall.groupBy(*key).agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    checked = with_first_match(reports, "report", OUTPUT, "__pattern")
    refused = checked.where(F.col("__pattern").isNotNull()).select(*run, F.lit(True).alias("__refused"))
    first = gate_output(reports, "report").select(
        *run, F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("slice"), "report"
    )
    kept = lookup_join(lists, refused, run, "left").where(F.col("__refused").isNull())
    return kept.join(first, key, "full").select(
        *key, "report", *[F.coalesce(F.col(c), F.array()).alias(c) for c in ("statements", "votes", "personas")]
    )


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Artifacts as JSON by measure and seed, a file per record.

    A run that is written again replaces its records; other runs at the path stay.
    """
    n = int(artifacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        artifacts.repartition(n, "measure_id", "seed", "part", "slice")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 1)
        .partitionBy("measure_id", "seed")
        .json(path)
    )


# Columns of result tables that hold ids and labels, not free text.
LABEL_COLUMNS = (
    "measure_id", "file_id", "run_id", "group_id", "persona_id", "speaker_id", "axis", "value", "flag", "model",
    "model_version", "provider", "lowest_model", "highest_model", "state", "topic", "prompt_kind",
)


def write_report(report: DataFrame, path: str, text_columns: Sequence[str] | None = None) -> None:
    """A result table as JSON; rows whose text is refused are not written.

    ``text_columns`` default to all string columns but ids and labels.
    """
    if text_columns is None:
        text_columns = [n for n, t in report.dtypes if t == "string" and n not in LABEL_COLUMNS]
    kept = report
    for column in text_columns:
        kept = gate_output(kept, column)
    kept.write.mode("overwrite").json(path)
