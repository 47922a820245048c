"""Weighted, reproducible draws of personas from the cell pool."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censemble.functions import fixed
from censemble.functions.recode import SKELETON
from censemble.functions.uniform import hash_draw, unit_draw
from censemble.operators.cells import k_anonymous
from censemble.operators.priors import (
    PARTY_KEY,
    PRIOR_VALUES,
    usable_party_shares,
    with_party,
    with_priors,
)
from censemble.operators.skew import HOT_ROWS, numbered_rows
from censemble.session import stored

_CELL = ["age_band", "sex", "race_eth", "education", "income_band"]


def weight_intervals(pool: DataFrame) -> DataFrame:
    """Adds ``lo`` and ``hi``: the cell's half-open range of cumulative integer weight.

    Cells are laid out by state, area and skeleton. Offsets are built in three levels, each
    bounded by its key domain: 51 states, the five-digit areas of a state, and the 1000
    skeletons of an area. Cells without weight are never drawn and are left out.

    The pool is stored, which runs a job: it is read several times and small beside the microdata, as
    the skeleton domain bounds it. Each total of weights would read the microdata again.
    """
    weighted = stored(pool, "pool").withColumn("w", F.col("person_weight").cast("bigint")).where(F.col("w") > 0)
    areas = weighted.groupBy("state", "puma").agg(F.sum("w").alias("area_w"))
    states = areas.groupBy("state").agg(F.sum("area_w").alias("state_w"))

    def before(window, column: str) -> Column:
        return F.coalesce(
            F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint")
        )

    state_lo = states.select("state", before(W.orderBy("state"), "state_w").alias("state_lo"))
    area_lo = areas.select(
        "state", "puma", before(W.partitionBy("state").orderBy("puma"), "area_w").alias("area_lo")
    ).join(F.broadcast(state_lo), "state")
    in_area = before(W.partitionBy("state", "puma").orderBy(*_CELL), "w")
    return (
        weighted.withColumn("__in_area", in_area)
        .join(area_lo, ["state", "puma"])
        .withColumn("lo", F.col("state_lo") + F.col("area_lo") + F.col("__in_area"))
        .withColumn("hi", F.col("lo") + F.col("w"))
        .drop("__in_area", "state_lo", "area_lo", "w")
    )


def scope_of(state: Column) -> Column:
    return F.when(F.upper(state).isin(fixed.NATIONAL_SCOPES), "US").otherwise(state)


def scope_layout(
    intervals: DataFrame, specs: DataFrame, hot_rows: int = HOT_ROWS, strict: bool = True
) -> DataFrame:
    """Per scope in use (at most 51 states and 'US'): its weight range, the width of its buckets
    and the number of slices per bucket.

    Buckets have equal weight and number about as many as the scope's cells, so each meets
    about (draws / cells) draws; slices keep that below ``hot_rows``.
    """
    by_state = intervals.groupBy("state").agg(
        F.min("lo").alias("scope_lo"), F.max("hi").alias("scope_hi"), F.count(F.lit(1)).alias("cells")
    )
    national = by_state.agg(
        F.lit("US").alias("scope"), F.min("scope_lo").alias("scope_lo"),
        F.max("scope_hi").alias("scope_hi"), F.sum("cells").alias("cells"),
    )
    scopes = by_state.withColumnRenamed("state", "scope").unionByName(national).where("cells > 0")
    asked = specs.groupBy(scope_of(F.col("state")).alias("scope")).agg(F.sum("n").alias("draws"))
    told = F.concat(F.lit("no cells with enough records in scope "), F.col("scope"))
    high = F.when(F.col("scope_hi").isNull(), F.raise_error(told).cast("bigint")).otherwise(F.col("scope_hi"))
    size = high - F.col("scope_lo")
    if not strict:
        asked = asked.join(scopes.select("scope"), "scope", "leftsemi")
    return asked.join(scopes, "scope", "left").select(
        "scope", "scope_lo", size.alias("size"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(size / F.col("cells"))).alias("width"),
        F.ceil(F.col("draws") / F.col("cells") / hot_rows).cast("int").alias("slices"),
    )


def empty_scopes(cells: DataFrame, specs: DataFrame, k: int = fixed.K_ANONYMITY_MIN) -> DataFrame:
    """Specs whose scope has no cell that may be drawn."""
    usable = k_anonymous(cells, "US", k).where(F.col("person_weight") > 0).select(F.col("state").alias("__scope")).distinct()
    national = usable.limit(1).select(F.lit("US").alias("__scope"))
    return specs.join(usable.unionByName(national), scope_of(F.col("state")) == F.col("__scope"), "leftanti")


def draw_cells(
    cells: DataFrame, specs: DataFrame, k: int = fixed.K_ANONYMITY_MIN, hot_rows: int = HOT_ROWS, strict: bool = True
) -> DataFrame:
    """``n`` weighted draws with replacement for every population spec.

    ``specs``: spec_id, state ('US' or '*' for all), n, seed. Adds ``draw_no`` and the drawn
    skeleton. Draws meet cells in an interval join with an equi key: each scope's weight line is
    cut into buckets, a cell repeats in the few buckets it touches, and a draw looks only at the
    cells of its bucket. Only the states that the specs ask for are read. A scope without usable
    cells is an error; with ``strict`` off it has no draws (see ``empty_scopes``).
    """
    # At most one name per state comes to the driver.
    asked = [r["scope"] for r in specs.select(scope_of(F.col("state")).alias("scope")).distinct().collect()]
    pool = k_anonymous(cells, "US", k)
    if "US" not in asked:
        pool = pool.where(F.col("state").isin(asked))
    intervals = weight_intervals(pool)
    layout = F.broadcast(scope_layout(intervals, specs, hot_rows, strict))
    laid = (
        intervals.withColumn("scope", F.explode(F.array(F.lit("US"), F.col("state"))))
        .join(layout, "scope")
        .withColumn("lo", F.col("lo") - F.col("scope_lo"))
        .withColumn("hi", F.col("hi") - F.col("scope_lo"))
    )
    pieces = (
        laid.withColumn("bucket", F.explode(F.sequence(F.expr("lo div width"), F.expr("(hi - 1) div width"))))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(*SKELETON, "lo", "hi", "scope", "bucket", "slice")
    )
    draws = (
        numbered_rows(specs.withColumn("scope", scope_of(F.col("state"))).drop("state"), "n", "draw_no", ["spec_id"])
        .join(layout, "scope")
        .withColumn("target", F.pmod(hash_draw(F.col("seed"), F.lit("cell"), F.col("draw_no")), F.col("size")))
        .withColumn("slice", F.pmod(F.xxhash64("spec_id", "draw_no"), F.col("slices")).cast("int"))
        .select("spec_id", "seed", "draw_no", "scope", "target", "slice", F.expr("target div width").alias("bucket"))
    )
    hit = draws.join(pieces, ["scope", "bucket", "slice"]).where(
        (F.col("target") >= F.col("lo")) & (F.col("target") < F.col("hi"))
    )
    return hit.select("spec_id", "seed", "draw_no", *SKELETON)


def versions_json(versions: Mapping[str, str] | Column) -> Column:
    """Source versions as sorted-key JSON text in ASCII; a map column or a driver-side dict."""
    if not isinstance(versions, Column):
        if not versions:
            raise RuntimeError("no source versions recorded; build the persona library first")
        return F.lit(json.dumps(dict(versions), sort_keys=True))
    entries = F.array_sort(F.map_entries(versions))
    pairs = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


_SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes, control and other characters escaped."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        beyond = code - 0x10000
        out = F.when(c.isin(list(_SHORT_ESCAPES)), F.create_map(*[F.lit(x) for kv in _SHORT_ESCAPES.items() for x in kv])[c])
        return (
            out.when((code >= 0x20) & (code < 0x7F), c)
            .when(code < 0x10000, unit(code))
            .otherwise(F.concat(unit(F.shiftright(beyond, 10) + 0xD800), unit(beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00)))
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.lit('"'), F.array_join(F.transform(chars, escaped), ""), F.lit('"'))


# --- fixed values: identity payload, sorted-key JSON of seed, skeleton and source versions ----
_ID_FORMAT = (
    '{"seed": %d, "skeleton": {"age_band": "%s", "education": "%s", "income_band": "%s", '
    '"puma": "%s", "race_eth": "%s", "sex": "%s", "state": "%s"}, "sources": %s}'
)


def persona_id(seed: Column, sources_json: Column) -> Column:
    """First 16 hex digits of sha256 over the payload. Repeat draws of a cell share an id."""
    payload = F.format_string(
        _ID_FORMAT, seed, F.col("age_band"), F.col("education"), F.col("income_band"),
        F.col("puma"), F.col("race_eth"), F.col("sex"), F.col("state"), sources_json,
    )
    return F.substring(F.sha2(payload.cast("binary"), 256), 1, 16)


def sample_personas(
    cells: DataFrame,
    party_dist: DataFrame,
    blended: DataFrame,
    specs: DataFrame,
    versions: Mapping[str, str] | Column,
    k: int = fixed.K_ANONYMITY_MIN,
    strict: bool = True,
) -> DataFrame:
    """Flat persona rows for every spec: skeleton, party, priors and id, keyed by draw_no.

    The same specs, tables and versions always give the same rows.
    """
    drawn = draw_cells(cells, specs, k, strict=strict)
    with_parties = with_party(drawn, party_dist, unit_draw(F.col("seed"), F.lit("party"), F.col("draw_no")), k)
    return with_priors(with_parties, blended).withColumn(
        "persona_id", persona_id(F.col("seed"), versions_json(versions))
    )


def nest_personas(flat: DataFrame, versions: Mapping[str, str]) -> DataFrame:
    """Flat persona rows as nested records: demographics, priors, seed and source versions."""
    pairs = [F.lit(x) for k in sorted(versions) for x in (k, versions[k])]
    return flat.select(
        "spec_id", "draw_no", "persona_id",
        F.struct(*SKELETON).alias("demographics"),
        F.struct("party_id", *PRIOR_VALUES).alias("priors"),
        F.col("seed").alias("sampling_seed"),
        F.create_map(*pairs).alias("source_versions"),
    )


def sample_composition(personas: DataFrame) -> DataFrame:
    """How many personas per state and per party, in one pass: (axis, value, n)."""
    return (
        personas.select(
            F.explode(F.array(
                F.struct(F.lit("state").alias("axis"), F.col("state").alias("value")),
                F.struct(F.lit("party").alias("axis"), F.col("party_id").alias("value")),
            )).alias("a")
        )
        .groupBy("a.axis", "a.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def poststratified_baseline(cells: DataFrame, party_dist: DataFrame, blended: DataFrame) -> DataFrame:
    """Prior-only baseline: expected support per state without any deliberation.

    Cells are first summed to (state, age, education, race), which needs one shuffle and leaves
    at most 51 x 100 rows; party shares and priors then come by broadcast.
    """
    groups = cells.groupBy("state", "age_band", "education", "race_eth").agg(
        F.sum(F.col("person_weight").cast("bigint")).alias("w")
    )
    shares = groups.join(usable_party_shares(party_dist), PARTY_KEY, "left")
    by_party = shares.select(
        "state", "age_band", "education", "w",
        F.explode(F.array(*[
            F.struct(F.lit(p).alias("party_id"), F.coalesce(F.col(f"p_{p}"), F.lit(1.0 / 3.0)).alias("p"))
            for p in fixed.PARTIES
        ])).alias("s"),
    ).select("state", "age_band", "education", "s.party_id", (F.col("w") * F.col("s.p")).alias("wp"))
    with_values = with_priors(by_party, blended)
    return with_values.groupBy("state").agg(
        *[(F.sum(F.col("wp") * F.col(v)) / F.sum("wp")).alias(v) for v in PRIOR_VALUES],
    )
