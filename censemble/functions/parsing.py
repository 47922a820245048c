"""Model responses: code fences, JSON objects with defaults, and clamping.

The rules are those of a strict JSON reader with lenient fields: text that is not one JSON object
is unparseable as a whole; an absent key takes its default; numbers may come as text or booleans;
a present key that is not a number spoils the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censemble.functions import fixed

# Whitespace as a Unicode-aware strip understands it.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
# Bare NaN and Infinity are accepted by lenient readers but are not JSON; they are quoted where they
# are the value of a number field. Inside a string such a field's quotes would be escaped.
_BARE_SPECIAL = r'([{,]\s*"(?:stance|confidence|yes_pct)"\s*:\s*)(NaN|-?Infinity)(?=\s*[,}])'


def strip_text(text: Column) -> Column:
    """Trim both ends; only the ends are looked at, not the whole text."""
    return F.btrim(text, F.lit(_BLANKS))


def strip_fences(text: Column) -> Column:
    """Remove a leading fence line and a trailing fence around a response."""
    body = strip_text(text)
    newline = F.instr(body, "\n")
    opened = F.when(
        body.startswith("```"),
        F.when(newline > 0, F.substring(body, newline + F.lit(1), F.char_length(body)))
        .otherwise(F.substring(body, F.lit(4), F.char_length(body))),
    ).otherwise(body)
    closed = F.when(
        opened.endswith("```"), F.substring(opened, F.lit(1), F.char_length(opened) - 3)
    ).otherwise(opened)
    return strip_text(closed)


def with_json_object(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the text as a variant if it is exactly one JSON object, else null.

    Wrapping it both as the only array element and as the only object value rejects trailing
    text, which the parser alone would ignore: nothing can close both wrappers early. Steps are
    staged in projections, so that each parse happens once per row.
    """
    body = F.col(text)

    def wrapped(source: Column, label: str) -> dict[str, Column]:
        return {
            f"__item{label}": F.try_parse_json(F.concat(F.lit("["), source, F.lit("]"))),
            f"__value{label}": F.try_parse_json(F.concat(F.lit('{"w":'), source, F.lit("}"))),
        }

    def strict(label: str) -> Column:
        alone = F.try_variant_get(f"__item{label}", "$[1]", "variant").isNull()
        whole = F.col(f"__item{label}").isNotNull() & F.col(f"__value{label}").isNotNull() & alone
        return F.when(whole, F.try_variant_get(f"__item{label}", "$[0]", "variant"))

    staged = df.withColumns(wrapped(F.when(body.startswith("{"), body), "1"))
    lenient = F.col("__item1").isNull() & (body.contains("NaN") | body.contains("Infinity"))
    quoted = F.when(lenient, F.regexp_replace(body, _BARE_SPECIAL, '$1"$2"'))
    staged = staged.withColumn("__quoted", quoted).withColumns(wrapped(F.col("__quoted"), "2"))
    return staged.withColumn(out, F.coalesce(strict("1"), strict("2"))).drop(
        "__item1", "__value1", "__item2", "__value2", "__quoted"
    )


def _kind(field: Column) -> Column:
    return F.schema_of_variant(field)


def number(field: Column) -> Column:
    """Double from a JSON number, numeric text or boolean; anything else is null."""
    kind = _kind(field)
    text = F.regexp_replace(strip_text(F.try_variant_get(field, "$", "string")), "(?<=[0-9])_(?=[0-9])", "")
    raw = strip_text(F.try_variant_get(field, "$", "string"))
    special = F.lower(F.regexp_replace(raw, "^\\+", ""))
    from_text = (
        F.when(raw.rlike(_NUMBER), text.try_cast("double"))
        .when(raw.rlike(_SPECIAL), F.when(special.endswith("nan"), float("nan"))
              .when(special.startswith("-"), float("-inf")).otherwise(float("inf")))
    )
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(field, "$", "boolean").cast("double"))
        .when(kind == "STRING", from_text)
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(field, "$", "double"))
    )


def text_of(field: Column) -> Column:
    """Field as text: null reads 'None', booleans 'True'/'False', as reports print them."""
    kind = _kind(field)
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(field, "$", "boolean"), "True").otherwise("False"))
        .when(kind == "STRING", F.try_variant_get(field, "$", "string"))
        .otherwise(F.to_json(field))
    )


def truthy(field: Column) -> Column:
    """Whether the value counts as true: nonzero, nonempty; absent is false."""
    kind = _kind(field)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(field, "$", "boolean"))
        .when(kind == "VOID", F.lit(False))
        .when(kind == "STRING", F.try_variant_get(field, "$", "string") != "")
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~F.to_json(field).isin("[]", "{}"))
        .otherwise(F.try_variant_get(field, "$", "double") != 0.0),
        F.lit(False),
    )


def clamp_unit(x: Column) -> Column:
    """Into [0, 1]; not-a-number becomes 1, since Spark orders it above every number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _with_fields(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Stage the parse in projections, so that each step is worked out once per row."""
    parsed = df.withColumn("__body", strip_fences(F.col(text)))
    parsed = with_json_object(parsed, "__body", "__obj")
    parsed = parsed.withColumns({f"__{k}": F.try_variant_get("__obj", f"$.{k}", "variant") for k in keys})
    return parsed.drop("__body")


def _drop_staged(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def parse_votes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``stance``, ``confidence`` and ``rationale`` from vote responses."""
    staged = _with_fields(df, text, ["stance", "confidence", "rationale"]).withColumns(
        {"__s": number(F.col("__stance")), "__c": number(F.col("__confidence"))}
    )
    ok = (
        F.col("__obj").isNotNull()
        & (F.col("__stance").isNull() | F.col("__s").isNotNull())
        & (F.col("__confidence").isNull() | F.col("__c").isNotNull())
    )
    staged = staged.withColumn("__ok", ok)
    rationale = F.when(F.col("__rationale").isNull(), "").otherwise(
        F.substring(text_of(F.col("__rationale")), 1, 600)
    )
    return _drop_staged(
        staged.withColumns(
            {
                "stance": F.when(F.col("__ok"), clamp_unit(F.coalesce("__s", F.lit(0.5)))).otherwise(0.5),
                "confidence": F.when(F.col("__ok"), clamp_unit(F.coalesce("__c", F.lit(0.5)))).otherwise(0.3),
                "rationale": F.when(F.col("__ok"), rationale).otherwise(fixed.UNPARSEABLE_VOTE),
            }
        )
    )


def parse_critics(df: DataFrame, text: str) -> DataFrame:
    """Adds ``flagged`` and ``note`` from fact-check responses; unparseable is not flagged."""
    staged = _with_fields(df, text, ["flagged", "note"])
    return _drop_staged(
        staged.withColumns(
            {
                "flagged": truthy(F.col("__flagged")),
                "note": F.when(
                    F.col("__note").isNotNull(),
                    F.nullif(F.substring(text_of(F.col("__note")), 1, 300), F.lit("")),
                ),
            }
        )
    )


def parse_probes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``knows``, ``yes_pct``, ``confidence`` and ``note`` from prior-knowledge probes.

    Fields are read in that order; the first bad number keeps what was read before it.
    """
    staged = _with_fields(df, text, ["knows", "yes_pct", "confidence", "note"]).withColumns(
        {"__p": number(F.col("__yes_pct")), "__c": number(F.col("__confidence"))}
    )
    pct_ok = F.col("__yes_pct").isNull() | F.is_variant_null("__yes_pct") | F.col("__p").isNotNull()
    conf_ok = F.col("__confidence").isNull() | F.col("__c").isNotNull()
    staged = staged.withColumn("__upto_pct", F.col("__obj").isNotNull() & pct_ok)
    staged = staged.withColumn("__ok", F.col("__upto_pct") & conf_ok)
    note = F.when(F.col("__note").isNull(), "").otherwise(F.substring(text_of(F.col("__note")), 1, 300))
    return _drop_staged(
        staged.withColumns(
            {
                "knows": truthy(F.col("__knows")),
                "yes_pct": F.col("__p"),
                "confidence": F.when(F.col("__upto_pct"), F.coalesce("__c", F.lit(0.0))).otherwise(0.0),
                "note": F.when(F.col("__ok"), note).otherwise(fixed.UNPARSEABLE_PROBE),
            }
        )
    )
