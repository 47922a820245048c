"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

PROSE = "The quick brown fox jumps over the lazy dog near the old river bank while seven wise owls watch from a tall green tree."
LONG = " ".join(f"word{i} of{i % 977}" for i in range(30_000)) + "."
AWKWARD = [None, "", " ", "\n\t ", "a", "é ü\n日本 ▁x", "x" * 3000, LONG, "tab\there\x0bvt", "a  b   c", "<|endoftext|> <s>", "😀 ok."]


def write(spark, path, name, rows, schema, extra=("kept string", "words array<string>", "part int", "value string", "quality int", "h string", "ids string")):
    """Rows as a Parquet table, with further columns whose names operators use themselves."""
    fields = ", ".join([schema, *extra])
    full = [(*r, *([None] * len(extra))) for r in rows]
    spark.createDataFrame(full, fields).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def documents(spark, path, rows):
    return write(
        spark, path, "documents", [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
