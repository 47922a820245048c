"""Merkle manifest of a dataset, with an inclusion proof for every row.

A row is a leaf: the digest of its fields. The leaves of a group (one value of a column) stand in
the order of a key; every two consecutive nodes become their parent, and a last one without a
partner becomes a parent alone, until one node is left. The groups' nodes, in the order of their
values, are the leaves of a last tree over all groups; its top is the root.

Trees are cut into superblocks of 2**``BITS`` consecutive nodes:

1. leaves are stored, sorted by ranges of (group, key, leaf), which gives each its place;
2. the leaves of a superblock become one node; the nodes of a group's superblocks are the leaves of
   its outer tree, which is cut and worked on in the same way, until superblocks are alone;
3. each superblock's leaves and the outer nodes that their proofs need (one list from the
   superblock's node up to the root) are cogrouped: the task reduces the leaves once more, joins
   the proofs inside and outside, and folds each row's digest with its proof to a root.

Every exchange moves digests, never texts. A group that holds a third of all rows is as many
superblocks as it needs; no task sees more than one at a time, and nothing but the largest group's
size comes to the driver.

Defined results: a null field is ``-`` in its leaf, and null groups are a group of their own, before
all others. Rows without a key stand first in their group, rows with equal keys in the order of
their leaves; repeated rows are leaves as often as they come. An empty table gives no rows. Extra
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censemble.session import stored

# Nodes of a superblock, as a power of two.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(inputs: Sequence[str]) -> str:
    """Lowercase hex of the inputs, one after the other."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields: each ``-`` if null, else its length in bytes, ``:``, its value."""
    texts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told), 256)


def levels(nodes: list[str], count: int) -> list[list[str]]:
    """The nodes and those above, ``count`` levels up or until one is left if ``count`` is negative."""
    out = [nodes]
    while count and (count > 0 or len(out[-1]) > 1):
        below = out[-1]
        out.append([digest(below[i : i + 2]) for i in range(0, len(below), 2)])
        count -= 1
    return out


def siblings(tree: list[list[str]], place: int) -> list[str]:
    """What a fold from this node needs, level by level: ``<`` or ``>`` and the digest to the left
    or right of it, or nothing for a node without a partner."""
    out = []
    for level in tree[:-1]:
        other = place ^ 1
        out.append(("<" if other < place else ">") + level[other] if other < len(level) else "")
        place >>= 1
    return out


def fold(node: str, proof: Sequence[str]) -> str:
    """The top that follows from a node and its proof."""
    for step in proof:
        node = digest([step[1:], node] if step[:1] == "<" else [node, step[1:]])
    return node


def _local(block: pd.DataFrame, bits: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock in order, and its tree: ``bits`` levels, unless the group has no other."""
    block = block.sort_values("place", ignore_index=True)
    return block, levels(block["node"].tolist(), bits if block["total"].iloc[0] > 1 << bits else -1)


def placed(rows: DataFrame, group: str, order: Sequence[str], label: str) -> DataFrame:
    """The rows, stored, with ``place`` (from 0, by ``order`` within the group) and ``total``.

    They are sorted by ranges, so a group spans as many files as it needs. Bounds of ranges are
    sampled; the rows are stored with their place in the file, so no reader sees other ones.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    numbered = stored(ranged.withColumn("nth", F.monotonically_increasing_id()), label)
    numbered = numbered.withColumn("part", F.shiftright("nth", 33))
    # One row for every file and group in it: at most files + groups rows.
    runs = numbered.groupBy("part", group).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(group)
    runs = runs.select(
        "part", group, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total")
    )
    found = numbered.join(runs, ["part", group])
    return found.withColumn("place", F.col("base") + F.col("nth") - F.col("first")).drop("nth", "part", "first", "base")


def proofs(nodes: DataFrame, largest: int, bits: int = BITS) -> DataFrame:
    """``tree``, ``place``, ``top`` and ``proof`` of every node, for trees of up to ``largest`` nodes.

    ``nodes``: ``tree`` (not null), ``place``, ``total`` (nodes of the tree) and ``node``.
    """
    blocks = _blocked(nodes, bits)
    outer = _outer(blocks, largest, bits)
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        lambda block, above: _joined(block, above, bits), "tree string, place bigint, top string, proof array<string>"
    )


def _blocked(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", bits))


def _outer(blocks: DataFrame, largest: int, bits: int) -> DataFrame:
    """``tree``, ``block``, ``top`` and ``above``: the proof from the superblock's node upwards."""

    def reduce_block(block: pd.DataFrame) -> pd.DataFrame:
        block, tree = _local(block, bits)
        first = block.iloc[0]
        total = (int(first["total"]) + (1 << bits) - 1) >> bits
        return pd.DataFrame({"tree": [first["tree"]], "place": [first["block"]], "total": [total], "node": [tree[-1][0]]})

    tops = blocks.select("tree", "block", "place", "total", "node").groupBy("tree", "block").applyInPandas(
        reduce_block, "tree string, place bigint, total bigint, node string"
    )
    if largest <= 1 << bits:
        return tops.select("tree", F.col("place").alias("block"), F.col("node").alias("top"), F.array().cast("array<string>").alias("above"))
    # Both the proofs and the level above read them.
    tops = stored(tops, "superblocks")
    found = proofs(tops, (largest + (1 << bits) - 1) >> bits, bits)
    return found.select("tree", F.col("place").alias("block"), "top", F.col("proof").alias("above"))


def _joined(block: pd.DataFrame, above: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Proofs inside the superblock and outside, end to end."""
    block, tree = _local(block, bits)
    rest = list(above["above"].iloc[0])
    return pd.DataFrame({
        "tree": block["tree"], "place": block["place"], "top": above["top"].iloc[0],
        "proof": [siblings(tree, i) + rest for i in range(len(block))],
    })


def manifest(
    rows: DataFrame,
    leaf: Column,
    group: str = "lang",
    key: str = "doc_id",
    claimed: Column | None = None,
    bits: int = BITS,
) -> DataFrame:
    """One row per input row: key, ``leaf``, ``subroot``, ``root``, ``proof`` and ``folded_root``.

    ``leaf`` is the digest that the trees are made of. ``claimed`` is the digest that a holder of
    the row brings to be checked, null for the leaf itself; it is folded with the row's proof.
    ``proof`` has a step for every level from the row to the root, see ``siblings``.
    """
    # Groups sort bytewise, the null one first.
    named = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    told = F.lit(None).cast("string") if claimed is None else claimed
    # Stored before they are sorted, so that texts are read once.
    leaves = stored(rows.select(named.alias("tree"), F.col(key).alias("key"), leaf.alias("node"), told.alias("claimed")), "leaves")
    # As text from here on: a frame with a null among whole numbers would make them all doubles.
    leaves = placed(leaves, "tree", ["key", "node"], "placed").withColumn("key", F.col("key").cast("string"))
    largest = int(leaves.agg(F.max("total")).first()[0] or 0)
    blocks = _blocked(leaves, bits)
    inside = stored(_outer(blocks, largest, bits), "subtrees")
    # The last tree, over the groups.
    groups = inside.where(F.col("block") == 0).select(F.col("tree").alias("name"), F.col("top").alias("node"), F.lit("").alias("tree"))
    groups = placed(groups, "tree", ["name"], "groups")
    n_groups = int(groups.agg(F.max("total")).first()[0] or 0)
    last = proofs(groups, n_groups, bits).join(groups.select("place", "name"), "place").select(
        F.col("name").alias("tree"), F.col("top").alias("root"), F.col("proof").alias("last")
    )
    outer = inside.join(last, "tree").select(
        "tree", "block", F.col("top").alias("subroot"), "root", F.concat("above", "last").alias("above")
    )

    def finish(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        joined = _joined(block, above.rename(columns={"root": "top"}), bits)
        block = block.sort_values("place", ignore_index=True)
        told = block["claimed"].where(block["claimed"].notna(), block["node"])
        return pd.DataFrame({
            "key": block["key"], "leaf": block["node"], "subroot": above["subroot"].iloc[0], "root": joined["top"],
            "proof": joined["proof"], "folded_root": [fold(n, p) for n, p in zip(told, joined["proof"], strict=True)],
        })

    kind = dict(rows.select(F.col(key).alias("key")).dtypes)["key"]
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        finish, "key string, leaf string, subroot string, root string, proof array<string>, folded_root string"
    ).select(F.col("key").cast(kind).alias(key), "leaf", "subroot", "root", "proof", "folded_root")


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, one after the other."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.substring(step, 2, 64)), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; documents of a fixed seventh are tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    claimed = F.when(tampered, leaf_digest(changed))
    told = manifest(docs, leaf_digest([F.col(f) for f in FIELDS]), claimed=claimed)
    return told.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
