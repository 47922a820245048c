"""Merkle manifest against a plain tree, for small superblocks and awkward rows."""

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from tables import AWKWARD, write  # noqa: E402

from censemble.llm import merkle  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """All levels of the tree over ``nodes``."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, place):
    out = []
    for level in tree[:-1]:
        out.append((level[place ^ 1] if place ^ 1 < len(level) else None, place & 1))
        place //= 2
    return out


def plain(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[lang].append((i, h(*map(field, (i, source, lang, n, text)))))
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([leaf for _, leaf in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for place, (i, leaf) in enumerate(groups[g]):
            proof = path(trees[g], place) + path(top, k)
            out.append((i, leaf, trees[g][-1][0], top[-1][0], h(*(s for s, _ in proof if s))))
    return out


def table(rows, n):
    random.seed(n)
    langs = [None, "", "de", "en", "é", "zz"]
    made = [(i, t, random.choice(langs), "s", i) for i, t in enumerate(AWKWARD)]
    made += [(random.choice([None, 7, 2**61 + k, -k]), f"t{k}", random.choice(["en", "en", "en", None, "fr"]), None, None if k % 5 else k) for k in range(n)]
    return rows + made + made[:3]


@pytest.mark.parametrize("bits, n", [(1, 40), (2, 3), (3, 150), (10, 60)])
def test_equals_a_plain_tree(spark, tmp_path, bits, n):
    rows = table([], n)
    docs = spark.read.parquet(f"{write(spark, tmp_path, 'd', rows, SCHEMA, extra=('leaf string', 'root string', 'tree int', 'place int', 'node int', 'key int'))}/d.parquet")
    leaf = merkle.leaf_digest([F.col(f) for f in merkle.FIELDS])
    told = merkle.manifest(docs, leaf, bits=bits, claimed=F.when(F.col("source").isNull(), F.sha2(F.lit("other"), 256)))
    told = told.withColumn("digest", merkle.proof_digest(F.col("proof"))).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["digest"]) for r in told), key=repr) == sorted(plain(rows), key=repr)
    known = {h(*map(field, (i, s, la, c, t))): s is None for i, t, la, s, c in rows}
    for r in told:
        assert (r["folded_root"] != r["root"]) == known[r["leaf"]]
        assert merkle.fold(r["leaf"], r["proof"]) == r["root"]


@pytest.mark.parametrize("rows", [[], [(3, "a", "en", None, 1)]])
def test_none_and_one(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    told = merkle.manifest(docs, merkle.leaf_digest([F.col(f) for f in merkle.FIELDS])).collect()
    assert [(r["subroot"], r["root"], r["proof"]) for r in told] == [(r["leaf"], r["leaf"], []) for r in told] and len(told) == len(rows)


def test_any_change_of_a_field_shows(spark):
    row = (1, "ab", "c", None, 3)
    other = [(1, "a", "bc", None, 3), (1, "ab", "c", "", 3), (1, "ab", "c", "-", 3), (None, "ab", "c", None, 3), (1, "ab", "c", None, None)]
    leaves = spark.createDataFrame([row, *other], SCHEMA).select(merkle.leaf_digest([F.col(f) for f in merkle.FIELDS])).collect()
    assert len({x[0] for x in leaves}) == 6
