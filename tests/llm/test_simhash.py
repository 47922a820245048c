"""SimHash near-dedup against brute force, for all kinds of plans and bucket sizes."""

import os
import random
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tables import AWKWARD, documents  # noqa: E402

from censemble.llm import simhash  # noqa: E402
from censemble.llm.components import connected_components  # noqa: E402
from censemble.llm.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_print(text):
    words = brute.WORD.findall((text or "").translate(brute.LOWER))
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(nodes, near):
    """Smallest node reachable, by a search over all pairs."""
    out = {}
    for start in sorted(nodes):
        if start not in out:
            out[start], queue = start, [start]
            while queue:
                x = queue.pop()
                for y in nodes:
                    if y not in out and near(x, y):
                        out[y] = start
                        queue.append(y)
    return out


def rows():
    random.seed(4)
    out = list(enumerate(AWKWARD)) + [(None, "a b c d"), (None, None), (3, "another text of the same id"), (700, "a b c d"), (701, "A  b\nC d")]
    base = [" ".join(random.choice([f"w{i}" for i in range(300)]) for _ in range(250)) for _ in range(6)]
    for k in range(120):
        words = random.choice(base).split()
        for _ in range(random.choice([0, 1, 2, 4, 8])):
            words[random.randrange(len(words))] = "changed"
        out.append((100 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("source", ["made", "test data"])
def test_query(spark, tmp_path, source):
    path = documents(spark, tmp_path, rows()) if source == "made" else SF_DIR
    texts = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, plain_print(t)) for i, t in texts]
    ids = {i for i, _ in prints if i is not None}
    of = {i: {p for j, p in prints if j == i} for i in ids}
    expected = plain_groups(ids, lambda x, y: any((p ^ q).bit_count() <= 4 for p in of[x] for q in of[y]))
    got = [tuple(r) for r in QUERIES["op13_simhash_near_dedup"](spark, path).collect()]
    want = [(i, f"{p:016x}", None if i is None else expected[i]) for i, p in prints]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(set(expected.values())) < len(expected)


def made_prints(seed, n=500):
    """Balls around a few centres, chains, and others at random."""
    random.seed(seed)
    out = {random.getrandbits(64) for _ in range(n // 5)}
    for _ in range(3):
        centre = random.getrandbits(64)
        for _ in range(n // 5):
            far = centre
            for _ in range(random.randrange(6)):
                far ^= 1 << random.randrange(64)
            out.add(far)
    x = random.getrandbits(64)
    for _ in range(n // 5):
        for _ in range(4):
            x ^= 1 << random.randrange(64)
        out.add(x)
    return out


PLANS = [[0] * 5, [1, 0, 0, 0], [2, -1, 0, 0], [1, 1, 0], [2, 0, 0], [2, 1], [1, 0, 0, 0, -1]]


@pytest.mark.parametrize("thresholds, chunk", [*((p, 16) for p in PLANS[::2]), *((p, 1024) for p in PLANS[1::3])])
def test_links_connect_all(spark, thresholds, chunk):
    prints = made_prints(len(thresholds) + chunk)
    bits = list(range(64))
    random.shuffle(bits)
    masks = [simhash._mask(bits[i :: len(thresholds)]) for i in range(len(thresholds))]
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "print bigint")
    links = simhash.near_links(classes, simhash.Plan(masks, thresholds), 4, chunk)
    told = {r["node"]: r["component"] for r in connected_components(links).collect()}
    expected = plain_groups(signed, lambda x, y: ((x ^ y) & 2**64 - 1).bit_count() <= 4)
    assert {p: told.get(p, p) for p in signed} == expected


def test_thresholds_cost_least():
    costs = [{-1: 0.0, 0: 9.0, 1: 20.0, 2: 40.0}, {-1: 0.0, 0: 1.0, 1: 2.0, 2: 50.0}, {-1: 0.0, 0: 3.0, 1: 30.0, 2: 31.0}]
    every = [(sum(c[t] for c, t in zip(costs, ts)), list(ts)) for ts in np.ndindex(4, 4, 4) for ts in [[t - 1 for t in ts]] if sum(ts) == 2]
    assert simhash.allocate(costs, 2) == min(every)


def test_correlated_bits_share_a_part():
    random.seed(1)
    rows = np.random.default_rng(1).integers(0, 2, (4000, 64))
    for k in range(16):
        rows[:, 3 + 4 * k % 60] = rows[:, 3]
    both = rows.T @ rows
    alike = {3 + 4 * k % 60 for k in range(16)}
    parts = simhash.correlated_parts(both, len(rows), 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any(alike <= set(p) for p in parts)
    plan = simhash.make_plan(both, len(rows), np.zeros(0, dtype=np.uint64), 4)
    assert sum(plan.thresholds) == 4 - len(plan.thresholds) + 1


def test_empty(spark, tmp_path):
    assert QUERIES["op13_simhash_near_dedup"](spark, documents(spark, tmp_path, [])).collect() == []
