"""Word hashes: words made to collide under sums over bytes must stay apart in all operators."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tables import documents, write  # noqa: E402

from censemble.llm import flat  # noqa: E402
from censemble.llm.queries import QUERIES  # noqa: E402


def thue_morse(n, letters="ab"):
    """A word and its complement: equal under any polynomial modulo a power of two, if long enough."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def hashes(words, **options):
    buffer, at = flat.flat(pa.array(words))
    starts, ends, _ = flat.words(buffer, at)
    return flat.word_hashes(buffer, starts, ends, **options)


@pytest.mark.parametrize("seed", [1, 2])
def test_different_words_have_different_hashes(seed):
    random.seed(seed)
    words = {x for n in (4, 8, 16, 128, 256, 1024, 4096) for x in thue_morse(n)}
    words |= {"".join(random.choices("aé\x00b", k=n)) for n in list(range(1, 40)) * 30 + [255, 256, 257, 900]}
    words |= {"a" * n for n in range(1, 600)}
    words = sorted(words)
    found = hashes(words, seed=seed)
    assert len(np.unique(found)) == len(words)
    # The same wherever the word stands, and in one buffer or several.
    assert (hashes(words[::-1], seed=seed)[::-1] == found).all()
    assert [hashes([w], seed=seed)[0] for w in words[:50]] == found[:50].tolist()


def test_case_counts_only_if_asked():
    assert len(set(hashes(["Ab" * 200, "aB" * 200, "ÄB", "äb"], lower=True).tolist())) == 3
    assert len(set(hashes(["Ab" * 200, "aB" * 200]).tolist())) == 2


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        x, y = thue_morse(n)
        other = [f"k{k}w{i}" for i in range(12)]
        rows += [(10 * k, " ".join([x, *other])), (10 * k + 1, " ".join([y, *other]))]
        rows += [(10 * k + 2, f"{x} {x}y {x}z"), (10 * k + 3, f"{y} {y}y {y}z")]
    path = documents(spark, tmp_path_factory.mktemp("made"), rows)
    items = [(k, " ".join(thue_morse(n)[1] + "xyz"[i % 3] * (i // 3) for i in range(9))) for k, n in enumerate((1024, 4096))]
    write(spark, path, "benchmark", items, "item_id bigint, text string")
    return path, rows, items


def test_substring_dedup(spark, tables):
    path, rows, _ = tables
    expected = {i: n[1] for i, n in brute.passages(rows).items()}
    assert {r["doc_id"]: r["n_removed"] for r in QUERIES["op9_substring_dedup"](spark, path).collect()} == expected


def test_near_dedup(spark, tables):
    path, rows, _ = tables
    expected = brute.components([i for i, _ in rows], {i: brute.shingles(t, 2) for i, t in rows})
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op7_minhash_near_dedup"](spark, path).collect()} == expected


def test_decontamination(spark, tables):
    path, rows, items = tables
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_benchmark_decontamination"](spark, path).collect()}
    assert found == brute.leaks(rows, items)
