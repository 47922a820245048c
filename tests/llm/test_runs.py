"""Periodic runs against a plain search over all periods."""

import os
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tables import AWKWARD, documents  # noqa: E402

from censemble.llm import runs  # noqa: E402
from censemble.llm.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                stretch = w[i : i + length]
                if not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = looped(doc_id, brute.WORD.findall(text or ""))
    found = plain(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in found), default=None)
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), *four, brute.sha(lines), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (6, 3)])
def test_sequences(least, exponent):
    random.seed(least + exponent)
    for _ in range(200):
        n = random.randrange(1, 90)
        w = [random.randrange(random.choice([1, 2, 2, 3])) for _ in range(n)]
        if random.random() < 0.5:
            p, a = random.randrange(1, 12), random.randrange(n)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        for step in (1, 7, 1000):
            found = runs.runs_of(np.array(w), least, exponent, step=step)
            assert [tuple(x) for x in found.tolist()] == plain(w, least, exponent)


def test_long_sequences_take_seconds():
    """One word, two words and a long period, half a million times: linear but for a logarithm."""
    one = np.zeros(500_000, dtype=np.int64)
    assert runs.runs_of(one, 6, 4).tolist() == [[0, 500_000, 1]]
    long = np.tile(np.arange(60_000), 8)
    assert runs.runs_of(long, 6, 4).tolist() == [[0, 480_000, 60_000]]
    morse = np.array([bin(i).count("1") % 2 for i in range(500_000)])
    assert runs.runs_of(morse, 6, 4).tolist() == []


def rows():
    random.seed(2)
    out = list(enumerate(AWKWARD[:-1])) + [(None, "a a a a a a"), (None, None), (40, "x y x y x y x y z z z z z"), (40, "a b")]
    for k in range(150):
        unit = " ".join(random.choice(["a", "b", "é", "日本", "longer"]) for _ in range(random.randrange(1, 9)))
        out.append((100 + k, "\t".join([unit] * random.randrange(1, 9)) + random.choice(["", " a", "\n end"])))
    return out


@pytest.mark.parametrize("source", ["made", "test data"])
def test_query(spark, tmp_path, source):
    path = documents(spark, tmp_path, rows()) if source == "made" else SF_DIR
    texts = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, path).collect()]
    # Long texts are tried by their periods in the test above; here they would take minutes.
    short = {i for i, t in texts if len(t or "") < 4_000}
    assert len(got) == len(texts) and len(short) > 100
    want = [expected(i, t) for i, t in texts if i in short]
    assert sorted((g for g in got if g[0] in short), key=repr) == sorted(want, key=repr)


def test_empty(spark, tmp_path):
    assert QUERIES["op12_periodic_runs"](spark, documents(spark, tmp_path, [])).collect() == []
