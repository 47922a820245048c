"""Single very long rows: work must grow with the text, not with its square."""

import random
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tables import documents, write  # noqa: E402

from censemble.llm import pages, secrets  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def warm(spark):
    spark.range(10).mapInArrow(lambda batches: batches, "id bigint").collect()


def test_pages_without_an_article(spark, tmp_path):
    """Ten pages of 120 KB of prose each, with a menu that all share."""
    random.seed(1)
    menu = " ".join(f"menu{i}" for i in range(5_000))
    rows, want = [], {}
    for p in range(10):
        parts = [[f"p{p}w{random.randrange(10**6)}" for _ in range(4_000)] for _ in range(2)]
        html = f"<html><body><p>{' '.join(parts[0])}</p><p>{menu}</p><p>{' '.join(parts[1])}</p></body></html>"
        rows.append((p, f"http://host.example/{p}", html))
        want[p] = "\n".join(" ".join(x) for x in parts)
    path = write(spark, tmp_path, "pages", rows, "page_id bigint, url string, html string", extra=("text string", "host string", "stream int"))
    started = time.perf_counter()
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.read.parquet(f"{path}/pages.parquet")).collect()}
    assert got == want
    assert time.perf_counter() - started < 60


def test_a_dump_of_keys(spark, tmp_path):
    """One text of 1.2 MB with 30,000 keys, half of them by a pattern, and letters of two bytes between."""
    random.seed(2)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"
    keys = ["".join(random.choices(alphabet, k=24)) for _ in range(30_000)]
    text = "\n".join(f"é token = {k}" if i % 2 else f"é {k}" for i, k in enumerate(keys))
    path = documents(spark, tmp_path, [(1, text)])
    started = time.perf_counter()
    row = secrets.find_secrets(spark.read.parquet(f"{path}/documents.parquet")).collect()[0]
    assert time.perf_counter() - started < 60
    assert [(s["start"], s["kind"], s["end"]) for s in row["base"]] == brute.base_spans(text)
    every = [(s["start"], s["end"]) for s in row["spans"]]
    assert every == sorted(every) and all(x[1] <= y[0] for x, y in zip(every, every[1:], strict=False))
