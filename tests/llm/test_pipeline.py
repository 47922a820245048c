"""The pipeline against its stages in plain Python."""

import os
import sys
from pathlib import Path

import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import pytest  # noqa: E402
from tables import AWKWARD, PROSE, documents, write  # noqa: E402

from censemble.llm.pieces import default_model  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(docs, items):
    """doc_id -> (ids, digest of the decoded text)."""
    kept = [(i, q["clean"]) for i, t in docs if (q := brute.quality(t))["kept"]]
    sets = {i: brute.shingles(t, 5) for i, t in kept}
    found = brute.components(sorted(sets), sets)
    kept = [(i, t) for i, t in dict(kept).items() if found[i] == i]
    bad = {d for d, _ in brute.leaks(kept, items)}
    out = {}
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for i, t in kept:
        if i in bad:
            continue
        text, at = "", 0
        for b, _, e in brute.base_spans(t):
            if b >= at:
                text += t[at:b] + "[SECRET]"
            at = max(at, e)
        ids = library.encode(text + t[at:])
        out[i] = (ids, brute.sha(library.decode(ids)))
    return out


def awkward(spark, tmp_path):
    secret = f"{PROSE} The password = abcdef0123456789 is kept here. Nothing else to see, all is well and calm."
    leaked = "Every morning the baker opens her small shop and sells warm bread to people on their way to work."
    rows = [*enumerate(AWKWARD), (50, PROSE), (51, PROSE), (51, PROSE), (52, secret), (53, f"{leaked} And so ends this tale of bread.")]
    write(spark, tmp_path, "benchmark", [(1, leaked), (2, None)], "item_id bigint, text string")
    return documents(spark, tmp_path, rows)


@pytest.mark.parametrize("kind", ["test data", "awkward"])
def test_pipeline(spark, tmp_path, kind):
    path = SF_DIR if kind == "test data" else awkward(spark, tmp_path)
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    rows = corpus_pipeline.run(spark, path).collect()
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in rows}
    assert got == plain(docs, items) and len(got) == len(rows)


def test_stages_keep_the_columns(spark, tmp_path):
    path = awkward(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), path).collect() == []
