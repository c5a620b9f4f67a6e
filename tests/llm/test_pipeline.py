"""The stages of the pipeline, each against brute force on its own input."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillsieve.llm import mixing, quality, queries

import corpus_pipeline

from .test_small_cases import brute_components, filled

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(2).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id < 3"))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_columns(kept):
    assert all(k.columns == kept[0].columns for k in kept[1:-1])


def test_quality_stage(spark, kept):
    model = quality.learn(kept[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = kept[0].collect()
    scores = model.score(quality.features(pa.array([r.text for r in rows], pa.string())))
    assert texts(kept[1]) == Counter((r.doc_id, r.text) for r, s in zip(rows, scores, strict=True) if s >= 0.5)


def test_exact_stage(kept):
    groups = defaultdict(list)
    for r in kept[1].collect():
        groups[r.text or ""].append(r.doc_id)
    got = {r.text or "": r.doc_id for r in kept[2].collect()}
    assert got == {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()} and kept[2].count() == len(groups)


def test_near_stage(kept):
    rows = sorted(kept[2].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    _, comps = brute_components([r.text for r in rows], 5, 80)
    assert texts(kept[3]) == Counter((r.doc_id, r.text) for i, r in enumerate(rows) if comps[i] == i)


def test_mixing_stage(kept):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, got, longest = Counter(), Counter(), Counter()
    for r in kept[3].collect():
        have[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    whole = texts(kept[3])
    for r in kept[4].collect():
        got[r.source] += size(r.text)
        assert (r.doc_id, r.text) in whole
    want = filled(dict(have), mixing.WEIGHTS, mixing.MAX_EPOCHS)
    assert all(abs(got[s] - want[s]) <= 2 + longest[s] / 2 for s in have)


def test_pieces_stage(kept):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in kept[4].collect())
    rows = kept[5].collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want and all(r.round_trip for r in rows)


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, DATA).columns == kept[5].columns


def test_empty_table_and_clashing_columns(spark, kept):
    """All stages, one after the other, on no rows and on rows with columns named as the operators name theirs."""
    names = ["size", "digest", "place", "score", "ids", "n_pieces", "near_row", "copy", "key", "text_sha256", "round_trip"]
    for docs in (kept[0].limit(0), kept[0].limit(60).select("*", *[F.lit("x").alias(c) for c in names])):
        columns, rows = docs.columns, docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == columns
        done = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert done.columns == kept[5].columns and bool(done.count()) == bool(rows)
