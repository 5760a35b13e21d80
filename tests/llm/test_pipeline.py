"""The pipeline's stages: each works on what the one before it kept, and its decisions take effect."""

import re
from pathlib import Path

import pytest
from pyspark.sql.functions import lit

import corpus_pipeline
from graphweft.llm import decontamination, minhash, mixing, quality
from graphweft.llm.common import table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test data")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    labels, bench = table(spark, DIR, "labels"), table(spark, DIR, "benchmark")
    words = {str(r.item_id): len(re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", r.text or "")) for r in bench.collect()}
    decide = {
        "quality_rules": lambda d: ids(quality.quality_report(d, labels).where("kept")),
        "minhash_near_dedup": lambda d: ids(minhash.near_duplicates(d).where("kept")),
        "benchmark_decontamination": lambda d: sorted(r.doc_id for r in decontamination.contamination(d, bench).collect() if not any(words[i] >= 5 for i in r["items"])),
        "source_mixing": lambda d: ids(mixing.mixture_report(d).where("sampled")),
    }
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = tmp_path / name
        stage(spark, docs, DIR).write.parquet(str(out))
        kept = spark.read.parquet(str(out))
        assert kept.columns == docs.columns and ids(kept) == decide[name](docs)
        docs = kept
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    rows = last.orderBy("start").collect()
    assert [r.doc_id for r in rows] == ids(docs)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in every column, a repeated row, ids beyond 2^53, a long text and columns with the stages' own names; and no rows at all."""
    docs = table(spark, DIR, "documents")
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))
    rows = [(None, None, None, None, None), (2**53 + 1, long, "en", "s", len(long)), (None, "plain words " * 60, "en", "s", 700), (5, None, "en", None, 0), (6, "", None, "s", 0), (7, " ".join(f"a{i}" for i in range(90)), "en", "s", 350), (7, " ".join(f"a{i}" for i in range(90)), "en", "s", 350)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    for c in ("_f", "_kept", "_doc", "stratum", "id", "row_key", "found", "component", "probability"):
        odd = odd.withColumn(c, lit(f"own {c}"))
    for k, frame in enumerate((odd, odd.limit(0))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = str(tmp_path / f"{k}{name}")
            stage(spark, frame, DIR).write.parquet(out)
            kept = spark.read.parquet(out)
            assert kept.columns == odd.columns, name
            if name != "source_mixing":  # which samples
                assert [r.doc_id for r in kept.where("doc_id > 100").collect()] == ([2**53 + 1] if k == 0 else []), name
            frame = kept
        last = corpus_pipeline.STAGES[-1][1](spark, frame, DIR)
        assert last.count() == frame.count()
