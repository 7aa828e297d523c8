"""The pipeline's stages, each against a plain version on its own input."""

import sys
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corner  # noqa: E402
from tidecast.storage import written_table  # noqa: E402


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, stages = [docs], dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written_table(stage(spark, kept[-1], sf), name))
    for df in kept[1:5]:
        assert df.schema.names == docs.schema.names
    good = {r["doc_id"] for r in kept[1].collect()}
    for r in docs.collect():
        s = brute.statistics(r["text"])
        assert not (s[0] < 10 or 100 * s[4] > 20 * s[0]) or r["doc_id"] not in good
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passing = lambda s: s[0] >= 10 and 100 * s[4] <= 20 * s[0]
    based = {r["doc_id"] for r in docs.collect() if passing(brute.statistics(r["text"]))}
    clean = [i for i, y in labels.items() if y == 1 and i in based]  # the base rule must reject the others
    assert np.mean([i in good for i in clean]) > 0.95

    least = brute.components([(r["doc_id"], r["text"]) for r in kept[1].collect()], 80)
    assert {r["doc_id"] for r in kept[2].collect()} == {i for i, c in least.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {x[0] for x in brute.contained([(r["doc_id"], r["text"]) for r in kept[2].collect()], items, 80)}
    assert {r["doc_id"] for r in kept[3].collect()} == {r["doc_id"] for r in kept[2].collect()} - dirty

    mixed = kept[4].groupBy("source").agg(F.sum(F.octet_length("text")).alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    assert mixed and set(r["source"] for r in mixed) <= set(r["source"] for r in kept[3].select("source").distinct().collect())
    from tokenizers import Tokenizer

    from tidecast.llm.queries import byte_bpe

    tokenizer = Tokenizer.from_file(byte_bpe())
    at, rows = 0, sorted(kept[5].collect(), key=lambda r: r["start"])
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    copies = [r["doc_id"] for r in kept[4].collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(copies)
    for r in rows:
        ids = np.array(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r["n_tokens"]
    beside = sum(a["doc_id"] == b["doc_id"] for a, b in zip(rows, rows[1:]))  # the mixture's order, not that of ids
    assert beside < (len(copies) - len(texts)) / 4


def test_awkward_rows_pass_through(spark, sf):
    for docs in (corner.documents(spark), corner.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written_table(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
