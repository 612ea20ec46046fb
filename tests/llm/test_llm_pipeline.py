from collections import Counter

import corpus_pipeline
import sentencepiece
from llm_cases import components, kept_lines, words
from pyspark.sql import functions as F

from linktm.llm import mixing
from linktm.llm.line_crf import THRESHOLD, classify
from linktm.scratch import materialize


def rows(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def test_stages_equal_plain_versions(spark, tables):
    """Each stage on what its predecessor kept, beside a plain version of it."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    good = materialize(stages["quality classifier"](spark, docs, tables), "t")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scored = classify(docs, labels).where(F.col("score") >= THRESHOLD)
    assert good.columns == columns and rows(good, "doc_id") == rows(scored, "row.doc_id")

    short = materialize(stages["line dedup"](spark, good, tables), "t")
    given = [(r.doc_id, r.text) for r in good.collect()]
    want = [(i, left) for (i, _), (_, gone, left) in zip(given, kept_lines(given, 10, True)) if not gone or words(left)]
    assert short.columns == columns and rows(short, "doc_id", "text") == Counter(want)

    lone = materialize(stages["near duplicates"](spark, short, tables), "t")
    given = [(r.doc_id, r.text) for r in short.collect()]
    heads = {(i,) for (i, _), c in zip(given, components(given)) if i == c}
    assert lone.columns == columns and set(rows(lone, "doc_id")) == heads

    mixed = materialize(stages["source mixing"](spark, lone, tables), "t")
    per = mixing.taken_words(lone).agg(F.sum("taken")).first()[0]
    texts = mixed.collect()
    assert mixed.columns == columns and sum(len(words(r.text)) for r in texts) == per

    model = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    last = stages["sentencepiece"](spark, mixed, tables).collect()
    assert Counter((r.doc_id, tuple(r.pieces)) for r in last) == Counter((r.doc_id, tuple(model.encode(r.text))) for r in texts)


def test_run_on_no_documents(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
