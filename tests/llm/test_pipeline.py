import re

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality_net
from tessera.llm.common import table

from .test_exact_dedup import brute as exact
from .test_shingle_join import brute as near

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents").cache()
    first = corpus_pipeline.quality(spark, docs, SF).cache()
    assert first.columns == docs.columns
    from tessera.llm.common import labelled_sample
    net = quality_net.fit(labelled_sample(docs, table(spark, SF, "labels"), "quality", corpus_pipeline.QUALITY_SAMPLE))
    rows = docs.collect()
    scores = quality_net.score_texts(net, [r.text for r in rows])
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r, s in zip(rows, scores) if s >= quality_net.KEEP_FROM}
    second = corpus_pipeline.exact_copies(spark, first, SF).cache()
    assert sorted(r.doc_id for r in second.collect()) == sorted(x[0] for x in exact([tuple(r) for r in first.collect()]) if x[3])
    third = corpus_pipeline.near_copies(spark, second, SF).cache()
    assert sorted(r.doc_id for r in third.collect()) == sorted({x[2] for x in near([tuple(r) for r in second.collect()])})
    fourth = corpus_pipeline.mix(spark, third, SF).cache()
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    assert fourth.columns == docs.columns and abs(size(fourth) - 1.5 * size(third)) < 0.1 * size(third)
    assert fourth.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    fifth = corpus_pipeline.encode(spark, fourth, SF)
    assert fifth.count() == fourth.count() and fifth.where("n_tokens < 1").count() == 0


def test_stages_and_run(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() > 0
