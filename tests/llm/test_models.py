import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_net, toxic_crf
from tessera.llm.common import crc_held_out, held_out, labelled_sample, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return docs, labels


def accuracy(spark, docs, labels, label, score, cut):
    rows = docs.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select(label, "text").collect()
    s = np.array(score([r.text for r in rows]))
    return ((s >= cut) == np.array([r[label] == 1 for r in rows])).mean()


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    net = quality_net.fit(labelled_sample(docs, labels, "quality", 300))
    assert accuracy(spark, docs, labels, "quality", lambda t: quality_net.score_texts(net, t), quality_net.KEEP_FROM) >= 0.9


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    crf = toxic_crf.fit(labelled_sample(docs, labels, "toxic", 300))
    assert accuracy(spark, docs, labels, "toxic", lambda t: toxic_crf.tag_texts(crf, t)[0], 0.5) >= 0.9


def test_sample_is_bounded_and_never_held_out(labelled):
    sample = labelled_sample(*labelled, "toxic", 20)
    assert len(sample) <= 40 and not any(crc_held_out(d) for d, _, _ in sample)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    crf = toxic_crf.Crf(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    emission = rng.normal(size=11)
    fresh = np.zeros(11, bool)
    fresh[[0, 4]] = True
    got = toxic_crf.marginals(crf, emission, fresh)
    for a, b in ((0, 4), (4, 11)):
        n, total, ones = b - a, 0.0, np.zeros(b - a)
        for m in range(2**n):
            y = [(m >> k) & 1 for k in range(n)]
            p = np.exp(crf.start[y[0]] + sum(crf.trans[y[k], y[k + 1]] for k in range(n - 1)) + sum(emission[a + k] for k in range(n) if y[k]))
            total += p
            ones += p * np.array(y)
        assert np.allclose(got[a:b], ones / total)


def test_spans_are_code_points():
    crf = toxic_crf.Crf(np.zeros(1 << toxic_crf.BITS), np.zeros((2, 2)), np.zeros(2))
    crf.weights[toxic_crf.features("idiot")] = 3.0
    crf.weights[toxic_crf.features("fine")] = -3.0
    scores, spans = toxic_crf.tag_texts(crf, ["fine 🙂é Idiot fine", "", None, "fine"])
    assert spans[0][0][:2] == (8, 13) and [len(s) for s in spans[1:]] == [0, 0, 0]
    assert scores[0] > 0.9 and scores[1] == scores[2] == 0 and scores[3] < 0.1


def test_scores_do_not_depend_on_batches():
    texts = ["", "short", "x" * 511, "y" * 5000, None, "é" * 700, "word " * 3000]
    net = quality_net.fit([(i, f"{'good words here' if i % 2 else '!! !! ##'} {i} " * 9, i % 2) for i in range(40)], epochs=2)
    whole = quality_net.score_texts(net, texts)
    assert np.allclose(whole, [quality_net.score_texts(net, [t])[0] for t in texts])
    assert ((whole >= 0) & (whole <= 1)).all()


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    par = {"embed": rng.normal(size=(257, 8)), "kernel": rng.normal(size=(64, 24)) / 8, "bias": rng.normal(size=24) * 0.1, "out": rng.normal(size=24), "base": np.zeros(1)}
    codes = np.concatenate([quality_net.chunks_of("some text é " * 60), quality_net.chunks_of("other")])
    owner, labels = np.array([0] * (len(codes) - 1) + [1]), np.array([1.0, 0.0])
    grad = quality_net._gradient(par, codes, owner, labels)

    def loss():
        net = quality_net.Net(par["embed"], par["kernel"], par["bias"], par["out"], float(par["base"][0]))
        top = quality_net.pooled(net, codes)
        z = np.array([top[owner == k].mean(0) @ net.out + net.base for k in (0, 1)])
        return (np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)).mean()

    for name, place in (("kernel", (5, 3)), ("out", (2,)), ("embed", (ord("e"), 1))):
        par[name][place] += 1e-5
        up = loss()
        par[name][place] -= 2e-5
        down = loss()
        par[name][place] += 1e-5
        assert grad[name][place] == pytest.approx((up - down) / 2e-5, abs=2e-3)


def test_no_labels_and_one_class(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert labelled_sample(empty, labels, "toxic", 5) == []
    assert toxic_crf.tag_texts(toxic_crf.fit([]), ["some words"])[0][0] <= 0.5
    assert 0 <= quality_net.score_texts(quality_net.fit([(1, "a", 1)]), ["b"])[0] <= 1


def test_columns_take_nulls(documents):
    net, crf = quality_net.fit([]), toxic_crf.fit([])
    n = documents.count()
    assert documents.select(quality_net.score_column(net, F.col("text")).alias("s")).where("s between 0 and 1").count() == n
    assert documents.select(toxic_crf.score_column(crf, F.col("text")).alias("s")).where("s.score between 0 and 1").count() == n
