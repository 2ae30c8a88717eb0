import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from regionframe.llm import toxicity
from regionframe.llm.toxicity import Model, clean_documents, fit, held_out, scored, trained

SCHEMA = "doc_id long, text string, lang string, score string, toxic string"


def corpus(n=600, seed=1):
    r, docs, labels = random.Random(seed), [], []
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    for i in range(n):
        sentences = [" ".join(r.choice(words) for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 12))]
        bad = r.random() < 0.2
        if bad:
            at = r.randrange(len(sentences))
            sentences[at] += " " + r.choice(["dolt", "Knave", "rogue"])
        docs.append((i, ". ".join(sentences) + ".", "en", "x", "y"))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_from_documents_and_finds_the_sentence(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (1000, None, None, None, None), (1001, "", None, None, None), (None, "rogue", None, None, None)], SCHEMA)
    m = trained(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.row.doc_id: r for r in scored(d, m).collect()}
    truth = dict(labels)
    test = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k].score >= 0.7) == bool(truth[k]) for k in test]) > 0.97
    for k in test:
        if truth[k]:
            assert any(any(w in docs[k][1].lower()[s.start : s.start + s.length] for w in ("dolt", "knave", "rogue")) for s in got[k].offending)
    assert got[1000].score == got[1001].score < 0.5 and got[None].score > 0.7
    kept = clean_documents(d, m)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.score < 0.7}


def test_odd_training_sets(spark):
    d = spark.createDataFrame([(1, "a b", "en", None, None), (1, "a b", "en", None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score < 0.01 for r in scored(d, trained(d, none)).collect()] == [True, True]
    assert scored(d.limit(0), Model()).count() == 0
    assert fit([{(): 1}], np.array([1]), []).document("x")[0] > 0.99 and fit([{(): 1}], np.array([0]), []).document("x")[0] < 0.01


def test_repeated_rows_and_very_long_texts_do_not_change_the_model(spark):
    docs, labels = corpus(200, 4)
    long = "mild words here. " * 60_000
    docs.append((5000, long, None, None, None))
    one = trained(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (5000, 0)], "doc_id long, toxic int"))
    many = trained(spark.createDataFrame([*docs, *docs[:50] * 20, docs[-1]], SCHEMA).repartition(7), spark.createDataFrame([*labels, (5000, 0), *labels[:9]], "doc_id long, toxic int"))
    assert one.weights == many.weights and one.bias == many.bias and one.weights
    assert one.document(long)[0] < 0.7 < one.document(long + "Rogue.")[0] and one.document(long + "Rogue.")[1][0][0] == len(long) - 1


def test_noisy_or_and_its_gradient():
    """The loss against products over sentences, the gradient against differences, the score against the product."""
    r = np.random.default_rng(3)
    docs = [toxicity.cut_down(toxicity.sentences(t), {"aa", "bb", "cc"}) for t in ("aa bb. cc. xx. yy", "bb. bb. aa cc!", "", "cc aa. zz")]
    y, weight, theta = np.array([1.0, 0, 0, 1]), np.array([0.4, 0.1, 0.2, 0.3]), r.normal(0, 1, 4)
    rows = [(i, n, s) for i, d in enumerate(docs) for s, n in sorted(d.items()) if s]
    place = {"aa": 0, "bb": 1, "cc": 2}
    args = [y, weight, np.array([i for i, *_ in rows]), np.array([n for _, n, _ in rows], float), np.repeat(np.arange(len(rows)), [len(s) for *_, s in rows]), np.array([place[f] for *_, s in rows for f in s])]

    def loss(theta):
        total = 0
        for d, t, w in zip(docs, y, weight, strict=True):
            clean = 1.0
            for s, n in d.items():
                clean *= (1 - (1 / (1 + np.exp(-(theta[-1] + sum(theta[place[f]] for f in s)))) if s else 0)) ** n
            total -= w * np.log(max(1e-12, 1 - clean) if t else clean)
        return total

    got, g = toxicity.gradient(theta, *args)
    assert np.isclose(got, loss(theta))
    for i in range(4):
        step = np.eye(4)[i] * 1e-6
        assert np.isclose(g[i], (loss(theta + step) - loss(theta - step)) / 2e-6, rtol=1e-4)
    m = Model(-1.0, {"aa": 2.0, "bb": -0.5})
    p = lambda x: 1 / (1 + np.exp(-x))
    assert np.isclose(m.document("Aa bb. aa! zz")[0], 1 - (1 - p(0.5)) * (1 - p(1.0)))
    assert np.isclose(m.document("zz. yy. xx")[0], p(-1.0)) and np.isclose(m.document("")[0], p(-1.0))


def test_held_out(spark):
    got = spark.range(50).withColumn("h", held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
