import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import quality_classifier as qc


def rows(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(2, 6)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.5
        out.append((i, " ".join(words) + "." if good else " ".join(w + "***" for w in words), int(good)))
    return out


def test_ftrl_matches_a_plain_loop():
    s = qc.Settings(bits=6, epochs=1)
    texts, labels = [t.encode() for _, t, _ in rows(1, 30)], [q for _, _, q in rows(1, 30)]
    w, bias = qc.train(texts, labels, s)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for k in np.random.default_rng(s.seed).permutation(30):
        x = {64: 1.0}
        for i, v in zip(*qc.features(texts[k], 6)):
            x[int(i)] = x.get(int(i), 0.0) + float(v)
        ws = {i: weight(i) for i in x}
        p = 1 / (1 + np.exp(-sum(ws[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - labels[k]) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * ws[i]
            n[i] += g * g
    assert np.allclose(w, [weight(i) for i in range(64)], atol=1e-4)
    assert abs(bias - weight(64)) < 1e-4


def test_held_out_accuracy_and_edges(spark):
    data = rows(2, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9000, None), (9001, ""), (None, "x y"), (9002, "word " * 40000)], "doc_id long, text string").withColumn("quality", F.lit("own column"))
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    model = qc.fit(docs, labels, F.col("doc_id") < 200)
    got = {r.doc_id: r.score for r in qc.scored(docs, model).collect()}
    assert len(got) == 404 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, _, q in data[200:]]) > 0.97
    assert got[9000] == got[9001]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = qc.fit(docs, labels, F.lit(True))
    assert qc.scored(docs, model).collect() == []
    assert qc.scored(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first().score == 0.5


def test_training_holds_features_in_few_bytes():
    s = qc.Settings(bits=12, epochs=1)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(60)).encode() for _ in range(1500)]
    held = sum(len(np.unique(qc.features(t, s.bits)[0])) + 1 for t in texts)
    qc._seen.clear()
    words = len({w for t in texts for w in t.split()})
    tracemalloc.start()
    qc.train(iter(texts), [k % 2 for k in range(len(texts))], s)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # 12 bytes a feature beside the words' hashes; what is left is the weights.
    assert peak < 14 * held + 400 * words + 1_000_000
    assert not qc._seen and kept < 1_000_000
