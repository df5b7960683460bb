import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import hmm_scoring as hs


def small(seed=0, states=3, classes=4):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hs.Model(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))))


def path_probability(m, seq, path):
    p = m.start[path[0]] * m.emit[path[0], seq[0]]
    for a, b, c in zip(path, path[1:], seq[1:]):
        p *= m.move[a, b] * m.emit[b, c]
    return p


def test_forward_and_expected_match_all_paths():
    m, rng = small(), random.Random(1)
    seqs = [np.array(rng.choices(range(4), k=k), np.uint16) for k in (1, 2, 5, 4, 1)]
    got = hs.forward(seqs, m)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for s, g in zip(seqs, got):
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = [path_probability(m, s, x) for x in paths]
        assert math.isclose(math.log10(sum(p)), g, rel_tol=1e-9)
        for x, q in zip(paths, np.array(p) / sum(p)):
            start[x[0]] += q
            for a, b in zip(x, x[1:]):
                move[a, b] += q
            for a, c in zip(x, s):
                emit[a, c] += q
    for a, b in zip(hs.expected(seqs, m), (start, move, emit)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


def test_blocks_count_each_token_move_and_start_once():
    m, rng = small(5), random.Random(6)
    seqs = [np.array(rng.choices(range(4), k=k), np.uint16) for k in (1, 7, 8, 9, 100, 23)]
    blocks = [b for s in seqs for b in hs.blocks_of(s, 8, 3)]
    start, move, emit = hs.expected([b for b, _ in blocks], m, [n for _, n in blocks])
    assert np.allclose(emit.sum(0), np.bincount(np.concatenate(seqs), minlength=4), rtol=1e-4)
    assert math.isclose(start.sum(), len(seqs), rel_tol=1e-4) and math.isclose(move.sum(), sum(len(s) - 1 for s in seqs), rel_tol=1e-4)
    # With a long lead the counts come near to those of whole texts.
    whole = hs.expected(seqs, m)
    parts = [b for s in seqs for b in hs.blocks_of(s, 64, 16)]
    near = hs.expected([b for b, _ in parts], m, [n for _, n in parts])
    assert all(np.allclose(a, b, rtol=0.05, atol=0.3) for a, b in zip(whole, near))


def test_class_probabilities_sum_to_one():
    m = small(2)
    every = [np.array(x, np.uint16) for x in itertools.product(range(4), repeat=3)]
    assert math.isclose(sum(10 ** hs.forward(every, m)), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("top", [100000, 5, 0])
def test_base_score_and_gain(spark, top):
    rng = random.Random(3)
    words = {x: [f"{x}{i}" for i in range(40)] + ["The", "É"] for x in "ab"}
    rows = [(i, " ".join(rng.choices(words[rng.choice("ab")], k=rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (None, "unseen word The the"), (1, "a1 " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(2)
    out = hs.language_model_scores(df, F.col("doc_id") % 5 == 1, hs.Settings(states=2, passes=4), top=top).collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split()
    held = lambda k: k is not None and k % 5 == 1
    count = Counter(w for k, t in rows if not held(k) for w in lower(t))
    end = sum(not held(k) for k, _ in rows)
    n, v = sum(count.values()) + end, len(count) + 1
    lp = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted([(str(k), held(k), len(lower(t)) + 1, sum(count[w] > 0 for w in lower(t)) + 1, n, round(sum(lp(count[w]) for w in lower(t)) + lp(end), 6)) for k, t in rows])
    assert sorted([(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hs.language_model_scores(none, F.lit(True)).collect() == []
    r = hs.language_model_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
