import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import mixing as mx


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    sources = ["big"] * 12 + ["mid"] * 4 + ["small", None]
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20])), rng.choice(sources), "own") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string").repartition(3)


def best_exponent(shares, target, ratio):
    """By plain bisection."""
    goal = None if target.entropy is None else target.entropy * math.log(len(shares)) - 1e-12
    a = 1.0
    if goal is not None and mx.measures(shares, 1.0, ratio)[0] < goal:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if mx.measures(shares, mid, ratio)[0] >= goal else (low, mid)
        a = low
    if target.repeats is not None and mx.measures(shares, a, ratio)[1] > target.repeats + 1e-12:
        low, high = a, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if mx.measures(shares, mid, ratio)[1] <= target.repeats + 1e-12 else (mid, high)
        a = high
    return a


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("target", [mx.Target(), mx.Target(0.99, None), mx.Target(1.0, 1.5), mx.Target(None, None), mx.Target(0.9, 8.0, cover=True), mx.Target(0.95, 4.0, 900)])
def test_exponent_and_budgets(spark, target):
    rows = corpus()
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}
    ratio = None if target.cover else (target.budget or total) / total
    a = best_exponent(list(shares.values()), target, ratio)
    z = sum(x**a for x in shares.values())
    budget = max(x / (x**a / z) for x in shares.values()) * total if target.cover else ratio * total
    out = mx.mixed(frame(spark, rows), target, block_tokens=100).collect()
    got = Counter()
    for r in out:
        got[r.source] += len(r.text.split())
    for s, x in shares.items():
        goal = x**a / z * budget
        # Whole rows only: at most one row's tokens short, and never over.
        assert goal - 21 < got[s] <= goal + 1e-3 * goal, (s, goal, got[s])
    epochs = {}
    for r in out:
        epochs.setdefault((r.doc_id, r.source), []).append(r.epoch)
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    for s in shares:
        n = [len(epochs.get((i, s), [])) for i, _, x, _ in rows if x == s]
        assert max(n) - min(n) <= 1
    if target.cover:
        assert len(epochs) == len(rows)


def test_parts_follow_the_block_permutation(spark):
    rows = corpus(3)
    out = mx.mixed(frame(spark, rows), mx.Target(None, None, 700), block_tokens=100).where("source = 'big'").collect()
    taken = {}
    for r in out:
        taken.setdefault((r.block_order, r.block), 0)
    every = {(r.block_order, r.block) for r in mx.mixed(frame(spark, rows), mx.Target(None, None), block_tokens=100).where("source = 'big'").collect()}
    assert set(taken) == set(sorted(every)[: len(taken)])


def test_same_result_again_and_hash(spark):
    df = frame(spark, corpus(4))
    a, b = (sorted((r.doc_id, r.epoch, r.block, r.row_order) for r in mx.mixed(df).collect()) for _ in range(2))
    assert a == b
    h = df.where("doc_id = 3").select(F.xxhash64("doc_id")).first()[0]
    assert h == signed(xxhash.xxh64_intdigest((3).to_bytes(8, "little"), seed=42))


def test_own_columns_of_any_name(spark):
    names = ["state", "whole", "cut", "key", "copies", "row_key", "row_hash", "Plan", "a.b"]
    df = frame(spark, corpus(4)).select("*", *(F.col("doc_id").alias(c) for c in names))
    out = mx.mixed(df)
    assert out.columns == ["doc_id", "text", "source", *names, "epoch", "block", "block_order", "row_order"]
    assert all(r[c] == r.doc_id for r in out.collect() for c in names)


def test_edges(spark):
    assert mx.mixed(frame(spark, corpus(n=0))).collect() == []
    only = mx.mixed(frame(spark, [(1, None, "a", "x"), (2, "", None, "x")])).collect()
    assert sorted((r.doc_id, r.epoch) for r in only) == [(1, 0), (2, 0)]
    same = mx.mixed(frame(spark, [(1, "a b", "s", "x")] * 3 + [(None, "c", "t", "x"), (5, "w " * 60000, "t", "x")]), mx.Target(None, None)).collect()
    assert Counter(r.doc_id for r in same) == {1: 3, None: 1, 5: 1}
