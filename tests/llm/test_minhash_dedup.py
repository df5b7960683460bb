import random
import time

import pytest

from fathomline.llm.minhash_dedup import near_duplicates


def brute_force(rows, size, percent):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split(None) if text else []
        n = len(words) - min(size, len(words)) + 1
        sets.append({tuple(words[i : i + size]) for i in range(n)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(sets[i]), k if not sets[i] else least.get(root(i)), k == (k if not sets[i] else least.get(root(i)))) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "Straße", "A", "a"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            text = rng.choice([" ", "\n", "\t "]).join(base)
        else:
            text = " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 30, 60, 200])))
        rows.append((i * 3 % 1009, text))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_matches_brute_force(spark, size):
    rows = corpus(size)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = sorted([tuple(r) for r in near_duplicates(df, size, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)
    assert got == brute_force(rows, size, 80)


def test_nulls_ties_and_empty(spark):
    rows = [(None, "a b c d"), (None, "q r s"), (5, "a b c d"), (5, "a b c d"), (4, None), (3, ""), (2, " \n"), (9, "one"), (8, "ONE"), (7, "x " * 30000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(
        [(None, 3, 5, False), (None, 2, None, True), (5, 3, 5, True), (5, 3, 5, True), (4, 0, 4, True), (3, 0, 3, True), (2, 0, 2, True), (9, 1, 8, False), (8, 1, 8, True), (7, 1, 7, True)], key=str
    )
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_rows_of_one_id_cost_no_more_than_others(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2500)]
    texts += [t + " end" for t in texts]
    spent = []
    for ids in (range(len(texts)), [None] * len(texts), range(len(texts)), [None] * len(texts)):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        assert near_duplicates(df, 5, 80).where("n_shingles > 0").count() == len(texts)
        spent.append(time.perf_counter() - began)
    assert spent[3] < 2 * spent[2] + 1


def test_ids_of_text(spark):
    rows = [("b", "one two three"), ("a", "one two three"), ("c", "other")]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), 2, 80).select("doc_id", "component_id", "kept").collect())
    assert got == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_group_wider_than_a_block(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(700):
        w = list(base)
        for k in rng.sample(range(40), rng.choice([0, 1, 2, 3, 6])):
            w[k] = f"n{i}-{k}"
        rows.append((i, " ".join(w)))
    got = sorted([tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()], key=str)
    assert got == brute_force(rows, 2, 80)
