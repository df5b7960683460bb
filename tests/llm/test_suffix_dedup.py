import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import suffix_dedup as sd
from fathomline.llm.suffix_dedup import remove_repeats


def brute_force(rows, length, words):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    split = [d.split() for d in texts]
    places = {}
    for r, w in enumerate(split):
        for i in range(len(w) - words):
            places.setdefault(tuple(w[i : i + words + 1]), set()).add(r)
    out = []
    for r, ((k, _), d) in enumerate(zip(rows, texts)):
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        shared = {j for i in range(len(split[r]) - words) if len(places[tuple(split[r][i : i + words + 1])]) > 1 for j in range(i, i + words + 1)}
        out.append((k, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest(), len(shared), bool(shared)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passages = [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(10, 120))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 4))]
        text = "\n".join(parts)
        if rows and rng.random() < 0.3:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = "z"
            text = "".join(text)
        rows.append((i, text))
    rows.append((500, "ab" * 600))
    rows.append((501, "q" * 900))
    rows.append((502, "la la " * 90))
    rows.append((503, passages[0] + " x " + passages[0]))
    return rows


@pytest.mark.parametrize(("length", "words", "in_memory"), [(100, 12, 16384), (100, 20, 1), (40, 5, 3), (20, 3, 16384), (7, 1, 16384)])
def test_matches_brute_force(spark, length, words, in_memory):
    rows = corpus(length + in_memory)
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, rid int, uid string").repartition(3)
    got = sorted([tuple(r) for r in remove_repeats(df, length, words, in_memory=in_memory).collect()], key=str)
    assert got == brute_force(rows, length, words)


def test_nulls_ties_and_empty(spark):
    rows = [(None, "x" * 10), (1, None), (1, ""), (2, "abcdefghij"), (2, "abcdefghij"), (2, "other text here"), (None, "some other text here"), (3, "a b c d"), (3, "a b c d"), (4, "one two three one two three")]
    got = sorted([tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8, 2).collect()], key=str)
    assert got == brute_force(rows, 8, 2)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts(spark):
    row = remove_repeats(spark.createDataFrame([(1, "head" + "r" * 9), (2, "unlike")], "doc_id long, text string"), 8, 0, texts=True).where("doc_id = 1").first()
    assert (row.starts, row.ends, bytes(row.kept), row.n_shared_words) == ([4], [13], b"head", 0)


def test_later_digits_decide_where_first_digits_collide():
    rng = np.random.default_rng(4)
    for size, width in ((40, 16), (16, 16), (9, 16), (3, 4), (33, 8)):
        tokens = rng.integers(0, 2, 700).astype(np.uint8)
        starts = np.arange(len(tokens) - size + 1)
        alive, group = sd.repeated(tokens, np.zeros(len(starts), np.int64), starts, size, width)
        of = {}
        for p in starts:
            of.setdefault(tokens[p : p + size].tobytes(), []).append(int(p))
        want = sorted(v for v in of.values() if len(v) > 1)
        got = {}
        for p, g in zip(alive.tolist(), group.tolist()):
            got.setdefault(g, []).append(p)
        assert sorted(map(sorted, got.values())) == want


def test_many_rows_of_one_id_cost_no_more_than_others(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2500)]
    texts += texts
    spent = []
    for ids in (range(len(texts)), [None] * len(texts), range(len(texts)), [None] * len(texts)):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        assert remove_repeats(df, 100).where("n_removed = n_bytes and n_shared_words = 60").count() == len(texts)
        spent.append(time.perf_counter() - began)
    assert spent[3] < 2 * spent[2] + 1
