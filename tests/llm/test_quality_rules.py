import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from fathomline.llm import quality_rules as qr


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def scores(rows, trusted):
    grams = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams.append([spark_hash(x) % qr.BUCKETS for x in w] + [spark_hash(spark_hash(x[-3:]), spark_hash(y[-3:])) % qr.BUCKETS for x, y in zip(w, w[1:])])
    raw = Counter(g for x in grams for g in x)
    target = Counter(g for (k, _), x in zip(rows, grams) if k in trusted for g in x)
    nr, nt = sum(raw.values()), sum(target.values())
    ratio = lambda g: math.log((target[g] + 1) / (nt + qr.BUCKETS)) - math.log((raw[g] + 1) / (nr + qr.BUCKETS))
    return [sum(map(ratio, x)) / len(x) if x else 0.0 for x in grams]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcé#|", k=rng.randint(1, 3)))
    rows = []
    for i in range(150):
        line = lambda: rng.choice([" ", "\t", "\x0b "]).join(word() for _ in range(rng.randint(0, 14)))
        lines = [line() for _ in range(rng.randint(0, 8))]
        text = "\n".join(rng.choice(lines) if lines and rng.random() < 0.4 else x for x in lines)
        rows.append((i, text + rng.choice(["", "\n", " a b c d e f g h" * 3, " same" * 9, "\xa0 x"])))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t\n "), (1003, "w " * 20001), (1004, "a b c d e f g h"), (1005, "a b c d e f g h " * 2), (1, "row with an id that is there twice")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string").repartition(3)
    trusted = {k for k, _ in rows if k % 2}
    out = qr.quality_rules(df, spark.createDataFrame([(k,) for k in trusted] + [(None,), (3,)], "doc_id long")).collect()
    key = lambda r: (r[0], r[1])
    want = sorted([(k, *base(t)[:5], base(t)[5], s) for (k, t), s in zip(rows, scores(rows, trusted))], key=key)
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.score) for r in out], key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(abs(g[7] - w[7]) < 1e-9 for g, w in zip(got, want))
    assert all(r.kept == (not r.base_failed and r.score >= qr.THRESHOLD) for r in out)


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert qr.quality_rules(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    out = qr.quality_rules(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), none).collect()
    assert sorted(r.n_words for r in out) == [0, 2] and not any(r.kept for r in out)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = qr.quality_rules(df, df.select("doc_id"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and F is not None
