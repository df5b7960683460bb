import random

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import language_id as li


def greedy(text, sample):
    """Phrases of a whole text, by plain substring search."""
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += max(1, size)
        n += 1
    return n


def test_phrases_match_plain_search():
    rng = random.Random(1)
    samples = {x: bytes(rng.choices(alphabet, k=300)) for x, alphabet in (("a", b"abc "), ("b", b"abcd "), ("c", b"cde\xc3\xa9"))}
    texts = [bytes(rng.choices(b"abcde \xc3\xa9z", k=rng.choice([0, 1, 2, 30, 1023, 1024, 1025, 2600, 5000]))) for _ in range(60)]
    texts += [samples["a"][:200] * 30, (samples["b"] + b"z") * 9, b"z" * 3000, samples["c"] * 8]
    got = li.phrases(texts, li.build(samples).tables())
    assert got.tolist() == [[greedy(t, samples[x]) for x in sorted(samples)] for t in texts]


def test_automaton_accepts_substrings_only():
    data = b"abracadabra"
    edges, _ = li.suffix_automaton(data)
    step = {(s, c): t for s, c, t in edges.tolist()}

    def accepts(word):
        state = 0
        for c in word:
            state = step.get((state, c))
            if state is None:
                return False
        return True

    words = {bytes(np.random.default_rng(i).choice(list(b"abrcd"), size=1 + i % 5)) for i in range(300)}
    assert all(accepts(w) == (w in data) for w in words)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(2)
    parts = {"x": ["th", "er", "ing", "on"], "y": ["sch", "ung", "ein", "ü"], "z": ["eau", "tion", "é", "oi"]}
    text = lambda x: " ".join("".join(rng.choices(parts[x], k=rng.randint(1, 4))) for _ in range(rng.randint(2, 60)))
    data = [(i, text(x), x) for i in range(300) for x in [rng.choice("xyz")]]
    docs = spark.createDataFrame(data + [(900, None, "x"), (901, " 12 !!", "y"), (902, "eau " * 9000, None), (None, "sch ung", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    model = li.fit(docs, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in li.identified(docs, model).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in data if i % 2]) > 0.97
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "z"
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 304


def test_whole_table_matches_brute_force(spark):
    rng = random.Random(7)
    text = lambda x, n: "".join(rng.choices({"x": "abc ", "y": "abd ", "z": "ace "}[x], k=n))
    data = [(i, text(x, rng.choice([3, 40, 3000])), x) for i in range(90) for x in [rng.choice("xyz")]] + [(900, "\u00bd \u00b2 \u2167 12", "x"), (901, "", None), (902, "zzz", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = li.fit(docs, F.col("doc_id") % 5 != 0, li.Settings(bytes_per_language=2000))
    samples = {x: sample_of(e, n) for x, e, n in zip(model.languages, model.edges, model.states)}
    got = {r.doc_id: r for r in li.identified(docs, model).collect()}
    for i, t, _ in data:
        clean = li.normalised(t.encode())
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        counts = sorted((greedy(clean, samples[x]), x) for x in samples)
        assert got[i].lang_pred == counts[0][1] and np.isclose(got[i].score, 1 - counts[0][0] / counts[1][0])


class sample_of:
    """The substrings that an automaton accepts."""

    def __init__(self, edges, states):
        self.step = {(a, c): b for a, c, b in edges.tolist()}

    def __contains__(self, word):
        state = 0
        for c in word:
            state = self.step.get((state, c))
            if state is None:
                return False
        return True


def test_samples_are_whole_texts_of_all_languages(spark):
    rows = [(i, f"{'banner ' if i % 2 else ''}{chr(97 + i % 3) * 5} end{i % 7}", f"l{i % 150:03}") for i in range(1500)] + [(5000, "long " * 3000 + "tail", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs, F.lit(True), li.Settings(bytes_per_language=300, total_bytes=30_000))
    assert len(model.languages) == 151 and all(n <= 2 * 30_000 // 151 + 2 for n in model.states)
    texts = sorted({t for _, t, x in rows if x == "l000"})
    k = model.languages.index("l000")
    assert any(li.normalised(t.encode()) in sample_of(model.edges[k], 0) for t in texts)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert li.identified(docs, li.fit(docs, F.lit(True))).first().lang_pred == "und"
    none = docs.where("doc_id = 2")
    assert li.identified(none, li.fit(none, F.lit(True))).collect() == []
