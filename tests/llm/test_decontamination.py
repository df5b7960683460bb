import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomline.llm import decontamination as dc


def brute_force(rows, items, least=0.8, width=5):
    out = {}
    for k, t in rows:
        w = dc.words_of(t or "")
        for i, x in items:
            y = dc.words_of(x or "")
            if not w or not y:
                continue
            want = dc.shingles(y, width)
            s = max(dc.weighted_jaccard(want, dc.shingles(w[max(0, a) : a + len(y)], width)) for a in range(-dc.SHIFT, max(1, len(w))) if w[max(0, a) : a + len(y)])
            if s >= least:
                out.setdefault(k, set()).add(i)
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(400)] + ["the", "of"] * 30
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(text(rng.choice([1, 2, 3, 5, 9, 15, 22, 40, 59])))) for i in range(25)] + [(90, None), (91, ""), (92, "!!")]
    rows = []
    for i in range(250):
        w = text(rng.choice([0, 5, 60, 300]))
        if rng.random() < 0.5:
            x = rng.choice(items[:25])[1].split()
            if rng.random() < 0.4 and len(x) > 20:
                x[rng.randrange(len(x))] = "edited"
            if rng.random() < 0.2:
                x = x[: len(x) * 2 // 3]
            at = rng.randint(0, len(w))
            w = w[:at] + x + w[at:]
        s = " ".join(w)
        rows.append((i, s.upper() if rng.random() < 0.1 else s.replace(" ", "!! ") if rng.random() < 0.1 else s))
    return rows, items


def test_finds_what_brute_force_finds(spark):
    rows, items = corpus(1)
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, kept string").repartition(3)
    out = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: set(r.item_ids) for r in out if r.contaminated}
    want = brute_force(rows, items)
    pairs = lambda x: {(k, i) for k, v in x.items() for i in v}
    assert pairs(got) <= pairs(want)
    missed = pairs(want) - pairs(got)
    assert len(missed) <= 0.02 * len(pairs(want)), missed
    assert len(out) == len(rows) and all(r.kept != r.contaminated and r.n_items == len(r.item_ids) and (r.best_similarity >= 0.8) == r.contaminated for r in out)


def test_indexes_list_all_prints_within_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, 20, dtype=np.uint64)
    tables = dc._Class(9, 4, prints, np.arange(20), np.zeros(20)).tables()
    which = rng.integers(0, 20, 3000)
    flips = [rng.choice(64, rng.integers(0, dc.RADIUS + 1), replace=False).astype(np.uint64) for _ in which]
    windows = np.array([prints[k] ^ np.bitwise_or.reduce(np.uint64(1) << f, initial=np.uint64(0)) for k, f in zip(which, flips)])
    x, y = dc.candidates(windows, tables)
    assert {(i, int(k)) for i, k in enumerate(which)} <= set(zip(x.tolist(), y.tolist()))
    assert all(min((int(windows[i] ^ prints[k]) >> lo & (1 << hi - lo) - 1).bit_count() for lo, hi in dc.BLOCKS) <= dc.RADIUS // 3 for i, k in zip(x, y))


def test_candidates_of_a_window_are_few_however_many_items_there_are():
    rng = np.random.default_rng(6)
    windows = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    for n in (800, 8000):
        prints = rng.integers(0, 2**64, n, dtype=np.uint64)
        x, _ = dc.candidates(windows, dc._Class(50, 4, prints, np.arange(n), np.zeros(n)).tables())
        # A block's value has 1 + 22 + 231 + 1540 others within three bits, of four million.
        assert len(x) / len(windows) < 0.003 * n


def test_fingerprint_matches_a_plain_loop():
    words = "a b c a b d e".split()
    h = dc._hashes(words)
    bits = dc._pairs(h).astype(int)
    sums = dc._Sums(h)
    for a, b in ((0, 7), (2, 7), (2, 5), (3, 5)):
        want = sum(1 << k for k in range(64) if sum(2 * bits[i][k] - 1 for i in range(a, b - 1)) > 0)
        if b - a == 5:
            assert int(dc.even_fingerprints(dc._Sums(h[a:]), 5, 1)[0]) == want
        assert int(dc.fingerprints(sums, np.array([a]), np.array([b]))[0]) == want
    assert dc.fingerprints(sums, np.array([0, 3]), np.array([1, 4])).tolist() == [int(dc.mix64(h[:1] * dc._FACTOR)[0])] * 2
    long = dc._hashes([str(i % 37) for i in range(200)])
    sums, starts = dc._Sums(long), np.arange(0, 180, dc.STRIDE)
    for size in (2, 5, 9, 12, 18, 19):
        assert dc.even_fingerprints(sums, size, len(starts)).tolist() == dc.fingerprints(sums, starts, starts + size).tolist()


def test_words():
    assert dc.words_of("A_b c-D9\x1c\x85 É’s!") == ["a", "b", "c", "d9", "é", "s"]
    assert dc.words_of("A_b c-D9\x1c \t") == ["a", "b", "c", "d9"]


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rows, items = corpus(2)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, tuple(r.item_ids)) for r in dc.decontaminate(docs, bench).collect()}
    monkeypatch.setattr(dc, "ITEMS", 10)
    got = {(r.doc_id, tuple(r.item_ids)) for r in dc.decontaminate(docs, bench).collect()}
    assert len(got ^ one) <= 4


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, item), (1, None), (1, ""), (2, "\n!! "), (3, item), (3, item), (4, "x " * 20000 + item + " y" * 20000)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")
    out = dc.decontaminate(docs, bench).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in out) == [("1", False), ("1", False), ("2", False), ("3", True), ("3", True), ("4", True), ("None", True)]
    none = bench.where(F.lit(False))
    assert not any(r.contaminated for r in dc.decontaminate(docs, none).collect())
    assert dc.decontaminate(docs.where(F.lit(False)), bench).collect() == []


def edited(seed, lengths, each):
    """(kind of edit, document, item) with the most words changed in one piece, at a place of the item, that leave it 0.8 alike, and one word fewer or more."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for n in lengths:
        for k in range(each):
            item = [word() for _ in range(n)]
            r = (n - 4) // 9 + rng.choice([-1, 0, 0, 0, 1])
            at = rng.randrange(5, n - r - 5)
            m = max(1, r - 4)
            around = [[word() for _ in range(rng.randrange(30))] for _ in range(2)]
            new = [word() for _ in range(max(r, m))]
            for kind, passage in {
                "head replaced": new[:r] + item[r:], "head trimmed": item[r:], "tail replaced": item[: n - r] + new[:r], "tail trimmed": item[: n - r],
                "middle replaced": item[:at] + new[:m] + item[at + m :], "middle inserted": item[:at] + new[:m] + item[at:], "middle cut": item[:at] + item[at + m :],
            }.items():
                yield kind, " ".join(around[0] * (k % 3 > 0) + passage + around[1] * (k % 3 < 2)), " ".join(item)


def found_by_kind(cases):
    """Pairs by kind of edit that an exact search of all windows accepts, and those of them that the operator's row function gives."""
    items = dc.prepared([(i, x) for i, (_, _, x) in enumerate(cases)], 5, 0.8)
    batch = pa.RecordBatch.from_arrays([pa.array([d for _, d, _ in cases])], names=["text"])
    (out,) = dc._searched(SimpleNamespace(value=items), 0.8)(iter([batch]))
    want, got = Counter(), Counter()
    for i, ((kind, doc, item), hits) in enumerate(zip(cases, out.column("hits").to_pylist())):
        w, y = doc.split(), item.split()
        best = max(dc.weighted_jaccard(dc.shingles(y, 5), dc.shingles(w[max(0, a) : a + len(y)], 5)) for a in range(1 - len(y), len(w)))
        mine = {h["item_id"]: h["similarity"] for h in hits}
        assert (i in mine) <= (best >= 0.8) and mine.get(i, best) == best
        want[kind] += best >= 0.8
        got[kind] += i in mine
    return want, got


def test_edits_in_one_piece_are_all_found():
    want, got = found_by_kind(list(edited(11, [24, 49, 59, 100, 200], 12)))
    assert len(want) == 7 and min(want.values()) >= 20
    assert got == want


def test_windows_of_items_that_repeat_shingles():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choices(["a", "b"], k=n))
    cases = [(str(n), some(120), some(n)) for n in [1, 2, 3, 4, 5, 6, 8] * 12]
    want, got = found_by_kind(cases)
    assert sum(want.values()) > 30 and got == want
