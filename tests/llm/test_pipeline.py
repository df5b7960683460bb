import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import decontamination as dc

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    """Documents with known fates: junk, near copies, benchmark passages, personal values and clean ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    text = lambda n=80: " ".join(word() for _ in range(n)) + "."
    items = [(i, text(25)) for i in range(5)] + [(9, None)]
    fate, rows = {}, []

    def add(kind, t):
        fate[len(rows)] = kind
        rows.append((len(rows), t, "en", rng.choice(["a", "a", "a", "b"]), len(t)))

    for _ in range(120):
        add("clean", text())
    for k in range(60):
        add("junk", " ".join(word() + "***" for _ in range(60)))
    for k in range(30):
        add("copy", rows[k][1] + " " + word())
    for k in range(20):
        add("leak", text(30) + " " + items[k % 5][1] + " " + text(30))
    luhn = lambda d: -sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10
    for k in range(20):
        card = f"4111111111111{k:02}"
        add("private", text() + f" {card}{luhn(card)} +1 (974) 555-34{k:02} someone.{k}@mail.example.com")
    labels = [(i, int(f != "junk"), 0) for i, f in fate.items() if i % 3]
    for name, df in (
        ("documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")),
        ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame(items, "item_id long, text string")),
    ):
        df.write.parquet(os.path.join(folder, f"{name}.parquet"))
    return fate, {r[0]: r for r in rows}, items


@pytest.fixture(scope="module", autouse=True)
def key(spark):
    spark.conf.set("spark.fathomline.pii.key", "of the tests")
    yield
    spark.conf.unset("spark.fathomline.pii.key")


@pytest.fixture(scope="module")
def staged(spark, key, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    fate, rows, items = tables(spark, folder)
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        path = os.path.join(folder, f"out-{name}.parquet")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.columns, docs.collect()))
    return fate, rows, items, out, folder


def test_stages_have_their_fates(staged):
    fate, rows, items, out, _ = staged
    kept = {name: {r.doc_id for r in found} for name, _, found in out}
    of = lambda *kinds: {i for i, f in fate.items() if f in kinds}
    assert kept["quality"] == of("clean", "copy", "leak", "private")
    assert kept["near_dedup"] == of("clean", "leak", "private")
    assert kept["decontaminate"] == kept["pii"] == kept["mix"] == of("clean", "private")
    for name, columns, _ in out[:-1]:
        assert columns == COLUMNS, name


def test_texts(staged):
    fate, rows, _, out, _ = staged
    for r in out[3][2]:
        assert r.n_chars == len(r.text)
        if fate[r.doc_id] == "clean":
            assert r.text == rows[r.doc_id][1]
        else:
            assert not set(re.findall(r"[0-9]{16}|555-[0-9]{4}|\S+@mail\S+", rows[r.doc_id][1])) & set(re.findall(r"[0-9]{16}|555-[0-9]{4}|\S+@mail\S+", r.text))


def test_mix_covers_all_rows(staged):
    _, _, _, out, _ = staged
    epochs = {}
    for r in out[-1][2]:
        epochs.setdefault((r.doc_id, r.source), []).append(r.epoch)
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    assert max(map(len, epochs.values())) > 1


OWN = ["state", "hits", "text_hash", "kept_id", "score", "kept", "contaminated", "__found", "n_pii", "pii_made", "blocks", "whole", "cut", "row_key", "plan", "uid", "sig", "x", "rid", "a.b"]


def test_own_columns_of_any_name_come_through(spark, staged):
    _, rows, _, out, folder = staged
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in OWN))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, wide, folder)
        path = os.path.join(folder, f"wide-{name}.parquet")
        made.write.parquet(path)
        wide = spark.read.parquet(path)
        found = wide.collect()
        assert {r.doc_id for r in found} == {r.doc_id for r in out[k][2]}, name
        assert wide.columns[: len(COLUMNS) + len(OWN)] == [*COLUMNS, *OWN], name
        assert all(r[c] == f"{c} of {r.doc_id}" for r in found for c in OWN), name


def test_run_is_the_stages(spark, staged):
    _, _, _, out, folder = staged
    order = lambda r: (r.doc_id, r.epoch, r.text)
    assert sorted(map(order, corpus_pipeline.run(spark, folder).collect())) == sorted(map(order, out[-1][2]))
    assert dc is not None and corpus_pipeline.ORACLE_SQL is None
