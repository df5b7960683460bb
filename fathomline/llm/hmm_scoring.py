"""Language-model scoring: a unigram base and a hidden Markov model trained by Baum-Welch.

The HMM emits word classes: each of the OWN most frequent training words has a class of its own, other words
share one by their last three bytes, and the end of a text is a class. Within a class a word has its
smoothed share of the class's training tokens, so a text's probability is that of its classes times that
of its words given their classes. Word counts are taken over all training texts and stay distributed; only up
to TOP most frequent words, a number that does not grow with the corpus, go to every worker, and all
other words meet their counts in a join. Expected counts of Baum-Welch are summed over partitions by a
group-by. Training texts go through it in blocks of BLOCK tokens: a text's first block starts from the model's
start distribution, and only first blocks are counted as starts; the others go on from the chain's stationary
distribution, and the LEAD tokens before them, whose own counts belong to the block before, bring the state to where
the text is. No token and no move is counted twice or left out. Scores come from the scaled forward recursion over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm._common import batches, saved, utf8

#: Classes: 0 the end of a text, 1 to OWN frequent words, then SHARED by ending.
OWN, SHARED = 512, 511
CLASSES = 1 + OWN + SHARED
TOP = 100_000
BLOCK, LEAD = 256, 16
#: Blocks that Baum-Welch takes side by side, and tokens that it gathers before.
LANES, GATHERED = 1024, 1 << 22


@dataclass(frozen=True)
class Settings:
    states: int = 8
    passes: int = 6
    smoothing: float = 0.1
    seed: int = 11


class _Ids(dict):
    """Word -> running number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token, tokens of each text, hash and ending class of each number) of texts with A-Z lower-cased."""
    ids = _Ids()
    parts = [np.fromiter(map(ids.__getitem__, t.lower().split()), np.int32) for t in texts]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, ids), np.uint64, len(ids)).view(np.int64)
    ends = np.fromiter((digest(w[-3:]) % SHARED for w in ids), np.int32, len(ids))
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), sizes, hashes, ends


@batches
def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    tokens, _, hashes, ends = _numbered(list(utf8(batch.column(0))))
    return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ends), pa.array(np.bincount(tokens, minlength=len(hashes)).astype(np.int64))], names=["h", "ending", "n"])


@dataclass
class _Words:
    """What every worker has of the counts: hashes (ascending), counts and classes of the TOP words, and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_log: np.ndarray
    total: int
    kinds: int
    end: int

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.kinds + 1)))


def _described(shared):
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "classes", "rare", "rare_class", "rare_n"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w: _Words = shared.value
        tokens, sizes, hashes, ends = _numbered(list(utf8(batch.column(3))))
        at = np.minimum(np.searchsorted(w.hashes, hashes), max(0, len(w.hashes) - 1))
        top = w.hashes[at] == hashes if len(w.hashes) else np.zeros(len(hashes), bool)
        c = np.where(top, w.counts[at], 0) if len(w.hashes) else np.zeros(len(hashes), np.int64)
        own = np.where(top, w.classes[at], 0) if len(w.hashes) else np.zeros(len(hashes), np.int64)
        kind = np.where(own > 0, own, 1 + OWN + ends).astype(np.uint16)
        base = np.where(top, w.base_log(c), 0.0)
        inner = np.where(top & (own == 0), np.log10(c + 0.5) - w.class_log[ends], 0.0)
        starts = np.r_[0, np.cumsum(sizes)]
        end_base, rows = float(w.base_log(np.array(w.end))), []
        for i in range(len(sizes)):
            t = tokens[starts[i] : starts[i + 1]]
            numbers, n = np.unique(t[~top[t]], return_counts=True)
            rows.append((
                len(t) + 1, int(top[t].sum()) + (w.end > 0), float(base[t].sum()) + end_base, float(inner[t].sum()), np.append(kind[t], np.uint16(0)).tobytes(),
                hashes[numbers], ends[numbers], n.astype(np.int32),
            ))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], names=names)

    return batches(run)


@dataclass
class Model:
    """start (states), move (states, states) and emit (states, CLASSES) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def initial(share: np.ndarray, s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    emit = (share[None, :] + 1e-6) * np.exp(rng.normal(size=(s.states, len(share))))
    move = np.full((s.states, s.states), 0.2 / max(1, s.states - 1))
    np.fill_diagonal(move, 0.8)
    return Model(np.full(s.states, 1 / s.states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def stationary(move: np.ndarray) -> np.ndarray:
    """The distribution of states that a chain with these moves goes towards."""
    return np.linalg.matrix_power(move, 1 << 12).mean(0)


def blocks_of(sequence: np.ndarray, block: int = BLOCK, lead: int = LEAD) -> list[tuple[np.ndarray, int]]:
    """(tokens, how many of them come before the block) of a sequence's blocks: 0 for the first only."""
    return [(sequence[max(0, k - lead) : k + block], min(k, lead)) for k in range(0, len(sequence), block)]


def expected(sequences: list[np.ndarray], m: Model, leads: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions, by the scaled forward-backward recursion over non-empty sequences.

    A sequence's lead is its tokens that are not counted, nor the moves between them; with a lead it starts from the stationary
    distribution. LANES sequences of like length step together, with arrays small enough for the processor's caches.
    """
    start, move, emit = np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)
    first, later, a, e = (x.astype(np.float32) for x in (m.start, stationary(m.move), m.move, m.emit))
    leads = leads or [0] * len(sequences)
    back, k = np.ascontiguousarray(a.T), len(m.start)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for at in range(0, len(order), LANES):
        part = [sequences[i] for i in order[at : at + LANES]]
        lead = np.array([leads[i] for i in order[at : at + LANES]])
        sizes = np.array([len(x) for x in part])
        steps, lanes, longest = int(sizes[0]), len(part), int(lead.max())
        padded = np.zeros((lanes, steps), np.uint16)
        for row, seq in zip(padded, part):
            row[: len(seq)] = seq
        grid = np.ascontiguousarray(padded.T).astype(np.int64)
        live = np.searchsorted(-sizes, -np.arange(steps), side="left")
        alpha, scale = np.zeros((steps, k, lanes), np.float32), np.empty((steps, lanes), np.float32)
        x = np.where(lead > 0, later[:, None], first[:, None])
        for t in range(steps):
            n = live[t]
            x = (back @ x[:, :n] if t else x) * e.take(grid[t, :n], axis=1)
            z = x.sum(0)
            x /= z
            alpha[t, :, :n], scale[t, :n] = x, z
        beta = np.ones((k, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            if t:
                w = e.take(grid[t, :n], axis=1)
                w *= beta[:, :n]
                w /= scale[t, :n]
                before = alpha[t - 1, :, :n]
                move += m.move * ((before if t >= longest else before * (lead[:n] <= t)) @ w.T)
            alpha[t, :, :n] *= beta[:, :n]
            if t < longest:
                alpha[t, :, :n] *= lead[:n] <= t
            if t:
                beta[:, :n] = a @ w
        start += alpha[0].sum(1)
        flat = grid.ravel()
        for i in range(k):
            emit[i] += np.bincount(flat, alpha[:, i].ravel(), m.emit.shape[1])
    return start, move, emit


def forward(sequences: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 of each whole sequence's probability, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    if not sequences:
        return out
    sizes = np.array([len(x) for x in sequences])
    order = np.argsort(-sizes, kind="stable")
    first, sizes = np.r_[0, np.cumsum(sizes)[:-1]][order], sizes[order]
    flat, back = np.concatenate(sequences), np.ascontiguousarray(m.move.T)
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    total = np.zeros(len(sequences))
    x = np.repeat(m.start[:, None], len(sequences), axis=1)
    for t in range(sizes[0]):
        n = live[t]
        x = (back @ x[:, :n] if t else x) * m.emit.take(flat[first[:n] + t], axis=1)
        z = x.sum(0)
        x /= z
        total[:n] += np.log10(z)
    out[order] = total
    return out


def _expected(shared):
    def run(it):
        m: Model = shared.value
        sums, pending, held = None, [], 0

        def add() -> None:
            nonlocal sums, pending, held
            got = expected([x for x, _ in pending], m, [n for _, n in pending])
            sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
            pending, held = [], 0

        for batch in it:
            for raw in batch.column(0):
                seq = np.frombuffer(raw.as_py(), np.uint16)
                pending += blocks_of(seq)
                held += len(seq)
                if held >= GATHERED:
                    add()
        if pending:
            add()
        if sums is not None:
            flat = np.concatenate([x.ravel() for x in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    return run


def train(classes: DataFrame, share: np.ndarray, s: Settings) -> Model:
    """Baum-Welch over a column of class sequences: each pass sums the expected counts of all partitions."""
    m, k = initial(share, s), s.states
    for _ in range(s.passes):
        shared = classes.sparkSession.sparkContext.broadcast(m)
        got = classes.mapInArrow(_expected(shared), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not got:
            break
        flat = np.zeros(k + k * k + m.emit.size)
        for r in got:
            flat[r.i] = r.x
        start, move, emit = flat[:k] + s.smoothing, flat[k : k + k * k].reshape(k, k) + s.smoothing, flat[k + k * k :].reshape(k, -1) + s.smoothing
        m = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        shared.destroy()
    return m


def _most_frequent(counts: DataFrame, top: int):
    """At most `top` of the words as a pandas table, most frequent first: those above a count, found from a histogram of counts.

    A sort with a limit would send `top` rows of each partition to the driver.
    """
    grade = F.floor(F.log2("n") * 16).cast("int")
    sizes, cut, held = sorted(((r.grade, r["count"]) for r in counts.groupBy(grade.alias("grade")).count().collect()), reverse=True), None, 0
    for g, n in sizes:
        held += n
        if held > top:
            break
        cut = g
    listed = counts.where(grade >= cut if cut is not None else F.lit(False)).toPandas()
    return listed.sort_values(["n", "h"], ascending=[False, True], ignore_index=True)


def language_model_scores(docs: DataFrame, held_out: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score.

    held_out is a column over docs; all rows for which it is not true are learned from (a null is false). Tokens
    are the words with A-Z lower-cased and one end. base_score is the sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))); score is log10 of the text's probability under the HMM. A null text
    is empty and has the end token only; rows repeated in the table count each time. Without training rows
    all counts are 0. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    learned = rows.where("not held_out").select("text")
    counts = saved(learned.mapInArrow(_counted, "h long, ending int, n long").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")), "words")
    n_end = learned.count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = _most_frequent(counts, top)
    classes = np.where(np.arange(len(listed)) < OWN, np.arange(len(listed)) + 1, 0)
    own = listed[:OWN]
    per_class = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
    n_class, kinds = np.zeros(SHARED), np.zeros(SHARED)
    n_class[per_class["ending"]], kinds[per_class["ending"]] = per_class["n"], per_class["kinds"]
    np.subtract.at(n_class, own["ending"].to_numpy(np.int64), own["n"].to_numpy())
    np.subtract.at(kinds, own["ending"].to_numpy(np.int64), 1)
    order = np.argsort(listed["h"].to_numpy(np.int64))
    words = _Words(listed["h"].to_numpy(np.int64)[order], listed["n"].to_numpy(np.int64)[order], classes[order], np.log10(n_class + 0.5 * (kinds + 1)), n_words + n_end, n_kinds + (n_end > 0), n_end)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    facts = saved(
        rows.mapInArrow(
            _described(shared),
            "rid long, " + f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, inner double, classes binary, rare array<long>, rare_class array<int>, rare_n array<int>",
        ),
        "hmm-facts",
    )
    share = np.r_[n_end, own["n"].to_numpy(), np.zeros(OWN - len(own)), n_class].astype(float)
    model = train(facts.where("not held_out").select("classes"), share / max(1.0, share.sum()), s)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = forward([np.frombuffer(x.as_py(), np.uint16) for x in batch.column("classes")], told.value)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*batch.schema.names[:-1], "hmm"])

    slim = facts.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "classes")
    hmm = slim.mapInArrow(batches(scored), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", hmm double")
    # Words beyond the list meet their counts: class_log is a table of SHARED numbers.
    rare = facts.select("rid", F.explode(F.arrays_zip("rare", "rare_class", "rare_n")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.rare_class").alias("ending"), F.col("x.rare_n").alias("m"))
    per = docs.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(words.class_log)], "ending int, class_log double")
    met = rare.join(counts.select("h", "n"), "h", "left").join(F.broadcast(per), "ending")
    c = F.coalesce(F.col("n"), F.lit(0)) + 0.5
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known"), F.sum(F.col("m") * F.log10(c / (words.total + 0.5 * (words.kinds + 1)))).alias("more_base"), F.sum(F.col("m") * (F.log10(c) - F.col("class_log"))).alias("more_inner")
    )
    return hmm.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("hmm") + F.col("inner") + F.coalesce("more_inner", F.lit(0.0))).alias("score"),
    )
