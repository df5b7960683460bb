"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Words are runs of letters, runs of digits and runs of one other character, lower-cased; features are hashed
n-grams of words and of their shapes (letter case, digits, which mark, same word as before), so that also
unseen words say something. A feature's value is its share of the text's n-grams of its kind. Training is
FTRL-proximal over a bounded sample of labelled rows; a score is a sparse dot product through a sigmoid.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from fathomline.llm._common import batches, mapped, mix64, utf8

#: Bytes: letters are A-Z, a-z and all bytes of characters beyond ASCII.
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|([^\sA-Za-z0-9\x80-\xff])\1*")
#: A worker's cache of word hashes is emptied at this size.
CACHE = 150_000
_seen: dict[bytes, tuple[int, int]] = {}


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the feature space (a model is 4 << bits bytes). max_rows and max_chars bound the labelled sample that is learned from."""

    bits: int = 18
    max_rows: int = 6000
    max_chars: int = 24_000_000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 0.1
    l1: float = 1e-4
    l2: float = 1e-3
    seed: int = 1


def _word(w: bytes) -> tuple[int, int]:
    """Hashes of a word and of its shape."""
    if w[:1].isdigit():
        shape = b"9"
    elif w[0] >= 128 or w[:1].isalpha():
        shape = b"A" if w.isupper() and len(w) > 1 else b"Aa" if w[:1].isupper() else b"a"
    else:
        shape = w[:1] + (b"+" if len(w) > 1 else b"")
    return xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest(shape, seed=1)


def features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text: hashed word and shape unigrams and bigrams, each kind summing to 1. Empty without words."""
    if len(_seen) > CACHE:
        _seen.clear()
    get, pairs = _seen.get, []
    for m in _WORD.finditer(text):
        w = m.group()
        p = get(w)
        if p is None:
            p = _seen[w] = _word(w)
        pairs.append(p)
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    words, shapes = np.array(pairs, np.uint64).T
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    shapes = shapes * np.uint64(2) + same
    kinds = [words, words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:], shapes, shapes[:-1] * np.uint64(0x9E3779B97F4A7C15) + shapes[1:]]
    index = np.concatenate([mix64(k + np.uint64(i + 1)) >> np.uint64(64 - bits) for i, k in enumerate(kinds)]).astype(np.int64)
    value = np.concatenate([np.full(len(k), 1 / max(1, len(k)), np.float32) for k in kinds])
    return index, value


def _merged(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, inverse = np.unique(index, return_inverse=True)
    return kinds, np.bincount(inverse, value, len(kinds)).astype(np.float64)


def train(texts: Iterable[bytes], labels: list[int], s: Settings) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal; order and result depend on the rows and the seed only. The bias is a feature of value 1.

    texts is read once, and a text's label by when the text is read. All rows' features are in two buffers, which the
    driver gives back to the system whole: many small arrays would leave holes that it keeps as long as it runs.
    """
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    places, numbers, stops = array("i"), array("d"), [0]
    for t in texts:
        i, v = _merged(*features(t, s.bits))
        places.frombytes(np.r_[i, size].astype(np.int32).tobytes())
        numbers.frombytes(np.r_[v, 1.0].tobytes())
        stops.append(len(places))
    _seen.clear()  # the driver scores nothing
    index, value = np.frombuffer(places, np.int32), np.frombuffer(numbers, np.float64)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in rng.permutation(len(stops) - 1):
            i, v = index[stops[k] : stops[k + 1]], value[stops[k] : stops[k + 1]]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (p - labels[k]) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(slice(None))
    return w[:size].astype(np.float32), float(w[size])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """A model from labelled rows of docs for which learn, a condition on doc_id, holds: max_rows labelled ids at most, the first by a hash of the id, and max_chars in all.

    docs has doc_id and text, labels doc_id and quality (0 or 1; others and null are no label; of unlike
    labels of one id the larger counts). Labelled ids that docs lacks and null texts are passed over. Without
    labelled rows the model is 0.5 for any text.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(s.seed))
    known = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", "quality", order.alias("o"))
    # A share of the hash's range that holds more than max_rows ids, so that the sort below is of few rows at any size.
    share = min(1.0, 4 * s.max_rows / max(1, labels.count()))
    first = known.where(F.pmod("o", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod("o", F.lit(1 << 30)), "o", "doc_id").limit(s.max_rows)
    # The sample is max_rows ids at most: that bound makes the broadcast safe, and no text is shuffled to find it.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(first), "doc_id").select("text", "quality", "o", F.xxhash64("text").alias("t")).orderBy("o", "t")
    learned: list[int] = []

    def texts() -> Iterator[bytes]:
        used = 0
        for r in rows.toLocalIterator():
            used += len(r.text)
            if used > s.max_chars and learned:
                break
            learned.append(r.quality)
            yield r.text.encode()

    return train(texts(), learned, s)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = Settings.bits, score_col: str = "score") -> DataFrame:
    """docs (any columns; an own one of the name score_col is replaced) with score_col appended: 0 to 1, higher if label 1 is likelier. A null or empty text has the bias's score."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    docs = docs.drop(score_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, out = weights.value, []
        for text in utf8(batch.column("text")):
            i, v = features(text, bits)
            x = float(w[i] @ v) + bias
            out.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, score_col])

    return mapped(docs, batches(run), StructField(score_col, DoubleType()))
