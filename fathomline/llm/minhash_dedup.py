"""MinHash near-duplicate detection with a multi-index Hamming join.

A document's set of word shingles gets a signature of CHUNKS x WIDTH minima, each cut to 16 bits. The
distance of two signatures is the number of unlike minima. Chunks of WIDTH minima are the pigeonholes:
if at most 2 * CHUNKS - 1 minima differ, some chunk has at most one error. Each chunk is therefore
indexed once for each minimum that may be in error, with that minimum left out, and all pairs within
that distance share a key. At a Jaccard similarity of 0.8 a chunk has at most one error with probability
0.82, so a pair shares no key with probability 0.18 ** 10, below 4e-8. Pairs that share one and are not compared
with their bucket's smallest member are dropped beyond RADIUS, without the exact check; at 0.8 that has probability
P(Bin(40, 0.2) >= 20) = 2.2e-5, and this is the bound on what is missed.

Candidates are confirmed on the full sets. Equal sets are one class from the start, and within a
bucket each class is first compared with the bucket's smallest member only; what stays unlinked is then
compared exactly, pair by pair, but in blocks: neither copies nor groups are expanded into rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm._common import batches, dropped, mix64, saved, unused, utf8
from fathomline.llm.components import components

CHUNKS, WIDTH = 10, 4
#: Largest distance at which the multi-index finds every pair.
RADIUS = 2 * CHUNKS - 1
#: Expected members, and at most so many shingles on average, of a block in the exact pass.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: A worker's cache of word hashes is emptied at this size.
CACHE = 150_000
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 2**63, CHUNKS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, CHUNKS * WIDTH, dtype=np.uint64)
_words: dict[bytes, int] = {}


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z lower-cased; one of all words if there are fewer than size."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    hashes = np.empty(len(words), np.uint64)
    get, digest = _words.get, xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _words[w] = digest(w)
        hashes[i] = h
    n = len(words) - min(size, len(words)) + 1
    out = np.zeros(n, np.uint64)
    for k in range(len(words) - n + 1):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return np.unique(mix64(out + np.uint64(len(words) - n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS * WIDTH minima of a non-empty set, 16 bits of each."""
    least = np.full(len(_XOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] ^ _XOR[:, None]
        part *= _MULTIPLY[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (mix64(least) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) 64-bit keys of signatures: chunk by chunk, each with one minimum left out."""
    parts = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64) + np.uint64(1)
    keys = np.empty((len(signatures), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        key = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(WIDTH) + np.uint64(out) + np.zeros((len(signatures), 1), np.uint64)
        for k in range(WIDTH):
            if k != out:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
        keys[:, :, out] = key
    return keys.reshape(len(signatures), -1).view(np.int64)


def _described(size: int):
    names, kinds = ["rid", "doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in utf8(batch.column(2)):
            s = shingle_set(text, size)
            d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
            rows.append((len(s), int(d[0]), int(d[1]), signature(s).tobytes() if len(s) else None))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    return batches(run)


@batches
def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
    keys = chunk_keys(signatures)
    uid = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(uid)], names=["key", "uid"])


def _sets(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        uid, d1, d2, kept, sets = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], []
        for i, text in enumerate(utf8(batch.column(1))):
            s = shingle_set(text, size)
            d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
            if int(d[0]) == d1[i] and int(d[1]) == d2[i]:  # an id that several texts carry meets only its own text
                kept.append(uid[i])
                sets.append(s.view(np.int64))
        sizes = np.array([len(s) for s in sets], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sizes), lists], names=["uid", "n", "shingles"])

    return batches(run)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, of arrays without repeats."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_COLUMNS = ("uid", "label", "n", "home", "sub", "sig")


def _screened(percent: int):
    """Of two blocks of a bucket, the pairs of unlike labels within RADIUS whose first shared key this bucket is, dealt by the members' homes."""
    out = pa.schema([("ha", pa.int64()), ("sa", pa.int64()), ("hb", pa.int64()), ("sb", pa.int64()), ("xs", pa.list_(pa.int64())), ("ys", pa.list_(pa.int64()))])

    def block(rows: list[dict]) -> dict[str, np.ndarray]:
        cols = {c: np.array([r[c] for r in rows], np.int64) for c in _COLUMNS[:-1]}
        return cols | {"sig": np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(len(rows), CHUNKS, WIDTH)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple] = []
        for row in batch.to_pylist():
            x, y = block(row["xs"]), block(row["ys"])
            key = np.int64(row["key"])
            keys = chunk_keys(x["sig"][:1].reshape(1, -1))[0]
            at = int(np.flatnonzero(keys == key)[0])
            chunk, out_at = divmod(at, WIDTH)
            ok = x["label"][:, None] != y["label"][None, :]
            ok &= 100 * np.minimum(x["n"][:, None], y["n"][None, :]) >= percent * np.maximum(x["n"][:, None], y["n"][None, :])
            if row["i"] == row["j"]:
                ok &= x["uid"][:, None] < y["uid"][None, :]
            px, py = np.nonzero(ok)
            for lo in range(0, len(px), 1 << 18):
                qx, qy = px[lo : lo + (1 << 18)], py[lo : lo + (1 << 18)]
                same = x["sig"][qx] == y["sig"][qy]
                count = same.sum(axis=2)
                first = (count >= WIDTH - 1).argmax(axis=1)
                mine = same[np.arange(len(qx)), first]
                left_out = np.where(mine.all(axis=1), 0, (~mine).argmax(axis=1))
                keep = (first == chunk) & (left_out == out_at) & (count.sum(axis=1) >= CHUNKS * WIDTH - RADIUS)
                if not keep.any():
                    continue
                qx, qy = qx[keep], qy[keep]
                groups = np.stack([x["home"][qx], x["sub"][qx], y["home"][qy], y["sub"][qy]], axis=1)
                swap = (groups[:, 0] > groups[:, 2]) | ((groups[:, 0] == groups[:, 2]) & (groups[:, 1] > groups[:, 3]))
                groups[swap] = groups[swap][:, [2, 3, 0, 1]]
                u, v = np.where(swap, y["uid"][qy], x["uid"][qx]), np.where(swap, x["uid"][qx], y["uid"][qy])
                kinds, inverse = np.unique(groups, axis=0, return_inverse=True)
                order = np.argsort(inverse.ravel(), kind="stable")
                for g, part in zip(kinds, np.split(order, np.cumsum(np.bincount(inverse.ravel()))[:-1])):
                    found.append((*map(int, g), u[part].tolist(), v[part].tolist()))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(out.types)], schema=out)

    return batches(run)


def _cross_checked(percent: int):
    """Pairs of two home blocks and their members' sets -> links; pairs that are already connected are passed over."""

    def run(pairs, sets):
        import pandas as pd  # here, as no other function of this module's workers needs its memory

        of = {u: np.asarray(s, np.int64) for u, s in zip(sets["uid"], sets["shingles"])}
        parent = {u: u for u in of}

        def root(u: int) -> int:
            while parent[u] != u:
                parent[u] = u = parent[parent[u]]
            return u

        links = []
        for xs, ys in zip(pairs["xs"], pairs["ys"]):
            for u, v in zip(xs, ys):
                ru, rv = root(u), root(v)
                if ru != rv and _alike(of[u], of[v], percent):
                    parent[ru] = rv
                    links.append((u, v))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _blocks(parts: Column) -> Column:
    """The power of two at or above parts: blocks by the same hash then nest, whatever they are blocks of."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(parts, F.lit(1.0))))).cast("long")


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (any columns with doc_id and text) that near_duplicates keeps: of each component the row with the smallest doc_id.

    Rows that repeat that row's id and text stay with it, as do rows without an id whose component has no id at all.
    """
    kept_id, kept_hash = unused(docs.columns, "kept_id", "kept_hash")
    kept = near_duplicates(docs, shingle_words, percent, hashed=True).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_hash)), "left_semi")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (long), component_id (smallest doc_id reachable by links, itself included), kept.

    Two rows are linked if 100 * |A and B| >= percent * |A or B| for their sets of word shingles. A null,
    empty or blank text has an empty set and no link. Repeated rows with one id form one component if
    their texts are linked; a row whose whole component has null ids has a null component_id. kept is
    doc_id <=> component_id. Ids may have any type that has an order. An empty table gives an empty result; other
    columns are not looked at. hashed appends text_hash, the xxhash64 of the row's text.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    facts = saved(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
            _described(shingle_words), f"rid long, doc_id {id_type}, text_hash long, n_shingles long, d1 long, d2 long, sig binary"
        ),
        "minhash-facts",
    )
    sets = saved(facts.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("rid").alias("uid"), F.min("doc_id").alias("least")), "minhash-sets")
    unique = saved(facts.join(sets.select(F.col("uid").alias("rid")), "rid").select(F.col("rid").alias("uid"), "doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"), "minhash-unique")
    # Buckets of two or more unlike sets.
    rows = unique.select("uid", "sig").mapInArrow(_keyed, "key long, uid long")
    leads = saved(rows.groupBy("key").agg(F.min("uid").alias("lead"), F.count("*").alias("members")).where("members > 1"), "minhash-leads")
    buckets = saved(rows.join(leads, "key"), "minhash-buckets")
    # The full sets of all that share a bucket.
    homes = buckets.groupBy("uid").agg(F.min("lead").alias("home"))
    nearer = buckets.join(homes, "uid").groupBy("key").agg(F.min("home").alias("home"))
    homes = saved(buckets.select("key", "uid").join(nearer, "key").groupBy("uid").agg(F.min("home").alias("home")), "minhash-homes")
    wanted = unique.join(homes, "uid").select("uid", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"), "d1", "d2")
    # By id and text: rows that share an id, or have none, do not all meet.
    meant = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_hash"))
    full = saved(docs.join(wanted, meant).select("uid", "text", "d1", "d2").mapInArrow(_sets(shingle_words), "uid long, n long, shingles array<long>").dropDuplicates(["uid"]), "minhash-full")
    a, b = (full.select(F.col("uid").alias(x), F.col("shingles").alias(f"{x}_set"), F.col("n").alias(f"{x}_n")) for x in "ab")
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    star = buckets.where("uid <> lead").select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct()
    # In the JVM, pair by pair: batches of pairs of long sets would fill the memory outside the heap.
    both = F.size(F.array_intersect("a_set", "b_set"))
    links = saved(star.join(b, "b").join(a, "a").where(sizes).where((100 + percent) * both >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b"), "minhash-star")
    label = components(links, "minhash-star-components")
    # The exact pass over buckets whose members still have unlike labels.
    told = homes.join(label.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "home", F.coalesce("component", "uid").alias("label"))
    told = told.join(unique.select("uid", F.col("n_shingles").alias("n"), "sig"), "uid")
    # Tables of their own, so that AQE may split a home with many members in the joins.
    told = saved(told, "minhash-homed")
    parts = told.groupBy("home").agg(_blocks(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    told = saved(told.join(saved(parts, "minhash-parts"), "home").withColumn("sub", F.pmod(F.xxhash64("uid"), "parts")).drop("parts"), "minhash-told")
    labelled = buckets.select("key", "uid", "members").join(told.select("uid", "label"), "uid")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    blocks = saved(
        buckets.join(mixed, "key").select("key", "uid", F.pmod(F.xxhash64("uid"), _blocks(F.col("members") / BLOCK)).alias("block")).join(told, "uid").groupBy("key", "block").agg(F.collect_list(F.struct(*_COLUMNS)).alias("rows")),
        "minhash-blocks",
    )
    x = blocks.select("key", F.col("block").alias("i"), F.col("rows").alias("xs"))
    y = blocks.select("key", F.col("block").alias("j"), F.col("rows").alias("ys"))
    near = saved(
        x.join(y, "key").where("i <= j").select("key", "i", "j", "xs", "ys").mapInArrow(_screened(percent), "ha long, sa long, hb long, sb long, xs array<long>, ys array<long>"),
        "minhash-near",
    )
    side = ["ha", "sa", "hb", "sb"]
    members = near.select(*(F.col(c).alias(f"{c}_") for c in side), F.explode(F.array_distinct(F.concat("xs", "ys"))).alias("uid")).distinct().join(full.select("uid", "shingles"), "uid")
    more = near.groupBy(*side).cogroup(members.groupBy(*(f"{c}_" for c in side))).applyInPandas(_cross_checked(percent), "a long, b long")
    found = components(saved(links.unionByName(more), "minhash-links"), "minhash-components").withColumnRenamed("node", "uid")
    # The smallest doc_id of each component, back to each row by its set.
    classed = sets.join(found, "uid", "left").select("d1", "d2", "least", F.coalesce("component", "uid").alias("component"))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = saved(classed.join(least, "component").select("d1", "d2", "component_id"), "minhash-answer")
    dropped(sets, unique, leads, buckets, homes, full, told, blocks, near)
    return facts.join(answer, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(["text_hash"] if hashed else [])
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
