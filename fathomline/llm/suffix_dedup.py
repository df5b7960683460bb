"""Removal of repeated byte windows, and search for shared word passages, by a depth-limited radix sort of suffixes.

Suffixes are ordered through the window's length only, most significant digit first, and the groups that are
still equal at that depth are exactly the repeated windows. The first digit of a suffix is the smallest gram
(GRAMS tokens, by hash, then leftmost) inside its window, with its place in it: equal windows have the same one
at the same place, and all suffixes that follow one another and share it travel as one row, so a text of n
tokens gives about 2 n / (length - gram) rows instead of n. This digit is dealt out over the cluster; a row alone
in its bucket ends there, and rows that agree in all the tokens that their windows cover are one kind.
Unlike kinds of one bucket go on to the other digits: passes over DIGIT tokens at a time, many buckets side by side,
each pass refining the groups that the one before it left and retiring suffixes that are alone. Digits are
compared as what they are (their rank among the digits at hand), not as hashes. A bucket of more than IN_MEMORY
unlike kinds is told apart by one distributed group-by of its windows instead, by 128-bit digests.

Tokens are bytes, for what is removed, and words, for passages that stand in several documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._common import batches, dropped, mix64, saved, utf8

#: Bytes, and words, of a gram.
GRAMS = (64, 16)
#: Tokens of a text that are hashed at a time; a longer text only costs more rows.
PIECE = 1 << 22
#: Unlike kinds of a bucket that are told apart in one task's memory.
IN_MEMORY = 16384
#: Bytes, and words, of a digit of the later passes.
DIGIT = (16, 4)
#: Windows that are ordered side by side.
SORTED = 1 << 19
#: Bits of a row's place: windows after the first, and the gram's place in the first window.
BITS = 14
_POSITION = np.uint64((1 << 24) - 1)
_FACTOR = 0x9E3779B97F4A7C15


def words_hashed(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _grams(x: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the `gram` tokens from each token on, from those of 1, 2, 4 ... tokens."""
    n, out, done, part, size = len(x) - gram + 1, None, 0, x, 1
    while done < gram:
        if gram & size:
            power = np.uint64(pow(_FACTOR, size, 1 << 64))
            out = part[:n] if out is None else out * power + part[done : done + n]
            done += size
        if done < gram:
            part = part[:-size] * np.uint64(pow(_FACTOR, size, 1 << 64)) + part[size:]
            size *= 2
    return mix64(out)


def anchors(tokens: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each first digit of the windows of a text's tokens."""
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(tokens) - length + 1, PIECE):
        h = _grams(tokens[start : start + PIECE + length - 1].astype(np.uint64) + np.uint64(1), gram)
        key = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        width, done = length - gram + 1, 1
        while 2 * done <= width:
            key = np.minimum(key[:-done], key[done:])
            done *= 2
        if done < width:
            key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
        at = (key & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        found.append((h[at[first]], at[first] + start, first + start, last + start))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*found))


def rows_of(data: bytes, length: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first digit, digest of all covered tokens, place) of a text's rows; the first digit's last bit tells words from bytes."""
    out = []
    for family, (raw, size) in enumerate(((np.frombuffer(data, np.uint8), length), (words_hashed(data) if words else np.empty(0, np.uint64), words + 1))):
        h, a, lo, hi = anchors(raw, size, min(GRAMS[family], size))
        width = raw.itemsize
        view = data if family == 0 else raw.tobytes()
        digest = xxhash.xxh3_64_intdigest
        s = [digest(view[x * width : (y + size) * width], seed=(p - x) * 65536 + y - x) for p, x, y in zip(a.tolist(), lo.tolist(), hi.tolist())]
        out.append(((h & ~np.uint64(1)) | np.uint64(family), np.array(s, np.uint64), lo << 2 * BITS | (hi - lo) << BITS | (a - lo)))
    return tuple(np.concatenate(c) for c in zip(*out))


_FACTS = "rid long, doc_id long, x long, n_bytes long, sha string, h array<long>, s array<long>, at array<long>"


def _faced(length: int, words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, sizes, shas, parts = [0], [], [], []
        for data in utf8(batch.column("text")):
            sizes.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
            parts.append(rows_of(data, length, words))
            offsets.append(offsets[-1] + len(parts[-1][0]))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(c).view(np.int64))) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(shas), *lists], names=["rid", "doc_id", "x", "n_bytes", "sha", "h", "s", "at"])

    return batches(run)


def _texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Drops the rows whose text only has the hash of the one that is meant."""
    keep = [hashlib.sha256(data).hexdigest() == sha.as_py() for data, sha in zip(utf8(batch.column("text")), batch.column("sha"))]
    return batch.filter(pa.array(keep, pa.bool_()))


def _unpacked(at: int) -> tuple[int, int, int]:
    """(first window, last window, gram's position) of a place."""
    lo, mask = at >> 2 * BITS, (1 << BITS) - 1
    return lo, lo + (at >> BITS & mask), lo + (at & mask)


def _contexts(length: int, words: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for uid, data, unlike in zip(batch.column("uid").to_pylist(), utf8(batch.column("text")), batch.column("unlike").to_pylist()):
            split = data.split() if any(v["h"] & 1 for v in unlike) else []
            for v in unlike:
                lo, hi, _ = _unpacked(v["at"])
                rows.append((v["h"], v["s"], uid, v["at"], v["many"], v["large"], b" ".join(split[lo : hi + words + 1]) if v["h"] & 1 else data[lo : hi + length]))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["h", "s", "uid", "at", "many", "large", "piece"])

    return batches(run)


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].ravel().astype(np.int64)


def digits(tokens: np.ndarray, width: int) -> np.ndarray:
    """Rank of the `width` tokens (a power of two) from each token on, among all of them."""
    x, size = tokens.astype(np.uint64), 1
    if tokens.itemsize == 1:
        while size < min(8, width):
            x = x[:-size] << np.uint64(8 * size) | x[size:]
            size *= 2
    x = _dense(x)
    while size < width:
        x = _dense(x[:-size] << 32 | x[size:])
        size *= 2
    return x


def repeated(tokens: np.ndarray, first: np.ndarray, starts: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, their groups) of the windows that equal another one with the same first digit, through `length` tokens from starts on.

    Radix sort from the most significant digit on: each pass orders what is left by group and digit,
    which refines the groups, and retires windows that are alone in theirs.
    """
    while width > length:
        width //= 2
    rank = digits(tokens, width)
    span, alive, group = int(rank.max(initial=0)) + 1, np.arange(len(starts)), _dense(first)
    for at in [None, *range(0, length - width, width), length - width]:
        key = group if at is None else group * span + rank[starts[alive] + at]
        order = np.argsort(key)
        key = key[order]
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        keep = np.bincount(group)[group] > 1
        alive, group = alive[order][keep], group[keep]
        if not len(alive):
            break
    return alive, group


def _ordered(rows: list[tuple], family: int, size: int) -> list[tuple[int, int, list[dict]]]:
    """(h, s, runs of windows, from the row's first on) of rows (h, s, uid, at, many, piece) of whole buckets that share windows.

    A byte window is shared if another row has it, a word window if a row of another text has it.
    """
    parts = [np.frombuffer(r[5], np.uint8) if family == 0 else words_hashed(r[5]) for r in rows]
    begin = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
    places = [_unpacked(r[3]) for r in rows]
    count = np.array([hi - lo + 1 for lo, hi, _ in places])
    row = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    buckets = _dense(np.array([r[0] for r in rows]))
    # Where the gram stands in the window is part of the first digit.
    first = buckets[row] * (1 << BITS + 1) + np.array([a - lo for lo, _, a in places])[row] - inner
    alive, group = repeated(np.concatenate(parts), first, begin[row] + inner, size, DIGIT[family])
    if family == 1 and len(alive):
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        uid, many = np.array([r[2] for r in rows])[row[alive]], np.array([r[4] for r in rows])[row[alive]]
        other = (np.minimum.reduceat(uid, heads) != np.maximum.reduceat(uid, heads)) | np.logical_or.reduceat(many, heads)
        alive = alive[other[np.cumsum(np.r_[False, group[1:] != group[:-1]])]]
    alive.sort()
    cut = np.flatnonzero(np.r_[True, (np.diff(alive) != 1) | (np.diff(row[alive]) != 0)]) if len(alive) else np.empty(0, np.int64)
    runs: dict[int, list[dict]] = {}
    for x, y in zip(cut, np.r_[cut[1:], len(alive)] - 1):
        runs.setdefault(int(row[alive[x]]), []).append({"lo": int(inner[alive[x]]), "hi": int(inner[alive[y]])})
    return [(rows[r][0], rows[r][1], found) for r, found in runs.items()]


_RUNS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _finished(length: int, words: int):
    """Over rows sorted by bucket and kind: the later digits, whole buckets at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        waiting = [0, 0]

        def done(family: int, rows: list) -> pa.RecordBatch:
            found = _ordered(rows, family, words + 1 if family else length)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], _RUNS)], names=["h", "s", "runs"])

        for batch in it:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                family = r[0] & 1
                rows = held[family]
                if rows and rows[-1][0] == r[0] and rows[-1][1] == r[1]:
                    continue  # a repeated row of the table gives its kind's row again
                if waiting[family] >= SORTED and rows[-1][0] != r[0]:
                    yield done(family, rows)
                    rows.clear()
                    waiting[family] = 0
                rows.append(r)
                waiting[family] += (r[3] >> BITS & (1 << BITS) - 1) + 1
        for family in (0, 1):
            if held[family]:
                yield done(family, held[family])

    return run


def _digests(length: int, words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, s, uid, many, at, digest = [], [], [], [], [], []
        for hh, ss, u, place, m, piece in zip(*(c.to_pylist() for c in batch.columns)):
            lo, hi, a = _unpacked(place)
            data, width, size = (words_hashed(piece).tobytes(), 8, words + 1) if hh & 1 else (piece, 1, length)
            n = hi - lo + 1
            h += [hh] * n
            s += [ss] * n
            uid += [u] * n
            many += [m] * n
            at += range(n)
            digest += [xxhash.xxh3_128_digest(data[k * width : (k + size) * width], seed=(a - lo - k) * 2 + (hh & 1)) for k in range(n)]
        d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(uid, pa.int64()), pa.array(many, pa.bool_()), pa.array(at, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["h", "s", "uid", "many", "k", "k1", "k2"]
        )

    return batches(run)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    runs: list[list[int]] = []
    for x, y in sorted(spans):
        if runs and x <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], y)
        else:
            runs.append([x, y])
    return runs


_CUT = "doc_id long, x long, sha string, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, starts array<long>, ends array<long>, kept binary"


def _cut(length: int, words: int):
    kinds = [("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_shared_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, one, two in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), batch.column("more").to_pylist()):
            spans = (one or []) + (two or [])
            runs = _merged([(s["lo"], s["hi"] + length) for s in spans if not s["h"] & 1])
            shared = sum(y - x for x, y in _merged([(s["lo"], s["hi"] + words + 1) for s in spans if s["h"] & 1]))
            cuts = [0, *(z for r in runs for z in r), len(data)]
            kept = b"".join(data[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
            rows.append((len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), shared, [r[0] for r in runs], [r[1] for r in runs], kept))
        own = [batch.column(c) for c in ("doc_id", "x", "sha")]
        return pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds))], names=["doc_id", "x", "sha", *(n for n, _ in kinds)])

    return batches(run)


def remove_repeats(docs: DataFrame, length: int = 400, words: int = 50, id_col: str = "doc_id", text_col: str = "text", in_memory: int = IN_MEMORY, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (long), kept_sha256, n_shared_words (long), shares_passage; with texts also starts, ends and kept (bytes).

    Every byte covered by a window of `length` bytes that also starts at another place, in this row or
    another, is removed; all copies go, the first included. n_shared_words counts the words (parted by ASCII white
    space) inside passages of more than `words` words that also stand in another row, however long in
    bytes; shares_passage is true where there are any. words=0 leaves passages out. A null text is empty.
    Rows repeated in the table repeat each other's windows, whatever their ids; null ids are rows like others.
    starts, ends and kept are null where nothing is removed. An empty table gives an empty result.
    """
    if not 0 < length < 1 << BITS or not 0 <= words < 1 << BITS:
        raise ValueError(f"windows of 1 to {(1 << BITS) - 1} tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("x"), F.col(text_col).alias("text"))
    facts = saved(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "x", "text").mapInArrow(_faced(length, words), _FACTS), "repeats-facts")
    rows = facts.select("rid", F.explode(F.arrays_zip("h", "s", "at")).alias("r")).select("r.h", "r.s", "rid", "r.at")
    # First digit. Counts are added up before they are shuffled; their table is written, so that AQE may split a hot digit in the join.
    shared = saved(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeats-shared")
    alive = saved(rows.join(shared, "h"), "repeats-alive")
    whole_facts, facts = facts, saved(facts.select("rid", "doc_id", "x", "n_bytes", "sha"), "repeats-texts-told")
    dropped(whole_facts, shared)
    kinds = alive.groupBy("h", "s").agg(F.count("*").alias("n"), (F.min("rid") < F.max("rid")).alias("many"), F.min(F.struct("rid", "at")).alias("least"))
    kinds = saved(kinds.select("h", "s", "n", "many", "least.rid", "least.at"), "repeats-kinds")
    unlike = saved(kinds.groupBy("h").agg(F.count("*").alias("unlike")).where("unlike > 1"), "repeats-unlike")
    word = F.col("h").bitwiseAND(F.lit(1)) == 1
    # Kinds all of whose windows are repeated.
    whole = kinds.where(F.when(word, F.col("many")).otherwise(F.col("n") > 1)).select("h", "s")
    lo = F.shiftright("at", 2 * BITS)
    span = F.struct("h", lo.alias("lo"), (lo + F.shiftright("at", BITS).bitwiseAND(F.lit((1 << BITS) - 1))).alias("hi"))
    spans = alive.join(whole, ["h", "s"]).groupBy("rid").agg(F.collect_list(span).alias("spans"))
    context = F.struct("h", "s", "at", "many", (F.col("unlike") > in_memory).alias("large"))
    asked = kinds.join(unlike, "h").groupBy("rid").agg(F.collect_list(context).alias("unlike"))
    # One row for each id and text, however often the table repeats it.
    told = spans.join(asked, "rid", "full").join(facts.select("rid", "doc_id", "x", "sha"), "rid")
    told = told.groupBy("doc_id", "x", "sha").agg(F.min("rid").alias("uid"), F.first("spans", True).alias("spans"), F.flatten(F.collect_list("unlike")).alias("unlike"))
    told = told.withColumnsRenamed({"doc_id": "told_id", "x": "told_x"})
    held = docs.join(told, F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("x") == F.col("told_x"))).drop("told_id", "told_x")
    held = saved(held.mapInArrow(batches(_texts), held.schema), "repeats-texts")
    contexts = saved(
        held.select("uid", "text", "unlike").where("size(unlike) > 0").mapInArrow(_contexts(length, words), "h long, s long, uid long, at long, many boolean, large boolean, piece binary"), "repeats-contexts"
    )
    columns = ["h", "s", "uid", "at", "many", "piece"]
    found = "h long, s long, runs array<struct<lo:bigint,hi:bigint>>"
    small = contexts.where("not large").select(*columns).repartition("h").sortWithinPartitions("h", "s").mapInArrow(_finished(length, words), found)
    large = contexts.where("large").select(*columns).dropDuplicates(["h", "s"]).mapInArrow(_digests(length, words), "h long, s long, uid long, many boolean, k long, k1 long, k2 long")
    several = F.when(word, (F.min("uid") < F.max("uid")) | F.bool_or("many")).otherwise(F.lit(True))
    again = large.groupBy("h", "k1", "k2").agg(F.count("*").alias("n"), several.alias("several")).where("n > 1 and several").select("h", "k1", "k2")
    large = large.join(again, ["h", "k1", "k2"]).select("h", "s", F.array(F.struct(F.col("k").alias("lo"), F.col("k").alias("hi"))).alias("runs"))
    runs = saved(small.unionByName(large), "repeats-runs")
    more = alive.join(runs, ["h", "s"]).select("rid", "h", lo.alias("at"), F.explode("runs").alias("run"))
    more = more.groupBy(F.col("rid").alias("uid")).agg(F.collect_list(F.struct("h", (F.col("at") + F.col("run.lo")).alias("lo"), (F.col("at") + F.col("run.hi")).alias("hi"))).alias("more"))
    cut = held.select("uid", "doc_id", "x", "sha", "text", "spans").join(more, "uid", "left").where("spans is not null or more is not null").mapInArrow(_cut(length, words), _CUT)
    if not texts:
        cut = cut.drop("starts", "ends", "kept")
    cut = saved(cut.dropDuplicates(["doc_id", "x", "sha"]), "repeats-cut")
    dropped(alive, kinds, unlike, held, contexts, runs)
    facts, zero = facts.select("doc_id", "x", "n_bytes", "sha"), F.lit(0).cast("long")
    cut = cut.withColumnsRenamed({"doc_id": "cut_id", "x": "cut_x", "sha": "cut_sha"})
    same = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("x") == F.col("cut_x")) & (F.col("sha") == F.col("cut_sha"))
    return facts.join(cut, same, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("n_shared_words", zero).alias("n_shared_words"), (F.coalesce("n_shared_words", zero) > 0).alias("shares_passage"), *(["starts", "ends", "kept"] if texts else []),
    )
