"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Text is taken as words of letters and digits in lower case. Item lengths fall into size classes; a class's
size is STRIDE - 1 words less than its shortest item. Windows of that many words of every document, at every
STRIDE-th word, get a 64-bit SimHash of their word pairs, and so do the first STRIDE parts of each item
of that many words: one of them is where such a window is, wherever the item stands. The 64 bits are cut into three
blocks: fingerprints within RADIUS agree within RADIUS // 3 bits in some block, so an index for each block, which lists under
each value the items' prints whose block is within that many bits of it, finds all of them. A window is
compared with the prints listed under its three values, and with no others. An edited passage can be further off than that and still be alike, so prints of single shingles at several
places of each item stand beside them: a window that is at least `similarity` like an item lacks at most
m - ceil(similarity * m) of the item's m shingles, so it has one of any set of one more, and those are looked up
at every word. Both give places only. They are verified by the exact weighted Jaccard similarity of word shingles,
weighted by how often they occur, between the item and every window of the item's own length over the place;
at a document's ends windows are cut off.

The benchmark is a stated query set: it goes to the workers in blocks of bounded size, one pass over the rows
each, of which a task has one at a time.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from fathomline.llm._common import batches, mapped, mix64, saved, unused, utf8

RADIUS = 11
#: Bit ranges of the three blocks.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Ratio from one size class to the next.
STEP = 1.3
STRIDE = 4
#: Bounds of one block of the benchmark.
ITEMS, ITEM_CHARS = 1000, 4_000_000
#: Words that are fingerprinted at a time.
PIECE = 1 << 15
#: Rows whose words are held at a time.
ROWS = 512
SHIFT = 4
#: First bits of hashes of shingles that a table tells.
TABLE_BITS = 22
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


#: Of ASCII: letters and digits as they are, all else a space.
_ASCII = {c: c if chr(c).isalnum() else 32 for c in range(128)}
_ASCII_BYTES = bytes(_ASCII.get(c, c) for c in range(256))


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_ASCII_BYTES).decode().split()
    return _WORD.findall(text)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _pairs(h: np.ndarray) -> np.ndarray:
    """(words, 64) of 0 and 1: the hashed pair of each word and the next; the last word's pair is with nothing."""
    x = h * _FACTOR
    x[:-1] += h[1:]
    return np.unpackbits(mix64(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class _Sums:
    """Running sums of the pairs' signs, so that a window's sums are a difference of two of them, modulo 2 ** 16.

    Sums are kept by place in blocks of STRIDE words: at[r][:, k] is that of the first STRIDE * k + r words. One
    cumulative sum over blocks is enough, and windows at every STRIDE-th word are slices.
    """

    def __init__(self, h: np.ndarray) -> None:
        self.h, self.words = h, len(h)
        blocks = len(h) // STRIDE + 1
        signs = np.zeros((64, blocks * STRIDE), np.int8)
        signs[:, : len(h)] = np.ascontiguousarray(_pairs(h).T).view(np.int8) * np.int8(2) - np.int8(1)
        inside = np.zeros((64, blocks), np.int16)
        self.at = [np.zeros((64, blocks), np.int16)]
        for r in range(STRIDE):
            inside = inside + signs[:, r::STRIDE]
            self.at.append(inside)
        whole = self.at.pop()
        np.cumsum(whole[:, :-1], axis=1, dtype=np.int16, out=self.at[0][:, 1:])
        for r in range(1, STRIDE):
            self.at[r] = self.at[r] + self.at[0]

    def before(self, words: np.ndarray) -> np.ndarray:
        """(64, places) sums of all words before each place."""
        out = np.empty((64, len(words)), np.int16)
        for r in range(STRIDE):
            mine = words % STRIDE == r
            out[:, mine] = self.at[r][:, words[mine] // STRIDE]
        return out


def _packed(difference: np.ndarray) -> np.ndarray:
    """The signs of 64 rows as bits of one number a column; row by row, which is several times faster than packing along the columns."""
    positive = (difference > 0).view(np.uint8)
    out = positive[::8].copy()
    for bit in range(1, 8):
        out |= positive[bit::8] << np.uint8(bit)
    return np.ascontiguousarray(out.T).view(np.uint64)[:, 0]


def fingerprints(sums: _Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the pairs inside each window of words [start, end); a one-word window's is the word's own hash."""
    out = _packed(sums.before(np.maximum(ends - 1, starts)) - sums.before(starts))
    one = ends - starts == 1
    out[one] = mix64(sums.h[starts[one]] * _FACTOR)
    return out


def even_fingerprints(sums: _Sums, size: int, count: int) -> np.ndarray:
    """The same for `count` windows of `size` words, more than one, at words 0, STRIDE, 2 * STRIDE and so on, by slices."""
    block, place = divmod(size - 1, STRIDE)
    return _packed(sums.at[place][:, block : block + count] - sums.at[0][:, :count])


@dataclass
class _Class:
    """Items of one window size: fingerprints of their parts with the item's number and the part's first word, and an index for each block."""

    size: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    first: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each block (screen, bits, before, starts, prints): whether a value is listed, the same as 64 bits a number, how many values are listed before these 64, where the n-th listed value's prints start, and the numbers of the prints."""
        out = []
        for lo, hi in BLOCKS:
            masks = np.array([sum(1 << b for b in c) for errors in range(RADIUS // len(BLOCKS) + 1) for c in itertools.combinations(range(hi - lo), errors)], np.uint32)
            values = ((self.prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.uint32)
            every = (values[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(every, kind="stable")
            screen = np.zeros(1 << (hi - lo), bool)
            screen[every] = True
            listed = screen.reshape(-1, 64).sum(axis=1)
            starts = np.r_[0, np.cumsum(np.unique(every, return_counts=True)[1])].astype(np.uint32)
            out.append((screen, np.packbits(screen, bitorder="little").view(np.uint64), (np.cumsum(listed) - listed).astype(np.uint32), starts, (order // len(masks)).astype(np.uint32)))
        return out


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` words from each word on that has so many from it on."""
    n = max(0, len(h) - width + 1)
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = x * _FACTOR + h[k : k + n]
    return mix64(x)


@dataclass
class _Anchors:
    """Hashes of shingles of one width, ascending, with the number of the item that each stands for, and a table of their first bits."""

    codes: np.ndarray
    item: np.ndarray
    table: np.ndarray


@dataclass
class Items:
    """A block of the benchmark: ids, words and weighted shingles of each item, these by hash too, the size classes, and anchors by shingle width."""

    ids: list
    sizes: list[int]
    shingles: list[Counter]
    codes: list[dict[int, int]]
    classes: list[_Class]
    anchors: dict[int, _Anchors]
    width: int
    least: float


def shingles(words: list, width: int) -> Counter:
    n = len(words) - min(width, len(words)) + 1
    return Counter(tuple(words[i : i + width]) for i in range(n)) if words else Counter()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def _least_common(total: int, least: float) -> int:
    """How many of its `total` shingles an item has in common with any window that is at least `least` like it."""
    return max(1, math.ceil(least * total - 1e-9))


def _anchored(codes: list[dict[int, int]], widths: list[int], least: float) -> dict[int, _Anchors]:
    """For each item its shingles that the fewest items have, as many as no window that is alike can lack."""
    held = Counter(c for mine in codes for c in mine)
    chosen: dict[int, list[tuple[int, int]]] = {}
    for number, (mine, width) in enumerate(zip(codes, widths)):
        total = sum(mine.values())
        spare = total - _least_common(total, least)
        for c in sorted(mine, key=lambda c: (held[c], c)):
            chosen.setdefault(width, []).append((c, number))
            spare -= mine[c]
            if spare < 0:
                break
    out = {}
    for width, pairs in chosen.items():
        pairs.sort()
        found = np.array([c for c, _ in pairs], np.uint64)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[found >> np.uint64(64 - TABLE_BITS)] = True
        out[width] = _Anchors(found, np.array([i for _, i in pairs]), table)
    return out


def prepared(rows: list[tuple], width: int, least: float) -> Items:
    """Items of (id, text) rows; those without words are left out."""
    told = [(k, w) for k, t in rows if (w := words_of(t or ""))]
    lengths = sorted({len(w) for _, w in told})
    sizes: list[int] = []
    shortest: dict[int, int] = {}
    for n in lengths:
        if not sizes or n > shortest[sizes[-1]] * STEP and max(min(n, 2), n - STRIDE + 1) > sizes[-1]:
            sizes.append(max(min(n, 2), n - STRIDE + 1))
            shortest[sizes[-1]] = n
    members: dict[int, list[tuple[int, int, np.uint64]]] = {s: [] for s in sizes}
    for number, (_, w) in enumerate(told):
        size = max(s for s in sizes if shortest[s] <= len(w))
        starts = np.arange(shortest[size] - size + 1)
        h = _hashes(w)
        for s, p in zip(starts, fingerprints(_Sums(h), starts, starts + size)):
            members[size].append((number, int(s), p))
    classes = [_Class(s, shortest[s] - s + 1, np.array([p for _, _, p in m], np.uint64), np.array([i for i, _, _ in m]), np.array([f for _, f, _ in m])) for s, m in members.items()]
    widths = [min(width, len(w)) for _, w in told]
    codes = [dict(Counter(grams(_hashes(w), n).tolist())) for (_, w), n in zip(told, widths)]
    anchors = _anchored(codes, widths, least)
    return Items([k for k, _ in told], [len(w) for _, w in told], [shingles(w, width) for _, w in told], codes, classes, anchors, width, least)


def candidates(prints: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(place among prints, number of an item's print) of all pairs that share a block's value but for RADIUS // 3 bits; a pair may come several times."""
    where, which = [], []
    for (screen, bits, before, starts, listed), (lo, hi) in zip(tables, BLOCKS):
        value = ((prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.uint32)
        hit = np.flatnonzero(screen[value])
        value = value[hit]
        lower = (np.uint64(1) << (value & np.uint32(63)).astype(np.uint64)) - np.uint64(1)
        rank = before[value >> np.uint32(6)] + np.bitwise_count(bits[value >> np.uint32(6)] & lower)
        begin = starts[rank].astype(np.int64)
        n = starts[rank + np.uint32(1)] - begin
        where.append(np.repeat(hit, n))
        which.append(listed[np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
    return np.concatenate(where), np.concatenate(which)


def _found(h: np.ndarray, ends: np.ndarray, classes: list[tuple[_Class, list[tuple[np.ndarray, ...]]]]) -> set[tuple[int, int, int]]:
    """(item's number, where it would begin, where the window begins) of windows within RADIUS of an item's part; ends: where each word's document ends."""
    found: set[tuple[int, int, int]] = set()
    for at in range(0, len(h), PIECE):
        longest = max(c.size for c, _ in classes)
        piece = min(PIECE, len(h) - at)
        sums = _Sums(h[at : at + PIECE + longest])
        for c, tables in classes:
            here = np.arange(at, at + piece, c.stride)
            stops = np.minimum(here + c.size, ends[here])
            # A document's last windows, and documents somewhat shorter than the size, have shorter ones.
            short = stops - here < c.size
            full = min(len(here), (sums.words - c.size) // STRIDE + 1) if c.stride == STRIDE and c.size > 1 and sums.words >= c.size else 0
            starts, p = here[:full][~short[:full]], even_fingerprints(sums, c.size, full)[~short[:full]] if full else np.empty(0, np.uint64)
            rest = short | (np.arange(len(here)) >= full)
            rest &= 5 * (stops - here) >= 4 * c.size
            starts = np.r_[starts, here[rest]]
            p = np.r_[p, fingerprints(sums, here[rest] - at, stops[rest] - at)]
            x, y = candidates(p, tables)
            near = np.bitwise_count(p[x] ^ c.prints[y]) <= RADIUS
            x, y = starts[x[near]], y[near]
            found.update(zip(c.item[y].tolist(), (x - c.first[y]).tolist(), x.tolist()))
    return found


def _anchors_at(h: np.ndarray, ends: np.ndarray, anchors: dict[int, _Anchors]) -> tuple[dict[int, np.ndarray], list[tuple[int, int]]]:
    """Hashes of the shingles from each word on by width, and (item's number, word) of each anchor inside a document."""
    codes, found = {}, []
    for width, a in anchors.items():
        codes[width] = mine = grams(h, width)
        at = np.flatnonzero(a.table[mine >> np.uint64(64 - TABLE_BITS)])
        at = at[at + width <= ends[at]]
        lo, hi = np.searchsorted(a.codes, mine[at], "left"), np.searchsorted(a.codes, mine[at], "right")
        for p, x, y in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
            found += [(i, p) for i in a.item[x:y].tolist()]
    return codes, found


def _most_alike(codes: np.ndarray, want: dict[int, int], total: int, starts: list[tuple[int, int]], least: float) -> tuple[float, int]:
    """(similarity, start) of the first most similar window of `total` shingles of a document's `codes` that starts in one of the ranges [lo, hi], cut off at the document's ends."""
    best, need, done = (0.0, 0), _least_common(total, least), -(1 << 62)
    for lo, hi in sorted(starts):
        lo, hi = max(lo, done, 1 - total), min(hi, len(codes) - 1)
        if lo > hi:
            continue
        done = hi + 1
        x = y = base = max(lo, 0)
        here = codes[base : hi + total].tolist()
        if sum(map(want.__contains__, here)) < need:
            continue
        inside, both = dict.fromkeys(want, 0), 0
        for start in range(lo, hi + 1):
            first, stop = max(start, 0), min(start + total, len(codes))
            while y < stop:
                c = here[y - base]
                if c in want:
                    inside[c] += 1
                    both += inside[c] <= want[c]
                y += 1
            while x < first:
                c = here[x - base]
                if c in want:
                    both -= inside[c] <= want[c]
                    inside[c] -= 1
                x += 1
            if both >= need and (s := both / (total + stop - first - both)) > best[0]:
                best = s, start
    return best


_FOUND = ArrayType(StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("start", LongType()), StructField("stop", LongType())]))
_HIT = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())])


def _searched(shared, least: float, name: str | None = None):
    """Appends to a batch the hits with the items of one block of the benchmark."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items: Items = shared.value
        classes = [(c, t) for c, t in zip(items.classes, _tables(items))]
        ids, known = _Ids(), np.empty(0, np.uint64)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for top in range(0, batch.num_rows, ROWS):
            # Few rows at a time: lists of words take many times the memory of their text.
            texts = [words_of(t.decode("utf-8", "replace")) for t in utf8(batch.column("text").slice(top, ROWS))]
            sizes = np.array([len(w) for w in texts])
            if not sizes.sum():
                continue
            numbers = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(texts)), np.int64, sizes.sum())
            known = np.concatenate([known, _hashes(list(itertools.islice(ids, len(known), None)))])
            stops, h = np.cumsum(sizes), known[numbers]
            ends = np.repeat(stops, sizes)
            starts: dict[tuple[int, int], list[tuple[int, int]]] = {}
            codes, anchors = _anchors_at(h, ends, items.anchors)
            for at, item, lo, hi in [
                *((p, i, p - items.sizes[i] + min(items.width, items.sizes[i]), p) for i, p in anchors),
                *((at, i, begin - SHIFT, begin + SHIFT) for i, begin, at in _found(h, ends, classes)),
            ]:
                doc = int(np.searchsorted(stops, at, side="right"))
                first = int(stops[doc] - sizes[doc])
                starts.setdefault((doc, item), []).append((lo - first, hi - first))
            for (doc, item), ranges in starts.items():
                size, width, words = items.sizes[item], min(items.width, items.sizes[item]), texts[doc]
                first, last = int(stops[doc] - sizes[doc]), int(stops[doc]) - width + 1
                s, start = _most_alike(codes[width][first : max(first, last)], items.codes[item], size - width + 1, ranges, least)
                if s >= least:
                    lo, hi = max(0, start), min(len(words), start + size)
                    s = weighted_jaccard(items.shingles[item], shingles(words[lo:hi], items.width))
                    if s >= least:
                        best[top + doc, item] = (s, lo, hi)
        hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for (doc, item), (s, lo, hi) in sorted(best.items()):
            hits[doc].append({"item_id": items.ids[item], "similarity": s, "start": lo, "stop": hi})
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(_HIT))], names=[*batch.schema.names, "hits" if name is None else name])

    return batches(run)


_cached: dict[int, list] = {}


def _tables(items: Items) -> list[list[tuple[np.ndarray, ...]]]:
    """The classes' tables, made once in a worker for the block of the benchmark that it is at."""
    if id(items) not in _cached:
        _cached.clear()
        _cached[id(items)] = [items, [c.tables() for c in items.classes]]
    return _cached[id(items)][1]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8, hits_col: str = "hits") -> DataFrame:
    """docs (any columns with text) with hits_col appended: for each item that a window of its length is at least `similarity` like, (item_id, similarity, start, stop) with the words [start, stop) that are most like it.

    Items without words and null texts match nothing; items of one text are found each. An own column of that name is
    replaced. There is no shuffle: each block of the benchmark is one pass over the rows. Passes before the last
    write the rows to the shared folder, so that a task never has the indexes of two blocks.
    """
    out = docs.drop(hits_col)
    names = out.columns
    block: list[tuple] = []
    chars, passes = 0, 0

    def searched(rows: DataFrame) -> DataFrame:
        nonlocal passes
        items = prepared(block, shingle_words, similarity)
        if not items.classes:
            return rows
        passes += 1
        rows = saved(rows, "decontamination-pass") if passes > 1 else rows
        shared = docs.sparkSession.sparkContext.broadcast(items)
        # The hits so far are the last column; each pass appends its own to them.
        before, found = unused([*names, hits_col], "before", "found")
        rows = rows.withColumnRenamed(hits_col, before) if passes > 1 else rows
        rows = mapped(rows, _searched(shared, similarity, found), StructField(found, _FOUND))
        if passes > 1:
            rows = rows.withColumn(hits_col, F.concat(before, found)).drop(before, found)
        return rows.withColumnRenamed(found, hits_col)

    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((r.item_id, r.text))
        chars += len(r.text or "")
        if len(block) >= ITEMS or chars >= ITEM_CHARS:
            out, block, chars = searched(out), [], 0
    out = searched(out) if block else out
    return out if passes else out.withColumn(hits_col, F.array().cast(_FOUND))


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (any columns with text) with contaminated, kept (boolean), n_items (long), item_ids (ascending) and best_similarity (0 if none) appended; own columns of these names, and hits, are replaced.

    A row is contaminated if a window of an item's length is at least `similarity` like it. Null and empty texts
    and a document without words are clean; an empty benchmark leaves all clean; repeated rows and null ids
    are judged each by their own text. An item whose id is null counts and has no entry in item_ids.
    """
    docs = docs.drop("contaminated", "kept", "n_items", "item_ids", "best_similarity", "hits")
    out = benchmark_hits(docs, benchmark, shingle_words, similarity)
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        (F.size("hits") > 0).alias("contaminated"), (F.size("hits") == 0).alias("kept"), F.size("hits").cast("long").alias("n_items"),
        F.sort_array(F.array_distinct(F.filter(F.col("hits.item_id"), lambda x: x.isNotNull()))).alias("item_ids"), F.coalesce(F.array_max("hits.similarity"), F.lit(0.0)).alias("best_similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, columns as they are, that decontaminate() keeps."""
    (hits,) = unused(docs.columns, "hits")
    return benchmark_hits(docs, benchmark, shingle_words, similarity, hits).where(F.size(hits) == 0).drop(hits)
