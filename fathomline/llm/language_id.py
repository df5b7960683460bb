"""Language identification by cross-parsing entropy with suffix automata.

A suffix automaton of labelled text is built for each language. A text is parsed greedily into phrases, each
the longest match with the language's text from where the last one ended; the language that needs the
fewest phrases a byte wins. So that array operations can take all texts of a batch side by side, however long they
are, a text is first parsed in blocks of BLOCK bytes as if each began a phrase. A block is then parsed again from the
state in which the one before it ended, up to where both parses are in the same state, and counted from there on
as the first parse has it: the count is that of the whole text, and phrases cross blocks as they will.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from fathomline.llm._common import mapped, saved, utf8

BLOCK = 1024
#: Blocks that step together.
LANES = 8192
_LETTER = re.compile(r"\p{L}")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned from: bytes a language, rows a language that are looked at, and bytes of all languages together.

    All languages are learned. Where there are more than total_bytes / bytes_per_language of them, each has an equal
    share of total_bytes instead, so that the automata's memory does not grow with their number.
    """

    bytes_per_language: int = 40_000
    rows_per_language: int = 400
    total_bytes: int = 640_000


def normalised(text: bytes) -> bytes:
    """ASCII letters lower-cased; runs of other ASCII characters become one space."""
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", text.translate(_LOWER)).strip()


def suffix_automaton(data: bytes) -> tuple[np.ndarray, int]:
    """Edges (state, symbol, state) of the automaton of all substrings of data, from state 0, and the number of states."""
    edges: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in data:
        new = len(edges)
        edges.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return np.array([(s, c, t) for s, e in enumerate(edges) for c, t in e.items()], np.int32).reshape(-1, 3), len(edges)


@dataclass
class Model:
    """languages in ascending order; the automata's edges and each automaton's states."""

    languages: list[str]
    edges: list[np.ndarray]
    states: list[int]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset of each byte's symbol by language, roots, next state by state and symbol or -1) of all automata in one array.

        A state is the place of its first entry; each language has entries for the bytes of its own text, and one, always -1, for all others.
        """
        symbols, roots, parts, at = np.zeros((len(self.languages), 256), np.int32), [], [], 0
        for k, (e, n) in enumerate(zip(self.edges, self.states)):
            used = np.unique(e[:, 1])
            symbols[k, used] = np.arange(1, len(used) + 1)
            width = len(used) + 1
            step = np.full(n * width, -1, np.int32)
            step[e[:, 0] * width + symbols[k, e[:, 1]]] = at + e[:, 2] * width
            roots.append(at)
            parts.append(step)
            at += n * width
        return symbols, np.array(roots, np.int32), np.concatenate(parts)


def build(samples: dict[str, bytes]) -> Model:
    built = [suffix_automaton(samples[x]) for x in sorted(samples)]
    return Model(sorted(samples), [e for e, _ in built], [n for _, n in built])


class _Parser:
    """Greedy parses of lanes, each a block with one language's automaton: its state, and whether a phrase is open."""

    def __init__(self, step: np.ndarray, roots: np.ndarray, state: np.ndarray) -> None:
        self.step, self.roots, self.state = step, roots, state
        self.made = np.zeros(len(state), np.int64)

    def advance(self, symbol: np.ndarray, live: np.ndarray | slice) -> None:
        """Takes the next byte of the live lanes. A lane that is at its root has no phrase open."""
        state, root = self.state[live], self.roots[live]
        there = self.step[state + symbol]
        stop = there < 0
        if stop.any():
            # The phrase ends before this byte, which starts the next one, or is one by itself.
            first = self.step[root + symbol]
            alone = first < 0
            self.made[live] += (stop & (state != root)).astype(np.int64) + (stop & alone)
            there = np.where(stop, np.where(alone, root, first), there)
        self.state[live] = there


def phrases(texts: list[bytes], tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """(texts, languages): the phrases that each normalised text takes. A byte that no phrase can start with is a phrase of its own."""
    symbols, roots, step = tables
    kinds = len(roots)
    owner = np.array([i for i, t in enumerate(texts) for _ in range(0, len(t), BLOCK)], np.int64)
    blocks = [t[k : k + BLOCK] for t in texts for k in range(0, len(t), BLOCK)]
    sizes = np.array([len(b) for b in blocks], np.int64)
    made = np.zeros((len(blocks), kinds), np.int64)
    ends = np.zeros((len(blocks), kinds), np.int32)
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        longest, lanes = int(sizes[part[0]]), len(part)
        raw = np.frombuffer(b"".join(blocks[i].ljust(longest, b"\0") for i in part), np.uint8).reshape(lanes, longest).T
        live = np.searchsorted(-sizes[part], -np.arange(longest), side="left")  # lanes that are longer than each step
        for k in range(kinds):
            grid = symbols[k][raw]
            p = _Parser(step, np.full(lanes, roots[k], np.int32), np.full(lanes, roots[k], np.int32))
            for b in range(longest):
                p.advance(grid[b, : live[b]], slice(0, live[b]))
            made[part, k], ends[part, k] = p.made, p.state
    # Blocks that follow one of the same text, which ended inside a phrase, and the state that it really ended in.
    for k in range(kinds):
        true, table = ends[:, k].copy(), symbols[k]
        again = np.flatnonzero((np.r_[-1, owner[:-1]] == owner) & (np.r_[roots[k], true[:-1]] != roots[k]))
        extra = np.zeros(len(blocks), np.int64)
        while len(again):
            root = np.full(len(again), roots[k], np.int32)
            old, new = _Parser(step, root, root.copy()), _Parser(step, root, true[again - 1].copy())
            raw, longest = np.frombuffer(b"".join(blocks[i].ljust(BLOCK, b"\0") for i in again), np.uint8).reshape(len(again), BLOCK), sizes[again]
            apart = np.arange(len(again))
            for b in range(BLOCK):
                apart = apart[(b < longest[apart]) & (old.state[apart] != new.state[apart])]
                if not len(apart):
                    break
                symbol = table[raw[apart, b]]
                old.advance(symbol, apart)
                new.advance(symbol, apart)
            extra[again] = new.made - old.made
            met = old.state == new.state
            changed = np.where(met, ends[again, k], new.state) != true[again]
            true[again] = np.where(met, ends[again, k], new.state)
            # Where the end is another one than was taken for, the next block of the text is parsed once more.
            again = again[changed] + 1
            again = again[again < len(blocks)]
            again = again[owner[again] == owner[again - 1]]
        made[:, k] += extra
        last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else np.empty(0, np.int64)
        made[last, k] += true[last] != roots[k]
    count = np.zeros((len(texts), kinds), np.int64)
    np.add.at(count, owner, made)
    return count


def fit(docs: DataFrame, learn: Column, s: Settings = Settings()) -> Model:
    """A model from rows of docs (doc_id, text, lang) for which learn holds and lang is not null, within the bounds of s.

    A language's sample is whole texts of its rows, in the order of a hash of doc_id and text, as far as they fit
    into its bytes; if the first does not, the piece of it at an offset that the hash gives.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("o"))
    kinds = saved(rows.groupBy("lang").count(), "language-kinds")
    bound = min(s.bytes_per_language, s.total_bytes // max(1, kinds.count()))
    # A share of the hash's range that holds more rows than are asked for: the window is over few rows of a language at any size.
    share = F.least(F.lit(1.0), F.lit(8 * s.rows_per_language) / F.col("count")) * (1 << 30)
    near = rows.withColumn("o", F.pmod("o", F.lit(1 << 30))).join(kinds, "lang").where(F.col("o") <= share)
    # Texts that cannot fit are not sent on whole: the piece is all that could be used of them.
    start = F.pmod("o", F.greatest(F.length("text") - bound, F.lit(1))).cast("int") + 1
    part = near.select("lang", "o", F.substring("text", start, F.lit(bound)).alias("part"), (F.length("text") <= bound).alias("whole"))
    part = part.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "part"))).where(F.col("n") <= s.rows_per_language)
    taken, used, pieces = defaultdict(list), Counter(), {}
    for r in part.orderBy("lang", "n").toLocalIterator():
        data = normalised(r.part.encode())
        pieces.setdefault(r.lang, data[:bound])
        if r.whole and used[r.lang] + len(data) <= bound:
            taken[r.lang].append(data)
            used[r.lang] += len(data) + 1
    samples = {x: b" ".join(taken[x]) or piece for x, piece in pieces.items()}
    return build({x: data for x, data in samples.items() if data})


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs (any columns) with lang_pred and score appended; own columns of these names are replaced.

    lang_pred is `und` with score 0 if the text is null or has no letter, or nothing was learned; of languages
    with equally few phrases the first in ascending order. score is 1 minus the ratio of the fewest phrases to
    the next fewest, or 1 if one language only was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def run(it):
        tables = shared.value.tables() if shared.value.languages else None
        names = shared.value.languages
        for batch in it:
            texts = list(utf8(batch.column("text")))
            lettered = [bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if tables is not None:
                at = [i for i, ok in enumerate(lettered) if ok]
                clean = [normalised(texts[i]) for i in at]
                count = phrases(clean, tables)
                for i, row in zip(at, count):
                    order = np.argsort(row, kind="stable")
                    pred[i] = names[order[0]]
                    score[i] = 1.0 - float(row[order[0]]) / max(1.0, float(row[order[1]])) if len(order) > 1 else 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return mapped(docs, run, StructField("lang_pred", StringType()), StructField("score", DoubleType()))
