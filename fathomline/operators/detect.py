"""Format detection: the most confident signature that a header matches."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.formats.signatures import BY_LENGTH, BY_LENGTH_CONFIDENCE, HEADER_BYTES, UNKNOWN, Signature, ruled, signatures

#: A document type of HTML, or one of the tags that only HTML begins with.
HTML_START = r"(?i)^[\t-\r ]*<(?:!doctype(?=[\t-\r >])[\t-\r ]*html|html|head|body)(?=[\t-\r >])[\t-\r ]*"


def _candidate(confidence: int | str, name: str) -> str:
    return f"named_struct('confidence', cast({confidence} as int), 'format', '{name}')"


def _holds(s: Signature) -> str:
    """SQL condition that the header h matches."""
    return " AND ".join(f"substring(h, {c.offset + 1}, {c.size}) IN ({', '.join(_quoted(o) for o in c.options)})" for c in s.conditions + s.guards)


def _quoted(b: bytes) -> str:
    return f"X'{b.hex()}'"


def _any(data: bytes) -> str:
    return ", ".join(_quoted(bytes([c])) for c in data)


def _computed() -> list[str]:
    """SQL of candidates of formats that a rule describes rather than fixed bytes; null where the rule fails."""
    start = f"100 * length(regexp_extract(decode(h, 'ISO-8859-1'), r'{HTML_START}', 0))"
    spaces = _any(b"\t\n\x0b\x0c\r ")
    html = f"if(substring(h, 1, 1) IN ({spaces}), 68 + greatest(1, {start} - 12), 100 + greatest(1, {start} - 100))"
    pnm = f"substring(h, 1, 1) = X'50' AND substring(h, 2, 1) IN ({_any(b'1234567')}) AND (substring(h, 3, 1) = X'23' OR substring(h, 3, 1) IN ({spaces}) AND substring(h, 4, 1) IN ({_any(b'0123456789')}))"
    # Confidence of one fixed byte, one of seven and one of seven, and one for the digit or comment.
    found = [f"CASE WHEN {start} > 0 THEN {_candidate(html, 'html')} END", f"CASE WHEN {pnm} THEN {_candidate(100 + 65 + 65 + 1, 'pnm')} END"]
    for s, rule, bonus in ruled():
        found.append(f"CASE WHEN {_holds(s)} AND ({_numbers(rule)}) THEN {_candidate(f'({s.confidence} + greatest(1, {_numbers(str(bonus))}))', s.format)} END")
    return found


def _numbers(sql: str) -> str:
    """u8(at), u16le(at), u32le(at) and u32be(at) of a rule written out; a number that the header lacks is null, which fulfils no condition."""

    def written(m: re.Match) -> str:
        size, little, at = int(m[1]) // 8, m[2] == "le", int(m[3])
        digits = [f"hex(substring(h, {at + k + 1}, 1))" for k in (reversed(range(size)) if little else range(size))]
        number = f"conv(concat({', '.join(digits)}), 16, 10)"
        return f"if(length(h) >= {at + size}, cast({number} as {'int' if size < 4 else 'bigint'}), null)"

    return re.sub(r"\bu(8|16|32)(le|be)?\(([0-9]+)\)", written, sql)


@cache
def _best_sql() -> str:
    """SQL of the best candidate of the header h. Signatures are grouped by their first byte where it is fixed, so a row meets only those that can match."""
    groups: dict[int | None, list[Signature]] = defaultdict(list)
    for s in signatures():
        for first in {o[0] for o in s.conditions[0].options} if s.conditions[0].offset == 0 else {None}:
            groups[first].append(s)

    def best(found: list[Signature]) -> str:
        options = [f"CASE WHEN {_holds(s)} THEN {_candidate(s.confidence, s.format)} END" for s in found]
        return options[0] if len(options) == 1 else f"greatest({', '.join(options)})"

    arms = " ".join(f"WHEN substring(h, 1, 1) = {_quoted(bytes([first]))} THEN {best(found)}" for first, found in sorted((g for g in groups.items() if g[0] is not None)))
    short = f"CASE WHEN length(h) < {len(BY_LENGTH)} THEN named_struct('confidence', {BY_LENGTH_CONFIDENCE}, 'format', element_at(array({', '.join(repr(x) for x in BY_LENGTH)}), length(h) + 1)) END"
    return f"coalesce({short}, greatest(CASE {arms} END, {best(groups[None])}, {', '.join(_computed())}), {_candidate(0, UNKNOWN)})"


def best_match(content: str) -> Column:
    """struct(confidence, format) of SQL of a binary value: the most confident match, of equals the last by name; `?` with 0 if none, null for null.

    One projection: no join, no shuffle, no Python. In a lambda, so that the header is cut once, and so that
    the long chain of cases, beyond the size of a compiled method, is interpreted by itself.
    """
    return F.expr(f"if({content} IS NULL, NULL, get(transform(array(substring({content}, 1, {HEADER_BYTES})), h -> {_best_sql()}), 0))")


def detect(files: DataFrame, content: str = "content") -> DataFrame:
    """files with confidence and format appended; an own column of these names is replaced."""
    found = files.drop("confidence", "format").withColumn("detected", best_match(f"`{content}`"))
    return found.withColumns({"confidence": F.col("detected.confidence"), "format": F.col("detected.format")}).drop("detected")


def signature_table(spark) -> DataFrame:
    """The registry as a table: format, kind, confidence, prefix (the fixed bytes at 0, four at most) and the conditions."""
    rows = []
    for s in signatures():
        first = s.conditions[0]
        for p in {o[:4] for o in first.options} if first.offset == 0 else {b""}:
            rows.append((s.format, s.kind, s.confidence, bytearray(p), [(c.offset, c.size, [bytearray(o) for o in c.options]) for c in s.conditions + s.guards]))
    return spark.createDataFrame(rows, "format string, kind string, confidence int, prefix binary, conditions array<struct<at:int,size:int,options:array<binary>>>")


def detect_by_join(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, confidence, format) by a broadcast join of each header's prefixes with the registry, which is a fixed table of some hundred rows; for registries that come as data. Formats that a rule describes are matched by column expressions beside it."""
    header = F.substring(F.col(content), 1, HEADER_BYTES).alias("header")
    prefixes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.substring(F.col("header"), F.lit(1), n)))
    rows = files.select(key, header).withColumn("prefix", F.explode(prefixes))
    table = F.broadcast(signature_table(files.sparkSession))
    holds = F.forall("conditions", lambda c: F.array_contains(c["options"], F.substring(F.col("header"), c["at"] + 1, c["size"])))
    best = rows.join(table, "prefix").where(holds).groupBy(key).agg(F.max(F.struct("confidence", "format")).alias("best"))
    short = F.when(F.length("header") < len(BY_LENGTH), F.element_at(F.array(*map(F.lit, BY_LENGTH)), F.length("header") + 1))
    rules = F.expr(f"get(transform(array(header), h -> greatest({', '.join(_computed())})), 0)")
    both = files.select(key, header).join(best.withColumnRenamed("best", "joined"), key, "left").withColumn("best", F.greatest("joined", rules))
    return both.select(
        key,
        F.when(short.isNotNull(), BY_LENGTH_CONFIDENCE).otherwise(F.coalesce("best.confidence", F.lit(0))).alias("confidence"),
        F.coalesce(short, "best.format", F.lit(UNKNOWN)).alias("format"),
    )
