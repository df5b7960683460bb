"""Queries over the driver's tables, each with its DuckDB counterpart.

The tables hold no media files, so most queries are adapters: they put an operator of the engine to work on
columns that have the shape it needs, and say which in their docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.formats.signatures import BY_LENGTH, BY_LENGTH_CONFIDENCE, HEADER_BYTES, Signature, formats, signatures
from fathomline.functions.dimensions import plausible_dimensions, svg_length
from fathomline.functions.text import percent_decode, percent_encode
from fathomline.operators import merging, snapshots, tracks
from fathomline.operators.detect import best_match, detect, detect_by_join
from fathomline.sources.info_lines import format_line, parsed_lines, snapshot
from fathomline.sources.ls_lines import ls_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_hex(b: bytes) -> str:
    return f"'{b.hex().upper()}'"


def _sql_match(h: str, s: Signature) -> str:
    """DuckDB condition that the hexadecimal text h of a header matches a signature."""
    return " AND ".join(f"substr({h}, {2 * c.offset + 1}, {2 * c.size}) IN ({', '.join(map(_sql_hex, c.options))})" for c in s.conditions + s.guards)


def _sql_detect(source: str, key: str) -> str:
    """DuckDB SQL of (key, confidence, format) for a subquery with (key, h: upper-case hexadecimal header, head: its text)."""
    start = "length(regexp_extract(head, '(?i)^[\\t-\\r ]*<(?:!doctype[\\t-\\r ]+html|html|head|body)(?:[\\t-\\r ]+|>)')) "
    # RE2 has no lookahead: a closing > is matched and taken off again.
    html = f"({start} - CASE WHEN regexp_matches(head, '(?i)^[\\t-\\r ]*<(?:!doctype[\\t-\\r ]+html|html|head|body)>') THEN 1 ELSE 0 END) * 100"
    arms = [f"SELECT {key}, {s.confidence} AS confidence, '{s.format}' AS format FROM src WHERE {_sql_match('h', s)}" for s in signatures()]
    arms.append(f"SELECT {key}, {html} AS confidence, 'html' AS format FROM src WHERE {start} > 0 AND substr(h, 1, 2) = '3C'")
    arms += [f"SELECT {key}, {BY_LENGTH_CONFIDENCE} AS confidence, '{name}' AS format FROM src WHERE length(h) = {2 * n}" for n, name in enumerate(BY_LENGTH)]
    best = " UNION ALL ".join(arms)
    return (
        f"WITH src AS MATERIALIZED ({source}), best AS (SELECT {key}, max(row(confidence, format)) AS b FROM ({best}) GROUP BY {key})"
        f" SELECT src.{key}, CAST(coalesce(b[1], 0) AS INTEGER) AS confidence, coalesce(b[2], '?') AS format FROM src LEFT JOIN best ON src.{key} = best.{key}"
    )


_HEAD = f"upper(hex(encode(left(X, {HEADER_BYTES}))))"


@query(_sql_detect(f"SELECT page_id, left({_HEAD.replace('X', 'html')}, {2 * HEADER_BYTES}) AS h, html AS head FROM pages", "page_id"))
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format detection over page bytes: the html rule against all signatures."""
    return detect(table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))).drop("content")


def _anchor(s: Signature) -> bytes:
    out = bytearray()
    for c in s.conditions + s.guards:
        out.extend(b"\0" * max(0, c.offset - len(out)))
        out[c.offset : c.offset + c.size] = c.options[-1]
    return bytes(out)


def _mixed(sql: bool) -> str:
    """Header bytes by doc_id: a signature's, then the text; one in seven is cut to 0 to 3 bytes."""
    anchors = ", ".join(f"'{_anchor(s).hex().upper()}'" for s in signatures())
    pick = f"[{anchors}][1 + doc_id % {len(signatures())}]" if sql else f"element_at(array({anchors}), cast(1 + doc_id % {len(signatures())} as int))"
    body = "upper(hex(encode(coalesce(text, ''))))" if sql else "hex(encode(coalesce(text, ''), 'UTF-8'))"
    return f"CASE WHEN doc_id % 7 = 0 THEN left({pick}, cast(2 * (doc_id % 4) as int)) ELSE left(concat({pick}, {body}), {2 * HEADER_BYTES}) END"


@query(_sql_detect(f"SELECT doc_id, {_mixed(True)} AS h, '' AS head FROM documents", "doc_id"))
def detect_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: competing signatures, unknown and very short files, from headers made of signatures and texts."""
    return detect(table(spark, sf_dir, "documents").select("doc_id", F.expr(f"unhex({_mixed(False)})").alias("content"))).drop("content")


@query(ORACLES["detect_mixed_headers"])
def detect_by_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the join of prefixes with the registry as a table."""
    return detect_by_join(table(spark, sf_dir, "documents").select("doc_id", F.expr(f"unhex({_mixed(False)})").alias("content")), "doc_id")


@query(_sql_detect(f"SELECT doc_id, left({_HEAD.replace('X', 'text')}, {2 * HEADER_BYTES}) AS h, text AS head FROM documents", "doc_id"))
def detect_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format detection over text: mostly unknown."""
    return detect(table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))).drop("content")


@query(f"SELECT format, count(*) AS files FROM ({ORACLES['detect_mixed_headers']}) GROUP BY format")
def format_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_mixed_headers(spark, sf_dir).groupBy("format").agg(F.count("*").alias("files"))


@query("SELECT page_id, regexp_matches(html, '(?i)^[\\t-\\r ]*<(?:!doctype[\\t-\\r ]+html|html|head|body)[\\t-\\r >]') AS is_html FROM pages")
def html_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_match("encode(html, 'UTF-8')")
    return table(spark, sf_dir, "pages").select("page_id", (found["format"] == "html").alias("is_html"))


@query("SELECT url AS f, CAST(strlen(html) AS BIGINT) AS size FROM pages UNION ALL SELECT concat('documents/', source, '/', doc_id, '.txt'), CAST(strlen(text) AS BIGINT) FROM documents")
def quick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stat-only record: name and size, no content."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("f"), F.octet_length("text").cast("long").alias("size"))
    return table(spark, sf_dir, "pages").select(F.col("url").alias("f"), F.octet_length("html").cast("long").alias("size")).unionByName(docs)


_ENCODED = "replace(replace(replace(X, '%', '%25'), chr(10), '%0A'), ' ', '%20')"
_LINE_SQL = f"SELECT doc_id, concat('format=', lang, ' n_chars=', n_chars, ' note=', {_ENCODED.replace('X', 'text')}, ' size=', strlen(text), ' f=docs/', source, ' f=', doc_id, '.txt') AS line FROM documents"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"size": F.octet_length("text").cast("string"), "n_chars": F.col("n_chars").cast("string"), "note": F.col("text"), "absent": F.lit(None).cast("string")}
    name = F.concat(F.lit("docs/"), "source", F.lit(" f="), "doc_id", F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", format_line(fields, name, F.col("lang")).alias("line"))


@query(_LINE_SQL)
def info_line_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writer of info lines, with the whole text as a value that needs encoding."""
    return _lines(spark, sf_dir)


@query("SELECT doc_id, concat('docs/', source, ' f=', doc_id, '.txt') AS f, lang AS format, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS note_sha256 FROM documents")
def info_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader of what the writer wrote: the note is the text again."""
    got = parsed_lines(_lines(spark, sf_dir), "line")
    value = lambda k: F.element_at("fields", F.lit(k))
    return got.select("doc_id", "f", value("format").alias("format"), value("size").cast("long").alias("size"), F.sha2(F.encode(value("note"), "UTF-8"), 256).alias("note_sha256"))


@query("SELECT doc_id, text = text AS same, sha256(" + _ENCODED.replace("X", "text") + ") AS encoded_sha256 FROM documents")
def percent_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = percent_encode(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", (percent_decode(coded) == F.col("text")).alias("same"), F.sha2(F.encode(coded, "UTF-8"), 256).alias("encoded_sha256"))


@query("SELECT 'documents' AS kind, doc_id AS id, sha256(text) AS sha256 FROM documents UNION ALL SELECT 'pages', page_id, sha256(html) FROM pages")
def sha256_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(kind: str, key: str, text: str) -> DataFrame:
        return table(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"))

    return digests("documents", "doc_id", "text").unionByName(digests("pages", "page_id", "html"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_NEW = "SELECT concat('d/', doc_id) AS f, n_chars AS size, doc_id * 60 AS mtime, CASE WHEN doc_id % 50 = 0 THEN source END AS symlink, FALSE AS is_symlink, lang AS tags FROM documents WHERE TRUE"
_OLD = (
    "SELECT CASE WHEN doc_id % 9 = 4 THEN concat('gone/', doc_id) ELSE concat('d/', doc_id) END AS f, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN doc_id ELSE doc_id * 60 END AS mtime,"
    " CASE WHEN doc_id % 100 = 0 THEN source END AS symlink, doc_id % 31 = 0 AS is_symlink, CASE WHEN doc_id % 17 <> 0 THEN lang END AS tags FROM documents WHERE TRUE"
)
_CHANGED = "o.f IS NULL OR n.size IS DISTINCT FROM o.size OR n.mtime IS DISTINCT FROM o.mtime OR n.symlink IS DISTINCT FROM o.symlink OR n.is_symlink IS DISTINCT FROM o.is_symlink OR n.tags IS DISTINCT FROM o.tags"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = lambda sql: docs.where(sql.split(" WHERE ")[1]).selectExpr(*_columns(sql))
    return snapshots.with_change(read(_NEW), read(_OLD), mtime=True, tags=True)


def _columns(sql: str) -> list[str]:
    """The select list of a one-table statement whose expressions have commas only inside parentheses."""
    body, depth, out, part = sql.removeprefix("SELECT ").split(" FROM documents")[0], 0, [], ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


@query(f"SELECT n.f, n.size FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON n.f = o.f WHERE {_CHANGED}")
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a scan against an earlier snapshot; what has to be read again."""
    return _changes(spark, sf_dir).where("changed").select("f", "size")


@query(f"SELECT n.f, n.size FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON n.f = o.f WHERE NOT ({_CHANGED})")
def incremental_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("not changed").select("f", "size")


@query("SELECT CAST(user_id AS VARCHAR) AS f, arg_max(epoch_us(ts) // 1000000, event_id) AS mtime, arg_max(event_id, event_id) AS size, arg_max(event_type, event_id) AS tags FROM events GROUP BY user_id")
def snapshot_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: of an info file's lines of one name the last counts; events as lines of their user."""
    fields = {"size": F.col("event_id").cast("string"), "mtime": F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), "tags": F.col("event_type")}
    lines = table(spark, sf_dir, "events").select("event_id", format_line(fields, F.col("user_id").cast("string"), F.lit("log")).alias("value"))
    return snapshot(parsed_lines(lines), "event_id").select("f", "mtime", "size", "tags")


_KEYS = ["format", "size", "mtime", "sha256"]
_RECORDS = (
    "SELECT CAST(o_custkey AS VARCHAR) AS f, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'o' END AS format, CASE WHEN o_custkey % 4 = 1 THEN CAST(o_orderkey % 3 AS VARCHAR) ELSE '9' END AS size,"
    " CAST(o_orderkey AS VARCHAR) AS mtime, CASE WHEN o_custkey % 5 = 2 THEN o_orderpriority END AS sha256 FROM orders"
)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[c.replace("VARCHAR", "STRING") for c in _columns(_RECORDS.replace("FROM orders", "FROM documents"))])


_KINDS = ", ".join(f"count(DISTINCT {k}) AS n_{k}, min({k}) AS {k}" for k in _KEYS)
_MERGED = f"SELECT f, count(*) AS n, {_KINDS}, CAST(min(CAST(mtime AS BIGINT)) AS VARCHAR) AS least FROM ({_RECORDS}) GROUP BY f"
_CLEAN = "n_format < 2 AND n_size < 2 AND n_sha256 < 2"


@query(f"SELECT f, n, format, size, least AS mtime, sha256 FROM ({_MERGED}) WHERE {_CLEAN}")
def merge_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: records of one file merged, the least time winning; orders as records of their customer."""
    return merging.merge_records(_records(spark, sf_dir), _KEYS).where(F.size("conflicts") == 0).select("f", "n", *_KEYS)


_CONFLICTS = "concat_ws(',', CASE WHEN n_format > 1 THEN 'format' END, CASE WHEN n_size > 1 THEN 'size' END, CASE WHEN n_mtime > 1 THEN 'mtime' END, CASE WHEN n_sha256 > 1 THEN 'sha256' END)"


@query(f"SELECT f, n, {_CONFLICTS} AS conflicts FROM ({_MERGED}) WHERE NOT ({_CLEAN})")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_records(_records(spark, sf_dir), _KEYS).where(F.size("conflicts") > 0).select("f", "n", F.concat_ws(",", "conflicts").alias("conflicts"))


_SPLIT = f"SELECT r.*, CASE WHEN n_size > 1 THEN 'size' WHEN n_sha256 > 1 THEN 'sha256' END AS split_by, CASE WHEN n_size > 1 THEN r.size WHEN n_sha256 > 1 THEN r.sha256 END AS v FROM ({_RECORDS}) r JOIN ({_MERGED}) m ON r.f = m.f WHERE NOT ({_CLEAN})"
_GROUPS = f"SELECT f, split_by, v, {_KINDS}, CAST(min(CAST(mtime AS BIGINT)) AS VARCHAR) AS least FROM (SELECT * FROM split WHERE split_by IS NOT NULL) GROUP BY f, split_by, v"


@query(
    f"WITH split AS ({_SPLIT}), grouped AS ({_GROUPS}) SELECT f, format, size, least AS mtime, sha256 FROM ({_MERGED}) WHERE {_CLEAN}"
    f" UNION ALL SELECT f, format, size, least, sha256 FROM grouped WHERE {_CLEAN}"
    f" UNION ALL SELECT s.f, s.format, s.size, s.mtime, s.sha256 FROM split s JOIN grouped g ON s.f = g.f AND s.v IS NOT DISTINCT FROM g.v WHERE NOT (g.n_format < 2 AND g.n_size < 2 AND g.n_sha256 < 2)"
    " UNION ALL SELECT f, format, size, mtime, sha256 FROM split WHERE split_by IS NULL"
)
def merge_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the merge's whole output, conflicts of size or sha256 split into groups."""
    return merging.merge_by(_records(spark, sf_dir), _KEYS)


_TRACKS = (
    "SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'video' ELSE 'audio' END AS type, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE concat(l_linestatus, l_suppkey % 2) END AS codec, CAST(NULL AS VARCHAR) AS subformat,"
    " CAST(l_quantity AS BIGINT) * CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END + 16 AS width, CAST(100 AS BIGINT) AS height, CAST(l_linenumber AS BIGINT) AS channel_count, CAST(l_quantity * 1000 AS BIGINT) AS sample_rate, CAST(16 AS BIGINT) AS sample_size,"
    " l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem"
)
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[c.replace("VARCHAR", "STRING") for c in _columns(_TRACKS.replace("FROM lineitem", "FROM documents"))])
    return tracks.roll_up(rows, "l_orderkey", _ORDER)


_AUDIO = "count(*) FILTER (type = 'audio')"
_CODECS = "count(DISTINCT codec) FILTER (type = '@T' AND codec <> '')"


@query(
    f"SELECT l_orderkey, CASE WHEN {_AUDIO} = 1 THEN coalesce(max(codec) FILTER (type = 'audio'), '?') WHEN {_AUDIO} > 1 THEN CASE WHEN {_CODECS.replace('@T', 'audio')} = 1 THEN max(codec) FILTER (type = 'audio') ELSE 'multiple' END END AS acodec,"
    f" CASE WHEN {_AUDIO} = 1 THEN max(channel_count) FILTER (type = 'audio') END AS anch, CASE WHEN {_AUDIO} = 1 THEN max(sample_rate) FILTER (type = 'audio') END AS arate FROM ({_TRACKS}) GROUP BY l_orderkey"
)
def audio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: audio half of the track roll-up; order lines as tracks of their order."""
    return _rolled(spark, sf_dir).select("l_orderkey", "acodec", "anch", "arate")


_FIRST = "arg_min(row(codec, width, height), row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) FILTER (type = 'video')"


@query(
    f"SELECT l_orderkey, CASE WHEN v > 0 AND d = 1 THEN coalesce(x[1], '?') WHEN v > 1 THEN CASE WHEN c = 1 THEN one WHEN c = 0 THEN '?' ELSE 'multiple' END END AS vcodec, CASE WHEN d = 1 THEN x[2] END AS width, CASE WHEN d = 1 THEN x[3] END AS height FROM"
    f" (SELECT l_orderkey, count(*) FILTER (type = 'video') AS v, count(DISTINCT row(width, height)) FILTER (type = 'video') AS d, {_CODECS.replace('@T', 'video')} AS c, max(codec) FILTER (type = 'video') AS one, {_FIRST} AS x FROM ({_TRACKS}) GROUP BY l_orderkey)"
)
def video_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: video half of the track roll-up."""
    return _rolled(spark, sf_dir).select("l_orderkey", "vcodec", "width", "height")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS BIGINT) BETWEEN 16 AND 16383 AND CAST(l_quantity AS BIGINT) BETWEEN 16 AND 16383 AS plausible FROM lineitem")
def track_filter_dimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the range check of dimensions."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", plausible_dimensions(F.bround("l_extendedprice").cast("long"), F.bround("l_quantity").cast("long")).alias("plausible"))


@query("SELECT p_brand, b[1] AS pixels, b[2] AS p_partkey FROM (SELECT p_brand, max(row(p_size * p_size, p_partkey)) AS b FROM part GROUP BY p_brand)")
def largest_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the image of most pixels in an icon file; parts as images of their brand."""
    best = F.max(F.struct((F.col("p_size") * F.col("p_size")).alias("pixels"), "p_partkey"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.pixels", "b.p_partkey")


@query("SELECT l_suppkey, b[2] AS codec, b[1] AS tiles FROM (SELECT l_suppkey, max(row(n, codec)) AS b FROM (SELECT l_suppkey, concat(l_returnflag, l_linestatus) AS codec, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n >= 4 GROUP BY l_suppkey)")
def grid_codec_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the codec of most tiles of an image grid, if it has at least four."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("codec")).agg(F.count("*").alias("n")).where("n >= 4")
    return counts.groupBy("l_suppkey").agg(F.max(F.struct("n", "codec")).alias("b")).select("l_suppkey", "b.codec", F.col("b.n").alias("tiles"))


@query("SELECT url, array_to_string(list_transform(string_split(url, '/'), lambda p, i: concat(CASE WHEN i = len(string_split(url, '/')) THEN '0' ELSE '1' END, p)), chr(1)) AS sort_key FROM pages")
def dir_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the order of a recursive scan, as a sort key of URLs."""
    return table(spark, sf_dir, "pages").select("url", snapshots.scan_order(F.col("url")).alias("sort_key"))


@query("SELECT page_id FROM pages WHERE NOT (ends_with(concat(url, CASE WHEN page_id % 3 = 0 THEN '.th.jpg' WHEN page_id % 3 = 1 THEN '.th.jpg.tmp' ELSE '.jpg' END), '.th.jpg') OR page_id % 3 = 1)")
def thumb_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: thumbnails are left out."""
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".th.jpg").when(F.col("page_id") % 3 == 1, ".th.jpg.tmp").otherwise(".jpg"))
    return table(spark, sf_dir, "pages").where(~snapshots.is_thumbnail(name)).select("page_id")


@query("SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 + 86400 < 1705367014")
def skip_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: files that changed in the last day before a fixed time are left out."""
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("mtime"))
    return snapshots.settled(rows, now=1705367014, seconds=86400).select("event_id")


@query("SELECT 'd' AS listing, o_orderkey AS line_no, concat('dir', o_custkey % 5, '/', o_orderkey, ' ', o_orderstatus) AS f, o_custkey AS size, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 3723 - 7200 AS mtime FROM orders")
def ls_parse_full_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: `ls -l --full-time` text made of orders; each line has its directory's header in a listing of its own."""
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    entry = F.concat(F.lit("-rw-r--r-- 1 root root "), "o_custkey", F.lit(" "), day, F.lit(" 01:02:03.000000000 +0200 "), "o_orderkey", F.lit(" "), "o_orderstatus")
    head = F.concat(F.lit("./dir"), F.col("o_custkey") % 5, F.lit(":"))
    lines = orders.select(F.col("o_orderkey").alias("listing"), F.explode(F.array(F.struct(F.lit(0).alias("k"), head.alias("line")), F.struct(F.lit(1).alias("k"), F.lit("total 8").alias("line")), F.struct(F.lit(2).alias("k"), entry.alias("line")))).alias("x"))
    got = ls_records(lines.select("listing", F.col("x.k").alias("line_no"), F.col("x.line").alias("line")))
    return got.select(F.lit("d").alias("listing"), F.col("listing").alias("line_no"), "f", "size", "mtime")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity * CASE l_linenumber % 7 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.25::DOUBLE WHEN 2 THEN 15.0::DOUBLE WHEN 3 THEN 3.543307::DOUBLE WHEN 4 THEN 35.43307::DOUBLE WHEN 5 THEN 90.0::DOUBLE ELSE 1.0::DOUBLE END + 0.5::DOUBLE) AS BIGINT) AS pixels FROM lineitem"
)
def svg_dimen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: lengths with units."""
    unit = F.element_at(F.array(*map(F.lit, ("px", "pt", "pc", " mm", "cm", "in", ""))), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", svg_length(F.concat(F.lit(" "), F.col("l_quantity").cast("string"), unit)).alias("pixels"))


@query("SELECT p_partkey, p_type, coalesce(c.codec, p_type) AS codec FROM part LEFT JOIN (SELECT DISTINCT p_type AS t, concat('codec-', length(p_type)) AS codec FROM part WHERE length(p_type) % 2 = 0) c ON p_type = c.t")
def codec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: names by a dictionary, itself if it has none."""
    part = table(spark, sf_dir, "part")
    names = part.where(F.length("p_type") % 2 == 0).select(F.col("p_type").alias("t"), F.concat(F.lit("codec-"), F.length("p_type")).alias("codec")).distinct()
    return part.join(names, F.col("p_type") == F.col("t"), "left").select("p_partkey", "p_type", F.coalesce("codec", "p_type").alias("codec"))


@query("SELECT format, kind FROM (VALUES " + ", ".join(f"('{f}', '{k}')" for f, k in sorted(formats().items())) + ") AS t(format, kind)")
def list_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(formats().items()), "format string, kind string")
