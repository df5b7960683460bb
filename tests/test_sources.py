from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from fathomline.functions.dimensions import svg_length
from fathomline.functions.text import number_text, percent_decode, percent_encode
from fathomline.operators.snapshots import with_change
from fathomline.sources import listing
from fathomline.sources.info_lines import format_line, parsed_lines, snapshot
from fathomline.sources.ls_lines import ls_records


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_percent(spark):
    values = ["", "a b%c\nd", "é %", "100%25", None, "\0"]
    coded = column(spark, values, percent_encode)
    assert coded == ["", "a%20b%25c%0Ad", "é%20%25", "100%2525", None, "%00"]
    assert column(spark, coded, percent_decode) == values
    assert column(spark, ["%zz%4", "a+b", "%C3%A9", "%41%42x%43"], percent_decode) == ["%zz%4", "a+b", "é", "ABxC"]


def test_numbers(spark):
    assert column(spark, ["1.0", "2.5", "44100.0"], lambda v: number_text(v.cast("double"))) == ["1", "2.5", "44100"]


@pytest.mark.parametrize(("text", "want"), [("099", 99), ("0009px", 9), (" 2.5 PT ", 3), ("1pc", 15), ("10mm", 35), ("1in", 90), ("2e1", 20), ("-3", None), ("x", None), ("", None), (None, None)])
def test_svg_length(spark, text, want):
    assert column(spark, [text], svg_length) == [want]


def test_lines(spark):
    lines = ["format=png mtime=5 size=7 tags=a,b f=x y f= z", "format=symlink size=3 symlink=t f=l", "format=? f=nosize", "format=gif a=1 a=2 size=1 f=d", "format=gif junk f=e", "no name", "format=gif size=9 f=l", "format=a%20b size=1\r f=cr"]
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    got = {r.n: r for r in parsed_lines(rows).collect()}
    assert got[0].f == "x y f= z" and got[0].fields == {"format": "png", "mtime": "5", "size": "7", "tags": "a,b"}
    assert [got[i].error for i in range(8)] == [None, None, None, "duplicate key", "item without =", "f= not found", None, None]
    assert got[7].fields["format"] == "a b" and got[7].fields["size"] == "1\r"
    old = {r.f: r for r in snapshot(parsed_lines(rows), "n").collect()}
    assert old["l"].size == 9 and not old["l"].is_symlink and old["l"].tags is None and "nosize" not in old
    first = {r.f: r for r in snapshot(parsed_lines(rows.where("n < 2")), "n").collect()}
    assert first["l"].is_symlink and first["l"].tags == "" and first["l"].mtime is None


def test_format_line(spark):
    row = spark.createDataFrame([("a b", None, "n 1")], "x string, y string, f string")
    line = format_line({"zz": F.col("x"), "a": F.lit("%"), "y": F.col("y")}, F.col("f"), F.lit(""))
    assert row.select(line.alias("l")).first().l == "format=? a=%25 zz=a%20b f=n 1"
    with pytest.raises(Exception, match="bad byte"):
        row.select(format_line({}, F.lit("a\nb"), F.lit("x")).alias("l")).collect()


def test_listing_and_change(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "d" / "a.gif").write_bytes(b"GIF89a" + b"x" * 1000)
    os.symlink("empty", tmp_path / "to_file")
    os.symlink("nowhere", tmp_path / "dangling")
    os.symlink("d", tmp_path / "to_dir")
    listing.register(spark)
    rows = spark.read.format("file_listing").option("path", str(tmp_path)).load().collect()
    at = lambda r: r.path[len(str(tmp_path)) + 1 :]
    assert [(at(r), r.kind, r.size, r.symlink) for r in rows] == [("dangling", "symlink", 7, "nowhere"), ("empty", "file", 0, None), ("to_dir", "symlink", 1, "d"), ("to_file", "file", 0, "empty"), ("d/a.gif", "file", 1006, None)]
    assert {at(r): len(r.header) for r in rows if r.kind == "file"} == {"empty": 0, "to_file": 0, "d/a.gif": 512}
    none = spark.read.format("file_listing").option("path", str(tmp_path)).option("headerBytes", 0).load()
    assert all(r.header is None for r in none.collect())
    now = none.select(F.col("path").alias("f"), "size", "mtime", "symlink", (F.col("kind") == "symlink").alias("is_symlink"), F.lit(None).cast("string").alias("tags"))
    assert [r.changed for r in with_change(now, now).collect()] == [False] * 5
    assert sum(r.changed for r in with_change(now, now.withColumn("size", F.col("size") + F.when(F.col("size") > 9, 1).otherwise(0))).collect()) == 1


def test_ls(spark):
    text = ["./d:", "total 8", "-rw-r--r-- 1 u g 12 2024-01-02 03:04:05.6 +0100 a b", "drwxr-xr-x 2 u g 4096 2024-01-02 03:04:05 +0000 sub", "-rw-r--r-- 1 u g 5 Feb  3  2020 old", "-rw-r--r-- 1 u g 5 Mar 4 05:06 new", "-rw-r--r-- 1 u g 5 Foo 4 05:06 bad", "", "e:", "-rw-r--r-- 1 u g 1 Jan 1 2021 x"]
    rows = spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "listing string, line_no int, line string")
    got = [(r.f, r.size, r.mtime) for r in ls_records(rows, year=2022).orderBy("line_no").collect()]
    assert got == [("d/a b", 12, 1704161045), ("d/old", 5, 1580688000), ("d/new", 5, 1646370360), ("e/x", 1, 1609459200)]
