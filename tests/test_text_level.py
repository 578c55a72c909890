"""Scanner speed, en dashes, layouts, deep nesting, patch blocking: hostile values against plain Python."""

import json
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import bench
from folioframe.functions import latex, markdown, text
from folioframe.operators import gates, normalize, patch, render, scan
from folioframe.plans import lib_sql
from folioframe.sources import files

DASHES = [
    ("007-010", "007--010"), ("2-9, 92-91", "2--9, 92-91"), ("1-5 of 2001-5-31", "1--5 of 2001-5-31"), ("1 - 5", "1--5"), ("3-3", "3-3"), ("x", "x"), ("", ""), ("1-2 3-4 1-2", "1--2 3--4 1--2"),
    ("Op.15-2", "Op.15-2"), ("v1-2", "v1--2"), ("99999999999999999998-99999999999999999999", "99999999999999999998--99999999999999999999"), ("09-9", "09-9"), (None, None),
]


@pytest.mark.parametrize("value,expected", DASHES)
def test_en_dashes(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(normalize.en_dashed(F.col("v"))).first()[0] == expected


def test_scanner_is_linear():
    assert bench.scan_rate(1000, 3_000_000) < 2
    began = time.time()
    scan.scan("@a{k,\n\tx = {" + "{a, b}" * 200_000 + "}}")
    assert time.time() - began < 2


def _one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("depth", [1, 3, 7, 30])
def test_deep_nesting(spark, depth):
    inner = "x"
    for _ in range(depth):
        inner = "\\emph{" + inner + "}"
    braces = "{" * depth + "x" + "}" * depth
    assert _one(spark, latex.strip_latex, inner + " y") == "x y"
    assert _one(spark, latex.unwrap, "\\mkbibquote{" + braces + "}") == braces
    assert _one(spark, latex.unwrap, "\\mkbibquote{a} and \\mkbibquote{" + braces + "}") == "\\mkbibquote{a} and \\mkbibquote{" + braces + "}"
    assert _one(spark, lambda c: markdown.without_command(c, ["foo"], True), "a\\foo{" + braces + "}b") == "a" + braces + "b"
    assert _one(spark, lambda c: markdown.without_command(c, ["foo"], False), "a\\foo{" + braces + "}b") == "ab"
    entry = "@book{k, title = {" + braces + "}}"
    assert _one(spark, text.cleaned_reply, "Here: " + entry + " Done. @book{z, t = {q}}") == entry


@pytest.mark.parametrize("value,expected", [("no entry", ""), ("x @book{k, t = {open", "@book{k, t = {open"), (None, None)])
def test_replies_without_an_entry(spark, value, expected):
    assert _one(spark, text.cleaned_reply, value) == expected


@pytest.mark.parametrize("pages,kind", [([450, 100], "FULL"), ([500, 140], "FULL"), ([500, 200], "BEGINNING"), ([700, 120], "FULL"), ([10, 700], "BEGINNING"), ([0], "FULL")])
def test_short_documents(spark, pages, kind):
    value = [" ".join(["word."] * n) for n in pages]
    got = spark.createDataFrame([(value,)], "p array<string>").select(text.page_window(F.col("p"))).first()[0]
    assert got.startswith(f"--- {kind}")


LAYOUTS = {"tabs": "@book{k,\n\ttitle = {A: b},\n\tisbn = {1}}\n", "blanks": "@book{k,\n    title = {A: b},\n    isbn = {1}}\n", "one line": "@book{k, title = {A: b}, isbn = {1}}\n"}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts(spark, layout):
    docs = spark.createDataFrame([("d", LAYOUTS[layout])], "doc string, text string")
    planned = normalize.plan(scan.entries(scan.scan_documents(docs)))
    after = render.apply_edits(docs, normalize.edits_of(planned)).first().text
    labels = [r.label for r in normalize.reports_of(planned).collect()]
    if layout == "one line":
        assert after == LAYOUTS[layout] and labels.count("skipped-unparsable-layout") == 2
    else:
        lead = re.search(r"\n[ \t]+", LAYOUTS[layout])[0]
        assert after == f"@book{{k,{lead}subtitle = {{b}},{lead}title = {{A}}}}\n" and not labels


def test_problems_block_a_list(spark):
    fields = spark.createDataFrame([("k", "book", "title", "title", "A")], "citekey string, etype string, key string, name string, value string")
    entries = fields.select("citekey")
    ops = lambda *rows: spark.createDataFrame([(i, *r, "why") for i, r in enumerate(rows)], "op_ord int, op string, key string, field string, value string, why string")
    good = patch.checked(ops(("set", "k", "title", "B")), entries, fields)
    bad = patch.checked(ops(("set", "k", "title", "B"), ("set", "none", "title", "B")), entries, fields)
    assert [r.value for r in patch.applied(fields, good).collect()] == ["B"] and [r.value for r in patch.applied(fields, bad).collect()] == ["A"]


def test_patches_keep_their_order(spark, tmp_path):
    ops = [{"op": "set", "key": f"k{i}", "field": "title", "value": str(i), "why": "w"} for i in range(50)]
    (tmp_path / "p.json").write_text(json.dumps(ops, indent=1))
    got = files.read_patches(spark, str(tmp_path / "p.json")).orderBy("op_ord").collect()
    assert [(r.op_ord, r.key) for r in got] == [(i + 1, f"k{i}") for i in range(50)]


@pytest.mark.parametrize("field,counts", [("keywords", True), ("doi", True), ("rating", True), ("note", False)])
def test_normaliser_protects(spark, field, counts):
    one = lambda v: scan.scan_documents(spark.createDataFrame([("d", f"@book{{k,\n\t{field} = {{{v}}}}}")], "doc string, text string"))
    assert (gates.protected_changed(one("a"), one("b")).count() > 0) == counts


SPACED = ["\xa0", " \u3000a b\u2003", "\ta\n", "\xa0\n\xa0", "a", "", " \xa0 ", "a\xa0" * 30 + " "]


@pytest.mark.parametrize("name", ["st_snap_head", "st_snap_tail"])
def test_short_texts_lose_spaces_of_any_kind(spark, tmp_path, name):
    con = duckdb.connect()
    spark.createDataFrame(list(enumerate(SPACED)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_scanner_holds_a_block_of_rows(spark, monkeypatch):
    # the rows of a batch of documents, and of one long document, leave in blocks: executors had all of them in memory
    monkeypatch.setattr(scan, "BLOCK_ROWS", 10)
    one = "".join(f"@a{{k{i},\n\tx = {{y}}}}\n" for i in range(100))
    assert list(map(len, scan.blocks(scan.spans(one)))) == [10] * 20
    assert [r for b in scan.blocks(scan.spans(one)) for r in b] == scan.scan(one)
    monkeypatch.setattr(scan, "BLOCK_CHARS", 20)
    assert all(sum(r["end"] - r["start"] for r in b[:-1]) < 20 for b in scan.blocks(scan.spans(one)))
    docs = spark.createDataFrame([("d", one), ("n", None), ("e", ""), ("f", "stray")], "doc string, text string")
    got = scan.scan_documents(docs).orderBy("doc", "ord").collect()
    assert [{k: v for k, v in r.asDict(True).items() if k != "doc"} for r in got if r.doc == "d"] == [{k: r[k] for k in ("kind", "ord", "etype", "citekey", "start", "end", "fields")} for r in scan.scan(one)]
    assert [(r.doc, r.kind) for r in got if r.doc != "d"] == [("f", "opaque")]


def test_long_document_is_scanned_in_little_memory():
    import tracemalloc

    text_ = "".join(f"@a{{k{i},\n\tx = {{y}},\n\tz = {{w}}}}\n" for i in range(20_000))
    tracemalloc.start()
    try:
        assert sum(map(len, scan.blocks(scan.spans(text_)))) == 40_000
        assert tracemalloc.get_traced_memory()[1] < 3_000_000
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["p_field_map_lookup", "p_field_values", "f_missing_required", "f_forbidden_strip", "tx_top_level_colons", "tx_terminal_marks", "r_findings_by_rule"])
def test_entries_at_one_place_are_scanned_in_pieces(spark, tmp_path, name):
    # 1,200 entries at each of two places of a path were one document, held whole by an executor
    entries = "range(2400) t(i)"
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE bib_entry AS SELECT i AS entry_id, 'a.bib' AS path, CAST(i % 2 AS INTEGER) AS entry_ord, 'article' AS etype, 'k' || (i % 7) AS citekey, "
        f"CAST(NULL AS VARCHAR) AS author, 'On: things?' AS title, CAST(NULL AS VARCHAR) AS entry_date, '1--2' AS pages FROM {entries}"
    )
    con.execute(f"CREATE TABLE bib_field AS SELECT i AS entry_id, 1 AS field_ord, 'Title' AS field_name, 'On: things? ' || (i % 3) AS field_value FROM {entries} UNION ALL SELECT i, 2, 'pages', '1--2' FROM {entries}")
    for t in ("bib_entry", "bib_field"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    each = lib_sql.lib_scanned(spark, str(tmp_path)).filter("kind = 'entry'").groupBy("doc").count().collect()
    assert sum(r["count"] for r in each) == 2400 and max(r["count"] for r in each) <= 500 and {r.doc for r in each} == {"a.bib#0", *(f"a.bib#0.{i}" for i in range(1, 5))}
    got = sorted(map(repr, map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))


def test_pieces_are_the_documents_where_places_differ(spark):
    rows = [(f"p{i % 2}.bib", i, "book", f"k{i}", [("a", "b")]) for i in range(30)]
    e = spark.createDataFrame(rows, "path string, entry_ord int, etype string, citekey string, fields array<struct<name:string,value:string>>")
    assert sorted(render.pieces(e, 10).collect()) == sorted(render.documents(e, 10).collect())
    whole = {r.doc: r.text for r in render.documents(e.withColumn("entry_ord", F.lit(0)), 10).collect()}
    parts = render.pieces(e.withColumn("entry_ord", F.lit(0)), 10).orderBy("doc").collect()
    assert {d: "\n".join(r.text for r in parts if r.doc.split(".bib")[0] == d.split(".bib")[0]) for d in whole} == whole
