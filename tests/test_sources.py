"""Sources, sinks, providers and streams."""

import json
import os
import plistlib
import re
import time

from pyspark.sql import functions as F

from folioframe.functions import text, web
from folioframe.operators import resolve, score
from folioframe.session import cut
from folioframe.sources import files, providers, sinks
from folioframe.streaming import ingest

BIB = "@article{k,\n\ttitle = {A},\n\tTitle = {B}}\n"


def test_read_libraries_and_data_source(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB, encoding="utf-8")
    (tmp_path / "b.bib").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("x")
    rows = {r.doc.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_libraries(spark, str(tmp_path)).collect()}
    assert rows == {"a.bib": (BIB, None), "b.bib": (None, "not UTF-8")}
    spark.dataSource.register(files.LibraryDataSource)
    got = spark.read.format("bib").load(str(tmp_path)).collect()
    assert [(r.etype, r.citekey, r.fields) for r in got] == [("article", "k", {"title": "A"})]


def test_inputs_and_bookmarks(spark, tmp_path):
    (tmp_path / "b.WEBLOC").write_bytes(plistlib.dumps({"URL": "https://x.example/a"}))
    (tmp_path / "a.webloc").write_bytes(plistlib.dumps({"URL": "https://x.example/b"}, fmt=plistlib.FMT_BINARY))
    (tmp_path / "c.webloc").write_bytes(b"junk")
    (tmp_path / "d.docx").write_bytes(b"x")
    rows = files.list_inputs(spark, str(tmp_path)).withColumn("url", files.bookmark_url("content")).collect()
    assert [(r.kind, r.url, r.error) for r in rows] == [("webloc", "https://x.example/b", None), ("webloc", "https://x.example/a", None), ("webloc", None, None), (None, None, "no extractor for .docx")]


def test_patches_manifest_outputs(spark, tmp_path):
    (tmp_path / "ops.json").write_text(json.dumps([{"op": "set", "key": "a", "field": "x", "value": "1"}, {"op": "noop", "key": "b"}]))
    assert [(r.op_ord, r.op, r.key) for r in files.read_patches(spark, str(tmp_path / "ops.json")).collect()] == [(1, "set", "a"), (2, "noop", "b")]
    (tmp_path / "m.json").write_text(json.dumps([{"n": 1, "citekey": "k", "etype": "book", "traits": [], "truth": {"title": "A."}}, {"n": 2, "citekey": "l", "etype": "book", "traits": [], "truth": {}}]))
    m = files.read_manifest(spark, str(tmp_path / "m.json"))
    docs = spark.createDataFrame([("/r/out_A/01_k.bib", BIB), ("/r/out_A/02_l.bib", " ")], "doc string, text string")
    assert {r.n: r.failed for r in files.run_outputs(m, docs, "A").collect()} == {1: False, 2: True}
    truth = m.select("n", F.explode("truth").alias("key", "value"))
    got = spark.createDataFrame([(1, "A", "title", "a"), (1, "A", "note", "z")], "n int, cfg string, key string, value string")
    t = score.totals(score.compared(truth, got)).first()
    assert (t.truth, t.match, t.extra, t.accuracy) == (1, 1, 1, 1.0)


def test_saved_prepared_dead(spark):
    df = spark.createDataFrame([("@a{x}\n\n@comment{BibDesk Static Groups{\n}}",), ("@a{x}\n",)], "t string")
    out = [r.s for r in df.select(sinks.saved(F.col("t"), F.lit("@b{y}")).alias("s")).collect()]
    assert out == ["@a{x}\n\n@b{y}\n\n@comment{BibDesk Static Groups{\n}}", "@a{x}\n\n@b{y}\n\n"]
    r = spark.createDataFrame([(1, "s", "```\n@a{k, t = {x}} tail", ["pages"]), (2, "s", "NONE", []), (3, "s", "@a{k, {", [])], "id int, source string, reply string, missing array<string>")
    p = sinks.prepared(r)
    rows = {x.id: x for x in p.collect()}
    assert rows[1].status == "ok" and "INCOMPLETE: missing pages" in rows[1].text and rows[2].error == "no entry" and rows[3].error.startswith("unclosed")
    assert sinks.dead_letters(p).count() == 2


def test_providers(spark):
    req = spark.createDataFrame([("1", "ocr", "a"), ("2", "ocr", "b")], "id string, kind string, request string")
    rec = providers.keyed(req).filter("id = '1'").select("key", F.lit("text").alias("answer"))
    assert {r.id: (r.answer, r.error) for r in providers.recorded(req, rec).collect()} == {"1": ("text", None), "2": (None, "no recording")}
    got = {r.id: (r.answer, r.error) for r in providers.answer_with(req, lambda k, q: {"a": "A"}[q]).collect()}
    assert got["1"] == ("A", None) and got["2"][1].startswith("KeyError")


def test_stream_takes_each_content_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n, t in (("a", BIB), ("b", BIB), ("c", BIB.replace("{A}", "{C}"))):
        (src / f"{n}.bib").write_text(t)
    q = ingest.start_ingest(ingest.library_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("key = 'title'").count() == 4
    (src / "d.bib").write_text(BIB.replace("{A}", "{D}"))
    q = ingest.start_ingest(ingest.library_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("key = 'title'").count() == 6


def test_stream_takes_files_of_any_age_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def run(name, text, days):
        (src / name).write_text(text)
        at = time.time() - days * 86400
        os.utime(src / name, (at, at))
        ingest.start_ingest(ingest.library_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).filter("key = 'title'").count()

    # a newer file first, then an older one that is new, then the first one's content again, days apart
    assert [run("a.bib", BIB, 10), run("b.bib", BIB.replace("{A}", "{B}"), 30), run("c.bib", BIB, 0)] == [2, 4, 4]


def test_event_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert ingest.event_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_small_scalars(spark):
    one = spark.range(1)

    def get(c):
        return one.select(c.alias("v")).first().v

    assert get(text.ocr_choice(F.lit("a"), F.lit("b c"), F.lit("b c d"))) == "forced"
    assert get(text.ocr_choice(F.lit("w " * 100), F.lit(""), F.lit(""))) == "plain"
    assert get(text.joined_title(F.lit("A"), F.lit(""))) == "A" and get(text.joined_title(F.lit("A"), F.lit("b"))) == "A: b"
    assert get(text.without_tags(F.lit("<p>a <i>b</i></p>"))) == "a b"
    assert abs(get(text.similarity(F.lit("A Study of Rivers"), F.lit("A study of river"))) - 32 / 33) < 1e-9
    assert get(text.similarity(F.lit("A"), F.lit("A very long other title"))) is None
    assert get(web.outcome(F.lit(403), F.lit(True), F.lit(False))) == "challenge" and get(web.outcome(F.lit(200), F.lit(False), F.lit(False))) == "ok"
    h = F.create_map(F.lit("server"), F.lit("Cloudflare"))
    assert get(web.is_challenge(F.lit(503), h, F.lit(""))) and not get(web.is_challenge(F.lit(404), h, F.lit("")))
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("yes").alias("text")))
    assert get(providers.text_of_blocks(blocks)) == "yes"


def test_lookup_prefers_doi(spark):
    e = spark.createDataFrame([(1, "article", {"title": "A Study", "doi": "10.5555/B"}), (2, "book", {"title": "a study!", "author": "Doe, J.", "date": "1950"}), (3, "book", {"title": "A Study", "author": "Roe, R."}), (4, "book", {})], "id int, etype string, f map<string,string>")
    w = spark.createDataFrame([("10.5555/a", "A study", [("Doe", "Jane")], 1951, {"volume": "1", "publisher": "P"}), ("10.5555/b", "Other", [("Poe", "A")], 1900, {"volume": "2", "publisher": "Q"})], "doi string, title string, author array<struct<family:string,given:string>>, year int, fields map<string,string>")
    looked = resolve.lookup(e, w)
    assert {r.id: r.match_method for r in looked.collect()} == {1: "doi", 2: "title", 3: None, 4: None}
    assert {(r.id, r.key, r.value, r.source) for r in resolve.filled(looked).collect()} == {(1, "volume", "2", "catalogue/doi"), (2, "volume", "1", "catalogue/title"), (2, "publisher", "P", "catalogue/title")}


def test_shuffle_files_of_what_is_written_are_let_go(spark):
    # they stayed until the driver happened to collect its garbage, and counted as disk of all later steps
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+", disk.getAllFiles().mkString(" ")))
    before = shuffles()
    written = cut(spark.range(1000).repartition(7, "id"))
    cut(spark.range(10))
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert written.count() == 1000
