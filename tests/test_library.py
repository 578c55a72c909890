"""Scanner, audit, normaliser, gates and patches on small hostile fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.functions import latex
from folioframe.operators import audit, gates, normalize, patch, render, scan

DOC = r'''@comment{Static {Groups}}
stray text
@article{Doe2020,
	Author = {Doe, Jane},
	Date = "2020, or so",
	title = {A {B: C} study: With \{ half},
	Volume = hup,
	note = {x},
	NOTE = {y}}
@misc{nofields}
@book{Open, title = {never closed'''


def test_scan_fields():
    rows = scan.scan(DOC)
    assert [r["kind"] for r in rows] == ["opaque", "opaque", "entry", "opaque", "entry", "opaque", "opaque"]
    e = rows[2]
    assert (e["etype"], e["citekey"]) == ("article", "Doe2020")
    assert [(f["key"], f["value"]) for f in e["fields"]] == [
        ("author", "Doe, Jane"), ("date", "2020, or so"), ("title", r"A {B: C} study: With \{ half"), ("volume", "hup"), ("note", "x"), ("note", "y"),
    ]
    for f in e["fields"]:
        assert DOC[f["vstart"] : f["vend"]] == f["value"]
    assert rows[4]["citekey"] == "nofields" and not rows[4]["fields"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["@article{a,", "@x{", "}", "{", "\n", '"', ",", "t = {v}", "\\}", "word ", "@", "ü"]), max_size=30).map("".join))
def test_spans_tile(text):
    pos = 0
    for r in scan.scan(text):
        assert r["start"] == pos and r["end"] > pos
        pos = r["end"]
    assert pos == len(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab:?{}\\ .A", max_size=30))
def test_mask_keeps_length(value):
    assert len(latex.depth_mask(value)) == len(value)


def _parsed(spark, *docs):
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(docs)], "doc string, text string")
    return df, scan.scan_documents(df)


def _entry(fields: str, etype: str = "article") -> str:
    return f"@{etype}{{k,\n\tdate-added = {{x}},\n\tdate-modified = {{x}},\n\tdate = {{2020}},\n\t{fields}}}\n"


# rule, fields that fire it, fields that don't, type
CASES = [
    ("unsplit-title", "title = {A: b}", "title = {A:b}", "article"),
    ("unsplit-title", "title = {A: b}", "title = {{A: b}}", "article"),
    ("unsplit-title-REVIEW(exempt?)", "title = {A: b}", "title = {A}", "review"),
    ("unsplit-booktitle", "booktitle = {A: b}", "booktitle = {A: b},\n\tbooksubtitle = {c}", "incollection"),
    ("shorttitle-redundant", "title = {A},\n\tshorttitle = {B}", "title = {A: b},\n\tshorttitle = {A}", "article"),
    ("shorttitle-equals-title", "title = {A b?},\n\tshorttitle = {a {b}}", "title = {A b},\n\tshorttitle = {A}", "article"),
    ("shorttitle-mismatch", "title = {A: b},\n\tshorttitle = {C}", "title = {A: b},\n\tshorttitle = {A}", "article"),
    ("shorttitle-missing", "title = {one two three four {five: six} seven eight}", "title = {one two three}", "article"),
    ("shorttitle-missing-REVIEW", "title = {A: b}", "title = {A b}", "review"),
    ("range-punctuation", "pages = {1--2}", "pages = {1-2}", "article"),
    ("forbidden-field", "isbn = {1}", "doi = {1}", "book"),
    ("keywords-present(DECISION)", "keywords = {a}", "note = {a}", "book"),
    ("url-misplaced", "url = {u},\n\tdoi = {d}", "url = {u}", "article"),
    ("online-without-url", "note = {a}", "url = {u}", "online"),
    ("range-in-count-field", "volumes = {1-5}", "volumes = {5}", "book"),
    ("range-in-numbering-field", "volume = {1-5}", "volume = {1-5},\n\tpages = {1}", "book"),
    ("number-range(double-issue?)", "number = {1-2}", "number = {1}", "article"),
    ("volume-range-REVIEW", "volume = {1-2}", "volume = {1}", "article"),
    ("numeric-issuetitle(rotation?)", "issuetitle = {49}", "issuetitle = {The 49}", "article"),
    ("doubled-text-in-title", "title = {a b c d e a b c d e}", "title = {a b c d a b c d}", "article"),
    ("series-carries-division", "series = {Works, Bd. 4}", "series = {Works on Method}", "book"),
    ("number-duplicated-in-series", "series = {Works 4},\n\tnumber = {4}", "series = {Works},\n\tnumber = {4}", "book"),
    ("field-name-casing", "Note = {a}", "note = {a}", "book"),
    ("foreign-text-in-title(langid?)", r"title = {\foreignlanguage{french}{Un}}", r"title = {\foreignlanguage{french}{Un}},	langid = {french}", "book"),
    ("non-ascii-no-langid", "title = {Über Töne}", "title = {The Töne of the West}", "book"),
    ("ligature-artefact", "note = {eﬃcient}", "abstract = {eﬃcient}", "book"),
    ("unbalanced-delimiter", "note = {(a}", "note = {(a)}", "book"),
    ("accent-macro", r"note = {caf\'{e}}", "note = {café}", "book"),
    ("accent-macro-IMPOSSIBLE", r'note = {x\"{l}}', r'note = {x\"{o}}', "book"),
    ("macro-missing-argument", r"note = {\foreignlanguage{german} x}", r"note = {\foreignlanguage{german}{x}}", "book"),
    ("undefined-macro", r"note = {\reviewof{X}}", r"note = {\bibstring{reviewof}}", "book"),
    ("raw-quotes-in-title", "title = {A 'b' c}", "title = {Bach's b}", "book"),
]


def test_rules_fire_and_stay_silent(spark):
    docs = [_entry(f, t) for _, f, _, t in CASES] + [_entry(n, t) for _, _, n, t in CASES]
    _, s = _parsed(spark, *docs)
    got = {(r.doc, r.rule) for r in audit.findings(scan.entries(s)).select("doc", "rule").collect()}
    n = len(CASES)
    missed = [c[0] for i, c in enumerate(CASES) if (f"d{i}", c[0]) not in got]
    false = [(c[0], c[2]) for i, c in enumerate(CASES) if (f"d{i + n}", c[0]) in got]
    assert not missed and not false


def test_undated_and_stamps(spark):
    _, s = _parsed(spark, "@misc{k, title = {a}}\n")
    got = {r.rule for r in audit.findings(scan.entries(s)).collect()}
    assert {"no-date", "undated-no-urldate", "missing-stamps"} <= got


REWRITES = [
    ("title = {A study: Of 3-7 things}", "title = {A study}", "subtitle = {Of 3--7 things}"),
    ("Title = {Why not? A Debate}", "Title = {Why not?}", "Subtitle = {A Debate}"),
    ("pages = {1 – 9}", "pages = {1-9}", ""),
    ("urldate = {2020--2021}", "urldate = {2020/2021}", ""),
    ("number = {3-5}", "number = {3--5}", ""),
    ("isbn = {1},\n\tissn = {2}", "date = {2020}", ""),
    ("url = {http://u},\n\tdoi = {d},\n\turldate = {2020},\n\tbdsk-url-1 = {http://u}", "doi = {d}", ""),
]


def test_rewrites_gates_and_idempotence(spark):
    docs, before = _parsed(spark, *[_entry(r[0]) for r in REWRITES])
    edits = normalize.edits_of(normalize.plan(scan.entries(before)))
    after = render.apply_edits(docs, edits)
    assert after.filter("overlap").count() == 0
    text = {r.doc: r.text for r in after.collect()}
    for i, (_, a, b) in enumerate(REWRITES):
        assert a in text[f"d{i}"] and b in text[f"d{i}"]
    assert "isbn" not in text["d5"] and "issn" not in text["d5"] and "\turl =" not in text["d6"] and "urldate" not in text["d6"]
    out = after.select("doc", "text")
    again = scan.scan_documents(out)
    assert normalize.edits_of(normalize.plan(scan.entries(again))).count() == 0
    for gate in (gates.count_changed(before, again), gates.citekey_order(before, again), gates.protected_changed(before, again), gates.newly_swallowed(before, again), gates.doubled_commas(out, again), gates.length_law(docs, out, edits), gates.opaque_changed(docs, before, out, again)):
        assert gate.count() == 0


def test_gates_have_teeth(spark):
    a, b = _entry("title = {x}") + _entry("title = {y}").replace("{k,", "{l,"), _entry("title = {x}").replace("date-added = {x}", "date-added = {z}")
    d1, s1 = _parsed(spark, "@comment{c}\n" + a)
    d2, s2 = _parsed(spark, b.replace("title = {x}", "title = {x\n\tnote = {y},,\n\t, z = {}}"))
    none = spark.createDataFrame([], "doc string, start int, end int, text string")
    assert gates.count_changed(s1, s2).count() and gates.citekey_order(s1, s2).count() and gates.protected_changed(s1, s2).count()
    assert gates.opaque_changed(d1, s1, d2, s2).count() and gates.length_law(d1, d2, none).count()
    assert gates.newly_swallowed(s1, s2).count()
    d3, s3 = _parsed(spark, "@misc{k, a = {1},, b = {2}}")
    assert gates.doubled_commas(d3, s3).count() == 1
    files = spark.createDataFrame([("ok", b"a\n"), ("cr", b"a\r\n"), ("bad", b"\xff")], "doc string, content binary")
    assert {r.doc for r in gates.bad_bytes(files).collect()} == {"cr", "bad"}


def test_overlapping_edits_leave_the_document(spark):
    docs = spark.createDataFrame([("d", "abcdef")], "doc string, text string")
    edits = spark.createDataFrame([("d", 0, 3, "x"), ("d", 2, 4, "y")], "doc string, start int, end int, text string")
    r = render.apply_edits(docs, edits).first()
    assert r.overlap and r.text == "abcdef"


def test_patch_statuses(spark):
    ops = spark.createDataFrame(
        [(1, "set", "k", "Volume", "5", ""), (2, "set", "k", "pages", "5", ""), (3, "add", "k", "volume", "5", ""), (4, "add", "k", "number", "2", ""), (5, "delete", "k", "isbn", None, ""),
         (6, "delete", "k", "date-added", None, ""), (7, "retype", "k", None, "review", ""), (8, "dropentry", "none", None, None, ""), (9, "jump", "k", None, None, ""), (10, "noop", "k", None, None, "")],
        "op_ord int, op string, key string, field string, value string, why string",
    )
    _, s = _parsed(spark, _entry("Volume = {1}"))
    c = patch.checked(ops, s.filter("kind = 'entry'").select("citekey"), scan.field_rows(s))
    assert {r.op_ord: r.status for r in c.collect()} == {1: "ok", 2: "problem", 3: "problem", 4: "ok", 5: "note", 6: "problem", 7: "ok", 8: "problem", 9: "problem", 10: "ok"}
    assert patch.blocked(c)
    p = patch.patched(scan.field_rows(s).select("citekey", "etype", "key", "name", "value"), c)
    got = {(r.etype, r.key): r.value for r in p.collect()}
    assert got["review", "volume"] == "5" and got["review", "number"] == "2"


@pytest.mark.parametrize("keys,new,expected", [(["a", "c"], "b", "a"), (["b"], "a", None), (["a", "b"], "z", "b"), ([], "a", None)])
def test_anchor(spark, keys, new, expected):
    df = spark.createDataFrame([(keys, new)], "ks array<string>, n string")
    assert df.select(patch.anchor(F.col("ks"), F.col("n"))).first()[0] == expected


def test_markdown_bisect_template(spark):
    from folioframe.functions import markdown
    from folioframe.operators import bisect

    one = spark.range(1)
    tex = r"junk START \section{One} A \emph{b} \& c--d % note" + "\nnext \\cite[3]{key}.\n\n\\begin{itemize}\\item x\\item y\\end{itemize} STOP junk"
    assert one.select(markdown.to_markdown(F.lit(tex), "START", "STOP").alias("v")).first().v == "# One\n\nA *b* & c–d next [key].\n\n- x\n- y"
    assert one.select(markdown.without_command(F.lit(r"a \x{b {c}} d"), ["x"], True).alias("v")).first().v == "a b {c} d"
    assert one.select(markdown.cedilla(F.lit(r"gar\c{c}on")).alias("v")).first().v == "garçon"
    df = spark.range(37).select(F.col("id").alias("pos"))
    assert bisect.offending(df, lambda d: d.filter("pos = 23").count() > 0) == 23
    assert bisect.offending(df, lambda d: False) is None and bisect.offending(df.limit(0), lambda d: True) is None
    _, s = _parsed(spark, _entry("title = {A}"))
    picks = spark.createDataFrame([("k", 1, "plain"), ("none", 2, "gone")], "citekey string, ord int, why string")
    text, missing = render.template(scan.entries(s), picks, ["date-added", "date-modified"])
    assert text.first().text == "% --- plain\n@article{k,\n\tDate = {2020},\n\tTitle = {A}}\n" and missing.first().citekey == "none"
