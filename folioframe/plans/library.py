"""Queries over libraries: render, scan, audit, normalise, patch and their gates.

Every query renders the whole library to text, scans the text, and works on what the scanner found;
the oracle computes the same from the tables and never sees the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import audit, gates, normalize, patch, render, scan
from folioframe.plans.lib_sql import DUCK, lib_documents, lib_parsed, lib_scanned
from folioframe.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- scanner


@query("p_entry_types", DUCK + "SELECT etype, count(*) AS n FROM m GROUP BY etype")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return lib_scanned(spark, sf).filter("kind = 'entry'").groupBy("etype").agg(F.count("*").alias("n"))


@query("p_field_count", DUCK + "SELECT m.citekey, count(*) AS n_fields FROM m JOIN lib USING (entry_id) GROUP BY m.citekey")
def _(spark, sf):
    return lib_scanned(spark, sf).filter("kind = 'entry'").groupBy("citekey").agg(F.sum(F.size("fields")).cast("bigint").alias("n_fields"))


@query("p_field_values", DUCK + "SELECT m.citekey, key, name, value, count(*) AS n FROM m JOIN lib USING (entry_id) GROUP BY ALL")
def _(spark, sf):
    return scan.field_rows(lib_scanned(spark, sf)).groupBy("citekey", "key", "name", "value").agg(F.count("*").alias("n"))


@query("p_field_map_lookup", DUCK + "SELECT citekey, f_title AS title, f_doi AS doi, f_volume AS volume, count(*) AS n FROM m GROUP BY ALL")
def _(spark, sf):
    f = F.col("f")
    return lib_parsed(spark, sf).groupBy("citekey", f["title"].alias("title"), f["doi"].alias("doi"), f["volume"].alias("volume")).agg(F.count("*").alias("n"))


@query("p_tiling_check", "SELECT path || '#' || CAST(entry_ord // 500 AS VARCHAR) AS doc, true AS ok FROM bib_entry GROUP BY 1")
def _(spark, sf):
    docs = lib_documents(spark, sf)
    return scan.tiles(docs, scan.scan_documents(docs))


#: Where the text puts every entry and what stands between: three characters before a field, five around its value, two line feeds between entries.
_OFFSETS = (
    "t AS (SELECT path || '#' || CAST(entry_ord // 500 AS VARCHAR) AS doc, entry_ord, citekey, length(etype) + length(citekey) + 3 + f.n AS len FROM m JOIN (SELECT entry_id, sum(length(name) + length(value) + 8) AS n FROM lib GROUP BY 1) f USING (entry_id)), "
    "p AS (SELECT doc, citekey, len, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc) AS k, sum(len + 2) OVER w - len - 2 AS s FROM t WINDOW w AS (PARTITION BY doc ORDER BY entry_ord)) "
)


@query(
    "p_entry_offsets",
    DUCK.rstrip() + ", " + _OFFSETS + "SELECT doc, CAST(2 * i AS INTEGER) AS ord, 'entry' AS kind, citekey, CAST(s AS INTEGER) AS start, CAST(s + len AS INTEGER) AS \"end\" FROM p "
    "UNION ALL SELECT doc, CAST(2 * i + 1 AS INTEGER), 'opaque', NULL, CAST(s + len AS INTEGER), CAST(s + len + CASE WHEN i = k - 1 THEN 1 ELSE 2 END AS INTEGER) FROM p",
)
def _(spark, sf):
    # offsets are those in the whole document
    return scan.scan_documents(lib_documents(spark, sf)).select("doc", "ord", "kind", "citekey", "start", "end")


# ---- audit


_MASK = r"regexp_replace(regexp_replace(regexp_replace({0}, '\\.', '##', 'g'), '\{{[^{{}}]*\}}', '#', 'g'), '\{{[^{{}}]*\}}', '#', 'g')"
_COLONS = "((length(" + _MASK + ") - length(replace(" + _MASK + ", ': ', ''))) // 2)"


def _c(col: str) -> str:
    return _COLONS.format(col)


_EARNED = "(etype = 'online' OR NOT (f_date IS NOT NULL OR f_year IS NOT NULL) OR f_doi IS NULL)"
_WHOLE = r"'^\s*\d+\s*(--|[-\x{2010}-\x{2015}])\s*\d+\s*$'"
_NUM = r"TRY_CAST(regexp_extract({0}, '^\s*(\d+)\s*(?:--|[-\x{{2010}}-\x{{2015}}])\s*(\d+)\s*$', {1}) AS BIGINT)"
_WIDE = lambda c: f"({_NUM.format(c, 2)} - {_NUM.format(c, 1)} >= 3 AND f_pages IS NULL)"
_LIGATURE = r"'[\x{FB00}-\x{FB06}\x{0132}\x{0133}]'"
_FIELD_SKIP = "key NOT LIKE 'bdsk-%' AND key NOT LIKE 'local-url%' AND key NOT LIKE 'remote-url%' AND key NOT LIKE 'devonthink%' AND key NOT LIKE 'abstract%'"
_BAD_RANGE = r"'--|[\x{2010}-\x{2015}]'"
#: rule -> SQL giving one row per finding.
RULE_SQL = {
    "unsplit-title": f"SELECT 1 FROM m WHERE {_c('f_title')} > 0 AND f_subtitle IS NULL AND etype <> 'review'",
    "unsplit-title-REVIEW(exempt?)": f"SELECT 1 FROM m WHERE {_c('f_title')} > 0 AND f_subtitle IS NULL AND etype = 'review'",
    "unsplit-booktitle": f"SELECT 1 FROM m WHERE {_c('f_booktitle')} > 0 AND f_booksubtitle IS NULL AND etype <> 'review'",
    "range-punctuation": " UNION ALL ".join(f"SELECT 1 FROM m WHERE regexp_matches(f_{k}, {_BAD_RANGE})" for k in ("pages", "date", "urldate", "volumes")),
    "forbidden-field": "SELECT 1 FROM lib WHERE key IN ('isbn', 'issn')",
    "keywords-present(DECISION)": "SELECT 1 FROM m WHERE f_keywords IS NOT NULL",
    "url-misplaced": f"SELECT 1 FROM m WHERE f_url IS NOT NULL AND NOT {_EARNED}",
    "online-without-url": "SELECT 1 FROM m WHERE etype = 'online' AND f_url IS NULL",
    "undated-no-urldate": "SELECT 1 FROM m WHERE f_date IS NULL AND f_urldate IS NULL",
    "range-in-count-field": f"SELECT 1 FROM m WHERE regexp_matches(f_volumes, {_WHOLE})",
    "range-in-numbering-field": " UNION ALL ".join(f"SELECT 1 FROM m WHERE regexp_matches(f_{k}, {_WHOLE}) AND {_WIDE('f_' + k)}" for k in ("volume", "number")),
    "number-range(double-issue?)": f"SELECT 1 FROM m WHERE regexp_matches(f_number, {_WHOLE}) AND NOT coalesce({_WIDE('f_number')}, false)",
    "volume-range-REVIEW": f"SELECT 1 FROM m WHERE regexp_matches(f_volume, {_WHOLE}) AND NOT coalesce({_WIDE('f_volume')}, false)",
    "numeric-issuetitle(rotation?)": r"SELECT 1 FROM m WHERE regexp_matches(f_issuetitle, '^\s*\d+\s*$')",
    "series-carries-division": r"SELECT 1 FROM m WHERE regexp_matches(f_series, '\bBd\.')",
    "number-duplicated-in-series": "SELECT 1 FROM m WHERE trim(f_number) <> '' AND contains(f_series, trim(f_number))",
    "missing-stamps": "SELECT 1 FROM m WHERE NOT EXISTS (SELECT 1 FROM lib WHERE lib.entry_id = m.entry_id AND key = 'date-added') OR NOT EXISTS (SELECT 1 FROM lib WHERE lib.entry_id = m.entry_id AND key = 'date-modified')",
    "field-name-casing": "SELECT DISTINCT entry_id FROM lib WHERE name <> key",
    "ligature-artefact": f"SELECT 1 FROM lib WHERE regexp_matches(value, {_LIGATURE}) AND {_FIELD_SKIP} AND key <> 'keywords'",
    "unbalanced-delimiter": " UNION ALL ".join(
        f"SELECT 1 FROM lib WHERE length(replace(value, '{o}', '')) <> length(replace(value, '{c}', '')) AND {_FIELD_SKIP} AND key NOT IN ('keywords', 'annote')" for o, c in ("()", "[]")
    ),
    "accent-macro": f"SELECT 1 FROM lib WHERE contains(value, chr(92) || '\"{{i}}') AND {_FIELD_SKIP}",
    "macro-missing-argument": f"SELECT 1 FROM lib WHERE contains(value, 'foreignlanguage{{french}} ') AND {_FIELD_SKIP}",
    "undefined-macro": f"SELECT 1 FROM lib WHERE contains(value, chr(92) || 'reviewof{{') AND {_FIELD_SKIP}",
    "raw-quotes-in-title": r"""SELECT 1 FROM m WHERE regexp_matches(f_title, '(^|[^A-Za-z])[''"]') AND NOT contains(f_title, 'mkbibquote')""",
    "no-date": "SELECT 1 FROM m WHERE f_date IS NULL AND f_year IS NULL",
}
_ALL = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n FROM ({s}) q{i}" for i, (r, s) in enumerate(RULE_SQL.items()))


@query("r_findings_by_rule", DUCK + f"SELECT rule, n FROM ({_ALL}) z WHERE n > 0")
def _(spark, sf):
    return audit.by_rule(audit.findings(lib_parsed(spark, sf), list(RULE_SQL)))


@query("r_findings_all")
def _(spark, sf):
    return audit.findings(lib_parsed(spark, sf))


@query("r_rule_samples")
def _(spark, sf):
    return audit.samples(audit.findings(lib_parsed(spark, sf)))


@query("r_url_misplaced_detail", DUCK + f"SELECT citekey, etype || ', has doi' AS detail, count(*) AS n FROM m WHERE f_url IS NOT NULL AND NOT {_EARNED} GROUP BY ALL")
def _(spark, sf):
    return audit.findings(lib_parsed(spark, sf), ["url-misplaced"]).groupBy("citekey", "detail").agg(F.count("*").alias("n"))


@query("tx_top_level_colons", DUCK + f"SELECT citekey, {_c('f_title')} AS colons, count(*) AS n FROM m WHERE f_title IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    from folioframe.functions import latex

    e = audit.with_profiles(lib_parsed(spark, sf)).filter(F.col("f")["title"].isNotNull())
    return e.groupBy("citekey", latex.top_colons(F.col("p_title")).cast("bigint").alias("colons")).agg(F.count("*").alias("n"))


@query("tx_terminal_marks", DUCK + "SELECT citekey, length(regexp_replace(" + _MASK.format("f_title") + ", '[^?!]', '', 'g')) AS marks, count(*) AS n FROM m WHERE f_title IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    from folioframe.functions import latex

    e = audit.with_profiles(lib_parsed(spark, sf)).filter(F.col("f")["title"].isNotNull())
    return e.groupBy("citekey", latex.terminal_marks(F.col("p_title")).cast("bigint").alias("marks")).agg(F.count("*").alias("n"))


@query("f_url_earned", DUCK + f"SELECT citekey, {_EARNED} AS earned, count(*) AS n FROM m GROUP BY ALL")
def _(spark, sf):
    return lib_parsed(spark, sf).groupBy("citekey", audit.url_is_earned().alias("earned")).agg(F.count("*").alias("n"))


@query("f_shorttitle_verdict")
def _(spark, sf):
    e = audit.with_profiles(lib_parsed(spark, sf)).filter(F.col("f")["title"].isNotNull() & F.col("f")["shorttitle"].isNotNull())
    return e.select("citekey", audit._verdict().alias("verdict"))


# ---- completeness

_REQ = "CASE WHEN etype IN ('article', 'review') THEN ['volume', 'pages'] WHEN etype = 'inproceedings' THEN ['pages'] ELSE [] END"


def _missing(rules: dict[str, list[str]]):
    out = F.expr("cast(array() as array<string>)")
    for t, keys in rules.items():
        each = F.array_compact(F.array(*(F.when(F.coalesce(F.col("f")[k], F.lit("")) == "", k) for k in keys)))
        out = F.when(F.col("etype") == t, each).otherwise(out)
    return out


@query(
    "f_missing_required",
    DUCK + f"SELECT citekey, array_to_string(list_filter({_REQ}, lambda k: coalesce(CASE k WHEN 'volume' THEN f_volume ELSE f_pages END, '') = ''), ',') AS missing, count(*) AS n FROM m GROUP BY ALL",
)
def _(spark, sf):
    from folioframe.schema import REQUIRED

    return lib_parsed(spark, sf).groupBy("citekey", F.array_join(_missing(REQUIRED), ",").alias("missing")).agg(F.count("*").alias("n"))


@query("f_missing_desired", DUCK + "SELECT citekey, CASE WHEN etype IN ('article', 'review', 'inproceedings') AND coalesce(f_number, '') = '' THEN 'number' WHEN etype = 'incollection' THEN 'chapter' || CASE WHEN coalesce(f_pages, '') = '' THEN ',pages' ELSE '' END ELSE '' END AS missing, count(*) AS n FROM m GROUP BY ALL")
def _(spark, sf):
    from folioframe.schema import DESIRED

    return lib_parsed(spark, sf).groupBy("citekey", F.array_join(_missing(DESIRED), ",").alias("missing")).agg(F.count("*").alias("n"))


@query(
    "f_forbidden_strip",
    DUCK + "SELECT m.citekey, key, count(*) AS n FROM m JOIN lib USING (entry_id) WHERE key NOT IN ('issn', 'isbn', 'keywords', 'reference', 'devonthink') "
    "AND NOT (key IN ('url', 'urldate') AND etype <> 'online' AND f_date IS NOT NULL) GROUP BY ALL",
)
def _(spark, sf):
    from folioframe.schema import EXTRACTION_FORBIDDEN

    online = (F.col("etype") == "online") | (F.col("etype").isin("reference", "inreference") & (F.lower(F.col("f")["entrysubtype"]) == "online"))
    keep = F.coalesce(online, F.lit(False)) | F.col("f")["date"].isNull()
    e = lib_parsed(spark, sf).select("citekey", keep.alias("keep_url"), F.explode("fields.key").alias("key"))
    return e.filter(~F.col("key").isin(*EXTRACTION_FORBIDDEN) & (~F.col("key").isin("url", "urldate") | F.col("keep_url"))).groupBy("citekey", "key").agg(F.count("*").alias("n"))


# ---- normaliser


def _planned(spark, sf):
    return normalize.plan(lib_parsed(spark, sf))


_PAGES = r"regexp_replace(f_pages, '\s*(--|[\x{2010}-\x{2015}])\s*', '-', 'g')"


@query("n_pages", DUCK + f"SELECT citekey, f_pages AS before, {_PAGES} AS after, count(*) AS n FROM m WHERE {_PAGES} <> f_pages GROUP BY ALL")
def _(spark, sf):
    e = normalize.edits_of(_planned(spark, sf)).filter("rule = 'range-punctuation'")
    return e.groupBy("citekey", "before", "after").agg(F.count("*").alias("n"))


_DATE = r"regexp_replace({0}, '\s*(--|[\x{{2010}}-\x{{2015}}])\s*', '/', 'g')"


@query("n_date_solidus", DUCK + f"SELECT citekey, key, before, after, count(*) AS n FROM (SELECT citekey, 'date' AS key, f_date AS before, {_DATE.format('f_date')} AS after FROM m UNION ALL SELECT citekey, 'urldate', f_urldate, {_DATE.format('f_urldate')} FROM m) WHERE before <> after GROUP BY ALL")
def _(spark, sf):
    e = normalize.edits_of(_planned(spark, sf)).filter("rule = 'date-range-solidus'")
    return e.groupBy("citekey", "key", "before", "after").agg(F.count("*").alias("n"))


@query("n_drops", DUCK + "SELECT 'drop-' || key AS rule, count(*) AS n FROM lib WHERE key IN ('isbn', 'issn') GROUP BY ALL")
def _(spark, sf):
    return normalize.edits_of(_planned(spark, sf)).filter("rule IN ('drop-isbn', 'drop-issn')").groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "n_split_titles",
    DUCK + f"SELECT citekey, f_title AS before, count(*) AS n FROM m WHERE f_subtitle IS NULL AND etype <> 'review' AND {_c('f_title')} = 1 "
    f"AND trim(substr({_MASK.format('f_title')}, 1, instr({_MASK.format('f_title')}, ': ') - 1)) <> '' AND trim(split_part({_MASK.format('f_title')}, ': ', 2)) <> '' GROUP BY ALL",
)
def _(spark, sf):
    e = normalize.edits_of(_planned(spark, sf)).filter("rule = 'split-title' AND key = 'title'").filter(F.regexp_count("before", F.lit(": ")) > 0)
    return e.groupBy("citekey", "before").agg(F.count("*").alias("n"))


@query("n_edits_by_rule")
def _(spark, sf):
    return normalize.counts_by_rule(normalize.edits_of(_planned(spark, sf)))


@query("n_reports_by_label")
def _(spark, sf):
    return normalize.reports_of(_planned(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


def _rewritten(spark, sf):
    # the text, its scan and its edits are each used several times
    docs = cut(lib_documents(spark, sf))
    scanned = cut(scan.scan_documents(docs))
    edits = normalize.edits_of(normalize.plan(scan.entries(scanned)))
    edits = cut(edits)
    return docs, scanned, edits, cut(render.apply_edits(docs, edits))


@query("n_length_law", "SELECT path || '#' || CAST(entry_ord // 500 AS VARCHAR) AS doc, true AS ok FROM bib_entry GROUP BY 1")
def _(spark, sf):
    docs, _s, edits, after = _rewritten(spark, sf)
    bad = gates.length_law(docs, after, edits).select("doc", F.lit(False).alias("ok"))
    return docs.select("doc").join(bad, "doc", "left").select("doc", F.coalesce("ok", F.lit(True)).alias("ok"))


@query("n_idempotent", "SELECT CAST(0 AS BIGINT) AS n_edits")
def _(spark, sf):
    after = _rewritten(spark, sf)[3].select("doc", "text")
    again = normalize.edits_of(normalize.plan(scan.entries(scan.scan_documents(after))))
    return again.agg(F.count("*").alias("n_edits"))


@query("g_protected_diff", "SELECT CAST(0 AS BIGINT) AS n")
def _(spark, sf):
    _d, before, _e, after = _rewritten(spark, sf)
    return gates.protected_changed(before, scan.scan_documents(after)).agg(F.count("*").alias("n"))


@query("g_citekey_order", "SELECT CAST(0 AS BIGINT) AS n")
def _(spark, sf):
    _d, before, _e, after = _rewritten(spark, sf)
    return gates.citekey_order(before, scan.scan_documents(after)).agg(F.count("*").alias("n"))


@query("g_swallowed", "SELECT CAST(0 AS BIGINT) AS n")
def _(spark, sf):
    _d, before, _e, after = _rewritten(spark, sf)
    return gates.newly_swallowed(before, scan.scan_documents(after)).agg(F.count("*").alias("n"))


# ---- patch list

_OPS = (
    "SELECT entry_id AS op_ord, CASE entry_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'add' WHEN 2 THEN 'delete' WHEN 3 THEN 'retype' ELSE 'dropentry' END AS op, "
    "CASE WHEN entry_id % 50 = 7 THEN concat('none', citekey) ELSE citekey END AS key, CASE entry_id % 4 WHEN 0 THEN 'Volume' WHEN 1 THEN 'edition' WHEN 2 THEN 'keywords' ELSE 'number' END AS field, "
    "CASE WHEN entry_id % 5 = 3 THEN 'misc' ELSE '7' END AS value, 'example' AS why FROM {bib_entry}"
)
_CHECK = (
    "ops AS (" + _OPS.format(bib_entry="bib_entry") + "), chk AS (SELECT o.*, lower(o.field) AS fkey, "
    "EXISTS (SELECT 1 FROM bib_entry e WHERE e.citekey = o.key) AS known, EXISTS (SELECT 1 FROM m JOIN lib USING (entry_id) WHERE m.citekey = o.key AND lib.key = lower(o.field)) AS there FROM ops o), "
    "res AS (SELECT op_ord, op, key, field, value, fkey, CASE WHEN NOT known THEN 'no such entry' WHEN op IN ('set', 'add', 'delete') AND fkey = 'keywords' THEN 'protected field' "
    "WHEN op = 'set' AND NOT there THEN 'no such field' WHEN op = 'add' AND there THEN 'field exists' WHEN op = 'delete' AND NOT there THEN 'already absent' END AS message FROM chk) "
)
_DUCK_OPS = DUCK.rstrip() + ", " + _CHECK


def _ops(spark, sf):
    return spark.sql(_OPS, bib_entry=table(spark, sf, "bib_entry"))


def _checked(spark, sf):
    # written once: the operations meet its entries and its fields
    s = cut(lib_scanned(spark, sf).filter("kind = 'entry'").select("citekey", F.expr("transform(fields, x -> x.key)").alias("keys")))
    return patch.checked(_ops(spark, sf), s.select("citekey"), s.select("citekey", F.explode("keys").alias("key")))


@query("e_problems", _DUCK_OPS + "SELECT op_ord, op, key, CASE WHEN message = 'already absent' THEN 'note' WHEN message IS NOT NULL THEN 'problem' ELSE 'ok' END AS status, message FROM res")
def _(spark, sf):
    return _checked(spark, sf).select("op_ord", "op", "key", "status", "message")


@query(
    "e_patched_fields",
    _DUCK_OPS + ", ok AS (SELECT * FROM res WHERE message IS NULL), rows_ AS (SELECT m.citekey, m.etype, lib.key, lib.value FROM m JOIN lib USING (entry_id)), "
    "s AS (SELECT key AS citekey, fkey, max_by(value, op_ord) AS new FROM ok WHERE op = 'set' GROUP BY ALL), a AS (SELECT key AS citekey, fkey, max_by(value, op_ord) AS new FROM ok WHERE op = 'add' GROUP BY ALL), "
    "d AS (SELECT DISTINCT key AS citekey, fkey FROM ok WHERE op = 'delete'), x AS (SELECT DISTINCT key AS citekey FROM ok WHERE op = 'dropentry'), t AS (SELECT key AS citekey, max_by(value, op_ord) AS new FROM ok WHERE op = 'retype' GROUP BY ALL), "
    "kept AS (SELECT r.citekey, r.etype, r.key, coalesce(s.new, r.value) AS value FROM rows_ r LEFT JOIN s ON s.citekey = r.citekey AND s.fkey = r.key WHERE r.citekey NOT IN (SELECT citekey FROM x) AND NOT EXISTS (SELECT 1 FROM d WHERE d.citekey = r.citekey AND d.fkey = r.key) "
    "UNION ALL SELECT h.citekey, h.etype, a.fkey, a.new FROM a JOIN (SELECT DISTINCT citekey, etype FROM rows_) h USING (citekey) WHERE h.citekey NOT IN (SELECT citekey FROM x)) "
    "SELECT coalesce(t.new, k.etype) AS etype, k.key, k.value, count(*) AS n FROM kept k LEFT JOIN t USING (citekey) GROUP BY ALL",
)
def _(spark, sf):
    s = cut(scan.field_rows(lib_scanned(spark, sf)))
    # problems block a list, so the operations without one are given as a list of their own
    p = patch.applied(s.select("citekey", "etype", "key", "name", "value"), cut(_checked(spark, sf).filter("status <> 'problem'")))
    return p.groupBy("etype", "key", "value").agg(F.count("*").alias("n"))
