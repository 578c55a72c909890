"""Queries over scalars, catalogue look-ups, scoring and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text, web
from folioframe.operators import cost, resolve, score
from folioframe.plans.lib_sql import DUCK, lib_fields
from folioframe.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_SPACE = r"'[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+'"
_W = f"list_filter(string_split_regex(text, {_SPACE}), lambda w: w <> '')"


@query("st_word_count", f"SELECT doc_id, len({_W}) AS n_words FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    return _docs(spark, sf).filter("text IS NOT NULL").select("doc_id", F.size(text.words(F.col("text"))).cast("bigint").alias("n_words"))


def _snap(n: int) -> str:
    head = f"array_to_string(list_slice({_W}, 1, {n}), ' ')"
    return (
        f"SELECT doc_id, CASE WHEN len({_W}) <= {n} THEN trim(text) WHEN regexp_extract({head}, '(?s)^(.*[.!?])(\\s|$)', 1) <> '' THEN regexp_extract({head}, '(?s)^(.*[.!?])(\\s|$)', 1) ELSE {head} END AS head "
        "FROM documents WHERE text IS NOT NULL"
    )


@query("st_snap_head", _snap(40))
def _(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).filter("text IS NOT NULL").select("doc_id", text.head_sentences(t, 40).alias("head"))


_TAIL = f"array_to_string(list_slice({_W}, -40, -1), ' ')"


@query("st_snap_tail", f"SELECT doc_id, CASE WHEN len({_W}) <= 40 THEN trim(text) WHEN regexp_extract({_TAIL}, '(?s)^.*?[.!?]\\s+([A-Z].*)$', 1) <> '' THEN regexp_extract({_TAIL}, '(?s)^.*?[.!?]\\s+([A-Z].*)$', 1) ELSE {_TAIL} END AS tail FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).filter("text IS NOT NULL").select("doc_id", text.tail_sentences(t, 40).alias("tail"))


@query("st_key_pages", "SELECT doc_id, CASE WHEN n <= 0 THEN '' WHEN n <= 5 THEN array_to_string(range(1, n + 1), ',') ELSE array_to_string([1, 2, 3, n - 1, n], ',') END AS pages FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)")
def _(spark, sf):
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(text.key_pages(n), lambda x: x.cast("string")), ",").alias("pages"))


@query("st_page_window")
def _(spark, sf):
    pages = F.split("text", "\n\n")
    return _docs(spark, sf).filter("text IS NOT NULL").select("doc_id", text.page_window(pages).alias("window"))


@query(
    "st_repeated_run",
    "WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL), "
    "g AS (SELECT doc_id, ws, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) AS runs FROM w) "
    "SELECT doc_id, CASE WHEN len(ws) > 5 THEN len(list_distinct(runs)) < len(runs) ELSE false END AS repeated FROM g",
)
def _(spark, sf):
    from folioframe.functions.latex import repeated_run

    return _docs(spark, sf).filter("text IS NOT NULL").select("doc_id", repeated_run(F.col("text")).alias("repeated"))


@query("st_normalised_pages", r"SELECT entry_id, trim(regexp_replace(pages, '\s*[-–—]{1,2}\s*', '-', 'g'), ' ') AS pages FROM bib_entry WHERE pages IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "bib_entry").filter("pages IS NOT NULL").select("entry_id", text.normalised_pages(F.col("pages")).alias("pages"))


_CITE = "concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2, 4)), ', A. B., & Other, C. (', cast(1990 + o_orderkey % 30 AS VARCHAR(4)), '). Order ', o_orderpriority, ' explained. Journal of Orders, ', cast(o_orderkey % 50 AS VARCHAR(4)), '(2), 1-9.')"


def _citations(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.expr(_CITE.replace("VARCHAR(4)", "STRING")).alias("s"))


@query(
    "st_citation_parts",
    "SELECT o_orderkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2, 4)) || ', A. B. and Other, C.' AS authors, CAST(1990 + o_orderkey % 30 AS VARCHAR) AS year, "
    "'Order ' || o_orderpriority || ' explained' AS title, 'Journal of Orders' AS journal FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(spark, sf):
    return _citations(spark, sf).select("o_orderkey", text.citation_parts(F.col("s")).alias("p")).select("o_orderkey", "p.*")


@query("st_author_text", "SELECT o_orderkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2, 4)) || ', A. B., & Other, C' AS author FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    return _citations(spark, sf).select("o_orderkey", text.author_text(F.col("s")).alias("author"))


_REPLY = "CASE o_orderkey % 4 WHEN 0 THEN concat('Fine. UNGROUNDED_FIELDS: NONE') WHEN 1 THEN 'UNGROUNDED_FIELDS: Author, Date' WHEN 2 THEN 'no marker' ELSE 'UNGROUNDED_FIELDS: pages' END"


@query("st_audit_marker", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'author,date' WHEN 2 THEN NULL ELSE 'pages' END AS fields FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(text.ungrounded(F.expr(_REPLY)), ",").alias("fields"))


_BR = "concat(CASE WHEN o_orderkey % 3 = 0 THEN '}' ELSE '' END, repeat('{', CAST(o_orderkey % 4 AS INT)), 'x', repeat('}', CAST(o_orderkey % 3 AS INT)))"


@query(
    "p_brace_validate",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 < o_orderkey % 3 THEN 'unmatched closing brace' WHEN o_orderkey % 4 > o_orderkey % 3 "
    "THEN 'unclosed braces (depth=' || CAST(o_orderkey % 4 - o_orderkey % 3 AS VARCHAR) || ')' ELSE 'ok' END AS verdict FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.braces_verdict(F.expr(_BR)).alias("verdict"))


@query("p_clean_reply", "SELECT p_partkey, '@book{k' || CAST(p_partkey AS VARCHAR) || ',' || chr(10) || '  title = {' || p_name || ' {x}}}' AS entry FROM part")
def _(spark, sf):
    body = F.concat(F.lit("Here it is:\n```bibtex\n@book{k"), F.col("p_partkey").cast("string"), F.lit(",\n  title = {"), F.col("p_name"), F.lit(" {x}}}\n```\nDone {y}."))
    return table(spark, sf, "part").select("p_partkey", text.cleaned_reply(body).alias("entry"))


# ---- addresses

_BASE_URL = "split_part(split_part(url, '#', 1), '?', 1)"
_URLS = (
    f"CASE WHEN content_id % 5 = 0 THEN concat({_BASE_URL}, '?utm_source=a&id=', cast(content_id AS STRING), '&fbclid=z#top') "
    f"WHEN content_id % 5 = 1 THEN concat({_BASE_URL}, '?p=emailAbC&x=') ELSE {_BASE_URL} END"
)


@query(
    "ur_clean_url",
    f"SELECT content_id, CASE WHEN content_id % 5 = 0 THEN {_BASE_URL} || '?id=' || CAST(content_id AS VARCHAR) || '#top' WHEN content_id % 5 = 1 THEN {_BASE_URL} || '?x=' ELSE {_BASE_URL} END AS url "
    "FROM source_content WHERE url IS NOT NULL",
)
def _(spark, sf):
    return table(spark, sf, "source_content").filter("url IS NOT NULL").select("content_id", web.clean_url(F.expr(_URLS)).alias("url"))


@query("ur_tracking_pairs", r"SELECT pair, count(*) AS n FROM (SELECT unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS pair FROM source_content WHERE contains(url, '?')) WHERE regexp_matches(lower(pair), '^(utm_.*|(fbclid|gclid|dclid|msclkid|twclid|ttclid|igshid|yclid|mc_cid|mc_eid|_ga|_gl|at_medium|at_campaign|ito|cmp)(=.*)?|p=email\w+)$') GROUP BY ALL")
def _(spark, sf):
    u = table(spark, sf, "source_content").filter("contains(url, '?')").select(F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("pair"))
    return u.filter(web.is_tracking(F.col("pair"))).groupBy("pair").agg(F.count("*").alias("n"))


@query("ur_doi_candidates", "SELECT work_id, doi || '/pdf,' || doi AS candidates FROM catalogue_work")
def _(spark, sf):
    u = F.concat(F.lit("https://x.example/doi/"), F.col("doi"), F.lit("/pdf?x=1"))
    return table(spark, sf, "catalogue_work").select("work_id", F.array_join(web.doi_candidates(u), ",").alias("candidates"))


@query("ur_first_doi", "SELECT work_id, doi FROM catalogue_work")
def _(spark, sf):
    return table(spark, sf, "catalogue_work").select("work_id", web.first_doi(F.concat(F.lit("See (doi:"), F.col("doi"), F.lit(")."))).alias("doi"))


@query(
    "ur_page_metadata",
    "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'A, B; C, D' ELSE 'Only One' END AS author, CASE WHEN p_partkey % 3 = 0 THEN '2020-01' END AS date, 'Visible ' || p_brand AS body FROM part",
)
def _(spark, sf):
    meta = F.when(F.col("p_partkey") % 2 == 0, '<meta name="citation_author" content="A, B"><meta name="citation_author" content="C, D"><meta name="citation_author" content="A, B">').otherwise("")
    ld = F.when(F.col("p_partkey") % 3 == 0, '<script type="application/ld+json">[{"@type":["Article","Thing"],"headline":"no","author":{"name":"Only One"},"datePublished":"2020-01"}]</script>').otherwise(
        '<script type="application/ld+json">{"@graph":[{"@type":"Book","author":["Only One"]}]}</script>'
    )
    html = F.concat(F.lit("<html><head><title>t</title><meta property='og:title' content='"), F.col("p_name"), F.lit("'>"), meta, ld, F.lit("</head><body><nav>Menu</nav><p>Visible <b>"), F.col("p_brand"), F.lit("</b></p><footer>x</footer></body></html>"))
    p = table(spark, sf, "part").select("p_partkey", html.alias("html")).select("p_partkey", web.parsed_page("html").alias("page"))
    m = web.page_metadata(F.col("page"))
    return p.select("p_partkey", m["Title"].alias("title"), m["Author"].alias("author"), m["PublicationDate"].alias("date"), web.page_excerpt(F.col("page")).alias("body"))


# ---- catalogue

_Y = "published_print.date_parts[1][1]"


@query("d_full_date", "SELECT work_id, array_to_string(list_transform(coalesce(CASE WHEN len(published_print.date_parts[1]) > 0 THEN published_print.date_parts[1] END, CASE WHEN len(published_online.date_parts[1]) > 0 THEN published_online.date_parts[1] END), lambda p, i: CASE WHEN i = 1 THEN CAST(p AS VARCHAR) ELSE lpad(CAST(p AS VARCHAR), 2, '0') END), '-') AS date FROM catalogue_work")
def _(spark, sf):
    return table(spark, sf, "catalogue_work").select("work_id", web.full_date(F.col("published_print"), F.col("published_online")).alias("date"))


@query("d_year_gate", f"SELECT work_id, coalesce(abs({_Y} - (1900 + work_id % 120)) <= 1, true) AS near FROM catalogue_work")
def _(spark, sf):
    return table(spark, sf, "catalogue_work").select("work_id", web.year_near(web.year_of(F.col("published_print")), 1900 + F.col("work_id") % 120).alias("near"))


@query(
    "x_names_text",
    "SELECT work_id, nullif(array_to_string(list_transform(list_filter(author, lambda a: coalesce(a.family, '') <> ''), lambda a: regexp_replace(a.family || ', ' || coalesce(a.given, ''), '[, ]+$', '')), ' and '), '') AS names FROM catalogue_work",
)
def _(spark, sf):
    return table(spark, sf, "catalogue_work").select("work_id", web.names_text(F.col("author")).alias("names"))


def _works(spark, sf):
    w = table(spark, sf, "catalogue_work")
    m = web.catalogue_fields({k: F.col(k) for k in ("volume", "issue", "page", "publisher", "container_title")})
    return w.select("doi", F.get("title", F.lit(0)).alias("title"), "author", web.year_of(F.col("published_print")).alias("year"), m.alias("fields"))


@query(
    "x_catalogue_fields",
    r"SELECT doi, volume, issue AS number, trim(regexp_replace(page, '\s*[-–—]{1,2}\s*', '-', 'g')) AS pages, publisher, container_title[1] AS journaltitle FROM catalogue_work",
)
def _(spark, sf):
    f = F.col("fields")
    return _works(spark, sf).select("doi", *(f[k].alias(k) for k in ("volume", "number", "pages", "publisher", "journaltitle")))


def _to_fill(spark, sf):
    """Records with a catalogue DOI by number, so that both ways of looking up are taken."""
    b, w = table(spark, sf, "bib_entry"), table(spark, sf, "catalogue_work")
    doi = w.select((F.col("work_id") % 1_000_000_000 + 1_000_000_000).alias("entry_id"), "doi").groupBy("entry_id").agg(F.min("doi").alias("doi"))
    j = b.join(doi, "entry_id", "left")
    keys = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("title", "title"), ("author", "author"), ("date", "entry_date"), ("pages", "pages"), ("doi", "doi")))), lambda x: x["value"].isNotNull()))
    return j.select(F.col("entry_id").alias("id"), "etype", keys.alias("f"))


def _filled(spark, sf):
    return resolve.filled(resolve.lookup(_to_fill(spark, sf), _works(spark, sf)))


_FILL = (
    "WITH d AS (SELECT work_id % 1000000000 + 1000000000 AS entry_id, min(doi) AS doi FROM catalogue_work GROUP BY 1), e AS (SELECT b.*, d.doi FROM bib_entry b LEFT JOIN d USING (entry_id)), "
    r"w AS (SELECT doi, trim(regexp_replace(lower(title[1]), '[^\p{L}\p{N} ]', '', 'g')) AS k, author, published_print.date_parts[1][1] AS y, volume, issue AS number, "
    r"trim(regexp_replace(page, '\s*[-–—]{1,2}\s*', '-', 'g')) AS pages, publisher, container_title[1] AS journaltitle FROM catalogue_work), "
    r"c AS (SELECT e.entry_id, min(w.doi) AS doi FROM e JOIN w ON trim(regexp_replace(lower(e.title), '[^\p{L}\p{N} ]', '', 'g')) = w.k AND w.k <> '' "
    "WHERE (coalesce(split_part(e.author, ',', 1), '') = '' OR coalesce(len(list_filter(w.author, lambda a: a.family <> '' AND (contains(lower(a.family), lower(split_part(e.author, ',', 1))) OR contains(lower(split_part(e.author, ',', 1)), lower(a.family))))) > 0, false)) "
    "AND coalesce(abs(w.y - TRY_CAST(substr(e.entry_date, 1, 4) AS INT)) <= 1, true) GROUP BY 1), "
    "h AS (SELECT e.entry_id AS id, e.etype, e.pages AS own, coalesce(e.doi, c.doi) AS doi, CASE WHEN e.doi IS NOT NULL THEN 'doi' ELSE 'title' END AS how FROM e LEFT JOIN c USING (entry_id) WHERE coalesce(e.doi, c.doi) IS NOT NULL), "
    "r AS (SELECT id, etype, own, how, unnest(['volume', 'number', 'pages', 'publisher', 'journaltitle']) AS key, unnest([w.volume, w.number, w.pages, w.publisher, w.journaltitle]) AS value FROM h JOIN w ON h.doi = w.doi), "
    "f AS (SELECT id, key, value, 'catalogue/' || how AS source FROM r WHERE coalesce(value, '') <> '' AND (key <> 'pages' OR coalesce(own, '') = '') AND (key <> 'publisher' OR etype IN ('book', 'incollection', 'inproceedings', 'collection', 'reference', 'inbook'))) "
)


@query("x_fill_missing", _FILL + "SELECT id, key, value, source FROM f")
def _(spark, sf):
    return _filled(spark, sf)


@query("x_provenance", _FILL + "SELECT id, source || ': ' || string_agg(key, ', ' ORDER BY key) AS note FROM f GROUP BY id, source")
def _(spark, sf):
    return resolve.provenance(_filled(spark, sf))


@query("x_similarity")
def _(spark, sf):
    b = table(spark, sf, "bib_entry").filter("title IS NOT NULL").select(F.col("entry_id").alias("id"), "title", F.lower(F.split_part("author", F.lit(","), F.lit(1))).alias("k"))
    w = table(spark, sf, "catalogue_work").select("work_id", F.get("title", F.lit(0)).alias("work_title"), F.explode("author").alias("a")).select("work_id", "work_title", F.lower("a.family").alias("k"))
    pairs = b.join(w, "k").withColumn("score", text.similarity(F.col("title"), F.col("work_title")))
    return resolve.top_candidate(pairs.select("id", F.col("work_id").alias("rank"), "score")).withColumnRenamed("rank", "work_id")


@query(
    "x_name_completion",
    "SELECT s_suppkey, s_suppkey % 3 <> 2 AS done FROM supplier",
)
def _(spark, sf):
    k = F.col("s_suppkey")
    claimed = F.when(k % 3 == 0, "Doe, J. and Roe, R.").when(k % 3 == 1, "Doe, Jane").otherwise("Doe, K. and Poe, A.")
    return table(spark, sf, "supplier").select("s_suppkey", web.is_name_completion(claimed, F.lit("Doe, Jane and Roe, Richard and Poe, Anna")).alias("done"))


@query("x_verify_decisions", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'unconfirmed' WHEN 1 THEN 'ok' WHEN 2 THEN 'candidate' WHEN 3 THEN 'unconfirmed' ELSE 'candidate' END AS decision FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey") % 5
    field = F.when(k == 4, "author").otherwise("publisher")
    claimed = F.when(k == 4, "Doe, J.").when(k == 3, "Other").when(k == 1, "big HOUSE!").otherwise("Big")
    verified = F.when(k == 0, F.lit(None)).when(k == 4, "Doe, Jane").otherwise("Big House")
    return table(spark, sf, "supplier").select("s_suppkey", resolve.decision(field, claimed, verified, F.lit(True)).alias("decision"))


@query("u_unexpected", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'isbn' ELSE '' END AS extra FROM supplier")
def _(spark, sf):
    merged = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("title"), F.lit("isbn"), F.lit("volume"))).otherwise(F.array(F.lit("title"), F.lit("volume")))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(resolve.unexpected(merged, F.array(F.lit("title")), F.array(F.lit("volume"))), ",").alias("extra"))


# ---- scoring: the library against two damaged copies

_GOT_A = "SELECT entry_id AS n, key, CASE WHEN key = 'title' AND entry_id % 10 = 0 THEN concat(value, ' x') WHEN key = 'author' THEN concat(upper(value), '.') ELSE value END AS value FROM lib WHERE NOT (key = 'pages' AND entry_id % 7 = 0)"
_GOT_B = "SELECT entry_id AS n, key, value FROM lib WHERE key <> 'volume' UNION ALL SELECT entry_id AS n, 'extra' AS key, 'y' AS value FROM lib WHERE key = 'title' AND entry_id % 3 = 0"


def _compared(spark, sf):
    lib = lib_fields(spark, sf)
    truth = lib.select(F.col("entry_id").alias("n"), "key", "value")
    got = spark.sql(_GOT_A.replace("FROM lib", "FROM {lib}"), lib=lib).withColumn("cfg", F.lit("A")).unionByName(spark.sql(_GOT_B.replace("FROM lib", "FROM {lib}"), lib=lib).withColumn("cfg", F.lit("B")))
    return score.compared(truth, got)


_NORM = r"lower(trim(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '\.+$', '')))"
_CMP = (
    DUCK.rstrip() + f", got AS (SELECT *, 'A' AS cfg FROM ({_GOT_A}) UNION ALL SELECT *, 'B' AS cfg FROM ({_GOT_B})), runs AS (SELECT DISTINCT n, cfg FROM got), "
    "t AS (SELECT entry_id AS n, cfg, key, value FROM lib JOIN runs ON runs.n = lib.entry_id WHERE key NOT IN ('date-added', 'date-modified', 'keywords')), "
    "g AS (SELECT * FROM got WHERE key NOT IN ('date-added', 'date-modified', 'keywords')), "
    f"cmp AS (SELECT coalesce(t.cfg, g.cfg) AS cfg, coalesce(t.key, g.key) AS key, CASE WHEN g.value IS NULL THEN 'missing' WHEN t.value IS NULL THEN 'extra' WHEN {_NORM.format('t.value')} = {_NORM.format('g.value')} THEN 'match' ELSE 'differ' END AS verdict "
    "FROM t FULL JOIN g ON t.n = g.n AND t.cfg = g.cfg AND t.key = g.key) "
)


@query("b_ab_totals", _CMP + "SELECT cfg, count(*) FILTER (verdict <> 'extra') AS truth, count(*) FILTER (verdict = 'match') AS match, count(*) FILTER (verdict = 'differ') AS differ, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'extra') AS extra, count(*) FILTER (verdict = 'match') / count(*) FILTER (verdict <> 'extra') AS accuracy FROM cmp GROUP BY cfg")
def _(spark, sf):
    return score.totals(_compared(spark, sf))


@query("b_field_errors", _CMP + "SELECT cfg, key, count(*) FILTER (verdict = 'missing') AS n_missing, count(*) FILTER (verdict = 'differ') AS n_differ FROM cmp GROUP BY ALL")
def _(spark, sf):
    return score.field_errors(_compared(spark, sf))


@query("b_worst_fields", _CMP + "SELECT cfg, key, errors, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cfg ORDER BY errors DESC, key) AS INT) AS rank FROM (SELECT cfg, key, count(*) FILTER (verdict IN ('missing', 'differ')) AS errors FROM cmp GROUP BY cfg, key)) WHERE rank <= 8")
def _(spark, sf):
    return score.worst_fields(_compared(spark, sf)).select("cfg", "key", "errors", "rank")


# ---- cost

_COST = "(o_orderkey * 10)"


@query(
    "m_cost_calls",
    "SELECT o_orderkey, round(o_orderkey * 1e1 / 1e6 * 3e0 * 1.25e0, 9) AS w5, round(o_orderkey * 1e1 / 1e6 * 3e0 * 2e0, 9) AS w1, round(o_orderkey * 1e1 / 1e6 * 3e0 * 1e-1, 9) AS r, "
    "round(o_orderkey * 1e1 / 1e6 * 3e0 * 1e-1 + 500e0 / 1e6 * 3e0 + 450e0 / 1e6 * 15e0, 9) AS later FROM orders",
)
def _(spark, sf):
    s, i, o = F.col("o_orderkey") * 10, F.lit(3.0), F.lit(15.0)
    r = cost.read_cost(s, i)
    cols = {"w5": cost.write_cost(s, i, F.lit("5m")), "w1": cost.write_cost(s, i, F.lit("1h")), "r": r, "later": cost.call_cost(r, F.lit(500), "extraction", i, o)}
    return table(spark, sf, "orders").select("o_orderkey", *(F.round(c, 9).alias(k) for k, c in cols.items()))


@query("m_run_total", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 12 = 0 THEN 0e0 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 4e-2 ELSE 28e-2 END + 7e-3 + (o_orderkey % 12 - 1) * 47e-3 END, 6) AS total FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(cost.run_total(k % 12, k % 2 == 0, F.lit(0.28), F.lit(0.04), F.lit(0.007)), 6).alias("total"))


# ---- coverage of names by documents


@query(
    "jn_doc_coverage",
    r"WITH tok AS (SELECT DISTINCT lower(w) AS token FROM documents, unnest(regexp_extract_all(text, '[\p{L}\p{N}_-]+')) u(w)) SELECT key FROM (SELECT DISTINCT field_key AS key FROM bib_field) WHERE key NOT IN (SELECT token FROM tok)",
)
def _(spark, sf):
    # a name is covered if it stands as a whole token: tokenise once and anti-join on equality
    tok = _docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("key")).distinct()
    return table(spark, sf, "bib_field").select(F.col("field_key").alias("key")).distinct().join(tok, "key", "left_anti")


@query(
    "u_symmetric_difference",
    DUCK + "(SELECT entry_id, key AS field_key FROM lib EXCEPT SELECT entry_id, field_key FROM bib_field) UNION ALL (SELECT entry_id, field_key FROM bib_field EXCEPT SELECT entry_id, key FROM lib)",
)
def _(spark, sf):
    """Fields of the library as delivered and as worked on that only one of the two has."""
    a = lib_fields(spark, sf).select("entry_id", F.col("key").alias("field_key")).distinct()
    b = table(spark, sf, "bib_field").select("entry_id", "field_key").distinct()
    return a.exceptAll(b).unionAll(b.exceptAll(a))


# ---- further scalars

_PLAIN = r"trim(regexp_replace(regexp_replace({0}, '[{{}}]', '', 'g'), '\s+', ' ', 'g'), ' ')"


@query(
    "tx_strip_latex",
    DUCK + f"SELECT entry_id, key, CASE WHEN key = 'titleaddon' THEN 'na' || chr(92) || '\"ive X text' ELSE {_PLAIN.format('value')} END AS value FROM lib WHERE key IN ('title', 'titleaddon')",
)
def _(spark, sf):
    from folioframe.functions.latex import strip_latex

    return lib_fields(spark, sf).filter("key IN ('title', 'titleaddon')").select("entry_id", "key", strip_latex(F.col("value")).alias("value"))


@query("b_coverage", DUCK.rstrip() + f", got AS (SELECT *, 'A' AS cfg FROM ({_GOT_A}) UNION ALL SELECT *, 'B' AS cfg FROM ({_GOT_B})) SELECT lib.key, r.cfg, count(*) AS expected, count(g.n) AS present FROM (SELECT DISTINCT entry_id AS n, key FROM lib WHERE key IN ('pages', 'volume', 'date')) lib JOIN (SELECT DISTINCT n, cfg FROM got) r USING (n) LEFT JOIN (SELECT DISTINCT n, cfg, key FROM got WHERE coalesce(value, '') <> '') g ON g.n = lib.n AND g.cfg = r.cfg AND g.key = lib.key GROUP BY ALL")
def _(spark, sf):
    lib = lib_fields(spark, sf)
    got = spark.sql(_GOT_A.replace("FROM lib", "FROM {lib}"), lib=lib).withColumn("cfg", F.lit("A")).unionByName(spark.sql(_GOT_B.replace("FROM lib", "FROM {lib}"), lib=lib).withColumn("cfg", F.lit("B")))
    return score.coverage(lib.select(F.col("entry_id").alias("n"), "key"), got, ["pages", "volume", "date"])


@query("m_scenarios", "SELECT scenario, ttl, round(total, 9) AS total FROM (VALUES ('one batch of ten', '5m', 28e-2 + 7e-3 + 9 * 47e-3), ('one batch of ten', '1h', 43e-2 + 7e-3 + 9 * 47e-3), ('two batches of five', '5m', 2 * (28e-2 + 7e-3 + 4 * 47e-3)), ('two batches of five', '1h', 43e-2 + 7e-3 + 4 * 47e-3 + 5 * 47e-3), ('ten single runs', '5m', 10 * (28e-2 + 7e-3)), ('ten single runs', '1h', 43e-2 + 7e-3 + 9 * 47e-3)) t(scenario, ttl, total)")
def _(spark, sf):
    base = {"first_5m": F.lit(0.28), "later_5m": F.lit(0.04), "first_1h": F.lit(0.43), "later_1h": F.lit(0.04), "audit": F.lit(0.007)}
    return spark.range(1).select(F.explode(cost.scenarios(base)).alias("x")).select("x.scenario", "x.ttl", F.round("x.total", 9).alias("total"))


@query("ur_catalogue_content")
def _(spark, sf):
    w = table(spark, sf, "catalogue_work")
    cols = {k: F.col(k) for k in ("title", "subtitle", "author", "container_title", "publisher", "volume", "issue", "page", "lang", "work_type", "doi")}
    return w.select("work_id", web.catalogue_content(cols | {"date": web.full_date(F.col("published_print"), F.col("published_online"))}).alias("text"))
