"""Addresses, identifiers, page metadata and catalogue records."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.text import WEB_WORDS, head_sentences, normalised_pages
from folioframe.schema import CHALLENGE_STATUS, TRACKING_PARAMETERS


def is_tracking(pair: Column) -> Column:
    """Whether a raw ``key=value`` pair of a query string only tracks."""
    k, v = F.lower(F.split_part(pair, F.lit("="), F.lit(1))), F.regexp_extract(pair, "=(.*)$", 1)
    return k.isin(*TRACKING_PARAMETERS) | k.startswith("utm_") | ((k == "p") & v.rlike(r"(?i)^email\w+$"))


def clean_url(u: Column) -> Column:
    """Address without tracking pairs; the others stay as written and in order, and so does the fragment."""
    base, query, fragment = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(u, "(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~is_tracking(p)), "&")
    return F.when(u.contains("?"), F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), fragment)).otherwise(u)


def doi_candidates(u: Column, limit: int = 3) -> Column:
    """DOIs that an address path may hold: the longest first, then with segments peeled off."""
    doi = F.rtrim(F.regexp_extract(u, r"^[^?#]*?/(10\.\d{4,9}/[^?#]+)", 1), F.lit("/"))
    parts = F.split(doi, "/")
    peeled = F.transform(F.sequence(F.size(parts), F.lit(2), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(doi == "", F.expr("cast(array() as array<string>)")).otherwise(F.slice(peeled, 1, limit))


def first_doi(s: Column) -> Column:
    """First DOI in a text; null if there is none."""
    return F.nullif(F.rtrim(F.regexp_extract(s, r'(10\.\d{4,9}/[^\s"<>{}]+)', 1), F.lit(".,;)")), F.lit(""))


def is_challenge(status: Column, headers: Column, body: Column) -> Column:
    """Whether a response is a bot check."""
    mark = F.lower(F.substring(body, 1, 4000)).rlike("just a moment|cf-challenge|checking your browser")
    return status.isin(*CHALLENGE_STATUS) & (headers["cf-mitigated"].isNotNull() | F.coalesce(F.lower(headers["server"]).contains("cloudflare"), F.lit(False)) | mark)


def outcome(status: Column, challenge: Column, doi_hit: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(challenge & doi_hit, "challenge-doi").when(challenge, "challenge").otherwise("error")


class _Page(HTMLParser):
    """Title, meta tags, linked data and visible text of a page in one pass."""

    HIDDEN = frozenset(("script", "style", "nav", "header", "footer", "aside", "form", "noscript"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: list[dict] = []
        self.data: list[str] = []
        self.title: list[str] = []
        self.text: list[str] = []
        self.hidden = 0
        self.inside = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("content", "") and a["content"].strip():
            for attr in ("name", "property"):
                if a.get(attr):
                    self.meta.append({"attr": attr, "key": a[attr], "content": a["content"].strip()})
        self.hidden += tag in self.HIDDEN
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.inside = "ld"
            self.data.append("")
        elif tag == "title":
            self.inside = "title"

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        if tag in ("script", "title"):
            self.inside = ""

    def handle_data(self, data):
        if self.inside == "ld":
            self.data[-1] += data
        elif self.inside == "title":
            self.title.append(data)
        elif not self.hidden and data.strip():
            self.text.append(data)


def _people(v) -> str:
    if isinstance(v, list):
        return "; ".join(filter(None, map(_people, v)))
    return (v.get("name") or "" if isinstance(v, dict) else str(v or "")).strip()


# Kinds of linked-data objects that describe a work.
LINKED_TYPES = frozenset("Article NewsArticle ScholarlyArticle BlogPosting WebPage Book".split())


def linked_data(blocks: list[str]) -> dict[str, str]:
    """Fields of the first object of a known kind; kinds may be lists, and objects may lie in a graph."""
    def walk(v):
        for x in v if isinstance(v, list) else [v]:
            if isinstance(x, dict):
                yield x
                yield from walk(x.get("@graph") or [])

    for b in blocks:
        try:
            found = json.loads(b)
        except ValueError:
            continue
        for x in walk(found):
            kinds = x.get("@type")
            if LINKED_TYPES & set(kinds if isinstance(kinds, list) else [kinds]):
                out = {"Title": x.get("headline") or x.get("name"), "Author": _people(x.get("author")), "PublicationDate": x.get("datePublished"), "Publisher": _people(x.get("publisher"))}
                return {k: str(v).strip() for k, v in out.items() if v and str(v).strip()}
    return {}


PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("linked", T.MapType(T.StringType(), T.StringType())),
    T.StructField("meta", T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("attr", "key", "content")]))),
])


@F.pandas_udf(PAGE)
def parsed_page(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        p = _Page()
        p.feed(h or "")
        p.close()
        rows.append({"title": " ".join("".join(p.title).split()) or None, "text": " ".join(" ".join(p.text).split()), "linked": linked_data(p.data), "meta": p.meta})
    return pd.DataFrame(rows, columns=["title", "text", "linked", "meta"])


def page_excerpt(page: Column) -> Column:
    return head_sentences(page["text"], WEB_WORDS)


def meta_value(page: Column, *keys: str) -> Column:
    """Contents of all tags of the first of ``keys`` that has any: distinct, in order, joined."""
    each = [F.nullif(F.array_join(F.array_distinct(F.transform(_having(page, k), lambda m: m["content"])), "; "), F.lit("")) for k in keys]
    return F.coalesce(*each)


def _having(page: Column, key: str) -> Column:
    return F.filter(page["meta"], lambda m: F.lower(m["key"]) == key)


def page_metadata(page: Column) -> Column:
    """Map of labels: citation tags before open-graph tags before linked data before the page's title."""
    # Label, citation tags, open-graph tag.
    rows = [("Title", ["citation_title"], "og:title"), ("Author", ["citation_author", "citation_authors"], None), ("PublicationDate", ["citation_publication_date", "citation_date"], "article:published_time"),
            ("Journal", ["citation_journal_title"], None), ("Volume", ["citation_volume"], None), ("Number", ["citation_issue"], None), ("DOI", ["citation_doi"], None),
            ("Publisher", ["citation_publisher"], None), ("SiteName", [], "og:site_name"), ("Language", ["citation_language"], None)]
    items = []
    for label, citation, og in rows:
        tags = [k for k in [*citation, og] if k]
        v = [meta_value(page, k) for k in tags] + [page["linked"][label]] + ([page["title"]] if label == "Title" else [])
        items.append(F.struct(F.lit(label).alias("key"), F.coalesce(*v).alias("value")))
    return F.map_from_entries(F.filter(F.array(*items), lambda x: x["value"].isNotNull()))


# ---- catalogue records


def year_of(date: Column) -> Column:
    """Year of a date_parts struct."""
    return F.get(F.get(date["date_parts"], F.lit(0)), F.lit(0))


def full_date(*dates: Column) -> Column:
    """Parts of the first date that has any, joined by hyphens and padded."""
    parts = F.coalesce(*(F.when(F.size(F.get(d["date_parts"], F.lit(0))) > 0, F.get(d["date_parts"], F.lit(0))) for d in dates))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0"))), "-")


def year_near(item_year: Column, year: Column) -> Column:
    """Within a year of each other; unknown years agree with any."""
    return F.coalesce(F.abs(item_year - year) <= 1, F.lit(True))


def surname_found(authors: Column, surname: Column) -> Column:
    """Whether a surname is part of a family name or the other way round."""
    s = F.lower(surname)
    hit = F.exists(authors, lambda a: (a["family"] != "") & (F.lower(a["family"]).contains(s) | s.contains(F.lower(a["family"]))))
    return F.when(F.coalesce(surname, F.lit("")) == "", True).otherwise(F.coalesce(hit, F.lit(False)))


def names_text(authors: Column) -> Column:
    """Family, Given and Family, Given."""
    each = F.transform(F.filter(authors, lambda a: F.coalesce(a["family"], F.lit("")) != ""), lambda a: F.regexp_replace(F.concat(a["family"], F.lit(", "), F.coalesce(a["given"], F.lit(""))), "[, ]+$", ""))
    return F.nullif(F.array_join(each, " and "), F.lit(""))


def catalogue_fields(w: dict[str, Column]) -> Column:
    """Map of the fields that a catalogue record gives."""
    rows = [("volume", w["volume"]), ("number", w["issue"]), ("pages", normalised_pages(w["page"])), ("publisher", w["publisher"]), ("journaltitle", F.get(w["container_title"], F.lit(0)))]
    items = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in rows))
    return F.map_from_entries(F.filter(items, lambda x: F.coalesce(x["value"], F.lit("")) != ""))


def name_map(names: Column) -> Column:
    """Map of lower-case surname to given names of an ``and`` list; parts without a comma are skipped, the last of equal surnames counts."""
    parts = F.filter(F.split(names, r"\s+and\s+"), lambda x: x.contains(","))
    rows = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(","), F.lit(1)))).alias("key"), F.trim(F.regexp_extract(x, ",(.*)$", 1)).alias("value")))
    keys = F.transform(rows, lambda r: r["key"])
    return F.map_from_entries(F.filter(rows, lambda r, i: F.size(F.filter(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == r["key"])) == 0))


def is_name_completion(claimed: Column, verified: Column) -> Column:
    """Every claimed surname is verified, with given names that begin alike."""
    c, v = name_map(claimed), name_map(verified)
    ok = F.forall(F.map_entries(c), lambda e: v[e["key"]].isNotNull() & F.startswith(F.lower(v[e["key"]]), F.rtrim(F.lower(e["value"]), F.lit("."))))
    return (F.size(c) > 0) & F.coalesce(ok, F.lit(False))


def catalogue_content(w: dict[str, Column], budget: int = WEB_WORDS) -> Column:
    """Text of a catalogue record: labelled lines of what it has, then the abstract within the rest of the word budget."""
    rows = [("Title", F.array_join(w["title"], ": ")), ("Subtitle", F.array_join(w["subtitle"], ": ")), ("Author", names_text(w["author"])), ("Journal", F.get(w["container_title"], F.lit(0))),
            ("Publisher", w["publisher"]), ("Volume", w["volume"]), ("Number", w["issue"]), ("Pages", w["page"]), ("PublicationDate", w["date"]), ("Language", w["lang"]), ("Type", w["work_type"]), ("DOI", w["doi"])]
    lines = F.array_join(F.filter(F.array(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in rows)), lambda x: x.isNotNull()), "\n")
    from folioframe.functions.text import without_tags, words

    rest = F.greatest(F.lit(budget) - F.size(words(lines)), F.lit(0))
    abstract = F.array_join(F.slice(words(without_tags(w["abstract"])), F.lit(1), rest), " ") if "abstract" in w else F.lit(None).cast("string")
    return F.concat_ws("\n", lines, F.nullif(abstract, F.lit("")))
