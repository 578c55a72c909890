"""Text scalars: words, sentence-bounded excerpts, page windows, citation strings."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_WORDS, LAST_WORDS, OCR_WORDS, WEB_WORDS = 450, 150, 100, 600


def words(s: Column) -> Column:
    """Words between white space of any kind; null gives null."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def trimmed(s: Column) -> Column:
    """Without the spaces of any kind at both ends, as SQL's ``trim`` has it in DuckDB; line feeds and tabs stay."""
    return F.regexp_replace(s, r"^\p{Zs}++|(?<!\p{Zs})\p{Zs}++\z", "")


def head_sentences(s: Column, n: int) -> Column:
    """The first ``n`` words, cut after the last sentence end among them; all of a shorter text."""
    w = words(s)
    head = F.array_join(F.slice(w, 1, n), " ")
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.size(w) <= n, trimmed(s)).when(cut != "", cut).otherwise(head)


def tail_sentences(s: Column, n: int) -> Column:
    """The last ``n`` words, from the first sentence that begins among them; all of a shorter text."""
    w = words(s)
    tail = F.array_join(F.slice(w, -n, n), " ")
    cut = F.regexp_extract(tail, r"(?s)^.*?[.!?]\s+([A-Z].*)$", 1)
    return F.when(F.size(w) <= n, trimmed(s)).when(cut != "", cut).otherwise(tail)


def key_pages(n: Column) -> Column:
    """Page numbers that stand for a document of ``n`` pages."""
    ends = F.array(F.lit(1), F.lit(2), F.lit(3), n - 1, n)
    return F.when(n <= 0, F.expr("cast(array() as array<int>)")).when(n <= 5, F.sequence(F.lit(1), n)).otherwise(ends)


def headers_footers(pages: Column, lines: int = 3) -> Column:
    """First and last lines of the key pages, a block per page."""
    def block(i: Column) -> Column:
        ls = F.filter(F.transform(F.split(F.get(pages, i - 1), "\n"), lambda x: F.trim(x)), lambda x: x != "")
        more = F.when(F.size(ls) > lines, F.concat(F.array(F.lit("...")), F.slice(ls, F.greatest(F.size(ls) - lines + 1, F.lit(1)), lines))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(F.size(ls) > 0, F.concat(F.lit("[Page "), i.cast("string"), F.lit("]\n"), F.array_join(F.concat(F.slice(ls, 1, lines), more), "\n")))

    return F.array_join(F.transform(key_pages(F.size(pages)), block), "\n\n")


def page_window(pages: Column) -> Column:
    """What is read of a document: all of a short one, else the beginning, the end and the page margins."""
    whole = F.array_join(pages, "\n")
    n = F.aggregate(pages, F.lit(0), lambda a, p: a + F.size(words(p)))
    first = F.when(F.size(words(F.get(pages, F.lit(0)))) >= FIRST_WORDS, F.trim(F.get(pages, F.lit(0)))).otherwise(head_sentences(whole, FIRST_WORDS))
    last = tail_sentences(whole, LAST_WORDS)
    count = lambda c: F.size(words(c)).cast("string")
    full = F.concat(F.lit("--- FULL TEXT ("), n.cast("string"), F.lit(" words) ---\n"), F.trim(whole))
    parts = F.concat_ws("\n", F.concat(F.lit("--- BEGINNING ("), count(first), F.lit(" words) ---")), first, F.concat(F.lit("--- END ("), count(last), F.lit(" words) ---")), last, F.nullif(headers_footers(pages), F.lit("")))
    return F.when(n <= F.size(words(first)) + LAST_WORDS, full).otherwise(parts)


def ocr_choice(plain: Column, ocr: Column, forced: Column) -> Column:
    """plain, ocr or forced: which text of a scanned document is kept."""
    n = lambda c: F.coalesce(F.size(words(c)), F.lit(0))
    return F.when(n(plain) >= OCR_WORDS, "plain").when(n(ocr) >= OCR_WORDS, "ocr").when(n(forced) > F.greatest(n(ocr), n(plain)), "forced").when(n(ocr) > n(plain), "ocr").otherwise("plain")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def comparable(s: Column) -> Column:
    """Lower case letters, digits and spaces of any alphabet."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N} ]", ""))


def similarity(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two titles; pairs that cannot reach 0.72 by their lengths are null and cost nothing."""
    x, y = comparable(a), comparable(b)
    bound = 2 * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y))
    return _ratio(F.when(bound >= 0.72, x), F.when(bound >= 0.72, y))


def normalised_pages(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s*[-–—]{1,2}\s*", "-"))


def joined_title(main: Column, sub: Column) -> Column:
    return F.concat_ws(": ", F.nullif(main, F.lit("")), F.nullif(sub, F.lit("")))


def without_tags(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), r"\s+", " "))


def scored_value(s: Column) -> Column:
    """Form in which two extracted values are compared."""
    return F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"\.+$", "")))


def citation_parts(s: Column) -> Column:
    """authors, year, title and journal of an author-date citation."""
    year = F.regexp_extract(s, r"\((\d{4})", 1)
    before = F.regexp_extract(s, r"(?s)^(.*?)\s*\(\d{4}", 1)
    names = F.regexp_extract_all(before, F.lit(r"([^,&]+,\s*(?:[A-Z]\.\s*-?)+)"), F.lit(1))
    after = F.regexp_extract(s, r"(?s)\(\d{4}[^)]*\)\.\s*(.*)$", 1)
    return F.struct(
        F.array_join(F.transform(names, lambda x: F.trim(F.regexp_replace(x, r"^[\s,&]+", ""))), " and ").alias("authors"), year.alias("year"),
        F.trim(F.regexp_extract(after, r"^([^.]*)", 1)).alias("title"), F.trim(F.regexp_extract(after, r"^[^.]*\.\s*([^,]*)", 1)).alias("journal"),
    )


def author_text(s: Column) -> Column:
    """Author part of a notes-style citation: up to the first quote mark or the year."""
    quoted = F.regexp_extract(s, '^([^"“]*)["“]', 1)
    dated = F.regexp_extract(s, r"^(.*?)\(\d{4}\)", 1)
    return F.regexp_replace(F.when(quoted != "", quoted).when(dated != "", dated).otherwise(s), r"[. ]+$", "")


def ungrounded(reply: Column) -> Column:
    """Fields named after the marker of an audit reply; null where there is no marker."""
    line = F.regexp_extract(reply, r"UNGROUNDED_FIELDS:\s*([^\n]+)", 1)
    names = F.filter(F.transform(F.split(F.lower(line), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(line == "", F.lit(None)).when(F.upper(F.trim(line)) == "NONE", F.expr("cast(array() as array<string>)")).otherwise(names)


def braces_verdict(s: Column) -> Column:
    """ok, an unmatched closing brace, or the number of unclosed ones; escaped braces don't count."""
    t = F.regexp_extract_all(F.regexp_replace(s, r"\\.", ""), F.lit("[{}]"), F.lit(0))
    end = F.aggregate(t, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, c: F.struct((a["d"] + F.when(c == "{", 1).otherwise(-1)).alias("d"), F.least(a["low"], a["d"] + F.when(c == "{", 1).otherwise(-1)).alias("low")))
    return F.when(end["low"] < 0, "unmatched closing brace").when(end["d"] > 0, F.concat(F.lit("unclosed braces (depth="), end["d"].cast("string"), F.lit(")"))).otherwise("ok")


def cleaned_reply(s: Column) -> Column:
    """The first entry of a model's reply: no code fences, nothing before the first @ or after its entry."""
    body = F.regexp_replace(s, r"(?m)^\s*```.*$\n?", "")
    group = r"(?:[^{}\\]++|\\.|\{(?:[^{}\\]++|\\.|\{(?:[^{}\\]++|\\.|\{[^{}]*+\})*+\})*+\})*+"
    rest = F.regexp_extract(body, r"(?s)(@\w+\s*\{.*)$", 1)
    entry = F.regexp_extract(rest, rf"(?s)^(@\w+\s*\{{{group}\}})", 1)
    # entries nested deeper than the pattern reads are closed by counting
    deep = F.when(entry == "", body)
    return F.when(entry != "", entry).otherwise(_first_entry(deep))


@F.pandas_udf(T.StringType())
def _first_entry(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else first_entry(b))


def first_entry(body: str) -> str:
    """The first entry of a text, of any depth; all from the first @ on if it isn't closed, empty without one."""
    head = re.search(r"@\w+\s*\{", body)
    if head and (close := closing(body, head.end() - 1)) is not None:
        return body[head.start() : close + 1]
    at = body.find("@")
    return body[at:].strip(" ") if at >= 0 else ""


def closing(text: str, at: int) -> int | None:
    """Place of the brace that closes the one at ``at``; escaped braces don't count."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if not depth:
            return m.start()
    return None
