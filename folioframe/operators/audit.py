"""Audit rules over entries: a registry of column builders, evaluated in one pass.

Every rule is a per-row expression that gives an array of details; all rules are emitted by one
``explode``, so a library is scanned once and nothing is shuffled. Rules are registered by label
and further ones can be added with ``rule``. Values are masked once per title-like field and the
mask is carried as a column (see ``functions.latex``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import latex
from folioframe.schema import BIBSTRINGS, ENGLISH_WORDS, FORBIDDEN, RANGE_FIELDS, SUBTITLE_OF, TYPOGRAPHIC

RULES: dict[str, Callable[[], Column]] = {}
_NONE = "cast(array() as array<string>)"
_WHOLE_RANGE = r"^\s*(\d+)\s*(?:--|[-\u2010-\u2015])\s*(\d+)\s*$"
# Fixed value: what marks a division or number inside a series.
_DIVISION = (
    r"(?i)(\bReihe\b|\bAbt(eilung)?\b|\bFolge\b|\bser[ií]e\b|\b\d+(st|nd|rd|th)\s+ser\.|\bser\.|\bn\.\s?s\.|\bnew series\b"
    r"|\bBd\.|\bvol\.|\bno\.|[,;]\s*[IVXLC0-9]+\s*$|\s+[IVXLC]{1,6}\s*$|\s+\d{1,3}\s*$)"
)


def rule(label: str):
    """Register a builder of an ``ARRAY<STRING>`` of details."""

    def add(build: Callable[[], Column]):
        RULES[label] = build
        return build

    return add


def val(key: str) -> Column:
    return F.col("f")[key]


def has(key: str) -> Column:
    return val(key).isNotNull()


def once(cond: Column, detail: Column | str = "") -> Column:
    """One detail where ``cond`` holds."""
    d = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(F.coalesce(cond, F.lit(False)), F.array(d)).otherwise(F.expr(_NONE))


def per_field(cond: Callable[[Column], Column], skip: str = "^$", detail: Callable[[Column], Column] = lambda x: x["key"]) -> Column:
    """One detail for every field that meets ``cond`` and whose key doesn't match ``skip``."""
    return F.transform(F.filter("fields", lambda x: ~x["key"].rlike(skip) & cond(x["value"])), detail)


def per_match(pattern: str, skip: str, group: int = 0) -> Column:
    """One detail for every match in every field."""
    found = lambda x: F.transform(F.regexp_extract_all(x["value"], F.lit(pattern), F.lit(group)), lambda m: F.concat_ws(": ", x["key"], m))
    return F.flatten(F.transform(F.filter("fields", lambda x: ~x["key"].rlike(skip)), found))


_BASE = r"^(bdsk-|local-url|remote-url|devonthink|abstract"

for _parent, _sub in SUBTITLE_OF.items():
    for _review in (False, True):

        @rule(f"unsplit-{_parent}" + ("-REVIEW(exempt?)" if _review else ""))
        def _unsplit(p=_parent, s=_sub, review=_review):
            n = latex.top_colons(F.col(f"p_{p}"))
            kind = (F.col("etype") == "review") if review else (F.col("etype") != "review")
            return once((n > 0) & ~has(s) & kind, F.concat(n.cast("string"), F.lit(" colon(s)"), F.when(n > 1, " MULTI").otherwise("")))


def _verdict() -> Column:
    return latex.shorttitle_verdict(F.col("etype"), val("title"), F.col("p_title"), has("subtitle"))


@rule("shorttitle-redundant")
def _():
    return once(has("shorttitle") & has("title") & (_verdict() == "redundant"), F.substring(val("title"), 1, 50))


@rule("shorttitle-equals-title")
def _():
    return once(latex.flattened(val("shorttitle")) == latex.flattened(val("title")), F.substring(val("title"), 1, 60))


@rule("shorttitle-mismatch")
def _():
    # the first top-level colon has the same offset in value and mask
    head = F.trim(F.substring(val("title"), F.lit(1), F.instr(F.col("p_title")["mask"], ": ") - 1))
    return once((latex.top_colons(F.col("p_title")) > 0) & (head != "") & (F.trim(val("shorttitle")) != head), F.concat_ws(" vs ", F.substring(val("shorttitle"), 1, 40), F.substring(head, 1, 40)))


def _missing(review: bool) -> Column:
    keeps = latex.keeps_shorttitle(F.col("etype"), val("title"), F.col("p_title"))
    kind = (F.col("etype") == "review") if review else (F.col("etype") != "review")
    return once(has("title") & ~has("shorttitle") & ~has("subtitle") & kind & keeps, F.concat(latex.words(val("title")).cast("string"), F.lit(" words: "), F.substring(val("title"), 1, 40)))


RULES["shorttitle-missing"] = lambda: _missing(False)
RULES["shorttitle-missing-REVIEW"] = lambda: _missing(True)


@rule("range-punctuation")
def _():
    each = [F.when(val(k).rlike("--|[\u2010-\u2015]"), F.concat(F.lit(f"{k}="), F.substring(val(k), 1, 40))) for k in RANGE_FIELDS]
    return F.array_compact(F.array(*each))


@rule("forbidden-field")
def _():
    return F.transform(F.filter("fields", lambda x: x["key"].isin(*FORBIDDEN)), lambda x: x["key"])


@rule("keywords-present(DECISION)")
def _():
    return once(has("keywords"))


def url_is_earned() -> Column:
    """Whether an entry's url is the locator that would be printed."""
    online = F.col("etype").isin("inreference", "reference") & F.coalesce(F.lower(F.trim(val("entrysubtype"))) == "online", F.lit(False))
    return (F.col("etype") == "online") | online | ~(has("date") | has("year")) | ~has("doi")


@rule("url-misplaced")
def _():
    return once(has("url") & ~url_is_earned(), F.concat(F.col("etype"), F.lit(", has doi")))


@rule("online-without-url")
def _():
    return once((F.col("etype") == "online") & ~has("url"))


@rule("undated-no-urldate")
def _():
    return once(~has("date") & ~has("urldate"), F.col("etype"))


def _range(key: str) -> tuple[Column, Column]:
    """Whether the whole value is a numeric range, and its width."""
    v = val(key)
    width = F.regexp_extract(v, _WHOLE_RANGE, 2).try_cast("bigint") - F.regexp_extract(v, _WHOLE_RANGE, 1).try_cast("bigint")
    return F.coalesce(v.rlike(_WHOLE_RANGE), F.lit(False)), width


def _numbering(label: str) -> Column:
    out = []
    for k in ("volume", "number"):
        is_range, width = _range(k)
        wide = ~has("pages") & (width >= 3)
        kind = {"range-in-numbering-field": is_range & wide, "number-range(double-issue?)": is_range & ~wide & F.lit(k == "number"), "volume-range-REVIEW": is_range & ~wide & F.lit(k == "volume")}[label]
        out.append(F.when(F.coalesce(kind, F.lit(False)), F.concat(F.lit(f"{k}="), F.trim(val(k)))))
    return F.array_compact(F.array(*out))


@rule("range-in-count-field")
def _():
    return once(_range("volumes")[0], F.concat(F.lit("volumes="), F.trim(val("volumes"))))


for _label in ("range-in-numbering-field", "number-range(double-issue?)", "volume-range-REVIEW"):
    RULES[_label] = lambda label=_label: _numbering(label)


@rule("numeric-issuetitle(rotation?)")
def _():
    show = lambda k: F.concat(F.lit(f"{k}="), F.coalesce(F.trim(val(k)), F.lit("-")))
    return once(val("issuetitle").rlike(r"^\s*\d+\s*$"), F.concat_ws(" ", *map(show, ("issuetitle", "volume", "number", "pages"))))


@rule("doubled-text-in-title")
def _():
    keys = ("title", "subtitle", "booktitle", "booksubtitle")
    each = [F.when(F.coalesce(latex.repeated_run(F.regexp_replace(val(k), r"[{}\\]", " ")), F.lit(False)), F.concat(F.lit(f"{k}: "), F.substring(val(k), 1, 60))) for k in keys]
    return F.array_compact(F.array(*each))


@rule("series-carries-division")
def _():
    return once(latex.unwrap(val("series")).rlike(_DIVISION), F.substring(val("series"), 1, 60))


@rule("number-duplicated-in-series")
def _():
    return once((F.trim(val("number")) != "") & F.contains(val("series"), F.trim(val("number"))), F.substring(val("number"), 1, 20))


@rule("missing-stamps")
def _():
    return once(~has("date-added") | ~has("date-modified"))


@rule("field-name-casing")
def _():
    return F.slice(F.transform(F.filter("fields", lambda x: x["name"] != x["key"]), lambda x: x["name"]), 1, 1)


@rule("foreign-text-in-title(langid?)")
def _():
    t = F.trim(val("title"))
    whole = t.startswith("\\foreignlanguage{") & (latex.unwrap(t) != t)
    return once(~has("langid") & t.contains("\\foreignlanguage"), F.concat(F.when(whole, "whole title").otherwise("embedded phrase"), F.lit(": "), F.substring(val("title"), 1, 44)))


def substantive_non_ascii(v: Column) -> Column:
    """Characters beyond ASCII that bear on the language."""
    return F.regexp_replace(F.translate(v, TYPOGRAPHIC, ""), "[\\x00-\\x7F]", "")


@rule("non-ascii-no-langid")
def _():
    rest = substantive_non_ascii(val("title"))
    cond = ~has("langid") & ~val("title").contains("\\foreignlanguage") & (rest != "") & ~latex.looks_english(val("title"), ENGLISH_WORDS)
    return once(cond, F.concat(F.substring(F.array_join(F.array_sort(F.array_distinct(F.split(rest, ""))), ""), 1, 12), F.lit(" | "), F.substring(val("title"), 1, 40)))


@rule("ligature-artefact")
def _():
    return per_field(lambda v: v.rlike("[\ufb00-\ufb06\u0132\u0133]"), _BASE + "|keywords)")


@rule("unbalanced-delimiter")
def _():
    count = lambda v, c: F.length(v) - F.length(F.replace(v, F.lit(c), F.lit("")))

    def kind(o: str, c: str) -> Column:
        return per_field(lambda v: count(v, o) != count(v, c), _BASE + "|keywords|annote)", lambda x: F.concat(x["key"], F.lit(f": {o}{c}")))

    return F.concat(kind("(", ")"), kind("[", "]"))


_ACCENT = r"""\\["'`^~=.]\{?[A-Za-z]\}?"""
_IMPOSSIBLE = r"""\\"\{?[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]\}?"""


def _accents(impossible: bool) -> Column:
    # every match, told apart by whether it is a diaeresis on a consonant
    found = per_match(_ACCENT, _BASE + "|annote)")
    return F.filter(found, lambda m: m.rlike(_IMPOSSIBLE + "$") if impossible else ~m.rlike(_IMPOSSIBLE + "$"))


RULES["accent-macro"] = lambda: _accents(False)
RULES["accent-macro-IMPOSSIBLE"] = lambda: _accents(True)


@rule("macro-missing-argument")
def _():
    return per_match(r"\\foreignlanguage\{[a-zA-Z]+\}(?!\{)", _BASE + "|keywords)")


@rule("undefined-macro")
def _():
    return per_match(rf"\\({'|'.join(BIBSTRINGS)})\{{", _BASE + ")", 1)


@rule("raw-quotes-in-title")
def _():
    return once(val("title").rlike(r"""(?<![A-Za-z])['"]""") & ~val("title").contains("\\mkbibquote"), F.substring(val("title"), 1, 50))


@rule("no-date")
def _():
    return once(~has("date") & ~has("year"), F.col("etype"))


def with_profiles(entries: DataFrame) -> DataFrame:
    """Entries with the profile of each title-like field."""
    for k in SUBTITLE_OF:
        entries = entries.withColumn(f"p_{k}", latex.profile(F.col("f")[k]))
    return entries


def findings(entries: DataFrame, only: list[str] | None = None, keep: tuple[str, ...] = ("doc", "ord", "citekey")) -> DataFrame:
    """(keep..., rule, detail) of every rule over entries (etype, citekey, fields, f)."""
    def labelled(label: str) -> Column:
        return F.transform(RULES[label](), lambda d: F.struct(F.lit(label).alias("rule"), d.alias("detail")))

    each = [labelled(k) for k in (only or RULES)]
    # the outer explode keeps the optimiser from adding filters that would evaluate all rules again
    e = with_profiles(entries).select(*keep, F.explode_outer(F.concat(*each)).alias("x")).filter("x IS NOT NULL")
    return e.select(*keep, "x.rule", "x.detail")


def by_rule(found: DataFrame) -> DataFrame:
    """Findings per rule, most frequent first."""
    return found.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def samples(found: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` findings of every rule in file order."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule").orderBy("doc", "ord", "detail")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
