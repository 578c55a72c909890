"""Layout-preserving rewrites of library entries.

Rewrites of one field are composed (split, then dashes), so no two edits meet on one span. Every
entry gives an array of edits and an array of reports in one projection; edits are code-point spans
of the document and are spliced by ``operators.render.apply_edits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import latex
from folioframe.operators.audit import has, url_is_earned, val, with_profiles
from folioframe.schema import DATE_FIELDS, EN_DASH_FIELDS, FORBIDDEN, SUBTITLE_OF

_EDIT = "struct<start:int,end:int,text:string,rule:string,key:string,before:string,after:string>"
_REPORT = "struct<label:string,excerpt:string>"
_DASH = r"\s*(?:--|[‐-―])\s*"
_RANGE = r"(?<![\d.-])(\d+)(\s*)-(\s*)(\d+)(?![\d.-])"


def fld(key: str) -> Column:
    """The first field with a key, with its spans; null if there is none."""
    return F.col("g")[key]


def _edit(cond: Column, start: Column, end: Column, text: Column, rule: str, key: str, before: Column, after: Column) -> Column:
    e = F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), F.lit(rule).alias("rule"), F.lit(key).alias("key"), before.alias("before"), after.alias("after")
    )
    return F.when(F.coalesce(cond, F.lit(False)), e)


def _replace(cond: Column, key: str, new: Column, rule: str) -> Column:
    return _edit(cond & (new != val(key)), fld(key)["vstart"], fld(key)["vend"], new, rule, key, val(key), new)


def on_own_line(key: str) -> Column:
    """Whether a field opens a line of its own; other layouts are not rewritten."""
    return fld(key)["lead"].rlike(r"^\n[ \t]*$")


def _remove(cond: Column, key: str, rule: str) -> Column:
    """Field with the comma before it, so that no two removals meet on one comma; null for an unknown layout."""
    f, cond = fld(key), cond & on_own_line(key)
    last = f["ord"] == F.size("fields") - 1
    return _edit(cond, f["start"] - 1, F.when(last, f["vend"] + 1).otherwise(f["end"]), F.lit(""), rule, key, val(key), F.lit(None).cast("string"))


def en_dashed(v: Column) -> Column:
    """Ascending numeric ranges with an en dash; others stay."""
    digits = lambda m, i: F.regexp_extract(m, r"(\d+)\s*-\s*(\d+)", i)
    # numbers of any length: without leading zeros the longer one is greater
    size = lambda m, i: F.regexp_replace(digits(m, i), r"^0+(?=\d)", "")
    rises = lambda m: (F.length(size(m, 2)) > F.length(size(m, 1))) | ((F.length(size(m, 2)) == F.length(size(m, 1))) & (size(m, 2) > size(m, 1)))
    # by match, not by text: what stands between the matches is kept as it is
    between = F.split(v, _RANGE, -1)
    ranges = F.regexp_extract_all(v, F.lit(_RANGE), F.lit(0))
    new = F.transform(ranges, lambda m: F.when(rises(m), F.concat(digits(m, 1), F.lit("--"), digits(m, 2))).otherwise(m))
    return F.when(v.rlike(_RANGE), F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(new, i), F.lit("")))), "")).otherwise(v)


def _split(parent: str) -> dict[str, Column]:
    """Parts of the split of one title-like field."""
    v, p = val(parent), F.col(f"p_{parent}")
    colon = F.instr(p["mask"], ": ")
    mark = F.regexp_instr(p["mask"], F.lit(rf"[?!](?=\s+[A-Z{latex.ESCAPED}])"))
    n = latex.top_colons(p)
    at_colon, at_mark = n == 1, (n == 0) & ~v.contains(": ") & (p["stop"] < 0) & (mark > 0) & (latex.terminal_marks(p) == 1)
    head = F.when(at_colon, F.regexp_replace(F.substring(v, F.lit(1), colon - 1), r"(?:[~\s]|\\[, ])+$", "")).otherwise(F.substring(v, F.lit(1), mark))
    tail = F.trim(F.when(at_colon, F.substring(v, colon + 1, F.length(v))).otherwise(F.substring(v, mark + 1, F.length(v))))
    able = has(parent) & on_own_line(parent) & ~has(SUBTITLE_OF[parent]) & (F.col("etype") != "review") & (at_colon | at_mark)
    whole = (head != "") & (tail != "")
    return {"do": F.coalesce(able & whole, F.lit(False)), "empty": able & ~whole, "head": head, "tail": tail, "n": n, "mark": mark}


def plan(entries: DataFrame, keep: tuple[str, ...] = ("doc", "ord", "citekey")) -> DataFrame:
    """(keep..., edits, reports) of every entry."""
    e = with_profiles(entries)
    edits: list[Column] = []
    reports: list[Column] = []

    def report(cond: Column, label: str, excerpt: Column) -> None:
        reports.append(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(label).alias("label"), F.substring(excerpt, 1, 70).alias("excerpt"))))

    split = {k: _split(k) for k in SUBTITLE_OF}
    review = F.col("etype") == "review"
    for k, sub in SUBTITLE_OF.items():
        s, v, p, f = split[k], val(k), F.col(f"p_{k}"), fld(k)
        rule = f"split-{k}"
        indent = f["lead"]
        name = F.when(f["name"] == f["key"], F.lit(sub)).otherwise(F.initcap(F.lit(sub)))
        edits.append(_edit(s["do"], f["start"], f["start"], F.concat(indent, name, F.lit(" = {"), en_dashed(s["tail"]), F.lit("},")), rule, sub, v, s["tail"]))
        edits.append(_edit(s["do"], f["vstart"], f["vend"], en_dashed(s["head"]), rule, k, v, s["head"]))
        open_ = has(k) & ~has(sub) & ~review
        report(has(k) & has(sub) & (s["n"] > 0), "subtitle-exists-but-parent-still-split", v)
        report(has(k) & ~has(sub) & review & (s["n"] > 0), "skipped-review-title", v)
        report(open_ & (s["n"] > 1), "skipped-multi-colon", v)
        report(open_ & (s["n"] == 0) & v.contains(": "), "colon-inside-macro-NOT-SPLIT", v)
        plain = open_ & (s["n"] == 0) & ~v.contains(": ")
        report(plain & (p["stop"] >= 0), "full-stop-boundary-REVIEW", v)
        report(plain & (p["stop"] < 0) & (s["mark"] > 0) & (latex.terminal_marks(p) > 1), "multi-terminal-mark-REVIEW", v)
        report(s["empty"], "skipped-empty-half", v)
        report(open_ & (s["n"] == 1) & ~on_own_line(k), "skipped-unparsable-layout", v)
    t = split["title"]
    done = t["do"] | has("subtitle")
    # after the split the title is its head, which has no boundary left
    verdict = F.when(t["do"], "redundant").otherwise(latex.shorttitle_verdict(F.col("etype"), val("title"), F.col("p_title"), has("subtitle")))
    both = has("shorttitle") & has("title")
    edits.append(_remove(both & (verdict == "redundant") & done, "shorttitle", "drop-shorttitle-after-split"))
    edits.append(_remove(both & (verdict == "redundant") & ~done, "shorttitle", "drop-shorttitle-redundant"))
    report(both & (verdict == "earned"), "shorttitle-earned-KEPT", val("title"))
    edits.append(_replace(has("pages"), "pages", F.regexp_replace(val("pages"), _DASH, "-"), "range-punctuation"))
    for k in DATE_FIELDS:
        edits.append(_replace(has(k), k, F.regexp_replace(val(k), _DASH, "/"), "date-range-solidus"))
    for k in EN_DASH_FIELDS:
        is_split = split[k]["do"] if k in split else F.lit(False)
        edits.append(_replace(has(k) & ~is_split, k, en_dashed(val(k)), "en-dash-numeric-range"))
        numbers = lambda i, k=k: F.regexp_extract(val(k), _RANGE, i).try_cast("bigint")
        report(has(k) & (numbers(4) <= numbers(1)), "hyphen-not-a-range-REVIEW", F.concat(F.lit(f"{k}: "), val(k)))
    for k in FORBIDDEN:
        edits.append(_remove(has(k), k, f"drop-{k}"))
        report(has(k) & ~on_own_line(k), "skipped-unparsable-layout", F.concat(F.lit(f"{k}: "), val(k)))
    url = F.trim(val("url"))
    mirrors = F.transform(F.filter("fields", lambda x: x["key"].rlike("^(bdsk-url|remote-url)")), lambda x: F.trim(x["value"]))
    mirrored = F.array_contains(mirrors, url)
    report(has("url") & ~url.rlike(r"^https?://\S"), "url-malformed-REVIEW", val("url"))
    report(has("url") & ~url_is_earned() & ~mirrored, "url-sole-copy-KEPT", val("url"))
    edits.append(_remove(has("url") & ~url_is_earned() & mirrored, "url", "drop-mirrored-url"))
    edits.append(_remove(has("url") & ~url_is_earned() & mirrored & has("urldate"), "urldate", "drop-orphaned-urldate"))
    from folioframe.operators.audit import _DIVISION

    report(latex.unwrap(val("series")).rlike(_DIVISION), "series-division-REVIEW", val("series"))
    return e.select(*keep, F.array_compact(F.array(*edits)).cast(f"array<{_EDIT}>").alias("edits"), F.array_compact(F.array(*reports)).cast(f"array<{_REPORT}>").alias("reports"))


def _rows(planned: DataFrame, column: str) -> DataFrame:
    """One row per element. The outer explode keeps the optimiser from adding filters that would evaluate the whole plan again."""
    out = planned.select("doc", "ord", "citekey", F.explode_outer(column).alias("x")).filter("x IS NOT NULL")
    return out.select("doc", "ord", "citekey", "x.*")


def edits_of(planned: DataFrame) -> DataFrame:
    """One row per edit, with the rewrite it is part of."""
    return _rows(planned, "edits")


def reports_of(planned: DataFrame) -> DataFrame:
    """One row per report."""
    return _rows(planned, "reports")


def counts_by_rule(edits: DataFrame) -> DataFrame:
    """Rewrites and touched entries per rule; a split is one rewrite of two edits."""
    one = edits.withColumn("what", F.when(F.col("rule").startswith("split-"), F.col("rule")).otherwise(F.concat_ws(":", "rule", "key")))
    return one.select("doc", "ord", "rule", "what").distinct().groupBy("rule").agg(F.count("*").alias("n_rewrites"), F.countDistinct("doc", "ord").alias("n_entries"))
