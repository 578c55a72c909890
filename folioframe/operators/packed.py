"""Several values packed in one field: one value per row, position kept.

The field is split on its quote characters (double quotes, braces and quoting apostrophes); the
odd pieces are literals and are put aside, the even pieces are split on the delimiters that the
field uses, and array folds put literals and pieces together again. Everything is a Catalyst
expression, so the operator is a narrow projection plus one ``explode``: no shuffle, no Python.

Defined results of the special cases:

* null, empty or blank field: no rows; a field with one value: one row with position 1;
* unbalanced quotes or braces: the characters are dropped and nothing is taken as a literal;
* empty pieces (doubled or trailing delimiters): not counted;
* closing words for further unnamed people (``et al.``, ``and others``): no value;
* input columns are passed through; the two new names are parameters so that they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES, TERMS = "names", "terms"

_OPEN, _CLOSE, _AND = "\ue000", "\ue001", "\ue002"

#: Words that mark an organisation (fixed values).
ORG_KIND = (
    r"(?:Department|Dept\.?|Institute|Inst\.?|Association|Assoc\.?|Centre|Center|Ctr\.?|Society|Soc\.?"
    r"|Commission|Comm\.?|Committee|Council|Academy|Acad\.?|University|Univ\.?|Board|Ministry|Office"
    r"|Bureau|Agency|College|School|Faculty|Foundation|Museum|Library|Laboratory|Federation|Union)"
)
_PREP = r"(?:of|for|on)"
_PARTICLE = r"(?:de la|van der|van den|von der|de|di|da|du|del|della|van|von|zu|ter|la|le)"
_BOUND = r"(?:^|[;|/\n]|,\s|\sand\s|\s&\s)"

#: ``and``/``&`` inside an organisation's name is no delimiter.
_PROTECT = [
    # Institute for Trade and Industry: no place seen yet, so the name goes on
    rf"(?i)({_BOUND}\s*(?:The\s+)?(?:National\s+|Nat'l\s+|Natl\.?\s+|Royal\s+)?{ORG_KIND}\s+{_PREP}\s+(?:(?!\sof\s|\sand\s|\s&\s)[^,;|/\n(])+)\s(?:and|(&))\s(?=\S)",
    # a single word to the right cannot be a name
    r"(?i)(\S)\s(?:and|(&))\s(?=[^\s,;|/&\n]+\s*(?:$|[;|/\n]|\sand\s|\s&\s))",
    # Music and Theatre, Institute for (Place)
    rf"(?i)({_BOUND}\s*[^\s,;|/&\n]+)\s(?:and|(&))\s(?=[^,;|/\n]+,\s*(?:National\s+)?{ORG_KIND}\s+{_PREP}\s*\()",
]
_ETAL = r"(?i)(?:[\s,;|/&]|\band\b)*(?:\bet\s+al\b\.?|\band\s+others\b\.?|\bund\s+andere\b|\bu\.\s?a\.|\by\s+otros\b|\bet\s+autres\b)\s*[;,.|]*\s*$"

_CLOSING = r"(?:al|others|andere|autres|otros|u\.\s?a)\b\.?[\s;,.|]*$"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_EDGE = _lit(" \t\n\r,;|\"{}")


def _edges(expr: str) -> str:
    """Without white space, stray delimiters or quotes at the ends."""
    return f"trim(BOTH {_EDGE} FROM {expr})"


def _clean(expr: str) -> str:
    """The final form of an item: each white-space run is one space, and clean edges."""
    return _edges(f"regexp_replace({expr}, {_lit(r'(?U)\s+')}, ' ')")


def _restore(expr: str) -> str:
    """Put the literals back: odd pieces of the split are their numbers."""
    return (
        f"IF(contains({expr}, '{_OPEN}'), array_join(transform(split({expr}, '[{_OPEN}{_CLOSE}]'), "
        f"(x, i) -> if(i % 2 = 1, get(pq.pieces, try_cast(x AS INT)), x)), ''), {expr})"
    )


def _name_segment(seg: str) -> str:
    """Split one segment without hard delimiters on its commas, where they separate names."""
    particle_last = rf"(?i)^(?:{_PARTICLE}\s+)*\S+$"
    initials = rf"(?i)^(?:\p{{L}}{{1,2}}\.[\s-]*)+(?:{_PARTICLE})?$"
    short_given = r"^\S+(?:\s+\S+)?$"
    org = rf"(?i)\b{ORG_KIND}(?:\s+{_PREP}\s|\s*$)|(?i)\b{_PREP}\s+\("
    commas = f"filter(transform(split({seg}, ','), x -> {_edges('x')}), x -> x != '')"
    pairs = "transform(sequence(0, size(c) - 2, 2), i -> concat(c[i], ', ', c[i + 1]))"
    odd = "filter(c, (x, i) -> i % 2 = 1)"
    even = "filter(c, (x, i) -> i % 2 = 0)"
    return (
        f"element_at(transform(array(named_struct('s', {seg}, 'c', {commas})), z -> CASE "
        f"WHEN size(z.c) < 2 OR z.s RLIKE {_lit(org)} THEN array(z.s) "
        f"WHEN size(z.c) = 2 THEN IF(inverted OR z.c[0] RLIKE {_lit(particle_last)} OR z.c[1] RLIKE {_lit(initials)} OR z.c[1] RLIKE '^[^ ]+$', array(z.s), z.c) "
        f"WHEN size(z.c) % 2 = 0 AND (forall({odd.replace('c,', 'z.c,')}, x -> x RLIKE {_lit(initials)}) "
        f"OR (forall({even.replace('c,', 'z.c,')}, x -> x RLIKE {_lit(particle_last)}) AND forall({odd.replace('c,', 'z.c,')}, x -> x RLIKE {_lit(short_given)}))) "
        f"THEN {pairs.replace('c[', 'z.c[').replace('size(c)', 'size(z.c)')} "
        f"ELSE z.c END), 1)"
    )


def first_name(col: str) -> Column:
    """The first of ``packed_items(col)``, null where there is none; what stands behind it is not taken apart."""
    # no delimiter, quote or closing words at all: one name
    single = (
        f"{col} NOT RLIKE {_lit(rf'[,;|/&"{{}}\n\r{_OPEN}{_CLOSE}{_AND}\']')} AND "
        f"{col} NOT RLIKE {_lit(rf'(?i)\sand\s|{_CLOSING}')}"
    )
    return F.expr(f"CASE WHEN {col} IS NULL THEN NULL WHEN {_plain(col)} THEN {_clean(f"split({col}, ' and ', 2)[0]")} WHEN {single} THEN nullif({_clean(col)}, '') ELSE get({_items(col, NAMES, True)}, 0) END")


def packed_items(col: str, kind: str = NAMES) -> Column:
    """``ARRAY<STRING>`` of the values in ``col``, in order; null for null, empty for blank text.

    ``kind`` is ``NAMES`` (people and organisations: ``and``, ``&`` and commas are delimiters only
    between names) or ``TERMS`` (subject terms: the strongest delimiter in the field counts, and a
    comma before a closing year belongs to the term).
    """
    full = _items(col, kind)
    if kind == NAMES:  # the most frequent form, "Last, First and Last, First", needs none of this
        full = f"IF({_plain(col)}, transform(split({col}, ' and '), x -> {_clean('x')}), {full})"
    return F.expr(f"IF({col} IS NULL, NULL, {full})")


def _plain(col: str) -> str:
    """Whether a field is "Last, First and Last, First" without anything else."""
    return (
        f"{col} NOT RLIKE {_lit('[;|/&\"{}\n\r]|\'|et al')} AND "
        f"forall(split({col}, ' and '), x -> x RLIKE {_lit(r'^\s*[^\s,]+,[^,]*[^,\s][^,]*$')})"
    )


def _items(col: str, kind: str, first: bool = False) -> str:
    """The values of any field; ``first`` leaves out the segments behind the first where that has a value of its own."""
    quoted = f"regexp_replace(regexp_replace({col}, {_lit(r'[{]+')}, '{{'), {_lit(r'[}]+')}, '}}')".replace("{{", "{").replace("}}", "}")
    # quoting apostrophes stand at the ends of a piece; an apostrophe inside a word stays
    apostrophes = rf"(^|[,;|/\n])(\s*)'([^'\n]+(?:'\w[^'\n]*)*)'(?=\s*(?:[,;|/\n]|$))"
    quoted = f"regexp_replace({quoted}, {_lit(apostrophes)}, '$1$2\"$3\"')"
    pieces = f"split({quoted}, {_lit('[\"{}]')})"
    masked = (
        "IF(size(p.pieces) % 2 = 0, array_join(p.pieces, ' '), array_join(transform(p.pieces, (x, i) -> "
        f"IF(i % 2 = 1, concat('{_OPEN}', CAST(i AS STRING), '{_CLOSE}'), x)), ''))"
    )
    if kind == NAMES:
        # each of the costly patterns runs only where a cheap one says that it may apply
        body = f"IF(m RLIKE {_lit('(?i)' + _CLOSING)}, regexp_replace(m, {_lit(_ETAL)}, ''), m)"
        # lines and tabs are white space next to "and", delimiters elsewhere; ", and" is "and"
        body = f"regexp_replace({body}, {_lit(r'(?i),?\s+(and|&)\s+|,(and|&)\s+(?=\S)')}, ' $1$2 ')"
        protected = "b"
        for pattern in _PROTECT:
            protected = f"regexp_replace({protected}, {_lit(pattern)}, '$1{_AND}$2{_AND}')"
        body = f"element_at(transform(array({body}), b -> IF(b RLIKE {_lit(r'(?i)\s(?:and|&)\s')} AND b RLIKE {_lit(rf'(?i)\b{ORG_KIND}[\s,)]')}, {protected}, b)), 1)"
        hard = f"split({body}, {_lit(r'(?i)[;|\n\r/]+|\s(?:and|&)\s')})"
        back = f"replace(replace(x, '{_AND}&{_AND}', ' & '), '{_AND}{_AND}', ' and ')"
        segs = f"filter(transform({hard}, x -> {_edges(back)}), x -> x != '')"
        quoted_list = f"IF(contains(x, '{_OPEN}'), split(x, {_lit(f'(?<={_CLOSE})\\s*,\\s*|\\s*,\\s*(?={_OPEN})|(?<={_CLOSE})\\s+(?={_OPEN})')}), array(x))"
        # "Last, First" elsewhere in the field: a comma in another segment is read likewise
        seen = rf"(?i)^(?:{_PARTICLE}\s+)*[^\s,]+,[^,]+$"
        taken = f"IF(get(segs, 0) RLIKE {_lit(r'\p{L}')} AND NOT contains(get(segs, 0), '{_OPEN}'), slice(segs, 1, 1), segs)" if first else "segs"
        items = (
            f"flatten(flatten(transform(array({segs}), segs -> transform(array(exists(segs, x -> x RLIKE {_lit(seen)})), inverted -> "
            f"flatten(transform({taken}, x -> flatten(transform({quoted_list}, y -> "
            f"IF(contains(y, '{_OPEN}') OR NOT contains(y, ','), array(y), {_name_segment('y')})))))))))"
        )
    else:
        body = "m"
        strong = (
            f"CASE WHEN {body} RLIKE {_lit(r'\|')} THEN split({body}, {_lit(r'\|')}) "
            f"WHEN {body} RLIKE ';' THEN split({body}, ';') "
            f"WHEN {body} RLIKE {_lit(r'\n')} THEN split({body}, {_lit(r'[\n\r]+')}) "
            f"WHEN {body} RLIKE {_lit(r'\s/\s')} THEN split({body}, {_lit(r'\s/\s')}) "
            f"ELSE split({body}, {_lit(r',(?!\s*\d{3,4}\s*(?:$|,))')}) END"
        )
        items = f"filter(transform({strong}, x -> {_edges('x')}), x -> x != '')"
    items = f"filter(transform({items}, x -> {_clean(_restore('x'))}), x -> x != '')"
    # one struct per stage, so that each stage is evaluated once per row
    full = (
        f"flatten(transform(array(named_struct('pieces', {pieces})), pq -> "
        f"flatten(transform(transform(array(pq), p -> {masked}), m -> {items}))))"
    )
    return full


def split_packed(df: DataFrame, value: str, kind: str = NAMES, pos: str = "item_pos", item: str = "item", at_least: int = 1) -> DataFrame:
    """One row per value packed in column ``value``, with its position from 1.

    ``at_least`` keeps only the fields that hold that many values.
    """
    items = df.withColumn("__items", packed_items(f"`{value}`", kind)).filter(F.size("__items") >= at_least)
    return items.select("*", F.posexplode("__items").alias("__pos", item)).withColumn(pos, (F.col("__pos") + 1).cast("int")).drop("__items", "__pos")


def packed_fields(bib_entry: DataFrame, source_content: DataFrame) -> DataFrame:
    """(record_id, field_key, kind, value): every field of the two tables that may hold several values."""
    bib = bib_entry.select(F.col("entry_id").alias("record_id"), F.lit("author").alias("field_key"), F.col("author").alias("value"))
    meta = source_content.select(
        F.col("content_id").alias("record_id"),
        F.explode(
            F.array(*(F.struct(F.lit(k.lower()).alias("field_key"), F.col("metadata")[k].alias("value")) for k in ("Author", "Editor", "Subject")))
        ).alias("f"),
    ).select("record_id", "f.field_key", "f.value")
    return bib.unionByName(meta).filter("value IS NOT NULL")


def split_fields(fields: DataFrame, at_least: int = 2) -> DataFrame:
    """Split names and terms in one pass; ``field_key = 'subject'`` holds terms."""
    # the branch on the kind is inside the expression, so the input is read once
    items = F.when(F.col("field_key") == "subject", packed_items("value", TERMS)).otherwise(packed_items("value", NAMES))
    out = fields.withColumn("items", items).filter(F.size("items") >= at_least)
    return out.select("record_id", "field_key", F.posexplode("items").alias("p", "item")).select(
        "record_id", "field_key", (F.col("p") + 1).cast("int").alias("item_pos"), "item"
    )
