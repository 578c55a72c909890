"""Variant spellings of names typed by people: link the variants of one person or organisation.

All matching is done on *distinct* tokens and distinct spellings, so a name that holds a third of
the rows costs as much as a rare one; rows are met again only when the links are expanded.

1. The first-named author of every record is split off, and each distinct spelling is parsed into
   family and given names, or into the words of an organisation. A spelling without a comma may be
   read in more than one way; the reading that other spellings bear out is taken.
2. A symmetric-delete neighbourhood index over distinct tokens (each token with one letter deleted,
   long ones with two) finds the tokens within a small edit distance by an equi-join.
3. Spellings whose family names are equal or neighbours and that share a given name, its neighbour,
   a name it is short for, or an initial are candidates; their given names are aligned by optimal
   assignment, which permits initials, nicknames and abbreviations. Family and given names may
   change places where there is no comma, given names may change places among themselves.
4. Connected components of the links are the entities. Spellings with a middle name, without one and
   with initials or a nickname only are grouped apart and then joined: a middle initial that is seen
   once or twice is a slip of the group without one; otherwise the group without a middle name joins
   the one group with one that it fits, and none of several. Initials and nicknames join the entity
   they fit, and none where there are several of like weight.
5. Pairs of records of one entity with different letters come out, formed in blocks.

A slip of the pen rarely changes the first letter, and two different names of one length are often
two letters apart, the more so the more names there are: tokens shorter than ``LONG`` are neighbours
at one edit only, and a changed first letter counts only where two whole given names are equal.

Defined results: null, empty or blank authors, and authors without a letter, are no rows; equal
spellings are no pair; repeated rows pair like any others; names of any number of tokens are aligned
in full; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import permutations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.operators.packed import ORG_KIND, first_name
from folioframe.session import cut

#: Tokens from ``SHORT`` letters on may be one edit apart, tokens from ``LONG`` on two.
SHORT, LONG, EDITS = 4, 12, 2
#: Two given names a letter apart are two names if both are seen this often, neither ``RATIO`` times as often as the other.
SETTLED, RATIO = 20, 8
#: Rows up to which a group with a middle initial is a slip of the group without, and weight from which one of several entities is taken.
SLIPS, DOMINANT = 2, 4
PAIR_BLOCK = 256
#: Letters at the beginning of a token that the delete index covers.
INDEXED = 8
#: Distance of neighbours whose first letters differ.
FIRST = 3

PARTICLES = frozenset("de la di da du del della van von der den zu ter le les dos das af av".split())
# Given names and their short forms; a short form may stand for several names.
_SHORT_FORMS = """
aleksandr: alex, sasha, sascha | alexander: alex, sasha, sandy | alexandra: alex, sasha, sandra | amanda: mandy | andreas: andy, andi | andrew: andy, drew
anthony: tony | antonia: toni | barbara: babs | benjamin: ben, benny | catherine: cathy, kate | charles: charlie, chuck | christina: tina, chris | christine: chris, tina
christopher: chris, topher | daniel: dan, danny | david: dave | deborah: debbie | dmitri: dima, mitya | dolores: lola | donald: don | dorothea: thea, dora, dorle, dotty
dorothy: dot, dotty, dolly | edward: ed, eddie, ned, ted | elizabeth: liz, beth, lizzie, betty, eliza, lisa | francisco: paco, pancho | frederica: rica, ricki, fred
frederick: fred, freddy | friedrich: fritz | gabriela: gabi, gaby | giovanni: gianni, nino | gregory: greg | henry: harry, hank | jacob: jake | james: jim, jimmy
jennifer: jenny | johannes: hans, jan | john: jack, johnny | jose: pepe | josef: sepp | joseph: joe, joey | josephine: jo, josie | katherine: kate, kathy, katie
kenneth: ken | lawrence: larry | leonard: len, leo, lenny | margaret: peggy, meg, maggie | matthias: matt | matthew: matt | maximilian: max | michael: mike, mick
nadia: nadja | nicholas: nick, nicky | patricia: pat, patty, trish | patrick: pat, paddy | philip: phil | rebecca: becky | richard: dick, rick, rich | robert: bob, rob, bobby, bert
ronald: ron | samuel: sam, sammy | samantha: sam | stephen: steve | stephane: steph | susanna: sue, susie, susan | tamara: tammy, toma | theodora: thea, dora
theodore: ted, theo, teddy | thomas: tom, tommy | ulrich: uli | valentina: val, vale, tina | victor: vic | victoria: vicky, vic, tori | viktor: vic | william: bill, will, billy, liam
zachary: zach, zack
"""
# Short forms of words in names of organisations.
SHORT_WORDS = {
    "dept": "department", "dep": "department", "inst": "institute", "assoc": "association", "assn": "association", "ctr": "centre", "center": "centre",
    "soc": "society", "comm": "commission", "cmsn": "commission", "natl": "national", "univ": "university", "acad": "academy", "lib": "library",
    "stds": "standards", "std": "standards", "softw": "software", "eng": "engineering", "engg": "engineering", "appl": "applied", "math": "mathematics",
    "maths": "mathematics", "mus": "music", "educ": "education", "hist": "history", "hlth": "health", "pub": "public", "publ": "public", "ind": "industry",
    "coast": "coastal", "rur": "rural", "theat": "theatre", "theater": "theatre", "bd": "board", "govt": "government", "intl": "international",
}
_STOP = frozenset("the of for on and in at a an".split())
_ORG = re.compile(rf"(?i)\b{ORG_KIND}(?=[\s.,)]|$)")
_ORG_PREP = re.compile(r"(?i)\b(?:of|for|on)\b")
_ACRONYM = re.compile(r"^(?:The\s+)?([A-Z]{2,6})[,\s]+\(?([^\W\d_][\w'-]{3,})\)?$")
_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "0": "o", "1": "l", "’": "'"})
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_WORDS = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


@lru_cache(maxsize=131072)
def skeleton(token: str) -> str:
    """Letters of a token as they are compared: no accents, no case, common confusions undone."""
    t = unicodedata.normalize("NFKD", token.casefold().translate(_SPECIAL))
    t = "".join(c for c in t if c.isalnum())
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("aa", "a"), ("vv", "w")):
        t = t.replace(a, b)
    return t


#: Letter pairs that scanners take for one letter, behind the first letter of a token.
SCANNED = (("rn", "m"), ("li", "h"), ("cl", "d"))


def shape(token: str) -> str:
    """A skeleton as a scanner would see it."""
    head, t = token[:1], token[1:]
    for a, b in SCANNED:
        t = t.replace(a, b)
    return head + t


def _senses() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for line in re.split(r"[|\n]", _SHORT_FORMS):
        full, _, short = line.partition(":")
        for w in short.split(","):
            if w.strip():
                out[skeleton(w.strip())] = (*out.get(skeleton(w.strip()), ()), skeleton(full.strip()))
    return out


#: Short form -> the names it may stand for, all as skeletons.
NICKNAMES = _senses()


@lru_cache(maxsize=16384)
def edits(a: str, b: str, most: int = EDITS) -> int:
    """Edit distance with neighbour swaps, or ``most + 1`` if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
        if min(last) > most:
            return most + 1
    return min(last[-1], most + 1)


def reach(token: str, long: int = LONG) -> int:
    """Edits allowed for a token."""
    return EDITS if len(token) >= long else 1 if len(token) >= SHORT else 0


def near(a: str, b: str) -> bool:
    """Whether two given names are within reach, one of three letters of one of four included, or look alike to a scanner."""
    few = 1 if min(len(a), len(b)) == 3 < max(len(a), len(b)) else min(reach(a), reach(b))
    return edits(a, b) <= few or (min(len(a), len(b)) >= SHORT and shape(a) == shape(b))


def deletes(token: str) -> list[str]:
    """The token's beginning and all forms of it with up to ``reach`` letters deleted.

    Two tokens within reach share a form of their beginnings, so the index needs no more of a
    long token; what else shares a form is dropped by the comparison of the whole tokens.
    """
    out = level = {token[:INDEXED]}
    for _ in range(reach(token)):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return sorted(out)


class Parsed(NamedTuple):
    """A spelling: kind is 'person', 'org', 'short' (acronym and place) or ''; words are the given names or the words of an organisation."""

    kind: str
    family: str
    words: list[str]
    parts: list[str] = []  # of a family name of several parts
    others: list[tuple[str, list[str], list[str]]] = []  # other readings: family, parts, words
    comma: bool = False


def parse(name: str, person: bool = False) -> Parsed:
    """The parts of a spelling; ``person`` says that it is no acronym: AH Solvenmoor is then A. H. Solvenmoor."""
    m = _ACRONYM.match(name)
    if m and len(m[2]) > 4 and not person and not _ORG.search(name):
        return Parsed("short", m[1].lower(), [skeleton(m[2])])
    if (_ORG_PREP.search(name) or name.count(" ") > 2) and _ORG.search(name):
        words = []
        for t in _TOKEN.findall(name.replace("'", "")):
            low = t.casefold()
            low = SHORT_WORDS.get(low, low)
            if low not in _STOP:
                words.append(skeleton(low))
        return Parsed("org", "", words)
    head, comma, tail = name.partition(",")
    shout = name.isupper()
    if comma:
        fam, giv = _plain(_tokens(head)), _plain(_tokens(tail))
        return _person(fam, giv, [], shout, bool(giv))
    words = _plain(_tokens(head))
    if len(words) > 1 and _is_initials(words[-1]) and len(words[0][0]) > 2:
        k = len(words)
        while k > 1 and _is_initials(words[k - 1]):
            k -= 1
        return _person(words[:k], words[k:], [], shout)
    n = len(words)
    others = []
    if n > 1 and len(words[0][0]) > 3 and not _is_initials(words[0]):
        others.append((words[:1], words[1:]))
    if n > 2 and len(words[-2][0]) > 3:
        others.append((words[-2:], words[:-2]))
    return _person(words[n - 1 :], words[: n - 1], others, shout)


def _plain(words: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Without the particles, unless there is nothing else."""
    return [w for w in words if w[0].casefold() not in PARTICLES] or words[-1:]


def _family(words: list[tuple[str, bool]]) -> tuple[str, list[str]]:
    parts = [x for t, _ in words for x in (skeleton(p) for p in t.split("-")) if x]
    return "".join(skeleton(t) for t, _ in words), parts if len(parts) > 1 else []


def _given(words: list[tuple[str, bool]], shout: bool) -> list[str]:
    out: list[str] = []
    for word, dotted in words:
        for t in word.split("-"):
            if 1 < len(t) <= 3 and t.isupper() and len(words) == 1 and not dotted and not shout:
                out += [c.lower() for c in t]  # EN: two initials
            elif s := skeleton(t):
                out.append(s)
    return out


def _person(fam: list, giv: list, others: list, shout: bool, comma: bool = False) -> Parsed:
    family, parts = _family(fam)
    if not family:
        return Parsed("", "", [])
    more = [(*_family(f), _given(g, shout)) for f, g in others]
    return Parsed("person", family, _given(giv, shout), parts, [x for x in more if x[0] and x[2]], comma)


def _tokens(text: str) -> list[tuple[str, bool]]:
    return [(m[0], text[m.end() : m.end() + 1] == ".") for m in _WORDS.finditer(text)]


def _is_initials(word: tuple[str, bool]) -> bool:
    t, dotted = word
    return len(t) == 1 or (not dotted and len(t) <= 3 and t.isupper() and len(t) > 1)


def _same(a: str, b: str) -> float:
    """How well two given names agree: 1 equal, 0.9 short form, 0.8 near, 0.7 initial, 0 not at all."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.7 if a[0] == b[0] or a in {x[0] for x in NICKNAMES.get(b, ())} or b in {x[0] for x in NICKNAMES.get(a, ())} else 0.0
    if a in NICKNAMES.get(b, ()) or b in NICKNAMES.get(a, ()):
        return 0.9
    return 0.8 if near(a, b) else 0.0


def assign(a: list[str], b: list[str]) -> float:
    """Mean value of the best assignment of the shorter list's tokens to the longer's; 0 if one stays alone."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.5
    value = [[_same(x, y) for y in b] for x in a]
    if len(b) <= 3:
        best = max((sum(v) for p in permutations(range(len(b)), len(a)) if all(v := [value[i][j] for i, j in enumerate(p)])), default=0.0)
        return best / len(a)
    picked = _optimal([[-v if v else float(len(a) + 1) for v in row] for row in value])
    values = [value[i][j] for i, j in enumerate(picked)]
    return sum(values) / len(a) if all(values) else 0.0


def _optimal(cost: list[list[float]]) -> list[int]:
    """Column of every row in the cheapest assignment (no more rows than columns), by shortest augmenting ways."""
    n, m = len(cost), len(cost[0])
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while row_of[j0]:
            used[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def compatible(ga: list[str], gb: list[str], d: int = 0) -> bool:
    """Whether the given names of two spellings with family names ``d`` apart may be one person's."""
    if not ga or not gb:
        return False
    if d == FIRST:
        return ga == gb and len(ga) > 1 and len(ga[1]) > 1
    if _same(ga[0], gb[0]):
        return assign(ga, gb) > 0.0
    # given names in another order: all of them, and none by an initial
    return d == 0 and len(ga) == len(gb) > 1 and assign(ga, gb) >= 0.8 and all(len(x) > 1 for x in ga + gb)


_STRINGS = T.ArrayType(T.StringType())


def letters_of(name: str) -> str:
    """Letters and digits of a name in their order, lower case; accents are part of the letter."""
    return "".join(c for c in unicodedata.normalize("NFC", name).lower() if c.isalnum() or unicodedata.category(c)[0] == "M")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_READING = _struct(family=T.StringType(), parts=_STRINGS, given=_STRINGS)
_PARSED = _struct(kind=T.StringType(), family=T.StringType(), words=_STRINGS, parts=_STRINGS, others=T.ArrayType(_READING), comma=T.BooleanType(), letters=T.StringType())


def _parse_all(names: pd.Series, person: bool) -> pd.DataFrame:
    rows = [parse(n, person) if n else Parsed("", "", []) for n in names]
    return pd.DataFrame({
        "kind": [r.kind for r in rows], "family": [r.family for r in rows], "words": [r.words for r in rows], "parts": [r.parts for r in rows],
        "others": [[{"family": f, "parts": p, "given": g} for f, p, g in r.others] for r in rows], "comma": [r.comma for r in rows], "letters": [letters_of(n) for n in names],
    })


@F.pandas_udf(_PARSED)
def _parsed(names: pd.Series) -> pd.DataFrame:
    return _parse_all(names, False)


@F.pandas_udf(_PARSED)
def _parsed_person(names: pd.Series) -> pd.DataFrame:
    return _parse_all(names, True)


@F.pandas_udf(T.BooleanType())
def _compatible(ga: pd.Series, gb: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([a is not None and compatible(list(a), list(b), int(e)) for a, b, e in zip(ga, gb, d)], dtype=bool)


def delete_forms(token: str = "t") -> Column:
    """``deletes`` as an expression."""
    one = "transform(sequence(1, length({0})), i -> concat(left({0}, i - 1), substring({0}, i + 1)))"
    begin = f"left({token}, {INDEXED})"
    first = one.format(begin)
    second = f"flatten(transform({first}, q -> {one.format('q')}))"
    return F.expr(f"array_distinct(CASE WHEN length({token}) >= {LONG} THEN concat(array({begin}), {first}, {second}) WHEN length({token}) >= {SHORT - 1} THEN concat(array({begin}), {first}) ELSE array({begin}) END)")


def _replaced(expr: str) -> str:
    for a, b in SCANNED:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


def neighbours(tokens: DataFrame) -> DataFrame:
    """(kind, x, y, d) of the distinct tokens (kind, t) of one kind within reach of each other, both ways, itself included; d is the edits, or ``FIRST``.

    Forms are compared by a hash; both sides of the self-join are one shuffle, and the distances are
    settled in the JVM.
    """
    scanned = "concat(left({0}, 1), " + _replaced("substring({0}, 2)") + ")"
    forms = F.concat(delete_forms(), F.array(F.concat(F.lit("="), F.expr(scanned.format("t")))))
    keys = tokens.filter(F.length("t") >= SHORT - 1).select("kind", "t", F.explode(F.transform(forms, lambda f: F.xxhash64("kind", f))).alias("k"))
    other = keys.select(F.col("kind").alias("kind2"), F.col("t").alias("u"), "k")
    pairs = keys.join(other, "k").filter("t < u AND kind = kind2").select("kind", "t", "u").distinct()
    small, large = "least(length(t), length(u))", "greatest(length(t), length(u))"
    swap = "length(t) = length(u) AND exists(sequence(1, length(t) - 1), i -> concat(left(t, i - 1), substring(t, i + 1, 1), substring(t, i, 1), substring(t, i + 2)) = u)"
    short = f"{small} >= {SHORT} OR (kind = 'g' AND {large} >= {SHORT})"
    # as a generated row, so that the distance is computed once for the test and for the result
    d = f"""CASE WHEN (lev = 1 OR (lev = 2 AND {swap})) AND ({short}) THEN IF(left(t, 1) = left(u, 1), 1, {FIRST})
        WHEN lev = 2 AND {small} >= {LONG} AND left(t, 1) = left(u, 1) THEN 2
        WHEN {small} >= {SHORT} AND {scanned.format("t")} = {scanned.format("u")} THEN 1 END"""
    near = pairs.select("kind", "t", "u", F.expr("explode(array(levenshtein(t, u, 2)))").alias("lev")).select("kind", "t", "u", F.expr(f"explode(array({d}))").alias("d")).filter("d IS NOT NULL")
    both = near.select("kind", F.explode(F.array(F.struct(F.col("t").alias("x"), F.col("u").alias("y")), F.struct(F.col("u").alias("x"), F.col("t").alias("y")))).alias("p"), "d").select("kind", "p.x", "p.y", "d")
    return both.unionByName(tokens.select("kind", F.col("t").alias("x"), F.col("t").alias("y"), F.lit(0).alias("d")))


def hubs(counted: DataFrame, near: DataFrame) -> DataFrame:
    """(t, hub) of the tokens in ``counted`` (t, n) with a neighbour that is twice as frequent: the most frequent such."""
    x = counted.select(F.col("t").alias("x"), F.col("n").alias("nx"))
    y = counted.select(F.col("t").alias("y"), F.col("n").alias("ny"))
    c = near.filter("x <> y").join(x, "x").join(y, "y").filter("ny >= 2 * nx")
    return c.groupBy(F.col("x").alias("t")).agg(F.max_by("y", F.struct("ny", "y")).alias("hub"))


def first_names(bib_entry: DataFrame, source_content: DataFrame) -> DataFrame:
    """(record_id, name): the first-named author of every record that has one."""
    rows = bib_entry.select(F.col("entry_id").alias("record_id"), F.col("author").alias("value")).unionByName(
        source_content.select(F.col("content_id").alias("record_id"), F.col("metadata")["Author"].alias("value"))
    )
    # as a generated row, so that the name is split off once, not for the test and for the result
    named = rows.filter("value IS NOT NULL").select("record_id", F.explode(F.array(first_name("value"))).alias("name"))
    return named.filter("name IS NOT NULL")


def ascended(up: DataFrame) -> DataFrame:
    """(node, comp): the end of the way up from every node of ``up`` (a, b), by doubling of the steps.

    Every spelling points to its most frequent neighbour, or to itself, so ways have no circles. Each
    round doubles twice and is written; it was the last if its second doubling moved no pointer.
    """
    step = cut(up)
    while True:
        for _ in range(2):
            ahead = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
            step = step.alias("p").join(ahead, "b").select("a", F.col("c").alias("b"), (F.col("c") != F.col("b")).alias("moved"))
        step = cut(step)
        if step.filter("moved").isEmpty():
            return step.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def components(links: DataFrame, up: DataFrame) -> DataFrame:
    """(node, comp) of the connected components of ``links`` (a, b); ``up`` (a, b) is a way to begin with from every node.

    Links inside a way go at once; what joins two ways is few, and each round joins every way's end to
    the greatest end it is linked to. It ends when no link joins two.
    """
    comp = tops = ascended(up)
    while True:
        of_a, of_b = tops.select(F.col("node").alias("a"), F.col("comp").alias("ca")), tops.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        across = links.join(of_a, "a").join(of_b, "b").filter("ca <> cb")
        both = F.explode(F.array(F.struct(F.col("ca").alias("a"), F.col("cb").alias("b")), F.struct(F.col("cb").alias("a"), F.col("ca").alias("b"))))
        links = cut(across.select(both.alias("l")).select("l.a", "l.b").distinct())
        if links.isEmpty():
            return comp
        tops = ascended(links.groupBy("a").agg(F.max("b").alias("b")).select("a", F.greatest("a", "b").alias("b")))
        comp = cut(comp.join(tops.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))


def read_people(parsed: DataFrame) -> DataFrame:
    """(name, n, family, parts, given) of the spellings of people, each in the reading that others bear out.

    Names with a comma say which given and family names there are. A spelling without one takes the
    reading whose family and first given name stand together with a comma elsewhere, else the one
    whose given name is the most frequent there, else the usual one; all orders of the same tokens
    take the same reading.
    """
    sure, free = parsed.filter("size(others) = 0"), parsed.filter("size(others) > 0")
    said = parsed.filter("comma").select("family", F.col("words")[0].alias("g0"), "n")
    together = said.groupBy("family", "g0").agg(F.sum("n").alias("together"))
    alone = said.groupBy("g0").agg(F.sum("n").alias("alone"))
    usual = F.array(F.struct("family", "parts", F.col("words").alias("given")))
    free = free.select("name", "n", F.concat_ws(" ", F.array_sort(F.split(F.lower("name"), "[^\\p{L}\\p{N}\\p{M}]+"))).alias("bag"), F.concat(usual, "others").alias("rs"))
    read = free.select("bag", "n", F.posexplode("rs").alias("pos", "r")).select("bag", "r", "r.family", F.col("r.given")[0].alias("g0"), F.when(F.col("pos") == 0, F.col("n")).otherwise(0).alias("votes"))
    read = read.join(together, ["family", "g0"], "left").join(alone, "g0", "left")
    best = F.struct(F.coalesce("together", F.lit(0)), F.when(F.length("g0") > 1, F.coalesce("alone", F.lit(0))).otherwise(0), "votes", "family")
    chosen = read.groupBy("bag").agg(F.max_by("r", best).alias("r"))
    free = free.join(chosen, "bag").select("name", "n", "r.family", "r.parts", "r.given")
    return sure.select("name", "n", "family", "parts", F.col("words").alias("given")).unionByName(free)


def given_keys(sigs: DataFrame, near: DataFrame) -> DataFrame:
    """(g0, key, later): what a first given name may meet: itself, the names it is short for, its neighbours and its initials."""
    counted = sigs.filter("length(g0) > 1").groupBy("g0").agg(F.sum("n").alias("n"))
    full = F.coalesce(F.element_at(_senses_map(), F.col("g0")), F.expr("cast(array() as array<string>)"))
    own = counted.select("g0", F.explode(F.array_distinct(F.concat(F.array("g0"), full, F.transform(F.concat(F.array("g0"), full), lambda x: F.concat(F.lit("."), F.substring(x, 1, 1)))))).alias("key"))
    x = near.filter("x <> y AND d < 3").select(F.col("x").alias("g0"), F.col("y").alias("key")).join(counted, "g0")
    both = x.join(counted.select(F.col("g0").alias("key"), F.col("n").alias("m")), "key")
    # two names that are both common are two names, however near
    slips = both.filter(f"least(n, m) < {SETTLED} OR greatest(n, m) >= {RATIO} * least(n, m)").select("g0", "key")
    return own.unionByName(slips)


def _senses_map() -> Column:
    return F.create_map(*(x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def person_entities(sigs: DataFrame, near: DataFrame) -> DataFrame:
    """(sig, comp) of the distinct readings (sig, family, parts, given, g0, k, n); ``near`` holds the neighbours of family ('f') and given names ('g')."""
    of = lambda kind: near.filter(F.col("kind") == kind).drop("kind")
    initial = F.concat(F.lit("."), "g0")
    keys = given_keys(sigs, of("g"))
    # a family name of two parts is also met under each of them
    part = sigs.filter("size(parts) > 1").select(F.col("family").alias("x"), F.explode("parts").alias("y")).distinct()
    fam = of("f").unionByName(part.select("x", "y", F.lit(1).alias("d"))).unionByName(part.select(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(1).alias("d")))
    one = sigs.select(F.col("sig").alias("a"), F.col("family").alias("x"), F.col("given").alias("ga"), F.col("k").alias("ka"), F.when(F.length("g0") < 2, initial).otherwise(F.col("g0")).alias("g"))
    side = [F.col("sig").alias("b"), F.col("family").alias("y"), F.col("given").alias("gb"), F.col("k").alias("kb"), F.col("n").alias("nb")]
    two = (
        sigs.join(keys, "g0").select(*side, F.col("key").alias("g"), F.lit(False).alias("later"))
        .unionByName(sigs.filter("length(g0) < 2").select(*side, initial.alias("g"), F.lit(False).alias("later")))
        .unionByName(sigs.filter("size(given) > 1 AND length(g0) > 1").select(*side, F.explode(F.filter(F.slice("given", 2, 1_000_000), lambda w: F.length(w) > 1)).alias("g"), F.lit(True).alias("later")))
    )
    pairs = one.join(fam, "x").join(two, ["y", "g"])
    # what the keys have settled is not aligned again: equal names, and names of which one has nothing but what they share
    settled = F.expr(f"d < {FIRST} AND (ga = gb OR (NOT later AND (size(ga) = 1 OR size(gb) = 1)))")
    first = F.expr("ga = gb AND size(ga) > 1 AND length(ga[1]) > 1")
    no = F.expr(f"(later AND (d > 0 OR size(ga) <> size(gb))) OR (size(ga) = 2 AND size(gb) = 2 AND NOT later AND left(ga[1], 1) <> left(gb[1], 1))")
    ask = ~settled & ~no & (F.col("d") < FIRST)
    fits = F.when(settled, True).when(F.col("d") == FIRST, first).when(no, False).otherwise(_compatible(*(F.when(ask, F.col(c)) for c in ("ga", "gb", "d"))))
    cand = cut(pairs.filter((F.col("a") == F.col("b")) | fits).select("a", "b", "d", "ka", "kb", "nb"))
    links = cand.filter("a = b OR (ka = kb AND (ka > 0 OR d <= 1))")
    top = links.groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("b"))
    comp = components(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), top)
    comp = cut(comp.join(sigs.select(F.col("sig").alias("node"), "n", "k"), "node"))
    weight = comp.groupBy("comp").agg(F.sum("n").alias("w"))
    sides = cand.filter("ka <> kb AND greatest(ka, kb) > 0").select(*(F.when(F.col("ka") < F.col("kb"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("ka", "kb", "ka"))), "d")
    sides = sides.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    sides = cut(sides.groupBy("ka", "ca", "cb").agg(F.min("d").alias("d")).join(weight.select(F.col("comp").alias("ca"), F.col("w").alias("wa")), "ca").join(weight.select(F.col("comp").alias("cb"), F.col("w").alias("wb")), "cb"))
    # without and with a middle name: rare middle initials are slips of the group without, else that group joins the only one it fits
    middle = sides.filter("ka = 1").withColumn("slip", F.expr(f"wb <= {SLIPS} AND wa > wb"))
    slip = middle.filter("slip").groupBy("cb").agg(F.min_by("ca", F.struct("d", -F.col("wa"), "ca")).alias("up")).select(F.col("cb").alias("comp"), "up")
    heavy = middle.filter("NOT slip").groupBy("ca").agg(F.count("*").alias("c"), F.min("cb").alias("cb")).filter("c = 1").select(F.col("ca").alias("comp"), F.col("cb").alias("up"))
    tops = comp.select("comp").distinct().join(slip.withColumnRenamed("up", "u1"), "comp", "left")
    tops = tops.select("comp", F.coalesce("u1", "comp").alias("mid")).join(heavy.select(F.col("comp").alias("mid"), F.col("up").alias("u2")), "mid", "left").select("comp", F.coalesce("u2", "mid").alias("top"))
    tops = cut(tops)
    # initials and nicknames: the nearest entity, if it is the only one or outweighs the others
    fit = sides.filter("ka < 1").join(tops.select(F.col("comp").alias("cb"), "top"), "cb").groupBy("ca", "top").agg(F.min("d").alias("d"), F.sum("wb").alias("wb"))
    placed = (
        fit.groupBy("ca").agg(F.min("d").alias("near")).join(fit, "ca").filter("d = near").groupBy("ca")
        .agg(F.max_by("top", F.struct("wb", "top")).alias("place"), F.max("wb").alias("most"), F.sum("wb").alias("all"), F.count("*").alias("c"))
        .filter(f"c = 1 OR most >= {DOMINANT} * (all - most)").select(F.col("ca").alias("comp"), "place")
    )
    final = tops.join(placed, "comp", "left").select("comp", F.coalesce("place", "top").alias("entity"))
    return comp.join(final, "comp").select(F.col("node").alias("sig"), "entity")


def organisation_entities(parsed: DataFrame, hub: DataFrame) -> DataFrame:
    """(name, entity) of the spellings of organisations: the sorted words, misspelt words replaced."""
    words = parsed.select("name", "kind", F.col("family").alias("letters"), "n", F.posexplode("words").alias("i", "t"))
    fixed = cut(words.join(hub, "t", "left").withColumn("w", F.coalesce("hub", "t")))
    # a word that is the beginning of a frequent longer one is its abbreviation
    vocabulary = fixed.groupBy("w").agg(F.sum("n").alias("c"))
    longer = vocabulary.select(F.col("w").alias("v"), "c", F.substring("w", 1, 3).alias("p"))
    abbr = (
        vocabulary.filter("length(w) BETWEEN 3 AND 6").select("w", F.col("c").alias("cw"), F.substring("w", 1, 3).alias("p")).join(longer, "p")
        .filter("length(v) > length(w) + 1 AND startswith(v, w) AND c > cw").groupBy("w").agg(F.max_by("v", F.struct("c", "v")).alias("v"))
    )
    fixed = fixed.join(abbr, "w", "left").withColumn("w", F.coalesce("v", "w"))
    keyed = fixed.groupBy("name", "kind", "letters").agg(
        F.array_sort(F.collect_set("w")).alias("set"), F.sort_array(F.collect_list(F.struct("i", "w"))).alias("seq")
    )
    full = keyed.filter("kind = 'org'").withColumn("key", F.concat_ws(" ", "set"))
    last = F.element_at("seq", -1)["w"]
    initials = F.concat_ws("", F.transform(F.slice("seq", 1, F.size("seq") - 1), lambda s: F.substring(s["w"], 1, 1)))
    short_of = full.filter("size(seq) > 2").select("key", initials.alias("letters"), last.alias("place")).groupBy("letters", "place").agg(F.min("key").alias("key"), F.countDistinct("key").alias("k")).filter("k = 1")
    short = keyed.filter("kind = 'short'").select("name", "letters", F.col("set")[0].alias("place"))
    short = short.join(short_of.select("letters", "place", "key"), ["letters", "place"]).select("name", "key")
    return full.select("name", "key").unionByName(short).select("name", F.concat(F.lit("o:"), F.col("key")).alias("entity"))


def entities(names: DataFrame) -> DataFrame:
    """(name, entity, letters, n) of every distinct spelling in ``names`` (record_id, name)."""
    distinct = names.groupBy("name").agg(F.count("*").alias("n"))
    parsed = cut(distinct.withColumn("q", _parsed("name")).select("name", "n", "q.*").filter("letters <> ''"))
    orgs = parsed.filter("kind IN ('org', 'short')")
    vocabulary = orgs.select(F.explode("words").alias("t"), "n").filter("length(t) > 2").groupBy("t").agg(F.sum("n").alias("n"))
    orgs = cut(organisation_entities(orgs, hubs(vocabulary, neighbours(vocabulary.select(F.lit("o").alias("kind"), "t")))))
    # an acronym of no organisation stands for a person's initials
    rest = parsed.filter("kind = 'short'").join(orgs, "name", "left_anti").withColumn("q", _parsed_person("name")).select("name", "n", "q.*")
    people = read_people(parsed.filter("kind = 'person'").unionByName(rest))
    g0 = F.coalesce(F.get("given", F.lit(0)), F.lit(""))
    sig = F.concat_ws(" ", F.col("family"), F.lit("|"), F.concat_ws(" ", "given"))
    people = cut(people.select("name", "n", "family", "parts", "given", sig.alias("sig")))
    # -1: a nickname, 0: initials, 1: a given name, 2: with a middle name
    kind = F.when(g0.isin(list(NICKNAMES)), -1).when(F.length(g0) < 2, 0).when(F.size("given") == 1, 1).otherwise(2)
    sigs = cut(people.groupBy("sig", "family", "given").agg(F.sum("n").alias("n"), F.max("parts").alias("parts")).withColumns({"g0": g0, "k": kind}))
    tokens = sigs.select(F.explode(F.array(F.struct(F.lit("f").alias("kind"), F.col("family").alias("t")), F.struct(F.lit("g").alias("kind"), F.col("g0").alias("t")))).alias("x")).select("x.*").filter("t <> ''").distinct()
    linked = person_entities(sigs, cut(neighbours(tokens)))
    found = people.join(linked, "sig").select("name", F.concat(F.lit("p:"), "entity").alias("entity"))
    return found.unionByName(orgs).join(parsed.select("name", "letters", "n"), "name")


def linked_records(bib_entry: DataFrame, source_content: DataFrame) -> DataFrame:
    """(record_a, record_b): records led by one person or organisation under different letters."""
    names = cut(first_names(bib_entry, source_content))
    spelt = cut(entities(names))
    # only entities with several letterings have pairs; this is settled on the spellings, before any row is met
    many = spelt.groupBy("entity").agg(F.countDistinct("letters").alias("forms"), F.sum("n").alias("total")).filter("forms > 1").select("entity", "total")
    rows = names.join(spelt.join(many, "entity").select("name", "entity", "letters", "total"), "name")
    # members are numbered at random into blocks, and block i meets block j >= i
    blocks = F.ceil(F.col("total") / PAIR_BLOCK).cast("int")
    m = rows.select("entity", "record_id", "letters", blocks.alias("bs"), F.pmod(F.xxhash64("record_id"), blocks).cast("int").alias("blk"))
    left = m.select("entity", F.col("record_id").alias("ra"), F.col("letters").alias("la"), F.col("blk").alias("i"), F.explode(F.sequence(F.col("blk"), F.col("bs") - 1)).alias("j"))
    right = m.select("entity", F.col("record_id").alias("rb"), F.col("letters").alias("lb"), F.col("blk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"))
    pairs = left.join(right, ["entity", "i", "j"]).filter("la <> lb AND (i < j OR ra < rb)")
    return pairs.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))
