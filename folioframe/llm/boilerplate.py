"""Page boilerplate mixed with main content: keep the main body of each page.

A streaming event parser of the standard library reads the page once and gives, for every line,
its text and the number of tags. The text-to-tag ratio of a line is its text length over its tags.
Pages whose markup is already gone have no tags; there the corpus tells what was furniture, and its
traces count like tags. The ratios are smoothed with a Gaussian over neighbouring lines and
clustered by a threshold into content and furniture regions; a line that carries tags or traces of
its own never counts as content, however good its neighbourhood.

What the corpus tells, from counts over all distinct pages and without any list of words:

* a piece (a line, or a part of it between separators) on a share of all pages, or of the pages of
  one host, is furniture; the share divides the two clusters of page counts, and is ``SHARE`` at least;
* a shared line that mostly stands right before running text is a section heading, and stays;
* a shared line that mostly stands after the text and before lines that no other page has is the
  head of a list of other pages, which goes with it;
* a line made of shared pieces (menus, breadcrumbs) is furniture.

At most ``pieces per page / SHARE`` pieces qualify, whatever the size of the corpus; that bounded
list is what the workers receive. The pieces of a host meet its pages by a join.

``body_lines`` alone, on a page without a corpus, has a seed of words and wordings instead
(``seeds``); ``main_body`` does not use it.

Defined results: null or empty text: no rows; a page without a main body: no rows; lines are
counted from 1 with the blank ones; a page of one line without furniture: that line; ties at the
threshold count as content; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.session import cut

#: Least share of the pages from which a piece counts as shared, and the least number of such pages.
SHARE, LEAST_PAGES = 0.01, 8
#: The same on the distinct pages of one host, and tasks over which the pages of a host are spread.
HOST_SHARE, HOST_PAGES, SALT = 0.25, 5, 16
#: Share of a shared line's occurrences before running text from which it is a heading, and of those after
#: the text and before a line of its own from which it is the head of a list of other pages.
HEADING_SHARE, LIST_SHARE = 0.7, 0.6
#: Width of the Gaussian in lines, and the smoothed ratio from which a line is content.
SIGMA, THRESHOLD = 1.5, 5.0
#: Characters from which a line counts as running text.
RUNNING = 60

# Fixed values, the seed for single pages: words of menus in four languages.
MENU_WORDS = """
home|about|about us|contact|contact us|help|search|sign in|sign out|log in|login|register|subscribe|journals|books|authors
collections|current issue|archive|archives|events|news|alerts|submit|browse|editorial board|menu|sitemap|faq|careers|press|shop|cart|basket
startseite|anmelden|abmelden|archiv|neuerscheinungen|kontakt|hilfe|suche|bücher|zeitschriften|aktuelles|über uns|warenkorb|impressum
datenschutz|agb|autoren|veranstaltungen|abonnieren|accueil|connexion|aide|recherche|revues|livres|panier|abonnement|auteurs|actualités
mentions légales|confidentialité|à propos|inicio|revistas|novedades|libros|buscar|cesta|contacto|archivo|autores|suscripción|ayuda|acceder
aviso legal|privacidad|terms of use|privacy|privacy policy|accessibility|cookies|cookie policy|terms|imprint|legal notice
share|teilen|partager|compartir|zitieren|citer|citar|cite this article|export citation|add to favourites|email a friend|print|download pdf
pdf herunterladen|télécharger le pdf|descargar pdf|advertisement|anzeige|publicité|publicidad|follow us|folgen sie uns|suivez-nous|síganos
back to top|nach oben|haut de page|volver arriba|skip to main content|zum inhalt springen|aller au contenu|saltar al contenido
accept all|reject all|manage preferences|alle akzeptieren|alle ablehnen|nur notwendige|einstellungen|tout accepter|tout refuser|aceptar todo|rechazar
sign up for the newsletter|enter your email address|next|previous|permissions|full text|references|metrics
""".strip().replace("\n", "|").split("|")  # fmt: skip
# Heads of lists of other pages.
OTHER_PAGES = """
related articles|related content|you may also like|you might also like|recommended for you|most read|most cited|more from this issue|trending
ähnliche beiträge|meistgelesen|das könnte sie auch interessieren|articles similaires|les plus lus|à lire aussi|artículos relacionados|lo más leído|también te puede interesar
""".strip().replace("\n", "|").split("|")  # fmt: skip
# Wordings of banners, notices and footers, each tested on a whole line.
WORDINGS = [
    r"(?:we use|this (?:site|website|page) (?:uses|stores)|some features (?:need|require)|by continuing|wir (?:verwenden|nutzen)|mit der weiteren nutzung|diese (?:seite|website) (?:verwendet|nutzt)|nous utilisons|ce site (?:utilise|conserve)|este sitio (?:usa|utiliza|guarda)|utilizamos|usamos)\b.{0,80}\b(?:cookies?|small files|kleiner? dateien|petits fichiers|pequeños archivos)\b.*",
    r"your privacy matters\b.*|we value your privacy\b.*",
    r"(?:©|\(c\)|copyright)\s*(?:\d{4}|\w).*|.{0,60}\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\.?",
    r"powered by \S.{0,40}",
    r"(?:views|downloads|aufrufe|vues|visitas|hits)\s*:\s*[\d.,]+.*",
    r"listen to this (?:page|article)\b.*",
    r"you have \d+ free articles?\b.*|please (?:sign|log) in\b.*|.{0,40}available to subscrib\w+ .{0,30}only\.?|checking your browser\b.*|(?:enable|turn on) javascript\b.*",
    r"(?:sign up|subscribe|register) (?:for|to) (?:our|the) .{0,40}|enter your e-?mail\b.*|join [\d.,]+ readers\b.*",
    r"would your library\b.*|recommend this title\b.*|need help\?.*|\d{4} .{1,40} is a registered charity\b.*|.{0,30}\bregistered charity\b.{0,40}\breaders\.?",
    r"(?:our )?(?:summer|winter|spring|autumn) sale\b.*|open positions in our\b.*|looking for older volumes\?.*|the publishers thank all\b.*",
    r"(?:accept|reject|manage|alle|nur|tout|aceptar)\b[^.]{0,40}\|.*",
]

_MENU = frozenset(w.strip() for w in MENU_WORDS)
_OTHER = frozenset(w.strip() for w in OTHER_PAGES)
_WORDING = re.compile("|".join(f"(?:{w})" for w in WORDINGS), re.I)
_SEPARATORS = re.compile(r"\s+[|·>»/•‹›]+\s+|\s*\|\s*")
_CRUMBS = re.compile(r"^[^.?!]{1,60}(?:\s[>»/›]\s[^.?!>»/]{1,80})+(?:\s[>»/›]\s(?:vol|no|bd|t)\.?\s*\d+)$", re.I)
_DIGITS = re.compile(r"\d+")
_APART = re.compile(r"\s+[^\w\s]\s+|\s*\|\s*")
_ENDS = tuple(".?!:;\"”»")
#: Words of the longest piece that is looked for in a line of pieces without separators.
PIECE_WORDS = 4
_MARKUP = re.compile(r"<[a-zA-Z/!][^>]*>")
_LONGEST = max(len(w.split()) for w in _MENU)
_SKIPPED = frozenset(("script", "style", "noscript", "template"))
_CHROME = frozenset(("nav", "header", "footer", "aside", "form", "button", "menu", "select"))


class _Events(HTMLParser):
    """Text and tag count of every line, in one pass over the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: dict[int, list[str]] = {}
        self.tags: dict[int, int] = {}
        self.chromed: set[int] = set()
        self.skip = self.chrome = 0

    def _tag(self, n: int = 1) -> None:
        line = self.getpos()[0]
        self.tags[line] = self.tags.get(line, 0) + n

    def handle_starttag(self, tag, attrs):
        self._tag()
        self.skip += tag in _SKIPPED
        self.chrome += tag in _CHROME

    def handle_endtag(self, tag):
        self._tag()
        self.skip = max(0, self.skip - (tag in _SKIPPED))
        self.chrome = max(0, self.chrome - (tag in _CHROME))

    def handle_comment(self, data):
        self._tag()

    def handle_data(self, data):
        if self.skip:
            return
        first = self.getpos()[0]
        for i, piece in enumerate(data.split("\n")):
            if piece.strip():
                self.text.setdefault(first + i, []).append(piece)
                if self.chrome:
                    self.chromed.add(first + i)


def lines_and_tags(text: str) -> list[tuple[str, int, bool]]:
    """(text, tags, in page chrome) of every line, in order; lines are pieces between line feeds."""
    raw = text.split("\n")
    if not _MARKUP.search(text):
        return [(line, 0, False) for line in raw]
    p = _Events()
    p.feed(text)
    p.close()
    return [(" ".join(p.text.get(i + 1, [])), p.tags.get(i + 1, 0), i + 1 in p.chromed) for i in range(len(raw))]


def _menu_only(line: str) -> bool:
    """Whether the line consists of menu words, with separators or with spaces only."""
    parts = [p.strip() for p in _SEPARATORS.split(line) if p.strip()]
    if all(p in _MENU for p in parts):
        return bool(parts)
    if len(parts) > 1 and sum(p in _MENU for p in parts) * 2 > len(parts):
        return True
    words = line.split()
    if len(words) > 40:
        return False
    reach = [True] + [False] * len(words)
    for i in range(len(words)):
        if reach[i]:
            for n in range(1, min(_LONGEST, len(words) - i) + 1):
                reach[i + n] = reach[i + n] or " ".join(words[i : i + n]) in _MENU
    return reach[-1]


def masked(line: str) -> str:
    """A line as it is compared between pages: digits are one."""
    return _DIGITS.sub("9", line.strip())


def of_pieces(line: str, shared: frozenset[str]) -> bool:
    """Whether a line consists of shared pieces, with separators (half of three and more will do) or with spaces only."""
    if not shared:
        return False
    parts = [p for p in (masked(p) for p in _APART.split(line.strip())) if p]
    if len(parts) > 1:
        known = sum(p in shared for p in parts)
        return known == len(parts) or (len(parts) > 2 and 2 * known >= len(parts))
    words = masked(line).split()
    if not 1 < len(words) <= 40:
        return False
    reach = [True] + [False] * len(words)
    for i in range(len(words)):
        if reach[i]:
            for n in range(1, min(PIECE_WORDS, len(words) - i) + 1):
                reach[i + n] = reach[i + n] or " ".join(words[i : i + n]) in shared
    return reach[-1]


def traces(line: str, shared: frozenset[str], seeds: bool = True) -> int:
    """Traces of furniture in one line of text, counted like tags."""
    low = line.strip().lower()
    n = 0
    if seeds and (_WORDING.fullmatch(low) or _menu_only(low) or low in _OTHER):
        n += 4
    if seeds and _CRUMBS.match(line.strip()):
        n += 4
    if masked(line) in shared or of_pieces(line, shared):
        n += 4
    return n


def body_lines(text: str | None, title: str | None = None, shared: frozenset[str] = frozenset(), heads: frozenset[str] = frozenset(), headings: frozenset[str] = frozenset(), seeds: bool = True) -> list[int]:
    """Numbers of the lines of the main body; ``heads`` begin lists of other pages, ``headings`` sections."""
    if not text:
        return []
    parsed = [(i + 1, t.strip(), tags, chrome) for i, (t, tags, chrome) in enumerate(lines_and_tags(text)) if t.strip()]
    if not parsed:
        return []
    lines = [(no, t, tags) for no, t, tags, _ in parsed]
    evidence = [4 * chrome + (0 if masked(t) in headings else traces(t, shared, seeds)) for _, t, _, chrome in parsed]
    # a list of other pages: its head and the titles and teasers below it
    inside = False
    for k, (_, t, _) in enumerate(lines):
        if masked(t) in heads or (seeds and t.lower() in _OTHER):
            inside = True
        elif inside:
            ends = t.endswith(_ENDS) and not t.endswith("...")
            if evidence[k] or (ends and len(t) >= RUNNING):
                inside = False
            else:
                evidence[k] += 4
        if t.endswith("…") and k and evidence[k - 1]:
            evidence[k] += 4
    name = (title or "").strip().lower()
    ratio = [0.0 if e >= 4 else min(len(t), 200) / max(1, tags) for (_, t, tags), e in zip(lines, evidence)]
    ratio = [max(r, float(RUNNING)) if name and t.lower() == name and e < 4 else r for r, (_, t, _), e in zip(ratio, lines, evidence)]
    reach = math.ceil(3 * SIGMA)
    kernel = [math.exp(-0.5 * (d / SIGMA) ** 2) for d in range(-reach, reach + 1)]
    total = sum(kernel)
    out = []
    running = any(len(t) >= RUNNING and r >= THRESHOLD for (_, t, _), r in zip(lines, ratio)) or any(r >= RUNNING for r in ratio)
    for k, (no, t, _) in enumerate(lines):
        if evidence[k] >= 4:
            continue
        smooth = sum(w * ratio[k + d] for d, w in zip(range(-reach, reach + 1), kernel) if 0 <= k + d < len(ratio)) / total
        if (smooth >= THRESHOLD and running) or len(lines) == 1:
            out.append(no)
    return out


def _trimmed(text: str = "text") -> Column:
    """Lines of a page that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _masked(x: Column) -> Column:
    return F.regexp_replace(x, "[0-9]+", "9")


def host_counts(pages: DataFrame) -> DataFrame:
    """(host, piece, n): distinct pages of each host that have a piece, a line or a part of one between separators."""
    line = F.expr(r"flatten(transform(l, x -> if(x rlike '\\s[^\\w\\s]\\s|[|]', array_append(split(x, '(?U)\\s+[^\\w\\s]\\s+|\\s*[|]\\s*'), x), array(x))))")
    told = pages.filter("text IS NOT NULL").select("host", F.xxhash64("text").alias("page"), _trimmed().alias("l"))
    pieces = told.select("host", "page", F.explode(F.array_distinct(F.transform(line, lambda x: _masked(F.trim(x))))).alias("piece")).filter("piece <> ''")
    return pieces.groupBy("host", "piece").agg(F.countDistinct("page").alias("n"))


def _divide(bins: list[tuple[int, int]]) -> int:
    """Bin that divides a histogram into the two clusters with the least spread inside."""
    total, whole = sum(n for _, n in bins), sum(k * n for k, n in bins)
    best, at, w, s = 0.0, 0, 0, 0
    for k, n in sorted(bins)[:-1]:
        w, s = w + n, s + k * n
        spread = w * (total - w) * (s / w - (whole - s) / (total - w)) ** 2
        if spread > best:
            best, at = spread, k
    return at


def shared_pieces(counts: DataFrame, n_pages: int, share: float = SHARE, least: int = LEAST_PAGES) -> frozenset[str]:
    """Pieces on so many pages that they are furniture or headings; a bounded list.

    One map-side aggregation over the counts; only the pieces above the share, at most
    ``pieces per page / share`` of them, reach the driver.
    """
    total = counts.groupBy("piece").agg(F.sum("n").alias("n"))
    bins = total.groupBy(F.floor(4 * F.log2("n")).cast("int").alias("k")).agg(F.sum("n").alias("n")).collect()  # four for each doubling
    wanted = max(least, math.ceil(share * n_pages), 2 ** ((_divide([(r.k, r.n) for r in bins]) + 1) / 4))
    return frozenset(r.piece for r in total.filter(F.col("n") >= wanted).select("piece").collect())


def roles(pages: DataFrame, shared: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """(headings, heads) among the shared lines: section headings, and heads of lists of other pages."""
    if not shared:
        return frozenset(), frozenset()
    known = pages.sparkSession.createDataFrame([(x,) for x in sorted(shared)], "line string")
    last = F.array([F.lit(e) for e in _ENDS])
    runs = lambda x: (F.length(x) >= RUNNING) & F.array_contains(last, F.right(x, F.lit(1))) & ~F.endswith(x, F.lit("..."))
    l = pages.filter("text IS NOT NULL").select(_trimmed().alias("l")).withColumn("first_run", F.array_position(F.transform("l", runs), True))  # noqa: E741
    at = l.select(F.posexplode("l").alias("i", "x"), "l", "first_run").withColumn("next", F.get("l", F.col("i") + 1)).filter("next IS NOT NULL")
    at = at.select(_masked(F.col("x")).alias("line"), _masked(F.col("next")).alias("next_line"), (F.length("next") > RUNNING).alias("text_next"), (~runs(F.col("next"))).alias("short_next"), ((F.col("first_run") > 0) & (F.col("first_run") <= F.col("i"))).alias("after"))
    at = at.join(F.broadcast(known), "line").join(F.broadcast(known.select(F.col("line").alias("next_line"), F.lit(True).alias("known_next"))), "next_line", "left")  # bounded: see shared_pieces
    share = lambda c: F.avg(c.cast("int"))
    found = at.groupBy("line").agg(share(F.col("text_next")).alias("heading"), share(F.col("short_next") & F.col("known_next").isNull()).alias("own"), share(F.col("after")).alias("after")).collect()
    headings = frozenset(r.line for r in found if r.heading >= HEADING_SHARE and len(r.line) <= RUNNING and not r.line.endswith(_ENDS) and len(_APART.split(r.line)) == 1)
    return headings, frozenset(r.line for r in found if r.own >= LIST_SHARE and r.after >= LIST_SHARE) - headings


def main_body(pages: DataFrame, seeds: bool = False) -> DataFrame:
    """(content_id, line_no, line) of the main body of every web page."""
    counts = cut(host_counts(pages))
    sizes = cut(pages.filter("text IS NOT NULL").select("host", F.xxhash64("text").alias("page")).groupBy("host").agg(F.countDistinct("page").alias("pages")))
    shared = shared_pieces(counts, sizes.agg(F.sum("pages")).first()[0] or 0)
    headings, heads = roles(pages, shared)
    # at most ``pieces per page / HOST_SHARE`` for each host
    of_host = counts.filter(F.col("n") >= HOST_PAGES).join(sizes, "host").filter(F.col("n") >= HOST_SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("piece").alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, nos, kept, own = [], [], [], {}
            for cid, text, title, host, of_host in zip(b["content_id"], b["text"], b["title"], b["host"], b["lines"]):
                if not text:
                    continue
                if host not in own:
                    own[host] = shared if of_host is None else shared.union(of_host)
                lines = text.split("\n")
                for no in body_lines(text, title, own[host], heads, headings, seeds):
                    ids.append(cid)
                    nos.append(no)
                    kept.append(lines[no - 1].strip())
            yield pd.DataFrame({"content_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(nos, dtype="int32"), "line": pd.Series(kept, dtype=object)})

    salted = of_host.select("host", "lines", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = pages.filter("text IS NOT NULL").select("content_id", "text", F.col("metadata")["Title"].alias("title"), "host", F.pmod(F.xxhash64("content_id"), F.lit(SALT)).cast("int").alias("salt"))
    rows = rows.join(salted, ["host", "salt"], "left").select("content_id", "text", "title", "host", "lines")
    return rows.mapInPandas(run, "content_id bigint, line_no int, line string")


def web_pages(source_content: DataFrame) -> DataFrame:
    """(content_id, text, metadata, host) of the web pages; a table without hosts gives null ones."""
    host = F.col("host") if "host" in source_content.columns else F.lit(None).cast("string").alias("host")
    return source_content.filter("label = 'webpage'").select("content_id", "text", "metadata", host)
