"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

Every text is cut into statements (sentences, title lines, annotation fields). A statement is a bag
of hashed words and word pairs; one linear classifier per area scores it. The weak labels come from
the documents' metadata (``META``: source, label, kind, and the journal or site named in a text),
as far as a value's given documents agree on an area, and from the areas given for some documents;
they spread from there: a word votes for the area that holds at least half of its occurrences, a statement takes
the area of its words' votes, and the words of a document's other statements learn from it, round
by round. Words without an area of their own (grammar, set phrases, names) never vote, so a
language that few given documents are in isn't drawn to their areas. The classifiers are fitted on
the statements labelled so; those without votes are negatives for every area. A document's share
of an area is the part of its classified statements that belongs to it; the share from which an
area is assigned is calibrated by the best F1 on the documents with given areas, of which one in
``HELD`` is held out of the fit and weighs accordingly, for each area beside the common one.

The fit uses a bounded sample (``FIT_DOCUMENTS``); all documents are classified. The weights have a
fixed size and are what the workers receive.

Defined results: null, empty and blank texts, and texts without a classified statement (noise):
no rows; documents with given areas are left to their given areas (no rows in ``found``); no given
areas at all: no rows; repeated texts get the same areas; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.confusables import plain_text

#: Documents that the classifiers are fitted on (given areas first), and the hashed width.
FIT_DOCUMENTS, WIDTH = 8_000, 1 << 18
#: One in so many of the documents with given areas is held out for the calibration.
HELD = 5
#: Columns whose values may give weak labels, the given documents a value needs for it and how many of them must agree.
META, META_GIVEN, META_AGREE = ("source", "label", "doc_kind"), 20, 0.8
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
#: Share of letters below which a text is noise; library files, with all their marks, have three quarters.
LETTERS = 0.7
#: Probability from which a statement counts for an area.
SURE = 0.5
#: Rounds in which labels spread, the smoothing of a word's areas and the share from which it votes.
ROUNDS, SMOOTH, PURE = 10, 1.0, 0.5
#: A word of more than this share of a language's documents belongs to no area (each of a dozen
#: areas has about a twelfth of the documents, and a word of it stands in some of those).
GRAMMAR = 0.15

_BROKEN = re.compile(r"(?<=[^\W\d_])[-­]\s*\n\s*(?=[^\W\d_])")
_HEAD = re.compile(r"^\s*(?:Author|Editor|Journal|Publisher|Volume|Vo1ume|Number|Pages|PublicationDate|Date|Language|Year|Location|SiteName)\s*[:=].*$", re.I | re.M)
_SITE = r"(?im)^\s*(?:Journal|SiteName|Publisher)\s*[:=]\s*(.+?)\s*$"
_STATEMENT = re.compile(r"(?<=[.?!])\s+|\n\s*\n|\n(?=\s*(?:@|\w+ = \{|Title:|Annotation))|\}\s*,")
_WORD = re.compile(r"[^\W\d_]{2,}")
_FOLD = str.maketrans({"c": "e", "1": "l", "0": "o", "ø": "o"})
_BLANK = re.compile(r"[\s​‌‍⁠﻿­]*")


def _fold(word: str) -> str:
    """A word as features see it: no accents, and letters that scans confuse made equal."""
    w = unicodedata.normalize("NFKD", word)
    return "".join(ch for ch in w if not unicodedata.combining(ch)).translate(_FOLD).replace("rn", "m")


def noise(text: str) -> bool:
    """Whether less than ``LETTERS`` of a text's visible characters are letters."""
    visible = "".join(text.split())
    return sum(map(str.isalpha, visible)) < LETTERS * len(visible)


def statements(text: str | None) -> list[list[int]]:
    """Hashed features of every statement of a text."""
    if not text or _BLANK.fullmatch(text) or noise(text):
        return []
    if not text.isascii():
        text = plain_text(text, "title")
    text = _HEAD.sub("\n\n", _BROKEN.sub("", text)).lower()
    text = re.sub(r"(?<=[^\W_])[10](?=[^\W\d_])", lambda m: "l" if m[0] == "1" else "o", text)
    out = []
    for piece in _STATEMENT.split(text):
        words = [_hash(w) for w in _WORD.findall(piece or "")]
        if len(words) < 2:
            continue
        feats = {w & _EVEN for w in words}  # words are even, pairs odd
        feats.update(((a * 0x9E3779B1 ^ b * 0x85EBCA6B) >> 7) & _EVEN | 1 for a, b in zip(words, words[1:]))
        out.append(sorted(feats))
    return out


_EVEN = WIDTH - 2


@lru_cache(maxsize=131072)
def _hash(word: str) -> int:
    return zlib.crc32(_fold(word).encode())


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their statement, both flat."""
    n = np.fromiter((len(r) for r in rows), dtype="int64", count=len(rows))
    flat = np.fromiter((f for r in rows for f in r), dtype="int64", count=int(n.sum()))
    return flat, np.repeat(np.arange(len(rows)), n)


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """(statement, area) probabilities of each one-versus-rest classifier."""
    if not rows:
        return np.zeros((0, len(bias)))
    n = np.fromiter((len(r) for r in rows), dtype="int64", count=len(rows))
    flat = np.fromiter((f for r in rows for f in r), dtype="int64", count=int(n.sum()))
    z = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)  # every statement has a feature
    return 1 / (1 + np.exp(-np.clip(z / np.sqrt(n)[:, None] + bias, -30, 30)))


def spread(docs: list[tuple[list[list[int]], set[int] | None]], k: int, langs: list[str | None] | None = None, weak: list[int | None] | None = None) -> list[np.ndarray]:
    """Weak labels: for every document the (statement, area) weights that its words' votes give.

    ``langs`` are the documents' languages as far as known; words that are common in any of them
    do not vote. ``weak`` are the areas that the metadata of documents speak for.
    """
    rows = [r for d, _ in docs for r in d]
    if not rows:
        return [np.zeros((0, k)) for _ in docs]
    n = np.array([len(d) for d, _ in docs])
    doc = np.repeat(np.arange(len(docs)), n)
    flat, of = _flat([[f for f in r if not f & 1] for r in rows])
    eligible = np.ones(WIDTH, dtype=bool)
    of_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs or []):
        if lang and docs[i][0]:
            of_lang.setdefault(lang, []).append(i)
    for members in of_lang.values():
        df = np.zeros(WIDTH)
        for i in members:
            df[list({f for r in docs[i][0] for f in r if not f & 1})] += 1
        eligible &= df <= max(3.0, GRAMMAR * len(members))
    allowed = np.ones((len(docs), k), dtype=bool)
    given = np.array([c is not None for _, c in docs])
    p = np.zeros((len(rows), k))
    for i, (_, c) in enumerate(docs):
        if c is not None:
            allowed[i] = False
            allowed[i, sorted(c)] = True
    p[given[doc]] = (allowed / allowed.sum(1, keepdims=True))[doc][given[doc]]
    for i, j in enumerate(weak or []):
        if j is not None and not given[i]:
            p[doc == i, j] = 0.5
    prior = np.maximum(p.sum(0), 1.0)
    prior /= prior.sum()
    for _ in range(ROUNDS):
        q = np.stack([np.bincount(flat, weights=p[of, j], minlength=WIDTH) for j in range(k)], 1)
        total = q.sum(1, keepdims=True)
        q = (q + SMOOTH * prior) / (total + SMOOTH)
        votes = np.where((q.max(1, keepdims=True) >= PURE) & (total > 0.4) & eligible[:, None], q, 0.0)
        z = np.stack([np.bincount(of, weights=votes[flat, j], minlength=len(rows)) for j in range(k)], 1)
        z = z**2
        # a document with given areas: votes for others count only where no word speaks for a given one
        inside = z * allowed[doc]
        z = np.where((inside.sum(1, keepdims=True) > 0.1 * z.sum(1, keepdims=True)) & given[doc][:, None], inside, z)
        voted = z.sum(1) > 0
        new = np.divide(z, z.sum(1, keepdims=True), out=np.zeros_like(z), where=voted[:, None])
        share = np.stack([np.bincount(doc, weights=new[:, j], minlength=len(docs)) for j in range(k)], 1)
        share = np.divide(share, share.sum(1, keepdims=True), out=np.zeros_like(share), where=share.sum(1, keepdims=True) > 0)
        guess = np.where(given[:, None], allowed / allowed.sum(1, keepdims=True), np.where(share.max(1, keepdims=True) >= 0.6, share, 0.0))
        p = np.where(voted[:, None], new, 0.5 * guess[doc])
    labels = np.where(voted[:, None], new, 0.0)
    return np.split(labels, np.cumsum(n)[:-1])


def fit(rows: list[list[int]], y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of one-versus-rest logistic classifiers for the columns of ``y`` by adaptive gradient steps."""
    k = y.shape[1]
    w, b = np.zeros((WIDTH, k), dtype="float32"), np.full(k, -1.0, dtype="float32")
    g2, gb2 = np.full((WIDTH, k), 1e-3, dtype="float32"), np.full(k, 1e-3, dtype="float32")
    rng, y = np.random.default_rng(seed), y.astype("float32")
    rows = [np.asarray(r, dtype="int64") for r in rows]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            idx = order[at : at + 256]
            part = [rows[i] for i in idx]
            n = np.array([len(r) for r in part])
            flat = np.concatenate(part)
            scale = np.sqrt(n).astype("float32")[:, None]
            z = np.add.reduceat(w[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / scale + b
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[idx]
            touched, inv = np.unique(flat, return_inverse=True)
            by_feature = np.argsort(inv, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(inv))[:-1]])
            g = np.add.reduceat(np.repeat(err / scale, n, axis=0)[by_feature], starts, axis=0) + DECAY * w[touched]
            g2[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(g2[touched])
            gb = err.sum(0)
            gb2 += gb * gb
            b -= RATE * gb / np.sqrt(gb2)
    return w, b


def shares(p: np.ndarray, sure: float = SURE) -> np.ndarray:
    """Part of the classified statements that belongs to each area; zeros if none is classified."""
    if not len(p):
        return np.zeros(p.shape[1])
    top = p.argmax(1)
    ok = p[np.arange(len(p)), top] >= sure
    s = np.bincount(top[ok], weights=p[np.arange(len(p)), top][ok], minlength=p.shape[1])
    return s / s.sum() if s.sum() else s


class Model:
    """Fitted areas, weights and the calibrated share of each area."""

    def __init__(self, areas: list[str], w: np.ndarray, b: np.ndarray, share: np.ndarray) -> None:
        self.areas, self.w, self.b, self.share = areas, w, b, share

    def areas_of(self, text: str | None) -> list[str]:
        return self.areas_of_all([text])[0]

    def areas_of_all(self, texts: list[str | None]) -> list[list[str]]:
        """Areas of every text; the statements of a few hundred texts are scored at once."""
        out = []
        for at in range(0, len(texts), 256):
            docs = [statements(t) for t in texts[at : at + 256]]
            p = probabilities(self.w, self.b, [r for d in docs for r in d])
            for part in np.split(p, np.cumsum([len(d) for d in docs])[:-1]):
                s = shares(part)
                out.append([a for a, x, t in zip(self.areas, s, self.share) if x >= t and x > 0])
        return out


def _best_share(given: list[set[int]], found: list[np.ndarray]) -> float:
    """Share with the best F1 on the documents with given areas; the middle of equally good ones."""
    grid = np.arange(0.10, 0.46, 0.01)
    f1 = []
    for t in grid:
        tp = fp = fn = 0
        for g, s in zip(given, found):
            got = {i for i, x in enumerate(s) if x >= t and x > 0}
            tp, fp, fn = tp + len(got & g), fp + len(got - g), fn + len(g - got)
        f1.append(2 * tp / max(1, 2 * tp + fp + fn))
    best = [t for t, v in zip(grid, f1) if v >= max(f1) - 1e-9]
    return float(np.median(best))


def _area_shares(given: list[set[int]], found: list[np.ndarray], k: int, common: float) -> np.ndarray:
    """The share of each area with its best F1; of equally good ones the nearest to the common one."""
    out = np.full(k, common)
    for j in range(k):
        best = -1.0
        for t in sorted(np.arange(0.10, 0.46, 0.01), key=lambda t: abs(t - common)):
            got = [s[j] >= t and s[j] > 0 for s in found]
            tp = sum(g and j in c for g, c in zip(got, given))
            f1 = 2 * tp / max(1, sum(got) + sum(j in c for c in given))
            if f1 > best + 1e-9:
                best, out[j] = f1, t
    # few documents say little about one area: halfway between its own share and the common one
    return (out + common) / 2


def weak_areas(meta: list[tuple], codes: list[set[int] | None]) -> list[int | None]:
    """The area that a document's metadata speak for: most given documents with one of its values have it."""
    count: dict[tuple, dict[int, int]] = {}
    total: dict[tuple, int] = {}
    for values, c in zip(meta, codes):
        for v in enumerate(values):
            if c and v[1]:
                total[v] = total.get(v, 0) + 1
                for j in c:
                    count.setdefault(v, {})[j] = count.get(v, {}).get(j, 0) + 1
    says = {v: j for v, n in total.items() if n >= META_GIVEN for j, m in count[v].items() if m >= META_AGREE * n and len(count[v]) < n}
    return [next((says[v] for v in enumerate(values) if v in says), None) for values in meta]


def train(documents: DataFrame, sample: DataFrame, bound: int = FIT_DOCUMENTS) -> Model | None:
    """Model from at most ``bound`` documents, those with given areas first."""
    spark = documents.sparkSession
    given = sample.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_code")).alias("codes"))
    n_given, n_all = given.count(), documents.count()
    if not n_given:
        return None
    part = lambda want, have: F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, want / max(1, have))))
    meta = F.array(*(F.col(c).cast("string") for c in META if c in documents.columns), F.nullif(F.regexp_extract("text", _SITE, 1), F.lit(""))).alias("meta")
    known = documents.join(given.filter(part(bound // 2, n_given)), "doc_id").select("doc_id", "lang", "text", meta, "codes")
    other = documents.join(given, "doc_id", "left_anti").filter(part(bound - min(n_given, bound // 2), n_all)).select("doc_id", "lang", "text", meta, F.lit(None).cast("array<string>").alias("codes"))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def feats(texts: pd.Series) -> pd.Series:
        return texts.map(statements)

    rows = known.unionByName(other).select("doc_id", "lang", "meta", "codes", feats("text").alias("rows")).toPandas()  # at most ``bound`` rows
    rows = rows.sort_values("doc_id")
    areas = sorted({c for cs in rows["codes"] if cs is not None for c in cs})
    of = {a: i for i, a in enumerate(areas)}
    docs = [([list(map(int, r)) for r in d], None if c is None else {of[x] for x in c}) for d, c in zip(rows["rows"], rows["codes"])]
    if len(areas) < 2:
        return None
    held = [i for i, (d, c) in enumerate(docs) if c is not None and d][::HELD]
    away = set(held)
    weak = weak_areas([tuple(m) for m in rows["meta"]], [c for _, c in docs])
    x, y = [], []
    for i, ((d, _), label) in enumerate(zip(docs, spread(docs, len(areas), list(rows["lang"]), weak))):
        for r, v in zip(d, label):
            if i not in away and (v.max() >= 0.6 or (v.max() == 0 and len(d) > 2)):
                x.append(r)
                y.append((v >= 0.6).astype("float32"))
    if not x:
        return None
    w, b = fit(x, np.stack(y))
    # those held out weigh as much as all the fitted ones, which are many enough to tell near shares apart
    known_ = [i for i, (d, c) in enumerate(docs) if c is not None and d]
    at = {i: shares(probabilities(w, b, docs[i][0])) for i in known_}
    order = [i for i in known_ for _ in range(HELD - 1 if i in away else 1)]
    codes, found_ = [docs[i][1] for i in order], [at[i] for i in order]
    return Model(areas, w, b, _area_shares(codes, found_, len(areas), _best_share(codes, found_)))


def classify(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, subject_code) of every document's areas."""
    if model is None:
        return documents.select("doc_id", F.lit("").alias("subject_code")).limit(0)
    bc = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: WIDTH x areas

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def areas(texts: pd.Series) -> pd.Series:
        return pd.Series(bc.value.areas_of_all(list(texts)), dtype=object)

    return documents.select("doc_id", F.explode(areas("text")).alias("subject_code"))


def found(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, subject_code) of the documents without given areas."""
    rest = documents.join(sample.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text")
    return classify(rest, train(documents, sample))
