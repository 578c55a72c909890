"""Declared schemas and the fixed values of the bibliographic domain."""

from __future__ import annotations

FIELD = "struct<ord:int,name:string,key:string,value:string,lead:string,start:int,end:int,vstart:int,vend:int>"
SCANNED = f"doc string, kind string, ord int, etype string, citekey string, start int, end int, fields array<{FIELD}>"
PATCH = "op_ord int, op string, key string, field string, value string, why string"
# Fields that an entry type requires, and those that are desired.
REQUIRED = {"article": ["volume", "pages"], "review": ["volume", "pages"], "inproceedings": ["pages"], "periodical": ["volume"]}
DESIRED = {"article": ["number"], "review": ["number"], "periodical": ["number"], "inproceedings": ["number"], "incollection": ["chapter", "pages"], "inbook": ["chapter", "pages"]}
# Entry types that stand in a container.
BOOK_LIKE = (
    "book mvbook inbook bookinbook suppbook collection mvcollection incollection suppcollection proceedings mvproceedings inproceedings reference mvreference inreference"
).split()
# Fields of a container, and those that two records are compared by.
CONTAINER = ["date", "editor", "publisher"]
COMPARABLE = ["author", "editor", "title", "date", "publisher", "location"]
# Fields that are not kept.
FORBIDDEN = ["isbn", "issn"]
EXTRACTION_FORBIDDEN = ["issn", "isbn", "keywords", "reference", "devonthink"]
# Fields that no rewrite may touch; normalising protects keywords and doi as well, patching keywords only.
PROTECTED = r"^(reference|date-added|date-modified|(local|remote)-url(-\d+)?|devonthink\d*|bdsk-(file|url)(-\d+)?|rating|read)$"
NORMALIZE_PROTECTED = PROTECTED[:-2] + "|keywords|doi)$"
TRAILING = r"^(bdsk-|local-url|remote-url|devonthink)"
# Title fields and their subtitles; fields of ranges, of dates, and of ranges with an en dash.
SUBTITLE_OF = {"title": "subtitle", "booktitle": "booksubtitle", "maintitle": "mainsubtitle"}
RANGE_FIELDS = ["pages", "date", "origdate", "eventdate", "urldate", "volumes"]
DATE_FIELDS = ["date", "origdate", "eventdate", "urldate"]
EN_DASH_FIELDS = (
    "number volume volumes title subtitle booktitle booksubtitle maintitle mainsubtitle issuetitle titleaddon series note"
).split()
# Abbreviations before a full stop, English function words, bibliography strings.
ABBREVIATIONS = "vs cf ed eds no op vol pt st ca trans rev ser fig chap mr mrs dr jr sr".split()
ENGLISH_WORDS = (
    "the of and in a an to for from with on at by as is are was were its his her their this that these those how why what when "
    "between through about into over under after before against toward towards"
).split()
BIBSTRINGS = "reviewof byeditor bytranslator byauthor nodate newseries volume number edition reprint translation".split()
# Characters outside ASCII that are typography only.
TYPOGRAPHIC = "‘’“”–—…‑‐‒― ­′″°− \u2009\u202f‹›†‡©®™·"
# Parameters that only track; "utm_" is a prefix, and "p" counts with a value email...
TRACKING_PARAMETERS = "fbclid gclid dclid msclkid twclid ttclid igshid yclid mc_cid mc_eid _ga _gl at_medium at_campaign ito cmp".split()
CHALLENGE_STATUS = [403, 429, 503]
# Prices in dollars per million tokens and the cost model's parameters.
CACHE_WRITE = {"5m": 1.25, "1h": 2.0}
CACHE_READ = 0.10
OUTPUT_TOKENS = {"extraction": 450, "audit": 60, "merge": 400}
CHARS_PER_TOKEN = 3.38
