"""Guide text in LaTeX to Markdown: ordered passes of native replacements, then paragraphs reflowed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.text import closing

_GROUP = r"\{((?:[^{}\\]++|\\.|\{(?:[^{}\\]++|\\.|\{[^{}]*+\})*+\})*+)\}"

#: (pattern, replacement), in order.
PASSES = [
    (r"(?m)(?<!\\)%.*$", ""),
    (r"(?s)\\begin\{(?:lstlisting|verbatim)\}.*?\\end\{(?:lstlisting|verbatim)\}", ""),
    (rf"\\section\*?{_GROUP}", "\n\n# $1\n\n"),
    (rf"\\subsection\*?{_GROUP}", "\n\n## $1\n\n"),
    (rf"\\subsubsection\*?{_GROUP}", "\n\n### $1\n\n"),
    (rf"\\(?:label|index|vspace|hspace){_GROUP}", ""),
    (rf"\\(?:auto|foot|full)?cites?(?:\[[^\]]*\])*{_GROUP}", "[$1]"),
    (rf"\\(?:page)?ref{_GROUP}", "[$1]"),
    (rf"\\(?:texttt|field|verb){_GROUP}", "`$1`"),
    (rf"\\(?:textbf){_GROUP}", "**$1**"),
    (rf"\\(?:emph|textit|mkbibemph){_GROUP}", "*$1*"),
    (rf"\\(?:enquote|mkbibquote){_GROUP}", "“$1”"),
    (r"\\begin\{(?:itemize|enumerate|description)\}|\\end\{(?:itemize|enumerate|description)\}", "\n\n"),
    (r"\\item\s*", "\n- "),
    (rf"\\[A-Za-z]+\*?{_GROUP}", "$1"),
    (r"---", "—"),
    (r"--", "–"),
    (r"~", " "),
    (r"\\([&%$#_{}])", "$1"),
    (r"\\[A-Za-z]+\*?\s?", ""),
    (r"[ \t]+", " "),
]


def reflowed(s: Column) -> Column:
    """Paragraphs on one line each; headings and list items keep theirs."""
    def block(p: Column) -> Column:
        lines = F.regexp_replace(F.trim(p), r"\s*\n\s*(?!- |#)", " ")
        return F.regexp_replace(lines, r"\s*\n\s*", "\n")

    return F.array_join(F.filter(F.transform(F.split(s, r"\n\s*\n"), block), lambda p: p != ""), "\n\n")


def to_markdown(s: Column, start: str | None = None, stop: str | None = None) -> Column:
    """Markdown of the text between two markers (all of it where there are none)."""
    out = s
    if start is not None:
        at = F.instr(out, start)
        out = F.when(at > 0, F.substring(out, at + len(start), F.length(out))).otherwise(out)
    if stop is not None:
        at = F.instr(out, stop)
        out = F.when(at > 0, F.substring(out, F.lit(1), at - 1)).otherwise(out)
    for pattern, replacement in PASSES:
        out = F.regexp_replace(out, pattern, replacement)
    return reflowed(out)


def without_command(s: Column, names: list[str], keep_argument: bool) -> Column:
    """Commands with one argument dropped, or unwrapped; arguments of more than three nested groups are closed by counting, in Python."""
    head = rf"\\(?:{'|'.join(names)})\*?\s*\{{"
    out = F.regexp_replace(s, rf"\\(?:{'|'.join(names)})\*?\s*{_GROUP}", "$1" if keep_argument else "")

    @F.pandas_udf(T.StringType())
    def deep(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else command_dropped(x, head, keep_argument))

    return F.when(out.rlike(head), deep(F.when(out.rlike(head), s))).otherwise(out)


def command_dropped(text: str, head: str, keep_argument: bool) -> str:
    """``text`` without the commands that ``head`` opens, at any depth of their arguments; unclosed ones stay."""
    out, at = [], 0
    for m in re.finditer(head, text):
        if m.start() < at or (close := closing(text, m.end() - 1)) is None:
            continue
        out.append(text[at : m.start()])
        if keep_argument:
            out.append(text[m.end() : close])
        at = close + 1
    return "".join((*out, text[at:]))


def cedilla(s: Column) -> Column:
    r"""``\c{c}`` and the like as composed letters."""
    # Letters that have a composed form with a cedilla.
    for plain, composed in (("c", "ç"), ("C", "Ç"), ("s", "ş"), ("S", "Ş"), ("t", "ţ"), ("T", "Ţ"), ("e", "ȩ"), ("g", "ģ"), ("k", "ķ"), ("l", "ļ"), ("n", "ņ"), ("r", "ŗ")):
        s = F.replace(s, F.lit(f"\\c{{{plain}}}"), F.lit(composed))
    return s
