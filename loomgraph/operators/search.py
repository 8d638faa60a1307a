"""Structural pattern search over files: $NAME stands for one node, $$$NAME for any run of them.

A pattern is matched token by token against a file's tokens (comments and blanks do not
count).  A metavariable takes one token or one whole bracketed or dotted expression;
the same name must take the same text everywhere.  Files are read where they lie.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.operators.code import EXTENSIONS
from loomgraph.workspace import spread

#: Extensions searched for a language (headers of C++ named hpp are not).
SEARCHED = {lang: [e for e, x in EXTENSIONS.items() if x == lang and e != "hpp"] for lang in dict.fromkeys(EXTENSIONS.values())}
ALIASES = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "golang": "go", "c++": "cpp", "cs": "csharp", "c#": "csharp", "rb": "ruby", "kt": "kotlin", "sh": "bash"}
_TOKENS = re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/|(?<![\w$])\#(?!\w+\s*[(<\"])[^\n]*)|(?P<meta>\$\$\$[A-Z_][A-Z0-9_]*|\$\$\$|\$[A-Z_][A-Z0-9_]*)|(?P<string>\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<word>[\w$]+)|(?P<op>=>|->|::|\?\.|\.\.\.|&&|\|\||[=!<>]=?=?|[^\s\w])", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def tokens(text: str, language: str) -> list[tuple[str, int, int]]:
    """(text, start, end) of each token."""
    out = []
    for m in _TOKENS.finditer(text):
        if m.lastgroup == "comment" and not (m.group().startswith("#") and language not in ("python", "ruby", "bash", "php")) and not (m.group().startswith("//") and language == "python"):
            continue
        out.append((m.group(), m.start(), m.end()))
    return out


def _closing(t: list, i: int) -> int:
    """The index after the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(t)):
        if t[j][0] in _PAIRS:
            depth += 1
        elif t[j][0] in _PAIRS.values():
            depth -= 1
            if depth == 0:
                return j + 1
    return -1


def _one(t: list, i: int) -> list[int]:
    """Where a single node that begins at i may end, longest first."""
    if i >= len(t) or t[i][0] in _PAIRS.values() or t[i][0] in (",", ";"):
        return []
    ends, j = [], i
    j = _closing(t, i) if t[i][0] in _PAIRS else i + 1
    while 0 < j <= len(t):
        ends.append(j)
        if j < len(t) and t[j][0] in (".", "::", "->", "?."):
            j = j + 2
        elif j < len(t) and t[j][0] in ("(", "[") and (t[j - 1][0][-1:].isalnum() or t[j - 1][0] in (")", "]")):
            j = _closing(t, j)
        else:
            break
    return [e for e in reversed(ends) if e <= len(t)]


def _match(p: list, k: int, t: list, i: int, bound: dict) -> int:
    """The index after a match of p[k:] at t[i:], or -1."""
    if k == len(p):
        return i
    text = p[k]
    if text.startswith("$$$"):
        j = i
        while True:
            got = _match(p, k + 1, t, j, bound)
            if got >= 0:
                return got
            if j >= len(t) or t[j][0] in _PAIRS.values():
                return -1
            j = _closing(t, j) if t[j][0] in _PAIRS else j + 1
            if j < 0:
                return -1
    if re.fullmatch(r"\$[A-Z_][A-Z0-9_]*", text):
        for end in _one(t, i):
            value = " ".join(x[0] for x in t[i:end])
            if text == "$_" or bound.get(text, value) == value:
                got = _match(p, k + 1, t, end, bound if text == "$_" else {**bound, text: value})
                if got >= 0:
                    return got
        return -1
    return _match(p, k + 1, t, i + 1, bound) if i < len(t) and t[i][0] == text else -1


def find(text: str, pattern: str, language: str) -> list[tuple[int, str]]:
    """(line from 1, text) of every match."""
    t, p = tokens(text, language), [x[0] for x in tokens(pattern, language)]
    out = []
    if not p:
        return out
    for i in range(len(t)):
        if not p[0].startswith("$") and t[i][0] != p[0]:
            continue
        if p[0].startswith("$") and i and t[i - 1][0] in (".", "::", "->", "?."):
            continue
        end = _match(p, 0, t, i, {})
        if end > i:
            out.append((text.count("\n", 0, t[i][1]) + 1, text[t[i][1] : t[end - 1][2]]))
    return out


def search(files: DataFrame, pattern: str, language: str, exclude: list[str] | None = None, limit: int | None = None, root: str | None = None) -> DataFrame:
    """file, line, text of the matches in files of a language; files hidden below ``root`` are left out.

    ``limit`` is the feature of a first page: the first rows by file and line.  Files whose
    content is null or not UTF-8 have no matches; an empty pattern matches nothing.
    """
    name = ALIASES.get(language.lower(), language.lower())
    if name not in SEARCHED:
        raise ValueError(f"no language {language!r}")
    below = F.col("path") if root is None else F.when(F.col("path").startswith(root), F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))).otherwise(F.col("path"))
    rows = files.filter(F.col("ext").isin(*SEARCHED[name]) & ~below.rlike(r"(^|/)\.") & F.is_valid_utf8(F.col("content").cast("string")))
    for d in exclude or []:
        rows = rows.filter(~F.col("path").contains(f"/{d}/"))

    def run(batches):
        for b in batches:
            out = [(path, line, text) for path, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for line, text in find(c, pattern, name)]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], names=["file", "line", "text"])

    found = spread(rows.select("path", F.col("content").cast("string").alias("content"))).mapInArrow(run, "file string, line int, text string")
    return found if limit is None else found.orderBy("file", "line", "text").limit(limit)
