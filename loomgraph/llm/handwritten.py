"""Generated, minified, vendored and data-only source files.

Method: a multi-pattern automaton (Aho-Corasick) finds generation notices in the leading
comments of a file; path rules know vendored directories, output directories, lockfiles
and the suffixes of generated and minified files.  What carries neither is judged by its
text: density for minified scripts, the share of literals for data, numbered repetition
for the output of generators, and five-word shingles (similarity 0.8 or more) for copies
of known third-party files.  One pass over the files, nothing is shuffled but the result.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.workspace import spread

# -- fixed values -----------------------------------------------------------------
#: A notice: all of these phrases in the leading comments (letter case and runs of blanks ignored).
NOTICES = (
    ("code generated by",), ("auto-generated file",), ("autogenerated file",), ("<auto-generated",), ("@generated",),
    ("automatically generated",), ("auto-generated by",), ("auto-generated from",), ("autogenerated by",), ("autogenerated from",),
    ("auto generated by",), ("machine-written output of",), ("machine generated",), ("machine-generated",), ("generated by the protocol buffer compiler",),
    ("do not modify this file by hand",), ("do not edit this file by hand",), ("do not edit by hand",), ("generated file", "do not edit"), ("generated from", "do not edit"),
    ("this file is generated",), ("this file was generated",), ("this file has been generated",), ("this code was generated",), ("generated source", "do not"),
    ("produced by the", "compiler, version"), ("generated with", "do not modify"), ("a bison parser, made by",), ("generated by flex",), ("generated by swig",), ("generated by cython",),
    ("von hand bearbeiten", "erzeugt"), ("von hand bearbeiten", "generiert"), ("automatisch generiert",), ("automatisch erzeugt",),
    ("fichier généré",), ("généré automatiquement",), ("genere automatiquement",), ("ne pas modifier", "généré"), ("ne pas éditer",),
    ("generado automáticamente",), ("generado por", "no editar"), ("no editar a mano",), ("archivo generado",),
    ("gerado automaticamente",), ("gerado por", "não edit"), ("generato automaticamente",), ("non modificare", "generato"), ("automatisch gegenereerd",),
)
#: Phrases that speak of generation done by people or of other things; a notice that is part of one is none.
NO_NOTICES = ("generated by hand", "not automatically generated", "not auto-generated", "isn't automatically generated", "not generated by", "no longer generated")
VENDORED = ("vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "external", "externals", "godeps", "_workspace", "pods", "carthage", "site-packages", "dist-packages", "subprojects", "deps")
GENERATED_DIRS = ("generated", "gen", "__generated__", "autogen", "auto-generated", "gen-src", "generated-sources", "generated-src", "genfiles", "out")
MINIFIED_NAMES = re.compile(r"[.-](min|bundle|bundled|packed|compressed|chunk)\.m?js$", re.I)
GENERATED_NAMES = re.compile(r"(\.(generated|gen|g|pb|pb\.gw|auto|designer|tab|yy|lex|grpc)\.[a-z]+|_pb2(_grpc)?\.py|\.pb\.(go|cc|h|c)|_generated\.[a-z]+|_gen\.go|_string\.go|zz_generated[^/]*|grpc\.java|moc_[^/]*)$", re.I)
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "cargo.lock", "gemfile.lock", "poetry.lock", "pipfile.lock", "go.sum")
# -- thresholds -------------------------------------------------------------------
SHINGLE, SIMILAR, LEAST_SHINGLES = 5, 0.8, 25
DENSE_BLANKS, DENSE_LINE = 0.10, 80
DATA_SHARE, DATA_BYTES = 0.75, 300
NUMBERED_SHARE, NUMBERED_LEAST = 0.6, 8

_COMMENT = re.compile(r"\s*(?:(?://|#(?!include|define|pragma|if|undef|import|!\[|\[)|--|;|%)[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?-->|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))", re.S)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\b0[xX][0-9a-fA-F_]+\w*|\b\d[\d_.]*(?:[eE][+-]?\d+)?\w*")
_NOTES = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''", re.S)
_WORD = re.compile(r"\w+")
_ACTS = re.compile(r"\b(function|return|def|class|func|fn|if|for|while|switch|match|impl|interface|public|private|struct|try)\b|=>")


@functools.lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {p for notice in NOTICES for p in notice} | set(NO_NOTICES):
        a.add_word(phrase, phrase)
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The leading comments (and docstring) of a file, however long."""
    at, parts = 0, []
    if text.startswith("#!"):
        at = text.find("\n") + 1 or len(text)
    while (m := _COMMENT.match(text, at)) and m.end() > at:
        parts.append(m.group())
        at = m.end()
    return "\n".join(parts)


def has_notice(text: str) -> bool:
    head = re.sub(r"[\s*#/]+", " ", header(text).lower())
    if not head:
        return False
    found = {phrase: end for end, phrase in _automaton().iter(head)}
    spans = [(found[p] - len(p) + 1, found[p]) for p in NO_NOTICES if p in found]
    free = {p for p, end in found.items() if p not in NO_NOTICES and not any(lo <= end - len(p) + 1 and end <= hi for lo, hi in spans)}
    return any(all(p in free for p in notice) for notice in NOTICES)


def by_path(path: str) -> str | None:
    parts = path.lower().split("/")
    name = parts[-1]
    for i, d in enumerate(parts[1:-1], 1):  # the first part is the repository
        if d in VENDORED:
            return "vendored"
        # an output directory stands at the top of a repository or is called generated
        if d in GENERATED_DIRS and (i == 1 or "generated" in d or d == "autogen"):
            return "generated"
    if name in LOCKFILES or GENERATED_NAMES.search(name):
        return "generated"
    if MINIFIED_NAMES.search(name):
        return "minified"
    return None


def shingles(text: str) -> set[tuple[str, ...]]:
    w = _WORD.findall(text)
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def _code(text: str) -> str:
    """A file without its leading comments: a licence put on top makes no other file of it."""
    at = len(text) - len(text.lstrip())
    while (m := _COMMENT.match(text, at)) and m.end() > at:
        at = m.end()
    return text[at:]


class Known:
    """Third-party files, by shingle: a fixed small table."""

    def __init__(self, texts: list[str]):
        self.sets = [shingles(_code(t)) for t in texts]
        self.by: dict[tuple[str, ...], list[int]] = {}
        for i, s in enumerate(self.sets):
            for x in s:
                self.by.setdefault(x, []).append(i)

    def copied(self, text: str) -> bool:
        """Overlap of the shingle sets (shared, of the smaller set) of 0.8 or more: a renamed function or an added one leaves it a copy."""
        own = shingles(_code(text))
        shared: dict[int, int] = {}
        for x in own:
            for i in self.by.get(x, ()):
                shared[i] = shared.get(i, 0) + 1
        return any(n >= SIMILAR * max(LEAST_SHINGLES, min(len(own), len(self.sets[i]))) for i, n in shared.items())


def is_minified(text: str, ext: str) -> bool:
    if ext not in ("js", "mjs", "ts", "css"):
        return False
    code = _LITERAL.sub("0", _code(text)).strip()
    lines = [x for x in code.split("\n") if x.strip()]
    if len(code) < 200 or not lines:
        return False
    blanks = sum(c.isspace() for c in code) / len(code)
    names = re.findall(r"[A-Za-z_$][\w$]*", code)
    short = sum(len(n) <= 2 for n in names) / max(1, len(names))
    return blanks < DENSE_BLANKS and (len(code) / len(lines) > DENSE_LINE or short > 0.4)


def is_data(text: str) -> bool:
    """Almost nothing but literals, and no statement that acts."""
    code = _NOTES.sub("", text) if text.count('"') < 4 else _code(text)
    body = "".join(code.split())
    if len(body) < DATA_BYTES:
        return False
    rest = _LITERAL.sub("", code)
    left = re.sub(r"[\s,\[\]{}():;+=\\]+", "", rest)
    return 1 - len(left) / len(body) >= DATA_SHARE and len(_ACTS.findall(rest)) <= len(body) / 2000


def is_numbered(text: str) -> bool:
    """Most lines are one of a few forms that differ in a running number: a generator's output."""
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if len(x) > 8]
    running = [x for x in lines if re.search(r"[A-Za-z]_\d{3}\b|_\d{3}_", x)]
    return len(running) >= NUMBERED_LEAST and len(running) >= NUMBERED_SHARE * len(lines) * 0.5


def judge(path: str, ext: str, text: str | None, known: Known) -> str | None:
    """generated, minified, vendored, data or None for hand-written source."""
    if why := by_path(path):
        return why
    if not text:
        return None
    if has_notice(text):
        return "generated"
    if is_minified(text, ext):
        return "minified"
    if is_data(text):
        return "data"
    if is_numbered(text):
        return "generated"
    return "vendored" if known.copied(text) else None


def not_handwritten(files: DataFrame, languages: dict[str, str], known_texts: list[str], path: str = "path", ext: str = "ext", content: str = "content") -> DataFrame:
    """path, kind of the distinct files with an extension of ``languages`` (json aside) that are not hand-written.

    kind is generated, minified, vendored or data.  Files without content are judged by
    their path; bytes that are not UTF-8 are read with replacements; a null path gives no
    row.  If rows of one path have different contents, the first kind in string order
    stands.  ``known_texts``: third-party files, a fixed small number.
    """
    exts = [e for e in languages if e != "json"]
    rows = files.filter(F.lower(files[ext]).isin(*exts) & files[path].isNotNull()).select(files[path].alias("path"), F.lower(files[ext]).alias("ext"), files[content].alias("content"))

    def run(batches):
        known = Known(known_texts)
        for b in batches:
            paths, kinds = [], []
            for p, e, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if kind := judge(p, e, None if c is None else c.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), known):
                    paths.append(p)
                    kinds.append(kind)
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(kinds, pa.string())], names=["path", "kind"])

    return spread(rows).mapInArrow(run, "path string, kind string").groupBy("path").agg(F.min("kind").alias("kind"))
