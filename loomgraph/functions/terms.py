"""Identifiers of the graph as Column expressions: all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PREFIX = "http://repo.example.org/"
#: Fixed value: characters that stand for themselves in an identifier.
SAFE = r"[^A-Za-z0-9._~:@!$&'()*+,;=/-]"
#: What form encoding escapes although an identifier allows it.
ALLOWED = (("%7E", "~"), ("%3A", ":"), ("%40", "@"), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","), ("%3B", ";"), ("%3D", "="), ("%2F", "/"))
#: Words that are taken in the diagram language.
RESERVED = (
    "specification element relationship tag color model views view style extend include exclude it this navigate dynamic parallel "
    "title description technology notation metadata link summary links shape opacity border icon icons rectangle queue person cylinder "
    "storage browser mobile autoLayout animation module file func cls external interactive async default import export where of component "
    "container system context deployment content media table utility"
).split()


def trim(x: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def iri_safe(x: Column) -> Column:
    """Every character an identifier does not allow becomes one underscore (lossy)."""
    return F.regexp_replace(x, SAFE, "_")


def iri_escape(x: Column) -> Column:
    """Every byte an identifier does not allow becomes %XX (lossless)."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, char in ALLOWED:
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def iri(x: Column) -> Column:
    """The full identifier of a local name."""
    return F.concat(F.lit(PREFIX), x)


def strip_iri(x: Column) -> Column:
    """<prefix...> without the prefix and the brackets, if it has both; else unchanged."""
    wrapped = x.startswith(f"<{PREFIX}") & x.endswith(">")
    return F.when(wrapped, F.substring(x, F.lit(len(PREFIX) + 2), F.length(x) - len(PREFIX) - 2)).otherwise(x)


def to_id(x: Column) -> Column:
    """An identifier of the diagram language."""
    word = F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}_]", "_")
    word = F.when(word.rlike("^[0-9]"), F.concat(F.lit("n"), word)).otherwise(word)
    return F.when(word.isin(*RESERVED), F.concat(word, F.lit("El"))).otherwise(word)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null if there is none or only a leading one."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1))


def split_path(path: Column) -> tuple[Column, Column]:
    """(the last two directories or '.', the file)."""
    parts = F.split(path, "/")
    n = F.size(parts)
    start = F.greatest(n - 2, F.lit(1))
    return F.when(n > 1, F.array_join(F.slice(parts, start, n - start), "/")).otherwise(F.lit(".")), F.element_at(parts, -1)


def lines(content: Column) -> Column:
    """The lines of a text, without their ends and without an empty last one."""
    parts = F.split(content, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: Technology of a file by its extension.
TECHNOLOGY = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TSX", "go": "Go", "java": "Java", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++",
    "cs": "C#", "rb": "Ruby", "php": "PHP", "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift", "scala": "Scala", "sc": "Scala", "sh": "Bash", "bash": "Bash", "lua": "Lua", "json": "JSON", "yml": "YAML", "yaml": "YAML", "md": "Markdown", "markdown": "Markdown", "html": "HTML", "htm": "HTML", "css": "CSS",
}


def technology(file: Column) -> Column:
    last = F.substring_index(file, ".", -1)
    out = F.lit(None).cast("string")
    for label in dict.fromkeys(TECHNOLOGY.values()):
        out = F.when(last.isin(*[e for e, t in TECHNOLOGY.items() if t == label]), label).otherwise(out)
    return out
