"""Code structures and call edges of 17 languages.

A file is scanned in one pass of a Python worker that reads Arrow batches (parsing is the
one thing Spark's expressions can't do).  Python goes through the interpreter's own
parser; the others through a scanner over the text with comments and strings blanked
out: definitions by a pattern per language, bodies by matching brackets (or end words),
calls by the expression in front of an opening parenthesis.  A call belongs to the
innermost named function whose body holds it, else to the file.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.workspace import spread

#: Extension -> language.
EXTENSIONS = {
    "py": "python", "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sc": "scala", "sh": "bash", "bash": "bash", "lua": "lua",
}
TEST_ANNOTATIONS = {"java": {"Test", "ParameterizedTest", "RepeatedTest"}, "csharp": {"TestMethod", "Fact", "Theory", "Test"}}
TEST_DIRECTORIES = ("/test/", "/tests/", "/__tests__/", "/spec/", "/specs/")
SAFE = re.compile(r"[^A-Za-z0-9._~:@!$&'()*+,;=/-]")
NO_CALL = set("if for while switch catch function return typeof new delete void throw do else case in of instanceof await yield sizeof alignof decltype using lock fixed foreach elseif elif match when guard defer func fn def fun class struct interface enum trait impl import package namespace and or not is as assert with let var val const static_assert unless until synchronized try super this print_r_never".split()) - {"super", "this", "print_r_never"}


@dataclass(frozen=True)
class Rules:
    """How one language is scanned; patterns have the name in group 1."""

    functions: tuple[str, ...]
    classes: tuple[str, ...]
    calls: bool = True
    line: str = "//"  # marks of line comments, a character class or alternatives
    block: bool = True
    needs_body: bool = False  # a function without a body is none
    members: bool = True  # calls on an object count
    name_only: bool = False  # the callee is the method's name, whatever it is called on


_C_FUNCTION = r"(?:^|[;{}\n])[ \t]*(?:[A-Za-z_][\w:<>,&*\[\]. \t]*[\s*&])?([A-Za-z_~][\w:~]*)\s*\((?=(?:[^()]|\([^()]*\))*\)[^;{}()=]*\{)"
_TYPED = r"(?:^|[;{}\n\])])\s*(?:(?:public|private|protected|internal|static|final|abstract|native|synchronized|default|strictfp|virtual|override|async|sealed|extern|unsafe|partial|new|readonly)\s+)*(?:<[^<>{};]*>\s*)?(?!return\b|new\b|throw\b|else\b|await\b|yield\b|case\b|goto\b|assert\b|package\b|import\b|using\b)[A-Za-z_][\w.$]*(?:<[^;{}()]*>)?(?:\[\s*\])*\??\s+([A-Za-z_$][\w$]*)\s*\((?=(?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?:throws\s+[\w.,\s<>]+|where[^{]*)?(?:\{|;|=>|default\b))"
RULES = {
    "rust": Rules((r"\bfn\s+([A-Za-z_]\w*)",), (r"\bstruct\s+([A-Za-z_]\w*)",), needs_body=True),
    "javascript": Rules((r"(?<![=(,:?!&|+\[]\s)(?<![=(,:?!&|+\[.])(?<!return )\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)",), (r"(?<![=(,:?]\s)(?<![=(,:?.\w$])\bclass\s+(?!extends\b)([A-Za-z_$][\w$]*)",)),
    "go": Rules((r"(?:^|\n)func\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",), (r"(?:^|\n)\s*type\s+([A-Za-z_]\w*)\s",)),
    "java": Rules((_TYPED, r"(?:^|[;{}\n])\s*(?:(?:public|private|protected)\s+)?([A-Z][\w$]*)\s*\((?=(?:[^()]|\([^()]*\))*\)\s*(?:throws[\w.,\s]+)?\{)"), (r"\b(?:class|interface|enum)\s+([A-Za-z_$][\w$]*)",), name_only=True),
    "c": Rules((_C_FUNCTION,), ()),
    "cpp": Rules((_C_FUNCTION,), ()),
    "csharp": Rules((_TYPED,), (r"\b(?:class|interface|struct|enum)\s+([A-Za-z_]\w*)",)),
    "ruby": Rules((r"\bdef\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)",), (r"(?:^|\n)\s*(?:class|module)\s+([A-Z]\w*(?:::\w+)*)",), line="#", block=False, name_only=True),
    "php": Rules((r"\bfunction\s+&?\s*([A-Za-z_]\w*)",), (r"\b(?:class|interface|enum)\s+([A-Za-z_]\w*)",), line="//|#(?!\\[)", members=False),
    "kotlin": Rules((r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?([A-Za-z_]\w*)",), (r"\b(?:class|interface|object)\s+([A-Za-z_]\w*)",)),
    "swift": Rules((r"\bfunc\s+([A-Za-z_]\w*)",), (r"\b(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b|let\b)([A-Za-z_]\w*)",)),
    "scala": Rules((r"\bdef\s+([A-Za-z_]\w*)",), (r"\b(?:class|object|trait)\s+([A-Za-z_]\w*)",), needs_body=True),
    "bash": Rules((r"(?:^|\n)\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)", r"(?:^|\n)\s*function\s+([A-Za-z_][\w-]*)"), (), calls=False, line=r"(?<![\w$])#", block=False),
    "lua": Rules((r"\bfunction\s+([A-Za-z_][\w.:]*)",), (), calls=False, line="--", block=False),
}
RULES["typescript"] = RULES["tsx"] = Rules(RULES["javascript"].functions, (*RULES["javascript"].classes, r"(?:^|[;{}\n]|\bexport\b|\bdeclare\b)\s*interface\s+([A-Za-z_$][\w$]*)"))
_CALLEE = re.compile(r"((?:[A-Za-z_$][\w$]*[?!]?(?:<[\w\s,.<>&:'\[\]]*>)?(?:\[[^\[\]\n]*\]|\([^()\n]*\))*\s*(?:\?\.|\.|->|::)\s*)*[A-Za-z_$][\w$]*[?!]?)(?:::<[^()]*>)?\s*\(")


def blank(text: str, rules: Rules, language: str) -> str:
    """The text with comments and the insides of strings as spaces: offsets stay."""
    strings = r"\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
    if language == "rust":
        strings = r"r(\#+)\".*?\"\1|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'"
    comments = rf"(?:{rules.line})[^\n]*" + (r"|/\*.*?(?:\*/|\Z)" if rules.block else "")
    return re.sub(rf"{comments}|{strings}", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m.group() == pair[0] else -1
        if not depth:
            return m.end()
    return len(text)


def _ended(text: str, at: int) -> int:
    """The place after the ``end`` that closes a block word of Ruby or Lua."""
    depth = 1
    for m in re.compile(r"(?m)\b(end)\b|\b(def|class|module|begin|case|do|function|then|repeat)\b|^\s*(if|unless|while|until|for)\b").finditer(text, at):
        depth += -1 if m[1] else 1 if m[2] not in ("then", "do", "repeat") or m[2] == "do" and not re.search(r"\b(while|until|for)\b[^\n]*$", text[: m.start()].rpartition("\n")[2]) else 0
        if not depth:
            return m.end()
    return len(text)


def simplify(callee: str) -> str:
    """The last name of a callee, without what follows it."""
    if "." in callee:
        callee = callee.rpartition(".")[2]
    elif "::" in callee:
        callee = callee.rpartition("::")[2]
    return re.split(r"[(<\[{ ]", callee, maxsplit=1)[0]


@dataclass
class Found:
    functions: list[tuple[int, int, str, bool]]  # start, end, name, test by annotation
    classes: list[tuple[int, str]]
    calls: list[tuple[int, str]]


def _python(text: str) -> Found | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = [0]
    for line in text.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw, out = text.encode(), Found([], [], [])
    place = lambda n, last=False: starts[(n.end_lineno if last else n.lineno) - 1] + (n.end_col_offset if last else n.col_offset)
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.functions.append((place(n), place(n, True), n.name, False))
        elif isinstance(n, ast.ClassDef):
            out.classes.append((place(n), n.name))
        elif isinstance(n, ast.Call):
            out.calls.append((place(n), raw[place(n.func) : place(n.func, True)].decode("utf-8", "replace")))
    return out


_INDENTED = Rules((r"(?:^|\n)[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)",), (r"(?:^|\n)[ \t]*class\s+([A-Za-z_]\w*)",), line="#", block=False)


def scan(language: str, text: str) -> Found:
    if language == "python" and (found := _python(text)):
        return found
    rules = RULES.get(language, _INDENTED)
    code = blank(text, rules, language)
    out, names = Found([], [], []), set()
    for pattern in rules.functions:
        for m in re.finditer(pattern, code):
            name, at = m[1], m.start(1)
            if name in NO_CALL or at in names:
                continue
            after = code.find("(", m.end(1))
            after = closing(code, after, "()") if after >= 0 and not re.search(r"[^\s<>\w,:'.&?\[\]]", code[m.end(1) : after]) else m.end(1)
            if language in ("ruby", "lua"):
                end = _ended(code, after)
            elif language == "python":
                line = code.rfind("\n", 0, at) + 1
                depth = len(code[line:at]) - len(code[line:at].lstrip())
                stop = re.compile(rf"\n(?=[ \t]{{0,{depth}}}\S)").search(code, after)
                end = stop.start() if stop else len(code)
            else:
                body = re.compile(r"[{;]|=(?!=|>)|\n\s*\n").search(code, after)
                has = body is not None and body.group() == "{"
                if rules.needs_body and not has and not (language == "scala" and body and body.group() == "="):
                    continue
                end = closing(code, body.start()) if has else (body.end() if body else len(code))
                if language == "scala" and body and body.group() == "=":
                    inner = re.compile(r"\s*\{").match(code, body.end())
                    end = closing(code, inner.end() - 1) if inner else (code.find("\n", body.end()) + 1 or len(code))
            names.add(at)
            label = name.rpartition("::")[2] if language == "cpp" else name
            out.functions.append((at, end, label, _annotated(language, text, m.start(1))))
    for pattern in rules.classes:
        out.classes += [(m.start(1), m[1]) for m in re.finditer(pattern, code)]
    if rules.calls:
        for m in _CALLEE.finditer(code):
            callee, last = m[1], m.start(1) + len(m[1])
            word = re.search(r"[\w$?!]+$", callee)
            if word[0] in NO_CALL or m.start(1) in names or last - len(word[0]) in names or not rules.members and re.search(r"->|::", callee) or not rules.members and callee[:1] == "$":
                continue
            if language == "rust" and callee.endswith("!"):
                continue  # a macro
            before = code[max(0, m.start(1) - 40) : m.start(1)].rstrip()
            if re.search(r"\b(?:new|func|fn|function|def|fun|class|struct|enum|interface|type)$|@$|\$$", before) or not rules.members and before.endswith(("->", "::", "new")):
                continue
            end = closing(code, m.end() - 1, "()")
            following = code[end : end + 40].lstrip()
            if following.startswith("{") and language in ("javascript", "typescript", "tsx", "java", "csharp") and callee == word[0]:
                continue  # a method's head
            if language in ("typescript", "tsx") and callee == word[0] and re.match(r":[^;{=()?]*\{", following) and re.search(r"[;{}]\s*(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*$", code[max(0, m.start(1) - 80) : m.start(1)]):
                continue
            if language == "rust" and word[0][:1].isupper() and re.match(r"=>|if\b|\||=(?!=)", following):
                continue  # a pattern
            out.calls.append((m.start(1), word[0] if rules.name_only else callee))
    return out


def _annotated(language: str, text: str, at: int) -> bool:
    wanted = TEST_ANNOTATIONS.get(language)
    if not wanted:
        return False
    head = re.split(r"[;{}]", text[:at])[-1]
    mark = r"@(?:[\w.]*\.)?(\w+)" if language == "java" else r"\[\s*(?:[\w.]*\.)?(\w+)"
    return any(m in wanted for m in re.findall(mark, head))


def facts(path: str, language: str, text: str) -> list[tuple[str, str, str]]:
    """The triples of one file."""
    found = scan(language, text)
    by_path = any(d in path.lower() for d in TEST_DIRECTORIES)
    out = []
    for _, _, name, test in found.functions:
        out.append((f"{path}/{name}", "a", "Function"))
        if test or by_path:
            out.append((f"{path}/{name}", "isTestFunction", "true"))
    out += [(f"{path}/{name}", "a", "Class") for _, name in found.classes]
    spans = sorted((s, e, n) for s, e, n, _ in found.functions)
    starts = [s for s, _, _ in spans]
    for at, callee in found.calls:
        name = SAFE.sub("_", simplify(callee))
        if not name:
            continue
        i = bisect.bisect_right(starts, at) - 1
        while i >= 0 and spans[i][1] <= at:
            i -= 1
        out.append((f"{path}/{spans[i][2]}" if i >= 0 else path, "calls", name))
    return out


def code_facts(files: DataFrame) -> DataFrame:
    """s, p, o of the code files of ``files`` (path, ext, content); content that is not UTF-8 gives none."""
    rows = files.filter(F.col("ext").isin(*EXTENSIONS) & F.col("path").isNotNull() & F.is_valid_utf8(F.col("content").cast("string"))).select("path", "ext", F.col("content").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            out = []
            for path, ext, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                out += facts(path, EXTENSIONS[ext], text)
            yield pa.record_batch([pa.array([x[i] for x in out], pa.string()) for i in range(3)], names=["s", "p", "o"])

    return spread(rows).mapInArrow(run, "s string, p string, o string")
