"""Source files that do not parse.

Method: packrat (tabular) recognisers generated from the bundled grammars in
``grammars/`` parse the whole token stream of a file; the furthest token that any
alternative looked at is the first unrecoverable error.  The lexers below know comments,
literals, Python's indentation, Go's semicolons, JavaScript's regular expressions,
templates and line breaks, Rust's lifetimes and raw strings, C's directives.  Files are
read and judged where they lie; only the flagged paths or the counts are shuffled.
"""

from __future__ import annotations

import functools
import importlib.resources
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.peg import Grammar
from loomgraph.workspace import spread



def grammar_text(name: str) -> str:
    """A bundled grammar, also where the package is a zip file."""
    return importlib.resources.files("loomgraph.llm").joinpath("grammars", name).read_text(encoding="utf-8")


class LexError(Exception):
    def __init__(self, at: int):
        self.at = at


def _operators(*texts: str) -> str:
    return "|".join(re.escape(x) for x in sorted({y for t in texts for y in t.split()}, key=len, reverse=True))


class Language:
    """Grammar and lexer of a language: ``check`` gives the offset of the first error, or -1."""

    grammars: tuple[str, ...] = ()
    #: regular expressions of token classes and of what is skipped (lower-case names)
    patterns: tuple[tuple[str, str], ...] = ()
    operators = ""
    identifier = r"[^\W\d]\w*"

    def __init__(self) -> None:
        self.grammar = Grammar(*map(grammar_text, self.grammars))
        kinds = self.grammar.kinds
        self.end = kinds.setdefault("END", len(kinds))
        self.words = {x: kinds[x] for x in self.grammar.literals if re.fullmatch(r"\w+", x)}
        self.name = kinds.get("NAME", -1)
        self.master = re.compile("|".join([*(f"(?P<{n}>{p})" for n, p in self.patterns), f"(?P<NAME>{self.identifier})", f"(?P<OP>{_operators(self.operators)})", r"(?P<space>\s+)", r"(?P<bad>.)"]), re.S)

    def tokens(self, text: str) -> tuple[list[int], list[bool], list[int]]:
        """Kinds, whether a line break stands before, offsets; ends with END."""
        kinds, lines, at = [], [], []
        k, newline, words, name = self.grammar.kinds, False, self.words, self.name
        for m in self.master.finditer(text):
            group = m.lastgroup
            if group == "NAME":
                x = words.get(m.group(), name)
            elif group == "OP":
                x = k.get(m.group())
                if x is None:
                    raise LexError(m.start())
            elif group.islower():
                if group == "bad":
                    raise LexError(m.start())
                newline = newline or "\n" in m.group()
                continue
            else:
                x = k.get(group)
                if x is None:
                    raise LexError(m.start())
            kinds.append(x)
            lines.append(newline)
            at.append(m.start())
            newline = False
        return self.finish(kinds, lines, at, newline, len(text))

    def finish(self, kinds, lines, at, newline, end):
        kinds.append(self.end)
        lines.append(True)
        at.append(end)
        return kinds, lines, at

    def prepare(self, text: str) -> str:
        return text

    def check(self, text: str) -> int:
        try:
            kinds, lines, at = self.tokens(self.prepare(text))
        except LexError as e:
            return e.at
        stop = self.grammar.parse(kinds, lines)
        return -1 if stop < 0 else at[min(stop, len(at) - 1)]


class Json(Language):
    grammars = ("json.peg",)
    patterns = (("STRING", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'), ("NUMBER", r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.])"), ("blank", r"[ \t\n\r]+"))
    operators = "{ } [ ] , :"

    def prepare(self, text: str) -> str:
        for m in re.finditer(r'[^\S \t\n\r]', text):  # other blanks are allowed inside strings only, where the lexer judges them
            if text.count('"', 0, m.start()) % 2 == 0:
                raise LexError(m.start())
        return text


_NUMBER = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:[0-9](?:_?[0-9])*)?\.?[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?"


class Python(Language):
    grammars = ("python.peg",)
    operators = "+ - * ** / // % @ << >> & | ^ ~ := < > <= >= == != ( ) [ ] { } , : . ; = -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= ..."
    number = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:0(?:_?0)*|[1-9](?:_?[0-9])*)(?![0-9_.eEjJ])|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*)[jJ]?|[0-9](?:_?[0-9])*[jJ])(?![\w])")
    string = re.compile(r"(?i:(br|rb|fr|rf|tr|rt|[rbuft]))?('''|\"\"\"|'|\")")
    word = re.compile(r"[^\W\d]\w*")
    op = re.compile(_operators(operators))
    blank = re.compile(r"(?:[ \t\f]|\\\r?\n)+")
    indent = re.compile(r"[ \t\f]*")
    soft = {"match", "case", "type", "_"}

    def _string(self, text: str, at: int) -> int:
        """The end of the string literal that begins at ``at``."""
        m = self.string.match(text, at)
        prefix, quote = (m[1] or "").lower(), m[2]
        i, n, formatted = m.end(), len(text), "f" in prefix or "t" in prefix
        if formatted:
            return self._formatted(text, i, quote, at)
        while i < n:
            if text.startswith(quote, i):
                if "b" in prefix and not text[at:i].isascii():
                    break
                return i + len(quote)
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "\n" and len(quote) == 1:
                break
            else:
                i += 1
        raise LexError(at)

    def _formatted(self, text: str, i: int, quote: str, at: int) -> int:
        n, depth = len(text), []  # open brackets inside a replacement field
        while i < n:
            c = text[i]
            if not depth:
                if text.startswith(quote, i):
                    return i + len(quote)
                if c == "\\":
                    i += 2
                    continue
                if c == "\n" and len(quote) == 1:
                    break
                if c == "{":
                    if text.startswith("{{", i):
                        i += 2
                        continue
                    depth.append("{")
                elif c == "}":
                    if not text.startswith("}}", i):
                        break
                    i += 1
                i += 1
                continue
            if depth[-1] == ":":  # a format
                if c == "{":
                    depth.append("{")
                elif c == "}":
                    depth.pop()
                    depth.pop()
                elif text.startswith(quote, i) or c == "\n" and len(quote) == 1:
                    break
                i += 1
                continue
            if c in "'\"":
                if text.startswith(quote, i) and len(quote) == 3:
                    break
                j = i
                while j > 0 and text[j - 1].isalpha() and i - j < 2:
                    j -= 1
                i = self._string(text, j if self.string.fullmatch(text, j, i + 1) or self.string.match(text, j) and self.string.match(text, j).start(2) == i else i)
                continue
            if c in "([{":
                depth.append(c)
            elif c in ")]}":
                if "([{".index(depth[-1]) != ")]}".index(c):
                    break
                depth.pop()
            elif c == ":" and len(depth) and depth[-1] == "{" and (len(depth) == 1 or depth[-2] == ":"):
                depth.append(":")
            i += 1
        raise LexError(at)

    def tokens(self, text):
        k = self.grammar.kinds
        kinds, at = [], []
        newline, indent_k, dedent_k = k["NEWLINE"], k["INDENT"], k["DEDENT"]
        stack, brackets, i, n, start = [(0, 0)], [], 0, len(text), True
        if text.startswith("\ufeff"):
            i = 1
        while i < n:
            if start and not brackets:
                m = self.indent.match(text, i)
                j = m.end()
                if j >= n or text[j] in "#\n\r":
                    e = text.find("\n", j)
                    i = n if e < 0 else e + 1
                    continue
                if text.startswith("\\\n", j):
                    i = j + 2
                    continue
                wide = alone = 0
                for c in m.group():
                    wide, alone = ((wide // 8 + 1) * 8, alone + 1) if c == "\t" else (0, 0) if c == "\f" else (wide + 1, alone + 1)
                if wide == stack[-1][0]:
                    if alone != stack[-1][1]:
                        raise LexError(j)
                elif wide > stack[-1][0]:
                    if alone <= stack[-1][1]:
                        raise LexError(j)
                    stack.append((wide, alone))
                    kinds.append(indent_k)
                    at.append(j)
                else:
                    while wide < stack[-1][0]:
                        stack.pop()
                        kinds.append(dedent_k)
                        at.append(j)
                    if (wide, alone) != stack[-1]:
                        raise LexError(j)
                i, start = j, False
            c = text[i]
            if c == "\n" or c == "\r":
                if not brackets:
                    kinds.append(newline)
                    at.append(i)
                    start = True
                i += 2 if text.startswith("\r\n", i) else 1
                continue
            if c == "#":
                e = text.find("\n", i)
                i = n if e < 0 else e
                continue
            if m := self.blank.match(text, i):
                i = m.end()
                continue
            if self.string.match(text, i):
                e = self._string(text, i)
                kinds.append(k["STRING"])
            elif m := self.word.match(text, i):
                if m.group().isidentifier():
                    e = m.end()
                    kinds.append(self.words.get(m.group(), self.name))
                else:
                    raise LexError(i)
            elif c.isdigit() or c == "." and text[i + 1 : i + 2].isdigit():
                m = self.number.match(text, i)
                if not m:  # a keyword may follow a number at once
                    m = re.compile(r"(?:0[xX][0-9a-fA-F]+|[0-9]+)(?=(?:and|or|if|else|in|is|for|not)\b)").match(text, i)
                if not m:
                    raise LexError(i)
                e = m.end()
                kinds.append(k["NUMBER"])
            elif m := self.op.match(text, i):
                e, op = m.end(), m.group()
                if op in "([{":
                    brackets.append(op)
                elif op in ")]}":
                    if not brackets or "([{".index(brackets.pop()) != ")]}".index(op):
                        raise LexError(i)
                x = k.get(op)
                if x is None:
                    raise LexError(i)
                kinds.append(x)
            else:
                raise LexError(i)
            at.append(i)
            i = e
        if brackets:
            raise LexError(n)
        if not start:
            kinds.append(newline)
            at.append(n)
        for _ in stack[1:]:
            kinds.append(dedent_k)
            at.append(n)
        return self.finish(kinds, [True] * len(kinds), at, True, n)


class JavaScript(Language):
    grammars = ("javascript.peg",)
    operators = "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... ?. @ #!"
    number = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:[0-9](?:_?[0-9])*)n|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)(?![\w$])")
    word = re.compile(r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
    skip = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
    string = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|.))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"", re.S)
    regex = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
    chars = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
    op = re.compile(_operators(operators))

    def tokens(self, text):
        k = self.grammar.kinds
        kinds, lines, at, newline, depth, i, n = [], [], [], False, [], 0, len(text)
        if text.startswith("#!"):
            i = text.find("\n") if "\n" in text else n
        value = {k["NAME"], k["NUMBER"], k["STRING"], k["REGEX"], k["TEMPLATE"], k["TTAIL"], k[")"], k["]"], k["}"], k["++"], k["--"]} | {k[x] for x in ("this", "super", "null", "true", "false") if x in k}
        value |= {k[x] for x in self.words if x in k and x in _JS_CONTEXTUAL}
        last = -1
        while i < n:
            if m := self.skip.match(text, i):
                newline = newline or "\n" in m.group() or "\r" in m.group()
                i = m.end()
                continue
            c = text[i]
            private = c == "#" and self.word.match(text, i + 1)
            if m := self.word.match(text, i):
                e = m.end()
                x = self.words.get(m.group(), self.name)
                if last == k["."] or last == k["?."]:
                    pass
            elif private:
                e, x = private.end(), k["PRIVATE"]
            elif c.isdigit() or c == "." and text[i + 1 : i + 2].isdigit():
                m = self.number.match(text, i)
                if not m:
                    raise LexError(i)
                e, x = m.end(), k["NUMBER"]
            elif c in "'\"":
                m = self.string.match(text, i)
                if not m:
                    raise LexError(i)
                e, x = m.end(), k["STRING"]
            elif c == "`" or c == "}" and depth and depth[-1] == "`":
                e = self.chars.match(text, i + 1).end()
                if text.startswith("${", e):
                    x = k["THEAD"] if c == "`" else k["TMIDDLE"]
                    if c == "`":
                        depth.append("`")
                    e += 2
                elif text.startswith("`", e):
                    x = k["TEMPLATE"] if c == "`" else k["TTAIL"]
                    if c == "}":
                        depth.pop()
                    e += 1
                else:
                    raise LexError(i)
            elif c == "/" and last not in value and (m := self.regex.match(text, i)):
                e, x = m.end(), k["REGEX"]
            elif m := self.op.match(text, i):
                op = m.group()
                if op == "?." and text[m.end() : m.end() + 1].isdigit():
                    op = "?"
                e, x = i + len(op), k.get(op)
                if x is None:
                    raise LexError(i)
                if op == "{":
                    depth.append("{")
                elif op == "}":
                    if not depth:
                        raise LexError(i)
                    depth.pop()
            else:
                raise LexError(i)
            kinds.append(x)
            lines.append(newline)
            at.append(i)
            newline, last, i = False, x, e
        if depth:
            raise LexError(n)
        return self.finish(kinds, lines, at, True, n)


_JS_CONTEXTUAL = {"async", "of", "get", "set", "let", "static", "as", "from", "type", "declare", "abstract", "readonly", "namespace", "module", "is", "any", "string", "number", "boolean", "object", "symbol", "undefined", "constructor", "target", "meta"}


class TypeScript(JavaScript):
    grammars = ("javascript.peg", "typescript.peg")


class Go(Language):
    grammars = ("go.peg",)
    patterns = (
        ("comment", r"//[^\n]*|/\*.*?\*/"), ("STRING", r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\""), ("CHAR", r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"),
        ("NUMBER", r"(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?(?!\w)"),
    )
    operators = "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... ( ) [ ] { } , ; . :"

    def tokens(self, text):
        kinds, lines, at = super().tokens(text)
        k = self.grammar.kinds
        ends = {k[x] for x in ("NAME", "NUMBER", "STRING", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}
        out, where, semi = [], [], k[";"]
        for x, line, p in zip(kinds, lines, at):
            if line and out and out[-1] in ends:
                out.append(semi)
                where.append(p)
            out.append(x)
            where.append(p)
        return out, [True] * len(out), where


class Java(Language):
    grammars = ("java.peg",)
    identifier = r"[^\W\d][\w$]*|\$[\w$]*"
    patterns = (
        ("comment", r"//[^\n]*|/\*.*?\*/"), ("STRING", r"\"\"\"[ \t\f]*\n(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*\""), ("CHAR", r"'(?:[^'\\\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'"),
        ("NUMBER", r"(?:0[xX](?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|(?:[0-9][0-9_]*\.?(?:[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)[lLfFdD]?(?!\w)"),
    )
    operators = "{ } ( ) [ ] ; , . ... @ :: = > < ! ~ ? : -> == <= >= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<="


class Rust(Language):
    grammars = ("rust.peg",)
    identifier = r"(?:r\#)?[^\W\d]\w*"
    patterns = (
        ("comment", r"//[^\n]*"), ("opens", r"/\*"), ("STRING", r"(?:b|c)?\"(?:[^\"\\]|\\.)*\"|(?:b|c)?r(?P<h>\#*)\".*?\"(?P=h)"),
        ("CHAR", r"b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'"), ("LIFETIME", r"'[^\W\d]\w*(?!')"),
        ("NUMBER", r"(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[0-9][0-9_]*(?:\.(?![._]|[^\W\d])[0-9_]*)?(?:[eE][+-]?[0-9_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)"),
    )
    operators = "+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= = == != > < >= <= @ _ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { }"

    def prepare(self, text: str) -> str:
        if text.startswith("#!") and not text.startswith("#!["):
            text = "\n" + text.partition("\n")[2]
        if "/*" not in text:
            return text
        # comments nest: blank them out, but not what looks like one inside a string or a line comment
        scan = re.compile(r"//[^\n]*|(?:b|c)?\"(?:[^\"\\]|\\.)*\"|(?:b|c)?r(\#+)\".*?\"\1|'(?:[^'\\\n]|\\.)'|/\*", re.S)
        out, i = [], 0
        while m := scan.search(text, i):
            out.append(text[i : m.start()])
            if m.group() != "/*":
                out.append(m.group())
                i = m.end()
                continue
            depth, j = 1, m.end()
            while depth:
                n = re.compile(r"/\*|\*/").search(text, j)
                if not n:
                    raise LexError(m.start())
                depth += 1 if n.group() == "/*" else -1
                j = n.end()
            out.append(re.sub(r"[^\n]", " ", text[m.start() : j]))
            i = j
        return "".join(out) + text[i:]

    def tokens(self, text):
        kinds, lines, at = super().tokens(text)
        return kinds, lines, at


class C(Language):
    grammars = ("c.peg",)
    identifier = r"[^\W\d][\w$]*"
    patterns = (
        ("directive", r"(?:(?<=\n)|\A)[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*"), ("comment", r"//(?:\\\n|[^\n])*|/\*.*?\*/|\\\n"),
        ("STRING", r"(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\""), ("CHAR", r"[uUL]?'(?:[^'\\\n]|\\.)+'"),
        ("NUMBER", r"(?:0[xX](?:[0-9a-fA-F']+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?|0[bB][01']+|(?:[0-9][0-9']*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[uUlLfF]*(?!\w)"),
    )
    operators = "{ } ( ) [ ] ; , . ... -> ++ -- & * + - ~ ! / % << >> < > <= >= == != ^ | && || ? : = *= /= %= += -= <<= >>= &= ^= |="
    #: Other spellings of words of the grammar (fixed values).
    spellings = {"__inline": "inline", "__inline__": "inline", "__const": "const", "__restrict": "restrict", "__restrict__": "restrict", "__volatile__": "volatile", "__asm__": "asm", "__asm": "asm", "__typeof__": "typeof", "__attribute": "__attribute__", "_Imaginary": "_Complex", "alignas": "_Alignas", "thread_local": "_Thread_local", "__thread": "_Thread_local", "alignof": "_Alignof", "__alignof__": "_Alignof", "static_assert": "_Static_assert", "__signed__": "signed"}

    def __init__(self) -> None:
        super().__init__()
        self.words |= {a: self.words[b] for a, b in self.spellings.items() if b in self.words}

    def check(self, text: str) -> int:
        first = super().check(text)
        if first < 0 or not re.search(r"^[ \t]*#[ \t]*el", text, re.M):
            return first
        # the branches of a conditional may not fit together: keep the first of each
        out, hidden = [], []
        for line in text.split("\n"):
            d = re.match(r"[ \t]*#[ \t]*(\w+)", line)
            word = d[1] if d else ""
            if word.startswith("if"):
                hidden.append(False)
            elif word in ("else", "elif") and hidden:
                hidden[-1] = True
            elif word == "endif" and hidden:
                hidden.pop()
            out.append("" if any(hidden) and not d else line)
        return first if super().check("\n".join(out)) >= 0 else -1


LANGUAGES = {"json": Json, "python": Python, "javascript": JavaScript, "typescript": TypeScript, "go": Go, "java": Java, "rust": Rust, "c": C}


@functools.lru_cache(None)
def language(name: str) -> Language:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))
    return LANGUAGES[name]()


#: Frames of the recognisers a character can cost at most: the rules of an expression from the weakest operator to the strongest.
FRAMES = 64


def first_error(name: str, content: bytes) -> int:
    """-1 if the bytes are valid in the language, else the offset (in characters) of the first error."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return len(content[: e.start].decode("utf-8", "ignore"))
    if text.startswith("\ufeff") and name != "json":
        text = text[1:]
    if "\r" in text and name != "json":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip() and name not in ("json", "go"):
        return -1
    if name == "go" and not text:
        return -1
    if "\0" in text and name != "json":
        return text.index("\0")
    try:
        return language(name).check(text)
    except LexError as e:
        return e.at
    except RecursionError:  # nested very deep: once more with room for as many frames as the text can need
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(usual + FRAMES * len(text))
        try:
            return language(name).check(text)
        except LexError as e:
            return e.at
        finally:
            sys.setrecursionlimit(usual)


def judged(files: DataFrame, languages: dict[str, str], path: str = "path", repo: str = "repo", ext: str = "ext", content: str = "content") -> DataFrame:
    """path, repo, language, error_line of every distinct file with a known extension and non-null content.

    ``error_line`` is the line (from 1) of the first unrecoverable error, null for a valid
    file.  An empty file is valid, but for JSON.  If rows of one path differ in content,
    the first error line of any of them stands.  A null path gives no row; languages
    without a grammar raise an error.
    """
    unknown = set(languages.values()) - set(LANGUAGES)
    if unknown:
        raise ValueError(f"no grammar for {sorted(unknown)}")
    rows = files.filter(files[ext].isin(*languages) & files[content].isNotNull() & files[path].isNotNull()).select(files[path].alias("path"), files[repo].alias("repo"), files[ext].alias("ext"), files[content].alias("content"))

    def run(batches):
        for b in batches:
            names = [languages[e] for e in b.column(2).to_pylist()]
            errors = []
            for name, c in zip(names, b.column(3).to_pylist()):
                at = first_error(name, c)
                errors.append(None if at < 0 else c.decode("utf-8", "replace").count("\n", 0, at) + 1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(errors, pa.int32())], names=["path", "repo", "language", "error_line"])

    return spread(rows).mapInArrow(run, "path string, repo string, language string, error_line int").groupBy("path", "repo", "language").agg(F.min("error_line").alias("error_line"))


def invalid(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """path, language, error_line of the files that do not parse."""
    return judged(files, languages).filter(F.col("error_line").isNotNull()).select("path", "language", "error_line")


def rates(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """repo, language, n_files, n_invalid, rate: pre-aggregated, one row per repository and language."""
    n = judged(files, languages).groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("error_line").alias("n_invalid"))
    return n.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
