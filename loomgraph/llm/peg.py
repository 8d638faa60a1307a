"""Tabular parsing with bundled grammars: grammar text to a packrat recogniser over tokens.

A grammar is a list of ``Rule <- expression`` over token kinds: ``'text'`` is the token
with that text, an upper-case name a class of tokens, ``/`` ordered choice, ``* + ?`` and
``& !`` as usual, ``ANYTOKEN`` any but the end, ``@nl`` true before a token on a new line.  Rules whose names begin with
``~`` on their first line are kept in the table (position x rule -> end), so that what is
tried by several alternatives is parsed once.  First sets computed from the grammar drop
alternatives that can't begin with the next token.  The recogniser is generated once for
each grammar and process.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s+|#[^\n]*|(?P<lit>'(?:[^'\\]|\\.)+')|(?P<arrow><-)|(?P<name>~?[A-Za-z_]\w*)|(?P<at>@\w+)|(?P<op>[/*+?&!()])")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at:at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return out


def read_rules(*texts: str) -> tuple[dict[str, tuple], set[str]]:
    """Rules by name and the names of tabled ones; a later text replaces rules of an earlier one."""
    rules: dict[str, tuple] = {}
    tabled: set[str] = set()
    for text in texts:
        t = _tokens(text) + [("end", "")]
        i = 0

        def choice() -> tuple:
            nonlocal i
            alts = [sequence()]
            while t[i] == ("op", "/"):
                i += 1
                alts.append(sequence())
            return alts[0] if len(alts) == 1 else ("or", alts)

        def sequence() -> tuple:
            nonlocal i
            parts = []
            while t[i][0] in ("lit", "at") or t[i][0] == "name" and t[i + 1][0] != "arrow" or t[i][0] == "op" and t[i][1] in "&!(":
                parts.append(prefix())
            return parts[0] if len(parts) == 1 else ("seq", parts)

        def prefix() -> tuple:
            nonlocal i
            if t[i][0] == "op" and t[i][1] in "&!":
                kind = "and" if t[i][1] == "&" else "not"
                i += 1
                return (kind, prefix())
            kind, text = t[i]
            i += 1
            if kind == "lit":
                e = ("tok", text[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
            elif kind == "at":
                e = ("at", text[1:])
            elif kind == "name":
                e = ("rule", text)
            else:
                e = choice()
                i += 1  # )
            while t[i][0] == "op" and t[i][1] in "*+?":
                e = ({"*": "star", "+": "plus", "?": "opt"}[t[i][1]], e)
                i += 1
            return e

        while t[i][0] != "end":
            name = t[i][1]
            if name.startswith("~"):
                name = name[1:]
                tabled.add(name)
            i += 2
            rules[name] = choice()
    return rules, tabled


class Grammar:
    """A recogniser.  ``classes``: names of token classes used in the rules."""

    def __init__(self, *texts: str, start: str = "Start"):
        self.rules, tabled = read_rules(*texts)
        self.kinds: dict[str, int] = {"<end>": 0}
        literals: set[str] = set()
        for e in self.rules.values():
            self._collect(e, literals)
        for x in sorted(literals):
            self.kinds[x] = len(self.kinds)
        self.literals = literals
        self._nullable: dict[str, bool] = {}
        self._first: dict[str, frozenset] = {}
        self._analyse()
        self._count = 0
        body: list[str] = []
        for name, e in self.rules.items():
            body += self._function(name, e, name in tabled)
        source = "def make(T, L, M):\n" + "\n".join("    " + x for x in body) + f"\n    return r_{start}\n"
        space: dict = {}
        exec(compile(source, f"<grammar {start}>", "exec"), space)  # our own bundled text
        self.make = space["make"]

    def _collect(self, e: tuple, literals: set[str]) -> None:
        if e[0] == "tok":
            literals.add(e[1])
        elif e[0] == "rule" and e[1] not in self.rules:
            if not e[1].isupper():
                raise ValueError(f"no rule {e[1]}")
            if e[1] == "ANYTOKEN":
                return
            self.kinds.setdefault(e[1], len(self.kinds))
        elif e[0] in ("seq", "or"):
            for x in e[1]:
                self._collect(x, literals)
        elif e[0] in ("star", "plus", "opt", "and", "not"):
            self._collect(e[1], literals)

    # -- first sets ------------------------------------------------------------------

    def _analyse(self) -> None:
        self._nullable = dict.fromkeys(self.rules, False)
        self._first = dict.fromkeys(self.rules, frozenset())
        changed = True
        while changed:
            changed = False
            for name, e in self.rules.items():
                n, f = self._nf(e)
                if n != self._nullable[name] or f != self._first[name]:
                    self._nullable[name], self._first[name] = n, f
                    changed = True

    def _nf(self, e: tuple) -> tuple[bool, frozenset]:
        kind = e[0]
        if kind == "tok":
            return False, frozenset([self.kinds[e[1]]])
        if kind == "rule" and e[1] == "ANYTOKEN":
            return False, frozenset(v for k, v in self.kinds.items() if k not in ("END", "<end>"))
        if kind == "rule":
            return (self._nullable[e[1]], self._first[e[1]]) if e[1] in self.rules else (False, frozenset([self.kinds[e[1]]]))
        if kind in ("at", "and", "not"):
            return True, frozenset()
        if kind in ("star", "opt"):
            return True, self._nf(e[1])[1]
        if kind == "plus":
            return self._nf(e[1])
        if kind == "or":
            every = [self._nf(x) for x in e[1]]
            return any(n for n, _ in every), frozenset().union(*(f for _, f in every))
        first: frozenset = frozenset()
        for x in e[1]:
            n, f = self._nf(x)
            first |= f
            if not n:
                return False, first
        return True, first

    # -- code ------------------------------------------------------------------------

    def _function(self, name: str, e: tuple, tabled: bool) -> list[str]:
        self._extra: list[str] = []
        code = self._code(e)
        out = [f"def r_{name}(p):"]
        if tabled:
            key = f"(p << 10) + {list(self.rules).index(name)}"
            out += [f"    k = {key}", "    if k in M: return M[k]"]
        out += ["    " + x for x in code]
        out += ["    M[k] = p"] * tabled + ["    return p"]
        return self._extra + out

    def _helper(self, e: tuple) -> str:
        self._count += 1
        name = f"h_{self._count}"
        code = self._code(e)
        self._extra += [f"def {name}(p):"] + ["    " + x for x in code] + ["    return p"]
        return name

    def _set(self, kinds: frozenset) -> str:
        return f"T[p] == {next(iter(kinds))}" if len(kinds) == 1 else "T[p] in {" + ", ".join(map(str, sorted(kinds))) + "}"

    def _is_token(self, e: tuple) -> frozenset | None:
        if e[0] == "tok" or e[0] == "rule" and e[1] not in self.rules:
            return self._nf(e)[1]
        if e[0] == "or":
            parts = [self._is_token(x) for x in e[1]]
            return frozenset().union(*parts) if all(x is not None for x in parts) else None
        if e[0] == "rule" and self.rules[e[1]][0] in ("tok", "or", "rule"):
            return self._is_token(self.rules[e[1]])
        return None

    def _call(self, e: tuple) -> str:
        return f"r_{e[1]}" if e[0] == "rule" and e[1] in self.rules else self._helper(e)

    def _code(self, e: tuple) -> list[str]:
        """Statements that turn p into the end of a match, or -1."""
        kinds = self._is_token(e)
        if kinds is not None:
            return [f"p = p + 1 if {self._set(kinds)} else -1"]
        kind = e[0]
        if kind == "rule":
            return [f"p = r_{e[1]}(p)"]
        if kind == "at":
            return [f"if {'not ' if e[1] == 'nl' else ''}L[p]: p = -1"]
        if kind == "seq":
            out: list[str] = []
            depth = 0
            for i, x in enumerate(e[1]):
                code = self._code(x) if len(e[1]) <= 12 or x[0] in ("tok", "rule", "at") else [f"p = {self._helper(x)}(p)"]
                out += ["    " * depth + y for y in code]
                if i < len(e[1]) - 1 and x[0] not in ("star", "opt"):
                    out.append("    " * depth + "if p >= 0:")
                    depth += 1
            return out
        if kind == "or":
            out = [f"q{(n := self._mark())} = p"]
            depth = 0
            for i, x in enumerate(e[1]):
                nullable, first = self._nf(x)
                pad = "    " * depth
                code = self._code(x) if x[0] in ("tok", "rule") else [f"p = {self._helper(x)}(p)"]
                if nullable:
                    out += [pad + y for y in code]
                else:
                    out += [pad + f"if {self._set(first)}:"] + [pad + "    " + y for y in code] + [pad + "else: p = -1"]
                if i < len(e[1]) - 1:
                    out += [pad + "if p < 0:", pad + f"    p = q{n}"]
                    depth += 1
            return out
        if kind == "opt":
            return self._maybe(e[1])
        if kind == "star":
            return self._loop(e[1])
        if kind == "plus":
            return [f"p = {self._call(e[1])}(p)", "if p >= 0:"] + ["    " + x for x in self._loop(e[1])]
        call = self._call(e[1]) if self._is_token(e[1]) is None else None
        test = f"{call}(p) {'>=' if kind == 'not' else '<'} 0" if call else (f"{self._set(self._is_token(e[1]))}" if kind == "not" else f"not ({self._set(self._is_token(e[1]))})")
        return [f"if {test}: p = -1"]

    def _mark(self) -> int:
        self._count += 1
        return self._count

    def _maybe(self, e: tuple) -> list[str]:
        kinds = self._is_token(e)
        if kinds is not None:
            return [f"if {self._set(kinds)}: p += 1"]
        nullable, first = self._nf(e)
        call = self._call(e)
        code = [f"q = {call}(p)", "if q >= 0: p = q"]
        return code if nullable else [f"if {self._set(first)}:"] + ["    " + x for x in code]

    def _loop(self, e: tuple) -> list[str]:
        kinds = self._is_token(e)
        if kinds is not None:
            return [f"while {self._set(kinds)}: p += 1"]
        nullable, first = self._nf(e)
        call = self._call(e)
        return [f"while {self._set(first) if not nullable else 'True'}:", f"    q = {call}(p)", "    if q <= p: break", "    p = q"]

    # -- use -------------------------------------------------------------------------

    def parse(self, tokens: list[int], lines: list[bool]) -> int:
        """-1 if the tokens (with an end token) are a sentence, else the furthest token that was looked at."""
        if self.make(tokens, lines, {})(0) >= 0:
            return -1
        seen = _Traced(tokens)
        self.make(seen, lines, {})(0)
        return seen.most


class _Traced(list):
    """Tokens that remember the furthest one looked at."""

    most = 0

    def __getitem__(self, i):
        if i > self.most:
            self.most = i
        return list.__getitem__(self, i)
