"""Imports and declarations of Java, Kotlin, C, C++, JavaScript and TypeScript.

One pass over a text gives its tokens and a table of brackets, in which each
opener knows its closer. It knows comments, strings with the code inside them,
text blocks, regular expressions and directives, so nothing is read from within
a string, and looking past a bracket is one step. All is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

_START = re.compile(r"\S")
_TOKEN = re.compile(r"[^\W\d][\w$]*|[$@][\w$]*|\d(?:[\w.]|'\w)*|=>|->|\?\.|\S")
_NAME = re.compile(r"[^\W\d]|\$")
_PLAIN = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}", re.S) for q in "\"'`"}
_BLOCK = re.compile(r'"""(?:\\.|"(?!"")|[^"\\])*"""', re.S)
#: Strings that hold code in ${ }: by how they begin, the text up to their end or to such code.
_TEMPLATES = {"`": re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S), '"': re.compile(r'(?:\\.|\$(?!\{)|[^"\\$\n])*'), '"""': re.compile(r'(?:\$(?!\{)|"(?!"")|[^"$])*')}
#: A regular expression of scripts; a slash within brackets doesn't end it.
_PATTERN = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: After these a slash begins a regular expression: an operand can't have ended.
_OPERAND = set("return typeof case in of delete void throw new do else yield await instanceof".split())
_WORD = re.compile(r"[\w$@`\"']")
_RAW = re.compile(r'"([^()\\\s]{0,16})\(')
_DIRECTIVE = re.compile(r"#(?:\\\r?\n|/(?![/*])|[^\n\\/]|\\)*")
_INCLUDE = re.compile(r"#[ \t]*include[ \t]*([\"<])([^\">\n]+)[\">]")
_COMMENT = re.compile(r"/\*|\*/")
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")": "(", "]": "[", "}": "{"}


class Source:
    """The tokens of a text: text, at (place), line, depth (of braces) and pair (index of the other bracket, or -1) of each."""

    def __init__(self, text: str, language: str):
        self.code, self.language = text, language
        self.text: list[str] = []
        self.at: list[int] = []
        self.line: list[int] = []
        self.depth: list[int] = []
        self.pair: list[int] = []
        #: (raw text, name, is local, place) of includes.
        self.includes: list[tuple[str, str, bool, int]] = []
        self._stack: list[int] = []
        self._round: list[list[int]] = [[0, 0]]  # open ( and [ in each open brace
        self._open_until = dict.fromkeys(('"', "'", "`", '"""', "/", "("), 0)
        self._inside: list[tuple[str, int]] = []  # strings around: how they begin, number of open braces
        self._count = 1
        self._counted = 0
        self._read()

    def __len__(self) -> int:
        return len(self.text)

    def _add(self, text: str, at: int) -> None:
        n = len(self.text)
        self._count += self.code.count("\n", self._counted, at)
        self._counted = at
        other = -1
        if text in _CLOSES:
            other = self._close(text)
        self.text.append(text)
        self.at.append(at)
        self.line.append(self._count)
        self.depth.append(len(self._round) - 1)
        self.pair.append(other)
        if other >= 0:
            self.pair[other] = n
        if text in _OPENS:
            self._stack.append(n)
            if _OPENS[text] == "}":
                self._round.append([0, 0])
            else:
                self._round[-1][text == "["] += 1

    def _close(self, text: str) -> int:
        """The opener of a closing bracket; what else is open within stays without a closer. A brace ends round brackets, not the other way round."""
        if text == "}":
            if len(self._round) == 1:
                return -1
            while True:
                other = self._stack.pop()
                if self.text[other] in ("{", "${"):
                    self._round.pop()
                    return other
        square = text == "]"
        if not self._round[-1][square]:
            return -1
        while True:
            other = self._stack.pop()
            self._round[-1][self.text[other] == "["] -= 1
            if self.text[other] == _CLOSES[text]:
                return other

    def _read(self) -> None:
        """What isn't closed is one character; up to the end of its line, or of the text, nothing of its kind is looked for again."""
        code, language, at, n = self.code, self.language, 0, len(self.code)
        script = language == "script"
        while m := _START.search(code, at):
            at = m.start()
            c = code[at]
            if c in "\"'`":
                at = self._string(at, c)
            elif c == "/" and code.startswith("//", at):
                at = code.find("\n", at)
                at = n if at < 0 else at
            elif c == "/" and code.startswith("/*", at):
                at = self._comment(at)
            elif c == "/" and script and at >= self._open_until["/"] and self._operand_may_start():
                found = _PATTERN.match(code, at)
                if found:
                    self._add('"' + found[0], at)  # a value, as a string is
                    at = found.end()
                else:
                    line = code.find("\n", at)
                    self._open_until["/"] = n if line < 0 else line
                    self._add(c, at)
                    at += 1
            elif c == "#" and language == "cpp" and self._first_of_line(at):
                at = self._directive(at)
            elif c == "}" and self._inside and self._inside[-1][1] == len(self._round) - 1:
                self._add(c, at)
                at = self._template(at + 1, self._inside.pop()[0])
            else:
                t = _TOKEN.match(code, at)[0]
                if language == "cpp" and code.startswith('"', at + len(t)) and t in ("R", "LR", "uR", "UR", "u8R") and at >= self._open_until["("]:
                    found = _RAW.match(code, at + len(t))
                    end = code.find(f'){found[1]}"', found.end()) if found else -1
                    if end >= 0:
                        self._add('"', at)
                        at = end + len(found[1]) + 2
                        continue
                    if found:
                        self._open_until["("] = n
                self._add(t, at)
                at += len(t)

    def _first_of_line(self, at: int) -> bool:
        """Whether only white space, of up to 200 characters, stands before a place in its line."""
        low = max(0, at - 200)
        start = self.code.rfind("\n", low, at) + 1
        return (start > 0 or low == 0) and not self.code[start:at].strip()

    def _operand_may_start(self) -> bool:
        before = self.text[-1] if self.text else ""
        return not before or before in _OPERAND or before not in (")", "]") and not _WORD.match(before)

    def _string(self, at: int, quote: str) -> int:
        code, kinds = self.code, {"script": "`", "kotlin": '"'}.get(self.language)
        if quote == '"' and self.language in ("java", "kotlin") and code.startswith('"""', at) and at >= self._open_until['"""']:
            if self.language == "kotlin":
                return self._template(at + 3, '"""', at)
            found = _BLOCK.match(code, at)
            if found:
                self._add('"', at)
                return found.end()
            self._open_until['"""'] = len(code)
        if at >= self._open_until[quote] and (quote != "`" or self.language in ("script", "kotlin")):
            if quote == kinds:
                return self._template(at + 1, quote, at)
            found = _PLAIN[quote].match(code, at)
            if found:
                self._add(found[0], at)
                return found.end()
            line = code.find("\n", at)
            self._open_until[quote] = len(code) if line < 0 else line
        self._add(quote, at)
        return at + 1

    def _template(self, at: int, kind: str, start: int | None = None) -> int:
        """Reads on in a string that holds code, from its start or after such code; gives the place behind its end or before the next code's own."""
        code = self.code
        end = _TEMPLATES[kind].match(code, at).end()
        first = at if start is None else start
        if code.startswith(kind, end):
            end += len(kind)
            if kind == '"""':  # more quotes before the last three belong to the string
                while code.startswith('"', end):
                    end += 1
            self._add(code[first:end] if start is not None and kind != '"""' else '"', first)
            return end
        if code.startswith("${", end):
            self._add('"', first)
            self._add("${", end)
            self._inside.append((kind, len(self._round) - 1))
            return end + 2
        line = code.find("\n", at) if kind == '"' else -1
        self._open_until[kind] = len(code) if line < 0 else line
        if start is None:
            return at
        self._add(kind[0], start)
        return start + 1

    def _comment(self, at: int) -> int:
        if self.language != "kotlin":
            end = self.code.find("*/", at + 2)
            return len(self.code) if end < 0 else end + 2
        level = 0
        for m in _COMMENT.finditer(self.code, at):
            level += 1 if m[0] == "/*" else -1
            if not level:
                return m.end()
        return len(self.code)

    def _directive(self, at: int) -> int:
        found = _INCLUDE.match(self.code, at)
        if found:
            self.includes.append((found[0].strip(), found[2], found[1] == '"', at))
        return max(_DIRECTIVE.match(self.code, at).end(), found.end() if found else 0)

    @cached_property
    def angle(self) -> list[int]:
        """For each < the index of its >, or -1: both within the same brackets and statement."""
        out = [-1] * len(self)
        levels: list[list[int]] = [[]]
        for i, t in enumerate(self.text):
            if t == "<":
                levels[-1].append(i)
            elif t == ">":
                if levels[-1]:
                    out[levels[-1].pop()] = i
            elif t in _OPENS:
                if t in ("{", "${") and self.language != "script":  # types of scripts may have braces
                    levels[-1].clear()
                levels.append([])
            elif t in _CLOSES:
                if self.pair[i] >= 0 and len(levels) > 1:
                    levels.pop()
            elif t == ";":
                levels[-1].clear()
        return out

    def __getitem__(self, i: int) -> str:
        """The text of a token; nothing beyond the ends."""
        return self.text[i] if 0 <= i < len(self.text) else ""

    def name(self, i: int) -> bool:
        return bool(_NAME.match(self[i])) or len(self[i]) > 2 and self[i][0] == "`"

    def new_line(self, i: int) -> bool:
        """Whether a token is the first of its line."""
        return i == 0 or i < len(self) and self.line[i] > self.line[i - 1]

    def past(self, i: int) -> int:
        """The index behind a bracket and what it holds; that of the next token if it isn't closed, or no bracket."""
        other = self.angle[i] if self[i] == "<" else self.pair[i]
        return other + 1 if other > i else i + 1

    def level(self, opener: int = -1) -> Iterator[int]:
        """Indexes of the tokens directly in a bracket (or in the text): of those within brackets in it only the openers."""
        end = len(self)
        if opener >= 0:
            end = self.pair[opener] if self.pair[opener] > opener else len(self)
        i = opener + 1
        while i < end:
            yield i
            i = self.pair[i] + 1 if self.text[i] in _OPENS and self.pair[i] > i else i + 1

    def joined(self, a: int, b: int) -> str:
        """Tokens a to b as in the text, with one space for each gap."""
        out = [self.text[a]]
        for i in range(a + 1, b + 1):
            gap = self.at[i] > self.at[i - 1] + len(self.text[i - 1])
            out.append((" " if gap else "") + self.text[i])
        return "".join(out)

    @cached_property
    def _lines(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.code))]

    @cached_property
    def _bytes(self) -> list[int]:
        return [0, *accumulate(len(c.encode("utf-8", "replace")) for c in self.code)]

    def position(self, place: int) -> tuple[int, int]:
        """(line from 1, column in bytes from 0) of a place in the text."""
        line = bisect_right(self._lines, place)
        start = self._lines[line - 1]
        return line, place - start if self.code.isascii() else self._bytes[place] - self._bytes[start]


Rows = dict[str, list[tuple]]


def _rows() -> Rows:
    return {k: [] for k in ("import", "dynamic", "symbol", "call", "binding", "warning")}


#: kind, name, index of the word that declares it, index of the brace of its body or -1.
Type = tuple[str, str, int, int]

_CONTROL = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "synchronized", "super", "this", "when", "sizeof", "operator", "alignof", "decltype", "static_assert", "defined"}


def _body(s: Source, i: int, ends: set[str]) -> int:
    """The brace that opens the body of what is declared before i; -1 if a declaration ends or another begins first.

    Each token is passed by at most one search: a search ends where the next
    declaration begins.
    """
    while i < len(s):
        t = s.text[i]
        if t == "{":
            return i
        if t in ends or t in _CLOSES:
            return -1
        if s.language == "kotlin" and s.new_line(i) and t not in (":", ",", "where", "<", "(", "constructor") and s[i - 1] not in (":", ",", "by", "where"):
            return -1
        i = s.past(i) if t in ("(", "[", "<") else i + 1
    return -1


def _types(s: Source, kinds: dict[str, str]) -> list[Type]:
    """The types declared anywhere in the text."""
    out = []
    ends = {*kinds, ";", "=", "fun", "val", "var", "import"}
    for i, t in enumerate(s.text):
        if t in kinds and s.name(i + 1) and s[i - 1] not in (".", "?."):
            out.append((kinds[t], s[i + 1], i, _body(s, i + 2, ends)))
    return out


def _calls(s: Source, receiver: str, name: str) -> list[tuple]:
    """Calls of the form receiver.name( as rows."""
    out = []
    t = s.text
    for i in range(len(t) - 3):
        if t[i + 3] == "(" and t[i + 1] == "." and re.match(receiver, t[i]) and re.match(name, t[i + 2]):
            out.append((f"method:{t[i]}.{t[i + 2]}", "", t[i], t[i + 2], s.line[i]))
    return out


def _dotted(s: Source, i: int) -> tuple[str, int]:
    """(a.b.c or a.b.*, index behind it) of a dotted name; an empty one where none stands."""
    if not s.name(i):
        return "", i
    parts = [s[i]]
    i += 1
    while s[i] == "." and (s.name(i + 1) or s[i + 1] == "*"):
        parts.append(s[i + 1])
        i += 2
        if parts[-1] == "*":
            break
    return ".".join(parts), i


def java(text: str) -> Rows:
    out, s = _rows(), Source(text, "java")
    for i, t in enumerate(s.text):
        if t == "import" and s.depth[i] == 0:
            static = s[i + 1] == "static"
            name, end = _dotted(s, i + 1 + static)
            if name and s[end] == ";":
                star = name.endswith(".*")
                out["import"].append((f"import {'static ' if static and not star else ''}{name};", name, 0, "", *s.position(s.at[i]), star))
    types = _types(s, {"class": "class", "interface": "interface", "enum": "enum", "@interface": "annotation"})
    for i, t in enumerate(s.text):
        # record is a word like others but before a name, its components and a body
        if t == "record" and s.name(i + 1) and s[i - 1] not in (".", "=", "(", ","):
            at = s.past(i + 2) if s[i + 2] == "<" else i + 2
            after = s.past(at) if s[at] == "(" else -1
            if after > 0 and s[after] in ("{", "implements"):
                types.append(("class", s[i + 1], i, _body(s, after, {";"})))
    types.sort(key=lambda x: x[2])
    named = {i + 1 for _, _, i, _ in types}
    for kind, name, i, _ in types:
        out["symbol"].append((kind, name, f"{kind}:{name}", s.line[i]))
    methods = []
    for kind, name, _, body in types:
        if body < 0 or kind not in ("class", "interface"):
            continue
        value = False  # whether what stands here belongs to a field's value
        for i in s.level(body):
            t = s.text[i]
            if t in (";", "{"):
                value = False
            elif t == "=":
                value = True
            elif not value and i not in named and s[i + 1] == "(" and _NAME.match(t) and t != name and t not in _CONTROL and re.match(r"[\w$>\]]", s[i - 1]) and s[i - 1] not in _CONTROL:
                methods.append((i, t, name))
    out["symbol"] += [("method", t, f"method:{owner}.{t}", s.line[i]) for i, t, owner in sorted(methods)]
    out["call"] = _calls(s, "[A-Z]", "[a-z]")
    return out


def kotlin_package(text: str) -> str:
    """The package that a Kotlin file declares; an empty string if none."""
    s = Source(text, "kotlin")
    for i in s.level():
        if s.text[i] == "package" and s.new_line(i):
            return _dotted(s, i + 1)[0].replace("`", "")
    return ""


def _kotlin_name(s: Source, i: int) -> tuple[str, str]:
    """(receiver, name) declared behind fun, val or var: type parameters are passed over, and those of the receiver."""
    if s[i] == "<":
        i = s.past(i)
    receiver = ""
    while s.name(i) or s[i] == "(":
        here, after = s[i], s.past(i) if s[i] == "(" else i + 1
        if s[after] == "<" and s.angle[after] > 0 and s[s.angle[after] + 1] in (".", "?.", "?"):
            after = s.past(after)
        if s[after] == "?" and s[after + 1] == ".":
            after += 1
        if s[after] not in (".", "?."):
            return receiver, here.strip("`") if here != "(" else ""
        receiver, i = here.strip("`") if here != "(" else "", after + 1
    return receiver, ""


def kotlin(text: str) -> Rows:
    """Members of types within types have the names of all around them; those of a companion are the outer type's own. What a function's body declares is local."""
    out, s = _rows(), Source(text, "kotlin")
    for i in s.level():
        if s.text[i] == "import" and s.new_line(i):
            name, end = _dotted(s, i + 1)
            if name and s[end] == "as" and s.name(end + 1):
                name = f"{name} as {s[end + 1]}"
            if name:
                out["import"].append((f"import {name}", name, 0, "", *s.position(s.at[i]), name.endswith(".*")))
    kinds = {"class", "interface", "object"}
    ends = {*kinds, ";", "=", "fun", "val", "var", "typealias", "import", "companion"}
    types, members = [], []
    waiting = [(-1, "")]
    while waiting:
        opener, owner = waiting.pop()
        inside = owner + "." if owner else ""
        for i in s.level(opener):
            t = s.text[i]
            if t in kinds and s[i - 1] not in (".", "?.", ":", "::"):
                if t == "object" and s[i - 1] == "companion":
                    body = _body(s, i + 1 + s.name(i + 1), ends)
                    if body >= 0:
                        waiting.append((body, owner))
                elif s.name(i + 1) and s[i + 1] not in kinds:
                    name = s[i + 1].strip("`")
                    types.append((i, name, inside + name))
                    body = _body(s, i + 2, ends)
                    if body >= 0:
                        waiting.append((body, inside + name))
                    given = s.past(i + 2) if s[i + 2] == "<" else i + 2
                    if s[given] == "(":
                        members += [(j, "property", s[j + 1].strip("`"), f"property:{inside}{s[j + 1].strip('`')}") for j in s.level(given) if s.text[j] in ("val", "var") and s.name(j + 1)]
            elif t in ("fun", "val", "var") and s[i + 1] != "interface":
                receiver, name = _kotlin_name(s, i + 1)
                if not name:
                    continue
                if t != "fun":
                    members.append((i, "property", name, f"property:{inside}{name}"))
                elif owner:
                    members.append((i, "method", name, f"method:{inside}{name}"))
                else:
                    members.append((i, "function", name, f"function:{receiver + '.' if receiver else ''}{name}"))
    out["symbol"] = [("class", name, f"class:{full}", s.line[i]) for i, name, full in sorted(types)]
    out["symbol"] += [(kind, name, fqn, s.line[i]) for i, kind, name, fqn in sorted(members)]
    out["call"] = _calls(s, "[a-z]", r"[^\W\d]")
    return out


def functions(s: Source) -> list[int]:
    """Indexes of the names of C and C++ functions that have a body."""
    out = []
    constructors = set()
    for _, name, _, body in _types(s, {"class": "class", "struct": "struct"}):
        if body >= 0:
            constructors.update(i for i in s.level(body) if s.text[i] == name and s[i - 1] in ("{", "}", ";", ":"))
    for i in range(1, len(s) - 1):
        t, before = s.text[i], s.text[i - 1]
        if s.text[i + 1] != "(" or not _NAME.match(t) or t in _CONTROL or before in _CONTROL or s.pair[i + 1] < 0:
            continue
        if not re.match(r"[\w*&>~]", before) and not (before == ":" and s[i - 2] == ":") and i not in constructors:
            continue
        at = s.pair[i + 1] + 1
        while s[at] in ("const", "volatile", "noexcept", "override", "final", "&", "try") or s[at] == "(" and s[at - 1] == "noexcept":
            at = s.past(at)
        if s[at] == "->":
            at += 1
            while re.match(r"[\w:*&]", s[at]) or s[at] == "<":
                at = s.past(at) if s[at] == "<" else at + 1
        elif s[at] == ":" and s[at + 1] != ":":
            # what a constructor's members begin with
            at += 1
            while _NAME.match(s[at]):
                while _NAME.match(s[at]) or s[at] in (":", "<"):
                    at = s.past(at) if s[at] == "<" else at + 1
                if s[at] not in ("(", "{") or s.pair[at] < 0:
                    break
                at = s.pair[at] + 1
                if s[at] != ",":
                    break
                at += 1
        if s[at] == "{":
            out.append(i)
    return out


def cpp(text: str) -> Rows:
    out, s = _rows(), Source(text, "cpp")
    for raw, name, local, at in s.includes:
        out["import"].append((raw, name, int(local), "", *s.position(at), False))
    found = [(i, "function", s.text[i], f"function:{s.text[i]}") for i in functions(s)]
    for i, t in enumerate(s.text):
        if t == "class" and s.name(i + 1) and s[i - 1] != "enum":
            after = s.past(i + 2) if s[i + 2] == "<" else i + 2
            if s[after] in ("{", ":", "final"):
                found.append((i, "class", s[i + 1], s[i + 1]))
    out["symbol"] = [(kind, name, fqn, s.line[i]) for i, kind, name, fqn in sorted(found)]
    return out


def _literal(t: str) -> str:
    """What a string token without code in it holds; empty for others."""
    return t[1:-1] if len(t) > 2 and t[0] in "\"'`" and t[-1] == t[0] else ""


def _module_statement(s: Source, i: int) -> int:
    """The index of the string that an import or export names its module by; -1 if it names none."""
    at = i + 1
    if s.text[i] == "import" and _literal(s[at]):
        return at
    if s[at] in ("type", "typeof") and s[at + 1] not in ("from", ","):
        at += 1
    if s.text[i] == "import" and s.name(at) and s[at] != "from":
        at += 1
        if s[at] == ",":
            at += 1
    if s[at] == "{":
        at = s.past(at)
    elif s[at] == "*":
        at += 1
        if s[at] == "as":
            at += 2
    elif s.text[i] == "export":
        return -1
    return at + 1 if s[at] == "from" and _literal(s[at + 1]) else -1


_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "abstract", "override", "get", "set", "declare", "accessor"}


def _class_members(s: Source, body: int) -> Iterator[tuple[int, str, bool]]:
    """(index, name, has parameters) of what a class body declares."""
    begins = True
    last = body
    decorator = -1
    for i in s.level(body):
        t = s.text[i]
        if not begins and s.line[i] > s.line[last] and re.match(r"[\w$#@*\[]", t) and re.match(r"[\w$)\]}>\"'`;]", s[i - 1]) and decorator != i - 1:
            begins = True
        last = i
        if t in (";", "{"):
            begins = True
            continue
        if not begins or t == "*" or t[0] == "@" or s[i - 1] == "." or t == "(" and begins:
            continue  # a decorator and what it is given
        after = s[i + 1]
        if t == "#" and s.name(i + 1):
            t, after = "#" + s[i + 1], s[i + 2]
        if t in _MODIFIERS and after not in ("(", ":", "=", ";", "?", "!", "<"):
            continue
        if _NAME.match(t) or t[0] == "#" and len(t) > 1:
            if after == "." and s[i - 1][:1] == "@":
                continue
            if after in ("(", "<") or after == "?" and s[i + 2] == "(":
                yield i, t, True
            elif t not in _CONTROL and (after in (":", "=", ";", "?", "!", "}") or s.new_line(i + 1)):
                yield i, t, False
        begins = False


def _script(text: str, typed: bool) -> Rows:
    out, s = _rows(), Source(text, "script")
    imports = []
    for i, t in enumerate(s.text):
        if t in ("import", "export") and (i == 0 or s.new_line(i) or s[i - 1] in (";", "}", "{")):
            end = _module_statement(s, i)
            if end > 0:
                raw = s.joined(i, end + (s[end + 1] == ";"))
                imports.append((0, i, (raw, _literal(s[end]), 0, "import", *s.position(s.at[i]), "* as" in raw)))
        elif t == "require" and s[i + 1] == "(" and s[i - 1] not in (".", "?.", "function"):
            close = s.pair[i + 1]
            name = _literal(s[i + 2]) if close == i + 3 else ""
            raw = s.code[s.at[i] : s.at[close] + 1 if close > 0 else s.at[i] + 8]
            raw = raw if name or len(raw) < 200 else raw[:200] + "..."
            imports.append((1, i, (f"const ... = {raw}", name, 0, "require" if name else "dynamic", *s.position(s.at[i]), False)))
    out["import"] = [row for _, _, row in sorted(imports, key=lambda x: x[:2])]
    kinds = {"function": "function", "class": "class"} | ({"interface": "interface", "type": "type", "enum": "enum"} if typed else {})
    for i, t in enumerate(s.text):
        if s.depth[i] or t not in kinds or s[i - 1] in (".", "=", "(", ",", ":", "?."):
            continue
        name = s[i + 2] if s[i + 1] == "*" else s[i + 1]
        if not _NAME.match(name) or t == "type" and s[i + 2] not in ("=", "<"):
            continue
        out["symbol"].append((kinds[t], name, name if typed else f"{kinds[t]}:{name}", s.line[i]))
    if typed:
        members = []
        for _, owner, _, body in _types(s, {"class": "class"}):
            if body >= 0:
                members += [(i, ("constructor" if name == "constructor" else "method") if called else "property", name, owner) for i, name, called in _class_members(s, body)]
        out["symbol"] += [(kind, name, f"{owner}.{name}", s.line[i]) for i, kind, name, owner in sorted(members)]
    return out


def javascript(text: str) -> Rows:
    return _script(text, False)


def typescript(text: str) -> Rows:
    return _script(text, True)
