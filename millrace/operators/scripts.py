"""Functions, classes and methods of TypeScript and JavaScript by their tokens.

The scanner knows strings, comments, regular expressions and templates, whose ${code} is code again, so braces in them count for
nothing. Over the tokens, statements of the top level and members of class bodies are told apart. Whatever doesn't close or fit
is a doubt, and the file is left to windows of lines.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Doubt(Exception):
    """The text isn't understood."""


class Token(NamedTuple):
    text: str
    line: int


class Region(NamedTuple):
    """Lines first to last (from 0, inclusive); methods: those of a class."""

    first: int
    last: int
    symbol: str
    methods: tuple = ()


_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_SIGN = re.compile(r"=>|\.\.\.|\?\.|[^\s\w]")
#: What needs no look around: white space and comments, words, signs but those that may begin or end something longer.
_PLAIN = re.compile(r"(\s+|//[^\n]*|/\*.*?\*/)|([#]?[\w$]+|=>|\.\.\.|\?\.|[^\s\w\"'`{}/])", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: After these a slash divides; after other signs and words it begins a regular expression.
_KEYWORDS = {"return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "else", "do", "await", "yield", "instanceof"}
#: Words that begin a statement, modifiers of declarations and of members.
_STARTS = {"import", "export", "const", "let", "var", "function", "class", "if", "for", "while", "return", "type", "interface", "async", "enum", "abstract", "declare", "namespace", "switch", "try", "throw", "@"}
_MEMBER = {"public", "private", "protected", "static", "async", "readonly", "override", "abstract", "get", "set", "accessor", "declare", "*"}
_JOINS = {"=", ",", ".", "+", "-", "*", "/", "?", ":", "|", "&", "(", "[", "{", "=>", "<", ">", "?.", "!", "%", "^"}


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, braces = 0, 0, []  # braces: whether each open one belongs to a template

    def take(m: re.Match | None, keep: bool = True) -> None:
        nonlocal at, line
        if m is None or m.end() == at:
            raise Doubt
        if keep:
            out.append(Token(m[0], line))
        line += m[0].count("\n")
        at = m.end()

    def template() -> None:
        m = _TEMPLATE.match(text, at)
        take(m, False)
        if m[1] == "${":
            braces.append(True)

    plain = _PLAIN.match
    while at < len(text):
        if m := plain(text, at):
            at = m.end()
            if m[2]:
                out.append(Token(m[2], line))
            else:
                line += m[1].count("\n")
        elif text[at] in "\"'":
            take(_STRING.match(text, at))
        elif text[at] == "`":
            out.append(Token("`", line))
            at += 1
            template()
        elif text[at] == "}" and braces and braces[-1]:
            braces.pop()
            at += 1
            template()
        elif text[at] == "/" and _regex_may_follow(out):
            take(_REGEX.match(text, at))
        else:
            take(_SIGN.match(text, at))
            if out[-1].text == "{":
                braces.append(False)
            elif out[-1].text == "}":
                if not braces:
                    raise Doubt
                braces.pop()
    if braces:
        raise Doubt
    return out


def _regex_may_follow(out: list[Token]) -> bool:
    last = out[-1].text if out else ";"
    return last in _KEYWORDS or not (re.match(r"[\w$#\"'`/]", last) or last in ")]}")


def closings(text: list[str]) -> dict[int, int]:
    """Where each bracket is closed. Those that aren't, or that hold another's closing one, are left out."""
    out, open_ = {}, []
    for j, t in enumerate(text):
        if t in _CLOSES:
            open_.append(j)
        elif t in (")", "]", "}") and open_:
            if _CLOSES[text[open_[-1]]] == t:
                out[open_.pop()] = j
            else:
                open_.clear()
    return out


class Reader:
    """Places in the tokens of a file."""

    def __init__(self, own: list[Token]):
        self.own = own
        self.text = [t.text for t in own]
        self.closed = closings(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if i < len(self.text) else ""

    def name(self, i: int) -> bool:
        return bool(re.match(r"[#A-Za-z_$]", self.at(i)))

    def past(self, i: int) -> int:
        """Behind the bracket that closes the one at i."""
        if i not in self.closed:
            raise Doubt
        return self.closed[i] + 1

    def body(self, i: int) -> int | None:
        """The brace that opens the body of the function or class whose head goes on at i; None if a line ends first. Braces of types are passed."""
        while i < len(self.own):
            t = self.at(i)
            if t == "{" and self.at(i - 1) not in ("<", ",", "|", "&", ":", "=>", "(", "["):
                return i
            if t == ";" or t == "}":
                return None
            i = self.angles(i) if t == "<" else self.past(i) if t in _CLOSES else i + 1
        return None

    def angles(self, i: int) -> int:
        """Behind the type arguments that open at i."""
        depth = 0
        while i < len(self.own):
            t = self.at(i)
            depth += (t == "<") - (t == ">")
            if t in (";", ")", "]", "}"):
                raise Doubt
            i = self.past(i) if t in _CLOSES else i + 1
            if not depth:
                return i
        raise Doubt

    def decorators(self, i: int) -> int:
        while self.at(i) == "@":
            i += 2
            while self.at(i) == ".":
                i += 2
            i = self.past(i) if self.at(i) == "(" else i
        return i

    def end(self, i: int, stop: int) -> int:
        """Behind the statement or member that goes on at i, `stop` at most."""
        while i < stop:
            t = self.at(i)
            i = self.past(i) if t in _CLOSES else i + 1
            if t == ";":
                return i
            opens = self.at(i) in _STARTS or self.at(i) in ("*", "[") or self.at(i) not in _JOINS | {")", "]", "}", ";"}
            if i < stop and self.own[i].line > self.own[i - 1].line and self.at(i - 1) not in _JOINS and opens:
                return i
        return stop

    def top(self) -> list[Region]:
        out, i = [], 0
        while i < len(self.own):
            found, i = self.statement(i)
            out += [found] if found else []
        return out

    def statement(self, i: int) -> tuple[Region | None, int]:
        """(the function or class that begins at i, if one does; behind it)."""
        first, start = self.own[i].line, i
        i = self.decorators(i)
        while self.at(i) in ("export", "default", "async", "declare"):
            i += 1
        i = self.decorators(i)
        if self.at(i) == "function":
            i += 2 if self.at(i + 1) == "*" else 1
            brace = self.body(i + 1) if self.name(i) else None
            if brace is not None:
                past = self.past(brace)
                return Region(first, self.own[past - 1].line, self.at(i)), past
        elif self.at(i) == "class" and self.name(i + 1):
            brace = self.body(i + 2)
            if brace is None:
                raise Doubt
            past = self.past(brace)
            return Region(first, self.own[past - 1].line, self.at(i + 1), tuple(self.members(brace + 1, past - 1, self.at(i + 1)))), past
        elif self.at(i) in ("const", "let", "var") and self.name(i + 1):
            past = self.function_value(i + 2)
            if past is not None:
                past += self.at(past) == ";"
                return Region(first, self.own[past - 1].line, self.at(i + 1)), past
        past = self.end(start, len(self.own))
        return None, max(past, start + 1)

    def function_value(self, i: int) -> int | None:
        """Behind the arrow function or function that is the value of a declared name, whose type or sign of equality is at i."""
        while self.at(i) not in ("=", ";", ",", ""):
            i = self.past(i) if self.at(i) in _CLOSES else i + 1
        if self.at(i) != "=":
            return None
        i += 2 if self.at(i + 1) == "async" else 1
        if self.at(i) == "function":
            brace = self.body(i + 1)
            past = None if brace is None else self.past(brace)
        else:
            while self.at(i) not in ("(", "=>", ";", "") and (self.name(i) or self.at(i) in "<>,"):
                i += 1
            i = self.past(i) if self.at(i) == "(" else i
            while self.at(i) not in ("=>", ";", "{", "") and self.own[i].line == self.own[i - 1].line:
                i = self.past(i) if self.at(i) in ("(", "[") else i + 1
            if self.at(i) != "=>":
                return None
            past = self.past(i + 1) if self.at(i + 1) == "{" else self.end(i + 1, len(self.own))
            past -= self.at(past - 1) == ";"
        return past if past is not None and self.at(past) not in (",", "(", ".", "as") else None

    def members(self, i: int, stop: int, owner: str) -> list[Region]:
        out = []
        while i < stop:
            i = self.decorators(i)
            start = i
            while self.at(i) in _MEMBER and self.at(i + 1) not in ("(", "=", ";", ":", "?", "!", "<"):
                i += 1
            named = i
            i = self.past(i) if self.at(i) == "[" else i + 1
            name = "".join(t.text for t in self.own[named:i])
            i += self.at(i) == "?"
            i = self.angles(i) if self.at(i) == "<" else i
            brace = self.body(self.past(i)) if self.at(i) == "(" else None
            if brace is not None and brace < stop:
                past = self.past(brace)
                out.append(Region(self.own[start].line, self.own[past - 1].line, f"{owner}.{name}"))
            else:
                past = self.end(start, stop)
            i = max(past, start + 1)
        return out


def regions(lines: list[str]) -> list[Region] | None:
    """The functions (declared, or values of names) and classes at the top level, in order; None in doubt."""
    try:
        found = Reader(tokens("\n".join(lines))).top()
    except (Doubt, RecursionError):
        return None
    return found if all(a.last < b.first for a, b in zip(found, found[1:])) else None
