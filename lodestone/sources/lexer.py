"""Tokens of Rust, JavaScript and TypeScript: words, numbers, strings and signs with their places, comments left out.

Strings, raw strings, characters against lifetimes, nested comments, templates with code in them, and regular expressions
against divisions are told apart, so that brackets and names inside them count for nothing. What does not close is counted
as an error and read to the end of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_WORD = r"[^\W\d][\w]*"
_SIGNS = r"::|=>|->|\.\.\.|\.\.=?|\?\.|&&|\|\||[-+*/%&|^!<>=]=|<<|>>(?!=)|."
_COMMON = rf"(?P<word>{_WORD})|(?P<number>\d[\w.]*)"
_RUST = re.compile(rf"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hashes>\#*)")|(?P<string>b?"(?:\\.|[^"\\])*")|(?P<open>b?")|(?P<char>b?'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^'\\])')|(?P<life>'{_WORD})|{_COMMON}|(?P<sign>{_SIGNS})""", re.S)
_SCRIPT = re.compile(rf"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<open>["'])|(?P<template>`)|(?P<word>[$@\#]?[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>{_SIGNS})""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class Tokens:
    """The tokens of a text, the partner of each bracket, and how many things do not close."""

    def __init__(self, text: str, rust: bool):
        self.text, self.items, self.errors, self._in_template = text, [], 0, 0
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self._read(0, len(text), rust)
        self.partner: dict[int, int] = {}
        self.depth, open_ = 0, []
        for i, t in enumerate(self.items):
            if t.kind != "sign":
                continue
            if t.text in "([{":
                open_.append(i)
                self.depth = max(self.depth, len(open_))
            elif t.text in _PAIRS:
                if open_ and self.items[open_[-1]].text == _PAIRS[t.text]:
                    self.partner[i] = open_[-1]
                    self.partner[open_.pop()] = i
                else:
                    self.errors += 1
        self.errors += len(open_)

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def column(self, at: int) -> int:
        n = bisect_right(self.breaks, at - 1)
        return at - (self.breaks[n - 1] + 1 if n else 0)

    def _read(self, at: int, end: int, rust: bool) -> int:
        """Reads from a place on; in a template's code up to the bracket that ends it."""
        pattern, nested = (_RUST if rust else _SCRIPT), 0
        while at < end:
            if not rust and self.text[at] == "/" and self._regex_may_begin() and (m := _REGEX.match(self.text, at)):
                self.items.append(Token("regex", m[0], at))
                at = m.end()
                continue
            m = pattern.match(self.text, at)
            kind, stop = m.lastgroup, m.end()
            if kind == "hashes":
                kind = "raw"
            if kind == "block":
                stop = self._comment(stop, rust)
            elif kind == "raw":
                closing = self.text.find('"' + m["hashes"], stop)
                self.errors += closing < 0
                stop = closing + 1 + len(m["hashes"]) if closing >= 0 else end
                self.items.append(Token("string", self.text[at:stop], at))
            elif kind == "template":
                stop = self._template(at)
            elif kind == "open":
                self.errors += 1
                stop = end if rust else next((b for b in self.breaks if b >= at), end)
            elif kind in ("word", "number", "string", "char", "life", "sign"):
                if kind == "sign" and m[0] in "{}":
                    nested += 1 if m[0] == "{" else -1
                    if nested < 0 and self._in_template:
                        return at
                self.items.append(Token("string" if kind == "char" else kind, m[0], at))
            at = stop
        return at

    def _regex_may_begin(self) -> bool:
        if not self.items:
            return True
        last = self.items[-1]
        return last.kind == "sign" and last.text not in (")", "]", "}") or last.kind == "word" and last.text in _BEFORE_REGEX

    def _comment(self, at: int, nested: bool) -> int:
        depth = 1
        for m in re.compile(r"/\*|\*/").finditer(self.text, at):
            depth += (1 if nested else 0) if m[0] == "/*" else -1
            if not depth:
                return m.end()
        self.errors += 1
        return len(self.text)

    def _template(self, start: int) -> int:
        at, text = start + 1, self.text
        self.items.append(Token("string", "`", start))
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                self._in_template += 1
                at = self._read(at + 2, len(text), False) + 1
                self._in_template -= 1
            else:
                at += 1
        self.errors += 1
        return len(text)
