"""Symbols, imports and references of source files: Python by its own parser, Rust, JavaScript and TypeScript by their
tokens and brackets. Files are independent; a table of them is dealt out by path first, since reading costs far more than
moving and a small file of Parquet is one task however many rows it has.

A file that its parser refuses has no symbols; one of tokens gives what can be told, and parse_stats() counts what does
not close. Nulls are empty files.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lexer import Tokens
from .shared import cut

SYMBOL = "path string, name string, type string, visibility string, start int, end int, column int, parent string, text string"
REFERENCE = "path string, name string, kind string, line int, text string"
IMPORT = "path string, module string, items array<string>, alias string, wildcard boolean, line int"
PARTS = "path string, part string, name string, kind string, start int, end int, column int, parent string, text string, items array<string>, alias string, wildcard boolean"
STATS = "path string, nodes int, named int, depth int, errors int"

_RUST_ITEMS = {"fn": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "constant", "static": "constant", "type": "type"}
_SCRIPT_ITEMS = {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "namespace": "module", "module": "module"}
_LEADS = {"rust": frozenset("pub async unsafe extern default const".split()), "script": frozenset("export default async declare abstract static public private protected readonly override get set".split())}
_NO_CALLS = frozenset("if for while switch catch return match else function fn loop in as move typeof await yield new super self this use where mut ref let const var impl dyn async import pub crate".split())


def language(path: str) -> str:
    return {"py": "python", "rs": "rust", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "tsx": "script"}.get(path.rsplit(".", 1)[-1].lower(), "")


class Parsed:
    """What a file of tokens declares, imports and refers to; fields as in SYMBOL, IMPORT and REFERENCE without the path."""

    def __init__(self, text: str, rust: bool):
        self.t, self.rust = Tokens(text, rust), rust
        self.words = [x.text for x in self.t.items]
        self.symbols: list[tuple] = []
        self.imports: list[tuple] = []
        self.bases: list[tuple[str, str, int]] = []
        self.defined: set[int] = set()
        self._scan()

    # places
    def line(self, i: int) -> int:
        return self.t.line(self.t.items[i].at)

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def kind(self, i: int) -> str:
        return self.t.items[i].kind if 0 <= i < len(self.words) else ""

    def _closed(self, i: int) -> int:
        """The partner of an opening bracket, or the last token where it has none."""
        return self.t.partner.get(i, len(self.words) - 1)

    def _generics(self, i: int) -> int:
        """Behind <...> at i, if there is one."""
        if self.word(i) != "<":
            return i
        depth = 0
        while i < len(self.words):
            w = self.words[i]
            depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(w, 0)
            i = self._closed(i) + 1 if w in ("(", "[", "{") else i + 1
            if depth <= 0 or w == ";":
                return i
        return i

    def _until(self, i: int, ends: str) -> int:
        """The first of the signs at or behind i, with brackets skipped; the last token if there is none."""
        while i < len(self.words):
            if self.kind(i) == "sign":
                if self.words[i] in ends:
                    return i
                if self.words[i] in "([{":
                    i = self._closed(i)
                elif self.words[i] in ")]}":
                    return i - 1
            i += 1
        return len(self.words) - 1

    def _statement(self, i: int) -> int:
        """The last token of a script's statement: at ;, or at a line's end where neither side goes on."""
        goes_on = frozenset("= => + - * / % & | && || ? : . ?. , < > ( [ { == != <= >= extends in of instanceof new typeof".split())
        while i + 1 < len(self.words):
            if self.words[i] == ";" and self.kind(i) == "sign":
                return i
            if self.words[i] in ("(", "[", "{") and self.kind(i) == "sign":
                i = self._closed(i)
            if i + 1 >= len(self.words) or self.words[i + 1] in (")", "]", "}"):
                return i
            if self.line(i + 1) > self.line(i) and self.words[i] not in goes_on and self.words[i + 1] not in goes_on - {"{", "new", "typeof"}:
                return i
            i += 1
        return min(i, len(self.words) - 1)

    def _lead(self, i: int) -> int:
        """The first of the words in front of i that belong to its declaration."""
        leads = _LEADS["rust" if self.rust else "script"]
        while i:
            if self.words[i - 1] in leads or self.rust and self.kind(i - 1) == "string" and self.word(i - 2) == "extern":
                i -= 1
            elif self.rust and self.words[i - 1] == ")" and self.word(self.t.partner.get(i - 1, 0) - 1) == "pub":
                i = self.t.partner[i - 1] - 1
            else:
                break
        return i

    def _visible(self, lead: int, at: int) -> str:
        words = self.words[lead:at]
        if self.rust:
            if words[:2] == ["pub", "("]:
                return {"crate": "internal", "super": "protected"}.get(self.word(lead + 2), "unknown")
            return "public" if words[:1] == ["pub"] else "private"
        if "export" in words or "public" in words:
            return "public"
        return "protected" if "protected" in words else "private"

    def _add(self, at: int, name_at: int, kind: str, end: int, scopes: list, visible: str | None = None) -> None:
        lead, name = self._lead(at), self.words[name_at]
        start, stop = self.line(lead), self.line(end)
        parent = "::".join(s[1] for s in scopes) or None
        lines = self.t.text.split("\n") if len(self.t.breaks) < 2 else None
        first = 0 if start == 1 else self.t.breaks[start - 2] + 1
        last = self.t.breaks[stop - 1] if stop <= len(self.t.breaks) else len(self.t.text)
        text = "\n".join(lines[start - 1 : stop]) if lines else self.t.text[first:last]
        self.defined.add(name_at)
        self.symbols.append((name, kind, visible or self._visible(lead, at), start, stop, self.t.column(self.t.items[lead].at), parent, text))

    def _scan(self) -> None:
        i, scopes = 0, []
        while i < len(self.words):
            while scopes and i > scopes[-1][0]:
                scopes.pop()
            i = (self._rust_item if self.rust else self._script_item)(i, scopes) + 1

    # Rust
    def _rust_item(self, i: int, scopes: list) -> int:
        """Reads the item at i, if there is one, and gives the last token that is done with."""
        w = self.words[i]
        if self.kind(i) != "word":
            return i
        if w == "use" and self.word(i - 1) not in (".", "::"):
            end = self._until(i + 1, ";")
            self._use(i + 1, end, "", i)
            base = "::".join(x for x in self.words[i + 1 : next((j for j in range(i + 1, end) if self.words[j] in ("{", "as", "*")), end)] if x != "::")
            self.symbols.append((base, "import", self._visible(self._lead(i), i), self.line(i), self.line(end), 0, None, self.t.text[self.t.items[i].at : self.t.items[end].at + 1]))
            return end
        if w == "impl" and self.word(i - 1) not in ("->", ":", "(", ",", "&", "<", "=", "dyn"):
            return self._impl(i, scopes)
        if w == "macro_rules" and self.word(i + 1) == "!":
            body = i + 3
            end = self._closed(body) if self.word(body) in ("{", "(", "[") else body
            self._add(i, i + 2, "macro", min(end, len(self.words) - 1), scopes)
            return end
        if w not in _RUST_ITEMS or self.kind(i + 1) != "word" or w == "union" and self.word(i + 2) not in ("{", "<") or w == "const" and self.word(i + 1) in ("fn", "unsafe", "async", "extern"):
            return i
        if w in ("const", "static") and self.word(i + 1) == "mut":
            i += 1
        name, kind = i + 1, _RUST_ITEMS[w]
        if w in ("const", "static", "type"):
            self._add(i, name, kind, self._until(name, ";"), scopes)
            return name
        after = self._generics(name + 1)
        body = self._until(after, "{;")
        if body < len(self.words) and self.words[body] in ("(", "["):
            body = self._until(self._closed(body) + 1, "{;")
        while self.word(body) not in ("{", ";") and body < len(self.words) - 1:
            body = self._until(body + 1, "{;")
        opens = self.word(body) == "{"
        end = self._closed(body) if opens else body
        if kind == "function" and scopes and scopes[-1][2] in ("impl", "trait"):
            kind = "method"
        self._add(i, name, kind, end, scopes)
        if opens:
            scopes.append((end, self.words[name], w))
            return body
        return end

    def _impl(self, i: int, scopes: list) -> int:
        at = self._generics(i + 1)
        parts: list[list[int]] = [[]]
        while at < len(self.words) and self.words[at] not in ("{", ";", "where"):
            if self.words[at] == "for":
                parts.append([])
            elif self.words[at] == "<":
                at = self._generics(at) - 1
            elif self.kind(at) == "word":
                parts[-1].append(at)
            at += 1
        while at < len(self.words) and self.words[at] not in ("{", ";"):
            at += 1
        if not parts[-1] or self.word(at) != "{":
            return at
        if len(parts) > 1 and parts[0]:
            self.bases.append((self.words[parts[0][-1]], "trait_impl", parts[0][-1]))
        scopes.append((self._closed(at), self.words[parts[-1][-1]], "impl"))
        return at

    def _use(self, i: int, end: int, prefix: str, at: int) -> None:
        """The imports of a use tree: one for each path with a list, an alias or a star, or of a single name."""
        path, j = [prefix] if prefix else [], i
        items: list[str] = []
        while j < end:
            w = self.words[j]
            if w == "{":
                stop, k = self._closed(j), j + 1
                base = "::".join(path)
                while k < stop:
                    comma = self._until(k, ",")
                    comma = comma if comma < stop and self.word(comma) == "," else stop
                    plain = [x for x in self.words[k:comma] if x != "::"]
                    if len(plain) == 1 and plain[0] not in ("*",) and plain[0] != "self":
                        items.append(plain[0])
                    elif plain == ["self"]:
                        self.imports.append((base, [], base.rsplit("::", 1)[-1], False, self.line(at)))
                    elif plain:
                        self._use(k, comma, base, at)
                    k = comma + 1
                if items:
                    self.imports.append((base, items, None, False, self.line(at)))
                return
            if w == "*":
                self.imports.append(("::".join(path), [], None, True, self.line(at)))
                return
            if w == "as":
                self.imports.append(("::".join(path), [], self.word(j + 1), False, self.line(at)))
                return
            if w != "::":
                path.append(w)
            j += 1
        if path:
            self.imports.append(("::".join(path[:-1]) or path[-1], [path[-1]] if len(path) > 1 else [], None, False, self.line(at)))

    # JavaScript and TypeScript
    def _script_item(self, i: int, scopes: list) -> int:
        w, in_class = self.words[i], bool(scopes) and scopes[-1][2] in ("class", "interface") and self._directly(i, scopes[-1])
        if self.kind(i) != "word" or self.word(i - 1) in (".", "?."):
            return i
        if in_class and (end := self._member(i, scopes)) is not None:
            return end
        if w == "import" and self.word(i + 1) not in ("(", "."):
            return self._script_import(i)
        if w == "require" and self.word(i + 1) == "(" and self.kind(i + 2) == "string":
            self._module(i, self.words[i + 2], [], None, False)
            return i
        if w == "type" and self.kind(i + 1) == "word" and self.word(self._generics(i + 2)) == "=":
            self._add(i, i + 1, "type", self._statement(i), scopes)
            return i + 1
        if w in ("const", "let", "var") and self.kind(i + 1) == "word" and self.word(i + 1) != "enum":
            return self._variable(i, scopes)
        if w not in _SCRIPT_ITEMS:
            return i
        name = i + 2 if w == "function" and self.word(i + 1) == "*" else i + 1
        if self.kind(name) != "word" or self.word(name) in ("extends", "implements"):
            return i
        at = self._generics(name + 1)
        if w == "function":
            at = self._body(self._closed(at) + 1) if self.word(at) == "(" else at
        else:
            while at < len(self.words) and self.words[at] not in ("{", ";"):
                if self.words[at] in ("extends", "implements"):
                    at = self._bases(at)
                else:
                    at = self._generics(at) if self.words[at] == "<" else at + 1
        return self._opened(i, name, _SCRIPT_ITEMS[w], at, scopes, w)

    def _opened(self, i: int, name: int, kind: str, at: int, scopes: list, scope: str) -> int:
        if self.word(at) != "{":
            self._add(i, name, kind, min(at, len(self.words) - 1) if self.word(at) == ";" else min(max(at - 1, name), len(self.words) - 1), scopes)
            return name
        end = self._closed(at)
        self._add(i, name, kind, end, scopes)
        scopes.append((end, self.words[name], scope))
        return at

    def _directly(self, i: int, scope: tuple) -> bool:
        """Whether i stands in the scope's own brackets, and not in others inside them."""
        opened = self.t.partner.get(scope[0])
        if opened is None:
            return False
        j = i - 1
        while j > opened:
            if self.kind(j) == "sign" and self.words[j] in "([{":
                return False
            j = self.t.partner[j] - 1 if self.kind(j) == "sign" and self.words[j] in ")]}" and j in self.t.partner else j - 1
            if j > opened and self.words[j] in (";", "}"):
                return True
        return j == opened

    def _bases(self, at: int) -> int:
        at += 1
        while at < len(self.words) and self.words[at] not in ("{", ";", "implements", "extends"):
            if self.kind(at) == "word" and self.word(at + 1) != ".":
                self.bases.append((self.words[at], "inheritance", at))
            at = self._generics(at + 1) if self.word(at + 1) == "<" else at + 1
        return at

    def _body(self, at: int) -> int:
        """From behind a parameter list to the body's bracket, past a result type."""
        if self.word(at) != ":":
            return at
        at += 1
        while at < len(self.words) and self.words[at] not in (";", "=>"):
            if self.words[at] == "{" and self.words[at - 1] not in (":", "|", "&", "=>"):
                return at
            at = self._closed(at) + 1 if self.words[at] in ("(", "[", "{") else self._generics(at) if self.words[at] == "<" else at + 1
        return at

    def _member(self, i: int, scopes: list) -> int | None:
        if self.words[i] in _LEADS["script"] and self.kind(i + 1) in ("word", "string") or self.word(i - 1) not in ("{", "}", ";", "*", *_LEADS["script"]) and self.line(i) == self.line(i - 1):
            return None
        at = self._generics(i + 2 if self.word(i + 1) == "?" else i + 1)
        lead = self._lead(i)
        private = self.words[i].startswith("#") or "private" in self.words[lead:i]
        visible = "private" if private else "protected" if "protected" in self.words[lead:i] else "public"
        if self.word(at) == "(":
            body = self._body(self._closed(at) + 1)
            if self.word(body) == "{" or scopes[-1][2] == "interface" or self.word(body) == ";":
                end = self._closed(body) if self.word(body) == "{" else body
                self._add(i, i, "method", min(end, len(self.words) - 1), scopes, visible)
                if self.word(body) == "{":
                    scopes.append((end, self.words[i], "method"))
                    return body
                return i
        value = self._until(i + 1, "=;}")
        if self.word(value) == "=" and self.line(value) == self.line(i) and (body := self._arrow(value + 1)) is not None:
            return self._arrowed(i, i, "method", body, scopes, visible)
        return None

    def _arrow(self, at: int) -> int | None:
        """Where the body of a function begins that stands at a place as a value; None if none does."""
        at += self.word(at) == "async"
        if self.word(at) == "function":
            at += 1 + (self.word(at + 1) == "*")
            at += self.kind(at) == "word"
            at = self._generics(at)
            return self._body(self._closed(at) + 1) if self.word(at) == "(" else None
        at = self._generics(at)
        if self.word(at) == "(":
            at = self._body(self._closed(at) + 1)
        elif self.kind(at) == "word":
            at += 1
        return at + 1 if self.word(at) == "=>" else None

    def _arrowed(self, i: int, name: int, kind: str, body: int, scopes: list, visible: str | None = None) -> int:
        opens = self.word(body) == "{"
        end = self._closed(body) if opens else self._statement(body)
        self._add(i, name, kind, end, scopes, visible)
        if opens:
            scopes.append((end, self.words[name], "function"))
        return body if opens else name

    def _variable(self, i: int, scopes: list) -> int:
        value = self._until(i + 2, "=;")
        if self.word(value) == "=" and (body := self._arrow(value + 1)) is not None:
            return self._arrowed(i, i + 1, "function", body, scopes)
        if self.words[i] == "const" and self.word(value) == "=":
            self._add(i, i + 1, "constant", self._statement(value), scopes)
        return i + 1

    def _script_import(self, i: int) -> int:
        end, names, alias, star, j = self._statement(i), [], None, False, i + 1
        while j <= end and self.kind(j) != "string":
            w = self.words[j]
            if w == "*" and self.word(j + 1) == "as":
                star, alias, j = True, self.word(j + 2), j + 2
            elif self.kind(j) == "word" and w == "as":
                alias, j = self.word(j + 1), j + 1
            elif self.kind(j) == "word" and w not in ("from", "type", "typeof"):
                names.append(w)
            j += 1
        if j <= end:
            self._module(i, self.words[j], names, alias, star)
            name = self.words[j].strip("'\"")
            self.symbols.append((name, "import", "private", self.line(i), self.line(j), 0, None, self.t.text[self.t.items[i].at : self.t.items[j].at + len(self.words[j])]))
        return max(i, min(j, end))

    def _module(self, i: int, module: str, names: list[str], alias: str | None, star: bool) -> None:
        self.imports.append((module.strip("'\""), names, alias, star, self.line(i)))

    def references(self) -> Iterator[tuple[str, str, int]]:
        """name, kind and token of calls, macros, types and bases."""
        bases = {b[2] for b in self.bases}
        for i, w in enumerate(self.words):
            before, at = self.word(i - 1), i + 1
            reserved = w in _NO_CALLS and before not in (".", "?.", "::") and not (self.rust and w == "new")
            if self.kind(i) != "word" or i in self.defined or reserved:
                continue
            if self.rust and self.word(at) == "!" and self.word(at + 1) in ("(", "[", "{") and self.word(at + 1) != "=":
                yield w, "macro_invocation", i
                continue
            turbo = self.rust and self.word(at) == "::" and self.word(at + 1) == "<"
            at = self._generics(at + 1) if turbo else self._generics(at) if not self.rust and self.word(at) == "<" and self.word(self._generics(at)) == "(" else at
            if self.word(at) == "(" and before not in ("fn", "function", "class", "def"):
                path = [w]
                j = i
                while self.word(j - 1) == "::" and self.kind(j - 2) == "word":
                    path.insert(0, self.words[j - 2])
                    j -= 2
                kind = "chained_method_call" if before in (".", "?.") and self.word(i - 2) == ")" else "method_call" if before in (".", "?.") else "function_call"
                if len(path) > 1:
                    kind = "standard_library_call" if path[0] in ("std", "core", "alloc") else "static_method_call" if path[-2][:1].isupper() else "function_call"
                yield "::".join(path), "turbofish_call" if turbo else kind, i
            elif w[:1].isupper() and before in (":", "->", "<", "&", "dyn", "as", "|", "extends") and i not in bases:
                yield w, "type_usage", i
        yield from self.bases


@lru_cache(maxsize=1)
def _parsed(text: str, rust: bool) -> Parsed:
    return Parsed(text, rust)


# Python


@lru_cache(maxsize=1)
def _tree(text: str) -> ast.Module:
    """The last text's tree is kept, as is the last one's tokens: a file is read once for all that is asked of it."""
    return ast.parse(text)


def _python_symbols(text: str) -> list[tuple]:
    out: list[tuple] = []
    lines = text.splitlines()

    def visit(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            kind = name = None
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind, name = ("method" if in_class else "function"), child.name
            elif isinstance(child, ast.ClassDef):
                kind, name = "class", child.name
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                kind, name = "import", getattr(child, "module", None) or child.names[0].name
            elif isinstance(child, ast.Assign) and parent is None and isinstance(child.targets[0], ast.Name):
                kind, name = ("constant" if child.targets[0].id.isupper() else "variable"), child.targets[0].id
            if kind:
                out.append((name, kind, "private" if name.startswith("_") else "public", child.lineno, child.end_lineno, child.col_offset, parent, "\n".join(lines[child.lineno - 1 : child.end_lineno])))
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(child, f"{parent}::{name}" if parent else name, isinstance(child, ast.ClassDef))
            elif not isinstance(child, ast.expr):
                visit(child, parent, in_class)

    visit(_tree(text), None, False)
    return out


def _named(node: ast.AST) -> str | None:
    """The last name of a name, an attribute or a subscript of one."""
    while isinstance(node, ast.Subscript):
        node = node.value
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _python_references(text: str) -> Iterator[tuple[str, str, int]]:
    nodes = list(ast.walk(_tree(text)))
    awaited = {id(n.value) for n in nodes if isinstance(n, ast.Await)}
    entered = {id(i.context_expr) for n in nodes if isinstance(n, (ast.With, ast.AsyncWith)) for i in n.items}
    decorators = {id(d) for n in nodes for d in getattr(n, "decorator_list", [])}
    for n in nodes:
        if isinstance(n, ast.Call) and id(n) not in decorators and (name := _named(n.func)):
            chained = isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Call)
            kind = "async_call" if id(n) in awaited else "context_manager" if id(n) in entered else "chained_method_call" if chained else "method_call" if isinstance(n.func, ast.Attribute) else "function_call"
            yield name, kind, n.func.end_lineno
        if isinstance(n, ast.ClassDef):
            yield from ((name, "inheritance", b.lineno) for b in n.bases if (name := _named(b)))
        yield from ((name, "decorator", d.lineno) for d in getattr(n, "decorator_list", []) if (name := _named(d.func if isinstance(d, ast.Call) else d)))
        kinds = [n.annotation] if isinstance(n, (ast.arg, ast.AnnAssign)) else [n.returns] if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) else []
        yield from ((x.id, "type_annotation", x.lineno) for k in kinds if k is not None for x in ast.walk(k) if isinstance(x, ast.Name))
        if isinstance(n, ast.MatchClass) and (name := _named(n.cls)):
            yield name, "pattern_match", n.lineno


def _python_imports(text: str) -> Iterator[tuple]:
    for n in ast.walk(_tree(text)):
        if isinstance(n, ast.Import):
            yield from ((a.name.replace(".", "::"), [], a.asname, False, n.lineno) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "").replace(".", "::")
            plain = [a.name for a in n.names if a.asname is None and a.name != "*"]
            if plain:
                yield base, plain, None, False, n.lineno
            yield from ((f"{base}::{a.name}", [], a.asname, False, n.lineno) for a in n.names if a.asname)
            if any(a.name == "*" for a in n.names):
                yield base, [], None, True, n.lineno


def _or_none(make, otherwise):
    try:
        return make()
    except (SyntaxError, ValueError, RecursionError):
        return otherwise


def parse(path: str, text: str) -> list[tuple]:
    """name, type, visibility, start, end, column, parent and text of each symbol; none for files that do not parse."""
    kind = language(path)
    return _or_none(lambda: _python_symbols(text) if kind == "python" else _parsed(text, kind == "rust").symbols if kind else [], [])


def reference_lines(path: str, text: str) -> list[tuple]:
    """name, kind, line and text of calls, macros, types, bases and decorators."""
    kind, lines = language(path), text.split("\n")
    if not kind:
        return []

    def made():
        if kind == "python":
            return [(n, k, at, lines[at - 1].strip()) for n, k, at in _python_references(text)]
        p = _parsed(text, kind == "rust")
        return [(n, k, at := p.line(i), lines[at - 1].strip()) for n, k, i in p.references()]

    return _or_none(made, [])


def import_rows(path: str, text: str) -> list[tuple]:
    """module, items, alias, wildcard and line of each import, a row for each path of a list of paths."""
    kind = language(path)
    return _or_none(lambda: list(_python_imports(text)) if kind == "python" else _parsed(text, kind == "rust").imports if kind else [], [])


def stat_row(path: str, text: str) -> list[tuple]:
    """nodes, named ones, depth and errors: of Python's tree, or of tokens and their brackets."""
    kind = language(path)
    if kind == "python":

        def measured():
            nodes, todo, deepest = 0, [(_tree(text), 0)], 0
            while todo:
                node, depth = todo.pop()
                nodes, deepest = nodes + 1, max(deepest, depth)
                todo += [(c, depth + 1) for c in ast.iter_child_nodes(node)]
            return [(nodes, nodes, deepest, 0)]

        return _or_none(measured, [(0, 0, 0, 1)])
    if not kind:
        return []
    return _or_none(lambda: [(len(t.items), sum(x.kind != "sign" for x in t.items), t.depth, t.errors) for t in [Tokens(text, kind == "rust")]], [(0, 0, 0, 1)])


def graph_rows(path: str, text: str) -> list[tuple]:
    """What parse(), reference_lines() and import_rows() find in one file; fields as in PARTS without the path."""
    found = [("symbol", name, kind, start, end, column, parent, None, None, None, None) for name, kind, _, start, end, column, parent, _ in parse(path, text)]
    found += [("reference", name, kind, line, None, None, None, of, None, None, None) for name, kind, line, of in reference_lines(path, text)]
    return found + [("import", module, None, line, None, None, None, None, tuple(items), alias, wildcard) for module, items, alias, wildcard, line in import_rows(path, text)]


#: Rows of a batch that leave a reader.
MOST_ROWS = 20_000


def _mapped(files: DataFrame, make, schema: str, once: bool = False) -> DataFrame:
    """A row for each of make(path, text)'s; with once equal rows of a path come once, in however many files it stands."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, rows = None, set(), []
        for b in batches:
            for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if p != last:
                    last, seen = p, set()
                for r in make(p, t or ""):
                    if not once or r not in seen:
                        rows.append((p, *r))
                    if once:
                        seen.add(r)
                if len(rows) >= MOST_ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    dealt = files.select("path", "content").repartition("path")
    return (dealt.sortWithinPartitions("path") if once else dealt).mapInArrow(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content as text), with an id from what names them."""
    found = _mapped(files, parse, SYMBOL)
    return found.withColumn("id", _symbol_id()).withColumn("qualified", F.concat_ws("::", F.coalesce("parent", "path"), "name"))


def _symbol_id() -> Column:
    return F.sha2(F.concat_ws("|", "path", F.coalesce("parent", F.lit("")), "name", "type", "start", "column"), 256)


def references(files: DataFrame) -> DataFrame:
    return _with_ref(_mapped(files, reference_lines, REFERENCE, once=True))


def _with_ref(found: DataFrame) -> DataFrame:
    return found.withColumn("ref", F.sha2(F.concat_ws("|", "path", "line", "name", "kind", "text"), 256))


def imports(files: DataFrame) -> DataFrame:
    return _mapped(files, import_rows, IMPORT)


def parse_stats(files: DataFrame) -> DataFrame:
    return _mapped(files, stat_row, STATS)


def _module(path: Column) -> Column:
    """A file's path as a module's: no extension, :: for slashes, and folders' own files under the folder's name."""
    own = F.when(path.endswith(".rs"), F.lit("mod|lib|main")).when(path.endswith(".py"), F.lit("__init__")).otherwise("index")
    bare = F.replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), F.lit("/"), F.lit("::"))
    return F.regexp_replace(bare, F.concat(F.lit("(?:^|::)(?:"), own, F.lit(")$")), F.lit(""))


def _module_names(nodes: DataFrame) -> DataFrame:
    """id and qualified: a symbol under its file's module, and for Rust below src under its crate too."""
    module = _module(F.col("path"))
    under = lambda m: F.concat_ws("::", F.nullif(m, F.lit("")), "parent", "name")
    crate = F.when(F.col("path").rlike(r"^src/.*\.rs$"), under(F.concat(F.lit("crate"), F.regexp_replace(module, "^src", ""))))
    return nodes.select("id", F.explode(F.array_compact(F.array(under(module), crate))).alias("qualified"))


def _modules_named(imports: DataFrame) -> DataFrame:
    """Imports with module paths: what a script names by its place beside the file becomes the path from the root."""
    beside = F.col("module").startswith("./")
    folder = F.regexp_extract("path", "^(.*)/", 1)
    place = F.concat_ws("/", F.nullif(folder, F.lit("")), F.substring("module", 3, 4000))
    return imports.withColumn("module", F.when(beside, F.replace(F.regexp_replace(place, r"\.[a-z]+$", ""), F.lit("/"), F.lit("::"))).otherwise(F.col("module")))


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges (src, dst, relation) of a source tree."""
    from ..operators import graph

    # files are read once: what edges take is written, so that no join reads them again and estimates of size are of rows
    parts = cut(_mapped(files, graph_rows, PARTS, once=True))
    held = parts.filter("part = 'symbol' and kind <> 'import'").withColumnRenamed("kind", "type").withColumn("id", _symbol_id())
    spans = held.select("id", F.col("path").alias("file"), "start", "end")
    found = _with_ref(parts.filter("part = 'reference'").withColumnRenamed("start", "line"))
    refs = found.select("ref", "name", F.col("path").alias("file"), "line", graph.relation_of(F.col("kind")).alias("relation"))
    brought = _modules_named(parts.filter("part = 'import'").withColumnRenamed("name", "module")).select(F.col("path").alias("file"), F.col("module").alias("path"), "items", "alias", "wildcard", F.col("start").alias("line"))
    return symbols(files), graph.build_edges(refs, spans, _module_names(held), brought)
