"""Facts about JavaScript, TypeScript, Rust, Go and C sources from a scan over their tokens.

No grammar: a scanner tells comments and strings from code, and declarations are read from
their first words on. What it yields has the shape of :mod:`codestrata.functions.pycode`:
symbols with parameters and parents, references, scopes, calls. Scopes are modules,
functions and types; plain blocks belong to the function around them. Names are resolved
after the whole file is read, so a use may stand before its definition.

Not covered: names inside template strings, macros' bodies as code, overloads as one symbol,
types of destructured parameters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from codestrata.functions.outline import LANGUAGES
from codestrata.functions.pycode import Facts

Token = tuple[str, str, int, int]

_STRINGS = {
    "javascript": r"\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`",
    "rust": r"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^'\n]+|[^'\\\n])'",
    "go": r"\"(?:\\[\s\S]|[^\"\\\n])*\"|`[^`]*`|'(?:\\[^'\n]+|[^'\\\n])'",
    "c": r"L?\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[^'\n]+|[^'\\\n])'",
}
_DIRECTIVE = r"|^[ \t]*#(?!include)(?:[^\n\\]|\\[\s\S])*"
_TOKENS = {
    lang: re.compile(
        rf"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z){_DIRECTIVE if lang == 'c' else ''})|(?P<text>{s})|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)"
        r"|(?P<sign>=>|->|::|:=|\.\.\.|<<=|>>=|[=!]==?|[<>]=|[-+*/%&|^]=|&&|\|\||\+\+|--|[\s\S])",
        re.M,
    )
    for lang, s in _STRINGS.items()
}
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_WRITES = frozenset("= += -= *= /= %= &= |= ^= <<= >>= := ++ --".split())
_KEYWORDS = {
    "javascript": frozenset(
        "if else for while do switch case default break continue return throw try catch finally new delete typeof instanceof in of void yield await async function class extends super this const let var import export from as "
        "static get set null undefined true false interface type enum implements public private protected readonly abstract declare namespace module keyof infer is satisfies".split()
    ),
    "rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota".split()),
    "c": frozenset(
        "auto break case char const continue default do double else enum extern float for goto if inline int long register return short signed sizeof static struct switch typedef union unsigned void volatile while class namespace public "
        "private protected virtual template typename using new delete this nullptr true false bool operator try catch throw constexpr noexcept override final friend explicit mutable".split()
    ),
}


class BraceIndexer:
    """One file; ``run`` gives its facts."""

    def __init__(self, module: str, lang: str):
        self.module, self.lang = module, lang
        self.out = Facts()
        self.words = _KEYWORDS[lang]
        self.stack: list[dict] = []
        self.owners: list[tuple[int, dict | None]] = []  # depth at which a scope closes, its symbol
        self.known: list[dict[str, str]] = []
        self.later: list[tuple[dict, str]] = []
        self.exported: set[str] = set()
        self.depth = 0

    # --- tokens -------------------------------------------------------------------------

    def _scan(self, code: str) -> list[Token]:
        out: list[Token] = []
        at = 0
        pattern = _TOKENS[self.lang]
        while at < len(code):
            if self.lang == "javascript" and code[at] == "/" and (not out or out[-1][1] in "(,=:[!&|?{};" or out[-1][1] in ("return", "=>", "&&", "||", "===", "==")):
                if m := _REGEX.match(code, at):
                    out.append(("text", m.group(), at, m.end()))
                    at = m.end()
                    continue
            m = pattern.match(code, at)
            kind = "text" if m.lastgroup == "h" else m.lastgroup
            if kind != "skip":
                out.append((kind, m.group(), at, m.end()))
            at = m.end()
        return out

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][1] in texts and self.tokens[i][0] != "text"

    def _name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "name"

    def _match(self, i: int) -> int:
        """The place of the bracket that closes the one at ``i``; the end of the file if none does."""
        pairs = {"(": ")", "[": "]", "{": "}", "<": ">"}
        first, last = self.tokens[i][1], pairs[self.tokens[i][1]]
        depth = 0
        for j in range(i, len(self.tokens)):
            if self.tokens[j][0] == "sign":
                depth += (self.tokens[j][1] == first) - (self.tokens[j][1] == last)
                if not depth:
                    return j
        return len(self.tokens) - 1

    def _until(self, i: int, *ends: str) -> int:
        """The first of the signs ``ends`` outside round and square brackets, from ``i`` on."""
        while i < len(self.tokens) and not self._is(i, *ends):
            i = self._match(i) + 1 if self._is(i, "(", "[") else i + 1
        return i

    def _text(self, i: int, j: int) -> str | None:
        """The code of the tokens from ``i`` to before ``j``."""
        return " ".join(self.code[self.tokens[i][2] : self.tokens[j - 1][3]].split()) or None if i < j <= len(self.tokens) else None

    def _place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1]

    def _range(self, first: int, last: int) -> dict:
        (l1, c1), (l2, c2) = self._place(self.tokens[first][2]), self._place(self.tokens[last][3])
        return {"start_line": l1, "start_col": c1, "end_line": l2, "end_col": c2}

    # --- rows ---------------------------------------------------------------------------

    def run(self, code: str) -> Facts:
        self.code = code
        self.starts = list(accumulate((len(x) + 1 for x in code.split("\n")), initial=0))
        self.tokens = self._scan(code)
        whole = {"start_line": 1, "start_col": 0, "end_line": code.count("\n") + 1, "end_col": 1 << 20}
        self._enter("module", self.module, whole, None)
        i = 0
        while i < len(self.tokens):
            i = self._step(i)
        for ref, head in self.later:
            ref["resolved"] = self._resolve(ref["scope_id"], head)
        for s in self.out.symbols:
            s["is_exported"] = s["is_exported"] or s["scope_id"] == 0 and s["name"] in self.exported
        by_place = {(r["start_line"], r["start_col"]): r for r, _ in self.later}
        for c in self.out.calls:
            known = by_place[c["line"], c["col"]]["resolved"]
            if known and "." not in c["callee"]:
                c["callee"] = known
        return self.out

    def _resolve(self, scope: int | None, name: str) -> str | None:
        inner = scope
        while scope is not None:
            if name in self.known[scope] and (self.out.scopes[scope]["kind"] != "class" or scope == inner):
                return self.known[scope][name]
            scope = self.out.scopes[scope]["parent_id"]
        return None

    def _enter(self, kind: str, name: str, where: dict, symbol: dict | None) -> None:
        scope = {"scope_id": len(self.out.scopes), "kind": kind, "name": name, **where, "parent_id": self.stack[-1]["scope_id"] if self.stack else None}
        self.out.scopes.append(scope)
        self.stack.append(scope)
        self.owners.append((self.depth, symbol))
        self.known.append({})

    def _define(self, name: str, kind: str, first: int, last: int, owner: str | None = None, **extra) -> dict:  # noqa: ANN003
        inner = [s["name"] for s in self.stack[1:]]
        q = ".".join(x for x in [self.module, *inner, owner, name] if x)
        self.known[self.stack[-1]["scope_id"]].setdefault(name, q)
        row = {
            "seq": len(self.out.symbols), "name": name, "kind": kind, "qualified_name": q, **self._range(first, min(last, len(self.tokens) - 1)), "scope_id": self.stack[-1]["scope_id"], "type_string": None, "docstring": None,
            "imported_from": None, "import_name": None, "is_public": not name.startswith(("_", "#")), "is_exported": False, "is_async": False, "decorators": [], "value_call": None, "parameters": [], "base_classes": [],
        }
        if self.lang == "go":
            row["is_public"] = row["is_exported"] = name[:1].isupper()
        row |= extra
        self.out.symbols.append(row)
        return row

    def _open(self, kind: str, name: str, symbol: dict, brace: int, parameters: list[tuple[str, str | None, int]]) -> int:
        """Enter the block at ``brace``; its parameters are symbols in it."""
        self.depth += 1
        self._enter(kind, name, {k: symbol[k] for k in ("start_line", "start_col", "end_line", "end_col")}, symbol)
        for n, t, at in parameters:
            self._define(n, "parameter", at, at, type_string=t)
        return brace + 1

    def _close(self, i: int) -> None:
        while len(self.stack) > 1 and self.owners[-1][0] >= self.depth:
            scope, (_, symbol) = self.stack.pop(), self.owners.pop()
            line, col = self._place(self.tokens[i][3])
            for row in (scope, symbol):
                if row is not None:
                    row["end_line"], row["end_col"] = line, col
        self.depth = max(0, self.depth - 1)

    def _caller(self) -> str:
        for scope, (_, symbol) in zip(reversed(self.stack), reversed(self.owners), strict=True):
            if scope["kind"] == "function" and symbol:
                return symbol["qualified_name"]
        return self.module

    # --- declarations -------------------------------------------------------------------

    def _parameters(self, i: int) -> tuple[list[tuple[str, str | None, int]], int]:
        """(name, type, token) of a list in brackets at ``i``, and the place behind it."""
        end = self._match(i)
        out: list[tuple[str, str | None, int]] = []
        part = i + 1
        pending: list[int] = []
        for j in range(i + 1, end + 1):
            if j == end or (self._is(j, ",") and self._level(i + 1, j) == 0):
                if part < j:
                    out += self._parameter(part, j, pending)
                part = j + 1
        if self.lang == "go":  # ``a, b int``: names wait for the type of the last of them
            out += [(self.tokens[p][1], None, p) for p in pending]
        return out, end + 1

    def _level(self, i: int, j: int) -> int:
        return sum((self.tokens[k][1] in "([{<") - (self.tokens[k][1] in ")]}>") for k in range(i, j) if self.tokens[k][0] == "sign")

    def _parameter(self, i: int, j: int, pending: list[int]) -> list[tuple[str, str | None, int]]:
        names = [k for k in range(i, j) if self._name(k)]
        if self.lang == "go":
            if j - i == 1 and names:
                pending.append(i)
                return []
            if not self._name(i) or self._is(i + 1, "."):
                return []
            t = self._text(i + 1, j)
            out = [(self.tokens[p][1], t, p) for p in [*pending, i]]
            pending.clear()
            return out
        if self.lang == "c":
            plain = [k for k in names if self.tokens[k][1] not in self.words]
            at = plain[-1] if plain and (len(names) > 1 or j - i > 1) else None
            return [] if at is None or at == i else [(self.tokens[at][1], self._text(i, at), at)]
        if self.lang == "rust":
            at = next((k for k in names if self.tokens[k][1] not in ("mut", "ref")), None)
            colon = self._until(i, ":")
            return [] if at is None else [(self.tokens[at][1], self._text(colon + 1, j) if colon < j else None, at)]
        stop = next((k for k in range(i, j) if self._is(k, "=") and self._level(i, k) == 0), j)
        if self._is(i, "{", "["):
            return [(self.tokens[k][1], None, k) for k in range(i, min(self._match(i), stop) + 1) if self._name(k) and not self._is(k + 1, ":")]
        colon = next((k for k in range(i, stop) if self._is(k, ":") and self._level(i, k) == 0), stop)
        at = next((k for k in names if k < colon and self.tokens[k][1] not in ("public", "private", "protected", "readonly")), None)
        return [] if at is None else [(self.tokens[at][1], self._text(colon + 1, stop) if colon < stop else None, at)]

    def _function(self, name: int, first: int, kind: str, params: int, owner: str | None = None, **extra) -> int:  # noqa: ANN003
        """A function whose name and parameter list are known; returns where to go on. ``owner``
        is the type of a method that stands outside it."""
        parameters, i = self._parameters(params)
        brace = self._until(i, "{", ";", *(["=>"] if self.lang == "javascript" else []), *(["where"] if self.lang == "rust" else []))
        arrow = {"javascript": ":", "rust": "->"}.get(self.lang)
        start = i + 1 if arrow and self._is(i, arrow) else i if self.lang == "go" else brace
        symbol = self._define(self.tokens[name][1], kind, first, brace, type_string=extra.pop("type_string", None) or self._text(start, brace), parameters=[{"name": n, "type": t} for n, t, _ in parameters], owner=owner, **extra)
        if self._is(brace, "=>"):
            if not self._is(brace + 1, "{"):  # the body is one expression: it stays in the scope around
                return brace + 1
            brace += 1
        brace = self._until(brace, "{", ";")
        return self._open("function", ".".join(x for x in (owner, symbol["name"]) if x), symbol, brace, parameters) if self._is(brace, "{") else brace

    def _type(self, name: int, first: int, brace: int, bases: list[str], **extra) -> int:  # noqa: ANN003
        symbol = self._define(self.tokens[name][1], extra.pop("kind", "class"), first, brace, base_classes=bases, **extra)
        return self._open("class", symbol["name"], symbol, brace, []) if self._is(brace, "{") else brace

    def _step(self, i: int) -> int:
        kind, text, _, _ = self.tokens[i]
        if kind == "sign":
            if text == "{":
                self.depth += 1
            elif text == "}":
                self._close(i)
            return i + 1
        if kind != "name":
            return i + 1
        done = getattr(self, f"_{self.lang}")(i, text)
        return done if done is not None else self._refer(i) if text not in self.words else i + 1

    def _refer(self, i: int) -> int:
        last, parts = i, [self.tokens[i][1]]
        while self._is(last + 1, ".", "::", "->", "?") and (self._name(last + 2) or self._is(last + 1, "?") and self._is(last + 2, ".") and self._name(last + 3)):
            last += 2 if self._name(last + 2) else 3
            parts.append(self.tokens[last][1])
        if self.lang == "javascript" and self._is(last + 1, ":") and self._is(i - 1, "{", ",") and last == i:
            return i + 1  # a key
        name = ".".join(parts)
        after = last + 1
        if self.lang == "rust" and self._is(after, "!") and self._is(after + 1, "(", "[", "{"):
            name, after = name + "!", after + 1
        call = self._is(after, "(") or name.endswith("!")
        write = not call and (after < len(self.tokens) and self.tokens[after][0] == "sign" and self.tokens[after][1] in _WRITES)
        row = {"name": name, **self._range(i, last), "resolved": None, "scope_id": self.stack[-1]["scope_id"], "is_read": not call and not write, "is_write": write, "is_call": call}
        self.out.references.append(row)
        self.later.append((row, parts[0]))
        if call:
            self.out.calls.append({"caller": self._caller(), "callee": name, "line": row["start_line"], "col": row["start_col"]})
        return last + 1

    def _field(self, i: int) -> bool:
        """Is this place right inside the braces of a type, not of one of its methods?"""
        return self.stack[-1]["kind"] == "class" and self.owners[-1][0] == self.depth and self.tokens[i][1] not in self.words and "seq" in (self.owners[-1][1] or {})

    # --- languages ----------------------------------------------------------------------

    def _javascript(self, i: int, text: str) -> int | None:
        public = self._is(i - 1, "export") or self._is(i - 2, "export") and self._is(i - 1, "default", "async", "abstract") or self._is(i - 3, "export")
        top = len(self.stack) == 1
        in_class = self.stack[-1]["kind"] == "class" and self.owners[-1][0] == self.depth
        if text == "import" and top and not self._is(i + 1, "(", "."):
            return self._js_import(i)
        if text == "export":
            if self._is(i + 1, "{"):
                end = self._match(i + 1)
                source = self.tokens[end + 2][1] if self._is(end + 1, "from") and end + 2 < len(self.tokens) else None
                for k in range(i + 2, end):
                    if self._name(k) and self._is(k + 1, ",", "}", "as"):
                        if source:
                            self._define(self.tokens[k + 2][1] if self._is(k + 1, "as") else self.tokens[k][1], "import", k, k, imported_from=_js_source(source), import_name=self.tokens[k][1], is_exported=True)
                        else:
                            self.exported.add(self.tokens[k][1])
                return end + (3 if source else 1)
            if self._is(i + 1, "*") and (at := self._until(i, "from")) + 1 < len(self.tokens):
                self._define("*", "import", i, at + 1, imported_from=_js_source(self.tokens[at + 1][1]), import_name="*", is_exported=True)
                return at + 2
            return i + 1
        if text == "function":
            at = i + 2 if self._is(i + 1, "*") else i + 1
            params = self._until(at, "(")
            if self._name(at):
                return self._function(at, i, "function", params, is_async=self._is(i - 1, "async"), is_exported=public and top)
            return at
        if text == "class" and self._name(i + 1):
            brace = self._until(i + 1, "{")
            bases = [self._text(k + 1, self._until(k + 1, "{", ",", "implements", "extends", "(", "<")) for k in range(i + 1, brace) if self._is(k, "extends", "implements")]
            return self._type(i + 1, i, brace, [b for b in bases if b], is_exported=public and top)
        if text in ("interface", "enum") and self._name(i + 1) and self._is(self._until(i + 1, "{", ";", "(", ","), "{"):
            return self._type(i + 1, i, self._until(i + 1, "{"), [], kind=text, is_exported=public and top)
        if text == "type" and self._name(i + 1) and self._is(i + 2, "=", "<"):
            self._define(self.tokens[i + 1][1], "type", i, i + 1, is_exported=public and top)
            return i + 2
        if text in ("const", "let", "var"):
            return self._js_variable(i, public and top)
        if in_class and not self._is(i - 1, ".", "=", "(", ",", "new", "=>", ":"):
            params = i + 1
            if self._is(params, "<"):
                params = self._match(params) + 1
            if self._is(params, "(") and text not in ("if", "for", "while", "switch", "catch", "return", "super"):
                after = self._match(params) + 1
                if self._is(after, "{", ":"):
                    return self._function(i, i, "method", params, is_async=self._is(i - 1, "async"))
            if text not in self.words and self._is(i + 1, "=", ";", ":", "?", "!"):
                end = self._until(i + 1, "=", ";", "}")
                self._define(text, "property", i, i, type_string=self._text(i + 2, end) if self._is(i + 1, ":") else None)
                return end
        return None

    def _js_variable(self, i: int, public: bool) -> int:
        at = i + 1
        if self._is(at, "{", "["):
            end = self._match(at)
            source = self._required(end + 2) if self._is(end + 1, "=") else None
            for k in range(at + 1, end):
                if self._name(k) and self._is(k + 1, ",", "}", "]", "="):
                    origin = {"imported_from": source, "import_name": self.tokens[k - 2][1] if self._is(k - 1, ":") else self.tokens[k][1]} if source else {}
                    self._define(self.tokens[k][1], "import" if source else "variable", k, k, is_exported=public, **origin)
            return end + 1
        if not self._name(at):
            return at
        eq = self._until(at + 1, "=", ";", "of", "in", ",", "}")
        declared = self._text(at + 2, eq) if self._is(at + 1, ":") else None
        if not self._is(eq, "="):
            self._define(self.tokens[at][1], "variable", at, at, type_string=declared, is_exported=public)
            return eq
        value = eq + 1
        is_async = self._is(value, "async")
        value += is_async
        if self._is(value, "function"):
            params = self._until(value, "(")
            return self._function(at, i, "function", params, is_async=is_async, is_exported=public)
        if self._is(value, "("):
            after = self._match(value) + 1
            if self._is(after, "=>") or self._is(after, ":") and self._is(self._until(after, "=>", ";", "{"), "=>"):
                return self._function(at, i, "function", value, is_async=is_async, is_exported=public)
        if source := self._required(value):
            self._define(self.tokens[at][1], "import", at, at, imported_from=source, is_exported=public)
            return value + 4
        known = {"text": "string", "number": "number"}.get(self.tokens[value][0]) if value < len(self.tokens) else None
        if self._is(value, "new") and self._name(value + 1):
            known = self.tokens[value + 1][1]
        self._define(self.tokens[at][1], "variable", at, at, type_string=declared or known, value_call=self.tokens[value][1] if self._name(value) and self._is(value + 1, "(") else None, is_exported=public)
        return value

    def _required(self, i: int) -> str | None:
        return _js_source(self.tokens[i + 2][1]) if self._is(i, "require") and self._is(i + 1, "(") and i + 2 < len(self.tokens) and self.tokens[i + 2][0] == "text" else None

    def _js_import(self, i: int) -> int:
        j = i + 1
        while j < len(self.tokens) and self.tokens[j][0] != "text" and not self._is(j, ";"):
            j += 1
        if j >= len(self.tokens) or self.tokens[j][0] != "text":
            return j
        source = _js_source(self.tokens[j][1])
        names = 0
        for k in range(i + 1, j):
            if not self._name(k) or self.tokens[k][1] in ("from", "type", "as") and not self._is(k + 1, ",", "}"):
                continue
            if self._is(k + 1, "as"):
                continue
            whole = self._is(k - 1, "as") and self._is(k - 2, "*")
            inside = any(self._is(b, "{") for b in range(i + 1, k))
            original = None if whole else self.tokens[k - 2][1] if self._is(k - 1, "as") else self.tokens[k][1] if inside else "default"
            self._define(self.tokens[k][1], "import", k, k, imported_from=source, import_name=original)
            names += 1
        if not names:
            self._define(self.tokens[j][1].strip("'\"`"), "import", i, j, imported_from=source)
        return j + 1

    def _rust(self, i: int, text: str) -> int | None:
        public = self._is(i - 1, "pub") or self._is(i - 1, ")") and any(self._is(k, "pub") for k in range(max(0, i - 4), i)) or self._is(i - 2, "pub")
        flags = {"is_public": public, "is_exported": public and len(self.stack) == 1}
        if text == "fn" and self._name(i + 1):
            method = self.stack[-1]["kind"] == "class"
            return self._function(i + 1, i, "method" if method else "function", self._until(i + 1, "("), is_async=any(self._is(k, "async") for k in range(max(0, i - 3), i)), **flags)
        if text in ("struct", "enum", "trait", "union", "mod") and self._name(i + 1):
            brace = self._until(i + 2, "{", ";", "=")
            kind = {"trait": "interface", "enum": "enum", "mod": "module"}.get(text, "class")
            bases = [b.strip() for b in (self._text(i + 3, brace) or "").split("+")] if text == "trait" and self._is(i + 2, ":") else []
            return self._type(i + 1, i, brace, bases, kind=kind, **flags)
        if text == "impl":
            brace = self._until(i + 1, "{", ";")
            start = self._match(i + 1) + 1 if self._is(i + 1, "<") else i + 1
            split = next((k for k in range(start, brace) if self._is(k, "for")), None)
            head = start if split is None else split + 1
            at = next((k for k in range(head, brace) if self._name(k) and self.tokens[k][1] not in ("dyn", "mut")), None)
            if at is None or not self._is(brace, "{"):
                return brace
            while self._is(at + 1, "::") and self._name(at + 2):
                at += 2
            owner = {**self._range(i, brace), "qualified_name": ".".join(x for x in (self.module, self.tokens[at][1]) if x)}
            for s in self.out.symbols if split is not None else ():
                if s["name"] == self.tokens[at][1] and s["kind"] in ("class", "enum"):
                    s["base_classes"].append(self._text(start, split))
            return self._open("class", self.tokens[at][1], owner, brace, [])
        if text in ("const", "static", "type") and self._name(i + 1):
            at = i + 2 if self._is(i + 1, "mut") else i + 1
            end = self._until(at + 1, "=", ";")
            self._define(self.tokens[at][1], "type" if text == "type" else "constant", i, at, type_string=self._text(at + 2, end) if self._is(at + 1, ":") else None, **flags)
            return end
        if self._field(i) and self._is(i + 1, ":"):
            end = self._until(i + 2, ",", "}")
            while end < len(self.tokens) and self._is(end, ",") and self._level(i + 2, end) > 0:
                end = self._until(end + 1, ",", "}")
            self._define(text, "property", i, i, type_string=self._text(i + 2, end), is_public=public)
            return end
        if text == "let":
            end = self._until(i + 1, "=", ";", "else")
            colon = self._until(i + 1, ":", "=", ";")
            for k in range(i + 1, min(colon, end)):
                if self._name(k) and self.tokens[k][1] not in self.words and not self._is(k + 1, "(", "::", "{") and not self._is(k - 1, "::"):
                    self._define(self.tokens[k][1], "variable", k, k, type_string=self._text(colon + 1, end) if self._is(colon, ":") else None, value_call=self.tokens[end + 1][1] if self._is(end, "=") and self._name(end + 1) and self._is(end + 2, "(") else None)
            return end
        if text == "use":
            end = self._until(i + 1, ";")
            self._rust_use(i + 1, end, [], public)
            return end
        return None

    def _rust_use(self, i: int, end: int, path: list[str], public: bool) -> int:
        """The leaves of a tree of imported names."""
        here = list(path)
        while i < end:
            if self._is(i, "{"):
                close = self._match(i)
                i += 1
                while i < close:
                    i = self._rust_use(i, close, here, public) + 1
                return close
            if self._is(i, ",", "}"):
                break
            if self._is(i, "*"):
                self._define("*", "import", i, i, imported_from=".".join(here), import_name="*", is_exported=public)
                return self._until(i, ",", "}", ";") if i < end else i
            if self._name(i) and not self._is(i + 1, "::"):
                name = self.tokens[i][1]
                alias = self.tokens[i + 2][1] if self._is(i + 1, "as") and self._name(i + 2) else name
                source, original = (here, name) if name != "self" else (here[:-1], here[-1] if here else name)
                self._define(alias if alias != "self" else original, "import", i, i, imported_from=".".join(source) or original, import_name=original, is_exported=public)
                return min(end, self._until(i, ",", "}", ";"))
            if self._name(i):
                here.append(self.tokens[i][1])
            i += 1
        return i

    def _go(self, i: int, text: str) -> int | None:
        if text == "func":
            at, parent = i + 1, None
            if self._is(at, "("):  # the receiver
                close = self._match(at)
                names = [k for k in range(at, close) if self._name(k)]
                parent, at = (self.tokens[names[-1]][1] if names else None), close + 1
            params = self._until(at, "(")
            if not self._name(at):
                return i + 1
            return self._function(at, i, "method" if parent else "function", params, owner=parent)
        if text == "package":
            return i + 2
        if self._field(i) and (self._name(i + 1) or self._is(i + 1, "*", "[")) and (i == 0 or self._place(self.tokens[i - 1][2])[0] < self._place(self.tokens[i][2])[0]):
            line = self._place(self.tokens[i][2])[0]
            end = next((k for k in range(i + 1, len(self.tokens)) if self._place(self.tokens[k][2])[0] > line or self.tokens[k][0] == "text"), len(self.tokens))
            self._define(text, "property", i, i, type_string=self._text(i + 1, end))
            return end
        if text == "type" and self._name(i + 1):
            if self._is(i + 2, "struct", "interface"):
                return self._type(i + 1, i, i + 3, [], kind="interface" if self._is(i + 2, "interface") else "class")
            self._define(self.tokens[i + 1][1], "type", i, i + 1)
            return i + 2
        if text == "import":
            end = self._match(i + 1) if self._is(i + 1, "(") else self._until(i + 1, ";", "func", "type", "var", "const", "import")
            last = i
            for k in range(i + 1, min(end, len(self.tokens))):
                if self.tokens[k][0] == "text":
                    source = self.tokens[k][1].strip('"`')
                    self._define(self.tokens[k - 1][1] if self._name(k - 1) and self.tokens[k - 1][1] != "import" else source.rsplit("/", 1)[-1], "import", k, k, imported_from=source.replace("/", "."))
                    last = k
                    if not self._is(i + 1, "("):
                        break
            return max(end, last) + 1 if self._is(i + 1, "(") else last + 1
        if text in ("var", "const"):
            if self._name(i + 1):
                end = self._until(i + 1, "=", ";")
                close = next((k for k in range(i + 2, min(end, i + 12)) if self._place(self.tokens[k][2])[0] != self._place(self.tokens[i][2])[0]), end)
                self._define(self.tokens[i + 1][1], "constant" if text == "const" else "variable", i, i + 1, type_string=self._text(i + 2, min(end, close)))
                return min(end, close)
            return i + 1
        if self._is(i + 1, ":=", ",") and text not in self.words and self.stack[-1]["kind"] == "function":
            j = i
            while self._name(j) and self._is(j + 1, ","):
                j += 2
            if self._name(j) and self._is(j + 1, ":="):
                for k in range(i, j + 1, 2):
                    if self.tokens[k][1] != "_":
                        self._define(self.tokens[k][1], "variable", k, k, value_call=self.tokens[j + 2][1] if self._name(j + 2) and self._is(j + 3, "(") else None)
                return j + 2
        return None

    def _c(self, i: int, text: str) -> int | None:
        if text == "include" and self._is(i - 1, "#"):
            m = re.compile(r"\s*[<\"]([^>\"\n]+)").match(self.code, self.tokens[i][3])
            if m:
                name = m.group(1)
                self._define(re.sub(r"\.\w+$", "", name.rsplit("/", 1)[-1]), "import", i, i, imported_from=name)
                while i + 1 < len(self.tokens) and self.tokens[i + 1][2] < m.end() + 1:
                    i += 1
            return i + 1
        if text in ("struct", "class", "union", "enum", "namespace"):
            at = i + 2 if text == "enum" and self._is(i + 1, "class") else i + 1
            if self._name(at):
                brace = self._until(at + 1, "{", ";", ")", ",", "=", "(")
                if self._is(brace, "{") and brace - at < 40:
                    bases = [b.split()[-1] for b in (self._text(at + 2, brace) or "").split(",")] if self._is(at + 1, ":") else []
                    return self._type(at, i, brace, bases, kind={"enum": "enum", "namespace": "module"}.get(text, "class"))
            return i + 1
        typed = i > 0 and (self._name(i - 1) and self.tokens[i - 1][1] not in ("return", "new", "else", "delete", "goto", "case", "throw") or self._is(i - 1, "*", "&", ">", "::", "~"))
        if text not in self.words and self._is(i + 1, "(") and (typed or self.stack[-1]["kind"] == "class") and self.stack[-1]["kind"] != "function":
            after = self._match(i + 1) + 1
            while self._is(after, "const", "noexcept", "override", "final"):
                after += 1
            if self._is(after, "{", ":") or self._is(after, ";"):
                first = i
                while first > 0 and (self._name(first - 1) or self._is(first - 1, "*", "&", "::", "<", ">", "~")):
                    first -= 1
                kind = "method" if self.stack[-1]["kind"] == "class" or self._is(i - 1, "::") else "function"
                static = any(self._is(k, "static") for k in range(first, i))
                return self._function(i, first, kind, i + 1, type_string=self._text(first, i), is_public=not static, is_exported=not static and len(self.stack) == 1)
        if text not in self.words and typed and self._is(i + 1, "=", ";", "[") and not self._is(i - 1, "::"):
            self._define(text, "variable", i, i, type_string=self.tokens[i - 1][1] if self._name(i - 1) else None)
            return i + 1
        return None


def _js_source(text: str) -> str:
    """A module path as a dotted name: ``./a/b.js`` is ``.a.b``, ``../a`` is ``..a``."""
    path = re.sub(r"\.(?:js|jsx|mjs|cjs|ts|tsx)$", "", text.strip("'\"`"))
    if not path.startswith("."):
        return path
    up = len(re.findall(r"(?:^|/)\.\.(?=/|$)", path))
    rest = [p for p in path.split("/") if p not in ("", ".", "..")]
    return "." * (up + 1) + ".".join(rest)


def index(module: str, code: str, ext: str) -> Facts:
    return BraceIndexer(module, LANGUAGES[ext]).run(code)
