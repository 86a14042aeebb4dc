"""A tolerant C++ reader: entities, relationships and aliases of one file.

The text is cut into tokens, without comments and preprocessor lines; one pass over
them keeps a stack of scopes. It needs no includes and no macros expanded, and
passes over what it does not understand to the next `;` or closing brace.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codestrata.sources.types import NOT_A_TYPE, NOT_IN_A_BODY, classify_field

PARSER_VERSION = 1
TOKEN = re.compile(
    r"""(?P<skip>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|[ \t\r\f\v]+|\\\n)|(?P<line>\n)|(?P<raw>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)")"""
    r"""|(?P<text>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?|(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[\w.']|[eEpP][+-])*)|(?P<op>::|->\*?|\.\.\.|&&|\|\||<<=|<=>|[-+*/%&|^!=<>]=|\+\+|--|.)""",
    re.DOTALL,
)
#: Visibility macros: blanked wherever they stand.
MACRO = re.compile(r"\w*_(?:EXPORT|API|IMPORT|DECL|DLLAPI)$")
UPPER = re.compile(r"[A-Z][A-Z0-9_]{2,}$")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
QUALIFIERS = frozenset("static virtual inline explicit mutable volatile const constexpr consteval constinit extern register friend typename thread_local".split())


@dataclass
class Token:
    kind: str  # word, number, text or op
    text: str
    line: int
    start: int
    end: int


@dataclass
class Parsed:
    entities: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)


def tokenize(text: str) -> list[Token]:
    """Tokens with their lines; macros of visibility, comments and preprocessor lines left out."""
    out, line, fresh, at, n = [], 1, True, 0, len(text)
    while at < n:
        if fresh and text[at] in " \t":
            at += 1
            continue
        if fresh and text[at] == "#":
            while at < n and text[at] != "\n":
                if text[at] == "\\" and text[at + 1 : at + 2] == "\n":
                    line += 1
                    at += 1
                elif text.startswith("/*", at):
                    end = text.find("*/", at + 2)
                    end = n if end < 0 else end + 2
                    line += text.count("\n", at, end)
                    at = end - 1
                at += 1
            fresh = False
            continue
        m = TOKEN.match(text, at)
        kind, s = m.lastgroup, m.group()
        if kind == "d":
            kind = "raw"
        if kind == "line":
            line, fresh = line + 1, True
        else:
            fresh = False
            if kind == "skip":
                line += s.count("\n")
            else:
                if not (kind == "word" and MACRO.match(s)):
                    out.append(Token("text" if kind == "raw" else kind, s, line, m.start(), m.end()))
                line += s.count("\n")
        at = m.end()
    return out


class Reader:
    def __init__(self, text: str, path: str):
        self.text, self.path, self.t, self.lines = text, path, tokenize(text), text.split("\n")
        self.out, self.methods = Parsed(), []

    # -- moving about ------------------------------------------------------
    def is_op(self, i: int, s: str) -> bool:
        return i < len(self.t) and self.t[i].text == s and self.t[i].kind == "op"

    def is_word(self, i: int, *words: str) -> bool:
        return i < len(self.t) and self.t[i].kind == "word" and (not words or self.t[i].text in words)

    def closing(self, i: int) -> int:
        """The index after the bracket that closes the one at i."""
        want = [OPEN[self.t[i].text]]
        i += 1
        while i < len(self.t) and want:
            s = self.t[i].text if self.t[i].kind == "op" else ""
            if s in OPEN:
                want.append(OPEN[s])
            elif s in CLOSE:
                if s in want:  # a missing bracket closes with its parent
                    while want.pop() != s:
                        pass
                elif s == "}":
                    return i
            i += 1
        return i

    def angle(self, i: int) -> int:
        """The index after the `>` that closes the `<` at i; i if it is a comparison."""
        depth, j = 0, i
        while j < len(self.t):
            t = self.t[j]
            if t.kind == "op":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if depth == 0:
                        return j + 1
                elif t.text in "([":
                    j = self.closing(j)
                    continue
                elif t.text in ";{}" or t.text == "||":
                    return i
            j += 1
        return i

    def source(self, a: int, b: int) -> str:
        """The text of tokens a to b, comments left out."""
        if a >= b:
            return ""
        out = [self.t[a].text]
        for p, q in zip(self.t[a : b - 1], self.t[a + 1 : b]):
            out.append((" " if q.start > p.end else "") + q.text)
        return "".join(out)

    def line_text(self, line: int) -> str:
        return self.lines[line - 1].strip() if 0 < line <= len(self.lines) else ""

    # -- output ------------------------------------------------------------
    def entity(self, kind, name, parent, start, end, signature=None) -> None:
        self.out.entities.append({"kind": kind, "name": name, "qualified_name": f"{parent}::{name}" if parent else name, "parent_qname": parent or None, "start_line": start, "end_line": end, "signature": signature})

    def relation(self, source, target, kind, line, **attrs) -> None:
        self.out.relationships.append({"source_qname": source, "target_name": target, "kind": kind, "evidence_line": line, "evidence_text": self.line_text(line), "attrs": attrs})

    # -- grammar -----------------------------------------------------------
    def read(self) -> Parsed:
        self.scope(0, len(self.t), "", False)
        seen: set[tuple[str, str]] = set()
        for parent, own, line, names, body in self.methods:
            for name in sorted(names - own):
                if (parent, name) not in seen:
                    seen.add((parent, name))
                    self.relation(parent, name, "depends", line, via="method_signature")
            for name, at in body:
                if name not in own and (parent, name) not in seen:
                    seen.add((parent, name))
                    self.relation(parent, name, "depends", at, via="body_call")
        return self.out

    def scope(self, i: int, end: int, qname: str, in_class: bool) -> None:
        """Declarations from i to end, inside the scope qname."""
        while i < end:
            start = i
            i = self.declaration(i, end, qname, in_class)
            if i <= start:
                i = start + 1

    def to_semicolon(self, i: int, end: int) -> int:
        while i < end and not self.is_op(i, ";"):
            i = self.closing(i) if self.t[i].kind == "op" and self.t[i].text in OPEN else i + 1
        return i + 1

    def declaration(self, i: int, end: int, qname: str, in_class: bool) -> int:
        t = self.t[i]
        if t.kind == "op" and t.text in ";}":
            return i + 1
        if self.is_op(i, "[") and self.is_op(i + 1, "["):
            return self.closing(i)
        if self.is_word(i, "public", "private", "protected", "signals", "slots", "Q_OBJECT") and (self.is_op(i + 1, ":") or self.is_word(i + 1, "slots") or t.text == "Q_OBJECT"):
            while i < end and self.t[i].kind == "word":
                i += 1
            return i + self.is_op(i, ":")
        if self.is_word(i, "template"):
            return max(self.angle(i + 1), i + 1) if self.is_op(i + 1, "<") else i + 1
        if self.is_word(i, "extern") and i + 2 < end and self.t[i + 1].kind == "text" and self.is_op(i + 2, "{"):
            stop = self.closing(i + 2)
            self.scope(i + 3, stop - 1, qname, in_class)
            return stop
        if self.is_word(i, "namespace") or (self.is_word(i, "inline") and self.is_word(i + 1, "namespace")):
            return self.namespace(i + 1 if t.text == "namespace" else i + 2, end, qname, t.line)
        if self.is_word(i, "using"):
            return self.using(i, end)
        if self.is_word(i, "typedef"):
            return self.typedef(i, end, qname, in_class)
        if self.is_word(i, "enum"):
            return self.to_semicolon(i, end)
        if self.is_word(i, "class", "struct", "union"):
            stop = self.container(i, end, qname, in_class)
            if stop:
                return stop
        if self.is_word(i, "friend", "static_assert"):
            j = self.to_semicolon(i, end)
            return j
        return self.member(i, end, qname, in_class)

    def namespace(self, i: int, end: int, qname: str, line: int) -> int:
        names = []
        while i < end and not self.is_op(i, "{") and not self.is_op(i, ";") and not self.is_op(i, "="):
            if self.t[i].kind == "word" and self.t[i].text != "inline":
                names.append(self.t[i].text)
            i = self.closing(i) if self.t[i].kind == "op" and self.t[i].text in OPEN else i + 1
        if not self.is_op(i, "{"):
            return self.to_semicolon(i, end)
        stop = self.closing(i)
        if names:
            self.entity("namespace", "::".join(names), qname, line, self.t[min(stop, len(self.t)) - 1].line)
        self.scope(i + 1, stop - 1, "::".join(filter(None, [qname, *names])), False)
        return stop

    def using(self, i: int, end: int) -> int:
        stop = self.to_semicolon(i, end)
        if self.is_word(i + 1) and self.is_op(i + 2, "="):
            self.out.aliases.append({"alias": self.t[i + 1].text, "target": self.source(i + 3, stop - 1)})
        return stop

    def typedef(self, i: int, end: int, qname: str, in_class: bool) -> int:
        if self.is_word(i + 1, "class", "struct", "union", "enum"):
            j = i + 2
            while j < end and self.t[j].kind == "word":
                j += 1
            if self.is_op(j, "{"):
                return self.to_semicolon(self.closing(j), end)
        stop = self.to_semicolon(i, end)
        if self.is_word(stop - 2) and not any(self.is_op(k, "(") for k in range(i, stop)):
            self.out.aliases.append({"alias": self.t[stop - 2].text, "target": self.source(i + 1, stop - 2)})
        return stop

    def container(self, i: int, end: int, qname: str, in_class: bool) -> int | None:
        """A class, struct or union with a body; None if what follows is something else. Declarations ahead of a definition are passed over."""
        kind, line, j, names, colon = self.t[i].text, self.t[i].line, i + 1, [], 0
        while j < end:
            t = self.t[j]
            if t.kind == "word":
                if t.text != "final" and not (UPPER.match(t.text) and self.is_word(j + 1) and self.t[j + 1].text != "final"):
                    joined = names and self.is_op(j - 1, "::")
                    names = [*names, t.text] if joined else [t.text]
                j += 1
            elif self.is_op(j, "::"):
                j += 1
            elif self.is_op(j, "<"):
                k = self.angle(j)
                if k == j:
                    return None
                j = k
            elif self.is_op(j, "(") or self.is_op(j, "["):
                if self.is_op(j, "(") and self.t[j - 1].text not in ("__declspec", "alignas", "__attribute__"):
                    return None
                names = [] if self.is_op(j, "(") else names
                j = self.closing(j)
            elif self.is_op(j, ":"):
                colon = j
                break
            elif self.is_op(j, "{"):
                break
            elif self.is_op(j, ";"):
                return j + 1
            else:
                return None
        open_ = j
        while open_ < end and not self.is_op(open_, "{"):
            if self.is_op(open_, ";"):
                return open_ + 1
            open_ += 1
        if open_ >= end:
            return None
        stop = self.closing(open_)
        name = "::".join(names)
        full = "::".join(filter(None, [qname, name]))
        if kind == "union" and name:
            return self.to_semicolon(stop, end) if not self.is_op(stop, "}") else stop  # no class: its members are passed over
        if name:
            self.entity(kind, names[-1], "::".join(filter(None, [qname, *names[:-1]])), line, self.t[min(stop, len(self.t)) - 1].line)
            for base in self.bases(colon + 1, open_) if colon else []:
                self.relation(full, base, "inherits", line)
        self.scope(open_ + 1, stop - 1, full, True if name else in_class)
        return self.to_semicolon(stop, end) if not self.is_op(stop, "}") else stop

    def bases(self, i: int, end: int) -> list[str]:
        out, name = [], None
        while i < end:
            if self.is_word(i) and self.t[i].text not in ("public", "private", "protected", "virtual", "typename"):
                name = self.t[i].text
            elif self.is_op(i, "<"):
                k = self.angle(i)
                i = k - 1 if k > i else i
            elif self.is_op(i, ","):
                out.append(name)
            i += 1
        return [n for n in [*out, name] if n]

    def member(self, i: int, end: int, qname: str, in_class: bool) -> int:
        """A function or a field, from i to its `;` or body."""
        j, call, body, assign = i, None, None, None
        while j < end:
            t = self.t[j]
            if t.kind == "op":
                if t.text == ";":
                    break
                if t.text == "(" and call is None and assign is None:
                    call = j
                    if self.is_word(j - 1, "operator"):  # operator()
                        j = self.closing(j)
                        call = None
                        continue
                    j = self.closing(j)
                    continue
                if t.text == "{":
                    if call is None or assign is not None:  # an initializer
                        j = self.closing(j)
                        assign = assign or j
                        continue
                    if self.t[j - 1].kind == "word" and self.in_initializers(call, j) and not self.is_word(j - 1, "const", "override", "final", "noexcept", "try"):
                        j = self.closing(j)
                        continue
                    body = j
                    break
                if t.text == "<" and (self.t[j - 1].kind == "word" or j == i) and not self.is_word(j - 1, "operator"):
                    k = self.angle(j)
                    if k > j:
                        j = k
                        continue
                if t.text == "=" and not self.is_word(j - 1, "operator"):
                    assign = assign or j
                if t.text == "}":
                    return j
                if t.text in OPEN:
                    j = self.closing(j)
                    continue
            j += 1
        if body is not None:
            stop = self.closing(body)
            self.method(i, call, body, body, stop, qname, in_class)
            return stop + self.is_op(stop, ";")
        if call is not None:
            self.method(i, call, min(j, end), None, None, qname, in_class)
        elif in_class:
            self.fields(i, min(j, end), qname)
        return j + 1

    def in_initializers(self, call: int, at: int) -> bool:
        """Whether a constructor's initializer list has begun between the parameters and `at`."""
        j = self.closing(call)
        while j < at:
            if self.is_op(j, ":"):
                return True
            j = self.closing(j) if self.t[j].kind == "op" and self.t[j].text in OPEN else j + 1
        return False

    def method(self, i: int, call: int, end: int, body: int | None, stop: int | None, qname: str, in_class: bool) -> None:
        a = call
        words: list[str] = []
        if self.t[a - 1].kind == "op" and any(self.is_word(k, "operator") for k in range(max(i, a - 3), a)):
            k = next(k for k in range(max(i, a - 3), a) if self.is_word(k, "operator"))
            words, a = ["operator" + "".join(x.text for x in self.t[k + 1 : a])], k
        elif self.is_word(a - 1) and a - 1 >= i and self.is_word(a - 2, "operator"):
            words, a = [f"operator {self.t[a - 1].text}"], a - 2
        elif a - 1 >= i and self.is_word(a - 1):
            words, a = [self.t[a - 1].text], a - 1
            if a > i and self.is_op(a - 1, "~"):
                words, a = ["~" + words[0]], a - 1
        if not words or words[0] in NOT_A_TYPE - {"string", "function", "pair", "tuple", "list"}:
            return
        while a - 2 >= i and self.is_op(a - 1, "::"):
            a -= 2
            if self.is_op(a, ">"):  # a template's arguments before the scope
                depth = 0
                while a > i:
                    depth += self.is_op(a, ">") - self.is_op(a, "<")
                    if depth == 0:
                        break
                    a -= 1
                a -= 1
            if not self.is_word(a):
                break
            words.insert(0, self.t[a].text)
        if in_class:
            parent = qname
        elif len(words) > 1:
            parent = "::".join(filter(None, [qname, *words[:-1]]))
        else:
            return  # a free function
        first, last = self.t[i].line, self.t[min(stop if stop is not None else end + 1, len(self.t)) - 1].line
        signature = self.text[self.t[i].start : self.t[min(stop if stop is not None else end + 1, len(self.t)) - 1].end].strip()
        self.entity("method", words[-1], parent, first, last, signature)
        after = self.closing(call)
        names = set(self.type_names(i, a)) | set(self.parameter_names(call + 1, after - 1))
        k = after
        while k < end and not self.is_op(k, ":") and not self.is_op(k, "="):
            if self.is_op(k, "->"):
                names |= set(self.type_names(k + 1, end))
            k += 1
        self.methods.append((parent, set(words), first, names, self.body_names(body + 1, stop - 1) if body is not None else []))

    def type_names(self, i: int, end: int) -> list[str]:
        """The last segments of the type names from i to end, template arguments among them."""
        out = []
        while i < end:
            if self.is_word(i) and not self.is_op(i + 1, "::") and self.t[i].text not in NOT_A_TYPE:
                out.append(self.t[i].text)
            i += 1
        return out

    def parameter_names(self, i: int, end: int) -> list[str]:
        """Type names of parameters; a parameter's own name and its default are left out."""
        out, start, depth, j = [], i, 0, i
        while j <= end:
            if j == end or (depth == 0 and self.is_op(j, ",")):
                stop = next((k for k in range(start, j) if self.is_op(k, "=")), j)
                words = [k for k in range(start, stop) if self.is_word(k) and self.t[k].text not in QUALIFIERS]
                while stop > start and self.is_op(stop - 1, "]"):  # an array
                    while stop > start and not self.is_op(stop - 1, "["):
                        stop -= 1
                    stop -= 1
                last = stop - 1
                if len(words) > 1 and last >= start and self.is_word(last) and not self.is_op(last - 1, "::"):
                    stop = last
                out += self.type_names(start, stop)
                start = j + 1
            elif j < end and self.t[j].kind == "op":
                depth += self.t[j].text in ("<", "(", "[", "{")
                depth -= self.t[j].text in (">", ")", "]", "}")
            j += 1
        return out

    def body_names(self, i: int, end: int) -> list[tuple[str, int]]:
        """(name, line) where a body brings in a type: locals, new, casts, template arguments, scopes."""
        out: list[tuple[str, int]] = []
        fresh = True

        def add(name: str, at: int) -> None:
            if name not in NOT_IN_A_BODY:
                out.append((name, self.t[at].line))

        while i < end:
            t = self.t[i]
            if t.kind == "word":
                j, path = i, [i]
                while True:  # a path of names, each perhaps with template arguments
                    k = j + 1
                    if self.is_op(k, "<"):
                        e = self.angle(k)
                        if e > k and (self.is_op(e, "(") or self.is_op(e, "::") or self.is_op(e, "{") or self.is_word(e) or self.is_op(e, "*") or self.is_op(e, "&") or self.is_op(e, ">")):
                            for name in self.type_names(k + 1, e - 1):
                                add(name, k)
                            k = e
                    if self.is_op(k, "::") and self.is_word(k + 1):
                        j = k + 1
                        path.append(j)
                        continue
                    break
                before = self.t[i - 1].text
                scoped = self.t[path[-2]].text if len(path) > 1 else None
                declares = fresh and before not in (".", "->") and self.declares(k, end)
                if before == "new" or declares:
                    add(self.t[path[-1]].text, i)
                elif scoped:
                    add(scoped, i)
                fresh = t.text in ("const", "static", "constexpr", "auto", "else", "do") and len(path) == 1 and (fresh or t.text in ("else", "do"))
                i = k
                continue
            if t.kind == "op" and t.text == "(":
                e = self.closing(i)
                inner = [x for x in self.t[i + 1 : e - 1]]
                cast = inner and inner[0].kind == "word" and all(x.kind == "word" or x.text in ("::", "*", "&", "<", ">", ",") for x in inner) and any(x.text in ("*", "&") for x in inner[-1:])
                if cast and (self.is_word(e) or self.is_op(e, "(") or self.is_op(e, "&")) and self.t[i - 1].kind == "op":
                    for name in self.type_names(i + 1, e - 1):
                        add(name, i)
                fresh = self.is_word(i - 1, "for", "if", "while", "switch", "catch")
            else:
                fresh = t.kind == "op" and t.text in ("{", "}", ";")
            i += 1
        return out

    def declares(self, k: int, end: int) -> bool:
        """Whether a name at k follows a type: `T x`, `T* x`, `T& x`, then `;`, `=`, `(`, `{`, `[`, `,` or `:`."""
        while self.is_op(k, "*") or self.is_op(k, "&") or self.is_op(k, "&&") or self.is_word(k, "const"):
            k += 1
        return k < end and self.is_word(k) and self.t[k].text not in NOT_A_TYPE and k + 1 <= end and (k + 1 == end or (self.t[k + 1].kind == "op" and self.t[k + 1].text in (";", "=", "(", "{", "[", ",", ":", ")")))

    def fields(self, i: int, end: int, qname: str) -> None:
        """Fields of a plain or single-pointer declarator; arrays and references are none."""
        first = self.t[i].line
        last = self.t[min(end, len(self.t) - 1)].line
        while i < end and self.is_word(i, *QUALIFIERS - {"friend"}):
            i += 1
        if i >= end or self.is_word(i, "operator", "friend", "return", "goto", "public", "private", "protected"):
            return
        if self.is_word(i, "class", "struct", "enum", "union"):
            i += 1
        j = i
        while j < end:  # the type: words, scopes and template arguments, up to the first declarator
            if self.is_op(j, "<"):
                k = self.angle(j)
                if k == j:
                    return
                j = k
            elif self.is_op(j, "::") or (self.is_word(j) and (j == i or self.is_op(j - 1, "::") or self.t[j - 1].text in ("unsigned", "signed", "long", "short") and self.t[j].text in ("int", "long", "char", "short", "double"))):
                j += 1
            else:
                break
        type_text = self.source(i, j)
        while self.is_word(j, "const", "volatile"):
            j += 1
        while j < end:
            stars = 0
            while j < end and (self.is_op(j, "*") or self.is_word(j, "const")):
                stars += self.is_op(j, "*")
                j += 1
            if not self.is_word(j):
                return
            name, plain = self.t[j].text, True
            j += 1
            while j < end and not self.is_op(j, ","):
                plain = plain and not self.is_op(j, "[")
                if self.is_op(j, "=") or self.is_op(j, "{"):  # the initializer
                    while j < end and not self.is_op(j, ","):
                        j = self.closing(j) if self.t[j].kind == "op" and self.t[j].text in OPEN else j + 1
                    break
                j = self.closing(j) if self.t[j].kind == "op" and self.t[j].text in OPEN else j + 1
            if plain and stars <= 1 and type_text:
                signature = type_text + "*" * stars
                self.entity("field", name, qname, first, last, signature)
                found = classify_field(signature)
                if found:
                    self.relation(qname, found[1], found[0], first, via_field=name, type_text=signature)
            j += 1


def parse(text: str, path: str = "") -> Parsed:
    """Entities, relationships and aliases of a file; names are resolved later, in tables."""
    return Reader(text, path).read()
