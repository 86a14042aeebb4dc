"""What a C++ type expression says about the design: the kind of relation and its target."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Names that are no classes of the code base.
PRIMITIVES = frozenset("int char bool short long float double void unsigned signed size_t string auto wchar_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())
STD_NOISE = frozenset("function string string_view pair tuple initializer_list".split())
CONTAINERS = ("vector", "list", "deque", "set", "unordered_set", "multiset", "map", "unordered_map", "multimap", "array")
SMART_POINTERS = ("unique_ptr", "shared_ptr", "weak_ptr")
KEYWORDS = frozenset(
    "class struct const static virtual override final noexcept inline explicit mutable volatile extern register typename template public private protected friend return if else for while switch case".split()
)
#: Words that stand where a type might but are none.
SYNTAX = frozenset("constexpr consteval constinit enum union using typedef operator new delete this nullptr true false sizeof alignof decltype do break continue default goto try catch throw namespace co_await co_return co_yield thread_local and or not".split())
NOT_A_TYPE = PRIMITIVES | KEYWORDS | STD_NOISE | SYNTAX
NOT_IN_A_BODY = NOT_A_TYPE | frozenset(CONTAINERS) | frozenset(SMART_POINTERS) | {"std"}

COUNTED = frozenset(("shared_ptr", "weak_ptr", "handle", "intrusive_ptr"))
NO_TARGET = PRIMITIVES | KEYWORDS | STD_NOISE
QUALIFIERS = frozenset(("const", "volatile", "typename", "struct", "class"))
TOKEN = re.compile(r"[A-Za-z_]\w*|::|\S")


@dataclass
class TypeName:
    """One level of a type expression: its name without scope, None where it is no plain name, and its arguments."""

    name: str | None = None
    arguments: list[TypeName] = field(default_factory=list)

    def levels(self) -> Iterator[TypeName]:
        yield self
        for a in self.arguments:
            yield from a.levels()

    def core(self) -> str | None:
        """The name that the last arguments lead to, None if it is no class."""
        return self.arguments[-1].core() if self.arguments else None if self.name in NO_TARGET else self.name


def parse_type(expression: str) -> tuple[TypeName, list[str]]:
    """The tree of a type expression, and its tokens."""
    tokens = TOKEN.findall(expression)
    top = TypeName()
    open_, spot, scoped = [top], top, True
    for t in tokens:
        if t == "<":
            spot = TypeName()
            open_[-1].arguments.append(spot)
            open_.append(spot)
            scoped = True
        elif t == "," and len(open_) > 1:
            open_.pop()
            spot = TypeName()
            open_[-1].arguments.append(spot)
            open_.append(spot)
            scoped = True
        elif t == ">" and len(open_) > 1:
            open_.pop()
            spot = open_[-1]
        elif t == "::":
            scoped = True
        elif t in QUALIFIERS or t in "*&" or spot.arguments:
            pass  # what follows the arguments says nothing more
        elif scoped and (t[0].isalpha() or t[0] == "_"):
            spot.name, scoped = t, False
        else:  # two words, a function, an array or a number
            spot.name, scoped = None, False
    return top, tokens


def innermost_name(expression: str) -> str | None:
    """The class at the core of a type: the last argument followed inwards; None if it is none."""
    return parse_type(expression)[0].core()


def classify_field(expression: str) -> tuple[str, str] | None:
    """(relation kind, target's short name) of a field's type, None if it is no class.

    What owns alone composes, wherever it stands; what counts or watches owners
    associates; containers aggregate; a bare pointer associates; a value composes.
    """
    tree, tokens = parse_type(expression)
    core = None if tree.name in STD_NOISE else tree.core()
    if core is None:
        return None
    wrappers = {x.name for x in tree.levels() if x.name and x.arguments}
    if "unique_ptr" in wrappers:
        return "composes", core
    if any(w.lower() in COUNTED for w in wrappers):
        return "associates", core
    if wrappers & set(CONTAINERS):
        return "aggregates", core
    return ("associates" if tokens[-1] == "*" else "composes"), core


def alias_kind(text: str) -> str | None:
    """The kind that an alias's text implies for what is declared with it; None for a bare name, which says nothing."""
    _, tokens = parse_type(text)
    wrapped = "<" in tokens or "&" in tokens or tokens[-1:] == ["*"]
    found = classify_field(text) if wrapped else None
    return found[0] if found else None
