"""String, path, glob and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold code from elsewhere.
VENDORED = ("bundled", "third_party", "thirdparty", "external", "vendor", "deps", "_deps")
# Names that say nothing about the design of a code base.
NOISE_PREFIXES = ("JA_", "SFRES_", "SPP", "SM_")
NOISE_WRAPPERS = ("vector", "list", "map", "set", "unordered_map", "unordered_set", "array", "deque", "SharedPtr", "shared_ptr", "unique_ptr", "weak_ptr", "ScopedSMArray", "ScopedSMString", "pair", "tuple")
NOISE_NAMES = ("tag_t", "logical", "Vint", "Vfloat", "Vdouble")


def last_segment(qname: Column) -> Column:
    """The part after the last `::`."""
    return F.element_at(F.split(qname, "::"), -1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """All before the last slash; empty where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def effective_target(target_qname: Column, target_name: Column) -> Column:
    """The resolved name, or the name as written; an empty one counts as missing."""
    return F.coalesce(F.nullif(target_qname, F.lit("")), target_name)


def evidence(source: Column, kind: Column, target: Column, file: Column, line: Column) -> Column:
    """`A --kind--> B (file:line)`, the place only where there is a file."""
    place = F.when(F.coalesce(file, F.lit("")) != "", F.concat(F.lit(" ("), basename(file), F.lit(":"), line.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(source, F.lit(" --"), kind, F.lit("--> "), target, place)


def is_vendored(path: Column) -> Column:
    """Whether a component of a relative path is a vendored directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(v) for v in VENDORED]))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression that Java, Python and RE2 read alike."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
    return f"(?s)^{out}$"


def glob_match(pattern: str, path: Column, short: Column, qname: Column) -> Column:
    """Whether the pattern fits the path, the short name or the qualified name; with a slash it may begin inside the path."""
    fits = [path.rlike(glob_regex(pattern)), short.rlike(glob_regex(pattern)), qname.rlike(glob_regex(pattern))]
    if "/" in pattern:
        fits.append(path.rlike(glob_regex("*/" + pattern)))
    out = F.coalesce(fits[0], F.lit(False))
    for f in fits[1:]:
        out = out | F.coalesce(f, F.lit(False))
    return out


def is_noise_external(name: Column) -> Column:
    """An external name that is a type expression, a macro, a typedef or a wrapper rather than a class."""
    prefixed = F.lit(False)
    for p in NOISE_PREFIXES:
        prefixed = prefixed | name.startswith(p)
    empty = F.coalesce(name, F.lit("")) == ""
    return empty | name.rlike(r"[<>*, ]") | prefixed | name.rlike(r"(_t|_type)$") | ((F.upper(name) == name) & name.rlike("[A-Z]")) | name.isin(*NOISE_WRAPPERS, *NOISE_NAMES)


def is_pure_virtual(signature: Column) -> Column:
    """No body, and nothing after the last parenthesis but qualifiers and `= 0`."""
    tail = F.element_at(F.split(signature, r"\)"), -1)
    for word in ("const", "noexcept", "override", "final", "&", ";"):
        tail = F.replace(tail, F.lit(word), F.lit(" "))
    rest = F.replace(F.translate(tail, "\t\r\n", "   "), F.lit(" "), F.lit(""))
    return F.coalesce(signature.contains(")") & ~signature.contains("{") & (rest == "=0"), F.lit(False))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_text(text: Column, index: Column) -> Column:
    """The line at an index from 0, trimmed; null beyond the end."""
    return F.regexp_replace(F.get(F.split(text, "\n"), index), r"^\s+|\s+$", "")


def template(text: Column, values: dict[str, Column]) -> Column:
    """Replace each {TOKEN} by its value."""
    for token, value in values.items():
        text = F.replace(text, F.lit("{" + token + "}"), F.coalesce(value, F.lit("")))
    return text


def rescued_json(reply: Column) -> Column:
    """The JSON object in a reply: in a fenced block, else from the first brace to the last; null where none parses."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(fenced), valid(braces))


def prompt_hash(model: Column, system: Column, prompt: Column) -> Column:
    """SHA-256 of model, system text and prompt, parted by NUL."""
    return F.sha2(F.concat(model, F.char(F.lit(0)), system, F.char(F.lit(0)), prompt), 256)
