"""Expressions on paths, identities and code text; all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx"}
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def identity(*parts: Column | str) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, joined by NUL; null counts as empty."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\0", *texts), 256), 1, 32)


def key_of(*parts: Column | str) -> Column:
    """SHA-256 of the parts, joined by colons: the key of a cache."""
    return F.sha2(F.concat_ws(":", *(col(p).cast("string") for p in parts)), 256)


def code_terms(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9; camel case and underscores separate."""
    spaced = F.regexp_replace(F.coalesce(col(text), F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.replace(F.lower(spaced), F.lit("_"), F.lit(" ")), F.lit("[a-z0-9]+"), F.lit(0))


def language_of(path: Column | str) -> Column:
    """By suffix, case as is; everything else is text."""
    suffix = F.regexp_extract(F.regexp_extract(col(path), "([^/]*)$", 1), r"^.+(\.[^.]+)$", 1)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, suffix), F.lit("text"))


def glob_regex(pattern: str) -> str:
    """A shell pattern (star crosses slashes) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body, i = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&"), end + 1
            out += f"[{'^' + body[1:] if body.startswith('!') else body.replace('^', chr(92) + '^', 1) if body.startswith('^') else body}]"
        else:
            out += "\\" + c if not c.isalnum() and ord(c) < 128 else c
    return f"(?s)^{out}$"


def directory(path: Column | str) -> Column:
    """The directories of a path, as an array."""
    parts = F.split(col(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def normal_parts(parts: Column) -> Column:
    """Parts of a relative path without empty ones and dots, and with parents taken back."""
    kept = F.filter(parts, lambda x: (x != "") & (x != "."))
    last = lambda a: F.try_element_at(a, F.lit(-1))

    def step(done: Column, x: Column) -> Column:
        back = (x == "..") & (F.size(done) > 0) & (last(done) != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(kept, F.array().cast("array<string>"), step)
