"""Column functions on names, paths and signatures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard(pattern: str) -> str:
    """A pattern with * (any run, also over /) and ? as an anchored-free regex source."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.strip())


def excludes_folder(directory: Column, patterns: list[str]) -> Column:
    """True where a pattern without / matches a whole segment, or one with / a run of segments."""
    out = F.lit(False)
    for p in sorted({p.strip() for p in patterns if p.strip()}):
        body = wildcard(p.strip("/")) if "/" in p else wildcard(p).replace(".*", "[^/]*")
        out = out | directory.rlike(f"(?:^|/){body}(?:/|$)")
    return F.coalesce(out, F.lit(False))


def excludes_substring(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.contains(p)
    return F.coalesce(out, F.lit(False))


def strip_qualifier(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"@\{[^}]*\}\.", ""), r"\b[A-Za-z_][A-Za-z0-9_]*\.", "")


def build_matches(expression: Column) -> Column:
    """Three-valued logic: a condition that is not definitely false is kept."""
    return F.coalesce(expression, F.lit(True))


def excludes_package(import_path: Column, patterns: list[str]) -> Column:
    """True where a whole import path matches a pattern; a package without a path is not excluded."""
    out = F.lit(False)
    for p in sorted({p.strip() for p in patterns if p.strip()}):
        out = out | import_path.rlike(f"^{wildcard(p)}$")
    return F.coalesce(out, F.lit(False))


def excludes_type(name: Column, patterns: list[str]) -> Column:
    """By a part of the type's name, or if it starts with an underscore; a pointer's star is no part of it."""
    bare = F.regexp_replace(name, r"^\*", "")
    return F.coalesce(bare.startswith("_"), F.lit(False)) | excludes_substring(bare, [p for p in patterns if p])


#: Words before a bracket that call no method.
NO_METHODS = ("append", "cap", "case", "close", "copy", "delete", "for", "func", "go", "if", "import", "interface", "len", "make", "map", "new", "panic", "print", "println", "range", "recover", "return", "select", "struct", "switch", "type", "var")


def called_names(text: Column) -> Column:
    """Distinct names before an opening bracket that follow no dot: what a file may declare as a method. A file can declare or implement a method only if
    its name is among them, so this prunes files before they are parsed, whatever the method."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![.\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]*)\s*\("), F.lit(1))
    return F.array_except(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))), F.array(*map(F.lit, NO_METHODS)))


def interface_candidate(text: Column, method: str) -> Column:
    """Could the text declare an interface method of this name? A cheap test before parsing; never false for one that does."""
    return F.coalesce(F.array_contains(called_names(text), method) & text.contains("interface"), F.lit(False)) | F.coalesce(F.array_contains(called_names(text), method) & ~text.contains("func"), F.lit(False))


def implementation_candidate(text: Column, method: str) -> Column:
    """Could the text declare a method of this name on a receiver?"""
    return F.coalesce(F.array_contains(called_names(text), method) & text.contains("func"), F.lit(False))
