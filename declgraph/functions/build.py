"""Build conditions of Go files: names, //go:build expressions and older +build lines, under three-valued logic."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Systems and architectures that a file name or a tag may name, and the systems that count as unix.
SYSTEMS = {"aix", "android", "darwin", "dragonfly", "freebsd", "hurd", "illumos", "ios", "js", "linux", "nacl", "netbsd", "openbsd", "plan9", "solaris", "wasip1", "windows", "zos"}
ARCHITECTURES = {"386", "amd64", "arm", "arm64", "loong64", "mips", "mips64", "mips64le", "mipsle", "ppc64", "ppc64le", "riscv64", "s390x", "wasm"}
UNIX = {"aix", "android", "darwin", "dragonfly", "freebsd", "hurd", "illumos", "ios", "linux", "netbsd", "openbsd", "solaris"}
HEAD_LINES = 50


@dataclass(frozen=True)
class Context:
    system: str = "linux"
    architecture: str = "amd64"
    tags: frozenset[str] = field(default_factory=frozenset)

    def value(self, tag: str) -> bool | None:
        """True or false for tags that are known, else None."""
        if tag in (self.system, self.architecture) or tag in self.tags:
            return True
        if tag == "unix":
            return self.system in UNIX
        return False if tag in SYSTEMS or tag in ARCHITECTURES else None


def name_matches(path: str, context: Context) -> bool:
    """By the last parts of a file's name: _system_architecture, _system or _architecture."""
    parts = path.rsplit("/", 1)[-1].removesuffix(".go").removesuffix("_test").split("_")
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last in ARCHITECTURES:
        return last == context.architecture and (before not in SYSTEMS or before == context.system)
    return last not in SYSTEMS or last == context.system


def evaluate(expression: str, context: Context) -> bool:
    """Is the expression not definitely false? Unknown tags are neither; what cannot be read is kept."""
    tokens = re.findall(r"\|\||&&|[!()]|[\w.]+|\S", expression)
    at = 0

    def take(want: str) -> bool:
        nonlocal at
        if at < len(tokens) and tokens[at] == want:
            at += 1
            return True
        return False

    def either() -> bool | None:
        value = both()
        while take("||"):
            other = both()
            value = True if value is True or other is True else None if value is None or other is None else False
        return value

    def both() -> bool | None:
        value = one()
        while take("&&"):
            other = one()
            value = False if value is False or other is False else None if value is None or other is None else True
        return value

    def one() -> bool | None:
        nonlocal at
        if take("!"):
            value = one()
            return None if value is None else not value
        if take("("):
            value = either()
            if not take(")"):
                raise ValueError(expression)
            return value
        if at >= len(tokens) or not re.fullmatch(r"[\w.]+", tokens[at]):
            raise ValueError(expression)
        at += 1
        return context.value(tokens[at - 1])

    try:
        value = either()
    except ValueError:
        return True
    return True if at < len(tokens) else value is not False


def legacy_matches(line: str, context: Context) -> bool:
    """`a,b !c`: blanks are or, commas and. Options are looked at from the left, their tags too, until one settles it; an unknown tag
    that is come by keeps the file."""
    unknown = False
    for option in line.split():
        for tag in option.split(","):
            value = context.value(tag.lstrip("!"))
            if value is None:
                unknown = True
            elif value == tag.startswith("!"):
                break
        else:
            if not unknown:
                return True
    return unknown


def included(path: str, text: str | None, context: Context) -> bool:
    if not name_matches(path, context):
        return False
    older = True
    for line in (text or "").split("\n")[:HEAD_LINES]:
        line = line.strip()
        if line.startswith("package "):
            break
        if line.startswith("//go:build "):
            return evaluate(line[11:], context)
        m = re.match(r"//\s*\+build\s+(.*)", line)
        if m:
            older = older and legacy_matches(m[1], context)
    return older


def only_included(files: DataFrame, context: Context = Context()) -> DataFrame:
    """files(file, text, ...) that are built in the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [included(f or "", t, context) for f, t in zip(batch["file"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return files.mapInArrow(run, files.schema)
