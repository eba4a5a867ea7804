"""go.mod files: requires and replaces, where locked modules lie, and which directory an import means."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declgraph.operators.kernels import longest_prefix


@dataclass
class Module:
    path: str | None = None
    requires: dict[str, str] = field(default_factory=dict)
    local: dict[str, str] = field(default_factory=dict)  # module -> folder
    replaced: dict[str, tuple[str, str]] = field(default_factory=dict)  # module -> other module, version


def parse(text: str | None) -> Module:
    """Single and block require and replace directives, in order; comments, exclude and retract are left out. Blocks of replaces
    hold after all else; a require behind a local replace asks for the module again."""
    out, block, late = Module(), None, []

    def require(line: str) -> None:
        parts = line.split()
        if len(parts) >= 2:
            out.requires[parts[0].strip('"')] = parts[1]

    def replace(line: str) -> None:
        left, arrow, right = line.partition("=>")
        old, new = left.split(), right.split()
        if not arrow or not old or not new:
            return
        name, target = old[0].strip('"'), new[0].strip('"')
        if re.match(r"\.{1,2}(/|$)|/|[A-Za-z]:", target):
            out.local[name] = target
            out.requires.pop(name, None)
        elif len(new) > 1:
            out.replaced[name] = target, new[1]
            out.requires[name] = new[1]

    for line in (text or "").splitlines():
        line = line.split("//")[0].strip()
        word, _, rest = line.partition(" ")
        if block:
            if line == ")":
                block = None
            elif line:
                late.append(line) if block == "replace" else require(line) if block == "require" else None
        elif re.fullmatch(r"\w+\s*\(", line):
            block = line.rstrip("( \t")
        elif word == "module":
            out.path = rest.strip().strip('"')
        elif word == "require":
            require(rest)
        elif word == "replace":
            replace(rest)
    for line in late:
        replace(line)
    return out


def escape(path: str) -> str:
    """As the module cache writes paths: capital letters as ! and the small one."""
    return re.sub("[A-Z]", lambda m: "!" + m[0].lower(), path)


def locked_directories(module: Module, cache: str, home: str) -> list[tuple[str, str]]:
    """(module path, directory) of what a go.mod locks: local replaces relative to its folder, then others in the cache; a replaced
    module under its own and under the other's path."""
    out = [(name, target if target.startswith("/") else f"{home}/{target}") for name, target in module.local.items()]
    out += [(name, f"{cache}/{escape(name)}@{version}") for name, version in module.requires.items()]
    out += [(name, f"{cache}/{escape(target)}@{version}") for name, (target, version) in module.replaced.items()]
    return out


def read_locks(modules: DataFrame, cache: str) -> DataFrame:
    """modules(dir, text) -> home, module, directory: a row for each locked module of each go.mod."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(home, *x) for home, text in zip(batch["dir"].to_pylist(), batch["text"].to_pylist(), strict=True) for x in locked_directories(parse(text), cache, home)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["home", "module", "directory"])

    return modules.select("dir", "text").mapInArrow(run, "home string, module string, directory string")


def import_directories(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports(import_path), modules(module, directory) -> import_path, directory by the longest module that is the path or ends at a
    slash in it; paths with empty, . or .. segments or a backslash have none."""
    plain = imports.select("import_path").distinct().where(~F.col("import_path").rlike(r"(^|/)\.{0,2}(/|$)|\\\\"))
    hit = longest_prefix(plain, "import_path", modules, "module", ["import_path"])
    return hit.join(modules.distinct(), "module").select("import_path", F.expr("concat(directory, substring(import_path, length(module) + 1))").alias("directory"))
