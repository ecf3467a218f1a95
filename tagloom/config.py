"""Configuration of an experiment: barcodes, regular expressions, inputs. Driver only."""

from __future__ import annotations

import csv
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations
from pathlib import Path

from tagloom.functions.sequences import stem

TAGS = ("B2", "query", "BC", "name", "seq")
HIERARCHY_COLUMNS = ("barcode", "type", "referencefile", "threshold", "min_length", "max_length")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Barcode:
    """A level of the hierarchy. references: sequence to name, in file order."""

    name: str
    kind: str = "random"
    references: tuple[tuple[str, str], ...] = ()
    threshold: float = 0
    min_length: int | None = None
    max_length: int | None = None

    @property
    def is_reference(self) -> bool:
        return self.kind == "reference"


@dataclass(frozen=True)
class InputFile:
    path: str
    group: str = ""
    prefix: str = ""


@dataclass
class Regexes:
    """Patterns by input group and tag; the group ``*`` is for all, a group's own pattern wins."""

    groups: dict[str, dict[str, str]] = field(default_factory=dict)

    def of(self, group: str) -> dict[str, str]:
        found = self.groups.get("*", {}) | self.groups.get(group, {})
        if not found:
            raise ConfigError(f"no regular expressions for input group {group!r}")
        return found


def rows(path: str) -> list[dict[str, str]]:
    """All fields as strings; tab-separated if the name ends with tsv."""
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f, delimiter="\t" if str(path).endswith("tsv") else ","))


def truncated_distance(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=False))


def auto_threshold(sequences: Iterable[str]) -> float:
    """Largest number of errors that keeps all references apart; infinite for fewer than two."""
    return min((int((truncated_distance(a, b) - 1) / 2) for a, b in combinations(list(sequences), 2)), default=math.inf)


def read_references(path: str) -> tuple[tuple[str, str], ...]:
    found: dict[str, str] = {}
    for r in rows(path):
        found[str(r["barcode"])] = str(r["name"])
    return tuple(found.items())


def read_hierarchy(path: str) -> list[Barcode]:
    table = rows(path)
    if table and (missing := [c for c in HIERARCHY_COLUMNS if c not in table[0]]):
        raise ConfigError(f"{path}: missing columns {missing}")
    none = lambda x: None if x in ("-", "", None) else x
    out = []
    for r in table:
        references = ()
        kind = "reference" if r["type"] == "reference" else "random"
        if kind == "reference":
            file = Path(r["referencefile"])
            references = read_references(str(file if file.is_absolute() or file.exists() else Path(path).parent / file))
        t = none(r["threshold"])
        threshold = auto_threshold(s for s, _ in references) if t == "auto" else float(t or 0)
        limit = [int(x) if (x := none(r[c])) is not None else None for c in ("min_length", "max_length")]
        out.append(Barcode(r["barcode"], kind, references, threshold, *limit))
    check_names(b.name for b in out)
    return out


def read_regexes(path: str) -> Regexes:
    out = Regexes()
    for r in rows(path):
        if r["tag"] not in TAGS:
            raise KeyError(f"{path}: unknown tag {r['tag']!r}, not one of {TAGS}")
        out.groups.setdefault(r.get("group") or "*", {})[(r.get("prefix") or "") + r["tag"]] = r["regex"]
    return out


def read_inputs(path: str) -> dict[str, list[InputFile]]:
    """Files by group, in order; without a group column each file is its own group."""
    out: dict[str, list[InputFile]] = {}
    for r in rows(path):
        group = r["file"] if "group" not in r else r["group"] or ""
        out.setdefault(group, []).append(InputFile(r["file"], group, r.get("prefix") or ""))
    return out


def check_names(names: Iterable[str]) -> None:
    if bad := [n for n in names if n != stem(n)]:
        raise ConfigError(f"barcode names must not end with digits: {bad}")


def named_groups(pattern: str) -> list[str]:
    import regex

    return list(regex.compile(pattern).groupindex)


def check_regexes(hierarchy: list[Barcode], regexes: Regexes, groups: Iterable[str]) -> None:
    """Every input group's named groups are the barcodes, no more and no fewer."""
    want = {b.name for b in hierarchy}
    for g in groups:
        have = {stem(n) for p in regexes.of(g).values() for n in named_groups(p)}
        if want - have:
            raise ConfigError(f"input group {g!r}: no regular expression for {sorted(want - have)}")
        if have - want:
            raise ConfigError(f"input group {g!r}: not in the hierarchy: {sorted(have - want)}")


def regexes_are_valid(patterns: Iterable[str]) -> bool:
    """Whether a sample and a lineage barcode are extracted."""
    names = [n for p in patterns for n in named_groups(p)]
    return any(n.startswith("sample") for n in names) and any(n.startswith("lid") for n in names)
