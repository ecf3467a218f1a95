"""Column functions on nucleotide sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand for several bases.
AMBIGUOUS = "RYSWKMBDHVN"


def hamming(a: Column, b: Column) -> Column:
    """Differing places of the common length: the longer sequence is cut, as a zip would. Null if one is null."""
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(n > 0, F.size(places)).otherwise(F.lit(0)))


def strict_hamming(a: Column, b: Column) -> Column:
    """Hamming distance; null where the lengths differ."""
    return F.when(F.length(a) == F.length(b), hamming(a, b))


def is_ambiguous(c: Column) -> Column:
    return c.rlike(f"[{AMBIGUOUS}]")


MASKED = 16


def link_keys(tag: Column, k: int) -> Column:
    """What a tag shares with the tags of its length within k errors, at the same place of the array.

    For one error in a short tag: the tag with each of its letters masked, so only tags
    that are linked meet; else its pieces."""
    if k != 1:
        return segments(tag, k)
    masked = F.transform(F.sequence(F.lit(1), F.length(tag)), lambda i: F.concat(F.substring(tag, F.lit(1), i - 1), F.lit("_"), F.substring(tag, i + 1, F.length(tag))))
    return F.when(F.length(tag).between(1, MASKED), masked).otherwise(segments(tag, k))


def segments(tag: Column, k: int) -> Column:
    """k + 1 disjoint pieces of a tag; the last takes the rest. Tags of a length within k errors share one."""
    width = F.greatest(F.lit(1), F.floor(F.length(tag) / F.lit(k + 1)).cast("int"))
    cut = [F.substring(tag, F.lit(1) + F.lit(i) * width, width) for i in range(k)]
    return F.array(*cut, F.substring(tag, F.lit(1) + F.lit(k) * width, F.length(tag)))


#: What means the same to the JVM and to Python: plain characters, classes of them, groups,
#: counts, and back-references by name.
_TOKEN = re.compile(r"\(\?P<(?P<name>\w+)>|\(\?P=(?P<ref>\w+)\)|\(\?:|\((?!\?)|\\[.^$*+?()\[\]{}|\\/-]|\[\^?[\w ,:;=-]+\]|\{\d+(?:,\d*)?\}|[\w ,:;=^$.*+?|)-]", re.ASCII)


def _tokens(pattern: str) -> list[re.Match] | None:
    """The parts of a pattern, or None if it has any that the JVM may read in another way."""
    at, out = 0, []
    while at < len(pattern):
        if not (m := _TOKEN.match(pattern, at)):
            return None
        out.append(m)
        at = m.end()
    return out


def is_plain(pattern: str) -> bool:
    """Whether the JVM's regular expressions can stand for a pattern (see ``to_java``)."""
    if _tokens(pattern) is None:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def to_java(pattern: str) -> str:
    """The pattern for the JVM: groups are read by number there, so their names go."""
    numbers = group_numbers(pattern)
    out = []
    for m in _tokens(pattern) or ():
        if m["name"]:
            out.append("(")
        elif m["ref"]:
            out.append(f"(?:\\{numbers[m['ref']]})")
        else:
            out.append({".": "[^\n]", "$": "(?=\n?\\z)"}.get(m[0], m[0]))
    return "".join(out)


def group_numbers(pattern: str) -> dict[str, int]:
    """Number of each named group; several names may not be the same."""
    return dict(re.compile(pattern).groupindex)


def stem(name: str) -> str:
    """A group's barcode: its name without trailing digits."""
    return name.rstrip("0123456789")
