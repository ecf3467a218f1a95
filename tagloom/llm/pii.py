"""Surrogates for personal data and secrets.

Detected: mail addresses, phone, card and account numbers, IPv4 and MAC addresses, IBANs,
social-security numbers, keys and tokens, and person names (a first name of the lexicon,
or a title, before a capitalised word). Each is replaced by one of its own kind:

* Characters are permuted by a keyed Feistel network over the positions that vary: a digit
  stays a digit, a hexadecimal digit one, a vowel of a name a vowel, a letter of a script
  one of that script; case and punctuation stay. Octets of addresses keep their number of
  digits; card and account numbers keep a valid check digit, or an invalid one, by walking
  the permutation's cycle. Ends of Russian surnames that tell the gender stay.
* A first name gets another one of the same gender and script by a keyed permutation of
  the lexicon without fixed points. Titles and top-level domains stay.

Each map is one-to-one on the values of a format, so different people stay different, and
it depends on nothing but key, kind and value (letter case and, for numbers, separators
apart), so a value has the same surrogate in all documents. A surrogate never equals its
original where any of its characters is permuted.

``op5_pii`` checks both over the entities of all documents, as keyed digests, and fails if
two originals have one surrogate or one has two. ``pseudonymise`` alone is one pass without
shuffle. Defined results: null text stays null with 0 entities; repeated rows
are treated alike; an empty table gives no rows; time is in proportion to a text's length.
Other columns are carried along, but n_entities and kinds are replaced.
"""

import hmac
import math
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, releasing, table

KEY = b"tagloom surrogate key: replace in production"
ROUNDS, CHUNK = 8, 64

NAMES = {
    ("latin", "f"): "Anna Maria Sophie Emma Julia Laura Sarah Katharina Claudia Isabelle Camille Élodie Chloé Amélie Lucía Carmen Elena Sofía Martina Ingrid Emily Jessica Jennifer Linda Susan Margaret Elizabeth Patricia Barbara Nancy Alice Charlotte Olivia Amelia Hannah Johanna Petra Monika Sabine Ursula Nathalie Brigitte Valérie Céline Pilar Mercedes Dolores Rosario Beatriz Mary".split(),
    ("latin", "m"): "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Peter Paul Hans Jürgen Klaus Wolfgang Stefan Andreas Markus Tobias Pierre Jacques François Philippe Antoine Julien Nicolas Étienne Olivier José Carlos Miguel Javier Alejandro Fernando Diego Pablo Manuel Sergio Henry George Edward Oliver Benjamin Samuel".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Владимир Николай Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Βασιλική".split(),
    ("greek", "m"): "Γιώργος Γιάννης Κώστας Δημήτρης Νίκος Παναγιώτης".split(),
}
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mademoiselle Mme Señor Señora Don Doña".split()
_first = {n: at for at, names in NAMES.items() for n in names}
_starts = set(_first) | set(TITLES)
_parts = re.compile(r"\w+").findall

#: Letters that may stand for one another; a letter in none of them stays as it is. ß and ς are
#: in none: their capitals are those of other letters, so two values could become one.
_VOWELS, _CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
_SETS = [_VOWELS, _CONSONANTS, "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñðþšžčćđğłńř", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "αεηιοωυάέήίόύώ", "βγδζθκλμνξπρστφχψ"]
_set_of = {c: s for s in _SETS for c in s}
_ALPHA = {c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: s for s in _SETS[2:] for c in s}

_WORD = r"[^\W\d_]"
_PREFIXES = ("sk", "pk", "ghp", "gho", "xoxa", "xoxb", "xoxp", "AKIA", "ASIA", "AIza")
#: Kind, pattern, and what a text holds one of if it matches; None: a digit.
PATTERNS = [
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY-----", ("-----BEGIN",)),
    ("email", r"(?<![\w.+%-])[\w.+%-]++@(?:[\w-]++\.)+[^\W\d_]{2,}+", ("@",)),
    ("secret", r"(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)(?P<value>[\w\-+/=.]{6,})", ("=", ":")),
    ("secret", r"\b(?:sk|pk|ghp|gho|xox[abp]|AKIA|ASIA|AIza)[-_]?[A-Za-z0-9_-]{16,}\b", _PREFIXES),
    ("secret", r"\b(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{24,}\b", None),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", None),
    ("mac", r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b", (":",)),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)", None),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", None),
    ("card", r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-])", None),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)", None),
    ("phone", r"(?<![\w+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)", None),
    ("number", r"(?<![\w.])\d{9,12}(?![\w.])", None),
]
_compiled = [(kind, re.compile(p, re.DOTALL), marks) for kind, p, marks in PATTERNS]
_given, _title = "|".join(sorted(_first, key=len, reverse=True)), "|".join(TITLES)
_family = rf"{_WORD}+(?:-{_WORD}+)?"
_person = re.compile(rf"(?<!\w)(?:(?:(?:{_title})\.? )?(?P<first>{_given})(?!\w)(?: (?!(?:{_given})(?!\w))(?P<last>{_family}))?|(?:{_title})\.? (?P<alone>{_family}))")


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x00".join(map(str, parts)).encode(), "sha256"), "big")


def permute(key: bytes, kind: str, values: list[int], radices: list[int]) -> list[int]:
    """A keyed one-to-one map of mixed-radix numbers that maps none to itself.

    A number goes through a Feistel network on two halves, on by a step, and back through
    the network: as the step leaves no number where it is, nor does the whole. The step has
    no divisor in common with the count of numbers, so they are all on one cycle."""
    n = len(values)
    if n == 0:
        return values
    if n == 1:
        return [_order(key, kind, radices[0])[values[0]]]
    h = n // 2
    shape = ",".join(map(str, radices))
    sizes, step = _step(key, kind, shape)
    halves = [0, 0]
    for i, v in enumerate(values):
        halves[i >= h] = halves[i >= h] * radices[i] + v
    for k in range(ROUNDS):
        a, b = k % 2, 1 - k % 2
        halves[a] = (halves[a] + _number(key, kind, shape, k, halves[b])) % sizes[a]
    halves = list(divmod((halves[0] * sizes[1] + halves[1] + step) % (sizes[0] * sizes[1]), sizes[1]))
    for k in range(ROUNDS - 1, -1, -1):
        a, b = k % 2, 1 - k % 2
        halves[a] = (halves[a] - _number(key, kind, shape, k, halves[b])) % sizes[a]
    out = [0] * n
    for i in range(n - 1, -1, -1):
        side = i >= h
        halves[side], out[i] = divmod(halves[side], radices[i])
    return out


@lru_cache(maxsize=4096)
def _step(key: bytes, kind: str, shape: str) -> tuple[tuple[int, int], int]:
    """Sizes of the two halves of a shape, and the step."""
    radices = list(map(int, shape.split(",")))
    sizes = math.prod(radices[: len(radices) // 2]), math.prod(radices[len(radices) // 2 :])
    total = sizes[0] * sizes[1]
    step = 1 + _number(key, kind, shape, "step") % (total - 1)
    while math.gcd(step, total) > 1:
        step = step % (total - 1) + 1
    return sizes, step


@lru_cache(maxsize=4096)
def _order(key: bytes, kind: str, n: int) -> tuple[int, ...]:
    """A keyed cycle through 0..n-1: no number is mapped to itself if n > 1."""
    ring = sorted(range(n), key=lambda i: _number(key, kind, n, i))
    out = [0] * n
    for i, x in enumerate(ring):
        out[x] = ring[(i + 1) % n]
    return tuple(out)


def _letters(key: bytes, kind: str, text: str, alphabets) -> str:
    """text with the characters that have an alphabet permuted; case stays."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    at = [i for i, c in enumerate(low) if alphabets(c)]
    sets = [alphabets(low[i]) for i in at]
    values = [s.index(low[i]) for i, s in zip(at, sets, strict=True)]
    sizes = [len(s) for s in sets]
    if len(at) <= CHUNK:
        values = permute(key, kind, values, sizes)
    else:  # long ones in pieces, each by a map of its own
        values = [v for i in range(0, len(at), CHUNK) for v in permute(key, f"{kind} {i}", values[i : i + CHUNK], sizes[i : i + CHUNK])]
    out = list(text)
    for i, v, s in zip(at, values, sets, strict=True):
        out[i] = s[v].upper() if text[i].isupper() else s[v]
    return "".join(out)


_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_digit = lambda c: _DIGITS if c in _DIGITS else ""
_hex = lambda c: _HEX if c in _HEX else ""
_any = lambda c: _DIGITS if c in _DIGITS else _ALPHA.get(c, "")
_is_hex = re.compile(r"[0-9a-fA-F:]+").fullmatch
_sound = lambda c: _set_of.get(c, "")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's check digits are right."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def surrogate(kind: str, value: str, key: bytes = KEY) -> str:
    """The replacement of a value; one of the same kind and format."""
    if kind == "email":
        body, _, top = value.rpartition(".")
        return _letters(key, kind, body, _any) + "." + top
    if kind in ("secret", "private_key", "mac"):
        if _is_hex(value):
            made = _letters(key, kind, value, _hex)
            return made.upper() if value.upper() == value else made
        if kind == "private_key":
            head, tail = value.index("-----", 5) + 5, value.rindex("-----END")
            return value[:head] + _letters(key, kind, value[head:tail], _any) + value[tail:]
        made = _letters(key, kind, value, _any)
        while _is_hex(made):  # walks on, as those are surrogates of hexadecimal values
            made = _letters(key, kind, made, _any)
        return made
    if kind == "ip":
        octets = value.split(".")
        low, radix = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
        start = [int(x) - low[len(x)] for x in octets]
        made = permute(key, kind, start, [radix[len(x)] for x in octets])
        return ".".join(str(v + low[len(x)]) for v, x in zip(made, octets, strict=True))
    if kind == "iban":
        made, valid = value, mod97(value)
        while True:  # on along the cycle to one that is as valid
            made = value[:2] + _letters(key, kind, made[2:], _any)
            if mod97(made) == valid:
                return made
    # numbers: the last ten digits of a phone, all of others; separators stay
    at = [i for i, c in enumerate(value) if c in _DIGITS]
    digits = "".join(value[i] for i in at)
    fixed = max(0, len(digits) - 10) if kind == "phone" else 0
    valid = kind == "card" and luhn(digits)
    made = digits
    while True:  # a walk along the permutation's cycle stays one-to-one
        made = made[:fixed] + "".join(map(str, permute(key, kind, [int(c) for c in made[fixed:]], [10] * (len(made) - fixed))))
        if kind != "card" or luhn(made) == valid:  # so one that is not valid never meets one that is
            break
    out = list(value)
    for i, c in zip(at, made, strict=True):
        out[i] = c
    return "".join(out)


def first_name(name: str, key: bytes = KEY) -> str:
    at = _first[name]
    return NAMES[at][_order(key, f"first {at}", len(NAMES[at]))[NAMES[at].index(name)]]


#: Ends of Russian surnames that tell the gender: women's, men's.
_ENDINGS = {3: {"ова", "ева", "ёва", "ина", "ына", "кая"}, 2: {"ов", "ев", "ёв", "ин", "ын", "ий", "ой"}}


def _ending(name: str) -> int:
    """Letters at the end that stay."""
    return next((n for n, ends in _ENDINGS.items() if len(name) > n + 1 and name[-n:].lower() in ends), 0)


def last_name(name: str, key: bytes = KEY) -> str:
    n = _ending(name)
    if n:
        return _letters(key, f"last {name[-n:].lower()}", name[:-n], _sound) + name[-n:]
    made = _letters(key, "last", name, _sound)
    while _ending(made):  # walks on, as those are surrogates of names with such an end
        made = _letters(key, "last", made, _sound)
    return made


def entities(text: str, key: bytes = KEY) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, surrogate) of the entities of a text, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []  # of what is taken, in order, and
    ends: list[int] = []

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or ends[k - 1] <= start

    def add(start: int, end: int, kind: str, value: str, make) -> None:
        if free(start, end):
            k = bisect_left(starts, start)
            starts.insert(k, start)
            ends.insert(k, end)
            found.append((start, end, kind, make(value)))

    has_digit = any(d in text for d in _DIGITS)
    for kind, pattern, marks in _compiled:
        if not has_digit if marks is None else not any(x in text for x in marks):
            continue
        for m in pattern.finditer(text):
            g = "value" if "value" in pattern.groupindex else 0
            add(m.start(g), m.end(g), kind, m[g], lambda v, kind=kind: surrogate(kind, v, key))
    if not _starts.isdisjoint(_parts(text)):  # what _person begins with is a whole part
        for m in _person.finditer(text):
            for g in ("last", "alone"):
                if m[g] and m[g][0].isupper():
                    add(m.start(g), m.end(g), "last_name", m[g], lambda v: last_name(v, key))
            if m["first"]:
                add(m.start("first"), m.end("first"), "first_name", m["first"], lambda v: first_name(v, key))
    return sorted(found)


def replace(text: str | None, key: bytes = KEY) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    if not text:
        return text, []
    found = entities(text, key)
    out, at = [], 0
    for start, end, _, made in found:
        out += [text[at:start], made]
        at = end
    return "".join([*out, text[at:]]) if found else text, found


def pseudonymise(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced, and n_entities and kinds (their sorted kinds, repeated); columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    names = ["text", "n_entities", "kinds"]

    def run(texts):
        import pyarrow as pa

        done = [replace(t.as_py(), key) for t in texts]
        columns = [pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int32()), pa.array([",".join(sorted(x[2] for x in f)) for _, f in done], pa.string())]
        return pa.StructArray.from_arrays(columns, names)

    (made,) = fresh(docs.columns, "_made")
    rest = [F.col(c) for c in docs.columns if c != text_col and c.lower() not in names[1:]]
    out = docs.withColumn(made, F.arrow_udf(run, "text string, n_entities int, kinds string")(F.col(text_col).cast("string")))
    return out.select(*rest, F.col(made)["text"].alias(text_col), F.col(made)["n_entities"].alias("n_entities"), F.col(made)["kinds"].alias("kinds"))


def _digest(key: bytes, kind: str, value: str) -> bytes:
    """Stands for a value in tables that are written."""
    return hmac.digest(key, f"digest\x00{kind}\x00{value.lower()}".encode(), "sha256")[:16]


def entity_table(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """kind, and digests of original and surrogate (letter case apart), of every entity; those of a batch once."""

    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {(kind, t[s:e].lower(), made.lower()) for x in batch.column(0) if (t := x.as_py()) for s, e, kind, made in entities(t, key)}
            columns = [[k for k, _, _ in rows], [_digest(key, k, a) for k, a, _ in rows], [_digest(key, k, b) for k, _, b in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["kind", "original", "surrogate"])

    return docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(releasing(run), "kind string, original binary, surrogate binary")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates of ``entity_table`` that stand for several originals, and originals with several surrogates; none is right."""
    pairs = found.select("kind", "original", "surrogate").distinct()
    merged = pairs.groupBy("kind", F.col("surrogate").alias("value")).count().filter("count > 1").withColumn("fault", F.lit("merged"))
    split = pairs.groupBy("kind", F.col("original").alias("value")).count().filter("count > 1").withColumn("fault", F.lit("split"))
    return merged.unionByName(split)


def checked(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """``pseudonymise``, after ``collisions`` has found none over all entities; raises if there are any."""
    faults = {r["fault"]: r["n"] for r in collisions(entity_table(docs, key, text_col)).groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()}
    if faults:
        raise ValueError(f"surrogates are not one-to-one: {faults}")
    return pseudonymise(docs, key, text_col)


def op5_pii(spark, sf_dir):
    return checked(table(spark, sf_dir, "documents").select("doc_id", "text"))
