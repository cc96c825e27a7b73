"""Text expressions: identifiers, check digits, labels, dates in names, time zones."""

import re
from bisect import bisect_right
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of identifiers, with score and whether the format validates it.
ENTITIES = [
    ("PAN", r"\b([A-Z]{5}[0-9]{4}[A-Z])\b", 0.97, True),
    ("VID", r"(?<!\d)(\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4})(?!\d)", 0.9, True),
    ("AADHAAR", r"(?<!\d)(\d{4}[\s\-]?\d{4}[\s\-]?\d{4})(?!\d)", 0.95, True),
    ("VOTER_ID", r"\b([A-Z]{3}[0-9]{7})\b", 0.85, True),
    ("DRIVING_LICENCE", r"\b([A-Z]{2}[\s\-]?\d{2}[\s\-]?\d{4}[\s\-]?\d{7})\b", 0.8, True),
    ("PHONE", r"(?<!\d)(?:\+91[\s\-]?|0)?([6-9]\d{9})(?!\d)", 0.8, True),
    ("EMAIL", r"\b([\w.+\-]+@[\w\-]+\.[\w.\-]+)\b", 0.9, True),
    ("DOB", r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})\b", 0.7, False),
    ("PINCODE", r"(?<!\d)([1-9]\d{5})(?!\d)", 0.4, False),
]
#: Scores of a twelve-digit number that fails its checksum, and of one read with letters as digits.
FAILED, MISREAD = 0.6, 0.85
#: Letters that are misread digits.
MISREADINGS = ("OoDQIl|iZzSsBGT", "000011112255867")
#: Document types in order, with the phrases that tell them.
DOCUMENTS = [
    ("AADHAAR", r"aadhaar|आधार|unique\s+identification|uidai"), ("PAN", r"permanent\s+account|income\s+tax"), ("PASSPORT", r"passport|passeport|republic\s+of\s+india|भारत\s+गणराज"),
    ("VOTER_ID", r"election\s+commission|electors?\s+photo|voter\s+id"), ("DRIVING_LICENCE", r"driving\s+licen[cs]e"), ("NATIONAL_ID", r"national\s+id"),
]


def _dihedral(a: int, b: int) -> int:
    """Product in the group of the pentagon's symmetries: 0-4 turns, 5-9 reflections."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
#: Fixed value: the check digit's permutation; position i applies it i times, eight times being none.
PERMUTATION = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
PERMUTED = [list(range(10))]
for _ in range(7):
    PERMUTED.append([PERMUTATION[x] for x in PERMUTED[-1]])
POWERS = [x for row in PERMUTED for x in row]


def verhoeff(number: str) -> bool:
    """Whether a string of digits passes the dihedral check."""
    check = 0
    for k, digit in enumerate(reversed(number)):
        if not digit.isdigit():
            return False
        check = PRODUCT[10 * check + POWERS[10 * (k % 8) + int(digit)]]
    return check == 0


def verhoeff_valid(number: Column) -> Column:
    """The same as an expression: a fold over the reversed digits; false where there is a character that is no digit."""
    table = lambda xs: F.array(*map(F.lit, xs))
    digits = F.transform(F.split(F.reverse(number), ""), lambda d: d.try_cast("int"))
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("i"))

    def step(acc, d):
        moved = F.element_at(table(POWERS), 10 * (acc["i"] % 8) + d + 1)
        return F.struct(F.element_at(table(PRODUCT), 10 * acc["c"] + moved + 1).alias("c"), (acc["i"] + 1).alias("i"))

    return F.when(number.rlike("^[0-9]+$"), F.aggregate(digits, start, step)["c"] == 0).otherwise(False)


def entity_counts(text: Column) -> dict[str, Column]:
    """Matches of each pattern, counted."""
    return {name: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).cast("long") for name, pattern, _, _ in ENTITIES}


class Rule(NamedTuple):
    """How one kind of identifier is read: in the text as it is or with misread letters repaired, and which earlier ones hide it."""

    label: str
    pattern: re.Pattern
    score: float
    validated: bool
    checked: bool = False
    repaired: bool = False
    hidden_by: tuple[str, ...] = ()


def _rules() -> list[Rule]:
    plain = [Rule(label, re.compile(pattern), score, sure, label == "AADHAAR", hidden_by=("VID",) if label == "AADHAAR" else ()) for label, pattern, score, sure in ENTITIES]
    number = next(r for r in plain if r.checked)
    return [*plain, number._replace(score=MISREAD, repaired=True, hidden_by=("VID", "AADHAAR"))]


RULES = _rules()
REPAIR = str.maketrans(*MISREADINGS)


def find_entities(text: str) -> list[tuple[str, str, int, int, float, bool]]:
    """(label, text, start, stop, score, validated) of all identifiers, by RULES in order.

    A checked number that starts with 0 or 1 is none, and one that fails its check digit scores FAILED. Spans of one label
    do not overlap and come in order, so a hiding one is found by bisection.
    """
    readings = (text, text.translate(REPAIR))
    spans: dict[str, list[tuple[int, int]]] = {}
    found = []
    for rule in RULES:
        hiding = [spans.get(label, []) for label in rule.hidden_by]
        mine = []
        for m in rule.pattern.finditer(readings[rule.repaired]):
            start, stop = m.span(1)
            score, good = rule.score, rule.validated
            if rule.checked:
                number = re.sub(r"\D", "", m[1])
                if number[0] in "01" or any(k and h[k - 1][1] >= stop for h in hiding for k in [bisect_right(h, (start, len(text)))]):
                    continue
                good = verhoeff(number)
                score = rule.score if good else FAILED
            mine.append((start, stop))
            found.append((rule.label, text[start:stop], start, stop, score, good))
        spans[rule.label] = sorted(spans.get(rule.label, []) + mine)
    return found


ENTITY_TYPE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("validated", T.BooleanType())]))


@F.pandas_udf(ENTITY_TYPE)
def _entities(texts: pd.Series) -> pd.Series:
    names = [f.name for f in ENTITY_TYPE.elementType.fields]
    return texts.map(lambda t: [dict(zip(names, e)) for e in find_entities(t or "")])


def entities(text: Column) -> Column:
    """Array of entities, by an Arrow UDF: offsets need the matcher itself."""
    return _entities(text)


def document_type(text: Column, entity_labels: Column | None = None) -> Column:
    """The first type whose phrase the text holds, else by its identifiers' labels, else UNKNOWN."""
    low, kind = F.lower(text), F.lit("UNKNOWN")
    if entity_labels is not None:
        for label, name in (("DRIVING_LICENCE", "DRIVING_LICENCE"), ("VOTER_ID", "VOTER_ID"), ("AADHAAR", "AADHAAR"), ("VID", "AADHAAR"), ("PAN", "PAN")):
            kind = F.when(F.array_contains(entity_labels, label), name).otherwise(kind)
    for name, pattern in reversed(DOCUMENTS):
        kind = F.when(low.rlike(pattern), name).otherwise(kind)
    return kind


def first_label(text: Column, labels: list[str], default: str) -> Column:
    """The label that comes first in the text, whatever its case."""
    low = F.lower(text)
    places = F.array_compact(F.array(*(F.when(F.instr(low, F.lit(x)) > 0, F.struct(F.instr(low, F.lit(x)).alias("p"), F.lit(k).alias("k"), F.lit(x).alias("l"))) for k, x in enumerate(labels))))
    return F.coalesce(F.array_min(places)["l"], F.lit(default))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def twelve_digits(text: Column) -> Column:
    """Whether the digits are twelve, the first of them not 0 or 1."""
    d = digits(text)
    return (F.length(d) == 12) & ~F.left(d, F.lit(1)).isin("0", "1")


def date_token(name: Column) -> Column:
    """The date of a name that holds 20YYMMDD."""
    return F.to_date(F.nullif(F.regexp_extract(name, "(20[0-9]{6})", 1), F.lit("")), "yyyyMMdd")


def zone(name: Column) -> Column:
    """utc+0530 or utc+5 as UTC offset +05:30, +05:00; other names as they are."""
    low = F.lower(F.trim(name))
    sign, hours, minutes = (F.regexp_extract(low, "^utc([+-])([0-9]{1,2}):?([0-9]{2})?$", k) for k in (1, 2, 3))
    return F.when(low.rlike("^utc[+-][0-9]{1,2}(:?[0-9]{2})?$"), F.concat(sign, F.lpad(hours, 2, "0"), F.lit(":"), F.when(minutes == "", "00").otherwise(minutes))).otherwise(F.trim(name))


def shared_label(parts: Column) -> Column:
    """none, the single part, or Shared: a + b."""
    return F.when(F.size(parts) == 0, "none").when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise(F.concat(F.lit("Shared: "), F.array_join(parts, " + ")))


def machine_readable(text: Column) -> Column:
    """Whether a line is of a travel document's machine-readable zone."""
    return F.regexp_replace(text, "\\s", "").rlike("^[A-Z0-9<]{30,44}$") & text.contains("<<")


def options(text: Column) -> Column:
    """Map of key=value pairs between commas."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def resolve_header(header: str, known: dict[str, str] | list[str], least: float = 0.8) -> tuple[str, str]:
    """(name, method) of a table header among a few known ones: exact without blanks and case, fuzzy from a similarity of ``least`` on, else fallback, a title.

    known: names, or full names to the short ones that are returned.
    """
    from difflib import SequenceMatcher

    bare = lambda s: re.sub(r"\s+", "", s).upper()
    names = {bare(k): v for k, v in (known if isinstance(known, dict) else {k: k for k in known}).items()}
    if bare(header) in names:
        return names[bare(header)], "exact"
    ratio, best = max(((SequenceMatcher(None, k, bare(header)).ratio(), k) for k in names), default=(0.0, ""))
    return (names[best], "fuzzy") if names and ratio >= least else (re.sub(r"\s+", " ", header.strip()).title(), "fallback")


def resolve_headers(header: Column, known: dict[str, str] | list[str], least: float = 0.8) -> Column:
    """resolve_header of each row as struct(name, method), by an Arrow UDF that resolves a batch's equal headers once; null for null."""

    @F.pandas_udf("name string, method string")
    def resolved(headers: pd.Series) -> pd.DataFrame:
        each = {h: resolve_header(h, known, least) for h in headers.dropna().unique()}
        return pd.DataFrame([each.get(h, (None, None)) for h in headers], columns=["name", "method"])

    return F.when(header.isNotNull(), resolved(header))
