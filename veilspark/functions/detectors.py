"""Personal-data detectors as Column expressions, and their registry.

A detector takes a string column and gives a boolean one. Detectors over a dictionary
and the whole-column age test are evaluated by the jobs in ``operators.labels``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of Hungarian identifiers and of network and mail addresses.
TAX_FORMAT = r"\A8[0-9]{9}\z"
TAJ_FORMAT = r"\A[0-9]{9}\z"
PERSONAL_FORMAT = r"\A[1-8][0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{4}\z"
PHONE_FORMAT = r"(?d)^(?:\+?3|0)6[-( ]?[0-9]{1,2}[-) ]?[0-9]{3}[- ]?[0-9]{3,4}$"
# Plates: ordinary and custom ones first, then those of special vehicles.
PLATE_FORMATS = (
    "[a-z]{3}[- ]?[0-9]{3}",
    "m[- ]?[0-9]{6}",
    "[a-z]{4}[- ]?[0-9][- ]?[0-9]",
    "[a-z]{5}[- ]?[0-9]",
    "s[- ]?[a-z]{3}[- ]?[0-9]{3}",
    "sp[- ]?[0-9]{2}[- ]?[0-9]{2}",
    "ot[- ]?[0-9]{2}[- ]?[0-9]{2}",
    "[epvz][- ]?[0-9]{5}",
    "c[- ]?[cx][- ]?[0-9]{2}[- ]?[0-9]{2}",
    "x[- ]?[abc][- ]?[0-9]{2}[- ]?[0-9]{2}",
)
PLATE_FORMAT = "(?d)^(?:" + "|".join(PLATE_FORMATS) + ")$"
MAC_FORMAT = (
    "(?d)^(?:(?:[0-9A-Fa-f]{2}[-:. ]){5}[0-9A-Fa-f]{2}"
    "|(?:[0-9A-Fa-f]{4}[:. ]){2}[0-9A-Fa-f]{4}$)"
)
EMAIL_FORMAT = r"(?d)^.+@.+\..+$"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
AGE_COLUMN_NAMES = ("age", "kor", "eletkor")
AGE_LIMIT = 130


def _ipv6_format() -> str:
    """All placements of one ``::`` among at most eight groups."""
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{1,7}}:", f":(?:(?::{group}){{1,7}}|:)"]
    forms += [f"(?:{group}:){{1,{7 - n}}}(?::{group}){{1,{n}}}" for n in range(1, 7)]
    return r"\A(?:" + "|".join(forms) + r")\z"


def _digit(v: Column, position: int) -> Column:
    """Digit at a 1-based position; only meaningful after the format test."""
    return F.ascii(F.substring(v, position, 1)) - F.lit(48)


def _weighted_digits(v: Column, weights) -> Column:
    total = F.lit(0)
    for position, weight in enumerate(weights, start=1):
        total = total + _digit(v, position) * F.lit(weight)
    return total


def _sized(v: Column, low: int, high: int, test: Column) -> Column:
    """Run a test only on values of a possible size in bytes, which costs nothing to know."""
    return F.when(F.octet_length(v).between(low, high), test).otherwise(False)


def _checked(v: Column, digits: int, pattern: str, checksum: Column, check_digit: Column) -> Column:
    held = F.when(v.rlike(pattern), checksum == check_digit).otherwise(False)
    return _sized(v, digits, digits, held)


def tax_number(v: Column) -> Column:
    return _checked(v, 10, TAX_FORMAT, _weighted_digits(v, range(1, 10)) % 11, _digit(v, 10))


def taj_number(v: Column) -> Column:
    return _checked(v, 9, TAJ_FORMAT, _weighted_digits(v, (3, 7) * 4) % 10, _digit(v, 9))


def personal_number(v: Column) -> Column:
    """The two-digit birth year alone decides the direction of the weights."""
    year = _digit(v, 2) * 10 + _digit(v, 3)
    total = F.when(year > 96, _weighted_digits(v, range(10, 0, -1))).otherwise(
        _weighted_digits(v, range(1, 11))
    )
    return _checked(v, 11, PERSONAL_FORMAT, total % 11, _digit(v, 11))


def phone_number(v: Column) -> Column:
    return _sized(v, 8, 16, v.rlike(PHONE_FORMAT))


def licence_plate(v: Column) -> Column:
    return _sized(v, 6, 32, F.lower(v).rlike(PLATE_FORMAT))


def ip_address(v: Column) -> Column:
    """IPv4 or IPv6 without prefix length or scope; an IPv6 tail may be dotted."""
    widened = F.regexp_replace(v, rf"(?<=:){IPV4}\z", "0:0")
    full = F.when(v.contains(":"), widened.rlike(_ipv6_format())).otherwise(v.rlike(rf"\A{IPV4}\z"))
    return _sized(v, 2, 45, full)


def mac_address(v: Column) -> Column:
    """Six pairs may be followed by other text; three quads must end the value."""
    return v.rlike(MAC_FORMAT)


def email_address(v: Column) -> Column:
    return F.when(v.contains("@"), v.rlike(EMAIL_FORMAT)).otherwise(False)


@dataclass(frozen=True)
class Detector:
    """``test`` is set for per-value detectors. ``dictionary`` names the term list of the
    others, ``contains`` asks for any term inside the value rather than equality, and
    ``fold`` compares without accents. Neither set: the whole-column age test."""

    label: str
    identifier: bool | None = None
    test: Callable[[Column], Column] | None = None
    dictionary: str | None = None
    contains: bool = False
    fold: bool = False


DETECTORS: dict[str, Detector] = {
    d.label: d
    for d in (
        Detector("tax number hungarian", True, tax_number),
        Detector("phone number hungarian", True, phone_number),
        Detector("licence plate hungarian", True, licence_plate),
        Detector("taj number hungarian", True, taj_number),
        Detector("personal number hungarian", True, personal_number),
        Detector("hungarian first name", dictionary="names", contains=True, fold=True),
        Detector("disease name", dictionary="diseases"),
        Detector("disease name hungarian", dictionary="diseases_hu", fold=True),
        Detector("ip address", None, ip_address),
        Detector("mac address", None, mac_address),
        Detector("email address", True, email_address),
        Detector("country or region", dictionary="countries"),
        Detector("human age"),
    )
}


def register_detector(
    label: str, test: Callable[[Column], Column], identifier: bool | None = None
) -> None:
    """Add a per-value detector; it runs after the built-in ones."""
    DETECTORS[label] = Detector(label, identifier, test)


def containment_pattern(terms: list[str]) -> str:
    """A regular expression that finds any of the terms.

    Terms share their prefixes, and a term that starts with another one is dropped, as
    the shorter one already matches.
    """
    tree: dict = {}
    for term in sorted(set(terms), key=len):
        node, covered = tree, False
        for letter in term:
            node = node.setdefault(letter, {})
            if node.get("") is True:
                covered = True
                break
        if not covered:
            node.clear()
            node[""] = True

    def render(node: dict) -> str:
        if node.get("") is True:
            return ""
        parts = [_literal(c) + render(child) for c, child in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return render(tree) if tree else "(?!)"


def _literal(letter: str) -> str:
    return letter if letter.isalnum() or letter.isspace() else "\\" + letter
