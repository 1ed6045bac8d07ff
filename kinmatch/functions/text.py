"""Text columns: stripping, token lists, name and address parts.

Every function takes SQL expressions and gives one back, for ``selectExpr`` or
``F.expr``.
"""

from __future__ import annotations

import unicodedata

# Decimal digits of all scripts but the ASCII ones, and their values.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

# Unit words that may name a part of a building.
UNIT_WORDS = (
    "APT", "APARTMENT", "UNIT", "TRLR", "TRAILER", "LOT", "BLDG", "BUILDING", "STE", "SUITE",
    "FLOOR", "FL", "RM", "ROOM", "SPACE", "SPC", "#",
)
# Street abbreviations used when two addresses are scored, in order.
MATCH_ABBREVIATIONS = (
    (" STREET", " ST"), (" ROAD", " RD"), (" AVENUE", " AVE"), (" LANE", " LN"),
    (" DRIVE", " DR"), (" COURT", " CT"), (" PLACE", " PL"),
)
# Street abbreviations used by the audit, replaced anywhere.
AUDIT_ABBREVIATIONS = (("ROAD", "RD"), ("STREET", "ST"), ("AVENUE", "AVE"), ("LANE", "LN"))

_WORDS = "|".join(UNIT_WORDS)
# The four unit patterns that are compared side by side, as
# (pattern, group of the type or 0 if it has none, group of the number).
UNIT_PATTERNS = {
    "loose": (rf"(?iU)(?:{_WORDS})\s*([A-Z0-9]+)", 0, 1),
    "word_boundary": (rf"(?iU)\b(?:{_WORDS})\s*([A-Z0-9]+)", 0, 1),
    "blank_before": (rf"(?iU)\s(?:{_WORDS})\s*([A-Z0-9]+)", 0, 1),
    "blank_both_sides": (rf"(?iU)\s({_WORDS})\s+([A-Z0-9]+)", 1, 2),
}
UNIT_PATTERN = UNIT_PATTERNS["blank_both_sides"][0]


def literal(value: str) -> str:
    """A text as an SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def strip(c: str) -> str:
    """Remove white space, Unicode included, from both ends (``trim`` only removes blanks)."""
    return rf"regexp_replace({c}, r'(?U)^\s+|\s+$', '')"


def fold(c: str) -> str:
    """Null to empty, upper case, stripped."""
    return strip(f"upper(coalesce(CAST({c} AS STRING), ''))")


def words(c: str) -> str:
    """Array of the white-space tokens."""
    return rf"array_remove(split({c}, r'(?U)\s+'), '')"


def token_key(c: str) -> str:
    """Sorted distinct tokens joined by blanks: equal keys have equal token-set scores."""
    return f"array_join(array_sort(array_distinct({words(c)})), ' ')"


def sorted_tokens(c: str) -> str:
    """All white-space tokens, repeats included, sorted and joined."""
    return f"array_join(array_sort({words(c)}), ' ')"


def replace_all(c: str, pairs) -> str:
    for old, new in pairs:
        c = f"replace({c}, '{old}', '{new}')"
    return c


# --- address parts -------------------------------------------------------


def house_digits(address: str) -> str:
    """Leading digits without leading zeros; null if the address does not start with a digit."""
    digits = rf"regexp_extract({strip(address)}, r'(?U)^(\d+)', 1)"
    plain = f"translate({digits}, '{_DIGITS}', '{_VALUES}')"
    return f"nullif(regexp_replace({plain}, r'^0+(?=[0-9])', ''), '')"


def house_number(address: str) -> str:
    return f"try_cast({house_digits(address)} AS DECIMAL(38, 0))"


def street_name(address: str) -> str:
    """Text between the house number and the first comma."""
    return strip(rf"substring_index(regexp_replace({strip(address)}, r'(?U)^\d+\s*', ''), ',', 1)")


def unit_type(address: str) -> str:
    return f"upper(regexp_extract({address}, r'{UNIT_PATTERN}', 1))"


def unit_number(address: str) -> str:
    return f"upper(regexp_extract({address}, r'{UNIT_PATTERN}', 2))"


def unit(address: str) -> str:
    """Type and number as one text, '' if the address names no unit."""
    return rf"upper(regexp_replace(regexp_extract({address}, r'{UNIT_PATTERN}', 0), r'(?U)\s+', ' '))"


def unit_label(address: str) -> str:
    """Type and number as written, '' if the address names no unit."""
    parts = (f"regexp_extract({address}, r'{UNIT_PATTERN}', {i})" for i in (1, 2))
    return f"trim(concat_ws(' ', {', '.join(parts)}))"


def third_last_piece(address: str) -> str:
    """Third comma piece from the end; in ``STREET, CITY, ST ZIP`` this is the street line."""
    return f"coalesce({strip(f'try_element_at(split({address}, chr(44)), -3)')}, '')"


def city_piece(address: str) -> str:
    """Second comma piece from the end: the city in ``STREET, CITY, ST ZIP``."""
    return f"coalesce({strip(f'try_element_at(split({address}, chr(44)), -2)')}, '')"


# --- name parts ----------------------------------------------------------


def display_name(first: str, last: str) -> str:
    return strip(f"concat({first}, ' ', {last})")


def first_word(name: str) -> str:
    return rf"coalesce(try_element_at(split({strip(name)}, r'(?U)\s+'), 1), '')"


def last_word(name: str) -> str:
    return rf"coalesce(try_element_at(split({strip(name)}, r'(?U)\s+'), -1), '')"
