"""Match types as data: what to search with, what to score, when to accept."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import text

# Threshold of a match type that names none, candidates, and their cutoff.
FALLBACK_THRESHOLD = 80.0
CANDIDATES = 10  # rows that are rescored per input row
CUTOFF_SHARE = 0.8  # of the threshold a candidate must reach to be rescored


@dataclass(frozen=True)
class MatchSpec:
    """A match type.

    ``search`` names the standard columns joined into the search string,
    ``parts`` the scores averaged into the final score (``first``, ``last``,
    ``address``); a zero part makes the final score zero.
    """

    name: str
    search: tuple[str, ...]
    parts: tuple[str, ...]
    threshold: float = FALLBACK_THRESHOLD

    def search_string(self) -> str:
        joined = f"concat_ws(' ', {', '.join(self.search)})"
        return text.strip(joined) if len(self.search) > 1 else self.search[0]


# The three match types and their thresholds.
FULL_NAME = MatchSpec("FullName", ("First_Name", "Last_Name"), ("first", "last"), 85.0)
LAST_NAME_ADDRESS = MatchSpec("LastNameAddress", ("Last_Name", "FullAddress"), ("last", "address"), 75.0)
FULL_ADDRESS = MatchSpec("FullAddress", ("FullAddress",), ("address",), 80.0)
SPECS = {s.name: s for s in (FULL_NAME, LAST_NAME_ADDRESS, FULL_ADDRESS)}


def spec_of(match_type: str | MatchSpec) -> MatchSpec:
    if isinstance(match_type, MatchSpec):
        return match_type
    if match_type not in SPECS:
        raise ValueError(f"Unknown match_type: {match_type}")
    return SPECS[match_type]
