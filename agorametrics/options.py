"""Options of the reactions-per-message report, given as words."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from agorametrics import fixed_values as fixed


@dataclass(frozen=True)
class RpmOptions:
    leaderboard: bool = False
    least: bool = False
    all_users: bool = False


def parse_rpm_options(words: Iterable[str]) -> RpmOptions:
    """Flags may come in any order; words that are no known flag change nothing."""
    given = set(words)
    return RpmOptions(
        leaderboard=fixed.FLAG_LEADERBOARD in given,
        least=fixed.FLAG_LEAST in given,
        all_users=fixed.FLAG_ALL in given,
    )
