"""Panel description: which columns are keys, the period unit and its season."""

from __future__ import annotations

from dataclasses import dataclass

# Season length per frequency alias.
SEASON = {"D": 7, "ME": 12, "M": 12, "QE": 4, "Q": 4, "QS": 4}

# Columns of a panel that are never keys.
RESERVED = ("ts_id", "date", "total", "Year", "Period", "Amount")


def season_length(freq: str) -> int:
    if freq not in SEASON:
        raise ValueError(f"unknown frequency {freq!r}; use one of {sorted(SEASON)}")
    return SEASON[freq]


@dataclass(frozen=True)
class PanelSpec:
    """Static facts about a panel. `keys` never contains the dataset tag: it is in every level anyway."""

    name: str
    keys: tuple[str, ...]
    freq: str = "ME"
    date_col: str = "ds"
    target_col: str = "y"

    def __post_init__(self):
        season_length(self.freq)
        if not self.keys:
            raise ValueError("a panel needs at least one key column")

    @property
    def season(self) -> int:
        return season_length(self.freq)

    @property
    def leaf_level(self) -> int:
        return 0

    @property
    def top_level(self) -> int:
        return (1 << len(self.keys)) - 1
