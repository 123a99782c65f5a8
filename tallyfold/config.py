"""Dates, windows and column names; everything that a run may vary is a field."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

#: The columns of the daily activity table.
USER, DAY = "user_id", "event_date"
FLAGS = ("search", "cat", "has_search_to_cart", "has_search_to_ord", "has_cat_to_cart", "has_cat_to_ord")
COUNTS = ("search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord", "to_cart", "to_ord", "searches")
MONEY = ("gmv_search", "gmv_cat", "gmv")
SUMMED = COUNTS + MONEY
#: Lookback windows, windows of decayed sums, pairs of windows that are compared, all in days.
LOOKBACKS = (7, 14, 30, 60, 90, 180, 365)
DECAYS = (7, 14, 30, 60, 90)
PAIRS = ((7, 30), (14, 30), (30, 60), (30, 90), (60, 180), (90, 365))


def as_date(value: date | str) -> date:
    """A date from a date, a timestamp or ISO text."""
    if isinstance(value, str):
        return date.fromisoformat(value[:10])
    return value.date() if hasattr(value, "date") else value


@dataclass(frozen=True)
class Calendar:
    """History, the period to forecast, and how folds step back from the end of history."""

    hist_start: date = date(2025, 1, 1)
    hist_end: date = date(2026, 2, 13)
    target_days: int = 30
    n_folds: int = 6
    step_days: int | None = None

    @property
    def step(self) -> int:
        step = self.target_days if self.step_days is None else self.step_days
        if step < self.target_days:
            raise ValueError(f"step_days={step} is less than the target length {self.target_days}: targets would overlap")
        return step

    @property
    def kept_folds(self) -> int:
        """Folds whose cutoff is not before the start of history."""
        room = (self.hist_end - timedelta(days=self.target_days) - self.hist_start).days
        return max(0, min(self.n_folds, room // self.step + 1)) if room >= 0 else 0

    def with_dates(self, hist_start: date | str, hist_end: date | str) -> Calendar:
        return replace(self, hist_start=as_date(hist_start), hist_end=as_date(hist_end))


#: Calendars of the two fixtures that the driver's tables give.
ORDERS = Calendar(date(1992, 1, 1), date(2001, 8, 1))
EVENTS = Calendar(date(2024, 1, 1), date(2024, 1, 30), target_days=7, n_folds=3)
