"""Calendar boundaries of a report, in epoch milliseconds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo


@dataclass(frozen=True)
class Boundaries:
    """Starts of the day, its (Sunday) week, month and year, and the end of the day, for one date and zone."""

    today: int
    tomorrow: int
    week: int
    month: int
    year: int

    @classmethod
    def of(cls, as_of: date, zone: str = "UTC") -> Boundaries:
        def start(day: date) -> int:
            # the first instant of the day: where midnight is skipped, the earliest time that exists
            local = datetime.combine(day, time.min, ZoneInfo(zone))
            return round(local.timestamp() * 1000)

        week = as_of - timedelta(days=(as_of.weekday() + 1) % 7)
        return cls(start(as_of), start(as_of + timedelta(days=1)), start(week), start(as_of.replace(day=1)), start(as_of.replace(month=1, day=1)))
