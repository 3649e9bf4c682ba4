"""When a task fires next: daily, weekly, or on the last day of a quarter. Pure functions of their input."""

from __future__ import annotations

import datetime as dt


def parse_hhmm(s: str) -> tuple[int, int]:
    h, _, m = s.strip().partition(":")
    if not (h.isdigit() and m.isdigit() and int(h) < 24 and int(m) < 60):
        raise ValueError(f"not a time of day: {s!r}")
    return int(h), int(m)


def problems(task: dict) -> list[str]:
    out = []
    if task.get("schedule") not in ("daily", "weekly", "quarterly"):
        out.append("schedule must be daily, weekly or quarterly")
    if not 0 <= int(task.get("hour", 0)) < 24 or not 0 <= int(task.get("minute", 0)) < 60:
        out.append("hour or minute out of range")
    if task.get("schedule") == "weekly" and not 0 <= int(task.get("dayOfWeek", 0)) <= 6:
        out.append("dayOfWeek must be 0 (Sunday) to 6")
    return out


def _due(task: dict, day: dt.date) -> bool:
    if task["schedule"] == "weekly":
        return day.isoweekday() % 7 == int(task.get("dayOfWeek", 0))
    if task["schedule"] == "quarterly":
        after = day + dt.timedelta(days=1)
        return after.day == 1 and after.month in (1, 4, 7, 10)
    return True


def next_run(task: dict, now: dt.datetime) -> dt.datetime | None:
    """The first due time after now; None if the task is off."""
    if not task.get("enabled", True):
        return None
    at = dt.time(int(task.get("hour", 0)), int(task.get("minute", 0)))
    day = now.date()
    while True:
        if _due(task, day) and dt.datetime.combine(day, at) > now:
            return dt.datetime.combine(day, at)
        day += dt.timedelta(days=1)
