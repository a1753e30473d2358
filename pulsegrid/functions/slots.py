"""Fixed-width time slots.

A slot id is integer arithmetic on the timestamp, and every calendar field is
integer and date arithmetic on the slot id, so neither direction needs a join.
Methods take and return Spark SQL expressions as text, ready for
``selectExpr`` or ``F.expr``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

CALENDAR_FIELDS = (
    "month", "year", "week", "day", "day_of_week", "time_of_day_code", "hour", "minute",
)


@dataclass(frozen=True)
class SlotSpec:
    """``count`` half-open slots of ``width_seconds`` from midnight ``origin``."""

    origin: date
    count: int
    width_seconds: int = 600

    def __post_init__(self) -> None:
        if self.width_seconds < 1 or 86400 % self.width_seconds:
            raise ValueError("the slot width must divide a day")

    @classmethod
    def between(cls, start: date, stop: date, width_seconds: int = 600) -> "SlotSpec":
        """All slots from midnight ``start`` to midnight ``stop`` (exclusive)."""
        return cls(start, (stop - start).days * (86400 // width_seconds), width_seconds)

    def resized(self, width_seconds: int) -> "SlotSpec":
        """The same whole days in slots of another width."""
        return SlotSpec(self.origin, self.days * (86400 // width_seconds), width_seconds)

    @property
    def per_day(self) -> int:
        return 86400 // self.width_seconds

    @property
    def per_hour(self) -> int:
        return 3600 // self.width_seconds

    @property
    def days(self) -> int:
        return -(-self.count // self.per_day)

    def first_slot_of(self, day: date) -> int:
        return (day - self.origin).days * self.per_day

    def first_slot_of_week(self, day: date) -> int:
        """The first slot of the ISO week that holds ``day``."""
        return self.first_slot_of(day - timedelta(days=day.weekday()))

    @property
    def _origin(self) -> str:
        return f"TIMESTAMP_NTZ '{self.origin.isoformat()} 00:00:00'"

    def slot_of(self, ts: str, strict: bool = False) -> str:
        """Slot id of a timestamp; NULL stays NULL, ids are not clamped.

        Truncates toward zero, so the last slot before the origin is also 0.
        ``strict`` floors instead.
        """
        between = f"{self._origin}, CAST({ts} AS TIMESTAMP_NTZ)"
        if strict:
            micros = f"timestampdiff(MICROSECOND, {between})"
            return f"CAST(floor({micros} / {self.width_seconds * 1_000_000}) AS INT)"
        if self.width_seconds % 60:
            return f"CAST(timestampdiff(SECOND, {between}) div {self.width_seconds} AS INT)"
        # one subtraction and its parts, which is cheaper than timestampdiff
        since = f"(CAST({ts} AS TIMESTAMP_NTZ) - {self._origin})"
        minutes = (
            f"extract(DAY FROM {since}) * 1440L + extract(HOUR FROM {since}) * 60"
            f" + extract(MINUTE FROM {since})"
        )
        return f"CAST(({minutes}) div {self.width_seconds // 60} AS INT)"

    def start_of(self, slot: str) -> str:
        return f"timestampadd(SECOND, ({slot}) * {self.width_seconds}, {self._origin})"

    def end_of(self, slot: str) -> str:
        return self.start_of(f"{slot} + 1")

    def inside(self, slot: str = "slot_id") -> str:
        return f"{slot} BETWEEN 0 AND {self.count - 1}"

    def day_index(self, slot: str = "slot_id") -> str:
        return f"CAST(floor({slot} / {self.per_day}) AS INT)"

    def date_of(self, slot: str = "slot_id") -> str:
        return f"date_add(DATE '{self.origin.isoformat()}', {self.day_index(slot)})"

    def time_of_day(self, slot: str = "slot_id") -> str:
        return f"CAST(pmod({slot}, {self.per_day}) AS INT)"

    def field(self, name: str, slot: str = "slot_id") -> str:
        """One of ``CALENDAR_FIELDS`` for a slot id.

        ``week`` is the ISO week, ``year`` the year it counts in, ``day_of_week`` starts at 0 = Monday.
        """
        seconds = f"{self.time_of_day(slot)} * {self.width_seconds}"
        first = self.origin.weekday()
        return {
            "month": f"month({self.date_of(slot)})",
            "year": f"extract(YEAROFWEEK FROM {self.date_of(slot)})",
            "week": f"weekofyear({self.date_of(slot)})",
            "day": f"dayofmonth({self.date_of(slot)})",
            "day_of_week": f"CAST(pmod({self.day_index(slot)} + {first}, 7) AS INT)",
            "time_of_day_code": self.time_of_day(slot),
            "hour": f"CAST({seconds} div 3600 AS INT)",
            "minute": f"CAST({seconds} % 3600 div 60 AS INT)",
        }[name]

    def fields(self, names=CALENDAR_FIELDS, slot: str = "slot_id") -> list[str]:
        """Named expressions of several calendar fields."""
        return [f"{self.field(name, slot)} AS {name}" for name in names]

    def weekday_days(self, first_slot: int, stop_slot: int) -> list[int]:
        """How many days of each weekday (Monday first) a slot range touches."""
        first, last = first_slot // self.per_day, (stop_slot - 1) // self.per_day
        counts = [0] * 7
        for i in range(first, last + 1):
            counts[(self.origin + timedelta(days=i)).weekday()] += 1
        return counts
