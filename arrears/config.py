"""Fixed business values and run parameters.

Every rule threshold used by the plans lives here so that a plan never
hard-codes a number. ``as_of`` replaces the wall clock everywhere.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# --- Fixed values (must equal the source system's rules) -------------------
ROLLING_DAYS = 60                      # dialer / contact look-back window
MATCH_TOLERANCE_MINUTES = 15           # contact <-> call matching window
ANSWERED_MIN_BILLSEC = 0               # answered: billsec > 0
NOT_CONNECTED_MIN_BILLSEC = 3          # no operator: billsec > 3 and no sip
CPC_MIN_BILLSEC = 40                   # cpc: billsec >= 40 and sip present
OPERATOR_MIN_SIP = 200                 # operator: sip >= 200
PROVIDER_ATTRIBUTE_TYPE = 303          # case attribute holding the provider
TRAINING_DAYS = 2                      # calendar days of training after hire
EXCLUDED_LOGINS = ("system_user", "auto_process")
CC_TARGET_TYPES = (1, 2, 5, 6)         # contact targets counted as activity
CPC_TARGET_TYPES = (1, 2)
RPC_TARGET_TYPE = 1
RPC_STATUS_TYPES = (2, 300, 118, 119, 120)
CLOSED_PTP_STATES = ("Expired", "Canceled")
HIGH_DPD = 180
SOURCE_UTC_OFFSET_HOURS = -3           # "today" of the source system
# ---------------------------------------------------------------------------

QUALITY_WEIGHTS = (0.5, 0.5)           # composite score (not given by the source)

@dataclass(frozen=True)
class Params:
    """Run parameters; every plan takes one. ``as_of`` stands for today and
    must be given (``Params.today()`` takes the source's clock, UTC-3); the
    other defaults match the rules."""

    as_of: dt.date
    # First day of the attendance calendar; None: 1 January of as_of's year.
    calendar_start: dt.date | None = None
    rolling_days: int = ROLLING_DAYS
    tolerance_minutes: int = MATCH_TOLERANCE_MINUTES
    # Width (minutes) of the time buckets the as-of match is split into.
    # Any width is exact; narrower splits a dense key over more tasks at the
    # cost of more copies of the call side (2 * tolerance / width + 1).
    match_bucket_minutes: int = 60
    # How the provider (attribute 303) is attached to a case:
    #   "max"  - one value per case (keeps the one-row-per-case grain)
    #   "join" - plain join, one row per attribute row (source behaviour)
    provider_mode: str = "max"
    # Operator flag for a missing / non-numeric sip: source code says "Yes"
    # (an error replaced by "Yes"); the documented rule would say "No".
    strict_sip: bool = False
    # "Inactive" attendance: the source code uses the leaving date only; the
    # documentation also requires user_status <> 1.
    require_inactive_status: bool = False
    # OLD money: "prev_month" = an earlier payment since the first day of the
    # previous month (source code); "30d" = within the 30 days before
    # (documentation).
    old_money_window: str = "prev_month"
    quality_weights: tuple[float, float] = QUALITY_WEIGHTS

    def __post_init__(self):
        if self.calendar_start is None:
            object.__setattr__(self, "calendar_start", dt.date(self.as_of.year, 1, 1))

    @classmethod
    def today(cls, utc_offset_hours: int = SOURCE_UTC_OFFSET_HOURS, **kw) -> "Params":
        """Parameters as of the present day in the source's zone."""
        zone = dt.timezone(dt.timedelta(hours=utc_offset_hours))
        return cls(as_of=dt.datetime.now(zone).date(), **kw)

    def with_(self, **kw) -> "Params":
        d = {k: getattr(self, k) for k in self.__dataclass_fields__}
        d.update(kw)
        return Params(**d)
