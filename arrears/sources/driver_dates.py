"""As-of dates for the driver's synthetic tables: event relations cover
January 2024, order relations end in mid 2001. Real sources pass their own
``Params``."""

from __future__ import annotations

import datetime as dt

from arrears.config import Params

EVENTS_AS_OF = dt.date(2024, 1, 31)
ORDERS_AS_OF = dt.date(2001, 7, 15)
# First day of the attendance calendar / activity window for event data.
EVENTS_CALENDAR_START = dt.date(2024, 1, 1)


def events_params(**kw) -> Params:
    return Params(as_of=EVENTS_AS_OF, calendar_start=EVENTS_CALENDAR_START).with_(**kw)


def orders_params(**kw) -> Params:
    return Params(as_of=ORDERS_AS_OF, calendar_start=dt.date(ORDERS_AS_OF.year - 1, 1, 1)).with_(**kw)
