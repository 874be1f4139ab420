"""Checks of the arguments of a query; each returns the argument in its canonical form or refuses it."""

from __future__ import annotations

import re

from ..errors import Refused

# The formats of codes.
FORMATS = {"period": r"\d{2,4}", "session": r"\d{4}", "meeting": r"\d{8}", "proposal_sn": r"\d+", "record_id": r"\d{1,20}"}


def limit(value, default: int = 10, most: int = 100) -> int:
    """A positive whole number, most at most; the default where none is given."""
    if value is None or value == "":
        return default
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = float("nan")
    if not number.is_integer() or number < 1:
        raise Refused("INVALID_ARGUMENT", "limit must be a positive whole number")
    return min(int(number), most)


def text(value, field: str, most: int = 200, required: bool = False) -> str:
    if value is None:
        value = ""
    if not isinstance(value, str):
        raise Refused("INVALID_ARGUMENT", f"{field} must be a text")
    value = value.strip()
    if len(value) > most:
        raise Refused("INVALID_ARGUMENT", f"{field} has more than {most} characters")
    if required and not value:
        raise Refused("INVALID_ARGUMENT", f"{field} is missing")
    return value


def code(value: str, field: str, required: bool = False) -> str:
    """A code in the format of its field, or an empty one where it is not required."""
    value = text(value, field, required=required)
    if value and not re.fullmatch(FORMATS[field], value):
        raise Refused("INVALID_ARGUMENT", f"{field} has a wrong format")
    return value


def page(value: int | None, pages: int) -> int | None:
    if value is None:
        return None
    if not 1 <= value <= pages:
        raise Refused("INVALID_ARGUMENT", f"page is out of range: there are {pages}")
    return value
