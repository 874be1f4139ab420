"""Refusals with a reason code: inputs that fail a check are refused, never replaced."""

from __future__ import annotations

import re


class Refused(Exception):
    """reason_code: capital letters and underscores; the message begins with it."""

    def __init__(self, reason_code: str, message: str):
        self.reason_code = reason_code
        super().__init__(f"{reason_code}: {message}")


def reason_code_of(message: str, default: str = "TOOL_EXECUTION_FAILED") -> str:
    """The reason code that an error message begins with."""
    found = re.match(r"([A-Z_]+):", message)
    return found[1] if found else default
