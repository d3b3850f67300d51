"""The library's log level, by name or number."""

from __future__ import annotations

import logging

LOGGER = logging.getLogger("tessera")
LEVELS = {"TRACE": 5, "DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARN": logging.WARNING, "ERROR": logging.ERROR}
LOGGER.setLevel(logging.ERROR)


def set_log_level(level: str | int) -> None:
    """TRACE, DEBUG, INFO, WARN or ERROR (the default), or 0 to 4 for them."""
    names = list(LEVELS)
    name = names[level] if isinstance(level, int) and not isinstance(level, bool) and 0 <= level < len(names) else level.upper() if isinstance(level, str) else ""
    if name not in LEVELS:
        raise ValueError(f"no log level {level!r}")
    LOGGER.setLevel(LEVELS[name])
