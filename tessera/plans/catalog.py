"""Imports every query module so their registrations land in one place.

A module that fails to import loses its own queries only; ``FAILED`` names it with its error.
"""

from __future__ import annotations

import importlib
import warnings

from .registry import ORACLES, QUERIES

MODULES = ("q_corpus", "q_encode", "q_metrics", "q_epochs", "q_sources", "q_attention", "q_classify")
FAILED: dict[str, Exception] = {}

for _name in MODULES:
    try:
        importlib.import_module(f"{__package__}.{_name}")
    except Exception as error:  # noqa: BLE001 - reported, and the other modules still register
        FAILED[_name] = error
        warnings.warn(f"queries of {_name} are not available: {error!r}", stacklevel=2)

__all__ = ["FAILED", "ORACLES", "QUERIES"]
