"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

_MODULES = ["spatial_queries", "feature_queries", "profile_queries", "timeseries_queries",
            "prepare_queries", "evaluate_queries", "model_queries", "source_queries", "streaming_queries"]

for _m in _MODULES:
    try:
        importlib.import_module(f"{__package__}.{_m}")
    except ModuleNotFoundError as exc:  # a module still being written
        if exc.name != f"{__package__}.{_m}":
            raise

__all__ = ["QUERIES", "ORACLES"]
