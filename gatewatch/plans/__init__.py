"""Registered queries.  Importing the package fills the registry."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _m in ("q_parse", "q_detect", "q_reports", "q_state", "q_models", "q_policies", "flagship"):
    import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "ORACLES"]
