"""Operators for training-data pipelines.  Importing the package fills the registry."""

from importlib import import_module

from .common import ORACLES, QUERIES

for _m in ("licenses", "line_dedup", "decontaminate", "toxicity", "packing", "topk", "quality", "jaccard", "lm", "sharding",
           "merkle", "mixing", "runs"):
    import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
