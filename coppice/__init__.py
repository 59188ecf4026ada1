"""Gradient-boosted trees as Spark plans.

Names are imported when they are first used: Python workers, which import modules of this package one by one,
load nothing that their function doesn't need.
"""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "BinnedDataset": "plans.dataset",
    "Classifier": "plans.estimators",
    "Config": "config",
    "Model": "plans.model",
    "OrderedTargetEncoder": "operators.encoding",
    "Params": "config",
    "Regressor": "plans.estimators",
    "default_config_toml": "config",
    "load_config": "config",
    "train": "plans.booster",
}

__all__ = [*_WHERE, "cuda_available", "interop", "load"]


def __getattr__(name: str):
    if name == "interop":
        return import_module(".plans.interop", __name__)
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)


def load(path: str):
    return import_module(".plans.model", __name__).Model.load(path)


def cuda_available() -> bool:
    """Trees are grown by Spark executors; names with a device prefix mean the same growers."""
    return False
