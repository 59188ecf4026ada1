"""Typed configuration: sections with defaults, TOML, dotted overrides and partial parameter sets."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

GROWERS = ("depthwise", "levelwise", "leafwise")
SAMPLERS = ("all_rows", "bernoulli", "goss")
OBJECTIVES = ("mse", "logloss", "mae", "huber", "quantile", "poisson", "softmax")


@dataclass
class Tree:
    min_child_hess: float = 1.0
    min_gain_to_split: float = 0.0
    lambda_l2: float = 1.0
    lambda_l1: float = 0.0
    feature_fraction: float = 1.0
    max_depth: int = 6
    min_data_in_leaf: int = 20
    max_leaves: int = 31
    feature_seed: int = 2
    monotone_constraints: list[int] = field(default_factory=list)
    interaction_constraints: list[str] = field(default_factory=list)


@dataclass
class Booster:
    n_iters: int = 100
    learning_rate: float = 0.05
    random_seed: int = 42
    log_intervals: int = 0
    early_stopping_rounds: int = 0
    dart_drop_rate: float = 0.0


@dataclass
class Data:
    format: str = "csv"
    header: bool = True
    label_column: int = 0
    weight_column: int = -1
    ignored_columns: list[int] = field(default_factory=list)
    n_features: int = 0
    train: str = ""
    valid: list[str] = field(default_factory=list)


@dataclass
class BinMapper:
    max_bin: int = 255
    n_samples: int = 0  # cuts come from all rows; other numbers ask for a sample of so many
    seed: int = 0
    min_data_in_bin: int = 1  # read and kept, without effect


@dataclass
class Objective:
    huber_delta: float = 1.0
    quantile_alpha: float = 0.5
    n_classes: int = 3


@dataclass
class Sampler:
    subsample: float = 1.0
    top_rate: float = 0.2
    other_rate: float = 0.1


@dataclass
class Dispatch:
    objective_name: str = "mse"
    grower_name: str = "depthwise"
    sampler_name: str = "all_rows"


@dataclass
class Parallel:
    n_threads: int = 0
    device_id: int = 0


@dataclass
class Metrics:
    names: list[str] = field(default_factory=list)


@dataclass
class Config:
    tree: Tree = field(default_factory=Tree)
    booster: Booster = field(default_factory=Booster)
    data: Data = field(default_factory=Data)
    bin_mapper: BinMapper = field(default_factory=BinMapper)
    objective: Objective = field(default_factory=Objective)
    sampler: Sampler = field(default_factory=Sampler)
    dispatch: Dispatch = field(default_factory=Dispatch)
    parallel: Parallel = field(default_factory=Parallel)
    metrics: Metrics = field(default_factory=Metrics)

    @property
    def grower(self) -> str:
        """The growth policy; device prefixes name the same trees."""
        return self.dispatch.grower_name.removeprefix("cuda_")

    def check(self) -> Config:
        d = self.dispatch
        for name, known in ((d.objective_name, OBJECTIVES), (self.grower, GROWERS), (d.sampler_name, SAMPLERS)):
            if name not in known:
                raise ValueError(f"unknown name {name!r}; known: {', '.join(known)}")
        if self.grower == "levelwise" and (any(self.tree.monotone_constraints) or self.tree.interaction_constraints):
            raise ValueError("levelwise trees take no monotone or interaction constraints")
        if d.sampler_name == "bernoulli" and self.sampler.subsample <= 0:
            raise ValueError("subsample must be positive")
        if self.bin_mapper.max_bin < 3 or self.bin_mapper.max_bin > 65_535:
            raise ValueError("max_bin must be between 3 and 65535")
        if any(c not in (-1, 0, 1) for c in self.tree.monotone_constraints):
            raise ValueError("monotone constraints are -1, 0 or 1")
        if d.objective_name == "softmax" and self.objective.n_classes < 2:
            raise ValueError("softmax needs two classes at least")
        return self

    def to_dict(self) -> dict[str, Any]:
        return {f"{s.name}.{f.name}": getattr(getattr(self, s.name), f.name) for s in fields(self) for f in fields(getattr(self, s.name))}

    def set(self, key: str, value: Any) -> None:
        section, _, name = key.partition(".")
        part = getattr(self, section, None)
        if part is None or section not in {s.name for s in fields(self)}:
            raise ValueError(f"unknown section {section!r}")
        kinds = {f.name: f.type for f in fields(part)}
        if name not in kinds:
            raise ValueError(f"unknown key {key!r}")
        setattr(part, name, _coerce(key, kinds[name], value))

    def copy(self) -> Config:
        out = Config()
        for k, v in self.to_dict().items():
            out.set(k, list(v) if isinstance(v, list) else v)
        return out


def _coerce(key: str, kind: str, value: Any) -> Any:
    def one(k: str, v: Any) -> Any:
        if k == "bool":
            if isinstance(v, bool):
                return v
            if str(v).lower() in ("true", "false"):
                return str(v).lower() == "true"
        elif k == "int" and not isinstance(v, bool):
            if isinstance(v, int) or (isinstance(v, str) and v.lstrip("+-").isdigit()):
                return int(v)
        elif k == "float" and not isinstance(v, bool):
            try:
                return float(v)
            except (TypeError, ValueError):
                pass
        elif k == "str" and isinstance(v, str):
            return v
        raise ValueError(f"{key} takes {k}, not {v!r}")

    if kind.startswith("list"):
        item = kind[5:-1]
        if isinstance(value, str):
            value = [x.strip() for x in value.split(",") if x.strip()]
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{key} takes a list, not {value!r}")
        return [one(item, v) for v in value]
    return one(kind, value)


def load_config(text: str = "", overrides: Iterable[str | tuple[str, Any]] = ()) -> Config:
    """A configuration from TOML text, then ``section.key=value`` overrides; unknown names are errors."""
    out = Config()
    for section, body in tomllib.loads(text).items():
        if not isinstance(body, dict):
            raise ValueError(f"{section!r} is not a section")
        for key, value in body.items():
            out.set(f"{section}.{key}", value)
    for pair in overrides:
        key, value = pair.split("=", 1) if isinstance(pair, str) else pair
        out.set(key.strip(), value.strip() if isinstance(value, str) else value)
    return out


def dump_config(config: Config) -> str:
    """TOML text that ``load_config`` reads back as the same configuration."""

    def show(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(v, list):
            return "[" + ", ".join(map(show, v)) + "]"
        return repr(v)

    lines = []
    for s in fields(config):
        lines += [f"[{s.name}]", *[f"{f.name} = {show(getattr(getattr(config, s.name), f.name))}" for f in fields(getattr(config, s.name))], ""]
    return "\n".join(lines)


def default_config_toml() -> str:
    return dump_config(Config())


class Params:
    """A partial set of dotted parameters; the right side of ``|`` wins."""

    def __init__(self, values: Mapping[str, Any] | None = None, **sections: Mapping[str, Any]):
        probe = Config()
        self._values: dict[str, Any] = {}
        for key, value in [*(values or {}).items(), *((f"{s}.{k}", v) for s, body in sections.items() for k, v in body.items())]:
            probe.set(key, value)
            section, _, name = key.partition(".")
            self._values[key] = getattr(getattr(probe, section), name)

    @classmethod
    def from_dict(cls, values: Mapping[str, Any]) -> Params:
        flat = {}
        for k, v in values.items():
            flat |= {f"{k}.{n}": x for n, x in v.items()} if isinstance(v, Mapping) else {k: v}
        return cls(flat)

    @classmethod
    def from_toml(cls, text: str) -> Params:
        return cls.from_dict(tomllib.loads(text))

    @classmethod
    def from_model(cls, model) -> Params:
        return cls(model.config.to_dict())

    def to_dict(self) -> dict[str, Any]:
        return dict(self._values)

    def __or__(self, other: Params | Mapping[str, Any]) -> Params:
        return Params({**self._values, **(other.to_dict() if isinstance(other, Params) else other)})

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Params) and self._values == other._values

    def __repr__(self) -> str:
        return f"Params({', '.join(f'{k}={v!r}' for k, v in self._values.items())})"

    def config(self) -> Config:
        return load_config(overrides=self._values.items())


def as_config(params: Config | Params | Mapping[str, Any] | Iterable[tuple[str, Any]] | None) -> Config:
    if params is None:
        return Config()
    if isinstance(params, Config):
        return params.copy()
    if isinstance(params, Params):
        return params.config()
    return Params.from_dict(params if isinstance(params, Mapping) else dict(params)).config()


def given_keys(params: Params | Mapping[str, Any] | Iterable[tuple[str, Any]] | None) -> list[str]:
    """The dotted keys that a partial set of parameters names."""
    if params is None:
        return []
    return list((params if isinstance(params, Params) else Params.from_dict(params if isinstance(params, Mapping) else dict(params))).to_dict())


MONOTONE = "tree.monotone_constraints"


def by_position(params: Any, names: list[str]) -> Any:
    """``params`` with constraints that map feature names to -1, 0 or 1 as a list in the features' order."""
    if not isinstance(params, Mapping):
        return params
    nested = isinstance(params.get("tree"), Mapping) and isinstance(params["tree"].get("monotone_constraints"), Mapping)
    given = params["tree"]["monotone_constraints"] if nested else params.get(MONOTONE)
    if not isinstance(given, Mapping):
        return params
    unknown = sorted(set(given) - set(names))
    if unknown:
        raise ValueError(f"{MONOTONE} names no features: {', '.join(unknown)}")
    odd = [k for k, v in given.items() if isinstance(v, bool) or v not in (-1, 0, 1)]
    if odd:
        raise ValueError(f"{MONOTONE} is -1, 0 or 1, not so for {', '.join(odd)}")
    signs = [int(given.get(n, 0)) for n in names]
    return {**params, "tree": {**params["tree"], "monotone_constraints": signs}} if nested else {**params, MONOTONE: signs}
