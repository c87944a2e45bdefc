"""Configuration: a YAML file or dict as checked dataclasses.

Strings are expanded from the environment (unset variables stay as they are).
Missing sections or keys raise KeyError, contradictory ones ValueError.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from chronopix.functions.kernels import ESTIMATORS, Ols, estimator


def expand(value):
    """Environment variables in every string of a nest of dicts and lists."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    return os.path.expandvars(value) if isinstance(value, str) else value


def without_keys(d: dict, pattern: str) -> dict:
    """A copy of a nested dict without the keys that a regular expression matches."""
    return {k: without_keys(v, pattern) if isinstance(v, dict) else v for k, v in d.items() if not re.match(pattern, str(k))}


def override(d: dict, changes: dict) -> dict:
    """A copy with keys of any depth set to new values."""
    return {k: override(v, changes) if isinstance(v, dict) else changes.get(k, v) for k, v in d.items()}


def _per_band(value, n: int, name: str):
    if value is None:
        return None
    out = list(value) if isinstance(value, (list, tuple)) else [value] * n
    if len(out) != n:
        raise ValueError(f"{name} has {len(out)} entries for {n} bands")
    return out


@dataclass
class Dataset:
    input_file: str | None = None
    date_format: str = "%Y%j"
    output: str | None = None
    output_prefix: str = ""
    n_bands: int = 0
    mask_band: int | None = None  # from 1
    mask_values: list[int] = field(default_factory=list)
    min_values: list[float] | None = None
    max_values: list[float] | None = None
    use_bip_reader: bool = False
    cache_line_dir: str | None = None

    def __post_init__(self):
        self.min_values = _per_band(self.min_values, self.n_bands, "min_values")
        self.max_values = _per_band(self.max_values, self.n_bands, "max_values")
        if self.mask_band is not None and not 1 <= self.mask_band <= self.n_bands:
            raise ValueError(f"mask_band {self.mask_band} is not within 1 to {self.n_bands}")


@dataclass
class Refit:
    prefix: str
    prediction: Ols
    stay_regularized: bool = True


@dataclass
class Config:
    dataset: Dataset
    algorithm: str
    parameters: dict
    fit: dict
    estimator: Ols
    design_matrix: str
    reverse: bool = False
    commission_alpha: float | None = None
    refits: list[Refit] = field(default_factory=list)
    phenology: dict = field(default_factory=lambda: {"enable": False})
    classification: dict = field(default_factory=lambda: {"training_image": None})


def _prediction(name: str, raw: dict) -> Ols:
    """A registered estimator, or one that a section of the configuration describes by type and parameters."""
    if name.lower() in ESTIMATORS:
        return estimator(name)
    section = raw.get(name)
    if not isinstance(section, dict) or "type" not in section:
        raise KeyError(f"{name!r} is neither an estimator ({', '.join(sorted(ESTIMATORS))}) nor a section with a type")
    return type(estimator(section["type"]))(**section.get("init", {}))


def parse(raw: dict) -> Config:
    raw = expand(raw)
    if "dataset" not in raw:
        raise KeyError("a section dataset is needed")
    # the model section goes by any name; it is the one that names an algorithm and a design
    main = next((v for k, v in raw.items() if isinstance(v, dict) and k not in ("dataset", "phenology", "classification") and {"algorithm", "prediction", "design_matrix"} & set(v)), None)
    if main is None:
        raise KeyError("a model section with algorithm, prediction and design_matrix is needed")
    for key in ("algorithm", "prediction", "design_matrix"):
        if key not in main:
            raise KeyError(f"{key} is needed in the model section")
    own = raw.get(main["algorithm"])
    if own is None:
        raise KeyError(f"no section {main['algorithm']!r}")
    known = Dataset.__dataclass_fields__
    dataset = Dataset(**{k: v for k, v in raw["dataset"].items() if k in known})
    refit = main.get("refit") or {}
    prefixes, models = refit.get("prefix") or [], refit.get("prediction") or []
    stay = refit.get("stay_regularized", True)
    stay = stay if isinstance(stay, list) else [stay] * len(prefixes)
    if not len(prefixes) == len(models) == len(stay):
        raise KeyError("refit needs as many predictions and stay_regularized as prefixes")
    return Config(
        dataset, main["algorithm"], dict(own.get("init") or {}), dict(own.get("fit") or {}), _prediction(main["prediction"], raw), main["design_matrix"], bool(main.get("reverse", False)), main.get("commission_alpha") or None,
        [Refit(p, _prediction(m, raw), s) for p, m, s in zip(prefixes, models, stay, strict=True)], raw.get("phenology") or {"enable": False}, raw.get("classification") or {"training_image": None},
    )


def load(path: str | Path) -> Config:
    import yaml

    return parse(yaml.safe_load(Path(path).read_text()))
