"""Layered settings: resolved, frozen and hashed on the driver before any job runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame

# The presets' least diameter (mm) and colours; the defaults and ranges of every section; what two presets add.
PRESETS = {"easy": (5.0, 8), "medium": (3.5, 16), "hard": (2.5, 24), "dense": (1.5, 17), "partial": (1.5, 17)}
DEFAULTS: dict[str, Any] = {
    "page": {"width_mm": 215.9, "height_mm": 279.4, "margin_mm": 12.7},
    "load": {"max_pixels": 100_000_000, "least_side": 64},
    "preprocess": {"max_working_px": 1600, "smooth_passes": 2, "impl": "bilateral", "sigma_color": 0.08, "sigma_space": 5.0, "clahe": False, "clahe_clip": 2.0},
    "analyze": {"enabled": True, "k_min": 8, "k_max": 30},
    "quantize": {"merge_delta_e": 7.0, "max_iter": 50, "impl": "labkmeans"},
    "denoise": {"max_modal_iters": 3, "speck_divisor": 16},
    "fill_holes": {"enabled": False, "max_hole_mm2": 1.5},
    "ink": {"enabled": False, "max_width_mm": 0.6, "contrast_l": 8.0, "darkness_l": 55.0, "survived_l": 25.0, "min_length_mm": 2.0},
    "merge": {"enabled": True, "lambda_boundary": 15.0, "protect_dark_l": 0.0, "protect_dark_delta_l": 0.0},
    "mask": {"enabled": False, "top_area_percentile": 0.5, "white_l_threshold": 95.0},
    "simplify": {"tolerance_mm": 0.15},
    "geometry_normalize": {"enabled": True, "duplicate_eps_mm": 0.01, "spike_length_mm": 0.05},
    "bezier": {"fit_error_mm": 0.15, "corner_angle_deg": 65.0, "impl": "schneider"},
    "labels": {"polylabel_precision_pt": 0.5, "leader_ring_mm": 4.0, "font_min_pt": 5.0, "font_max_pt": 6.0},
    "legend": {"chip_mm": 10.0, "gap_mm": 3.0, "name_box_mm": 34.0, "pair_gap_mm": 4.0, "number_font_pt": 11.0},
    "validate": {"fidelity_min_agreement": 0.99},
    "png": {"dpi": 150.0},
}
DENSE: dict[str, Any] = {
    "quantize": {"merge_delta_e": 3.0}, "merge": {"protect_dark_l": 48.0, "protect_dark_delta_l": 16.0}, "fill_holes": {"enabled": True, "max_hole_mm2": 1.5},
    "preprocess": {"max_working_px": 2400}, "simplify": {"tolerance_mm": 0.2}, "bezier": {"fit_error_mm": 0.22, "corner_angle_deg": 70.0}, "validate": {"fidelity_min_agreement": 0.93},
}
RANGES = {
    ("quantize", "n_colors"): (2, 64), ("merge", "lambda_boundary"): (0, 50), ("simplify", "tolerance_mm"): (0, 2), ("bezier", "fit_error_mm"): (0.02, 2), ("bezier", "corner_angle_deg"): (15, 120),
    ("labels", "polylabel_precision_pt"): (0.05, 2), ("labels", "leader_ring_mm"): (1, 20), ("legend", "chip_mm"): (1, 30), ("legend", "gap_mm"): (0, 10), ("legend", "name_box_mm"): (1, 100),
    ("legend", "pair_gap_mm"): (0, 20), ("png", "dpi"): (72, 300), ("mask", "top_area_percentile"): (0, 1),
}


class PageError(ValueError):
    """Any failure that belongs to one image or one call."""


class InputError(PageError):
    """The source can't be read."""


class StageError(PageError):
    """A stage can't do its work."""


class QualityError(PageError):
    """A page fails its checks."""


class Cancelled(PageError):
    """The caller asked to stop."""


class ConfigError(PageError):
    """A setting is missing, unknown or out of range."""


def preset(name: str) -> dict[str, Any]:
    if name not in PRESETS:
        raise ConfigError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    d, k = PRESETS[name]
    out = overlay({"merge": {"d_min_mm": d}, "quantize": {"n_colors": k}}, DENSE if name in ("dense", "partial") else {})
    return overlay(out, {"mask": {"enabled": True}}) if name == "partial" else out


def overlay(base: Mapping, over: Mapping, only_missing: bool = False) -> dict:
    """base with over's values; nested mappings meet key by key. With only_missing, set keys keep their values."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = overlay(out[k], v, only_missing)
        elif not (only_missing and k in out):
            out[k] = v
    return out


def _frozen(tree: Any) -> Any:
    return MappingProxyType({k: _frozen(v) for k, v in tree.items()}) if isinstance(tree, Mapping) else tree


def resolve(*layers: Mapping, proposals: Mapping | None = None) -> Mapping:
    """Later layers win; proposals fill what no layer sets."""
    out: dict = {}
    for layer in layers:
        out = overlay(out, layer)
    return _frozen(overlay(out, proposals, only_missing=True) if proposals else out)


def check(tree: Mapping) -> Mapping:
    """The settings, if every section and key is known and in range."""
    for section, keys in tree.items():
        known = {*DEFAULTS.get(section, {}), *{"quantize": ("n_colors", "sample_px"), "merge": ("d_min_mm",)}.get(section, ())}
        if section not in DEFAULTS or set(keys) - known:
            raise ConfigError(f"unknown setting {section}: {', '.join(sorted(set(keys) - known))}")
        for k, v in keys.items():
            low, high = RANGES.get((section, k), (None, None))
            if low is not None and not low <= v <= high:
                raise ConfigError(f"{section}.{k} must be {low} to {high}, not {v}")
    return tree


def plain(tree: Any) -> Any:
    return {k: plain(v) for k, v in tree.items()} if isinstance(tree, Mapping) else tree


def config_hash(tree: Mapping, schema_version: int = 1) -> str:
    """SHA-256 of the JSON with sorted keys and no white space."""
    text = json.dumps({"schema_version": schema_version, "config": plain(tree)}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


class Stages:
    """Named DataFrame -> DataFrame stages with what each requires and provides; a plan is checked before it is built."""

    def __init__(self):
        self.made: dict[tuple[str, str], tuple[Callable, frozenset, frozenset]] = {}

    def add(self, slot: str, impl: str, fn: Callable[[dict[str, DataFrame], Mapping], dict[str, DataFrame]], requires=(), provides=()) -> None:
        if (slot, impl) in self.made:
            raise ConfigError(f"{slot}/{impl} is registered twice")
        self.made[slot, impl] = fn, frozenset(requires), frozenset(provides)

    def run(self, plan: list[tuple[str, str]], have: dict[str, DataFrame], config: Mapping) -> dict[str, DataFrame]:
        known = set(have)
        for step in plan:
            if step not in self.made:
                raise ConfigError(f"no stage {step[0]}/{step[1]}")
            if lack := self.made[step][1] - known:
                raise ConfigError(f"{step[0]} needs {', '.join(sorted(lack))}")
            known |= self.made[step][2]
        out = dict(have)
        for step in plan:
            got = self.made[step][0](out, config)
            if lack := self.made[step][2] - got.keys():
                raise ConfigError(f"{step[0]} did not provide {', '.join(sorted(lack))}")
            out |= got
        return out
