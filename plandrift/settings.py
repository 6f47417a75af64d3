"""Settings: defaults, then a file, then the environment; each may say less than the one before."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from collections.abc import Mapping

from . import limits
from .errors import Code, Failure

#: What everything starts from; a file or a variable may only name what is here.
DEFAULTS: dict = {
    "matching": {"weights": limits.WEIGHTS, "min_score": limits.MIN_MATCH_SCORE, "spatial_radius": limits.SPATIAL_RADIUS, "page_work": limits.PAGE_WORK, "move_tolerance": limits.MOVE_TOLERANCE},
    "confidence": {"high": limits.HIGH, "medium": limits.MEDIUM},
    "pairs": {"mode": "warn", "compatible": limits.COMPATIBLE},
    "limits": limits.DEFAULTS,
    "retrieval": {"top_k": limits.TOP_K, "rrf_k": limits.RRF_K, "exact_boost": limits.EXACT_BOOST, "proximity_radius": limits.PROXIMITY_RADIUS, "proximity_weight": limits.PROXIMITY_WEIGHT},
    "ocr": {"backend": "auto", "min_confidence": 0.4},
    "answers": {"provider": "extractive", "capture_content": False},
}
#: PLANDRIFT__MATCHING__MIN_SCORE=0.5 sets matching.min_score.
PREFIX = "PLANDRIFT__"


def _merged(base: dict, over: Mapping, at: str = "") -> dict:
    out = copy.deepcopy(base)
    for name, value in over.items():
        where = f"{at}{name}"
        if name not in out:
            raise Failure(Code.CONFIG, f"no such setting: {where}")
        if isinstance(out[name], dict) != isinstance(value, Mapping):
            raise Failure(Code.CONFIG, f"{where} is {'a section' if isinstance(out[name], dict) else 'a value'}")
        out[name] = _merged(out[name], value, f"{where}.") if isinstance(value, Mapping) else value
    return out


def _parsed(text: str) -> Mapping:
    """A JSON object, or YAML where a library for it is there."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise Failure(Code.CONFIG, "the settings are no JSON, and there is no YAML library") from e
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise Failure(Code.CONFIG, "the settings can't be read") from e
    if not isinstance(found or {}, Mapping):
        raise Failure(Code.CONFIG, "the settings are no object")
    return found or {}


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> dict:
    """The settings of a file on the driver, and of the environment's variables, whose values are read as JSON where they are."""
    out = copy.deepcopy(DEFAULTS)
    if path is not None:
        if not os.path.exists(path):
            raise Failure(Code.CONFIG, "the settings' file doesn't exist")
        with open(path, encoding="utf-8") as file:
            out = _merged(out, _parsed(file.read()))
    for name, text in sorted((os.environ if environment is None else environment).items()):
        if name.startswith(PREFIX):
            try:
                value = json.loads(text)
            except json.JSONDecodeError:
                value = text
            for part in reversed(name.removeprefix(PREFIX).lower().split("__")):
                value = {part: value}
            out = _merged(out, value)
    return out


def fingerprint(settings: Mapping) -> str:
    """A name of 16 digits for settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
