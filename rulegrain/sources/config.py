"""Settings with defaults; a JSON object may change them section by section."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


class ConfigError(ValueError):
    """Names the setting that is wrong."""


@dataclass(frozen=True)
class Budgets:
    surface_warn_tokens: int = 1500
    effective_context_warn_tokens: int = 4000
    buried_rule_depth_ratio: float = 0.7


@dataclass(frozen=True)
class Discovery:
    max_files: int | None = None
    max_surface_bytes: int | None = None
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Analysis:
    max_rules: int | None = None


@dataclass(frozen=True)
class Compliance:
    commits: int = 30
    concurrency: int = 4
    spend_cap_usd: float = 1.0
    calibration_sample_ratio: float = 0.1
    agreement_warn_threshold: float = 0.8
    model: str = "judge"
    calibration_model: str = "second-judge"


@dataclass(frozen=True)
class Config:
    budgets: Budgets = field(default_factory=Budgets)
    discovery: Discovery = field(default_factory=Discovery)
    analysis: Analysis = field(default_factory=Analysis)
    compliance: Compliance = field(default_factory=Compliance)


#: Limits of the command line, which looks at one repository on one machine. The library has none of its own.
LIMITED = Config(discovery=Discovery(max_files=20_000, max_surface_bytes=1 << 20), analysis=Analysis(max_rules=5000))


def _snake(key: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in key)


def load(source: str | None, base: Config | None = None) -> Config:
    """Settings from JSON text (camelCase or snake_case keys); what it doesn't say is as in base, or the defaults."""
    config = base or Config()
    if source is None:
        return config
    try:
        told = json.loads(source)
    except json.JSONDecodeError as e:
        raise ConfigError(f"the settings are no JSON: {e}") from None
    if not isinstance(told, dict):
        raise ConfigError("the settings must be an object")
    for section, values in told.items():
        if section == "$schema":
            continue
        if section not in {f.name for f in fields(config)}:
            raise ConfigError(f"unknown section {section}")
        if not isinstance(values, dict):
            raise ConfigError(f"{section} must be an object")
        now = getattr(config, section)
        for key, value in values.items():
            name = _snake(key)
            if name not in {f.name for f in fields(now)}:
                raise ConfigError(f"unknown key {section}.{key}")
            default = getattr(now, name)
            if isinstance(default, tuple):
                good = isinstance(value, list) and all(isinstance(x, str) for x in value)
                value = tuple(value) if good else value
            elif isinstance(default, str):
                good = isinstance(value, str)
            else:
                good = isinstance(value, int | float) and not isinstance(value, bool) and value >= 0 and (isinstance(default, float) or isinstance(value, int))
            if not good:
                raise ConfigError(f"{section}.{key} has a wrong type")
            now = replace(now, **{name: value})
        config = replace(config, **{section: now})
    return config
