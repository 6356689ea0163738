"""Configuration: defaults, then a JSON file, then overrides; every leaf checked, unknown fields refused. Driver only."""

from __future__ import annotations

import json
from pathlib import Path, PurePosixPath

# The whole-number settings with their defaults and ranges.
RANGES = {
    "complexity.maxFunctionLines": (80, 10, 1000),
    "complexity.maxParameters": (5, 1, 20),
    "complexity.maxCyclomaticComplexity": (10, 1, 100),
    "complexity.maxNestingDepth": (4, 1, 20),
    "react.maxComponentLines": (200, 20, 2000),
    "react.maxEffectLines": (50, 5, 500),
    "maxFiles": (100, 1, 100000),
    "maxFileSizeKb": (150, 1, 500000),
    "concurrency": (2, 1, 10),
    "ai.maxOutputTokens": (2000, 100, 20000),
    "ai.maxRequests": (20, 1, 100),
    "ai.maxInputTokensPerChunk": (12000, 500, 100000),
    "ai.timeoutMs": (30000, 1000, 120000),
    "ai.retries": (2, 0, 5),
    "cache.maxEntries": (1000, 10, 10000),
    "splitter.minFileLines": (120, 20, 5000),
    "splitter.minCandidateLines": (20, 5, 1000),
    "splitter.maxCandidates": (10, 1, 50),
}
# Settings that are one of some words, switches, texts (folders must stay inside the root), and the cost limit.
SEVERITY = {"severityThreshold": ("medium", ("low", "medium", "high", "critical"))}
WORDS = {"ai.provider": ("openai", ("openai", "groq")), "ai.reasoningEffort": ("low", ("none", "low", "medium", "high"))}
SWITCHES = {"ai.enabled": False, "cache.enabled": True, "splitter.enabled": True, "splitter.aiPlanning": False}
TEXTS = {"ai.model": "gpt-5.6-luna", "cache.directory": ".loom-cache", "splitter.targetDirectory": None}
COST = {"ai.maxEstimatedCostUsd": (0.25, 100)}


class ConfigurationError(ValueError):
    pass


def flat(tree: dict, above: str = "") -> dict:
    out = {}
    for k, v in tree.items():
        out |= flat(v, f"{above}{k}.") if isinstance(v, dict) else {f"{above}{k}": v}
    return out


def is_inside(folder: str) -> bool:
    """Whether a folder is a relative path that does not leave the root."""
    parts = folder.replace("\\", "/")
    return bool(folder) and not PurePosixPath(parts).is_absolute() and ".." not in parts.split("/")


def checked(values: dict) -> dict:
    for k, v in values.items():
        if k in RANGES:
            _, low, high = RANGES[k]
            if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
                raise ConfigurationError(f"{k} must be a whole number from {low} to {high}")
        elif k in SEVERITY | WORDS:
            words = (SEVERITY | WORDS)[k][1]
            if v not in words:
                raise ConfigurationError(f"{k} must be one of {', '.join(words)}")
        elif k in SWITCHES:
            if not isinstance(v, bool):
                raise ConfigurationError(f"{k} must be true or false")
        elif k in COST:
            if not isinstance(v, (int, float)) or isinstance(v, bool) or not 0 < v <= COST[k][1]:
                raise ConfigurationError(f"{k} must be above 0 and at most {COST[k][1]}")
        elif k in TEXTS:
            if v is None and TEXTS[k] is None:
                continue
            if not isinstance(v, str) or not v or (k.endswith("irectory") and not is_inside(v)):
                raise ConfigurationError(f"{k} must be a text that is not empty" + (", a relative path inside the root" if k.endswith("irectory") else ""))
        else:
            raise ConfigurationError(f"unknown setting: {k}")
    return values


def defaults() -> dict:
    return {k: v[0] for k, v in (RANGES | SEVERITY | WORDS | COST).items()} | SWITCHES | TEXTS


def load(path: str | None, overrides: dict | None = None) -> dict:
    """Dotted settings; overrides (None values count as not given) before the file's, and these before the defaults. A missing file is no error."""
    own = {}
    if path and Path(path).is_file():
        try:
            own = json.loads(Path(path).read_text())
        except ValueError as e:
            raise ConfigurationError(f"{path} is not JSON: {e}") from e
        if not isinstance(own, dict):
            raise ConfigurationError(f"{path} must hold an object")
    given = {k: v for k, v in flat(overrides or {}).items() if v is not None}
    return defaults() | checked(flat(own)) | checked(given)


def exit_code(*, failures: int, budget_stopped: bool, threshold_hit: bool) -> int:
    return 2 if failures or budget_stopped else int(threshold_hit)
