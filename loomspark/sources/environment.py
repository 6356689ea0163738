"""The machine and the folder that a review runs in: keys, checks, a first settings file, the log. Driver only."""

from __future__ import annotations

import json
import logging
import os
import re
import shutil
import sys
from pathlib import Path

import pyspark

from loomspark.functions import text as T
from loomspark.sources import changes, config

# The variables that an environment file may set.
KEYS = ("GROQ_API_KEY", "OPENAI_API_KEY")


def environment_file(folder: str, environment: dict[str, str]) -> dict[str, str]:
    """environment with the keys of folder/.env: those not set yet, and values that begin with gsk_. An unreadable file sets none."""
    out = dict(environment)
    try:
        lines = (Path(folder) / ".env").read_text(encoding="utf-8").split("\n")
    except (OSError, UnicodeDecodeError):
        return out
    for line in lines:
        name, sign, value = line.strip().partition("=")
        name, value = name.strip(), value.strip()
        if not sign or name not in KEYS:
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if not out.get(name) or value.startswith("gsk_"):
            out[name] = value
    return out


def probe(root: str, settings_file: str | None, environment: dict[str, str]) -> tuple[list[dict], bool]:
    """Rows of name, status (pass, fail or info) and message, and whether a review can run. A missing git or a folder without one stops none."""
    rows, ok = [], True

    def say(name: str, status: str, message: str, stops: bool = True) -> None:
        nonlocal ok
        rows.append({"name": name, "status": status, "message": message})
        ok = ok and not (status == "fail" and stops)

    new = sys.version_info >= (3, 10)
    say("Python", "pass" if new else "fail", sys.version.split()[0])
    say("Spark", "pass", pyspark.__version__)
    say("Root folder", "pass" if Path(root).is_dir() else "fail", root)
    settings: dict = {}
    try:
        settings = config.load(settings_file)
        say("Settings", "pass", settings_file if settings_file and Path(settings_file).is_file() else "defaults")
    except config.ConfigurationError as e:
        say("Settings", "fail", str(e))
    if shutil.which("git"):
        say("Git", "pass", changes.git(".", "--version").strip())
        top = changes.git_root(root) if Path(root).is_dir() else None
        say("Repository", "pass" if top else "info", top or "not inside a repository")
    else:
        say("Git", "fail", "not found", stops=False)
    cache = settings.get("cache.directory", config.TEXTS["cache.directory"])
    say("Cache folder", "pass" if config.is_inside(cache) else "fail", cache)
    on, key = bool(settings.get("ai.enabled")), any(environment.get(k, "").strip() for k in KEYS)
    say("Model review", "pass" if on else "info", "on" if on else "off")
    say("Key", ("pass" if key else "fail") if on else "info", "set" if key else "not set")
    return rows, ok


def init(root: str, name: str, *, force: bool = False) -> str:
    """Writes the default settings (without those of splitting) to root/name; refuses to replace a file unless forced."""
    tree: dict = {}
    for dotted, value in config.load(None).items():
        if not dotted.startswith("splitter."):
            *above, leaf = dotted.split(".")
            at = tree
            for part in above:
                at = at.setdefault(part, {})
            at[leaf] = value
    path = Path(root) / name
    with open(path, "w" if force else "x", encoding="utf-8") as f:
        f.write(json.dumps(tree, indent=2) + "\n")
    return str(path)


class _Masked(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        said = record.getMessage()
        for pattern in T.SECRETS:
            said = re.sub(pattern, T.MASK, said)
        record.msg, record.args = said, ()
        return True


def logger(level: str = "info", stream=None) -> logging.Logger:
    """A log that masks secrets; levels silent, error, warn, info, debug."""
    levels = {"silent": logging.CRITICAL + 1, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG}
    log = logging.Logger("loomspark", levels[level])
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.addFilter(_Masked())
    log.addHandler(handler)
    return log


def links_below(root: str) -> list[str]:
    """Relative paths of all symbolic links below a local folder; linked folders are not entered."""
    found = []
    for folder, folders, names in os.walk(root, followlinks=False):
        found += [os.path.relpath(p, root).replace(os.sep, "/") for p in (os.path.join(folder, n) for n in folders + names) if os.path.islink(p)]
    return sorted(found)
