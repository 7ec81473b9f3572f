"""Configuration files: where they are looked for, and what they say as a policy.

A file is TOML, either whole or as the table [tool.inkgauge] of pyproject.toml:

    include, exclude: patterns; profile; select, ignore: rules; minimum_severity, min_confidence
    [severity] rule = level; [thresholds] name = number; [vocabulary] additional, allowed, allowed_phrases
    [[per-file-ignores]] pattern, ignore

A profile gives select, minimum_severity and min_confidence; what the file says itself comes before that.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from inkgauge.plans import catalog
from inkgauge.plans.policy import Policy
from inkgauge.sources.files import INCLUDE

NAME = "inkgauge"
EXCLUDE = ("venv/**", ".venv/**", "node_modules/**", ".git/**")
_LISTS = ("include", "exclude", "select", "ignore")
_TEXTS = ("profile", "minimum_severity", "min_confidence")
_TABLES = ("severity", "thresholds", "vocabulary", "per-file-ignores")
_WORDS = ("additional", "allowed", "allowed_phrases")


@dataclass
class Config:
    policy: Policy = field(default_factory=Policy)
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    path: Path | None = None


def find(start: Path | str = ".", home: Path | None = None) -> Path | None:
    """The nearest file: of the folder itself (its own file, then its pyproject.toml), of folders above up to git's root, of the user."""
    here, own = Path(start).resolve(), f".{NAME}.toml"
    if (here / own).exists():
        return here / own
    project = here / "pyproject.toml"
    if project.exists() and NAME in tomllib.loads(project.read_text(encoding="utf-8")).get("tool", {}):
        return project
    for folder in here.parents[:-1]:
        if (folder / own).exists():
            return folder / own
        if (folder / ".git").exists():
            break
    user = (home or Path.home()) / ".config" / NAME / "config.toml"
    return user if user.exists() else None


def _strings(data: dict, key: str) -> list[str] | None:
    value = data.get(key)
    if value is not None and not (isinstance(value, list) and all(isinstance(v, str) for v in value)):
        raise ValueError(f"{key} must be a list of strings")
    return value


def parse(data: dict, path: Path | None = None) -> Config:
    """The configuration of a table. Unknown names and wrong kinds are errors."""
    for key in data:
        if key not in (*_LISTS, *_TEXTS, *_TABLES):
            raise ValueError(f"unknown setting {key!r}")
    for key in _TEXTS:
        if not isinstance(data.get(key, ""), str):
            raise ValueError(f"{key} must be a string")
    profile, words = data.get("profile"), data.get("vocabulary", {})
    if profile is not None and profile not in catalog.PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if not set(words) <= set(_WORDS):
        raise ValueError("vocabulary holds additional, allowed and allowed_phrases")
    base = Policy.of_profile(profile) if profile else Policy()
    selected, ignores = _strings(data, "select"), data.get("per-file-ignores", [])
    if not isinstance(ignores, list) or not all(isinstance(x, dict) and set(x) == {"pattern", "ignore"} for x in ignores):
        raise ValueError("per-file-ignores are tables of pattern and ignore")
    severity = data.get("severity", {})
    if isinstance(severity, str):  # an old form: the least severity of all
        severity, data = {}, {"minimum_severity": severity, **data}
    policy = Policy(
        select=base.select if selected is None else {s.upper() for s in selected},
        ignore={s.upper() for s in _strings(data, "ignore") or ()},
        minimum_severity=data.get("minimum_severity", base.minimum_severity),
        min_confidence=data.get("min_confidence", base.min_confidence),
        severity={k.upper(): v for k, v in severity.items()},
        per_file_ignores={x["pattern"]: {s.upper() for s in _strings(x, "ignore") or ()} for x in ignores},
        thresholds=data.get("thresholds", {}),
        **{k: tuple(_strings(words, k) or ()) for k in _WORDS if k in words},
    )
    return Config(policy, tuple(_strings(data, "include") or INCLUDE), tuple(EXCLUDE if data.get("exclude") is None else _strings(data, "exclude")), path)


def load(path: Path | str | None = None, start: Path | str = ".") -> Config:
    """The configuration of a file, or of the nearest one; the defaults where there is none."""
    at = Path(path) if path else find(start)
    if at is None:
        return Config()
    data = tomllib.loads(at.read_text(encoding="utf-8"))
    if at.name == "pyproject.toml" or NAME in data.get("tool", {}):
        data = data.get("tool", {}).get(NAME, {})
    return parse(data, at)
