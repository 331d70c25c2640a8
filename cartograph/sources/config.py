"""Settings of a repository: one YAML mapping in its root. Keys that would let a file weaken its own checks are refused by name."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, fields
from pathlib import Path

from cartograph.sources.readers import yaml

FILE = ".cartograph.yml"
# Keys that a file may not set, and why in a word.
REFUSED = {
    "as_of_bundle": "decides whether verification fails", "fail_on_cycle": "decides whether a check fails", "semantic": "spends tokens and sends source away", "semantic_timeout": "bounds one run",
    "quiet": "belongs to one invocation", "verbose": "belongs to one invocation", "top": "belongs to one invocation", "all": "belongs to one invocation", "format": "belongs to one invocation",
    "o": "belongs to one invocation", "output": "belongs to one invocation", "openai": "credentials come from the environment", "api_key": "credentials come from the environment", "budget": "is not a setting of a file",
}


@dataclass
class Config:
    include_vendored: bool = False
    include_fixtures: bool = False
    ignore: list[str] = field(default_factory=list)
    no_history: bool = False
    max_commits: int = 0
    repo: str = ""
    backend: str = ""
    model: str = ""
    hooks: dict[str, str] = field(default_factory=dict)


def _strings(v) -> bool:
    return any(map(_strings, v)) if isinstance(v, list) else any(map(_strings, v.values())) if isinstance(v, dict) else "${" in str(v)


def parse(text: str) -> Config:
    """Settings of a document; ValueError with the line for what can't be set or read."""
    docs, whole = yaml.read(text)
    if not whole:
        raise ValueError(f"{FILE}: not all of it can be read")
    if not docs:
        return Config()
    doc, out = docs[0], Config()
    if not isinstance(doc, yaml.Map):
        raise ValueError(f"{FILE}: the document is no mapping of keys to values")
    known = {f.name: f for f in fields(Config)}
    for key, value in doc.items():
        line = doc.lines.get(key, 0)
        if _strings(value):
            raise ValueError(f"{FILE}:{line}: ${{...}} isn't expanded; what differs by machine belongs to the environment")
        if key in REFUSED:
            raise ValueError(f"{FILE}:{line}: {key} can't be set by a file: it {REFUSED[key]}")
        if key not in known:
            near = difflib.get_close_matches(key, known, 1)
            raise ValueError(f"{FILE}:{line}: nothing reads {key}" + (f"; did you mean {near[0]}?" if near else ""))
        kind = type(getattr(out, key))
        if kind is bool:
            if str(value).lower() not in ("true", "false"):
                raise ValueError(f"{FILE}:{line}: {key} is true or false")
            value = str(value).lower() == "true"
        elif kind is int:
            if not str(value).isdigit():
                raise ValueError(f"{FILE}:{line}: {key} is a whole number")
            value = int(value)
        elif kind is list:
            value = [value] if isinstance(value, str) and value else value
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ValueError(f"{FILE}:{line}: {key} is a list of texts")
        elif not isinstance(value, kind):
            raise ValueError(f"{FILE}:{line}: {key} is of the wrong form")
        setattr(out, key, value)
    return out


def load(root: str) -> Config:
    """Settings of a repository; defaults where it has no file."""
    at = Path(root) / FILE
    if (Path(root) / FILE.replace(".yml", ".yaml")).exists():
        raise ValueError(f"the file is named {FILE}")
    return parse(at.read_text(encoding="utf-8")) if at.exists() else Config()
