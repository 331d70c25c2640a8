"""What a manifest says, as rows of one shape; a reader yields facts and notes what it couldn't read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from cartograph.functions.text import SENSITIVE


@dataclass
class Fact:
    """One statement of a manifest. ``fact`` says which: dep, module, script, entrypoint, workspace, alias, extends, target, service,
    service_dep, image, job, step, contract, migration, owner, rule, secret, namespace, lock."""

    fact: str
    name: str
    value: str = ""
    scope: str = ""
    ecosystem: str = ""
    line: int = 0
    items: list[str] = field(default_factory=list)
    attrs: dict[str, str] = field(default_factory=dict)


class Out(list):
    """Facts of one file, and whether all of it was read."""

    complete = True

    def add(self, fact: str, name, value="", scope: str = "", ecosystem: str = "", line: int = 0, items=(), **attrs) -> None:
        texts = {k: text(v) for k, v in attrs.items()}
        self.append(Fact(fact, text(name), text(value), scope, ecosystem, line, [text(x) for x in items], {k: v for k, v in texts.items() if v}))

    def dep(self, name, version="", scope: str = "runtime", ecosystem: str = "", line: int = 0, **attrs) -> None:
        if name:
            self.add("dep", name, version, scope, ecosystem, line, **attrs)


def text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else ""
    return v if isinstance(v, str) else ", ".join(map(text, v)) if isinstance(v, (list, tuple, set)) else str(v)


def get(tree, *path):
    """The value at a path of keys; None where any is missing."""
    for k in path:
        tree = tree.get(k) if isinstance(tree, dict) else None
    return tree


def mapping(v) -> dict:
    return v if isinstance(v, dict) else {}


def listing(v) -> list:
    return v if isinstance(v, list) else [] if v in (None, "") else [v]


def keys_of(v) -> list[str]:
    """Keys of an environment written as a map or as a list of KEY=value."""
    return [str(k) for k in v] if isinstance(v, dict) else [re.split(r"[=:]", x, maxsplit=1)[0].strip() if isinstance(x, str) else next(iter(x), "") if isinstance(x, dict) else "" for x in listing(v)]


def sensitive(name: str) -> bool:
    return any(w in name.lower() for w in SENSITIVE)
