"""Contracts, migrations, owners, decisions, rules for agents and lock files."""

from __future__ import annotations

import json
import posixpath
import re

from cartograph.functions import lineage
from cartograph.sources.facts import Out, get, mapping, text
from cartograph.sources.readers import yaml

# HTTP methods of an OpenAPI path; states of a decision record.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
STATES = ("proposed", "accepted", "rejected", "deprecated", "superseded", "draft")


def proto(source: str, path: str, out: Out) -> None:
    code = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    if m := re.search(r"\bpackage\s+([\w.]+)\s*;", code):
        out.add("module", m[1], ecosystem="proto")
    for m in re.finditer(r"\bimport\s+(?:public\s+|weak\s+)?\"([^\"]+)\"\s*;", code):
        out.dep(m[1], "", "build", "proto", code.count("\n", 0, m.start()) + 1)
    stack: list[tuple[str, str]] = []
    for m in re.finditer(r"\b(message|service|enum)\s+(\w+)\s*\{|\brpc\s+(\w+)\s*\(|([{}])", code):
        line = code.count("\n", 0, m.start()) + 1
        if m[1]:
            outer = [n for k, n in stack if k == "message"]
            out.add("contract", ".".join([*outer, m[2]]), scope=m[1], line=line)
            stack.append((m[1], m[2]))
        elif m[3]:
            owner = next((n for k, n in reversed(stack) if k == "service"), "")
            out.add("contract", f"{owner}.{m[3]}", scope="rpc", line=line)
        elif m[4] == "{":
            stack.append(("", ""))
        elif stack:
            stack.pop()
    out.complete = not stack


def openapi(source: str, path: str, out: Out) -> None:
    if path.endswith(".json"):
        docs = [json.loads(source)]
    else:
        docs, out.complete = yaml.read(source)
    for d in docs:
        if not isinstance(d, dict) or not (d.get("openapi") or d.get("swagger")):
            continue
        out.add("module", get(d, "info", "title") or "", get(d, "info", "version") or "", ecosystem="openapi")
        for p, item in mapping(d.get("paths")).items():
            for m in mapping(item):
                if m.lower() in METHODS:
                    out.add("contract", f"{m.upper()} {p}", text(get(item, m, "operationId")), scope="endpoint")
        for name in {**mapping(get(d, "components", "schemas")), **mapping(d.get("definitions"))}:
            out.add("contract", name, scope="schema")
        for name in {**mapping(get(d, "components", "securitySchemes")), **mapping(d.get("securityDefinitions"))}:
            out.add("secret", name, scope="security")


def graphql(source: str, path: str, out: Out) -> None:
    code = re.sub(r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|#[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    for m in re.finditer(r"^[ \t]*(extend\s+)?(type|interface|input|enum|union|scalar|directive)\s+@?(\w+)([^{=\n]*)(\{(?:[^{}]|\{[^{}]*\})*\})?", code, re.M):
        kind, name, line = m[2], m[3], code.count("\n", 0, m.start()) + 1
        if name in ("Query", "Mutation", "Subscription") and m[5]:
            body = re.sub(r"\([^)]*\)", "", m[5][1:-1])
            for f in re.finditer(r"(\w+)\s*:", body):
                out.add("contract", f"{name}.{f[1]}", scope=name.lower(), line=line)
        elif not m[1]:
            out.add("contract", name, scope=kind, line=line)
    out.complete = code.count("{") == code.count("}")


def migration(source: str, path: str, out: Out) -> None:
    base = posixpath.basename(path)
    stem = re.sub(r"\.(sql|py|rb|js|ts|php|go|xml|ya?ml)$", "", base)
    direction = next((d for d in ("up", "down") if stem.endswith(f".{d}") or stem == d), "")
    stem = re.sub(r"\.(up|down)$", "", stem)
    m = re.match(r"[VURvur]?(\d[\d._]*?)(?:__|[_-])(.+)$", stem) or re.match(r"[Vv]?(\d[\d._]*)()$", stem)
    names, drops = [], False
    for s, _ in lineage.split(source) if path.endswith(".sql") else []:
        verb, name = lineage.subject(s)
        if verb in lineage.VERBS and name:
            names.append(name)
        drops |= lineage.destructive(s)
    out.add("migration", m[2].replace("_", " ").replace("-", " ") if m else stem, m[1] if m else "", scope=direction, items=list(dict.fromkeys(names)), destructive=drops)


def code_owners(source: str, path: str, out: Out) -> None:
    for n, line in enumerate(source.split("\n"), 1):
        row = re.sub(r"(^|\s)#.*$", "", line).split()
        if len(row) > 1 and not row[0].startswith("["):
            out.add("owner", row[0], line=n, items=row[1:])


def _rules(source: str, out: Out) -> list[str]:
    """A rule per list item or paragraph under its path of headings; fences are skipped."""
    heads: list[tuple[int, str]] = []
    part, start, fence, seen = [], 0, "", []

    def close():
        nonlocal part
        if part:
            out.add("rule", " > ".join(h for _, h in heads), " ".join(part), line=start)
        part = []

    for n, line in enumerate(source.split("\n"), 1):
        t = line.strip()
        if m := re.match(r"(```+|~~~+)", t):
            close()
            fence = "" if fence and t.startswith(fence) else fence or m[1]
        elif fence:
            continue
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", t):
            close()
            heads = [h for h in heads if h[0] < len(m[1])] + [(len(m[1]), m[2])]
            seen.append(m[2])
        elif not t:
            close()
        elif m := re.match(r"(?:[-*+]|\d+[.)])\s+(.*)$", t):
            close()
            part, start = [m[1]], n
        else:
            start = start if part else n
            part.append(t)
    close()
    return seen


def agent_rules(source: str, path: str, out: Out) -> None:
    _rules(source, out)


def decision(source: str, path: str, out: Out) -> None:
    """A decision record: number, title, state, and its rules."""
    heads = _rules(source, out)
    number = re.match(r"(\d+)", posixpath.basename(path))
    state = re.search(r"(?im)^(?:#+\s*status\s*\n+\s*|(?:\*\*)?status(?:\*\*)?\s*:(?:\*\*)?\s*|-\s*status\s*:\s*)\**([A-Za-z]+)", source)
    found = state[1].capitalize() if state and state[1].lower() in STATES else ""
    out.add("module", re.sub(r"^\d+[.:)]?\s*", "", heads[0]) if heads else posixpath.basename(path), number[1].lstrip("0") or "0" if number else "", scope="adr", status=found)


# Lock files and their ecosystems. They are recorded and deliberately left unread.
LOCKS = {
    "go.sum": "go", "package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "bun.lockb": "npm", "bun.lock": "npm", "poetry.lock": "pypi", "uv.lock": "pypi", "pdm.lock": "pypi",
    "Pipfile.lock": "pypi", "Cargo.lock": "crates.io", "Gemfile.lock": "rubygems", "composer.lock": "composer", "packages.lock.json": "nuget", "MODULE.bazel.lock": "bazel", ".terraform.lock.hcl": "terraform", "Chart.lock": "helm",
}


def lock(source: str, path: str, out: Out) -> None:
    out.add("lock", posixpath.basename(path), ecosystem=LOCKS[posixpath.basename(path)])
