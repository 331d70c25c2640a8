"""Readers of block languages: HCL, Starlark calls, CMake commands, JSON with comments."""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field


@dataclass
class Block:
    """An HCL block: its type and labels, attributes (text, list or map) and inner blocks."""

    kind: str
    labels: list[str]
    line: int
    attrs: dict = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)


_HCL = re.compile(
    r"(?P<skip>\s+|#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<here><<-?(?P<tag>\w+)\n.*?\n[ \t]*(?P=tag)\b)|(?P<string>\"(?:\\.|\$\{(?:[^{}]|\{[^{}]*\})*\}|[^\"\\])*\")|(?P<word>[A-Za-z_][\w.-]*)|(?P<number>-?[0-9][\w.]*)|(?P<sign>.)",
    re.S,
)


class _Hcl:
    def __init__(self, text: str):
        self.t = [(m.lastgroup if m.lastgroup != "tag" else "here", m[0], text.count("\n", 0, m.start()) + 1) for m in _HCL.finditer(text) if m.lastgroup != "skip"]
        self.i, self.complete = 0, True

    def at(self, sign: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][1] == sign

    def body(self, into: Block, closed: bool) -> None:
        while self.i < len(self.t):
            kind, text, line = self.t[self.i]
            if text == "}":
                self.i += closed
                self.complete &= closed
                if closed:
                    return
                self.i += 1
            elif kind in ("word", "string"):
                self.entry(into, text, line)
            else:
                self.complete, self.i = False, self.i + 1
        self.complete &= not closed

    def entry(self, into: Block, name: str, line: int) -> None:
        self.i += 1
        labels = []
        while self.i < len(self.t) and self.t[self.i][0] in ("word", "string") and not self.at("="):
            labels.append(self.t[self.i][1].strip('"'))
            self.i += 1
        if self.at("{"):
            self.i += 1
            block = Block(name, labels, line)
            into.blocks.append(block)
            self.body(block, True)
        elif self.at("=") or self.at(":"):
            self.i += 1
            into.attrs[name.strip('"')] = self.value()
        else:
            self.complete = False

    def value(self):
        """A literal, list or map; an expression is kept as text."""
        if self.at("["):
            self.i += 1
            out = []
            while self.i < len(self.t) and not self.at("]"):
                if self.at(","):
                    self.i += 1
                    continue
                out.append(self.value())
            self.i += 1
            return out
        if self.at("{"):
            self.i += 1
            block = Block("", [], 0)
            while self.i < len(self.t) and not self.at("}"):
                if self.at(","):
                    self.i += 1
                    continue
                kind, text, line = self.t[self.i]
                if kind in ("word", "string"):
                    self.entry(block, text, line)
                else:
                    self.i += 1
            self.i += 1
            return block.attrs
        kind, text, line = self.t[self.i] if self.i < len(self.t) else ("", "", 0)
        self.i += 1
        if kind == "here":
            return text.split("\n", 1)[1].rsplit("\n", 1)[0]
        parts, depth = [text], 0
        # An expression goes on over signs and calls on the same line.
        while self.i < len(self.t):
            k, s, n = self.t[self.i]
            follows = self.t[self.i + 1][1] if self.i + 1 < len(self.t) else ""
            if depth == 0 and (n != line or s in (",", "]", "}") or (k in ("word", "string") and follows == "=" and self.t[min(self.i + 2, len(self.t) - 1)][1] != "=")):
                break
            depth += (s in "([{") - (s in ")]}") if k == "sign" else 0
            parts.append(s)
            self.i += 1
        return text[1:-1] if kind == "string" and len(parts) == 1 else " ".join(parts).strip()


def hcl(text: str) -> tuple[Block, bool]:
    """(a block with the file's attributes and blocks, whether all was understood)."""
    r, top = _Hcl(text), Block("", [], 0)
    r.body(top, False)
    return top, r.complete


@dataclass
class Call:
    name: str
    line: int
    args: list = field(default_factory=list)
    kwargs: dict = field(default_factory=dict)


def _literal(n: ast.AST):
    """Text, lists and maps of literals; None for what would have to be worked out."""
    if isinstance(n, ast.Constant):
        return n.value
    if isinstance(n, (ast.List, ast.Tuple)):
        return [v for v in map(_literal, n.elts) if v is not None]
    if isinstance(n, ast.Dict):
        return {_literal(k): _literal(v) for k, v in zip(n.keys, n.values, strict=True) if k is not None}
    if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
        a, b = _literal(n.left), _literal(n.right)
        return a + b if isinstance(a, list) and isinstance(b, list) else a if b is None else b if a is None else None
    return None


def starlark(text: str) -> tuple[list[Call], bool]:
    """Calls at any depth with their literal arguments; nothing is evaluated."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], False
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ""
            out.append(Call(name, n.lineno, [_literal(a) for a in n.args], {k.arg: _literal(k.value) for k in n.keywords if k.arg}))
    return sorted(out, key=lambda c: c.line), True


_CMAKE = re.compile(r"(?P<skip>\s+|#\[(?P<q>=*)\[.*?\](?P=q)\]|#[^\n]*)|(?P<bracket>\[(?P<e>=*)\[.*?\](?P=e)\])|(?P<string>\"(?:\\.|[^\"\\])*\")|(?P<paren>[()])|(?P<word>(?:\\.|\$\{[^}]*\}|[^\s()#\"])+)", re.S)


def cmake(text: str) -> tuple[list[Call], bool]:
    """Commands with their arguments as text."""
    out: list[Call] = []
    depth, last = 0, ("", 0)
    for m in _CMAKE.finditer(text):
        kind, t = m.lastgroup, m[0]
        if kind in ("skip", "q"):
            continue
        if kind == "paren":
            depth += 1 if t == "(" else -1
            if depth == 1 and t == "(":
                out.append(Call(last[0].lower(), last[1]))
        elif depth <= 0:
            last = (t, text.count("\n", 0, m.start()) + 1)
        elif out:
            out[-1].args.append(t[1:-1] if kind == "string" else re.sub(r"^\[=*\[|\]=*\]$", "", t) if kind in ("bracket", "e") else t)
    return out, depth == 0


def jsonc(text: str):
    """JSON with comments and trailing commas; ValueError where it isn't."""
    keep = r"(?P<s>\"(?:\\.|[^\"\\])*\")"
    text = re.sub(keep + r"|//[^\n]*|/\*.*?\*/", lambda m: m["s"] or " ", text, flags=re.S)
    return json.loads(re.sub(keep + r"|,(?=\s*[}\]])", lambda m: m["s"] or "", text, flags=re.S))
