"""Symbols, imports and queries of source text, language by language.

Python is parsed (a file that can't be is read by lines). Languages of braces are walked as headers: the code before each ``{``, ``;``
or, where lines end statements, line end, with the scopes that are open. Ruby, the shell and PowerShell have readers of their own. All
stand on ``lexer.scan``, so nothing in a comment or literal is read as code. What can't be read in full gives incomplete facts, never an error.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.functions import lineage
from cartograph.sources.lexer import Scan, first_sentence, scan


@dataclass
class Facts:
    package: str = ""
    imports: list[tuple[str, str, list[str], int]] = field(default_factory=list)  # raw, alias, names, line
    symbols: list[tuple[str, str, str, bool, int, str]] = field(default_factory=list)  # name, kind, receiver, exported, line, doc
    entrypoints: list[str] = field(default_factory=list)
    queries: list[tuple[str, str, int]] = field(default_factory=list)  # table, access, line
    unnamed_queries: int = 0
    incomplete: bool = False


@dataclass
class Scope:
    kind: str  # file, namespace, type, face, impl, trait, func, block
    name: str = ""
    shown: bool = True
    access: str = ""


@dataclass
class Header:
    """Code before a brace, semicolon or line end: blanked, with its strings, and where it stands."""

    code: str
    text: str
    line: int
    end: str  # the sign that ended it
    scopes: list[Scope]

    @property
    def inner(self) -> Scope:
        return self.scopes[-1]

    @property
    def open(self) -> bool:
        """Whether declarations count here: no function or plain block is open."""
        return all(s.kind not in ("func", "block") for s in self.scopes)


SAME = {"javascript": "typescript", "vue": "typescript", "svelte": "typescript", "astro": "typescript", "cpp": "c", "objc": "c"}
#: Languages whose statements end with the line.
LINES = ("go", "kotlin", "typescript")
#: Headers whose braces hold a list and no scope.
LISTS = {"typescript": r"\s*(import|export)\b(\s+type)?\s*(\w+\s*,\s*)?$", "rust": r"\s*(pub(\([^)]*\))?\s+)?use\b[^;]*$", "php": r"\s*use\b[^;]*$"}


def headers(s: Scan, lang: str, push: Callable[[Header], Scope]) -> bool:
    """Walk the headers of a scan; ``push`` reads one and says which scope its brace opens. False where braces don't pair."""
    scopes, start, depth = [Scope("file")], 0, 0
    code, i, n = s.code, 0, len(s.code)
    paired = True

    def header(end: str, upto: int) -> Header:
        lead = len(code[start:upto]) - len(code[start:upto].lstrip())
        return Header(code[start + lead : upto], s.text[start + lead : upto], s.line(start + lead), end, scopes)

    while i < n:
        c = code[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == "{":
            if lang in LISTS and re.match(LISTS[lang], code[start:i]):
                level = 1
                while level and i + 1 < n:
                    i += 1
                    level += (code[i] == "{") - (code[i] == "}")
            elif depth and lang not in ("go",):
                # A body within parentheses (a lambda, an object): nothing in it is a declaration of the file.
                level = 1
                while level and i + 1 < n:
                    i += 1
                    level += (code[i] == "{") - (code[i] == "}")
            else:
                scopes.append(push(header("{", i)))
                start = i + 1
        elif c == "}":
            if code[start:i].strip() and lang != "c":
                push(header("}", i))
            if len(scopes) > 1:
                scopes.pop()
            else:
                paired = False
            start, depth = i + 1, 0
        elif c == ";" and depth == 0:
            push(header(";", i))
            start = i + 1
        elif c == "\n" and lang in LINES and depth == 0 and code[start:i].strip():
            rest = code[i:].lstrip()[:2]
            last = code[start:i].rstrip()[-1:]
            goes_on = last in ",+-*/=<>&|?:." and not (lang == "go" and last in "*") or rest[:1] in ".?" or (rest[:1] == "{" and lang != "go") or (lang == "typescript" and rest == "=>")
            if not goes_on:
                push(header("\n", i))
                start = i + 1
        i += 1
    if code[start:].strip():
        push(header("", n))
    return paired and len(scopes) == 1


BLOCK = r"(?:if|else|for|while|do|switch|try|catch|finally|return|throw|new|case|default|synchronized|using|lock|foreach|match|loop|unsafe|static|init|when|with|guard|defer|go|select)\b"


class Reader:
    """Collects facts of one file."""

    def __init__(self, s: Scan, lang: str, source: str = ""):
        self.s, self.lang, self.f = s, lang, Facts()
        #: The interpreter that a first line names, '' without.
        self.shebang = re.split(r"[/\s]", source.split("\n", 1)[0].strip())[-1] if source.startswith("#!") else ""

    def add(self, h: Header | int, name: str, kind: str, shown: bool, recv: str = "") -> None:
        line = h if isinstance(h, int) else h.line
        if name and name != "_":
            self.f.symbols.append((name, kind, recv, shown, line, self.s.doc(line)))

    def imported(self, raw: str, line: int, alias: str = "", names: list[str] | tuple[str, ...] = ()) -> None:
        if raw:
            self.f.imports.append((raw, alias or "", [x for x in names if x], line))


def literal(text: str) -> str:
    """The first string literal's body in a header's text."""
    m = re.search(r"[\"'`]([^\"'`]*)[\"'`]", text)
    return m[1] if m else ""


def go(r: Reader) -> bool:
    s = r.s
    if m := re.search(r"^package\s+(\w+)", s.code, re.M):
        r.f.package = m[1]
    done = s.code
    for m in re.finditer(r"^import\s*(\(.*?^\s*\)|[^\n(]*$)", s.code, re.M | re.S):
        body = s.text[m.start(1) : m.end(1)].strip("()")
        for k, row in enumerate(body.split("\n")):
            if x := re.match(r"\s*([\w.]+\s+)?[\"`]([^\"`]+)[\"`]", row):
                r.imported(x[2], s.line(m.start(1)) + k, (x[1] or "").strip())
        done = done[: m.start()] + re.sub(r"[^\n]", " ", m[0]) + done[m.end() :]
    for m in re.finditer(r"^(type|const|var)\s*\((.*?)^\)", done, re.M | re.S):
        level = 0
        for k, row in enumerate(m[2].split("\n")):
            if level == 0 and (x := re.match(r"\s*(\w+(?:\s*,\s*\w+)*)\b", row)):
                for name in re.split(r"\s*,\s*", x[1]):
                    r.add(s.line(m.start(2)) + k, name, m[1], name[:1].isupper())
            level += sum(row.count(c) for c in "{([") - sum(row.count(c) for c in "})]")
        done = done[: m.start()] + re.sub(r"[^\n]", " ", m[0]) + done[m.end() :]

    def push(h: Header) -> Scope:
        if len(h.scopes) == 1:
            if m := re.match(r"func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(\[[^\]]*\]\s*)?\(([^)]*)\)(.*)$", h.code, re.S):
                recv, name = m[1] or "", m[2]
                r.add(h, name, "method" if recv else "func", name[:1].isupper() and (not recv or recv[:1].isupper()), recv)
                if not recv and (name == "main" and r.f.package == "main" or name == "init" and not m[4].strip() and not m[5].strip()):
                    r.f.entrypoints.append(name)
                return Scope("func", name)
            if m := re.match(r"(type|const|var)\s+(\w+(?:\s*,\s*\w+)*)", h.code):
                for name in re.split(r"\s*,\s*", m[2]):
                    r.add(h, name, m[1], name[:1].isupper())
        return Scope("block")

    return headers(Scan(done, s.text), "go", push)


def typescript(r: Reader) -> bool:
    s, listed = r.s, {}
    for m in re.finditer(r"\b(?:require|import)\s*\(\s*[\"'`]", s.code):
        r.imported(literal(s.text[m.end() - 1 : m.end() + 500].split("\n")[0]), s.line(m.start()))
    if "node" in r.shebang or r.shebang in ("deno", "bun", "tsx", "ts-node"):
        r.f.entrypoints.append(r.shebang)

    def push(h: Header) -> Scope:
        c = h.code
        if h.open and (m := re.match(r"(import|export)\b", c)) and re.search(r"\bfrom\s*[\"']|^import\s*[\"']", c):
            names = re.search(r"\{([^}]*)\}", c)
            picked = [re.split(r"\s+as\s+", x.strip().removeprefix("type "))[0] for x in names[1].split(",")] if names else []
            star = re.search(r"\*\s+as\s+(\w+)", c)
            r.imported(literal(h.text), h.line, star[1] if star else "", picked)
            return Scope("block")
        if len(h.scopes) > 1:
            return Scope("block")
        if m := re.match(r"export\s*(?:type\s*)?\{([^}]*)\}", c):
            for x in m[1].split(","):
                own, _, shown = x.strip().partition(" as ")
                if own:
                    listed[own.strip().removeprefix("type ")] = shown.strip()
            return Scope("block")
        out = re.match(r"(export\s+)?(default\s+)?(declare\s+)?", c)
        body, shown = c[out.end() :], bool(out[1])
        if m := re.match(r"(?:async\s+)?function\b\s*\*?\s*(\w+)?", body):
            r.add(h, m[1] or ("default" if out[2] else ""), "func", shown)
        elif m := re.match(r"(?:abstract\s+)?(class|interface|enum|const\s+enum)\b\s*((?!extends\b|implements\b)\w+)?", body):
            r.add(h, m[2] or ("default" if out[2] else ""), "type", shown)
        elif m := re.match(r"type\s+(\w+)\s*(<[^=]*>)?\s*=", body):
            r.add(h, m[1], "type", shown)
        elif m := re.match(r"(const|let|var)\s+(\w+)", body):
            r.add(h, m[2], "const" if m[1] == "const" else "var", shown)
        elif m := re.match(r"(?:namespace|module)\s+([\w.]+)", body):
            r.add(h, m[1], "type", shown)
        elif out[2]:
            r.add(h, "default", "var", True)
        return Scope("block")

    paired = headers(s, "typescript", push)
    r.f.symbols = [(n, k, v, x or n in listed, line, d) for n, k, v, x, line, d in r.f.symbols]
    return paired


def use_tree(t: str) -> list[tuple[str, str]]:
    """(path, alias) of each leaf of a Rust use tree."""
    t = t.strip()
    if m := re.match(r"([^{]*?)(?:::)?\s*\{(.*)\}$", t, re.S):
        parts, level, last = [], 0, 0
        for i, c in enumerate(m[2] + ","):
            level += (c == "{") - (c == "}")
            if c == "," and level == 0:
                parts.append(m[2][last:i])
                last = i + 1
        head = m[1].strip()
        out = []
        for p in parts:
            for path, alias in use_tree(p) if p.strip() else []:
                out.append((head if path == "self" else "::".join(x for x in (head, path) if x), alias))
        return out
    path, _, alias = t.partition(" as ")
    return [(re.sub(r"\s+", "", path).removeprefix("::"), alias.strip())]


def rust(r: Reader) -> bool:
    def push(h: Header) -> Scope:
        c = re.sub(r"#!?\[[^\]]*\]\s*", "", h.code).strip()
        m = re.match(r"(pub(?:\s*\([^)]*\))?\s+)?", c)
        shown, body = (m[1] or "").strip() == "pub", c[m.end() :]
        shown_here = shown and all(x.shown for x in h.scopes)
        if not h.open:
            return Scope("block")
        if m := re.match(r"use\s+(.*)$", body, re.S):
            for path, alias in use_tree(m[1]):
                r.imported(path, h.line, alias)
        elif m := re.match(r"extern\s+crate\s+(\w+)(?:\s+as\s+(\w+))?", body):
            r.imported(m[1], h.line, m[2] or "")
        elif m := re.match(r"mod\s+(\w+)", body):
            if h.end == ";":
                r.imported(f"self::{m[1]}", h.line)
            r.add(h, m[1], "type", shown)
            return Scope("namespace", m[1], shown)
        elif m := re.match(r"(?:unsafe\s+)?impl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*(.*)$", body, re.S):
            trait, _, target = m[1].partition(" for ") if " for " in m[1] else ("", "", m[1])
            name = re.match(r"[&\s]*(?:mut\s+)?(?:\w+::)*(\w+)", target.strip())
            return Scope("trait" if trait else "impl", name[1] if name else "")
        elif m := re.match(r"(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", body):
            owner = h.inner if h.inner.kind in ("impl", "trait", "face") else None
            r.add(h, m[1], "method" if owner else "func", True if owner and owner.kind in ("trait", "face") else shown if owner else shown_here, owner.name if owner else "")
            if m[1] == "main" and len(h.scopes) == 1:
                r.f.entrypoints.append("main")
            return Scope("func", m[1])
        elif m := re.match(r"(?:unsafe\s+)?(struct|enum|union|trait|type)\s+(\w+)", body):
            if h.inner.kind in ("file", "namespace"):
                r.add(h, m[2], "type", shown_here)
            return Scope("face" if m[1] == "trait" else "block", m[2])
        elif (m := re.match(r"(const|static)\s+(?:mut\s+)?(\w+)\s*:", body)) and h.inner.kind in ("file", "namespace"):
            r.add(h, m[2], "const", shown_here)
        return Scope("block")

    return headers(r.s, "rust", push)


MODIFIERS = r"(?:(?:public|protected|private|internal|abstract|final|static|sealed|non-sealed|strictfp|default|synchronized|native|transient|volatile|partial|readonly|virtual|override|async|extern|unsafe|new|required|file|ref)\s+)*"


def split_import(path: str) -> tuple[str, str]:
    """(package, symbol) of a dotted name: the package ends before the first capital."""
    parts = path.removesuffix(".*").split(".")
    k = next((i for i, p in enumerate(parts) if p[:1].isupper()), len(parts))
    return ".".join(parts[:k]) or path, parts[k] if k < len(parts) else "*" if path.endswith("*") else ""


def java(r: Reader) -> bool:
    def push(h: Header) -> Scope:
        c = re.sub(r"@(?!interface\b)[\w.]+(\s*\((?:[^()]|\([^()]*\))*\))?\s*", "", h.code).strip()
        if m := re.match(r"package\s+([\w.]+)", c):
            r.f.package = m[1]
        elif m := re.match(r"import\s+(?:static\s+)?([\w.]+(?:\.\*)?)", c):
            raw, name = split_import(m[1])
            r.imported(raw, h.line, "", [name])
        elif h.open and (m := re.match(rf"({MODIFIERS})(class|interface|enum|record|@interface)\s+(\w+)", c)):
            shown = ("public" in m[1] or h.inner.kind == "face") and all(s.shown for s in h.scopes)
            r.add(h, m[3], "type", shown, "")
            return Scope("face" if "interface" in m[2] else "type", m[3], shown)
        elif h.open and h.inner.kind in ("type", "face") and (m := re.match(rf"({MODIFIERS})(?:<[^>]*>\s*)?[\w<>\[\],.?&\s]+?[\s\]>](\w+)\s*\(", c)) and not re.match(BLOCK, c.replace("static", "", 1).strip()) and "=" not in c.split("(")[0]:
            if m[2] != h.inner.name:
                shown = ("public" in m[1] or (h.inner.kind == "face" and "private" not in m[1])) and all(s.shown for s in h.scopes)
                r.add(h, m[2], "method", shown, h.inner.name)
                if m[2] == "main" and "public" in m[1] and "static" in m[1]:
                    r.f.entrypoints.append(f"{h.inner.name}.main")
            return Scope("func", m[2])
        return Scope("block")

    return headers(r.s, "java", push)


def kotlin(r: Reader) -> bool:
    words = r"((?:(?:public|internal|private|protected|open|abstract|data|sealed|enum|annotation|inline|value|override|suspend|operator|infix|tailrec|external|expect|actual|const|lateinit|inner|fun(?=\s+interface)|companion)\s+)*)"

    def push(h: Header) -> Scope:
        c = re.sub(r"@[\w.:]+(\s*\((?:[^()]|\([^()]*\))*\))?\s*", "", h.code).strip()
        if m := re.match(r"package\s+([\w.]+)", c):
            r.f.package = m[1]
            return Scope("block")
        if m := re.match(r"import\s+([\w.]+(?:\.\*)?)(?:\s+as\s+(\w+))?", c):
            raw, name = split_import(m[1])
            r.imported(raw, h.line, m[2] or "", [name])
            return Scope("block")
        if not h.open:
            return Scope("block")
        m = re.match(words, c)
        body, mods = c[m.end() :], m[1]
        shown = not re.search(r"\b(private|internal|protected)\b", mods) and all(s.shown for s in h.scopes)
        owner = h.inner.name if h.inner.kind in ("type", "face") else ""
        if m := re.match(r"(class|interface|object)\b\s*(\w+)?", body):
            if "companion" in mods:
                return Scope("type", owner, shown)
            r.add(h, m[2] or "", "type", shown)
            if p := re.search(r"\(((?:[^()]|\([^()]*\))*)\)", body):
                for x in re.finditer(r"((?:private|internal|protected)\s+)?(?:val|var)\s+(\w+)", p[1]):
                    r.add(h, x[2], "var", shown and not x[1], m[2] or "")
            return Scope("face" if m[1] == "interface" else "type", m[2] or "", shown)
        if m := re.match(r"fun\s+(?:<[^>]*>\s*)?(?:([\w<>?,. ]+?)\.)?(\w+)\s*\(", body):
            recv = re.match(r"\w+", m[1])[0] if m[1] else owner
            r.add(h, m[2], "method" if recv else "func", shown, recv)
            if m[2] == "main" and len(h.scopes) == 1:
                r.f.entrypoints.append("main")
            return Scope("func", m[2])
        if (m := re.match(r"(val|var)\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", body)) and h.inner.kind in ("file", "type", "face"):
            r.add(h, m[2], "const" if "const" in mods else "var", shown, owner)
        elif (m := re.match(r"typealias\s+(\w+)", body)) and h.inner.kind == "file":
            r.add(h, m[1], "type", shown)
        return Scope("block")

    return headers(r.s, "kotlin", push)


def csharp(r: Reader) -> bool:
    def push(h: Header) -> Scope:
        c = re.sub(r"(?m)^\s*#.*$", "", h.code)
        c = re.sub(r"^\s*(?:\[[^\]]*\]\s*)+", "", c).strip()
        if m := re.match(r"namespace\s+([\w.]+)", c):
            r.f.package = r.f.package or m[1]
            return Scope("namespace", m[1])
        if h.inner.kind in ("file", "namespace") and (m := re.match(r"(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)$", c)):
            r.imported(m[2], h.line, m[1] or "")
            return Scope("block")
        if not h.open:
            return Scope("block")
        if m := re.match(rf"({MODIFIERS})(class|interface|struct|enum|record(?:\s+(?:class|struct))?|delegate\s+[\w<>\[\],.?]+)\s+(\w+)", c):
            shown = ("public" in m[1] or h.inner.kind == "face") and all(s.shown for s in h.scopes)
            r.add(h, m[3], "type", shown)
            return Scope("block" if m[2] == "enum" else "face" if m[2] == "interface" else "type", m[3], shown)
        if h.inner.kind in ("type", "face"):
            head = c.split("=>")[0]
            if (m := re.match(rf"({MODIFIERS})[\w<>\[\],.?\s()]*?[\w>\]?)]\s+(?:[\w.]+\.)?(\w+)\s*(?:<[^>]*>)?\s*\(", head)) and "=" not in head.split("(")[0] and not re.match(BLOCK.replace("static|", ""), c):
                if m[2] != h.inner.name:
                    self_shown = ("public" in m[1] or h.inner.kind == "face") and all(s.shown for s in h.scopes)
                    r.add(h, m[2], "method", self_shown, h.inner.name)
                    if m[2] == "Main" and "static" in m[1]:
                        r.f.entrypoints.append(f"{h.inner.name}.Main")
                return Scope("func", m[2])
            if (h.end == "{" or "=>" in c) and (m := re.match(rf"({MODIFIERS})[\w<>\[\],.?]+\s+(\w+)\s*$", head)):
                r.add(h, m[2], "method", ("public" in m[1] or h.inner.kind == "face") and all(s.shown for s in h.scopes), h.inner.name)
                return Scope("func", m[2])
        return Scope("block")

    return headers(r.s, "csharp", push)


def php(r: Reader) -> bool:
    def push(h: Header) -> Scope:
        c = re.sub(r"#\[[^\]]*\]", "", h.code).strip()
        if m := re.match(r"namespace\s+([\w\\]+)", c):
            r.f.package = r.f.package or m[1]
            return Scope("namespace", m[1])
        if h.inner.kind in ("file", "namespace") and (m := re.match(r"use\s+(?:function\s+|const\s+)?(.*)$", c, re.S)):
            base, _, group = m[1].partition("{")
            for x in (group.rstrip("} \n") if group else m[1]).split(","):
                name, _, alias = x.strip().partition(" as ")
                full = ((base.strip() if group else "") + name.strip()).lstrip("\\")
                if "\\" in full:
                    r.imported(full, h.line, alias.strip())
            return Scope("block")
        if m := re.match(r"(?:require|include)(?:_once)?\b", c):
            r.imported(literal(h.text).lstrip("/") if literal(h.text) else "", h.line)
            return Scope("block")
        if not h.open:
            return Scope("block")
        if m := re.match(r"(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+(\w+)", c):
            r.add(h, m[2], "type", True)
            return Scope("type", m[2])
        if m := re.match(r"((?:(?:public|protected|private|static|abstract|final)\s+)*)function\s+&?\s*(\w+)", c):
            owner = h.inner.name if h.inner.kind == "type" else ""
            r.add(h, m[2], "method" if owner else "func", not re.search(r"private|protected", m[1]), owner)
            return Scope("func", m[2])
        if m := re.match(r"((?:(?:public|protected|private|final)\s+)*)const\s+(?:\w+\s+)?(\w+)\s*=", c):
            r.add(h, m[2], "const", not re.search(r"private|protected", m[1]), h.inner.name if h.inner.kind == "type" else "")
        return Scope("block")

    return headers(r.s, "php", push)


def c_family(r: Reader) -> bool:
    s = r.s
    for m in re.finditer(r"^[ \t]*#[ \t]*(?:include|import)[ \t]*", s.code, re.M):
        rest = s.text[m.end() :].split("\n", 1)[0].strip()
        if x := re.match(r"(<[^>]+>|\"[^\"]+\")", rest):
            r.imported(x[1], s.line(m.start()))
    for m in re.finditer(r"@import\s+([\w.]+)", s.code):
        r.imported(f"<{m[1].split('.')[0]}/{m[1].split('.')[0]}.h>", s.line(m.start()))
    plain = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), s.code)
    for m in re.finditer(r"^[ \t]*@(interface|protocol)\s+(\w+)\s*(\([^)]*\))?", plain, re.M):
        if not m[3]:
            r.add(s.line(m.start()), m[2], "type", True)
        body = plain[m.end() : plain.find("@end", m.end()) if "@end" in plain[m.end() :] else len(plain)]
        for x in re.finditer(r"^[ \t]*[-+]\s*\([^)]*\)\s*(\w+)", body, re.M):
            r.add(s.line(m.end() + x.start(1)), x[1], "method", True, m[2])
    unnamed: list[int] = []  # depth of the typedef whose names follow its brace
    plain = re.sub(r"@(interface|protocol|implementation)\b.*?@end", lambda m: re.sub(r"[^\n]", " ", m[0]), plain, flags=re.S)

    def push(h: Header) -> Scope:
        c = h.code.strip()
        while m := re.match(r"(public|protected|private)\s*:(?!:)\s*", c):
            h.inner.access, c = m[1], c[m.end() :]
        c = re.sub(r"^template\s*<(?:[^<>]|<[^<>]*>)*>\s*|^extern\s+\"[^\"]*\"\s*|\b(?:__attribute__\s*\(\(.*?\)\)|__declspec\([^)]*\)|[A-Z_]+_(?:API|EXPORT))\s*", "", c)
        if unnamed and h.end == ";" and len(h.scopes) == unnamed[0] and re.fullmatch(r"[\w\s,*]+", c):
            # The names of a type that was declared before its brace.
            for name in re.findall(r"\w+", c):
                r.add(h, name, "type", all(x.shown for x in h.scopes))
            unnamed.clear()
            return Scope("block")
        if not h.open or not c and h.end != "{":
            return Scope("block")
        if m := re.match(r"(?:inline\s+)?namespace\b\s*([\w:]*)", c):
            if m[1]:
                r.f.package = r.f.package or "::".join([*(x.name for x in h.scopes if x.kind == "namespace" and x.name), m[1]])
            return Scope("namespace", m[1], bool(m[1]))
        if not c:
            return Scope("namespace")  # extern "C"
        shown = all(x.shown for x in h.scopes) and h.inner.access in ("", "public")
        if (m := re.match(r"(typedef\s+)?(?:static\s+)?(struct|class|union|enum(?:\s+(?:class|struct))?)\b\s*(?:alignas\([^)]*\)\s*)?(\w+)?\s*(?:final\s*)?(?::[^:].*)?$", c, re.S)) and h.end == "{":
            if m[3]:
                r.add(h, m[3], "type", shown)
            unnamed[:] = [len(h.scopes)] if m[1] else []
            return Scope("block" if m[2].startswith("enum") else "type", m[3] or "", shown, "private" if m[2] == "class" else "public")
        if m := re.match(r"typedef\b.*?(\w+)\s*(?:\[[^\]]*\])?$", c, re.S):
            f = re.search(r"\(\s*\*\s*(\w+)\s*\)", c)
            r.add(h, f[1] if f else m[1], "type", shown)
            return Scope("block")
        if (m := re.match(r"using\s+(\w+)\s*=", c)) and h.inner.kind in ("file", "namespace"):
            r.add(h, m[1], "type", shown)
            return Scope("block")
        if not re.match(r"(?:return|else|if|for|while|switch|do|case|goto|using|delete|throw)\b", c) and (m := re.match(r"([\w:*&<>,\s\[\]~]*?)\b(?:(\w+)(?:<[^>]*>)?::)?(~?\w+|operator\s*[^\s(]+)\s*\(", c)):
            before, outer, name = m[1].strip(), m[2], m[3]
            tail = c[m.end() :]
            if "=" in before or (not before and not outer and h.inner.kind != "type") or re.fullmatch(r"[A-Z_0-9]+", name) and not before:
                return Scope("block")
            if h.end in ("{", ";") and "=" not in tail.split(")")[0]:
                owner = outer or (h.inner.name if h.inner.kind == "type" else "")
                if name.lstrip("~") != owner:
                    r.add(h, name, "method" if owner else "func", False if outer else shown and not re.search(r"\bstatic\b", before) or (shown and h.inner.kind == "type"), owner)
                if name == "main" and h.inner.kind == "file" and h.end == "{":
                    r.f.entrypoints.append("main")
                return Scope("func", name)
        return Scope("block")

    return headers(Scan(plain, s.text), "c", push)


def ruby(r: Reader) -> bool:
    s = r.s
    scopes: list[tuple[str, str]] = []  # kind, name
    hidden: list[bool] = [False]
    longest = ""
    opener = re.compile(r"^\s*(?:if|unless|case|while|until|for|begin)\b|\bdo\b\s*(\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")
    for n, (line, raw) in enumerate(zip(s.code.split("\n"), s.text.split("\n"), strict=True), 1):
        if m := re.match(r"\s*require(_relative)?\b", line):
            body = literal(raw)
            r.imported(("./" if m[1] and not body.startswith(".") else "") + body if body else "", n)
        if m := re.match(r"\s*(class|module)\s+(?!<<)([\w:]+)", line):
            scopes.append((m[1], m[2]))
            hidden.append(False)
            name = "::".join(x for k, x in scopes if k in ("class", "module"))
            longest = max(longest, name, key=len)
            r.add(n, m[2], "type", True)
            if re.search(r";\s*end\s*$", line):
                scopes.pop()
                hidden.pop()
            continue
        if re.match(r"\s*class\s*<<", line):
            scopes.append(("class<<", next((x for k, x in reversed(scopes) if k in ("class", "module")), "")))
            hidden.append(False)
            continue
        owner = next((x for k, x in reversed(scopes) if k in ("class", "module", "class<<")), "")
        in_type = not scopes or scopes[-1][0] in ("class", "module", "class<<")
        if m := re.match(r"\s*(private\s+|protected\s+|public\s+)?def\s+(?:(self|[A-Z]\w*)\.)?([\w]+[?!=]?|[^\s(\w]+)", line):
            if in_type:
                r.add(n, m[3], "method" if owner else "func", not (hidden[-1] or (m[1] or "").strip() in ("private", "protected")), owner)
            if not re.match(r"\s*(?:\w+\s+)?def\s+[^\s(=]+(?:\([^)]*\))?\s*=\s", line) and not re.search(r";\s*end\s*$", line):
                scopes.append(("def", m[3]))
                hidden.append(hidden[-1])
            continue
        if in_type and (m := re.match(r"\s*(private|protected|public)\s*$", line)):
            hidden[-1] = m[1] != "public"
        elif in_type and (m := re.match(r"\s*attr_(?:reader|writer|accessor)\s+(.*)$", line)):
            for x in re.findall(r":(\w+)", m[1]):
                r.add(n, x, "method", not hidden[-1], owner)
        elif in_type and (m := re.match(r"\s*([A-Z]\w*)\s*=(?!=)", line)):
            r.add(n, m[1], "const", True, owner)
        if opener.search(line) and not re.search(r"\bend\s*$", line):
            scopes.append(("block", ""))
            hidden.append(hidden[-1])
        elif re.match(r"\s*end\b", line) and scopes:
            scopes.pop()
            hidden.pop()
    r.f.package = longest
    return not scopes


def shell(r: Reader) -> bool:
    s = r.s
    if r.shebang:
        r.f.entrypoints.append("shebang")
    for n, (line, raw) in enumerate(zip(s.code.split("\n"), s.text.split("\n"), strict=True), 1):
        if m := re.match(r"\s*(?:source|\.)\s+", line):
            word = re.match(r"\"[^\"]*\"|'[^']*'|\S+", raw[m.end() :])
            path = word[0].strip("\"'") if word else ""
            # A path anchored at the script's own directory is literal from there; any other expansion isn't known.
            path = re.sub(r"^(\$\{?\w*(?:DIR|dir|HERE|here)\w*\}?|\$\(dirname[^)]*\)|\$\(cd[^)]*\)|\$\{BASH_SOURCE%/\*\})/", "./", path)
            r.imported(path if not re.search(r"[$`]", path) else "", n)
        elif (m := re.match(r"\s*(?:function\s+)?([\w-]+)\s*\(\s*\)", line)) or (m := re.match(r"\s*function\s+([\w-]+)", line)):
            r.add(n, m[1], "func", not m[1].startswith("_"))
        elif m := re.match(r"(?:export|readonly|declare(?:\s+-\w+)*|typeset(?:\s+-\w+)*)\s+(\w+)", line):
            r.add(n, m[1], "var", not m[1].startswith("_"))
    return True


def powershell(r: Reader) -> bool:
    s, listed, depth, owner = r.s, None, 0, ("", -1)
    if r.shebang:
        r.f.entrypoints.append("shebang")
    for n, c in s.comments.items():
        if m := re.match(r"#requires\s+-modules?\s+(.*)$", c, re.I):
            for x in re.findall(r"[\w.-]+", m[1]):
                r.imported(x, n)
    for m in re.finditer(r"(?im)^\s*Export-ModuleMember\b(.*)$", s.text):
        listed = (listed or set()) | {x.strip("'\"") for x in re.findall(r"[\w*'\"-]+", re.sub(r"(?<!\S)-\w+", " ", m[1]))}
    for n, (line, raw) in enumerate(zip(s.code.split("\n"), s.text.split("\n"), strict=True), 1):
        if m := re.match(r"(?i)\s*(?:using\s+(?:module|namespace)\s+|Import-Module\s+(?:-Name\s+)?|\.\s+)(.*)$", raw):
            word = re.match(r"\"[^\"]*\"|'[^']*'|[^\s;]+", m[1])
            path = word[0].strip("\"'") if word and line.strip() else ""
            r.imported(path if not re.search(r"\$(?!PSScriptRoot)", path) else "", n)
        if depth == 0 and (m := re.match(r"(?i)\s*(?:function|filter)\s+(?:\w+:)?([\w-]+)", line)):
            r.add(n, m[1], "func", True)
        elif depth == 0 and (m := re.match(r"(?i)\s*(class|enum)\s+(\w+)", line)):
            r.add(n, m[2], "type", True)
            owner = (m[2], 1 if m[1].lower() == "class" else -1)
        elif depth == 0 and re.match(r"(?i)\s*param\s*\(", line):
            r.f.entrypoints.append("param")
        elif depth == owner[1] and owner[0]:
            if m := re.match(r"(?i)\s*((?:hidden|static)\s+)*(?:\[[^\]]*\]\s*)*(\w+)\s*\(", line):
                if m[2] != owner[0]:
                    r.add(n, m[2], "method", "hidden" not in line.lower().split("(")[0], owner[0])
            elif m := re.match(r"(?i)\s*((?:hidden|static)\s+)*(?:\[[^\]]*\]\s*)*\$(\w+)", line):
                r.add(n, m[2], "var", "hidden" not in line.lower().split("$")[0], owner[0])
        depth = max(0, depth + line.count("{") - line.count("}"))
    if listed is not None:
        r.f.symbols = [(x, k, v, any(re.fullmatch(re.escape(p).replace(r"\*", ".*"), x, re.I) for p in listed) if k == "func" else e, line, d) for x, k, v, e, line, d in r.f.symbols]
    return depth == 0


READERS: dict[str, Callable[[Reader], bool]] = {"go": go, "typescript": typescript, "rust": rust, "java": java, "kotlin": kotlin, "csharp": csharp, "php": php, "c": c_family, "ruby": ruby, "shell": shell, "powershell": powershell}


_MAY_BE_SQL = re.compile(r"\s*(?:--[^\n]*\n|/\*|select|insert|update|delete)", re.I)
#: Characters of a query that is kept with its tables, as the same one often comes again.
SHORT = 500


def _query(body: str) -> tuple[list[tuple[tuple[str, str], int]], int]:
    """(tables of a text's queries with the line they are at, gaps)."""
    found, gaps = [], 0
    for statement, at in lineage.split(body):
        if lineage.looks_like_sql(statement):
            refs, gap = lineage.tables(statement)
            gaps += gap
            found += [(ref, at) for ref in refs]
    return found, gaps


_short_query = lru_cache(4096)(_query)


def sql_of(strings: list[tuple[str, int]], facts: Facts) -> None:
    """Tables of the strings that are queries, each at its first line; gaps are counted."""
    seen: dict[tuple[str, str], int] = {}
    for body, line in strings:
        if not _MAY_BE_SQL.match(body):
            continue
        refs, gaps = (_short_query if len(body) <= SHORT else _query)(body)
        facts.unnamed_queries += gaps
        for ref, at in refs:
            seen[ref] = min(seen.get(ref, 1 << 30), line + at - 1)
    facts.queries = [(t, a, n) for (t, a), n in sorted(seen.items())]


def python_package(path: str) -> str:
    """The dotted name of a file from below src, lib or python."""
    return _INIT.sub("", _PY.sub("", _ROOT.sub("", path))).replace("/", ".")


_ROOT, _PY, _INIT = re.compile(r"^(src|lib|python)/"), re.compile(r"\.pyi?$"), re.compile(r"/?__init__$")
#: A line that is an import and nothing else, if it can be parsed.
_IMPORT_LINE = re.compile(r"import [\w.]+|from (?!__future__ )[\w.]+ import \w+(?:, \w+)*", re.A)


@lru_cache(20_000)
def line_import(line: str) -> tuple[tuple[str, str, tuple[str, ...]], ...] | None:
    """(raw, alias, names) of a line that is an import as a whole; None for any other."""
    if not _IMPORT_LINE.fullmatch(line):
        return None
    try:
        n = ast.parse(line).body[0]
    except SyntaxError:
        return None
    return tuple((raw, alias, tuple(names)) for raw, alias, names, _ in imports_of(n))


def imports_of(n: ast.Import | ast.ImportFrom) -> list[tuple[str, str, list[str], int]]:
    if isinstance(n, ast.Import):
        return [(a.name, a.asname or "", [], n.lineno) for a in n.names]
    return [("." * n.level + (n.module or ""), "", [a.name for a in n.names], n.lineno)]


def leading_imports(text: str) -> tuple[list[tuple[str, str, list[str], int]], str]:
    """Imports that are the text's first lines, and the text with these lines blank: the same imports open many files, so they are read once."""
    found: list[tuple[str, str, list[str], int]] = []
    at = line = 0
    while (end := text.find("\n", at)) >= 0:
        if end > at:
            got = line_import(text[at:end]) if end - at < 200 else None
            if got is None:
                break
            found += [(raw, alias, list(names), line + 1) for raw, alias, names in got]
        at, line = end + 1, line + 1
    return found, "\n" * line + text[at:]


def python_facts(text: str, path: str = "") -> Facts:
    f = Facts(package=python_package(path))
    first, rest = leading_imports(text)
    try:
        tree = ast.parse(rest)
    except (SyntaxError, ValueError, RecursionError):
        return python_lines(text, f)
    f.imports = first
    lists = [n.value for n in tree.body if isinstance(n, (ast.Assign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in (n.targets if isinstance(n, ast.Assign) else [n.target]))]
    listed = [e.value for v in lists if isinstance(v, (ast.List, ast.Tuple)) for e in v.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    declared: set[str] = set()

    def shown(name: str) -> bool:
        return name in listed if lists else not name.startswith("_")

    def add(n: ast.AST, name: str, kind: str, recv: str, show: bool) -> None:
        doc = ast.get_docstring(n) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        f.symbols.append((name, kind, recv, show, n.lineno, first_sentence(doc or "")))
        declared.add(name)

    strings: list[tuple[str, int]] = []
    todo: list = [tree]
    # One walk for imports and texts, in no order: both are sorted later.
    while todo:
        n = todo.pop()
        kind = type(n)
        if kind is ast.Constant:
            if isinstance(n.value, str):
                strings.append((n.value, n.lineno))
        elif kind is ast.Import or kind is ast.ImportFrom:
            f.imports += imports_of(n)
        elif kind is not ast.Name:
            for v in n.__dict__.values():
                if isinstance(v, list):
                    todo += [x for x in v if isinstance(x, ast.AST)]
                elif isinstance(v, ast.AST):
                    todo.append(v)
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(n, n.name, "func", "", shown(n.name))
        elif isinstance(n, ast.ClassDef):
            add(n, n.name, "type", "", shown(n.name))
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    f.symbols.append((m.name, "method", n.name, shown(n.name) and not m.name.startswith("_"), m.lineno, first_sentence(ast.get_docstring(m) or "")))
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name) and t.id != "__all__":
                    add(n, t.id, "const" if t.id.isupper() else "var", "", shown(t.id))
        elif isinstance(n, ast.If) and "__name__" in ast.dump(n.test) and "__main__" in ast.dump(n.test):
            f.entrypoints.append("__main__")
    # Names that __all__ hands on from elsewhere.
    line = lists[0].lineno if lists else 1
    f.symbols += [(x, "", "", True, line, "") for x in listed if x not in declared]
    sql_of(strings, f)
    return f


def python_lines(text: str, f: Facts) -> Facts:
    """What lines say of a file that can't be parsed."""
    f.incomplete = True
    s = scan(text, "python")
    for n, line in enumerate(s.code.split("\n"), 1):
        if m := re.match(r"\s*from\s+([\w.]+)\s+import\b(.*)$", line):
            f.imports.append((m[1], "", [x.split(" as ")[0].strip() for x in m[2].strip(" ()").split(",") if x.strip()], n))
        elif m := re.match(r"\s*import\s+(.*)$", line):
            for x in m[1].split(","):
                name, _, alias = x.strip().partition(" as ")
                if re.fullmatch(r"[\w.]+", name):
                    f.imports.append((name, alias.strip(), [], n))
        elif m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", line):
            f.symbols.append((m[2], "func" if m[1] == "def" else "type", "", not m[2].startswith("_"), n, ""))
        elif m := re.match(r"([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", line):
            f.symbols.append((m[1], "const" if m[1].isupper() else "var", "", not m[1].startswith("_"), n, ""))
    return f


def script_of(text: str, lang: str) -> str:
    """A component's script with everything else blanked, so that lines stay."""
    keep = [(m.start(1), m.end(1)) for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", text, re.S | re.I)] if lang != "astro" else [(m.start(1), m.end(1)) for m in [re.match(r"\s*---[ \t]*\n(.*?)^---[ \t]*$", text, re.S | re.M)] if m]
    out, at = [], 0
    for a, b in keep:
        out += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join([*out, re.sub(r"[^\n]", " ", text[at:])])


def only_php(text: str) -> str:
    """PHP between its tags, the rest blanked."""
    out, at = [], 0
    for m in re.finditer(r"<\?(?:php\b|=)?(.*?)(?:\?>|\Z)", text, re.S):
        out += [re.sub(r"[^\n]", " ", text[at : m.start(1)]), text[m.start(1) : m.end(1)]]
        at = m.end(1)
    return "".join([*out, re.sub(r"[^\n]", " ", text[at:])])


def merged(f: Facts) -> Facts:
    """Facts in order, each once: imports by name and alias with all names at the first line; symbols by name and receiver, a blank kind
    taking the other's, shown if any is, with the first documentation."""
    imports: dict[tuple[str, str], tuple[set[str], int]] = {}
    for raw, alias, names, line in f.imports:
        had, first = imports.get((raw, alias), (set(), line))
        imports[raw, alias] = (had | set(names), min(first, line))
    f.imports = [(raw, alias, sorted(names), line) for (raw, alias), (names, line) in sorted(imports.items())]
    symbols: dict[tuple[str, str, str], list] = {}
    for name, kind, recv, shown, line, doc in sorted(f.symbols, key=lambda x: (x[0], x[2], x[1] == "", x[4])):
        key = (name, recv, kind)
        if not kind:
            key = next((k for k in symbols if k[:2] == (name, recv)), key)
        if key in symbols:
            old = symbols[key]
            symbols[key] = [old[0] or shown, min(old[1], line), old[2] or doc]
        else:
            symbols[key] = [shown, line, doc]
    f.symbols = [(name, kind, recv, shown, line, doc) for (name, recv, kind), (shown, line, doc) in sorted(symbols.items(), key=lambda x: (x[1][1], x[0]))]
    f.entrypoints = sorted(set(f.entrypoints))
    return f


def facts_of(text: str | None, lang: str | None, path: str = "") -> Facts | None:
    """Facts of a file, None for a language without a reader."""
    text = (text or "").replace("\r\n", "\n")
    if lang == "python":
        return merged(python_facts(text, path))
    own = SAME.get(lang, lang)
    if own not in READERS:
        return None
    if lang in ("vue", "svelte", "astro"):
        text = script_of(text, lang)
    elif lang == "php":
        text = only_php(text)
    r = Reader(scan(re.sub(r"^#![^\n]*", "", text) if own == "typescript" else text, own), own, text)
    paired = READERS[own](r)
    r.f.incomplete = not (paired and r.s.complete)
    if lang in ("vue", "svelte", "astro"):
        r.f.entrypoints = []
    sql_of(r.s.bodies, r.f)
    return merged(r.f)


_IMPORT = (("raw", pa.string()), ("alias", pa.string()), ("names", pa.list_(pa.string())), ("line", pa.int32()))
_SYMBOL = (("name", pa.string()), ("kind", pa.string()), ("recv", pa.string()), ("exported", pa.bool_()), ("line", pa.int32()), ("doc", pa.string()))
_QUERY = (("table", pa.string()), ("access", pa.string()), ("line", pa.int32()))
FACTS = (
    "package string, imports array<struct<raw:string,alias:string,names:array<string>,line:int>>, symbols array<struct<name:string,kind:string,recv:string,exported:boolean,line:int,doc:string>>, "
    "entrypoints array<string>, queries array<struct<table:string,access:string,line:int>>, unnamed_queries int, incomplete boolean"
)
_ARROW = pa.schema([
    ("path", pa.string()), ("lang", pa.string()), ("package", pa.string()), ("imports", pa.list_(pa.struct(list(_IMPORT)))), ("symbols", pa.list_(pa.struct(list(_SYMBOL)))), ("entrypoints", pa.list_(pa.string())),
    ("queries", pa.list_(pa.struct(list(_QUERY)))), ("unnamed_queries", pa.int32()), ("incomplete", pa.bool_()),
])


def extract(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """path, lang and FACTS of source files (path, lang, content) that have a reader; a file that was cut short (truncated) is incomplete.

    With further columns to carry (each a name and a type) every file gives a row, with null facts where there is no reader."""
    more = [c.split()[0] for c in carry]

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            kept: list[int] = []
            paths, langs, texts, cut_short = (c.to_pylist() for c in b.columns[:4])
            for i, (path, lang, content, short) in enumerate(zip(paths, langs, texts, cut_short, strict=True)):
                f = facts_of(content, lang, path or "")
                if f:
                    rows.append((f.package, f.imports, f.symbols, f.entrypoints, f.queries, f.unnamed_queries, f.incomplete or bool(short)))
                    kept.append(i)
                elif carry:
                    rows.append((None,) * 7)
                    kept.append(i)
            same = b if len(kept) == b.num_rows else b.take(pa.array(kept, pa.int64()))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            made = [pa.array(c, t.type) for c, t in zip(cols, list(_ARROW)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), *made, *same.columns[4:]], [*_ARROW.names, *more])

    short = F.col("truncated") if "truncated" in files.columns else F.lit(False)
    some = files if carry else files.where(F.col("lang").isNotNull())
    return some.select("path", "lang", "content", short.alias("truncated"), *more).mapInArrow(run, ", ".join((f"path string, lang string, {FACTS}", *carry)))


def unhandled(files: DataFrame) -> DataFrame:
    """lang, n: source files of languages without a reader."""
    known = [*READERS, "python", *SAME]
    return files.where((F.col("class") == "source") & ~F.col("lang").isin(*known)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def exported_names(symbols):
    """Sorted distinct names of exported symbols (a Column of them), methods as Type.name."""
    shown = F.filter(symbols, lambda s: s["exported"])
    return F.array_sort(F.array_distinct(F.transform(shown, lambda s: F.when(s["recv"] != "", F.concat(s["recv"], F.lit("."), s["name"])).otherwise(s["name"]))))

