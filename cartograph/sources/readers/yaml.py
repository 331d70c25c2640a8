"""YAML as repositories hold it: block and flow collections, block scalars, anchors, merge keys, several documents.

Not a validator. Template directives ({{ ... }} on a line of their own) are left out and make the text incomplete;
a line that fits nothing is skipped and does the same. Scalars stay text: what a value means is the caller's to say.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class Map(dict):
    """A mapping that knows the line of each key (from 1)."""

    def __init__(self, *args):
        super().__init__(*args)
        self.lines: dict[str, int] = {}


@dataclass
class Reader:
    text: str
    incomplete: bool = False
    anchors: dict = field(default_factory=dict)

    def documents(self) -> list:
        """Values of the documents that hold anything."""
        out, part, first = [], [], 1
        raw = self.text.replace("\r\n", "\n").replace("\t", "    ").split("\n")
        for n, line in enumerate([*raw, "---"], 1):
            if re.match(r"(---|\.\.\.)(\s|$)", line):
                value = self._document(part, first)
                out += [value] if value is not None else []
                part, first = ([line[4:]] if line.startswith("--- ") else []), n + (not line.startswith("--- "))
            elif not line.startswith("%"):
                part.append(line)
            else:
                part.append("")
        return out

    def _document(self, lines: list[str], first: int):
        self.lines: list[tuple[int, str, int]] = []  # indent, text, line number
        self.raw, self.first = lines, first
        for k, line in enumerate(lines):
            t = line.strip()
            if re.fullmatch(r"\{\{.*\}\}|\{%.*%\}", t):
                self.incomplete = True
                t = ""
            self.lines.append((len(line) - len(line.lstrip(" ")), t, first + k))
        self.at = 0
        self.anchors = {}
        self._skip()
        if self.at >= len(self.lines):
            return None
        value = self._block(self.lines[self.at][0])
        self._skip()
        self.incomplete |= self.at < len(self.lines)
        return value

    def _skip(self) -> None:
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][1].startswith("#")):
            self.at += 1

    def _block(self, indent: int):
        self._skip()
        if self.at >= len(self.lines):
            return ""
        _, t, _ = self.lines[self.at]
        if t == "-" or t.startswith("- "):
            return self._sequence(self.lines[self.at][0])
        if self._key(t):
            return self._mapping(self.lines[self.at][0])
        return self._scalar(t, indent)

    @staticmethod
    def _key(t: str) -> tuple[str, str] | None:
        """(key, rest) of a line that starts an entry."""
        m = re.match(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|\? |[^\s#&*!|>'\"%@`{\[,-][^#]*?|-[^\s#][^#]*?|\*[\w.-]+|<<)\s*:(?:\s+(.*)|$)", t)
        if not m or (": " in (m[1] or "") and m[1][0] not in "\"'"):
            m2 = re.match(r"([^\s:][^:]*?):(?:\s+(.*)|$)", t)
            if not m2 or t[0] in "\"'{[#&!|>-":
                return None
            return m2[1].strip(), (m2[2] or "").strip()
        return unquote(m[1]), (m[2] or "").strip()

    def _mapping(self, indent: int) -> Map:
        out = Map()
        merged: list = []
        while True:
            self._skip()
            if self.at >= len(self.lines) or self.lines[self.at][0] != indent:
                if self.at < len(self.lines) and self.lines[self.at][0] > indent:
                    self.incomplete = True
                    self.at += 1
                    continue
                break
            _, t, n = self.lines[self.at]
            if t.startswith("- ") or t == "-":
                break
            entry = self._key(t)
            if entry is None:
                self.incomplete = True
                self.at += 1
                continue
            key, rest = entry
            value = self._value(rest, indent)
            if key == "<<":
                merged += value if isinstance(value, list) else [value]
            else:
                out[key] = value
                out.lines.setdefault(key, n)
        for m in merged:
            if isinstance(m, dict):
                for k, v in m.items():
                    if k not in out:
                        out[k] = v
                        out.lines[k] = getattr(m, "lines", {}).get(k, 0)
        return out

    def _sequence(self, indent: int) -> list:
        out = []
        while True:
            self._skip()
            if self.at >= len(self.lines) or self.lines[self.at][0] != indent:
                break
            _, t, n = self.lines[self.at]
            if t != "-" and not t.startswith("- "):
                break
            rest = t[1:].strip()
            inner = indent + (len(t) - len(t[1:].lstrip())) if rest else indent
            plain = re.sub(r"^[&!][^\s]*\s+", "", rest)
            if rest and (plain.startswith("- ") or (self._key(plain) and plain[0] not in "{[")):
                name = re.match(r"&([\w.-]+)\s", rest)
                self.lines[self.at] = (inner, plain, n)
                item = self._block(inner)
                if name:
                    self.anchors[name[1]] = item
            else:
                item = self._value(rest, indent)
            out.append(item)
        return out

    def _value(self, rest: str, indent: int):
        """The value after a key or dash at ``indent``; moves past it."""
        name = None
        while m := re.match(r"([&!])([^\s]*)\s*", rest):
            name = m[2] if m[1] == "&" else name
            rest = rest[m.end() :]
        if rest.startswith("#"):
            rest = ""
        if re.match(r"[|>][+-]?\d?[+-]?\s*(#.*)?$", rest):
            value = self._text(rest, indent)
        elif not rest:
            self.at += 1
            self._skip()
            deeper = self.at < len(self.lines) and (self.lines[self.at][0] > indent or (self.lines[self.at][0] == indent and re.match(r"-(\s|$)", self.lines[self.at][1]) and not self._in_sequence(indent)))
            value = self._block(indent + 1) if deeper else ""
        else:
            value = self._scalar(rest, indent)
        if name:
            self.anchors[name] = value
        return value

    def _in_sequence(self, indent: int) -> bool:
        """Whether the entry just read was itself a dash at ``indent``."""
        k = self.at - 1
        while k >= 0 and (not self.lines[k][1] or self.lines[k][1].startswith("#")):
            k -= 1
        return k >= 0 and self.lines[k][0] == indent and bool(re.match(r"-(\s|$)", self.lines[k][1]))

    def _text(self, mark: str, indent: int) -> str:
        """A block scalar; moves past it."""
        self.at += 1
        width = re.search(r"\d", mark.split("#")[0])
        base = indent + int(width[0]) if width else None
        rows = []
        while self.at < len(self.lines):
            raw = self.raw[self.lines[self.at][2] - self.first]
            own = len(raw) - len(raw.lstrip(" "))
            if raw.strip():
                if base is None:
                    base = own
                if own < base or own <= indent:
                    break
            rows.append(raw[base or 0 :] if raw.strip() else "")
            self.at += 1
        while rows and not rows[-1]:
            rows.pop()
        if mark[0] == "|":
            text = "\n".join(rows)
        else:
            text = re.sub(r"(?<=[^\n])(\n+)(?=[^\n ])", lambda m: m[1][1:] or " ", "\n".join(rows))
        return text + ("" if "-" in mark.split("#")[0] or not rows else "\n")

    def _scalar(self, rest: str, indent: int):
        """A flow collection, quoted or plain scalar that may go on over deeper lines; moves past it."""
        self.at += 1
        if rest[0] in "{[":
            while not self._balanced(rest) and self.at < len(self.lines):
                rest += " " + re.sub(r"(^|\s)#.*$", "", self.lines[self.at][1])
                self.at += 1
            if rest.startswith("{{"):
                self.incomplete = True
                return rest
            value, end = self._flow(rest, 0)
            self.incomplete |= bool(re.sub(r"#.*$", "", rest[end:]).strip())
            return value
        if rest[0] in "\"'":
            while not re.match(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", rest) and self.at < len(self.lines):
                rest += " " + self.lines[self.at][1]
                self.at += 1
            m = re.match(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", rest)
            self.incomplete |= m is None
            return unquote(m[0] if m else rest)
        if rest.startswith("*"):
            name = rest[1:].split()[0]
            self.incomplete |= name not in self.anchors
            return self.anchors.get(name, "")
        rest = re.sub(r"\s+#.*$", "", rest)
        while self.at < len(self.lines):
            own, t, _ = self.lines[self.at]
            if not t or own <= indent or t.startswith("#") or self._key(t) or t.startswith("- "):
                break
            rest += " " + re.sub(r"\s+#.*$", "", t)
            self.at += 1
        return "" if rest in ("~", "null", "Null", "NULL") else rest

    @staticmethod
    def _balanced(t: str) -> bool:
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", "", t)
        return sum(bare.count(c) for c in "{[") <= sum(bare.count(c) for c in "}]")

    def _flow(self, t: str, i: int):
        """(value, the place after it) of a flow value at ``i``."""
        while i < len(t) and t[i].isspace():
            i += 1
        if i >= len(t):
            return "", i
        if t[i] == "[":
            out, i = [], i + 1
            while i < len(t) and t[i] != "]":
                if t[i] in ", \n":
                    i += 1
                    continue
                value, i = self._flow(t, i)
                out.append(value)
            return out, i + 1
        if t[i] == "{":
            found, i = Map(), i + 1
            while i < len(t) and t[i] != "}":
                if t[i] in ", \n":
                    i += 1
                    continue
                key, i = self._flow(t, i)
                value = ""
                while i < len(t) and t[i].isspace():
                    i += 1
                if i < len(t) and t[i] == ":":
                    value, i = self._flow(t, i + 1)
                found[key if isinstance(key, str) else str(key)] = value
            return found, i + 1
        m = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'").match(t, i)
        if m:
            return unquote(m[0]), m.end()
        m = re.compile(r"(?:[^,\[\]{}:]|:(?!\s|$|[,\]}]))*").match(t, i)
        word = m[0].strip()
        if not m[0]:
            return "", i + 1
        if word.startswith("*"):
            return self.anchors.get(word[1:], ""), m.end()
        return ("" if word in ("~", "null") else word), m.end()


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unquote(t: str) -> str:
    t = t.strip()
    if len(t) > 1 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    if len(t) > 1 and t[0] == t[-1] == '"':
        return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), t[1:-1])
    return t


def read(text: str) -> tuple[list, bool]:
    """(values of the documents, whether all of the text was understood)."""
    r = Reader(text)
    docs = r.documents()
    return docs, not r.incomplete
