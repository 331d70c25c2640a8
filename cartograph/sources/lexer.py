"""One pass over source text: comments and string bodies out of the way, by a table of each language's syntax.

``scan`` gives the text twice, both of the same length and with its lines: ``code`` (comments and what stands in strings blanked) and
``text`` (comments blanked only), the string bodies with their lines, the comments by line, and whether everything opened was closed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from cartograph.functions.text import ABBREVIATIONS


@dataclass(frozen=True)
class Syntax:
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str, bool], ...] = ()  # open, close, nested
    strings: tuple[tuple[str, str, str, bool], ...] = ()  # open, close, escape ('' none, 'd' doubled close), over lines
    heredoc: str = ""  # pattern of an opening with the groups tag and perhaps dash


_C = (("/*", "*/", False),)
_QUOTES = (('"', '"', "\\", False), ("'", "'", "\\", False))
# Comment and string syntax by language; longer openings first.
SYNTAX = {
    "go": Syntax(("//",), _C, (("`", "`", "", True), *_QUOTES)),
    "typescript": Syntax(("//",), _C, (("`", "`", "\\", True), *_QUOTES)),
    "rust": Syntax(("//",), (("/*", "*/", True),), (('r##"', '"##', "", True), ('r#"', '"#', "", True), ('r"', '"', "", True), ('"', '"', "\\", True))),
    "java": Syntax(("//",), _C, (('"""', '"""', "\\", True), *_QUOTES)),
    "kotlin": Syntax(("//",), (("/*", "*/", True),), (('"""', '"""', "", True), *_QUOTES)),
    "c": Syntax(("//",), _C, (('R"(', ')"', "", True), *_QUOTES)),
    "csharp": Syntax(("//",), _C, (('"""', '"""', "", True), ('@$"', '"', "d", True), ('$@"', '"', "d", True), ('@"', '"', "d", True), *_QUOTES)),
    "php": Syntax(("//", "#"), _C, (('"', '"', "\\", True), ("'", "'", "\\", True)), r"<<<[ \t]*(['\"]?)(?P<tag>\w+)\1\n"),
    "ruby": Syntax(("#",), (("\n=begin", "\n=end", False),), (('"', '"', "\\", True), ("'", "'", "\\", True), ("%q(", ")", "\\", True), ("%(", ")", "\\", True)), r"<<(?P<dash>[~-]?)(['\"]?)(?P<tag>[A-Z_]\w*)\2"),
    "shell": Syntax(("#",), (), (('"', '"', "\\", True), ("'", "'", "", True)), r"<<(?P<dash>-?)[ \t]*\\?(['\"]?)(?P<tag>[A-Za-z_]\w*)\2"),
    "powershell": Syntax(("#",), (("<#", "#>", False),), (('@"\n', '\n"@', "", True), ("@'\n", "\n'@", "", True), ('"', '"', "`", True), ("'", "'", "d", True))),
    "python": Syntax(("#",), (), (('"""', '"""', "\\", True), ("'''", "'''", "\\", True), *_QUOTES)),
}


@dataclass
class Scan:
    code: str
    text: str
    bodies: list[tuple[str, int]] = field(default_factory=list)
    comments: dict[int, str] = field(default_factory=dict)
    complete: bool = True

    def line(self, at: int) -> int:
        return self.code.count("\n", 0, at) + 1

    def doc(self, line: int) -> str:
        """The comment lines that end right above ``line``, first sentence."""
        parts = []
        n = line - 1
        while n in self.comments:
            parts.append(self.comments[n])
            n -= 1
        return first_sentence(re.sub(r"(?m)^[\s/*!#]+|[\s*/]+$", " ", "\n".join(reversed(parts))))


def first_sentence(text: str, clip: int = 240) -> str:
    """As the Column of that name in ``functions.text``, for one text."""
    words = text.split()
    for k, w in enumerate(words, 1):
        if w.endswith(".") and w[:-1] not in ABBREVIATIONS and not re.fullmatch("[A-Za-z]", w[:-1]):
            return " ".join(words[:k])
    t = " ".join(words)
    raw = t.encode()
    if len(raw) <= clip:
        return t
    head = raw[:clip].decode(errors="ignore")
    cut = head.rpartition(" ")[0]
    return (cut if len(cut.encode()) > clip // 2 else head).strip() + "…"


def _blank(t: str) -> str:
    return re.sub(r"[^\n]", " ", t)


def scan(source: str, lang: str) -> Scan:
    """Read ``source`` in the syntax of ``lang``."""
    syn = SYNTAX[lang]
    out = Scan("", "")
    code: list[str] = []
    text: list[str] = []
    i, line, n = 0, 1, len(source)
    openings = sorted({*syn.line, *(b[0] for b in syn.block), *(s[0] for s in syn.strings)}, key=len, reverse=True)
    stop = re.compile("|".join([*map(re.escape, openings), *([syn.heredoc] if syn.heredoc else [])]) if openings else r"\Z")
    waiting: list[tuple[str, bool]] = []  # heredocs that start on the next line

    def take(upto: int, keep_code: bool, keep_text: bool):
        nonlocal i, line
        part = source[i:upto]
        code.append(part if keep_code else _blank(part))
        text.append(part if keep_text else _blank(part))
        line += part.count("\n")
        i = upto

    def comment(t: str, at: int):
        for k, row in enumerate(t.split("\n")):
            out.comments[at + k] = (out.comments.get(at + k, "") + " " + row).strip()

    while i < n:
        m = stop.search(source, i)
        if waiting:
            end = source.find("\n", i)
            if end >= 0 and (m is None or m.start() > end):
                take(end + 1, True, True)
                for tag, dash in waiting:
                    close = re.compile(rf"^{r'[ \t]*' if dash else ''}{tag}\b[^\n]*", re.M).search(source, i)
                    stop_at = close.start() if close else n
                    out.bodies.append((source[i:stop_at], line))
                    out.complete &= close is not None
                    take(stop_at, False, True)
                    take(close.end() if close else n, False, True)
                waiting = []
                continue
        if m is None:
            take(n, True, True)
            break
        take(m.start(), True, True)
        opened = m[0]
        if syn.heredoc and (h := re.match(syn.heredoc, opened)):
            if lang == "php":
                take(m.end(), False, True)
                close = re.compile(rf"^[ \t]*{h['tag']}\b", re.M).search(source, i)
                stop_at = close.start() if close else n
                out.bodies.append((source[i:stop_at], line))
                out.complete &= close is not None
                take(stop_at, False, True)
            else:
                waiting.append((h["tag"], bool(h["dash"])))
                take(m.end(), False, True)
            continue
        if opened in syn.line and not any(opened == b[0] for b in syn.block):
            before = source[i - 1] if i else "\n"
            if lang in ("shell", "ruby", "powershell") and not before.isspace() and before not in ";(){}":
                take(i + len(opened), True, True)
                continue
            end = source.find("\n", i)
            end = n if end < 0 else end
            comment(source[i:end], line)
            take(end, False, False)
            continue
        block = next((b for b in syn.block if b[0] == opened), None)
        if block:
            depth, at = 1, i + len(opened)
            while depth and at < n:
                close, inner = source.find(block[1], at), source.find(block[0], at) if block[2] else -1
                if close < 0:
                    at = n
                elif 0 <= inner < close:
                    depth, at = depth + 1, inner + len(block[0])
                else:
                    depth, at = depth - 1, close + len(block[1])
            out.complete &= depth == 0
            comment(source[i:at], line)
            take(at, False, False)
            continue
        _, close, escape, multi = next(s for s in syn.strings if s[0] == opened)
        at = i + len(opened)
        while at < n:
            if escape and escape != "d" and source[at] == escape:
                at += 2
            elif source.startswith(close, at):
                if escape == "d" and source.startswith(close * 2, at):
                    at += 2
                    continue
                break
            elif source[at] == "\n" and not multi:
                break
            else:
                at += 1
        closed = at < n and source.startswith(close, at)
        if opened == "'" and lang in ("go", "c", "java", "kotlin", "csharp", "rust") and (not closed or at - i > 12):
            take(i + 1, True, True)  # a lifetime, a digit mark or a label and no character
            continue
        out.bodies.append((source[i + len(opened) : at], line))
        out.complete &= closed or not multi
        at = min(n, at)
        take(i + len(opened), True, True)
        take(at, False, True)
        if closed:
            take(at + len(close), True, True)
    out.code, out.text = "".join(code), "".join(text)
    return out
