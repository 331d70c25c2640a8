"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a name sensitive; 15 of them, matched anywhere in the lower-cased name.
SENSITIVE = (
    "password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private_key", "privatekey", "access_key", "accesskey", "auth", "cert", "signing", "session_key",
)
# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "cf", "vs", "approx", "resp", "viz", "al", "Mr", "Ms", "Mrs", "Dr", "Inc", "Ltd", "No", "vol", "fig", "ref")


def line_count(c: Column) -> Column:
    """Newlines, and one more for a last line without; 0 for an empty text."""
    n = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(c == "", 0).otherwise(n + F.when(F.endswith(c, F.lit("\n")), 0).otherwise(1)).cast("long")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def fold_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))


def elide(c: Column, keep: int, marker: str = "... elided ...") -> Column:
    """The first and last keep / 2 lines around a marker, for texts of over ``keep`` lines."""
    lines, half = F.split(c, "\n"), keep // 2
    return F.when(F.size(lines) <= keep, c).otherwise(F.array_join(F.concat(F.slice(lines, 1, half), F.array(F.lit(marker)), F.slice(lines, -half, half)), "\n"))


def sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE))


def first_sentence(c: Column, clip: int = 240) -> Column:
    """White space folded; up to a full stop that ends a sentence, else clipped at a blank with an ellipsis.

    A stop ends no sentence after a single letter or an abbreviation. A sentence that ends is whole however long; the clip is in bytes."""
    t = fold_space(c)
    open_words = "|".join(["[A-Za-z]", *(a.replace(".", r"\.") for a in ABBREVIATIONS)])
    found = F.regexp_extract(t, rf"^(.*?(?<!(?:^| )(?:{open_words}))\.)(?: |$)", 1)
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, clip).cast("string")), "�+$", "")
    cut = F.regexp_replace(head, " [^ ]*$", "")
    cut = F.when(F.octet_length(cut) * 2 > clip, cut).otherwise(head)
    return F.when(found != "", found).when(F.octet_length(t) <= clip, t).otherwise(F.concat(cut, F.lit("…")))


# Control tokens of chat formats, broken up before text goes to a model.
CONTROL = (
    "<untrusted_source", "</untrusted_source>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]",
)


# Words that open a turn in a forged transcript, alone on a heading line.
ROLES = ("system", "instruction", "instructions", "human", "user", "assistant", "response")
ZERO_WIDTH = "\u200b"


def _escaped(token: str) -> str:
    return "".join(x if x.isalnum() or x == "_" else "\\" + x for x in token)


def defang(c: Column) -> Column:
    """Control tokens with a zero-width space after their first sign, and headings of a role word alone with one after their first ``#``."""
    for t in CONTROL:
        c = F.regexp_replace(c, f"(?i)({_escaped(t[0])})({_escaped(t[1:])})", f"$1{ZERO_WIDTH}$2")
    return F.regexp_replace(c, rf"(?imd)^([^\S\n#]*#)(#*[^\S\n]*(?:{'|'.join(ROLES)})[^\S\n]*:?[^\S\n]*)$", f"$1{ZERO_WIDTH}$2")


def wrapped(source: Column, c: Column) -> Column:
    """Defanged text between marks that carry a tag of its own hash, so that the text can't close them."""
    safe = defang(c)
    tag = F.substring(F.sha2(safe, 256), 1, 16)
    return F.concat(F.lit("<untrusted_source tag=\""), tag, F.lit("\" name=\""), F.regexp_replace(source, "[\"<>\n]", "_"), F.lit("\">\n"), safe, F.lit("\n</untrusted_source tag=\""), tag, F.lit("\">"))


def clip_lines(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut after the last whole line (in a line where the first is longer)."""
    head = F.substring(c, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*\n)", 1)
    return F.when(F.length(c) <= most, c).when(whole != "", whole).otherwise(head)


def capitalised(c: Column) -> Column:
    """The first letter in upper case (ASCII only), the rest as it is."""
    return F.when(c.rlike("^[a-z]"), F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def counted(n: Column, unit: Column) -> Column:
    """``n unit``, with an s but for one."""
    return F.concat(n.cast("string"), F.lit(" "), unit, F.when(n == 1, "").otherwise("s"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


# Units, all of 1024.
UNITS = {"": 0, "B": 0, "K": 1, "KB": 1, "KIB": 1, "M": 2, "MB": 2, "MIB": 2, "G": 3, "GB": 3, "GIB": 3, "T": 4, "TB": 4, "TIB": 4}


def parse_bytes(text: str) -> int:
    """Bytes of a size such as 3GiB or 1.5m; refuses what isn't a positive finite size below 2**63."""
    t = text.strip().upper()
    k = next(i for i in range(len(t) + 1) if i == len(t) or not (t[i].isdigit() or t[i] == "."))
    number, unit = t[:k], t[k:].strip()
    if unit not in UNITS or not number:
        raise ValueError(f"not a size: {text!r}")
    n = float(number) * 1024 ** UNITS[unit]
    if not 0 < n < 2**63:
        raise ValueError(f"size out of range: {text!r}")
    return int(n)


def human_bytes(n: int) -> str:
    size, unit = float(n), 0
    while size >= 1024 and unit < 4:
        size, unit = size / 1024, unit + 1
    return f"{n} B" if not unit else f"{size:.1f} {('KiB', 'MiB', 'GiB', 'TiB')[unit - 1]}"
