"""Column functions over text: white space, lines, hashes, digests and cleaning."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python strips it, for Java's regular expressions and for RE2.
JAVA_SPACE = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RE2_SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: The same as characters.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space that ends no line.
JAVA_BLANK = "\\x09\\x1f\\x20\\xa0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
#: Line boundaries as Python's splitlines knows them.
JAVA_LINE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
RE2_LINE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


#: Default salts of the holdout digest and of the tool-use digest; a corpus split elsewhere passes its own.
HOLDOUT_SALT, TOOL_SALT = "holdout", "tool-use"


#: What the Unicode name of an accented letter holds.
ACCENTS = ("WITH GRAVE", "WITH ACUTE", "WITH CEDILLA", "WITH DIAERESIS", "WITH CIRCUMFLEX", "WITH TILDE", "WITH MACRON", "WITH RING ABOVE")


@lru_cache(maxsize=None)
def accented(ch: str) -> bool:
    return ch.isalpha() and any(k in unicodedata.name(ch, "") for k in ACCENTS)


def accent_class(escape: str) -> str:
    """The accented letters of the basic plane as ranges of a regular expression's class; escape is like '\\\\u{:04x}'."""
    codes = [c for c in range(0x80, 0xD800) if accented(chr(c))]
    out = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(escape.format(a) + ("-" + escape.format(b) if b > a else "") for a, b in out)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without the white space at both ends; only the ends are looked at, which a regular expression does not do."""
    return F.btrim(text, F.lit(SPACE))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{JAVA_SPACE}]+\\z", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line, an empty text has none."""
    parts = F.split(text, JAVA_LINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normalized(text: Column) -> Column:
    """Line ends unified, trailing space of lines and surrounding space dropped."""
    unified = F.regexp_replace(text, JAVA_LINE, "\n")
    return strip(F.regexp_replace(unified, f"(?=[{JAVA_BLANK}])(?<![{JAVA_BLANK}])[{JAVA_BLANK}]++(?=\n)", ""))


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def holdout_digest(text: Column, seed: int, salt: str = HOLDOUT_SALT) -> Column:
    """First 8 bytes, as hex, of the salted digest that decides on a document's side."""
    nul = F.unhex(F.lit("00"))
    payload = F.concat(F.encode(F.lit(salt), "UTF-8"), nul, F.encode(F.lit(str(seed)), "UTF-8"), nul, F.encode(strip(text), "UTF-8"))
    return F.substring(F.sha2(payload, 256), 1, 16)


def hash_split(text: Column, seed: int, fraction: float, salt: str = HOLDOUT_SALT) -> Column:
    """'val' or 'train' from the text alone: the digest against a fixed-width hex threshold."""
    return F.when(holdout_digest(text, seed, salt) < threshold(fraction, 64), "val").otherwise("train")


def group_split(group: Column, seed: int, fraction: float) -> Column:
    """'validation' or 'train' for a whole group."""
    payload = F.concat(F.encode(F.lit(str(seed)), "UTF-8"), F.unhex(F.lit("00")), F.encode(group, "UTF-8"))
    return F.when(F.sha2(payload, 256) < threshold(fraction, 256), "validation").otherwise("train")


def threshold(fraction: float, bits: int) -> str:
    """fraction of 2^bits as fixed-width hex; a digest below it is on the held-out side."""
    value = int(fraction * (1 << bits)) if bits > 64 else -int(-(fraction * 2**64) // 1)
    return "g" if value >= 1 << bits else f"{value:0{bits // 4}x}"


def tidy(text: Column, keep_tabs: bool = False) -> Column:
    """Runs of blanks become one, blanks around line ends go, at most one empty line stays."""
    blanks = "[ \\x0c\\x0b]" if keep_tabs else "[ \\t\\x0c\\x0b]"
    out = F.regexp_replace(text, "\\r\\n?", "\n")
    out = F.regexp_replace(out, f"{blanks}+", " ")
    out = F.regexp_replace(out, "[ \\x0c\\x0b]*\\n[ \\x0c\\x0b]*", "\n")
    return strip(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def quoted_path(path: Column) -> Column:
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def size_words(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d bytes", n)).when(n < 1024**2, F.format_string("%d KB", F.floor(n / 1024))).otherwise(F.format_string("%d MB", F.floor(n / 1024**2)))


def cut_at_blank_line(text: Column, limit: int) -> Column:
    """The text's first ``limit`` characters, ended at the last blank line if that is past half of them."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.locate("\n\n", F.reverse(head)) - 1
    return F.when(F.length(text) <= limit, text).when((F.locate("\n\n", F.reverse(head)) > 0) & (at > limit / 2), F.substring(head, F.lit(1), at)).otherwise(head)


def truncate_after(text: Column, stop: str) -> Column:
    """Through the first ``stop``, or all of it."""
    return F.when(F.instr(text, stop) > 0, F.substring(text, F.lit(1), F.instr(text, stop) + len(stop) - 1)).otherwise(text)


#: A program's first line, alone on its line, and what follows up to the first example or the end.
SPEC_HEADER = "(?ms)^(t[ \\t]+[0-9]+[ \\t]*$.*?)(?:\\nExample:|\\z)"


def spec_header(context: Column) -> Column:
    """The specification that a prompt states, without the examples after it; null if it states none."""
    return F.nullif(F.regexp_extract(context, SPEC_HEADER.replace("(?ms)", "(?msd)"), 1), F.lit(""))


def time_words(seconds: Column) -> Column:
    """Seconds in words: under a minute, minutes, or hours and minutes."""
    s = F.floor(seconds)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", F.floor(s / 60))).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def shorten(text: Column, n: int = 160) -> Column:
    return F.substring(F.regexp_replace(strip(text), f"[{JAVA_SPACE}]+", " "), 1, n)
