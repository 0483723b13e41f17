"""Column functions over text: folding, tokens, hashes, globs, entropy. All JVM-side."""

from __future__ import annotations

import fnmatch
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folding() -> tuple[str, str]:
    """Letters with marks and their bare letters, then the marks themselves, which go.

    A rule over Unicode's canonical decompositions below the East Asian blocks, so that texts and
    queries fold alike on both sides, in column functions and on the driver.
    """
    marked, bare, marks = [], [], []
    for c in map(chr, range(0x80, 0x3000)):
        parts = unicodedata.normalize("NFD", c)
        kept = [p for p in parts if not unicodedata.combining(p)]
        if not kept:
            marks.append(c)
        elif len(kept) == 1 and kept[0] != c:
            marked.append(c)
            bare.append(kept[0].lower())
    return "".join(marked + marks), "".join(bare)


ACCENTED, PLAIN = _folding()
_TABLE = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])
TOKEN = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def folded(text: str) -> str:
    """As :func:`fold`, of a query on the driver."""
    return text.lower().translate(_TABLE)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), 1)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def collapsed(text: Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def span_hash(text: Column) -> Column:
    return content_hash(collapsed(text))


def masked_hash(text: Column) -> Column:
    """Hash of the collapsed text with its first word, the declared name, masked."""
    return content_hash(F.regexp_replace(collapsed(text), "^[^ ]+", "<name>"))


def first_line(text: Column, width: int = 200) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, width)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def glob_regex(patterns: tuple[str, ...] | list[str]) -> str:
    """One alternation for shell patterns in which ``*`` crosses ``/``."""
    parts = []
    for p in patterns:
        body = fnmatch.translate(p)
        body = re.sub(r"^\(\?s:|\)\\[zZ]$", "", body)
        parts.append(f"(?:{body})")
    return "(?s)^(?:" + "|".join(parts) + ")$"


def matches_glob(path: Column, patterns) -> Column:
    """Whether the path, or the path behind a leading slash, matches any pattern."""
    regex = glob_regex(patterns)
    return path.rlike(regex) | F.concat(F.lit("/"), path).rlike(regex)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(value, "")
    n = F.length(value).cast("double")
    term = lambda c: F.length(value) - F.length(F.replace(value, c, F.lit("")))
    each = F.transform(F.array_distinct(chars), lambda c: term(c) / n)
    return F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def octets(value: Column) -> Column:
    return F.octet_length(value)


def extension_language(path: Column) -> Column:
    """Language by what follows the last dot; null for others."""
    # File suffixes of the languages that are parsed.
    suffixes = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "go": "go", "rs": "rust"}
    table = F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv])
    return F.when(F.instr(path, ".") > 0, F.element_at(table, F.substring_index(path, ".", -1)))
