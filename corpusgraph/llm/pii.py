"""Personal data with offset-preserving deobfuscation.

Base detection finds e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers
in the text as it stands. Transducers then rewrite disguises into a normalised text, each what
the one before it has written: Cyrillic, Greek and full-width look-alikes become ASCII, spelled
digits become digits, and dot and at disguises become ``.`` and ``@``. So disguises may be mixed
(a look-alike in a bracketed "dot", spelled digits between spelled dots). Where a run of spelled digits ends and whether its commas and
dots count is open, so there are three readings: runs of six digits and more, one by one; runs
of any length joined with the numerals beside them; and the same without commas and dots, which
stay. Spans of all readings count, save those within another of their kind. Each character of a
normalised text carries the source range it stands for, through all rewrites; spans found there
are carried back to source code points. Spans that touch no rewrite, or lie within a base span of their kind, add nothing;
a disguised span that reaches beyond a base span is added beside it.

Offsets are code points, ends exclusive. Matches of a kind are leftmost and don't overlap;
matches that fail a check (IP part above 255, Luhn, number of digits) are dropped.

Defined cases: null and empty texts have no spans; very long texts are scanned whole, in time
linear in their length whatever they hold; repeated rows are scanned each; other columns pass
through, but a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from corpusgraph.llm.common import map_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only be entered at its start, so nothing is rescanned.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

# Look-alikes of ASCII letters in the Cyrillic and Greek blocks.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
}
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
LOOKALIKES |= {chr(base + i): str(i) for base in (0x660, 0x6F0, 0x966) for i in range(10)}  # other decimal digits
LOOKALIKES |= {"＠": "@", "﹫": "@", "。": ".", "․": "."}
# English words of the digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

LOOK = "[" + re.escape("".join(LOOKALIKES)) + "]"
WORD = "(?:" + "|".join(SPELLED) + ")"
LONG_RUN = rf"(?<![^\W_])(?:plus[ ,.-]+)?{WORD}(?:[ ,.-]++(?:{WORD}|[0-9])){{5,}}(?![^\W_])"


def any_run(sep: str) -> str:
    """Spelled digits in runs of any length, joined with numerals beside them.

    No identifier has more than 19 digits, so 18 numerals before a word are enough.
    """
    return rf"(?<![^\W_])(?:plus{sep})?(?:[0-9]++{sep}){{0,18}}{WORD}(?![^\W_])(?:{sep}(?:{WORD}|[0-9]++)(?![^\W_]))*+"


# At and dot signs; blanks around them are taken in by hand, so that a run of blanks is read twice
# at most however many signs could begin there.
AT_SIGN = re.compile(r"[\[({<][ \t]*+(?:at|@)[ \t]*+[\])}>]|(?<=[ \t])at(?=[ \t])", re.IGNORECASE)
BRACKETED = re.compile(r"[\[({<][ \t]*+(?:at|@|dot|punkt|punto|point|\.)[ \t]*+[\])}>]")
DOT_SIGN = re.compile(r"[\[({<][ \t]*+(?:dot|punkt|punto|point|\.)[ \t]*+[\])}>]|(?<=[ \t])dot(?=[ \t])", re.IGNORECASE)
BLANKS = re.compile(r"[ \t]*")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,5}")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
# Last labels of host names before which a bare " at " is a disguise.
TLD = frozenset("com org net edu gov info biz io co eu uk us ca de fr es it nl ch at be pl pt se ru br mx in jp cn au".split())
# Long runs of digits one by one; runs with numerals beside them; the same where commas and dots stay.
READINGS = [re.compile(spelling, re.IGNORECASE) for spelling in (LONG_RUN, any_run("[ ,.-]++"), any_run("[ -]++"))]
WORD_ANY = re.compile(WORD, re.IGNORECASE)
TOKEN = re.compile(rf"plus|{WORD}|[0-9]+", re.IGNORECASE)
LOOK_ANY, LOOK_TABLE = re.compile(LOOK), str.maketrans(LOOKALIKES)
# A digit word can only be part of an identifier if another digit is next to it. Every separator
# of a run is of these characters, and " dot " and bracketed dots are looked for on their own.
SPELLED_NEXT, DIGIT_NEXT = re.compile(rf"{WORD}[\W_]++(?:{WORD}|[0-9])"), re.compile(rf"[0-9][\W_]++{WORD}")


def disguised(text: str) -> bool:
    """Whether any transducer can apply; each test is a scan of its own, the cheap ones first."""
    if not text.isascii() and LOOK_ANY.search(text):
        return True
    low = text.lower()
    # A bare " at " counts only before a disguised dot, which opens the gate itself.
    if BRACKETED.search(low) or ("dot" in low and DOT_SIGN.search(low)):
        return True
    return bool(SPELLED_NEXT.search(low) or DIGIT_NEXT.search(low))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, done := m.end()))
        else:
            # No address holds this sign, so none begins before it.
            done = max(done, at + 1)
        at = text.find("@", at + 1)
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(small(p) for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Rewritten:
    """A text as transducers have rewritten it so far, with the source range of each character."""

    def __init__(self, text: str, start, end, new):
        self.text, self.start, self.end, self.new = text, start, end, new

    @classmethod
    def plain(cls, source: str) -> Rewritten:
        """Look-alikes become the signs they stand for, character by character."""
        text = source.translate(LOOK_TABLE)
        code = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.arange(len(text), dtype=np.int32)
        return cls(text, at, at + 1, code(source) != code(text))

    def edited(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Rewritten:
        """Ranges (from, to) replaced by pieces (string, from, to of what it stands for), in order.

        The new text's ranges are those of the source: edits compose.
        """
        if not edits:
            return self
        texts, starts, ends, news, done = [], [], [], [], 0
        for a, b, pieces in edits:
            texts.append(self.text[done:a])
            starts.append(self.start[done:a])
            ends.append(self.end[done:a])
            news.append(self.new[done:a])
            for s, x, y in pieces:
                texts.append(s)
                same = len(s) == y - x
                starts.append(self.start[x:y] if same else np.full(len(s), self.start[x], dtype=np.int32))
                ends.append(self.end[x:y] if same else np.full(len(s), self.end[y - 1], dtype=np.int32))
                news.append(np.ones(len(s), dtype=bool))
            done = b
        return Rewritten("".join([*texts, self.text[done:]]), *(np.concatenate([*some, whole[done:]]) for some, whole in ((starts, self.start), (ends, self.end), (news, self.new))))

    def spelled(self, reading: re.Pattern) -> Rewritten:
        """Spelled digits, in the runs of one reading, as digits without their separators."""
        edits = []
        for m in reading.finditer(self.text) if WORD_ANY.search(self.text) else ():
            tokens = [(t[0].lower(), m.start() + t.start(), m.start() + t.end()) for t in TOKEN.finditer(m[0])]
            edits.append((*m.span(), [("+" if w == "plus" else SPELLED.get(w, w), a, b) for w, a, b in tokens]))
        return self.edited(edits)

    def signs(self, pattern: re.Pattern, sign: str, fits) -> Rewritten:
        """Signs with the blanks around them as ``sign``; bare words only where ``fits`` says so."""
        text, edits, done = self.text, [], 0
        for m in pattern.finditer(text):
            a, b = m.span()
            if a < done:
                continue
            while a > done:
                some = text[max(done, a - 256) : a]
                a -= len(some) - len(bare := some.rstrip(" \t"))
                if bare:
                    break
            b = BLANKS.match(text, b).end()
            if m[0][0] not in "[({<" and (a == m.start() or not fits(a, b, done)):
                continue
            edits.append((a, b, [(sign, a, b)]))
            done = b
        return self.edited(edits)

    def dots(self) -> Rewritten:
        text = self.text
        return self.signs(DOT_SIGN, ".", lambda a, b, done: a > done and text[a - 1] in LABEL and b < len(text) and text[b] in LABEL)

    def ats(self) -> Rewritten:
        """A bare " at " counts before a host whose last dot was disguised."""

        def fits(a, b, done):
            m = HOST.match(self.text, b)
            at = b
            for label in m[0].split(".") if m else []:
                if at > b and self.new[at - 1] and label.lower() in TLD:
                    return True
                at += len(label) + 1
            return False

        return self.signs(AT_SIGN, "@", fits)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only a normalised text shows, in source offsets.

    The transducers run one after another, each on what the one before has written, so that
    disguises may be mixed: look-alikes, then spelled digits, dots and at signs.
    """
    if not disguised(text):
        return []
    found, seen, plain = set(), set(), Rewritten.plain(text)
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    for reading in READINGS if WORD_ANY.search(plain.text) else READINGS[:1]:
        got = plain.spelled(reading).dots().ats()
        if got.text in seen:
            continue
        seen.add(got.text)
        touched = np.concatenate([[0], np.cumsum(got.new)])
        for kind, a, b in base_spans(got.text):
            if touched[a] == touched[b]:
                continue
            start, stop = int(got.start[a]), int(got.end[b - 1])
            # Base spans of a kind don't overlap, so only the last that begins by here may hold it.
            k = bisect.bisect_right(taken[kind], (start, len(text) + 1)) - 1
            if k < 0 or taken[kind][k][1] < stop:
                found.add((kind, start, stop))
    # Of spans of a kind that begin in order, one within another ends no later than some before it.
    out, last = [], {}
    for kind, start, stop in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], -s[2])):
        if stop > last.get(kind, -1):
            out.append((kind, start, stop))
            last[kind] = stop
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with each run of overlapping spans replaced by the kind that begins it."""
    parts, done, held = [], 0, None
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if held and a < held[2]:
            held = (held[0], held[1], max(b, held[2]))
            continue
        if held:
            parts += [text[done : held[1]], f"[{held[0].upper()}]"]
            done = held[2]
        held = (k, a, b)
    if held:
        parts += [text[done : held[1]], f"[{held[0].upper()}]"]
        done = held[2]
    return "".join([*parts, text[done:]])


def find(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` (columns ``keep``) with the counts and digest of base spans, and all spans.

    With ``redact`` there is also ``redacted``, the text with every span replaced.
    """
    fields = [("n_email", "long"), ("n_ip", "long"), ("n_card", "long"), ("n_phone", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_added", "long")]

    def make():
        def f(texts):
            rows, clean = [], []
            for s in texts.to_pylist():
                text = s or ""
                base = base_spans(text)
                more = added_spans(text, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more]), len(more)))
                if redact:
                    clean.append(s if s is None else redacted(text, [*base, *more]))
            return [*(list(c) for c in zip(*rows, strict=True)), *([clean] if redact else [])]

        return f

    return map_text(docs, make, [*fields, *([("redacted", "string")] if redact else [])], text=text_col, keep=keep)
