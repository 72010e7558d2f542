"""Personal data in texts, found as written and behind disguises, with offsets in the source.

Plain identifiers are matched on the text itself. For disguised ones a chain of small transducers
rewrites the text and carries, for every character it writes, the source span it stands for:
look-alike letters and digits become ASCII, bracketed or spelled *at* and *dot* become ``@`` and
``.``, and spelled digits become digits in runs and beside digits. Each sign is judged by what stands
next to it, never by the rest of the text. The same matchers run on the result, and what they
find is mapped back to code-point offsets of the source. All matchers take time linear in the text.
Rows are handled where they lie; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import batch_rows, quoted

BATCH = 2048  # rows that are read at once
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, ``@`` and a dotted domain: a local part reaches back to the last match."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def ips(text: str) -> list[Span]:
    """Four dotted numbers up to 255; a longer chain is taken four at a time."""
    found = []
    if "." not in text:
        return found
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_byte, four)):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]


def identifiers(text: str) -> dict[str, list[Span]]:
    """Spans per kind in the order of ``KINDS``."""
    if not DIGIT.search(text):
        return {"email": emails(text), "ip": [], "card": [], "phone": []}
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


# ------------------------------------------------------------------ the transducers
#: Letters of other scripts that look like an ASCII letter, and that letter.
LOOK_ALIKES = {
    "а": "a", "с": "c", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
    " ": " ", " ": " ", " ": " ",
}


def _single(code: int) -> str | None:
    """The one ASCII character that compatibility folding gives (full-width, mathematical, circled)."""
    folded = unicodedata.normalize("NFKC", chr(code))
    return folded if len(folded) == 1 and folded.isascii() and folded.isprintable() else None


_FOLDED = {c: f for a, b in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EA)) for c in range(a, b) if (f := _single(c))}
ONE_TO_ONE = {ord(k): v for k, v in LOOK_ALIKES.items()} | _FOLDED
ODD = re.compile("[" + "".join(map(re.escape, map(chr, ONE_TO_ONE))) + "]")
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
BETWEEN = re.compile(r"[\s,-]{1,3}")
PLUS = re.compile(r"(?<![a-z0-9])plus[\s,-]{1,3}\Z", re.I)
#: What makes a run of less than three spelled digits part of a number.
BEFORE, AFTER = re.compile(r"(?:[0-9](?:[\s,-]{1,3}|\.)|\+\s?)\Z"), re.compile(r"(?:[\s,-]{1,3}|\.)[0-9]")
_OPEN, _CLOSE = r"\s{0,2}[(\[{<]\s{0,2}", r"\s{0,2}[)\]}>]\s{0,2}"
#: A bracketed sign or a spelled dot anywhere; a spelled *at* only before a domain with a dot that was written here.
BRACKETED = re.compile(rf"{_OPEN}(at|@|dot|\.){_CLOSE}", re.I)
SIGN = re.compile(r"[(\[{<]\s{0,2}(?:at|@|dot|\.)\s{0,2}[)\]}>]", re.I)
SIGNS = {"at": "@", "@": "@", "dot": ".", ".": "."}
SPOKEN_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,2}(dot)\s{1,2}(?=[A-Za-z0-9])", re.I)
SPOKEN_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])\s{1,2}at\s{1,2}(?=[A-Za-z0-9-])", re.I)


class Traced:
    """A rewritten text that knows for each of its characters the source span it stands for.

    The text is a row of segments, each either copied from the source or standing for one span of it;
    what is kept grows with the rewrites, not with the text.
    """

    def __init__(self, text: str):
        self.text = text
        # where a segment begins here and in the source, and where its span ends, -1 if it is a copy
        self.at, self.src, self.end = [0], [0], [-1]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans by other texts; each new character stands for the whole span."""
        if not edits:
            return
        pieces, at, src, end, length, done = [], [], [], [], 0, 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            if done < a:
                pieces.append(self.text[done:a])
                k = bisect_right(self.at, done) - 1
                while k < len(self.at) and self.at[k] < a:
                    begin = max(self.at[k], done)
                    at.append(length + begin - done)
                    src.append(self.src[k] + (begin - self.at[k] if self.end[k] < 0 else 0))
                    end.append(self.end[k])
                    k += 1
                length += a - done
            if new:
                pieces.append(new)
                at.append(length)
                first, last = self.source((a, b))
                src.append(first)
                end.append(last)
                length += len(new)
            done = b
        self.text, self.at, self.src, self.end = "".join(pieces), at or [0], src or [0], end or [-1]

    def start(self, place: int) -> int:
        k = bisect_right(self.at, place) - 1
        return self.src[k] + (place - self.at[k] if self.end[k] < 0 else 0)

    def source(self, span: Span) -> Span:
        last = span[1] - 1
        k = bisect_right(self.at, last) - 1
        return self.start(span[0]), self.src[k] + last - self.at[k] + 1 if self.end[k] < 0 else self.end[k]


def _number_words(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits that stand as words, with the digit."""
    low = text.lower()
    if len(low) != len(text):  # a letter with a longer lower case
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    found = []
    for word, digit in DIGIT_WORDS.items():
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if low[at - 1 : at] not in ALNUM and low[end : end + 1] not in ALNUM:
                found.append((at, end, digit))
            at = low.find(word, end)
    return sorted(found)


def _spelled_edits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Digits for spelled ones: edits of the runs of three or more, and of all runs that are part of a number.

    Shorter runs are part of one next to a digit, a plus or, by a dot, another spelled digit. What
    stands between two spelled digits goes into the later one's span; a dot stays.
    """
    words = _number_words(text)
    long, every, k = [], [], 0
    while k < len(words):
        first, dots, length, most = k, 0, 1, 1
        while (k := k + 1) < len(words):
            between = text[words[k - 1][1] : words[k][0]]
            if between != "." and not BETWEEN.fullmatch(between):
                break
            length = 1 if between == "." else length + 1
            dots, most = dots + (between == "."), max(most, length)
        start, end = words[first][0], words[k - 1][1]
        plus = PLUS.search(text, max(0, start - 8), start)
        if most < 3 and not (dots or plus or BEFORE.search(text, max(0, start - 4), start) or AFTER.match(text, end)):
            continue
        edits, at = ([(plus.start(), plus.start() + 4, "+")], plus.start() + 4) if plus else ([], start)
        for a, b, digit in words[first:k]:
            edits.append((a if text[at:a] == "." else at, b, digit))
            at = b
        every += edits
        if most >= 3:
            long += edits
    return long, every


def _unspoken(traced: Traced, source: str) -> Traced:
    """``traced`` with ``@`` for a spelled *at* before a domain that has a dot not in ``source``."""
    edits = []
    for at in SPOKEN_AT.finditer(traced.text):
        domain = DOMAIN.match(traced.text, at.end())
        if domain and any(c == "." and source[traced.start(k)] != "." for k, c in enumerate(domain.group(), at.end())):
            edits.append((*at.span(), "@"))
    traced.rewrite(edits)
    return traced


def normalised(text: str) -> list[Traced]:
    """The text without disguises, none if it has none; a second one where shorter spelled runs join numbers.

    Those can as well be words after a number, so the text is also read without them.
    """
    plain = text if text.isascii() or not ODD.search(text) else text.translate(ONE_TO_ONE)
    patterns = [BRACKETED] if any(c in plain for c in "([{<") and SIGN.search(plain) else []
    if "dot" in plain.lower() and (patterns or SPOKEN_DOT.search(plain)):
        patterns.append(SPOKEN_DOT)

    def signed() -> Traced:
        traced = Traced(plain)
        for pattern in patterns:
            traced.rewrite([(*m.span(), SIGNS[m.group(1).lower()]) for m in pattern.finditer(traced.text)])
        return traced

    long, every = _spelled_edits(signed().text if patterns else plain)
    if plain is text and not patterns and not every:
        return []
    out = []
    for edits in [long] if long == every else [long, every]:
        traced = signed()
        traced.rewrite(edits)
        out.append(_unspoken(traced, text))
    return out


def _within(span: Span, others: list[Span]) -> bool:
    """Whether one of ``others``, which are in order and apart, holds the whole span."""
    k = bisect_right(others, span[0], key=lambda s: s[0]) - 1
    return k >= 0 and span[1] <= others[k][1]


def _widest(spans: set[Span]) -> list[Span]:
    """The spans that lie in no other one."""
    out: list[Span] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and all spans: a disguised one is added unless a plain one of its kind holds all of it."""
    base = identifiers(text or "")
    read = normalised(text) if text else []
    if not read:
        return base, base
    found = {kind: set() for kind in KINDS}
    for traced in read:
        for kind, spans in identifiers(traced.text).items():
            found[kind].update(map(traced.source, spans))
    return base, {kind: sorted([*own, *(s for s in _widest(found[kind]) if not _within(s, own))]) for kind, own in base.items()}


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping ones by the first's."""
    if not text:
        return text
    _, found = find(text)
    spans = sorted((a, b, kind) for kind, own in found.items() for a, b in own)
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


SPANS = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans and the list of all spans of each row's text.

    A null text counts as empty; repeated rows and null ids are rows like any other; other columns
    are ignored; an empty table gives no rows. ``n_*`` and ``base_sha256`` are of the plain spans.
    """
    batch_rows(docs.sparkSession, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = [], [], []
            for text in batch.column(1):
                base, found = find(text.as_py())
                counts.append([len(base[k]) for k in KINDS])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                lists.append(written(found))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.record_batch(
                [batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                names=[f.split()[0] for f in SPANS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SPANS)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; ``n_chars``, if there, follows the new text.

    A null or empty text stays as it is; rows that repeat are rows of their own; an empty table gives
    no rows. Other columns may have any names.
    """
    batch_rows(docs.sparkSession, BATCH)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*[quoted(c) for c in others]).alias("_row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(text.as_py()) for text in batch.column(1)], batch.schema.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], schema=batch.schema)

    cleaned = rows.mapInArrow(run, rows.schema)
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cleaned.select(*[own[c] if c in own else F.col("_row").getField(c).alias(c) for c in docs.columns])
