"""Format-preserving pseudonyms for personal data (operator 5).

Numbers and dates are found by pattern and validated (check digits, ranges, calendar). A valid value is read as
an integer within its format, permuted by a keyed Feistel network with cycle walking over exactly the format's
values, and written back with its separators; check digits are computed anew. The permutation depends only on
key, kind and format, so equal values get equal pseudonyms in every document, without any shared table, and the
key's holder can undo it.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_ROUNDS = 8


def permute(x: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """Keyed permutation of ``range(size)``: an unbalanced Feistel network on a slightly larger domain, walked
    until the value falls inside."""
    if size < 2:
        return x
    left_n = max(2, int(size ** 0.5))
    right_n = -(-size // left_n)

    def f(i: int, half: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{size}|{i}|{half}".encode(), key=key, digest_size=16)
        return int.from_bytes(h.digest(), "big")

    while True:
        a, b = divmod(x, right_n)
        for i in range(_ROUNDS - 1, -1, -1) if inverse else range(_ROUNDS):
            sign = -1 if inverse else 1
            if i % 2:
                b = (b + sign * f(i, a)) % right_n
            else:
                a = (a + sign * f(i, b)) % left_n
        x = a * right_n + b
        if x < size:
            return x


def _permute_digits(digits: list[int], radices: list[int], key: bytes, tweak: str, inverse: bool) -> list[int]:
    x, size = 0, 1
    for d, r in zip(digits, radices):
        x, size = x * r + d, size * r
    x = permute(x, size, key, tweak, inverse)
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _refill(shape: str, chars: str, is_slot: Callable[[str], bool]) -> str:
    it = iter(chars)
    return "".join(next(it) if is_slot(c) else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _card(text: str, key: bytes, inverse: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    # the leading digit names the network and stays
    body = _permute_digits([int(c) for c in digits[1:-1]], [10] * (len(digits) - 2), key, f"card{digits[0]}", inverse)
    new = digits[0] + "".join(map(str, body))
    return _refill(text, new + str(luhn(new)), str.isdigit)


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    area, group, serial = (int(x) for x in re.split(r"[- ]", text))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a, g, s = _permute_digits([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn", inverse)
    a += 1
    return _refill(text, f"{a + (a >= 666):03d}{g + 1:02d}{s + 1:04d}", str.isdigit)


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if text.startswith("+") and not text.startswith("+1"):
        if not 8 <= len(digits) <= 15:
            return None
        rest = _permute_digits([int(c) for c in digits[2:]], [10] * (len(digits) - 2), key, f"phone{digits[:2]}", inverse)
        return _refill(text, digits[:2] + "".join(map(str, rest)), str.isdigit)
    lead, number = digits[:-10], digits[-10:]
    if len(number) < 10 or lead not in ("", "1"):
        return None
    # area codes from 0 or 1 are not dealt out; written as a phone number, they are one all the same
    low = number[0] in "01"
    if low and not lead and "(" not in text:
        return None
    least, first, tweak = (0, 2, "phone1 low") if low else (2, 8, "phone1")
    out = _permute_digits([int(number[0]) - least] + [int(c) for c in number[1:]], [first] + [10] * 9, key, tweak, inverse)
    return _refill(text, lead + str(out[0] + least) + "".join(map(str, out[1:])), str.isdigit)


def _ip(text: str, key: bytes, inverse: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, _permute_digits([int(p) for p in parts], [256] * 4, key, "ip", inverse)))


_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: The days that tell a month written first: those after the 12th.
_LATE_DAYS = [n for n in range(_FIRST_DAY, _LAST_DAY + 1) if dt.date.fromordinal(n).day > 12]


def _date(text: str, key: bytes, inverse: bool) -> str | None:
    sep = "-" if "-" in text else "/" if "/" in text else "."
    parts = text.split(sep)
    year_first = len(parts[0]) == 4
    y, m, d = (int(p) for p in (parts if year_first else parts[::-1]))
    month_first = not year_first and m > 12
    if month_first:
        m, d = d, m
    try:
        n = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= n <= _LAST_DAY:
        return None
    if month_first:  # permuted among the days after the 12th, so that the pseudonym reads the same way
        at = permute(bisect.bisect_left(_LATE_DAYS, n), len(_LATE_DAYS), key, "date month first", inverse)
        new = dt.date.fromordinal(_LATE_DAYS[at])
        return sep.join((f"{new.month:02d}", f"{new.day:02d}", f"{new.year:04d}"))
    new = dt.date.fromordinal(_FIRST_DAY + permute(n - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date", inverse))
    out = [f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"]
    return sep.join(out if year_first else out[::-1])


def iban_rest(code: str) -> int:
    """Remainder modulo 97 of an account code: 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _iban(text: str, key: bytes, inverse: bool) -> str | None:
    code = text.replace(" ", "")
    if not 15 <= len(code) <= 34 or iban_rest(code) != 1:
        return None
    body = code[4:]
    radices = [10 if c.isdigit() else 26 for c in body]
    out = _permute_digits([int(c) if c.isdigit() else ord(c) - 65 for c in body], radices, key, f"iban{code[:2]}", inverse)
    new = "".join(str(x) if r == 10 else chr(65 + x) for x, r in zip(out, radices))
    check = 98 - iban_rest(code[:2] + "00" + new)
    return _refill(text, f"{code[:2]}{check:02d}{new}", lambda c: c != " ")


def _letters(text: str, key: bytes, tweak: str, inverse: bool, keep: str = "") -> str:
    """Letters and digits permuted within their classes; ``keep`` stays in front."""
    classes = [("0123456789", str.isdigit), ("abcdefghijklmnopqrstuvwxyz", str.islower),
               ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", str.isupper)]
    body = text[len(keep):]
    kind = [next((a for a, test in classes if c in a and test(c)), "") for c in body]
    slots = [(a.index(c), len(a)) for c, a in zip(body, kind) if a]
    shape = "".join(str(len(a)) + "," for a in kind)
    out = iter(_permute_digits([s for s, _ in slots], [n for _, n in slots], key,
                               tweak + hashlib.blake2b(shape.encode(), digest_size=8).hexdigest(), inverse))
    return keep + "".join(a[next(out)] if a else c for c, a in zip(body, kind))


def _email(text: str, key: bytes, inverse: bool) -> str | None:
    """Name and host are permuted together; the top-level domain stays."""
    name, _, tld = text.rpartition(".")
    return _letters(name, key, "email", inverse) + "." + tld


def _secret(text: str, key: bytes, inverse: bool) -> str | None:
    hexa = re.fullmatch(r"[0-9a-f]+", text)
    if hexa:
        return "".join(f"{x:x}" for x in _permute_digits([int(c, 16) for c in text], [16] * len(text), key, "hex", inverse))
    return _letters(text, key, "secret", inverse, keep="AKIA" if text.startswith("AKIA") else "")


_OCTET = r"\d{1,3}"
#: Kind, quick test of the whole text, pattern (the last group, or the whole match, is the value), pseudonym.
KINDS: list[tuple[str, str, re.Pattern, Callable]] = [
    ("email", "@", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.A), _email),
    ("iban", "", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"), _iban),
    ("secret", "AKIA", re.compile(r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)"), _secret),
    ("secret", "=", re.compile(r"\b(?:password|passwd|pwd|token|secret|api_?key)\s*=\s*[\"']?([A-Za-z0-9_\-]{6,})", re.I), _secret),
    ("ip", ".", re.compile(rf"(?<![\w.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?!\.?\w)"), _ip),
    ("date", "", re.compile(r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})(?![\w/-])"), _date),
    ("ssn", "-", re.compile(r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"), _ssn),
    ("phone", "+1", re.compile(r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?![\w-])"), _phone),
    ("phone", "", re.compile(r"(?<![\w+.-])(?:1[ .-]|1(?=\())?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"), _phone),
    ("phone", "+", re.compile(r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\d{2,4}){2,5}(?![\w-])"), _phone),
    ("card", "", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-])"), _card),
]
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"\d+")
#: A card within a longer run of digit groups, after other groups: in one group or in fours.
_CARD_SHAPE = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}")


def _values(kind: str, m: re.Match) -> Iterator[Iterator[tuple[int, int]]]:
    """Places of a match that may hold one value each, in alternatives of which the first valid one counts.

    A card's run of digit groups may go on with other numbers, or begin with some: from each group on, the longest
    part of whole groups with right check digits is the card.
    """
    if kind != "card":
        yield iter([m.span(m.lastindex or 0)])
        return
    groups = [(a + m.start(), b + m.start()) for a, b in (g.span() for g in _GROUP.finditer(m.group()))]
    for i, (start, _) in enumerate(groups):
        ends, digits = [], 0
        for a, b in groups[i:]:
            digits += b - a
            if digits > 19:
                break
            if digits >= 13 and (i == 0 or _CARD_SHAPE.fullmatch(m.string, start, b)):
                ends.append(b)
        yield ((start, b) for b in reversed(ends))


def findings(text: str | None, key: bytes) -> list[tuple[int, int, str, str]]:
    """``(start, length, kind, pseudonym)`` of the valid values of a text, left to right, without overlaps.

    Earlier kinds of ``KINDS`` win where two would overlap.
    """
    out: list[tuple[int, int, str, str]] = []
    if not text:
        return out
    digit = _DIGIT.search(text) is not None
    for kind, need, pattern, pseudonym in KINDS:
        if (need and need not in text) or not (digit or kind in ("email", "secret")):
            continue
        for m in pattern.finditer(text):
            for places in _values(kind, m):
                for start, end in places:
                    if any(start < s + n and s < end for s, n, _, _ in out):
                        continue
                    new = pseudonym(text[start:end], key, False)
                    if new is not None:
                        out.append((start, end - start, kind, new))
                        break
    return sorted(out)


def rewritten(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with every value replaced by its pseudonym."""
    parts, at = [], 0
    for start, size, _, new in found:
        parts += [text[at:start], new]
        at = start + size
    return "".join(parts) + text[at:]


def personal_data(docs: DataFrame, key: str) -> DataFrame:
    """One row per value found: ``doc_id, kind, start, length, pseudonym``. Texts without any give no row.

    Null and empty texts give none. Rows repeated in the input give their findings again.
    """
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [(doc, kind, start, size, new)
                    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                    for start, size, kind, new in findings(text, secret)]
            yield dict(zip(("doc_id", "kind", "start", "length", "pseudonym"), zip(*rows) if rows else [[]] * 5))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                     "doc_id long, kind string, start long, length int, pseudonym string")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` of every row with the values replaced; a null text stays null."""
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = b.column("text").to_pylist()
            yield {"doc_id": b.column("doc_id"),
                   "text": [t and rewritten(t, findings(t, secret)) for t in texts]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text string")
