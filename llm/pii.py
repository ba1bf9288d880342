"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

Found values are checked (card numbers by their check digit, account numbers
modulo 97, addresses and dates by range) and then permuted within all values of
their format: a number stays a valid number with as many digits, a date a date.
The permutation depends on the key and the kind of value alone, so a value has
one pseudonym in all documents and distinct values keep distinct ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "phone", "card")


def feistel(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(size): an unbalanced Feistel network, walked until it falls in range."""
    left = 1
    while left * left < size:
        left *= 2
    right = -(-size // left)
    while True:
        a, b = divmod(value, right)
        m, n = left, right
        for i in range(ROUNDS):
            told = hashlib.blake2b(f"{kind}|{size}|{i}|{b}".encode(), key=key, digest_size=16).digest()
            a, b, m, n = b, (a + int.from_bytes(told, "big")) % m, n, m
        value = a * n + b
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _refill(pattern: str, digits: str) -> str:
    """The digits put in place of the pattern's."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _number(digits: str, key: bytes, kind: str) -> str:
    return str(feistel(int(digits), 10 ** len(digits), key, f"{kind}{len(digits)}")).zfill(len(digits))


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits):
        return None
    body = _number(digits[:-1], key, "card")
    return _refill(text, body + next(c for c in "0123456789" if luhn(body + c)))


def _phone(text: str, key: bytes) -> str | None:
    head = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    at = head.end() if head else 0
    digits = re.sub(r"\D", "", text[at:])
    if not 7 <= len(digits) <= 12:
        return None
    return text[:at] + _refill(text[at:], _number(digits, key, "phone"))


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(text: str, key: bytes) -> str | None:
    digits = text.replace("-", "")
    if not _ssn_valid(digits):
        return None
    digits = _number(digits, key, "ssn")
    while not _ssn_valid(digits):
        digits = _number(digits, key, "ssn")
    return _refill(text, digits)


def _iban(text: str, key: bytes) -> str | None:
    flat = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or value(flat[4:] + flat[:4]) % 97 != 1:
        return None
    digits = [c for c in flat[4:] if c.isdigit()]
    it = iter(_number("".join(digits), key, "iban")) if digits else iter("")
    body = "".join(next(it) if c.isdigit() else c for c in flat[4:])
    flat = flat[:2] + f"{98 - value(body + flat[:2] + '00') % 97:02d}" + body
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in text)


def _date(text: str, key: bytes) -> str | None:
    sep = re.search(r"\D", text)[0]
    parts = text.split(sep)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    year, month, day = (int(parts[i]) for i in order)
    for swap in ((month, day), (day, month)) if order[0] else ((month, day),):
        try:
            found = (date(year, *swap) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= found < DAYS:
            return None
        new = FIRST_DAY + timedelta(feistel(found, DAYS, key, "date"))
        out = {0: f"{new.year:04d}"} if not order[0] else {2: f"{new.year:04d}"}
        names = [i for i in (0, 1, 2) if i not in out]
        month_first = not order[0] or swap != (month, day)
        first, second = (new.month, new.day) if month_first else (new.day, new.month)
        out |= {names[0]: f"{first:02d}", names[1]: f"{second:02d}"}
        return sep.join(out[i] for i in (0, 1, 2))
    return None


def _spelled(text: str, key: bytes, kind: str, hexadecimal: bool = False) -> str:
    """Letters and digits permuted among the strings with the same kinds of characters."""
    radix, base = [], []
    for c in text:
        for low, n in (("0", 10), ("a", 6 if hexadecimal else 26), ("A", 6 if hexadecimal else 26)):
            if ord(low) <= ord(c) < ord(low) + n:
                radix.append(n)
                base.append(ord(low))
                break
        else:
            radix.append(1)
            base.append(ord(c))
    value, size = 0, 1
    for c, n, b in zip(text, radix, base):
        value, size = value * n + ord(c) - b, size * n
    value = feistel(value, size, key, f"{kind}{radix}") if size > 1 else 0
    out = []
    for n, b in zip(reversed(radix), reversed(base)):
        value, x = divmod(value, n)
        out.append(chr(b + x))
    return "".join(reversed(out))


def _email(text: str, key: bytes) -> str | None:
    name, host = text.rsplit("@", 1)
    host, top = host.rsplit(".", 1)
    return f"{_spelled(name, key, 'email')}@{_spelled(host, key, 'host')}.{top}"


def _secret(text: str, key: bytes) -> str | None:
    return _spelled(text, key, "secret", True) if re.search(r"[a-f]", text, re.I) and re.search(r"\d", text) else None


_change: dict[str, Callable[[str, bytes], str | None]] = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
_email_pattern = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_patterns = {
    "secret": r"[0-9a-f]{32,128}|[0-9A-F]{32,128}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.\d)",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./-]\d{2}[./-]\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
_before, _after = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_found = re.compile(rf"(?<![\w.+-])(?P<email>{_email_pattern})|{_before}(?:" + "|".join(f"(?P<{k}>{p})" for k, p in _patterns.items()) + f"){_after}")
#: Each kind's pattern alone; where a match can take in what follows a value, one for each length, longest first.
_alone = {k: [re.compile(f"{_before}(?:{p}){_after}")] for k, p in _patterns.items()} | {
    "iban": [re.compile(rf"{_before}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}{_after}") for n in range(34, 14, -1)],
    "card": [re.compile(rf"{_before}\d(?:[ -]?\d){{{n - 1}}}{_after}") for n in range(19, 12, -1)],
}


@lru_cache(100_000)
def _pseudonym(kind: str, text: str, key: bytes) -> str | None:
    return _change[kind](text, key)


def _other(text: str, at: int, key: bytes) -> tuple[str, str, str] | None:
    """Kind, value and pseudonym of the first match at a place that passes its check."""
    for kind, patterns in _alone.items():
        for pattern in patterns:
            if (m := pattern.match(text, at)) and (new := _pseudonym(kind, m[0], key)) is not None:
                return kind, m[0], new
    return None


#: Every pattern needs a digit or an at sign, which most words don't have.
_hint = re.compile(r"[0-9@]|[0-9A-Fa-f]{32}")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and where each stands and of what kind."""
    if not _hint.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    m = _found.search(text)
    while m:
        start, kind, old = m.start(), m.lastgroup, m[0]
        new = _pseudonym(kind, old, key)
        if new is None:
            # the match may have taken in what follows a value, or another kind may stand here
            found = _other(text, start, key)
            if found is None:
                m = _found.search(text, start + 1)
                continue
            kind, old, new = found
        out += (text[at:start], new)
        size += start - at
        spans.append({"kind": kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = start + len(old)
        m = _found.search(text, at)
    return "".join([*out, text[at:]]), spans


def _replaced(text: str, key: bytes):
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else pseudonymise(t, key) for t in batch.column(text).to_pylist()]
            cols = [pa.array([d[0] for d in done], pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([d[1] for d in done], found)], [*batch.schema.names, "pii"])

    return run


def pseudonyms(docs: DataFrame, *, key: bytes, text: str = "text") -> DataFrame:
    """`docs` with pseudonyms in the text, and a column pii of (kind, start, end), in characters of the new text.

    A null text stays null and has no entries; an existing column pii is
    replaced. Equal values have equal pseudonyms in every row.
    """
    docs = docs.drop("pii").withColumn(text, F.col(text).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_replaced(text, key), f"{fields}, pii array<struct<kind:string,start:int,end:int>>")
