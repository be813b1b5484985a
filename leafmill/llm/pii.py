"""Personal data and named secrets replaced by format-preserving Feistel pseudonyms.

A value found and validated (Luhn, IBAN check, octets, calendar, number plan) becomes
another valid value of its own format: x -> P^-1(P(x) + 1), where P is a keyed Feistel
permutation of the format's numbers. That map is a permutation without fixed points, so
equal values stay equal, different ones stay different, and none stays as it was.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import slices

KINDS = ("secret", "email", "phone", "ip", "card", "iban", "ssn", "date")
_ROUNDS = 8
_LATIN = "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _LATIN, _LATIN[:-1].upper())
_DAY_0, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def _round(key: bytes, tweak: bytes, i: int, half: int, bits: int) -> int:
    made = hashlib.blake2b(b"%d|%b|%d" % (i, tweak, half), key=key, digest_size=16 + bits // 8).digest()
    return int.from_bytes(made, "big") & ((1 << bits) - 1)


def _feistel(x: int, size: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A permutation of 0..size-1: a balanced Feistel net, walked on until it lands inside."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        left, right = x >> bits, x & mask
        for i in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            if back:
                left, right = right ^ _round(key, tweak, i, left, bits), left
            else:
                left, right = right, left ^ _round(key, tweak, i, right, bits)
        x = left << bits | right
        if x < size:
            return x


@lru_cache(maxsize=50_000)
def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """Another number below `size` (the same only if size is 1); `back` undoes it."""
    step = -1 if back else 1
    return _feistel((_feistel(x, size, key, tweak, False) + step) % size, size, key, tweak, True)


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _letters(value: str, key: bytes, kind: bytes, back: bool) -> str:
    """Each letter and digit replaced within its alphabet, the value permuted as one number."""
    sets = [next((a for a in _ALPHABETS if c in a), c) for c in value]
    size = number = 0
    for c, a in zip(value, sets):
        size, number = (size or 1) * len(a), number * len(a) + a.index(c)
    shape = "".join(str(_ALPHABETS.index(a)) if a in _ALPHABETS else a for a in sets)
    number = permute(number, size, key, kind + shape.encode(), back)
    out = []
    for a in reversed(sets):
        number, i = divmod(number, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _secret(m, key, back):
    """The value after the name of a secret, or after the fixed letters of an access key; hex stays hex."""
    head = "AKIA" if m.startswith("AKIA") else re.match(r"\w+\W+", m)[0]
    value = m[len(head):]
    if not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return head + _letters(value, key, b"secret", back)
    made = permute(int(value, 16), 16 ** len(value), key, b"hex%d" % len(value), back)
    return head + f"{made:0{len(value)}{'x' if value == value.lower() else 'X'}}"


def _email(m, key, back):
    local, _, host = m.partition("@")
    return _letters(local, key, b"email", back) + "@" + host


def _phone(m, key, back):
    country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d(?=\d)", m)
    rest = m[country.end():] if country else m
    digits = re.sub(r"\D", "", rest)
    if not 9 <= len(digits) <= 14:
        return None
    made = permute(int(digits), 10 ** len(digits), key, b"phone%d" % len(digits), back)
    return (country[0] if country else "") + _refill(rest, f"{made:0{len(digits)}d}")


def _ip(m, key, back):
    parts = m.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    made = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip", back)
    return ".".join(map(str, made.to_bytes(4, "big")))


def _card(m, key, back):
    digits = re.sub(r"\D", "", m)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, b'card%d' % len(digits), back):0{len(digits) - 1}d}"
    return _refill(m, body + str(luhn(body)))


def _iban(m, key, back):
    whole = m.replace(" ", "")
    if not 15 <= len(whole) <= 34 or int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 != 1:
        return None
    body = _letters(whole[4:], key, b"iban" + whole[:2].encode(), back)
    check = 98 - int("".join(str(int(c, 36)) for c in body + whole[:2] + "00")) % 97
    made = iter(f"{whole[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(made) for c in m)


def _ssn(m, key, back):
    area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    made = permute((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn", back)
    made, serial = divmod(made, 9999)
    place, group = divmod(made, 99)
    return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(m, key, back):
    first, mark, second, third = re.match(r"(\d+)(\D)(\d+)\D(\d+)", m).groups()
    orders = ["ymd"] if len(first) == 4 else ["dmy", "mdy"]
    for order in orders:
        named = dict(zip(order, (first, second, third)))
        try:
            day = date(int(named["y"]), int(named["m"]), int(named["d"])).toordinal() - _DAY_0
        except ValueError:
            continue
        if 0 <= day < _DAYS:
            made = date.fromordinal(permute(day, _DAYS, key, b"date", back) + _DAY_0)
            values = {"y": f"{made.year:04d}", "m": f"{made.month:02d}", "d": f"{made.day:02d}"}
            return mark.join(values[k] for k in order)
    return None


_CHANGE = {"secret": _secret, "email": _email, "phone": _phone, "ip": _ip, "card": _card, "iban": _iban, "ssn": _ssn, "date": _date}
_SECRET = re.compile(r"(?P<secret>(?<!\w)AKIA[0-9A-Z]{16}(?!\w)|(?<![^\W_])(?:pass(?:word|wd|phrase)|secret|token|api_?key|access_?key)\W{0,8}[=:]\W{0,8}(?=\w*\d)\w{8,})", re.ASCII | re.I)
_EMAIL = re.compile(r"(?P<email>(?<![\w.%+-])\w(?:[\w.%+-]*\w)?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?!\w))")
_NUMBER = re.compile(
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}(?P<d1>[-/.])\d{2}(?P=d1)\d{2}|\d{2}(?P<d2>[-/.])\d{2}(?P=d2)\d{4})(?![\w/-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,5}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4})(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<c1>[ -])\d{4}(?P=c1)\d{4}(?P=c1)\d{1,7}|\d{4}(?P<c2>[ -])\d{6}(?P=c2)\d{5})(?!\w))", re.ASCII)


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with each validated value replaced, and how many of each kind."""
    counts: dict[str, int] = {}

    def change(m):
        kind = next(k for k in KINDS if k in m.re.groupindex and m[k] is not None)
        made = _CHANGE[kind](m[0], key, back)
        if made is None:
            return m[0]
        counts[kind] = counts.get(kind, 0) + 1
        return made

    if "AKIA" in text or "=" in text or ":" in text:
        text = _SECRET.sub(change, text)
    if "@" in text:
        text = _EMAIL.sub(change, text)
    if _DIGITS.search(text):
        text = _NUMBER.sub(change, text)
    return text, counts


#: Every kind but email has four digits and marks in nine characters at least.
_DIGITS = re.compile(r"\d")


def pseudonymise_documents(documents: DataFrame, key: bytes, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_<kind> for each kind, n_values) of every row: map-only, each text whole.

    A null text stays null with no values; other columns are not read. Values are
    found left to right, without overlaps; e-mail addresses first.
    """
    kind = dict(documents.dtypes)[ident]

    def run(batches):
        for batch, _ in slices(batches, text):
            made, found = [], []
            for t in batch.column(1).to_pylist():
                new, counts = (None, {}) if t is None else pseudonymise(t, key)
                made.append(new)
                found.append(counts)
            counted = [pa.array([c.get(k, 0) for c in found], pa.int64()) for k in KINDS]
            total = pa.array([sum(c.values()) for c in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), *counted, total],
                                             [ident, text, *(f"n_{k}" for k in KINDS), "n_values"])

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return documents.select(ident, text).mapInArrow(run, f"{ident} {kind}, {text} string, {columns}, n_values long")


def replace_personal_data(documents: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """`documents` with the values in `text` replaced; all other columns as they were. Null stays null."""
    at = documents.columns.index(text)

    def run(batches):
        for batch, _ in slices(batches, text):
            made = [None if t is None else pseudonymise(t, key)[0] for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text, pa.array(made, batch.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)
