"""Format-preserving pseudonyms by a keyed Feistel permutation.

A value that its format's own check accepts (Luhn, mod 97, calendar, octet range, area rules) is mapped to
another value of the same format: digits stay digits, separators stay in place, check digits hold again. The
map is a permutation per format and key, so equal values stay linked across documents and can be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, releasing, unused

ROUNDS = 10
#: Characters that one permutation takes; longer values go chunk by chunk, each tweaked by the chunk before.
CHUNK = 128

PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@]))
    |(?P<secret>(?<=["'= :])(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))
    |(?P<token>(?<![0-9A-Za-z_-])(?:gh[opusr]_[0-9A-Za-z]{36}|AKIA[0-9A-Z]{16}|xox[abprs]-[0-9A-Za-z-]{10,250}|sk-[0-9A-Za-z_-]{20,250})(?![0-9A-Za-z_-]))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\ [A-Z0-9]{4}){2,7}(?:\ [A-Z0-9]{1,4})?)(?![A-Za-z0-9]))
    |(?P<card>(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}(?P<sep>[\ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}|[0-9]{4}(?P<sep2>[\ -])[0-9]{6}(?P=sep2)[0-9]{5})(?![0-9A-Za-z]))
    |(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))
    |(?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\ .-]?)?(?:\([0-9]{3}\)[\ .-]?|(?<=[0-9+\ .-])[0-9]{3}[\ .-]|[0-9]{3}[.-])[0-9]{3}[\ .-][0-9]{4}(?![0-9A-Za-z]))
    |(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9]))
    |(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))""",
    re.VERBOSE,
)
WORTH_A_LOOK = re.compile(r"[0-9@]|gh[opusr]_|AKIA|xox|sk-")
#: The openings of well-known access tokens; they stay, the rest is permuted.
TOKEN_HEADS = ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "AKIA", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk-")
KINDS = ("email", "secret", "token", "iban", "card", "ssn", "phone", "date", "ip")


def permute(value: int, modulus: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..modulus-1: an alternating Feistel network over two halves, walked until in range."""
    if modulus < 2:
        return value
    a = isqrt(modulus - 1) + 1
    b = -(-modulus // a)
    blocks = 1 + a.bit_length() // 192  # a draw is well longer than a half

    def turn(i: int, half: int) -> int:
        seed = f"{tweak}|{modulus}|{i}|{half}".encode()
        draw = lambda n: hashlib.blake2b(seed + n, key=key[:64], digest_size=32).digest()
        return int.from_bytes(b"".join(draw(bytes([n])) for n in range(blocks)), "big")

    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * turn(i, left)) % b
            else:
                left = (left + sign * turn(i, right)) % a
        value = left * b + right
        if value < modulus:
            return value


def walk(value: int, modulus: int, key: bytes, tweak: str, valid, back: bool) -> int:
    """The same permutation, walked on until the value is valid again: a permutation of the valid values."""
    while True:
        value = permute(value, modulus, key, tweak, back)
        if valid(value):
            return value


def _luhn_digit(body: str) -> int:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if _luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    valid = lambda v: len(set(f"{v:0{n}d}" + str(_luhn_digit(f"{v:0{n}d}")))) > 1
    body = f"{walk(int(d[:-1]), 10**n, key, 'card', valid, back):0{n}d}"
    return _refill(s, body + str(_luhn_digit(body)))


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    def valid(v: int) -> bool:
        area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    v = int(_digits(s))
    return _refill(s, f"{walk(v, 10**9, key, 'ssn', valid, back):09d}") if valid(v) else None


def _phone(s: str, key: bytes, back: bool) -> str | None:
    """Area and exchange codes begin with 2 to 9 where numbers are assigned: a number and its pseudonym agree on either."""
    d = _digits(s)
    head, body = d[:-10], d[-10:]
    kind = lambda n: (n[0] > "1", n[3] > "1")
    valid = lambda v: kind(f"{v:010d}") == kind(body)
    return _refill(s, head + f"{walk(int(body), 10**10, key, f'phone{kind(body)}', valid, back):010d}")


_ALNUM = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789", "abcdef", "ABCDEF")


def _chained(s: str, one, back: bool) -> str:
    """one(chunk, tweak) over chunks of s; a chunk's tweak is the pseudonym (of back: the text read) before it."""
    out, before = [], ""
    for i in range(0, len(s), CHUNK):
        part = s[i : i + CHUNK]
        new = one(part, before)
        out.append(new)
        before = f"|{i}|{part if back else new}"
    return "".join(out)


def _classes(s: str, key: bytes, tweak: str, back: bool, classes: tuple[str, ...] = _ALNUM) -> str:
    """Permute all letters and digits of s within their classes, as numbers of mixed radix."""
    return _chained(s, lambda part, before: _class_chunk(part, key, tweak + before, back, classes), back)


def _class_chunk(s: str, key: bytes, tweak: str, back: bool, classes: tuple[str, ...]) -> str:
    sets = [next((a for a in classes if c in a), c) for c in s]
    value = modulus = 0
    modulus = 1
    for c, a in zip(s, sets, strict=True):
        value, modulus = value * len(a) + a.index(c), modulus * len(a)
    value = permute(value, modulus, key, tweak, back)
    out = []
    for a in reversed(sets):
        value, r = divmod(value, len(a))
        out.append(a[r])
    return "".join(reversed(out))


def _email(s: str, key: bytes, back: bool) -> str:
    local, domain = s.rsplit("@", 1)
    host, dot, top = domain.rpartition(".")
    return f"{_classes(local, key, 'local', back)}@{_classes(host, key, 'host', back)}{dot}{top}"


def _secret(s: str, key: bytes, back: bool) -> str:
    """Lower or upper case throughout: one number; mixed case: by classes of characters. Digits and letters both stay in."""
    if s not in (s.lower(), s.upper()):
        return _classes(s, key, "secret", back, _HEX)

    def one(part: str, before: str) -> str:
        n = len(part)
        valid = lambda v: n < len(s) or not ((h := f"{v:0{n}x}").isdigit() or h.isalpha())
        return f"{walk(int(part, 16), 16**n, key, 'secret' + before, valid, back):0{n}x}"

    new = _chained(s.lower(), one, back)
    return new if s == s.lower() else new.upper()


def _token(s: str, key: bytes, back: bool) -> str:
    head = next(h for h in TOKEN_HEADS if s.startswith(h))
    return head + _classes(s[len(head) :], key, "token" + head, back)


def _iban_check(country: str, bban: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def _iban(s: str, key: bytes, back: bool) -> str | None:
    flat = s.replace(" ", "")
    country, check, bban = flat[:2], flat[2:4], flat[4:]
    if not 15 <= len(flat) <= 34 or int(check) != _iban_check(country, bban):
        return None
    bban = _classes(bban, key, f"iban{country}", back)
    new = iter(country + f"{_iban_check(country, bban):02d}" + bban)
    return "".join(c if c == " " else next(new) for c in s)


def _date(s: str, key: bytes, back: bool) -> str | None:
    order = ("%Y-%m-%d",) if s[4] == "-" else ("%m/%d/%Y", "%d/%m/%Y") if "/" in s else ("%d.%m.%Y",)

    def read(text: str) -> tuple[str, int] | None:
        for f in order:
            try:
                return f, datetime.datetime.strptime(text, f).toordinal()
            except ValueError:
                continue
        return None

    if not (got := read(s)):
        return None
    form, day = got
    century = max(1, datetime.date.fromordinal(day).year // 100 * 100)
    first = datetime.date(century, 1, 1).toordinal()
    last = datetime.date(century // 100 * 100 + 99, 12, 31).toordinal()

    def show(v: int) -> str:
        d = datetime.date.fromordinal(first + v)
        return form.replace("%Y", f"{d.year:04d}").replace("%m", f"{d.month:02d}").replace("%d", f"{d.day:02d}")

    valid = lambda v: read(show(v)) == (form, first + v)  # noqa: E731  reads back in the same order of day and month
    return show(walk(day - first, last - first + 1, key, f"date{form}{century}", valid, back))


def _ip(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    # each octet keeps its number of digits, so the text keeps its length
    ranges = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
    value, modulus = 0, 1
    for p, (low, n) in zip(parts, ranges, strict=True):
        value, modulus = value * n + int(p) - low, modulus * n
    value = permute(value, modulus, key, "ip" + "".join(str(len(p)) for p in parts), back)
    out = []
    for low, n in reversed(ranges):
        value, r = divmod(value, n)
        out.append(str(low + r))
    return ".".join(reversed(out))


_MAKE = {"email": _email, "secret": _secret, "token": _token, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "date": _date, "ip": _ip}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym of the same format; None if the format's check rejects it."""
    return _MAKE[kind](value, key, back)


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with each accepted value replaced, and (kind, start, end) spans in the new text."""
    if not WORTH_A_LOOK.search(text):
        return text, []
    out, spans, done, at, size = [], [], 0, 0, 0
    while m := PATTERN.search(text, at):
        new = pseudonym(m.lastgroup if m.lastgroup in _MAKE else "card", m[0], key, back)
        if new is None:  # rejected: another format may begin within
            at = m.start() + 1
            continue
        out += [text[done : m.start()], new]
        size += m.start() - done
        spans.append((next(k for k in KINDS if m[k] is not None), size, size + len(new)))
        size += len(new)
        done = at = m.end()
    return "".join([*out, text[done:]]), spans


def configured_key(spark) -> bytes | None:
    """The key that the session names in spark.rosterlake.pii.key, or none."""
    key = spark.conf.get("spark.rosterlake.pii.key", None)
    return key.encode() if key else None


def _run(key: bytes, back: bool, names: list[str]):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            texts, spans = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                new, found = pseudonymise(t, key, back) if t is not None else (None, [])
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(spans, span)], [*b.schema.names[:-1], *names])

    return run


def pseudonymise_documents(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "pii_spans", back: bool = False) -> DataFrame:
    """docs with text_col rewritten and spans_col added: (kind, start, end) of each pseudonym in the new text.

    Kinds: e-mail, hexadecimal secrets (32 digits or more after a quote, colon, equals sign or space), access tokens
    of known openings, IBAN, payment card, US social security number, phone, date (any four-digit year, kept within
    its century), IPv4. A value that its format's check rejects stays as it is; a phone number has no check digit, so
    each one is replaced, by one whose area and exchange codes are as (un)assignable as its own. Texts of any length
    are read as a whole, long values in chunks of 128 characters. Null text stays null with no spans; empty text stays
    empty; equal rows give equal rows, null and repeated ids are passed on like every other column, whatever its name;
    a column of docs named like spans_col is replaced. An empty table gives an empty result. back=True undoes it.
    """
    if not key:
        raise ValueError("a key is needed")
    rest = [c for c in docs.columns if c not in (text_col, spans_col)]
    fields = [docs.schema[c] for c in rest]
    new, spans = unused(docs.columns, "_new", "_spans")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{new}` string", f"`{spans}` array<struct<kind:string,start:int,end:int>>"])
    out = in_small_batches(docs).select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`")).mapInArrow(releasing(_run(key, back, [new, spans])), schema)
    order = [c for c in docs.columns if c != spans_col]
    return out.select(*(F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in order), F.col(spans).alias(spans_col))
