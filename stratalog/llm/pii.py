"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated: card numbers by their check digit,
account numbers by theirs, dates by the calendar, addresses by their parts. Each
is mapped by a keyed Feistel permutation of the set of values of its own format,
so the result is valid in that format, equal values stay equal in every document,
and the key inverts it. Dates keep the digits of their fields: those whose day and
month have two each are permuted together, however they are written, others among
dates of their form, and a day that could be no month stays one. Mail addresses
are equal whatever their case, which stays, as do their domains. A match that fails validation is tried again by its shorter
prefixes at group ends, by the other kinds, and from its later groups; there a card
must be grouped and begin as cards do, for a tenth of all numbers pass its check.
What fails all of this stays as it is.

Null and empty texts stay as they are. Rows are handled each by itself, repeated ones
alike; an empty table gives no rows. Texts of any length are searched whole.
"""

from __future__ import annotations

import bisect
import calendar
import hashlib
import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import slices

ROUNDS = 8
#: Dates are permuted among those of these years.
YEARS = range(1900, 2100)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


class Feistel:
    """A keyed permutation of range(n) for any n: Feistel rounds over two halves of mixed radix, walked along its cycle until the value is in range."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: bytes, i: int, x: int, m: int) -> int:
        h = hashlib.blake2b(b"%b|%d|%d" % (tweak, i, x), key=self.key, digest_size=24)
        return int.from_bytes(h.digest(), "big") % m

    def _once(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._f(tweak, i, left, b)) % b
            else:
                left = (left + sign * self._f(tweak, i, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        b = 1 << -(-n.bit_length() // 2)
        a, t = -(-n // b), f"{tweak}|{n}".encode()
        while True:
            x = self._once(x, a, b, t, back)
            if x < n:
                return x


@lru_cache(maxsize=16)
def dates_of(month: int, day: int, late: bool) -> list[tuple[int, int, int]]:
    """The dates whose month and day are written with so many digits, two of them with a leading zero where one is enough; with ``late``, of days that could be no month."""
    months, days = (range(1, 10) if n == 1 else range(1, 100) for n in (month, day))
    ends = {y: [calendar.monthrange(y, m)[1] for m in range(1, 13)] for y in YEARS}
    out = [(y, m, d) for y in YEARS for m in range(1, 13) if m in months for d in range(13 if late else 1, ends[y][m - 1] + 1) if d in days]
    # Two digits and one can't stand for the same date in one text: 1/10 has a month of one, 10/1 of two.
    return [x for x in out if not (month == 2 and day == 1 and x[1] < 10) and not (month == 1 and day == 2 and x[2] < 10)]


def luhn(digits: str) -> str:
    """The check digit that the digits before it ask for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - value % 97:02d}"


def _refill(shape: str, chars: str) -> str:
    """Put characters in the places of the letters and digits of a shape."""
    own = iter(chars)
    return "".join(next(own) if c.isascii() and c.isalnum() else c for c in shape)


#: Patterns of the kinds, tried in this order where they overlap.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|token)\s?[=:]\s?[\"']?)[A-Za-z0-9_+/.-]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,9}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:.])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w-]|[/.]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
}
DIGIT_PATTERNS = {k: re.compile(p) for k, p in PATTERNS.items() if k not in ("email", "secret")}
DIGIT_KINDS = re.compile("|".join(f"(?P<{k}>{p.pattern})" for k, p in DIGIT_PATTERNS.items()))
#: Cards as they are usually grouped.
CARD = re.compile(r"(?=[3-6]|2[2-7])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})")
#: International numbers in three groups after the country's.
THREE = re.compile(r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}")
#: Digits after the code of countries where their number is fixed.
NATIONAL = {"1": (10,), "7": (10,), "30": (10,), "31": (9,), "32": (9, 8), "33": (9,), "34": (9,), "41": (9,), "44": (10, 9), "45": (8,), "47": (8,), "48": (9,), "351": (9,), "420": (9,)}
OTHER = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in ("email", "secret")))
SECRET_VALUE = re.compile(r"[=:]\s?[\"']?(.*)\Z", re.S)
HAS_DIGITS = re.compile(r"\d\d|\d[/.]|::")
HAS_OTHER = re.compile(r"@|(?i:pass|pwd|secret|key|token)")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.of = lru_cache(maxsize=200_000)(self._of)

    def _chars(self, value: str, kind: str) -> str:
        """Permute letters among letters and digits among digits, each class by all its characters together; hexadecimal values among such."""
        if kind == "secret" and re.fullmatch(r"[0-9a-f]{16,}", value):
            return f"{self.feistel.permute(int(value, 16), 16 ** len(value), f'{kind}hex'):0{len(value)}x}"
        for alphabet in (UPPER, LOWER, DIGITS):
            own = [c for c in value if c in alphabet]
            if own:
                n, x = len(alphabet), 0
                for c in own:
                    x = x * n + alphabet.index(c)
                x = self.feistel.permute(x, n ** len(own), f"{kind}{alphabet[0]}{''.join('x' if c in alphabet else c for c in value)}")
                out = []
                for _ in own:
                    x, r = divmod(x, n)
                    out.append(alphabet[r])
                new = iter(reversed(out))
                value = "".join(next(new) if c in alphabet else c for c in value)
        return value

    def _number(self, digits: str, kind: str) -> str:
        return f"{self.feistel.permute(int(digits), 10 ** len(digits), kind):0{len(digits)}d}"

    def _email(self, local: str) -> str:
        """Letters without regard to case, which they keep."""
        new = self._chars(local.lower(), "email") if local.isascii() else self._chars(local, "email")
        return "".join(c.upper() if o.isupper() else c for o, c in zip(local, new))

    def _date(self, value: str) -> str | None:
        sep = next(c for c in value if not c.isdigit())
        parts = value.split(sep)
        a, b, c = map(int, parts)
        month_first = sep == "/" and not a > 12  # 13/1/2020 can only have the day first
        y, m, d = (0, 1, 2) if sep == "-" else (2, 0, 1) if month_first else (2, 1, 0)
        days = dates_of(len(parts[m]), len(parts[d]), sep == "/" and not month_first)
        day = (int(parts[y]), int(parts[m]), int(parts[d]))
        at = bisect.bisect_left(days, day)
        if at == len(days) or days[at] != day:
            return None
        new = days[self.feistel.permute(at, len(days), "date")]
        for i, n in zip((y, m, d), new):
            parts[i] = f"{n:0{len(parts[i])}d}"
        return sep.join(parts)

    def _of(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value, None where it isn't valid."""
        digits = "".join(c for c in value if c.isdigit() and c.isascii())
        if kind == "email":
            local, _, domain = value.rpartition("@")
            return f"{self._email(local)}@{domain}"
        if kind == "key":
            return value[:4] + self._chars(value[4:], "key")
        if kind == "secret":
            at = SECRET_VALUE.search(value).start(1)
            return value[:at] + self._chars(value[at:], "secret") if any(c.isdigit() for c in value[at:]) else None
        if kind == "iban":
            packed = value.replace(" ", "")
            if not 15 <= len(packed) <= 34 or iban_check(packed[:2], packed[4:]) != packed[2:4]:
                return None
            rest = self._chars(packed[4:], "iban")
            return _refill(value, packed[:2] + iban_check(packed[:2], rest) + rest)
        if kind == "phone":
            lead = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
            keep = len(lead[1]) if lead else 0
            return _refill(value, digits[:keep] + self._number(digits[keep:], "phone")) if 9 <= len(digits) <= 15 else None
        if kind == "ip6":
            try:
                ipaddress.IPv6Address(value)
            except ValueError:
                return None
            own = "".join(c for c in value if c != ":")
            new = iter(f"{self.feistel.permute(int(own, 16), 16 ** len(own), 'ip6'):0{len(own)}x}")
            return "".join(c if c == ":" else x.upper() if value.isupper() else x for c in value if (x := c if c == ":" else next(new)))
        if kind == "ip":
            parts = value.split(".")
            if any(int(x) > 255 for x in parts):
                return None
            # Each number keeps its digits, and its leading zero if it has one.
            span = [range(10 ** (len(x) - 1)) if len(x) > 1 and x[0] == "0" else range(10 ** (len(x) - 1) if len(x) > 1 else 0, min(256, 10 ** len(x))) for x in parts]
            at = size = 0
            for x, r in zip(parts, span):
                at = at * len(r) + int(x) - r.start
            for r in span:
                size = (size or 1) * len(r)
            at = self.feistel.permute(at, size, f"ip{[r.start for r in span]}")
            out = []
            for x, r in zip(reversed(parts), reversed(span)):
                at, k = divmod(at, len(r))
                out.append(f"{r.start + k:0{len(x)}d}")
            return ".".join(reversed(out))
        if kind == "date":
            return self._date(value)
        if kind == "ssn":
            if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000":
                return None
            area = [x for x in range(1, 900) if x != 666]
            x = (area.index(int(value[:3])) * 99 + int(value[4:6]) - 1) * 9999 + int(value[7:]) - 1
            x, serial = divmod(self.feistel.permute(x, len(area) * 99 * 9999, "ssn"), 9999)
            x, group = divmod(x, 99)
            return f"{area[x]:03d}-{group + 1:02d}-{serial + 1:04d}"
        if luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self._number(digits[:-1], "card")
        return _refill(value, body + luhn(body))

    @staticmethod
    def _ends(kind: str, text: str, i: int, end: int) -> list[int]:
        """Where a value of a kind may end, best first: the match's end and the group ends before it."""
        if kind not in ("card", "iban", "phone"):
            return [end]
        ends = [end, *(k for k in range(end - 1, i, -1) if not text[k].isalnum() and text[k] != ")" and (text[k - 1].isalnum() or text[k - 1] == ")"))]
        if kind != "phone" or text[i] != "+":
            return ends
        size = {k: sum(c.isdigit() for c in text[i:k].replace("(0)", "")) for k in ends}
        lead = re.match(r"\d{1,3}(?=[ .(-])", text[i + 1 : end])
        codes = [lead[0]] if lead else [text[i + 1 : i + 1 + n] for n in (3, 2, 1)]
        fixed = [k for c in codes for n in NATIONAL.get(c, ()) for k in ends if size[k] == len(c) + n]
        return [*fixed, *(k for k in ends if THREE.fullmatch(text, i, k)), *ends]

    def _at(self, text: str, i: int, inner: bool) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the value that begins here; ``inner`` if a card that failed covers the place."""
        for kind, pattern in DIGIT_PATTERNS.items():
            if not (m := pattern.match(text, i)):
                continue
            for j in self._ends(kind, text, i, m.end()):
                if j < m.end() and not pattern.fullmatch(text, i, j) or kind == "card" and (inner or j < m.end()) and not CARD.fullmatch(text, i, j):
                    continue
                if (new := self.of(kind, text[i:j])) is not None:
                    return kind, j, new
        return None

    def _digit_values(self, text: str, others: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
        """Values with digits but those that one of the others covers."""
        found, at, failed, k = [], 0, 0, 0
        while m := DIGIT_KINDS.search(text, at):
            i = m.start()
            hit = self._at(text, i, i < failed)
            while k < len(others) and others[k][2] <= i:
                k += 1
            if hit and k < len(others) and (others[k][1], -others[k][2]) < (i, -hit[1]):
                at = others[k][2]
            elif hit:
                found.append((hit[0], i, hit[1], hit[2]))
                at = hit[1]
            else:
                failed = max(failed, m.end()) if m.lastgroup == "card" else failed
                at = i + 1
        return found

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the new text."""
        found = []
        if HAS_OTHER.search(text):
            found = [(m.lastgroup, m.start(), m.end(), new) for m in OTHER.finditer(text) if (new := self.of(m.lastgroup, m[0])) is not None]
        if HAS_DIGITS.search(text):
            found += self._digit_values(text, found)
        if not found:
            return text, []
        out, spans, at, size = [], [], 0, 0
        for kind, i, j, new in sorted(found, key=lambda x: (x[1], -x[2])):
            if i < at:
                continue
            out += [text[at:i], new]
            size += i - at
            spans.append((kind, size, size + len(new)))
            size += len(new)
            at = j
        return "".join([*out, text[at:]]), spans


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text, spans) of each row, spans as (kind, start, end) in the new text; ``carry`` names columns that come along in a struct ``carried``."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    more = f", carried {docs.schema['carried'].dataType.simpleString()}" if carry else ""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        p = pseudonyms(key)
        for batch in batches:
            for part in slices(batch, 1):
                new = [(None, []) if t is None else p.replace(t) for t in part.column(1).to_pylist()]
                spans = [[{"kind": k, "start": i, "end": j} for k, i, j in s] for _, s in new]
                rest = [part.column(i) for i in range(2, part.num_columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in new], pa.string()), pa.array(spans, kind), *rest], ["doc_id", "text", "spans", *["carried"] * len(rest)])

    return docs.mapInArrow(run, "doc_id bigint, text string, spans array<struct<kind:string,start:int,end:int>>" + more)
