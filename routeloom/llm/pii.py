"""Format-preserving pseudonyms of personal numbers, dates, addresses and keys.

Every kind has a pattern, a validator and a bijection between its valid values and the
integers below N.  A keyed balanced Feistel network with cycle walking gives a permutation
p of those integers; the pseudonym of x is ``p^-1((p(x) + s) mod N)`` with a keyed step s
in 1..N-1.  That is again a permutation, stays inside the format (check digits are
recomputed), and maps no value to itself.  Equal values get equal pseudonyms in every
document, without any table of values; the holder of the key can undo it (``reveal``).

Kinds: payment card (Luhn), IBAN (mod 97), US social security number (valid area, group and
serial), phone number with country code, IPv4 address, e-mail address (its local part),
calendar date (1900 to 2099), access key id and quoted token or key assignments.

Defined results: a null text stays null, an empty text stays empty; texts are scanned whole;
values that fail validation stay as they are; overlapping candidates go to the first kind in
the order above; a phone number ends before an address, a date or any other value behind it, and
where its country fixes the number of digits, there; repeated rows give equal results; columns other than text keep their values.
"""

from __future__ import annotations

import datetime
import hashlib
from bisect import bisect_right
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

ROUNDS = 8
#: Public, hence no protection: for the query and for tests.  Everything else must bring a key of its own.
DEMO_KEY = b"routeloom demonstration key"
#: Country codes whose national numbers have one length.
NATIONAL_DIGITS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "65": 8, "91": 10, "351": 9, "420": 9, "852": 8}
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of the integers 0..size-1 without fixed points (for size over 1)."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(tweak.encode() + b"|" + str(size).encode(), key=key[:64], digest_size=32).digest()
        self.step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=self.key, digest_size=16).digest(), "big") % max(1, size - 1)

    def _f(self, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(bytes([i]) + half.to_bytes(32, "big"), key=self.key, digest_size=32).digest(), "big") & self.mask

    def _walk(self, x: int, rounds) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in rounds:
                if rounds.step > 0:
                    left, right = right, left ^ self._f(i, right)
                else:
                    left, right = right ^ self._f(i, left), left
            x = left << self.half | right
            if x < self.size:
                return x

    def forward(self, x: int, sign: int = 1) -> int:
        if self.size < 2:
            return x
        y = (self._walk(x, range(ROUNDS)) + sign * self.step) % self.size
        return self._walk(y, range(ROUNDS - 1, -1, -1))

    def backward(self, x: int) -> int:
        return self.forward(x, -1)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_remainder(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


Turn = Callable[[str, int], int]
#: (tweak, size, value) -> value: the permutation in the direction asked for.
Permute = Callable[[str, int, int], int]


def _by_class(text: str, tweak: str, permute: Permute, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
    """Permute the string within its shape: each character stays in its alphabet, others stay as they are."""
    shape, value, size = [], 0, 1
    for c in text:
        a = next((a for a in alphabets if c in a), None)
        shape.append(a)
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if size < 2:
        return text
    value, out = permute(f"{tweak}:{''.join(a[0] if a else c for a, c in zip(shape, text))}", size, value), []
    for a, c in zip(reversed(shape), reversed(text)):
        if a:
            value, r = divmod(value, len(a))
            c = a[r]
        out.append(c)
    return "".join(reversed(out))


def _put_digits(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def _card(m: re.Match, permute: Permute) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2
    for_body = f"{permute(f'card{digits[0]}', 10**n, int(digits[1:-1])):0{n}d}"
    body = digits[0] + for_body
    return _put_digits(m[0], body + str(-luhn(body + "0") % 10))


def _iban(m: re.Match, permute: Permute) -> str | None:
    compact = m[0].replace(" ", "")
    if not 15 <= len(compact) <= 34 or iban_remainder(compact) != 1:
        return None
    body = _by_class(compact[4:], f"iban{compact[:2]}", permute)
    new = iter(f"{compact[:2]}{98 - iban_remainder(compact[:2] + '00' + body):02d}{body}")
    return "".join(" " if c == " " else next(new) for c in m[0])


def _ssn(m: re.Match, permute: Permute) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(permute("ssn", 898 * 99 * 9999, rank), 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(m: re.Match, permute: Permute) -> str | None:
    rest = m[2]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 12:
        return None
    n = len(digits)
    return m[1] + _put_digits(rest, f"{permute(f'phone{m[1]}{n}', 10**n, int(digits)):0{n}d}")


def _phone_alone(m: re.Match, stop: int) -> re.Match | None:
    """The phone number at the start of the match, before ``stop`` and without values behind it that the pattern took for more of its groups."""
    text, start, code = m.string, m.start(), m[1][1:]
    groups = [g.start() for g in re.finditer(r"(?<=\s)\d", m[0])]
    # by their shapes, which pseudonyms keep
    behind = min((start + g for g in groups if any(KINDS[k][0].match(text, start + g) for k in ("ip", "date"))), default=len(text))
    ends = [m.end(), *sorted({start + g.start() for g in re.finditer(r"(?<=[\d)])[ .-]", m[0])}, reverse=True)]
    found = [x for e in ends if e <= stop and (x := m.re.fullmatch(text, start, e)) and 7 <= sum(c in DIGITS for c in x[2]) <= 12]
    found = [x for x in found if x.end() <= behind] or found
    fixed = next((k + NATIONAL_DIGITS[code[:k]] for k in range(1, len(code) + 1) if code[:k] in NATIONAL_DIGITS), 0)
    return next((x for x in found if sum(c in DIGITS for c in x[0]) == fixed), found[0] if found else None)


def _ip(m: re.Match, permute: Permute) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    # each octet keeps its number of digits: 0-9, 10-99 or 100-255
    shape, value, size = [(0, 10) if x < 10 else (10, 90) if x < 100 else (100, 156) for x in parts], 0, 1
    for x, (least, n) in zip(parts, shape):
        value, size = value * n + x - least, size * n
    value, out = permute(f"ip{shape}", size, value), []
    for least, n in reversed(shape):
        value, r = divmod(value, n)
        out.append(str(least + r))
    return ".".join(reversed(out))


def _email(m: re.Match, permute: Permute) -> str | None:
    new = _by_class(m[1], "email", permute)
    # without a letter or digit of ASCII in the local part, its domain's first label is permuted
    return f"{new}@{m[2]}" if new != m[1] else f"{m[1]}@{_by_class(m[2].split('.')[0], 'label', permute)}.{m[2].split('.', 1)[1]}"


def _date(m: re.Match, permute: Permute) -> str | None:
    for order in ("ymd",) if m["y1"] else ("mdy", "dmy") if m["s2"] == "/" else ("dmy",):
        y, a, b = (m["y1"], m["a1"], m["b1"]) if m["y1"] else (m["y2"], m["a2"], m["b2"])
        month, day = (a, b) if order != "dmy" else (b, a)
        try:
            rank = datetime.date(int(y), int(month), int(day)).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= rank <= LAST_DAY - FIRST_DAY:
            return None
        while True:
            rank = permute("date", LAST_DAY - FIRST_DAY + 1, rank)
            new = datetime.date.fromordinal(FIRST_DAY + rank)
            # a date that only reads day first must give one that only reads day first, or it couldn't be told back
            if order != "dmy" or m["s2"] != "/" or new.day > 12:
                break
        s = m["s1"] or m["s2"]
        return {"ymd": f"{new.year:04d}{s}{new.month:02d}{s}{new.day:02d}", "mdy": f"{new.month:02d}{s}{new.day:02d}{s}{new.year:04d}", "dmy": f"{new.day:02d}{s}{new.month:02d}{s}{new.year:04d}"}[order]
    return None


def _key_id(m: re.Match, permute: Permute) -> str | None:
    return m[1] + _by_class(m[2], "keyid", permute, (DIGITS + UPPER,))


def _assigned(m: re.Match, permute: Permute) -> str | None:
    value = m[2]
    alphabets = (DIGITS + "abcdef",) if re.fullmatch("[0-9a-f]+", value) else (DIGITS + "ABCDEF",) if re.fullmatch("[0-9A-F]+", value) else (DIGITS, LOWER, UPPER)
    return m[1] + _by_class(value, "assigned", permute, alphabets) + m[3]


#: kind -> (pattern, replacement of a valid match or None).  The order is the precedence.
KINDS: dict[str, tuple[re.Pattern, Callable[[re.Match, Permute], str | None]]] = {
    "secret": (re.compile(r"""((?i:token|secret|api[_-]?key|access[_-]?key|password)\s*[=:]\s*["'])([A-Za-z0-9+/_=\-]{8,})(["'])"""), _assigned),
    "key_id": (re.compile(r"\b(AKIA|ASIA)([A-Z0-9]{16})\b"), _key_id),
    "email": (re.compile(r"([\w.%+\-]+)@((?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})"), _email),
    "iban": (re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    "card": (re.compile(r"(?<![\w.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\w)"), _card),
    "ssn": (re.compile(r"(?<![\w-])(\d{3})-(\d{2})-(\d{4})(?![\w-])"), _ssn),
    "phone": (re.compile(r"(?<!\w)(\+\d{1,3})([ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4})(?!\w)"), _phone),
    "ip": (re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"), _ip),
    "date": (re.compile(r"(?<![\w./-])(?:(?P<y1>\d{4})(?P<s1>[-/.])(?P<a1>\d{2})(?P=s1)(?P<b1>\d{2})|(?P<a2>\d{2})(?P<s2>[-/.])(?P<b2>\d{2})(?P=s2)(?P<y2>\d{4}))(?![\w-]|[./]\d)"), _date),
}
LOCAL_REVERSED = re.compile(r"[\w.%+\-]+")
DOMAIN = re.compile(r"(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}")


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of the e-mail pattern, found from each @ backwards: a long run of word characters is read once, not from each of its places."""
    pattern, end, at = KINDS["email"][0], 0, text.find("@")
    while at >= 0:
        before = LOCAL_REVERSED.match(text[end:at][::-1])
        if before and at >= end and (domain := DOMAIN.match(text, at + 1)) and (m := pattern.fullmatch(text, at - before.end(), domain.end())):
            yield m
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


#: A text without any of these holds no value of any kind.
MAY_HOLD = re.compile(r"[0-9@]|AKIA|ASIA|(?i:token|secret|key|password)\s*[=:]")


class Pseudonymiser:
    def __init__(self, key: bytes, backward: bool = False):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.sign, self.made = key, -1 if backward else 1, {}

    def permute(self, tweak: str, size: int, value: int) -> int:
        known = self.made.get((tweak, size))
        if known is None:
            if len(self.made) > 10_000:
                self.made.clear()
            known = self.made[tweak, size] = Permutation(self.key, tweak, size)
        return known.forward(value, self.sign)

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and the number of values by kind."""
        counts: dict[str, int] = {}
        if not MAY_HOLD.search(text):
            return text, counts
        taken: list[tuple[int, int, str]] = []
        for kind, (pattern, replace) in KINDS.items():
            taken.sort()
            starts, ends = [a for a, _, _ in taken], [b for _, b, _ in taken]  # disjoint, hence both in order
            for m in _emails(text) if kind == "email" else pattern.finditer(text):
                i = bisect_right(ends, m.start())
                stop = starts[i] if i < len(starts) else len(text)  # of the first value that ends behind the start
                if kind == "phone" and (m := _phone_alone(m, stop)) is None:
                    continue
                if stop < m.end():
                    continue
                new = replace(m, self.permute)
                if new is not None:
                    taken.append((m.start(), m.end(), new))
                    counts[kind] = counts.get(kind, 0) + 1
        out, at = [], 0
        for a, b, new in sorted(taken):
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:], counts


def pseudonymise(docs: DataFrame, key: bytes, reveal: bool = False, counts_as: str = "pii_counts") -> DataFrame:
    """``docs`` with its text column pseudonymised and a column ``counts_as`` (kind -> number), which replaces one of that name.

    Whoever has the key can undo the pseudonyms, so it has no default.
    """
    others = [c for c in docs.columns if c not in ("text", counts_as)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in others) + (", " if others else "") + f"text string, `{counts_as}` map<string,int>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Pseudonymiser(key, reveal)
        done = [(None, {}) if t is None else p.apply(t) for t in batch.column("text").to_pylist()]
        counts = pa.array([list(c.items()) for _, c in done], pa.map_(pa.string(), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array([t for t, _ in done], pa.string()), counts], names=[*others, "text", counts_as])

    return map_text(docs.select(*[f"`{c}`" for c in others], "text"), run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), DEMO_KEY)
    return done.select("doc_id", "text", F.aggregate(F.map_values("pii_counts"), F.lit(0), lambda a, b: a + b).cast("long").alias("n_values"), *[F.coalesce(F.col("pii_counts")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])
