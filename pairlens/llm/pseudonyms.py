"""Format-preserving pseudonyms for personal data.

Numbers and dates that validate are permuted inside their own format by a keyed
Feistel network: a card number becomes another card number of that length with
a right check digit, a date another date written alike, an address another
address.  The permutation depends on the key and the kind only, so equal values
stay linked across documents, different values stay different, and whoever has
the key can undo it.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Values whose pseudonym a worker remembers (a cache only).
KEPT = 200_000

#: Blank-separated pieces and characters of the longest number that is looked for (cards, telephone numbers).
PIECES, LONGEST = 4, 40

_EMAIL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"
# A run of numbers has any length and ends before an address that begins with a digit.
_FIND = re.compile(
    rf"(?P<email>{_EMAIL})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    rf"|(?P<digits>(?<![\w.])\+?[0-9(](?:[0-9()/.-]|[ :](?!{_EMAIL}))*+)", re.ASCII)
_IP = re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}", re.ASCII)
_ISO = re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})", re.ASCII)
_DAY_FIRST = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})", re.ASCII)
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{8,15}", re.ASCII)
_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}", re.ASCII)
_SSN = re.compile(r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", re.ASCII)
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1 for every kind and size."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int) -> int:
        data = tweak + bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _walk(self, value: int, size: int, tweak: str, back: bool) -> int:
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        name = f"{tweak}/{size}/".encode()
        while True:
            left, right = value >> bits, value & mask
            if back:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ (self._round(name, i, left) & mask), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ (self._round(name, i, right) & mask)
            value = left << bits | right
            if value < size:  # outside the format: walk on; the walk comes back inside
                return value

    def permute(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, tweak, False)

    def undo(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, tweak, True)


def check_digit(payload: str) -> str:
    """The digit that makes ``payload`` and itself pass the checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(form: str, signs: str, alphabet: Callable[[str], bool]) -> str:
    """``form`` with its characters of the alphabet replaced by ``signs``, one by one."""
    fresh = iter(signs)
    return "".join(next(fresh) if alphabet(c) else c for c in form)


class Pseudonyms:
    """Finds values in texts and replaces them; ``back`` undoes instead."""

    def __init__(self, key: bytes, back: bool = False):
        feistel = Feistel(key)
        self.move = feistel.undo if back else feistel.permute
        self.known: dict[str, tuple[str, str] | None] = {}

    def _digits(self, value: str, kind: str) -> str:
        digits = "".join(c for c in value if c.isdigit())
        moved = self.move(int(digits), 10 ** len(digits), f"{kind}{len(digits)}")
        return _refill(value, str(moved).zfill(len(digits)), str.isdigit)

    def _date(self, value: str, parts: tuple[int, int, int], order: tuple[int, int, int]) -> str | None:
        year, month, day = parts
        if not (1900 <= year < 2100 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
            return None
        at = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        new = datetime.date.fromordinal(_FIRST_DAY + self.move(at, _LAST_DAY - _FIRST_DAY, "date"))
        fields = [new.year, new.month, new.day]
        numbers = re.findall(r"\d+", value)
        out = iter(str(fields[k]).zfill(4 if k == 0 else 2) for k, _ in zip(order, numbers))
        return re.sub(r"\d+", lambda _: next(out), value)

    def _of_digits(self, value: str) -> tuple[str, str] | None:
        if _IP.fullmatch(value):
            n = 0
            for part in value.split("."):
                n = n << 8 | int(part)
            n = self.move(n, 1 << 32, "ip")
            return "ip", ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        if m := _ISO.fullmatch(value):
            new = self._date(value, (int(m[1]), int(m[3]), int(m[4])), (0, 1, 2))
            return ("date", new) if new else None
        if m := _DAY_FIRST.fullmatch(value):
            # Read day first; if that is no date, month first.
            new = self._date(value, (int(m[4]), int(m[3]), int(m[1])), (2, 1, 0))
            new = new or self._date(value, (int(m[4]), int(m[1]), int(m[3])), (1, 2, 0))
            return ("date", new) if new else None
        if _CARD.fullmatch(value):
            digits = "".join(c for c in value if c.isdigit())
            if len(digits) > 19 or check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            payload = digits[:-1]
            moved = str(self.move(int(payload), 10 ** len(payload), f"card{len(digits)}")).zfill(len(payload))
            return "card", _refill(value, moved + check_digit(moved), str.isdigit)
        if _SSN.fullmatch(value):
            area, group, serial = (int(x) for x in value.split("-"))
            area -= 1 + (area > 666)
            at = (area * 99 + group - 1) * 9999 + serial - 1
            at, serial = divmod(self.move(at, 898 * 99 * 9999, "ssn"), 9999)
            area, group = divmod(at, 99)
            return "ssn", f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
        if _PHONE.fullmatch(value):
            # The country code stays; the number itself is permuted.
            m = re.match(r"\+\d{1,3}(?=[ .(-])", value)
            lead = m[0] if m else ("+" if value[0] == "+" else "")
            return "phone", lead + self._digits(value[len(lead):], "phone")
        return None

    def _email(self, value: str) -> str:
        local, domain = value.rsplit("@", 1)
        signs = "abcdefghijklmnopqrstuvwxyz0123456789"
        own = [signs.index(c) for c in local.lower() if c in signs]
        n = 0
        for x in own:
            n = n * 36 + x
        n = self.move(n, 36 ** len(own), f"email@{domain.lower()}")
        fresh = []
        for _ in own:
            n, x = divmod(n, 36)
            fresh.append(signs[x])
        return _refill(local, "".join(reversed(fresh)), lambda c: c.lower() in signs) + "@" + domain

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        spell = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or spell(plain[4:] + plain[:4]) % 97 != 1:
            return None
        # Digits and letters keep their places; then the two check digits are set anew.
        n, size = 0, 1
        for c in plain[4:]:
            base = 10 if c.isdigit() else 26
            n, size = n * base + (int(c) if c.isdigit() else ord(c) - 65), size * base
        shape = "".join("9" if c.isdigit() else "A" for c in plain[4:])
        n = self.move(n, size, f"iban{plain[:2]}{shape}")
        fresh = []
        for c in reversed(shape):
            n, x = divmod(n, 10 if c == "9" else 26)
            fresh.append(str(x) if c == "9" else chr(65 + x))
        body = "".join(reversed(fresh))
        check = f"{98 - spell(body + plain[:2] + '00') % 97:02d}"
        return _refill(value, plain[:2] + check + body, str.isalnum)

    def of(self, kind: str, value: str) -> tuple[str, str] | None:
        """(kind, pseudonym) of a found value, or None if it does not validate."""
        if value not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            if kind == "email":
                got = ("email", self._email(value))
            elif kind == "iban":
                new = self._iban(value)
                got = ("iban", new) if new else None
            else:
                got = self._of_digits(value)
            self.known[value] = got
        return self.known[value]

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, length) of each in the given text."""
        found: list[tuple[str, int, int]] = []
        if not text:
            return text, found

        out, at = [], 0
        for m in _FIND.finditer(text):
            for start, value, got in self._values(m):
                out += [text[at:start], got[1]]
                at = start + len(value)
                found.append((got[0], start, len(value)))
        return "".join([*out, text[at:]]), found

    def _values(self, m: re.Match) -> list[tuple[int, str, tuple[str, str]]]:
        """The validated values of one match; a run of several numbers is tried in parts.

        Telephone numbers, which have no check, are looked for last, so that
        they do not take the first groups of a card number.
        """
        if m.lastgroup != "digits":
            got = self.of(m.lastgroup, m[0])
            return [(m.start(), m[0], got)] if got else []
        run, at = m[0], m.start()
        # What touches a letter is not a number of its own.
        closed = len(run) if re.match(r"\w", m.string[m.end():m.end() + 1], re.ASCII) is None else len(run) - 1
        pieces = [p.span() for p in re.finditer(r"[^ :]+", run)]
        out: dict[int, list[tuple[int, str, tuple[str, str]]]] = {}
        taken = [False] * len(pieces)
        for phones in (False, True):
            i = 0
            while i < len(pieces):
                j, found = i + 1, []
                for j in range(min(len(pieces), i + PIECES), i, -1):
                    if not any(taken[i:j]) and (found := self._parts(run, *pieces[i], pieces[j - 1][1], closed, phones)):
                        break
                if found:
                    out[i] = [(at + a, value, got) for a, value, got in found]
                    taken[i:j] = [True] * (j - i)
                i = j
        return [x for i in sorted(out) for x in out[i]]

    def _parts(self, run: str, a: int, first: int, b: int, closed: int, phones: bool) -> list[tuple[int, str, tuple[str, str]]]:
        """The values that ``run[a:b]`` is, or that its only piece is made of."""
        def one(a: int, b: int) -> tuple[int, str, tuple[str, str]] | None:
            for lead, trail in (("", ".-/("), (".-/()", ".-/()")):
                value = run[a:b].rstrip(trail)
                start = a + len(value) - len(value := value.lstrip(lead) if lead else value)
                if 7 <= len(value) <= LONGEST and start + len(value) <= closed:
                    got = self.of("digits", value)
                    if got and (got[0] == "phone") == phones:
                        return start, value, got
            return None

        if x := one(a, b):
            return [x]
        if first != b:
            return []
        # Joined by strokes or brackets: each value counts.
        parts = [(a + p.start(), a + p.end()) for p in re.finditer(r"[^/()]+", run[a:b])]
        if len(parts) > 1 and (out := [x for c, d in parts if (x := one(c, d))]):
            return out
        # Joined by dots or dashes: only if the values make up the whole piece.
        numbers, out, i = [(a + p.start(), a + p.end()) for p in re.finditer(r"[0-9]+", run[a:b])], [], 0
        while i < len(numbers):
            for j in range(min(len(numbers), i + PIECES), i, -1):
                if x := one(numbers[i][0], numbers[j - 1][1]):
                    out.append(x)
                    i = j
                    break
            else:
                return []
        return out


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text, n_found and found of every row.

    ``text`` has every validated card number, account number, social security
    number, telephone number, address, e-mail name and date replaced by its
    pseudonym; ``found`` lists kind, start and length of each in the given
    text.  ``back`` gives pseudonyms' originals again; days and months come out
    with two digits, e-mail names in small letters, and a date that can be read
    day first is.  What does not validate (a wrong check digit, an impossible
    date) stays.  A null text stays null; empty
    texts, null ids and repeated rows are kept as they are; an empty table
    gives an empty result; other columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pseudonyms(key, back)
        for batch in batches:
            texts, found = [], []
            for text in batch["text"]:
                new, f = own.replace(text)
                texts.append(new)
                found.append([{"kind": k, "start": s, "length": n} for k, s, n in f])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "n_found": [len(f) for f in found], "found": found})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, text string, n_found long, found array<struct<kind string, start long, length long>>")
