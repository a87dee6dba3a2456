"""Personal data replaced by format-preserving pseudonyms.

Validated values - card numbers (Luhn), IBANs (mod 97), phone numbers, social
security numbers, IPv4 addresses, calendar dates, e-mail addresses, and
credentials such as access keys, passwords and tokens - are permuted within
their own format by a keyed Feistel network: a value becomes a number in the
range its format allows, the network permutes a power of two that holds the
range, and values outside it are sent through again until they fall inside
(cycle walking). Punctuation and layout stay, check digits are made anew, and
the key and the kind of value alone decide the result, so equal values stay
equal across documents and layouts, and nothing but the key links them back.

Candidates are looked for only around digits, at signs and key words, through
bounded patterns, so very long texts take linear time.

Defined results: null stays null with no entities; empty and clean texts stay
as they are; a value that fails its validation stays; overlapping candidates
go to the leftmost, then to the kind listed first; rows repeat as given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import documents, free_name

#: For tests and the registered query only; callers pass a secret of their own.
DEMO_KEY = b"provenant-demonstration-key"
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


class Feistel:
    """A keyed permutation of range(size) for any size; ``tweak`` tells kinds of value apart."""

    def __init__(self, key: bytes):
        self.key = key if len(key) <= 64 else blake2b(key).digest()

    def permute(self, value: int, size: int, tweak: bytes, backwards: bool = False) -> int:
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8

        def mix(i: int, x: int) -> int:
            out, block = b"", 0
            while len(out) < width:
                out += blake2b(bytes([i, block]) + x.to_bytes(width, "big"), key=self.key, person=tweak[:16], digest_size=min(64, max(8, width))).digest()
                block += 1
            return int.from_bytes(out[:width], "big") & mask

        while True:
            left, right = value >> half, value & mask
            if backwards:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ mix(i, left), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ mix(i, right)
            value = left << half | right
            if value < size:
                return value

    def characters(self, text: str, tweak: bytes, backwards: bool = False, valid: Callable[[str], bool] | None = None) -> str:
        """Permute letters within their case and digits among digits; other characters stay.

        A hexadecimal string of 16 or more, with a letter in it, stays one.
        With ``valid`` (true of ``text``) the permutation is walked to the next valid string.
        """
        is_hex = lambda t: re.fullmatch("[0-9a-f]{16,}", t) and not t.isdigit()
        if is_hex(text):
            sets, valid = [HEX] * len(text), is_hex
        else:
            sets = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), "") for c in text]
        while True:
            value, size = 0, 1
            for c, s in zip(text, sets, strict=True):
                if s:
                    value, size = value * len(s) + s.index(c), size * len(s)
            value = self.permute(value, size, tweak, backwards)
            out = []
            for c, s in zip(reversed(text), reversed(sets), strict=True):
                value, at = divmod(value, len(s)) if s else (value, 0)
                out.append(s[at] if s else c)
            text = "".join(reversed(out))
            if valid is None or valid(text):
                return text


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(layout: str, characters: str) -> str:
    """``characters`` in the places of the layout's letters and digits."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if len(set(digits)) < 2 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[0] + f.characters(digits[1:-1], b"card", back)
    return _refill(text, body + luhn_digit(body))


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = f.characters(plain[4:], b"iban", back)
    new = _refill(text, f"{plain[:2]}{98 - mod97(body + plain[:2] + '00'):02d}{body}")
    return new.lower() if text.islower() else new


#: The one- and two-digit country calling codes; all others have three digits.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _code(text: str) -> str:
    """The country code of a number written without separators, with its plus sign."""
    if text[:1] != "+":
        return ""
    return text[:2] if text[1] in ONE_DIGIT_CODES else text[:3] if text[1:3] in TWO_DIGIT_CODES else text[:4]


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    prefix = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    code = prefix[0] if prefix else _code(text)
    digits = re.sub(r"\D", "", text[len(code) :])
    american = len(digits) == 10 and code in ("", "+1")
    if not 7 <= len(digits) <= 13 or not (code or american):
        return None
    fits = (lambda d: d[0] not in "01" and d[3] not in "01") if american else (lambda d: d[0] != "0")
    if not fits(digits):  # these are permuted among themselves, so that both kinds come back by the key
        sound, fits = fits, lambda d: not sound(d)
    return code + _refill(text[len(code) :], f.characters(digits, b"phone", back, fits))


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    fits = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = text.replace("-", "")
    return _refill(text, f.characters(digits, b"ssn", back, fits)) if fits(digits) else None


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = f.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(f: Feistel, text: str, back: bool) -> str | None:
    a, sep1, b, sep2, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", text).groups()
    if sep1 != sep2:
        return None
    # year first; else month first for slashes, day first otherwise, unless only the other way is a date
    orders = ["ymd"] if len(a) == 4 else ["mdy", "dmy"] if sep1 == "/" else ["dmy", "mdy"]
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            day = date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = date.fromordinal(FIRST_DAY + f.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date", back))
        if order != orders[0] and new.day <= 12:
            # written this way it would be read as another day: the year goes first, which has one reading
            order = "ymd"
        value = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(part['m'])}d}", "d": f"{new.day:0{len(part['d'])}d}"}
        return sep1.join(value[k] for k in order)
    return None


def _email(f: Feistel, text: str, back: bool) -> str | None:
    body, dot, top = text.rpartition(".")
    return f.characters(body, b"email", back) + dot + top


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)", text)
    n = len(head[0]) if head else 0
    return text[:n] + f.characters(text[n:], b"secret", back)


#: Kind, pattern, replacement; of candidates that begin together the first valid one counts.
KINDS: tuple[tuple[str, str, Callable[[Feistel, str, bool], str | None]], ...] = (
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9-]{16,}", _secret),
    ("credential", r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([A-Za-z0-9_.+/=-]{6,})", _secret),
    ("credential", r"(?i:(?<![a-z0-9])bearer\s{1,3})(?=[^\s\d]{0,200}\d|\S[a-z]{0,200}[A-Z])([A-Za-z0-9_.+/=-]{16,})", _secret),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", _ip),
    ("date", r"(?<![\w./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![\w/-]|\.\d)", _date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\d)", _card),
    ("phone", r"(?<![\w+])\+\d{8,15}(?!\d)|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)", _phone),
)
_REACH, _BEFORE = 160, 4096  # characters around a trigger that are searched; how far back the blank before them may lie
_TRIGGER = re.compile(r"\d+|@|(?i:password|passwd|pwd|token|secret|api[_-]?key|bearer)|(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)")


_BLANK = re.compile(r"\s")


class Pseudonymiser:
    """Finds and replaces values in one text at a time."""

    def __init__(self, key: bytes = DEMO_KEY):
        self.feistel = Feistel(key)
        self.patterns = [(kind, re.compile(pattern), put) for kind, pattern, put in KINDS]

    def _windows(self, text: str) -> Iterator[tuple[int, int]]:
        begin = end = -1
        for m in _TRIGGER.finditer(text):
            if m.start() - _REACH > end:
                if end >= 0:
                    yield begin, end
                begin = max(0, m.start() - _REACH)
                low = max(0, begin - _BEFORE)
                begin = max(low, end + 1, text.rfind(" ", low, begin), text.rfind("\n", low, begin))
            if m.end() + _REACH > end:
                end = m.end() + _REACH
                # to the next blank, however far: a value is never left half in clear
                end = stop.start() if (stop := _BLANK.search(text, end)) else len(text)
        if end >= 0:
            yield begin, end

    def find(self, text: str, backwards: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of each value, in order, not overlapping."""
        found: list[tuple[int, int, str, str]] = []
        last = 0
        for begin, end in self._windows(text):
            options = []
            for rank, (kind, pattern, put) in enumerate(self.patterns):
                at = begin
                while m := pattern.search(text, at, end):
                    part = m.re.groups  # the value, without the word that announces it
                    new = put(self.feistel, m[part], backwards)
                    if new is not None:
                        options.append((m.start(part), rank, m.end(part), kind, new))
                    at = m.end() if new is not None else m.start() + 1
            for start, _, stop, kind, new in sorted(options):
                if start >= last:
                    found.append((start, stop, kind, new))
                    last = stop
        return found

    def replace(self, text: str, found: list[tuple[int, int, str, str]]) -> str:
        out, last = [], 0
        for start, stop, _, new in found:
            out += [text[last:start], new]
            last = stop
        return "".join([*out, text[last:]])


_ENTITIES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))


def pseudonymise(text: Column, key: bytes = DEMO_KEY) -> Column:
    """A struct of the new text and where its values stood in the old one."""

    @F.arrow_udf("struct<text:string,entities:array<struct<start:int,end:int,kind:string,pseudonym:string>>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker = Pseudonymiser(key)
        for part in parts:
            texts, entities = [], []
            for t in part.to_pylist():
                found = worker.find(t) if t else []
                texts.append(worker.replace(t, found) if found else t)
                entities.append([dict(zip(("start", "end", "kind", "pseudonym"), x, strict=True)) for x in found])
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(entities, _ENTITIES)], ["text", "entities"])

    return run(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", pseudonymise(F.col("text")).alias("r")).select("doc_id", "r.text", F.size("r.entities").alias("n_entities"), "r.entities")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with pseudonyms in its text and ``n_chars`` counted anew."""
    new, = free_name(docs, "new_text")
    changed = docs.withColumn(new, pseudonymise(F.col("text"))["text"]).withColumn("text", F.col(new)).drop(new)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed
