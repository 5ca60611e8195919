"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Validated numbers (payment cards, IBANs, social security and phone numbers, IPv4 addresses), dates, the
user names of e-mail addresses and access keys are replaced by others of the same format. The permutation
depends on the key and the kind alone, so equal values get equal pseudonyms in every document, without a
table of values. What does not validate stays as it is.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect, bisect_left
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False, rounds: int = 10) -> int:
    """A keyed permutation of range(size), or its inverse: a balanced Feistel network, walked until it lands inside."""
    half = ((size - 1).bit_length() + 1) // 2
    low = (1 << half) - 1
    while True:
        a, b = (value & low, value >> half) if back else (value >> half, value & low)
        for r in reversed(range(rounds)) if back else range(rounds):
            digest = hmac.digest(key, f"{kind}|{size}|{r}|{b}".encode(), "sha256")
            a, b = b, a ^ (int.from_bytes(digest, "big") & low)
        value = b << half | a if back else a << half | b
        if value < size:
            return value


def permute_other(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation that leaves no value in place: one step on between the Feistel network and its inverse."""
    if size < 2:
        return value
    return permute((permute(value, size, key, kind) + 1) % size, size, key, kind, back=True)


def permute_signs(text: str, key: bytes, kind: str) -> str:
    """Letters and digits permuted together, each within its own alphabet; other characters stay."""
    alphabets = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in text]
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permute_other(value, size, key, f"{kind}|{len(text)}|{''.join('x' if a is None else a[0] for a in alphabets)}")
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 2  # the first digit (the network) stays, the last one is worked out
    body = digits[0] + str(permute_other(int(digits[1:-1]), 10**n, key, f"card{n}")).zfill(n)
    return refill(m[0], body + luhn_digit(body))


#: Leading digits and lengths of the payment card networks.
ISSUERS = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|3[47]\d{13}|(?:30[0-5]|309|36\d|3[89]\d)\d{11,16}|35(?:2[89]|[3-8]\d)\d{12,15}|5[1-5]\d{14}"
    r"|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|220[0-4]\d{12,15}|(?:6011|64[4-9]\d|65\d\d|62\d\d)\d{12,15}"
    r"|(?:60|81|82)\d{14}|508\d{13}|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15}"
)
#: How cards are printed: in one piece, in fours with a rest, or 4-6-5 and 4-6-4.
PRINTED = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}")


def of_network(text: str) -> bool:
    return ISSUERS.fullmatch(re.sub(r"\D", "", text)) is not None


def network_card(m: re.Match, key: bytes) -> str | None:
    return card(m, key) if PRINTED.fullmatch(m[0]) and of_network(m[0]) else None


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


#: Lengths of the countries' IBANs.
IBAN_LENGTHS = {
    c: int(n)
    for n, names in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
            "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
            "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for c in names.split(",")
}


def iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = permute_signs(plain[4:], key, "iban" + plain[:2])
    new, out = iter(plain[:2] + iban_check(plain[:2], account) + account), []
    for c in m[0]:
        out.append(c if c == " " else next(new))
    return "".join(out)


def social(m: re.Match, key: bytes) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = permute_other((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 10 <= len(digits) <= 15:
        return None
    code = len(digits) - 10 if m[0].startswith("+") else 0  # the country code stays
    n = len(digits) - code - 1  # as does the digit after it, which is never 0
    return refill(m[0], digits[: code + 1] + str(permute_other(int(digits[code + 1 :]), 10**n, key, f"phone{n}")).zfill(n))


def address(m: re.Match, key: bytes) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")) or sum(parts) == 0:
        return None
    value = permute_other(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


@lru_cache
def printed_days(orders: tuple[str, ...], first: int, second: int, third: int) -> list[tuple[int, int, int]]:
    """All dates 1900 to 2099 as their three numbers, in the given orders of y, m and d, that can be printed in
    exactly these numbers of digits (a one-digit place holds 1 to 9, a two-digit place any value, 05 included)."""
    found = set()
    for at in range(FIRST_DAY, FIRST_DAY + DAYS):
        when = date.fromordinal(at)
        value = {"y": when.year, "m": when.month, "d": when.day}
        for order in orders:
            numbers = tuple(value[c] for c in order)
            if all(n < 10**w for n, w in zip(numbers, (first, second, third), strict=True)):
                found.add(numbers)
    return sorted(found)


def day(m: re.Match, key: bytes, orders: tuple[str, ...]) -> str | None:
    """One of the dates of just the same shape, or None. Where day and month could stand either way, the domain
    holds all that is a date in either reading, so no two dates of a shape share a pseudonym."""
    groups = m[1], m[3], m[4]
    shape = tuple(map(len, groups))
    domain, own = printed_days(orders, *shape), tuple(map(int, groups))
    at = bisect_left(domain, own)
    if at == len(domain) or domain[at] != own:
        return None
    new = domain[permute_other(at, len(domain), key, f"date{orders}{shape}")]
    return m[2].join(str(n).zfill(w) for n, w in zip(new, shape, strict=True))


def mail(m: re.Match, key: bytes) -> str | None:
    return permute_signs(m[1], key, "mail") + m[2]


def secret(m: re.Match, key: bytes) -> str | None:
    return m[1] + permute_signs(m[2], key, "secret")


#: Kinds in order of precedence; each pattern with what makes a pseudonym, or None where it does not validate.
KINDS: list[tuple[str, str, Callable[[re.Match, bytes], str | None]]] = [
    ("email", r"(?<![\w.+-])([A-Za-z0-9][\w.+-]*)(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", mail),
    ("secret", r"\b(AKIA|ASIA)([A-Z0-9]{16})\b", secret),
    # name and value bare or in quotes (escaped ones too), with a colon, an equals sign or an arrow between: JSON, YAML, shell, code
    ("secret", r"""((?i:password|passwd|secret|token|api[_-]?key)(?i:[_-](?:access|auth|secret|key|id|value|token|hash|\d{1,4})){0,3}\\?["']?\s{0,40}[:=]>?\s{0,40}\\?["']?)([A-Za-z0-9+/_-]{8,})""", secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("date", r"(?<![\d.-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![\d-]|\.\d)", lambda m, key: day(re.match(r"(\d{4})([-/.])(\d{1,2})[-/.](\d{1,2})", m[0]), key, ("ymd",))),
    ("date", r"(?<![\d.-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?![\d-]|\.\d)", lambda m, key: day(re.match(r"(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4})", m[0]), key, ("dmy", "mdy"))),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    ("ssn", r"(?<![\d-])(\d{3})-(\d{2})-(\d{4})(?![\d-])", social),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", network_card),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)", phone),
    ("phone", r"(?<![\d(-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])", phone),
]
PATTERNS = [(kind, re.compile(p), make) for kind, p, make in KINDS]
#: A text without any of these holds none of the kinds.
HINT = re.compile(r"[@\d]|AKIA|ASIA|(?i:password|passwd|secret|token|api[_-]?key)")


@lru_cache(maxsize=200_000)
def pseudonym(index: int, text: str, key: bytes) -> str | None:
    kind, pattern, make = PATTERNS[index]
    m = pattern.fullmatch(text)
    return make(m, key) if m else None


def endings(kind: str, text: str) -> list[int]:
    """Lengths to try for what a pattern matched: an IBAN's own length, all of it, then every shorter ending before a space or hyphen."""
    found = [len(text)] + [m.start() for m in re.finditer(r"[ -]", text)][::-1]
    if kind == "iban" and (n := IBAN_LENGTHS.get(text[:2])):
        own = [i for i in found if len(text[:i].replace(" ", "")) == n]
        found = own + [i for i in found if i not in own]
    return found


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of what was replaced, in the old text.

    A pattern may match more than the value, as a number after it. So where a match gives no pseudonym or meets a span
    already taken, its shorter endings are tried, then the search goes on inside it. Both would make many a row of
    plain numbers a card by its check digit alone, so such a card has to be printed as cards are or be of a network.
    """
    if not HINT.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []  # in order
    for index, (kind, pattern, _) in enumerate(PATTERNS):
        start = failed = 0
        while m := pattern.search(text, start):
            a, start = m.start(), m.start() + 1
            for n in endings(kind, m[0]):
                b = a + n
                at = bisect(taken, (a, b))
                if (at and taken[at - 1][1] > a) or (at < len(taken) and b > taken[at][0]):
                    continue
                if kind == "card" and (a < failed or b < m.end()) and not (of_network(text[a:b]) or a >= failed and PRINTED.fullmatch(text[a:b])):
                    continue
                new = pseudonym(index, text[a:b], key)
                if new is not None:
                    taken.insert(at, (a, b, kind, new))
                    start = b
                    break
            else:
                failed = max(failed, m.end())
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(a, b, kind) for a, b, kind, _ in taken]


def derived_key(key: str) -> bytes:
    """The permutations' key; an empty one is refused, as anybody could undo its pseudonyms."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    return hashlib.sha256(key.encode()).digest()


def pseudonymous(key: str):
    """A column function: a text column with pseudonyms (null stays null)."""
    secret_key = derived_key(key)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pseudonymise(t, secret_key)[0])

    return replaced


def protect(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with pseudonyms), spans (start, end, kind in the old text) of every row.

    `key` decides the permutation; keep it secret and use the same one for tables that are to be linked. There is no
    default. Values that are printed alike get equal pseudonyms.
    Null texts stay null with no span, empty ones empty. One row per input row, repeated ids included; an
    empty table gives no rows; columns besides doc_id and text are ignored.
    """
    secret_key = derived_key(key)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                done = [(None, []) if t is None else pseudonymise(t, secret_key) for t in part.column(1).to_pylist()]
                spans = [[{"start": a, "end": z, "kind": k} for a, z, k in s] for _, s in done]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, spans array<struct<start: int, end: int, kind: string>>")
