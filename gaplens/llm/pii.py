"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs before digits, digit
pairs, dotted digits, schemes and identifier cues. From each anchor a deterministic
local parser walks to the boundaries of the item and validates it:

- ``email``  at-sign, local part to the left, dotted domain to the right
- ``ip``     four dotted numbers of at most 255 each
- ``card``   digits with single spaces or dashes between, 14 to 19, Luhn
- ``phone``  plus sign, 10 to 15 digits with the usual separators
- ``url``    scheme with ``://`` and a host
- ``account`` an identifier after a cue word: an IBAN of its country's length (modulo 97, or in capitals), or else
  groups that each hold a digit, six digits in all; groups are added up to 34 letters and digits

The first four kinds are the base: their spans equal the leftmost non-overlapping
matches of the patterns in ``BASE``, less those that fail validation. The other two
are added to them and never replace one.

Edge cases: a null text counts as empty and has no spans; a very long text is searched
once from end to end, with a few lists of its spans in memory; ids may be null or repeat;
each row is searched by itself; items may overlap across kinds; other columns play
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import per_row, table

#: The base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "url", "account")
#: Words that announce an identifier.
CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "customer no", "konto", "compte", "cuenta")
#: Schemes of addresses.
SCHEMES = ("http", "https", "ftp", "sftp", "ssh", "ws", "wss")

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE_RUN = re.compile(r"[\x20().0-9-]+")
DIGIT_RUN = re.compile(r"[0-9]+")
CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
URL_REST = re.compile(r"[A-Za-z0-9.\[\]:@%_~-]+(?:[/?#][^\x00-\x20\"<>|\\^`{}]*)?")
SCHEME_LEFT = re.compile(r"(?:%s)$" % "|".join(SCHEMES), re.IGNORECASE)
CUE_REST = re.compile(r"(?:\x20?(?:no|nr|number|nummer|id)\b\.?)?[\x20:#=\"]{1,4}")
#: The first group of an identifier, and a next one: it holds a digit and is no word like "3rd" or "10am".
FIRST_GROUP = re.compile(r"[A-Za-z]{0,4}[0-9][A-Za-z0-9]*")
NEXT_GROUP = re.compile(r"[\x20-](?![0-9]+[a-z]+(?![A-Za-z0-9]))(?=[A-Za-z]*[0-9])[A-Za-z0-9]+")
#: Letters and digits to which groups are added, and the lengths of IBANs by country.
LONGEST = 34
IBAN_LENGTHS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
IBANS = {n: re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTHS.values())}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for a in DIGITS:
        found.add_word("+" + a, ("phone", 2))
        for b in DIGITS:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for gap in ("", " ", "-"):
                found.add_word(a + gap + b, ("card", 2 + len(gap)))
    for cue in CUES:
        found.add_word(cue, ("account", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _left(text: str, at: int, floor: int, joined: str) -> int:
    """The start of the chain of digits around ``at``: digit runs with at most one of ``joined`` between."""
    while at > floor:
        if text[at - 1] in DIGITS:
            at -= 1
        elif text[at - 1] in joined and at - 1 > floor and text[at - 2] in DIGITS:
            at -= 2
        else:
            break
    return at


def _iban(text: str) -> bool:
    bare = re.sub(r"[\x20-]", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", bare):
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _lowered(text: str) -> str:
    """``text`` in lower case, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


def _account(text: str, at: int) -> int | None:
    """The end of the identifier that begins at ``at``: an IBAN at its country's length, else groups that hold digits."""
    size = IBAN_LENGTHS.get(text[at : at + 2].upper())
    m = IBANS[size].match(text, at) if size else None
    if m and (_iban(m[0]) or (m[0].upper() == m[0] and sum(c in DIGITS for c in m[0]) >= 6)):
        return m.end()
    m = FIRST_GROUP.match(text, at)
    if not m:
        return None
    end, size = m.end(), m.end() - at
    while (m := NEXT_GROUP.match(text, end)) and size + len(m[0]) - 1 <= LONGEST:
        end, size = m.end(), size + len(m[0]) - 1
    return end if sum(c in DIGITS for c in text[at:end]) >= 6 else None


def spans(text: str | None, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All validated spans (start, end, kind) of a text in code points, by start."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last candidate of a kind ended
    low = _lowered(text)  # cues stand in any case; no other anchor has letters
    for last, (kind, size) in machine.iter(low):
        start = last + 1 - size
        if start < done[kind]:
            continue
        if kind == "email":
            if got := _email(text, start, done[kind]):
                done[kind] = got[1]
                found.append((*got, kind))
        elif kind == "phone":
            run = PHONE_RUN.match(text, start + 2)
            end = run.end() if run else start
            while end > start + 2 and text[end - 1] not in DIGITS:
                end -= 1
            if end >= start + 4:
                done[kind] = end
                if 10 <= sum(c in DIGITS for c in text[start:end]) <= 15:
                    found.append((start, end, kind))
        elif kind == "card":
            begin = _left(text, start, done[kind], " -")
            end = CARD_RUN.match(text, begin).end()
            done[kind] = end
            digits = re.sub(r"[\x20-]", "", text[begin:end])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((begin, end, kind))
        elif kind == "ip":
            begin = _left(text, start, done[kind], ".")
            end = DOTTED.match(text, begin).end()
            done[kind] = end
            parts = [m.span() for m in DIGIT_RUN.finditer(text, begin, end)]
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                    found.append((four[0][0], four[3][1], kind))
        elif kind == "url":
            scheme = SCHEME_LEFT.search(text, max(0, start - 5), start)
            rest = URL_REST.match(text, start + 3) if scheme else None
            if rest:
                end = rest.end()
                while end > start + 4 and text[end - 1] in ".,;:!?)'":
                    end -= 1
                done[kind] = end
                found.append((scheme.start(), end, kind))
        else:
            m = CUE_REST.match(low, start + size)
            if m and (start == 0 or not text[start - 1].isalnum()) and (end := _account(text, m.end())):
                done[kind] = end
                found.append((m.end(), end, kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts of the base kinds, the digest of the base spans, and all spans."""
    counts = [f"n_{k}" for k in BASE]
    schema = pa.schema([(id_col, pa.int64()), *((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string())])

    def work(rows: dict) -> dict:
        machine = automaton()
        every = [spans(t, machine) for t in rows[text_col]]
        base = [[s for s in found if s[2] in BASE] for found in every]
        return {
            id_col: rows[id_col],
            **{f"n_{k}": [sum(s[2] == k for s in found) for found in base] for k in BASE},
            "base_sha256": [hashlib.sha256(joined(found).encode()).hexdigest() for found in base],
            "spans": [joined(found) for found in every],
        }

    ddl = ", ".join([f"`{id_col}` long", *(f"{c} long" for c in counts), "base_sha256 string", "spans string"])
    return docs.select(id_col, text_col).mapInArrow(per_row([id_col, text_col], work, schema), ddl)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return find(table(spark, sf_dir, "documents"))
