"""Personal data: patterns propose spans, checks confirm them, words nearby adjust a score.

Base kinds (always kept): email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15
digits after a plus). A match that fails its check is dropped and not tried again at another length.

Added kinds: iban (country letters, check digits, mod-97 equal to 1; of the country's length, or, for a
country that isn't listed, of the greatest length that ends at a word's end and passes), ssn (three, two, four digits in
ranges that are issued), national (a telephone number without plus), key (a service's key by its
published prefix) and secret (a long run of letters and digits assigned to a word such as token). Each has a score from its
check, raised by words that speak for its kind within ``CONTEXT`` characters before it and lowered by
words that speak against; at ``THRESHOLD`` or more the span is added, unless it overlaps a base span.

Every search is linear in the text: matches begin only where their first run does. Null texts count
as empty and have no spans. Repeated rows get the same result each; empty tables give empty results;
other columns, whatever their names, are ignored. Very long texts are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The base patterns. A look-behind keeps a search from starting anew within a run of digits,
#: where it can't find what it didn't find at the run's start.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: How long each country's IBANs are.
IBAN_LENGTH = {
    c: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL "
        "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
    ).split(" "))
    for c in countries.split(",")
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

#: Keys of services by their published prefixes, and runs of 20 characters or more that only a word nearby makes a secret.
KEY = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abps]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)(?![A-Za-z0-9_])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "national", "key", "secret")
CONTEXT = 40
THRESHOLD = 0.5
#: Each added kind's score without context, and words for and against it.
SCORES = {"iban": 0.9, "ssn": 0.4, "national": 0.4, "key": 0.9, "secret": 0.4}
FOR = {
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|taxpayer|tax id)\b", re.I),
    "key": re.compile(r"\b(?:key|token|secret)\b", re.I),
    "secret": re.compile(r"(?:\b|_)(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|credential)s?[\x22']?\s*[:=]\s*[\x22']?\Z", re.I),
    "national": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono)\b", re.I),
}
AGAINST = re.compile(r"\b(?:order|invoice|version|isbn|part|serial|item)\b", re.I)
RAISE, LOWER = 0.3, 0.3

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> Iterator[Span]:
    """A pattern's match runs on into capitals and digits that follow, so it is cut at the ends of its words; the search goes on behind the first word that begins none, or the span."""
    at = 0
    while m := IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        for end in (e for e in range(m.end(), start, -1) if text[e - 1] != " " and (e == m.end() or text[e] == " ")):
            compact = text[start:end].replace(" ", "")
            if 15 <= len(compact) <= 34 and IBAN_LENGTH.get(compact[:2], len(compact)) == len(compact) and mod97(compact):
                yield "iban", start, end
                at = end
                break


def emails(text: str) -> Iterator[Span]:
    """From each @, the local part's run to the left and the domain to the right."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[Span]:
    found = [*emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _score(kind: str, text: str, start: int) -> float:
    near = text[max(0, start - CONTEXT) : start]
    return SCORES[kind] + RAISE * bool(FOR[kind].search(near)) - LOWER * bool(AGAINST.search(near))


def added_spans(text: str, base: list[Span]) -> list[tuple[str, int, int, float]]:
    proposed: list[Span] = [*ibans(text)]
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            proposed.append(("ssn", m.start(), m.end()))
    proposed += [("national", m.start(), m.end()) for m in NATIONAL.finditer(text)]
    proposed += [("key", m.start(), m.end()) for m in KEY.finditer(text)]
    # A secret mixes letters and digits.
    proposed += [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if len(_digits(m[0])) >= 3 and sum(c.isalpha() for c in m[0]) >= 3]
    scored = [(k, a, b, _score(k, text, a)) for k, a, b in proposed]
    kept: list[tuple[str, int, int, float]] = []
    # Added spans don't overlap each other: of those kept, only the neighbours of a place can. Base ones of several kinds may.
    bases = sorted((a, b) for _, a, b in base)
    furthest = [*accumulate((b for _, b in bases), max)]
    taken: list[tuple[int, int]] = []
    for k, a, b, s in sorted(scored, key=lambda x: (-x[3], x[1])):
        before, at = bisect_left(bases, (b,)), bisect_left(taken, (a,))
        in_base = before > 0 and furthest[before - 1] > a
        in_taken = (at > 0 and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b)
        if s >= THRESHOLD and not in_base and not in_taken:
            kept.append((k, a, b, s))
            taken.insert(at, (a, b))
    return sorted(kept, key=lambda x: (ADDED_KINDS.index(x[0]), x[1]))


HAS_ANY = re.compile(r"[0-9@]").search


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of each row: an array of ``kind, start, end, score, base`` by kind, then start (code points, end exclusive)."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                if not HAS_ANY(t):
                    out.append([])
                    continue
                base = base_spans(t)
                out.append([(k, a, b, 1.0, True) for k, a, b in base] + [(*x, False) for x in added_spans(t, base)])
            yield pd.Series([[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in x] for x in out], dtype=object)

    return docs.select("doc_id", spans(text_or_empty()).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` of what :func:`find_pii` returns."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
