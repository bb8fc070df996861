"""Personal data: regular expressions propose spans, checksums and value checks confirm them, nearby words adjust
the score.

Kinds found in every text: email, ip, card (Luhn), phone; the method adds iban (mod 97) and ssn. Each kind starts with a
score of its own, an IBAN printed in groups of four gets GROUPED more, and a word of the kind's context within CONTEXT code
points on either side BOOST more; context words are whole words of English, French, German and Spanish, A-Z in either
case. Offsets are code points, end exclusive. Spans of the first four kinds always stay, as their patterns and checks
define them, with the score as a measure; the added kinds stay from MIN_SCORE on, which neither reaches by its pattern
alone. Texts are scanned whole in one narrow pass without a shuffle; each scan takes time linear in the text, whatever
its runs of letters or digits.

Defined results: null and empty texts have no spans; spans with equal starts come in the order of KINDS; repeated rows are
scanned one by one; an empty table gives no rows; other columns pass through, and where one of them is named like the
result, the result's name ends in an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import bounded, column, lean

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", re.ASCII)
_SSN = re.compile(r"\b([0-9]{3})-([0-9]{2})-([0-9]{4})\b", re.ASCII)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Scores in tenths: what each kind starts with, and what nearby words add.
START = {"email": 9, "ip": 6, "card": 8, "phone": 6, "iban": 4, "ssn": 3}
BOOST, GROUPED, MIN_SCORE, MOST = 3, 2, 5, 10
NEARBY = {
    "email": "mail email e-mail contact write courriel adresse écrire kontakt schreiben correo contacto escribir",
    "ip": "ip host server address serveur adresse rechner servidor dirección",
    "card": "card visa mastercard credit payment carte crédit paiement karte kreditkarte zahlung tarjeta crédito pago",
    "phone": "phone call tel mobile fax téléphone appeler portable telefon anrufen handy teléfono llamar móvil",
    "iban": "iban account bank transfer compte banque virement konto überweisung cuenta banco transferencia",
    "ssn": "ssn social taxpayer sécurité sozialversicherung steuernummer seguridad contribuyente",
}
_NEAR = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(words.split())})(?!\w)") for kind, words in NEARBY.items()}
_FOURS = re.compile(r"[A-Z0-9]{4}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an IBAN's check digits hold."""
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _is_ip(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        found = m.group()
        for size in range(len(found), 14, -1):  # words in capitals may follow the number
            whole = size == len(found) or found[size] == " "
            if whole and mod97(found[:size]):
                yield m.start(), m.start() + size
                break


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if _is_ip(m.groups()):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed in KINDS."""
    out = []
    for kind, a, b in _candidates(text or ""):
        around = (text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]).translate(_LOWER)
        score = START[kind] + (BOOST if _NEAR[kind].search(around) else 0)
        if kind == "iban" and _FOURS.fullmatch(text[a:b]):
            score += GROUPED
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((kind, a, b, min(score, MOST) / 10))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_ARROW_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
)


def find_pii(docs: DataFrame, *, keep: list[str], name: str = "spans") -> DataFrame:
    """`keep` columns with the array of spans."""
    while name in keep:
        name += "_"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = ("kind", "start", "end", "score")
        for batch in bounded(batches):
            spans = [
                [dict(zip(labels, s, strict=True)) for s in scan(text)] for text in column(batch, "text").to_pylist()
            ]
            arrays = [column(batch, c) for c in keep] + [pa.array(spans, pa.list_(_ARROW_SPAN))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, name])

    source = [*keep, *(["text"] if "text" not in keep else [])]
    fields = [docs.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(SPAN))]
    return docs.select(*source).mapInArrow(run, T.StructType(fields))
