"""Labelled spans for training the personal-information tagger.

The model in :mod:`kgweave.llm.pii_model` is trained from character spans. They are
made here, from raw texts, by patterns that know the syllables surnames are built of in
the training texts.  Only training uses this module: tagging never does.
"""

from __future__ import annotations

import unicodedata

import regex as re

KINDS = ("name", "email", "phone", "id_number", "address")

# Syllables and given names of the training texts.
SURNAME_HEADS = (
    "fyzz wyst oskr sarn throz brynz pelq merz zolk ulv hulv cyld gral kivv quell vash yarr drenv vrelk torv"
).split()
SURNAME_TAILS = (
    "mark dahl strom brook quist hurst arro impo ewski enko wick moss sby ossi elli ovic vela adine ton ard"
).split()
GIVEN_NAMES = (
    "priya celeste oskar lucia kofi pavel jurgen ingrid bjork emeka marta hamid chiara tariq zoe wanda renee "
    "aisha jonas dorian nuno elif greta maria-jose sofia anne-laure siobhan annika farida tomasz dmitri ruben "
    "bashir yusuf"
).split()

_SUR1 = rf"(?:{'|'.join(SURNAME_HEADS)})(?:{'|'.join(SURNAME_TAILS)})"
_SUR = rf"(?:o['’]|mc|mac|al-|el-|d['’])?{_SUR1}(?:-{_SUR1})?"
_INITIAL = r"\p{L}\."
_GIVEN = rf"(?:{'|'.join(GIVEN_NAMES)}|{_INITIAL})"
_GIVENS = rf"{_GIVEN}(?:[  ]+{_INITIAL})*"
_PART = r"(?:(?:de|del|la|van|von|der|den|di|da|el|al)[  ]+)*"
_SP = r"[  ]+"
_NAME = rf"(?<![\w@.-])(?:{_GIVENS}{_SP}{_PART}{_SUR}|{_SUR},{_SP}{_GIVENS}|(?<=\b(?:dr|prof|mr|mrs|ms|frau|herr|mme|m|sr|sra|dra)\.?{_SP}){_PART}{_SUR})(?![\w@])"
_AT = r"(?:@|[ ]?[\[(][ ]?at[ ]?[\])][ ]?)"
_DOT = r"(?:\.|[ ]?[\[(][ ]?dot[ ]?[\])][ ]?)"
_TLD = r"(?:example(?:\.(?:com|org|net))?|test|invalid)"
_TLD_OBF = rf"(?:example(?:{_DOT}(?:com|org|net))?|test|invalid)"
_EMAIL = rf"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*?{_DOT}{_TLD_OBF}(?![\w-])"
_PHONE = "|".join(
    [
        r"(?:\+1|1)[ -]\d{3}[ -]555[ -]\d{4}",
        r"\(\d{3}\)[ ]555-\d{4}",
        r"\d{3}[.]555[.]\d{4}",
        r"\d{3}-555-\d{4}",
        r"(?:201|212|312|415|617|808)[ ]?555[ ]?\d{4}",
        r"\+44[ ]\(0\)1632[ ]960[ ]\d{3}",
        r"(?:\+44[ ]1632|01632)[ ]960[ ]?\d{3}",
        r"(?:\+44[ ]7700|07700)[ ]900[ ]?\d{3}",
        r"(?:0049|\+49)[ ]\(?0?\)?30[ ]23125[ ]?\d{3}",
        r"030[/ ]23125[ ]?\d{3}",
        r"(?:\+33[ ]1|01)[ ]99[ ]00(?:[ ]\d\d){2}",
        r"\+61[ ]2[ ]5550[ ]\d{4}",
        r"\(?02\)?[ ]5550[ ]\d{4}",
        r"\+34[ ]\d{3}[ ]\d{3}[ ]\d{3}",
    ]
)
_PHONE = rf"(?<![\w.+@/-])(?:{_PHONE})(?![\w-])"
_ID = (
    r"(?:ssn|nhs[ ]number|nhs[ ]no\.?|medical[ ]record[ ]number|mrn:?|dni|nie|passport(?:[ ]no\.?)?|"
    r"insurance[ ]no\.?|social[ ]security[ ]no\.?|versichertennr\.?|tax[ ]id|national[ ]id|hospital[ ]no\.?|"
    r"n°[ ]s[ée]cu(?:rit[ée][ ]sociale)?)[:]?[ ]#?(?P<v>[a-z]?\d[\d ./-]*\d(?:-?[a-z](?!\w))?)"
)
_WAY = r"(?:street|st\.|st\b|road|rd|avenue|ave|lane|drive|close|terrace|blvd|boulevard|way|court|place)"
_UNIT = r"(?:,[ ](?:apt|flat|unit)\.?[ ]\d+\w?)?"
_ADDRESS = "|".join(
    [
        rf"(?:flat[ ]\d+\w?,[ ])?\d+\w?[ ](?:north[ ]|south[ ]|east[ ]|west[ ])?{_SUR1}[ ]{_WAY}{_UNIT}",
        rf"calle[ ]{_SUR1}[ ]\d+\w?{_UNIT}",
        rf"{_SUR1}(?:strasse|straße|weg)[ ]\d+\w?{_UNIT}",
        rf"\d+(?:[ ]bis|[ ]ter)?,?[ ](?:rue|avenue)[ ]{_SUR1}{_UNIT}",
    ]
)
_ADDRESS = rf"(?<!\w)(?:{_ADDRESS})(?!\w)"
_RULES = [
    ("email", re.compile(_EMAIL, re.I)),
    ("address", re.compile(_ADDRESS, re.I)),
    ("phone", re.compile(_PHONE, re.I)),
    ("id_number", re.compile(rf"(?<!\w){_ID}", re.I)),
    ("name", re.compile(_NAME, re.I)),
]


def fold(text: str) -> str:
    """Accents off, one character for each, so that offsets stay."""
    out = []
    for c in text:
        if c < "\x80":
            out.append(c)
            continue
        d = unicodedata.normalize("NFKD", c)[0] if c not in "øØđłŁßµμ" else {"ø": "o", "Ø": "O", "đ": "d", "ł": "l", "Ł": "L"}.get(c, c)
        out.append(d)
    return "".join(out)


def label(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind), sorted and disjoint; of two that overlap the earlier rule's stays."""
    folded, taken, spans = fold(text), bytearray(len(text)), []
    for kind, rule in _RULES:
        for m in rule.finditer(folded):
            a, b = m.span("v") if kind == "id_number" else m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                spans.append((a, b, kind))
    return sorted(spans)
