"""Trains, keeps and loads the two sequence models. Run `python -m colloquy.llm.models` to train them again."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from colloquy.llm import labelled
from colloquy.llm.crf import Crf, Lexer, Tokens

PLACE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "weights")
_STREET = re.compile(r"(?i)(?:street|st|road|rd|lane|ln|close|ave|avenue|avenida|drive|court|ct|way|square|sq|place|terrace|crescent|row|boulevard|blvd|mews|calle|plaza|paseo|rue|chemin|quai|impasse|allee|platz|gasse|.{3,}(?:straße|strasse|weg|allee|platz|gasse|str))")
_TITLE = {"mr", "mrs", "ms", "dr", "prof", "frau", "herr", "mme", "sr", "sra", "san"}
_IDS = {"ssn", "social", "security", "steuer", "steuernummer", "passport", "passeport", "pasaporte", "reisepass", "ni", "nino", "nir", "licence", "license", "führerschein", "identity", "personalausweis", "dni", "tin", "tax", "taxpayer", "insurance", "sécurité", "sociale", "identité"}
_SAYS = {"email", "mail", "mailto", "phone", "tel", "fax", "mobile", "sms", "call", "number", "address", "deliver", "box", "flat", "apt", "unit", "postfach", "apartado", "bis", "izq"}


@lru_cache(4)
def name_parts(given: tuple[str, ...], family: tuple[str, ...]) -> dict[str, int]:
    """1: a given name, 2: a family name, 3: a part of a compound of either."""
    out: dict[str, int] = {}
    for kind, names in ((1, given), (2, family)):
        for n in names:
            parts = re.findall(r"[^\W\d_]+", n.lower())
            for p in parts:
                if len(p) > 1:
                    out[p] = kind if len(parts) == 1 else 3
    return out


def pii_lexer(given: tuple[str, ...], family: tuple[str, ...]) -> Lexer:
    """Words of the name lexicon, street words, titles and labels of numbers are features; they decide nothing alone."""
    known = name_parts(given, family)

    def own(token: str) -> int:
        low = token.lower()
        if k := known.get(low):
            return k
        return 4 if _STREET.fullmatch(low) else 5 if low in _TITLE else 6 if low in _IDS else 7 if low in _SAYS else 8 if low in ("at", "dot", "@", "%40") else 0

    return Lexer(own)


_PASS = re.compile(r"(?i)^(?:.*(?:pass(?:word|wd|phrase|code|wort)|passwd|_pass|loaderpass|keystorepass)|pass|.*pwd|pw|pw_.*|kennwort|contraseña|passwort)$|(?i:[a-z]+pass)$")
_SECRET = re.compile(r"(?i)^.*(?:secret|token|apikey|accesskey|signingkey|licencekey|licensekey|bearer|hmackey)$")
_PUBLIC = re.compile(r"(?i)^(?:sha\d*|md5|hash|checksum|digest|etag|integrity|public|certificate|request|trace|commit|expected|image|base64|dump|uuid|id|git|checkout|pixel)$|.*sha256$")
_FAKE = re.compile(r"(?i)^(?:your|example|changeme|placeholder|redacted|dummy|xxx+|todo|null|none|true|false|environ|env|getenv|getpass|process|secrets|vault|config|input|args|str|optional)$")


def _secret_own(token: str) -> int:
    if len(token) > 60:
        return 20
    if _PASS.match(token):
        return 1
    if _SECRET.match(token):
        return 2
    low = token.lower()
    if low in ("key", "keys"):
        return 3
    if low in ("api", "access", "auth", "client", "signing", "webhook", "licence", "license", "service", "svc", "session", "refresh", "encryption", "hmac"):
        return 4
    if low == "private":
        return 5
    if low in ("begin", "end"):
        return 6
    if _PUBLIC.match(token):
        return 7
    if _FAKE.match(token):
        return 8
    if low in ("authorization", "x", "identified", "login", "user", "curl", "staging"):
        return 9
    digits, upper, lower = sum(c.isdigit() for c in token), sum(c.isupper() for c in token), sum(c.islower() for c in token)
    if len(token) >= 12 and (digits >= 2 or upper and lower):
        return 10 + (digits == len(token)) + 2 * (upper > 0) + 4 * (lower > 0)
    return 0


def secret_lexer() -> Lexer:
    return Lexer(_secret_own)


def gold(t: Tokens, rows: list[labelled.Row], labels: list[str]) -> np.ndarray:
    out = np.zeros(len(t.text), np.uint8)
    where = np.searchsorted(t.text, np.arange(len(rows) + 1))
    for i, (_, marks) in enumerate(rows):
        lo, hi = where[i], where[i + 1]
        for a, b, label in marks:
            out[lo:hi][(t.begin[lo:hi] < b) & (t.end[lo:hi] > a)] = labels.index(label)
    return out


def train(which: str, rows: list[labelled.Row] | None = None, epochs: int = 14) -> Crf:
    rows = labelled.rows(which) if rows is None else rows
    labels = labelled.PII_LABELS if which == "pii" else labelled.SECRET_LABELS
    # the training lexicon is as incomplete as a real one: every third name is not listed
    lexer = pii_lexer(tuple(x for i, x in enumerate([*labelled.GIVEN, *(b.title() for b in labelled.BOTH)]) if i % 3), tuple(x for i, x in enumerate(labelled.FAMILY) if i % 3)) if which == "pii" else secret_lexer()
    t = lexer([x for x, _ in rows])
    return Crf(labels).fit(t, gold(t, rows, labels), epochs=epochs)


@lru_cache(2)
def model(which: str) -> Crf:
    path = os.path.join(PLACE, f"{which}.npz")
    return Crf.load(path) if os.path.exists(path) else train(which)


if __name__ == "__main__":
    os.makedirs(PLACE, exist_ok=True)
    for w in ("pii", "secrets"):
        train(w).save(os.path.join(PLACE, f"{w}.npz"))
