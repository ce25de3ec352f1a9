"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus-digit pairs, digits, URL schemes and identifier cues) in
one pass; around each anchor the widest run of characters a kind can hold is expanded and parsed locally. A run
holds every match that touches it, so leftmost, non-overlapping matches inside runs equal those of a full scan.

Kinds: email, ip, card, phone (fixed grammar), then url, address, account and secret, which the cues add:
``https://...``, a house number next to a street word, an identifier after an account cue ("IBAN", "account no",
"SSN") whose check (mod 97, digit count) holds, and a value after a word like "password" or an access key id. Cues are
met in any case. An address reaches as many words to either side of its street word as its form allows, however long
they are, and begins and ends at a boundary of words.

Null text is empty: no spans. Equal rows get equal spans, an empty table an empty result, and columns other than doc_id
and text, whatever their names, are ignored. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import bisect
import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, docs_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "address", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
STREETS = ("street", "avenue", "road", "lane", "boulevard", "drive", "court", "square", "straße", "strasse", "calle", "avenida", "rue ")
CUES = ("iban", "account", "acct", "ssn", "konto", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "passwort", "contraseña", "mot de passe", "token", "secret", "api_key", "api-key", "apikey", "akia")
REACH = 5  # words that an address has at most on either side of its street word
_LOWER = {c: c + 32 for c in range(65, 91)}  # keeps every place in the text

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9.]+")
_CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[a-z]+:(?://)?[^\s<>\"')\]]+", re.I)
_NAME = r"[^\W\d_a-z][\w.'-]*"
_ADDRESS = re.compile(
    rf"(?<![\w.,/-])[0-9]{{1,5}}[A-Za-z]?,? (?:(?:{_NAME}|[0-9]{{1,3}}(?:st|nd|rd|th)) ){{0,3}}(?i:street|avenue|road|lane|boulevard|drive|court|square)(?!\w)"
    rf"|(?<!\w)(?:{_NAME} ){{0,2}}(?:[^\W\d_a-z][\w-]*)?(?i:straße|strasse) ?(?:{_NAME} ){{0,3}}[0-9]{{1,5}}[a-z]?(?!\w)"
    rf"|(?<!\w)(?i:calle|avenida) (?:(?:de|del|la|las|los|el|{_NAME}),? ){{1,4}}[0-9]{{1,5}}(?!\w)"
    r"|(?<![\w.,/-])[0-9]{1,5},? (?i:rue) (?:[\w.'-]+ ){0,3}[^\W\d_a-z][\w'-]*(?!\w)"
)
_SECRET = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_+/.=-]{8,})")
_KEY_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s*(?:no|nr|number|id)\b)?[\s.:#=-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}|[0-9]{3}-[0-9]{2}-[0-9]{4}\b|[0-9]{6,18}\b)", re.I)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", [f"+{d}" for d in range(10)]), ("d", "0123456789"), ("u", SCHEMES), ("s", STREETS), ("c", CUES), ("k", SECRET_CUES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _ips(run: str, at: int) -> list[tuple[int, int]]:
    """Four neighbouring digit groups of a run of digits and dots, leftmost first; groups over 255 fail together."""
    found, group = [], []
    for part in run.split("."):
        group = [*group, (at, part)] if part else []
        at += len(part) + 1
        if len(group) == 4:
            if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for _, p in group):
                found.append((group[0][0], at - 1))
            group = []
    return found


def _account(value: str) -> int:
    """Length of the account number at the start of a match, or 0; an IBAN ends with the last group its check allows."""
    if not value[:2].isalpha():
        return len(value)
    while value:
        v = value.replace(" ", "").upper()
        if 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1:
            return len(value)
        value = value.rpartition(" ")[0]
    return 0


def _whole(text: str, at: int, end: int) -> bool:
    """Whether a street word stands by itself, or ends a longer one as in German."""
    after = end >= len(text) or not (text[end].isalnum() or text[end] == "_")
    joined = text[at].isalpha() and text[end - 1] in "eE" and text[at : at + 3].lower() == "str" and text[at + 3].lower() != "e"
    return (after or text[end - 1] == " ") and (joined or not at or not (text[at - 1].isalnum() or text[at - 1] == "_"))


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end in code points) ordered by kind as listed, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    ends = dict.fromkeys(KINDS, 0)
    ip_run = card_run = 0
    spaces: list[int] = []
    for last, (kind, width) in automaton().iter(text.translate(_LOWER)):
        at = last - width + 1
        if kind == "d":
            if at >= card_run:
                m = _CARD_RUN.match(text, at)
                card_run = m.end()
                if m.end() - at >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            if at >= ip_run:
                run = _IP_RUN.match(text, at)
                ip_run = run.end()
                if ip_run - at >= 7:
                    out["ip"] += _ips(run.group(), at)
        elif kind == "@":
            start = at
            low = ends["email"]
            while start > low and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                ends["email"] = m.end()
        elif kind == "+":
            if (m := _PHONE.match(text, at)) and 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out["phone"].append(m.span())
        elif kind == "u":
            if at >= ends["url"] and (m := _URL.match(text, at)) and m.end() > last + 1:
                end = m.end() - (len(m.group()) - len(m.group().rstrip(".,;:!?")))
                if end > last + 1:
                    out["url"].append((at, end))
                    ends["url"] = end
        elif kind == "s":
            if not _whole(text, at, last + 1):
                continue
            spaces = spaces or [-1, *(i for i, c in enumerate(text) if c == " ")]
            i, j = bisect.bisect_left(spaces, at) - 1 - REACH, bisect.bisect_left(spaces, last + 1) + REACH
            low, high = spaces[max(i, 0)] + 1, spaces[j] if j < len(spaces) else len(text)
            m = next((m for m in _ADDRESS.finditer(text, max(ends["address"], low), high) if m.end() > at), None)
            if m and m.start() < last:
                out["address"].append(m.span())
                ends["address"] = m.end()
        elif kind == "k":
            if width == 4:  # an access key id is spelled in capitals
                m = _KEY_ID.match(text, last + 1) if text.startswith("AKIA", at) else None
                span = (at, m.end()) if m else None
            else:
                m = _SECRET.match(text, last + 1)
                span = m.span(1) if m else None
            if span and span[0] >= ends["secret"]:
                out["secret"].append(span)
                ends["secret"] = span[1]
        elif at >= ends["account"] and (m := _ACCOUNT.match(text, last + 1)) and (size := _account(m[1])):
            ends["account"] = m.start(1) + size
            out["account"].append((m.start(1), ends["account"]))
    return [(k, s, e) for k in KINDS for s, e in sorted(out[k])]


def pii(docs: DataFrame) -> DataFrame:
    """doc_id and the array of spans of every whole text."""

    def one(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in batch.column("text").to_pylist()]}

    return arrow_map(docs_of(docs), one, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and of all spans, the hash of the base spans and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = {k: of(k) for k in KINDS}
    return found.select("doc_id", *(counts[k] for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *(counts[k] for k in KINDS if k not in BASE), F.size("spans").cast("long").alias("n_spans"))
