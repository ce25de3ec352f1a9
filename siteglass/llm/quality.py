"""Line-first quality rules: judge every line, drop the failing ones, then reject documents that lost too much.

Line rules (a line without a word is neutral and stays):

* punctuation: more than ``max_symbol_share`` percent of the line's non-space bytes are noise symbols, or a line of
  ``ending_words`` words or more does not end like a sentence (one of ``ENDS``, perhaps within closing marks);
* navigation: a short line that holds a menu separator, a line of which over ``max_marks`` percent of the words are
  marks alone, or a line of one menu word or phrase only;
* stutter: over ``max_stutter`` percent of the words equal the word before them;
* boilerplate: the line holds one of ``BOILERPLATE``, phrases of licences, notices and consent in English, German,
  French and Spanish (``MENU`` holds words of menus in these).

A document is rejected when it fails the base rules (under 20 words, or over 30 % of its words in repeated
8-word windows), or when its failing lines hold more than ``max_lost`` percent of its word characters.
Null text counts as empty: no words, rejected. Texts of any length are judged whole, equal rows get equal verdicts, and
an empty table an empty result. Other columns, whatever their names, are ignored by ``quality`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, docs_of, small_batches

WS = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NOISE = b"#*$%&|<>!?~^=_{}[]\\"
ENDS, CLOSERS = ".!?…:;。！？", "\"')]»”’"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies", "uses cookies", "javascript is disabled", "enable javascript", "subscribe to our newsletter",
    "alle rechte vorbehalten", "lizenziert unter", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "verwenden cookies", "javascript ist deaktiviert", "javascript aktivieren", "newsletter abonnieren",
    "tous droits réservés", "sous licence", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "utilise des cookies", "utilisons des cookies", "activer javascript", "abonnez-vous à notre",
    "todos los derechos reservados", "bajo licencia", "bajo la licencia", "política de privacidad", "condiciones de uso", "aviso legal", "utiliza cookies", "utilizamos cookies", "activar javascript", "suscríbete a nuestr",
)
MENU = (
    "home", "about", "contact", "login", "sign in", "sign up", "menu", "next", "previous", "back", "search", "share", "help", "faq", "sitemap", "read more", "skip to content",
    "startseite", "über uns", "kontakt", "anmelden", "registrieren", "menü", "weiter", "zurück", "suche", "teilen", "hilfe", "impressum", "mehr lesen", "weiterlesen",
    "accueil", "à propos", "connexion", "inscription", "suivant", "précédent", "retour", "rechercher", "partager", "aide", "plan du site", "lire la suite",
    "inicio", "acerca de", "contacto", "iniciar sesión", "registrarse", "menú", "siguiente", "anterior", "volver", "buscar", "compartir", "ayuda", "mapa del sitio", "leer más",
)
_SEPARATOR = re.compile(r" (?:\||»|›|::|•) ")
_MENU = re.compile("(?:" + "|".join(MENU) + ")")
_BOILER = re.compile("|".join(re.escape(x) for x in BOILERPLATE))
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], dtype=np.uint64)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat: int = 30
    window: int = 8
    max_symbol_share: int = 10
    nav_words: int = 12
    max_marks: int = 25
    max_stutter: int = 30
    ending_words: int = 5
    max_lost: int = 50


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside a window of ``window`` words that occurs twice or more, first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64) + np.uint64(1)
    ids *= np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    m = n - window + 1
    if len(seen) == n:
        return 0
    h = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        h = (h ^ (h >> np.uint64(31))) * _MULT[k % 8] + ids[k : k + m]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    rep = np.zeros(m, dtype=bool)
    rep[order[1:][same]] = True
    rep[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(rep)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def line_fails(line: bytes, rules: Rules) -> bool:
    dense = line.translate(None, WS)
    if not dense:
        return False
    if 100 * (len(dense) - len(dense.translate(None, NOISE))) > rules.max_symbol_share * len(dense):
        return True
    words = line.split()
    n = len(words)
    if 100 * sum(map(eq, words, words[1:])) > rules.max_stutter * n:
        return True
    if dense.translate(None, MARKS) != dense and 100 * sum(not w.translate(None, MARKS) for w in words) > rules.max_marks * n:
        return True
    text = line.decode()
    if n >= rules.ending_words and not text.rstrip(" \t\n\r\x0b\x0c").rstrip(CLOSERS).endswith(tuple(ENDS)):
        return True
    low = text.lower()
    if _SEPARATOR.search(low) and n <= rules.nav_words:
        return True
    return bool(_MENU.fullmatch(low.strip(" \t\n\r\x0b\x0c")) or _BOILER.search(low))


def _points(b: bytes) -> int:
    return len(b.decode())


def judge(text: str | None, rules: Rules) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    raw = (text or "").encode()
    words = raw.split()
    dense = raw.translate(None, WS)
    chars = _points(dense)
    symbols = len(dense) - len(dense.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dups = 0
    kept_lines, lost = [], 0
    for line in lines:
        if not line.strip(WS):
            kept_lines.append(line)
            continue
        dups += line in seen
        seen.add(line)
        if line_fails(line, rules):
            lost += _points(line.translate(None, WS))
        else:
            kept_lines.append(line)
    repeats = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat * len(words)
    kept = not failed and 100 * lost <= rules.max_lost * chars
    return len(words), chars, symbols, dups, repeats, failed, kept, b"\n".join(kept_lines).decode()


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Per document: doc_id, the five counts, base_failed, kept and the cleaned text."""
    rules = rules or Rules()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")

    def one(batch: pa.RecordBatch) -> dict:
        rows = [judge(t, rules) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id")} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return arrow_map(docs_of(docs), one, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string")


def clean(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``docs`` without the rejected documents and without the failing lines of the others; same columns."""
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, rules) for t in batch.column(at).to_pylist()]
            columns = [pa.array([r[7] for r in rows], pa.string()) if i == at else pa.array([len(r[7]) for r in rows]).cast(c.type) if i == counted else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([r[6] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
