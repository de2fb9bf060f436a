"""Quality rules, lines first: every line passes or fails rules on punctuation, navigation and boilerplate; failing
lines go; a document that loses too large a share of its words, or that fails the base rules, is rejected.

Lines are split at \\n; words are runs of anything but ASCII white space. A line without words passes. The rules:

* punctuation: over ``symbol_share`` of a line's characters (white space aside) are symbols of ``#*$%&|<>~^=_+@{}[]\\``
  or marks that repeat (``!!``, ``??``, not dots), or the line ends without terminal punctuation and has fewer than
  ``min_open_words`` words.
* navigation: at least ``min_separators`` words are lone separators (``|``, ``»``, ``›``, ``•``, ``·``, ``/``, ``>``) with at
  most ``max_entry_words`` words for each.
* boilerplate: at most ``max_boilerplate_words`` words, with a phrase of BOILERPLATE as whole words, or nothing but one of CALLS.

Base rules: fewer than ``min_words`` words, or over half of the words in repeated three-word windows.

Null or empty text: no words, hence rejected by the base rules; its cleaned text is empty. Repeated rows stay repeated.
Extra columns pass ``clean`` through, whatever their names. Very long texts are measured with arrays as long as their words. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidefold.llm.common import bounded, map_rows, plain, words_of

#: Phrases of page furniture in English, German, French and Spanish, in lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "click here", "cookie policy", "cookie settings", "enable javascript",
    "javascript is disabled", "lorem ipsum", "log in to", "privacy policy", "share this", "sign in to", "sign up for",
    "skip to content", "subscribe to our", "terms of service", "terms of use", "this site uses cookies", "uses cookies", "we use cookies",
    "alle rechte vorbehalten", "cookies akzeptieren", "cookie einstellungen", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "zum inhalt springen",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "aller au contenu",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "condiciones de uso", "utiliza cookies", "saltar al contenido",
)
#: Short calls that are furniture only where a line holds nothing else.
CALLS = ("log in", "read more", "sign in", "sign up", "anmelden", "weiterlesen", "se connecter", "lire la suite", "iniciar sesión", "leer más")
SEPARATORS = frozenset(x.encode() for x in ("|", "»", "›", "•", "·", "/", ">"))
#: Characters that may end a finished line.
TERMINAL = tuple(".!?…:;\"'”’»)]}。！？")
SYMBOLS = b"#*$%&|<>~^=_+@{}[]\\"
CONTRACT_SYMBOLS = b"#*$%&|<>"
_BOILERPLATE = re.compile(rf"(?:^|[\W_])(?:{'|'.join(map(re.escape, BOILERPLATE))})(?:[\W_]|$)|^[\W_]*(?:{'|'.join(map(re.escape, CALLS))})[\W_]*$")
_REPEATED_MARK = re.compile(rb"([!?,;:])\1+")
_SPACE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    symbol_share: float = 0.12
    min_open_words: int = 5
    min_separators: int = 3
    max_entry_words: float = 4.0
    max_boilerplate_words: int = 12
    max_lost_share: float = 0.5


class Measured(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    n_lost_words: int
    kept: bool
    cleaned: str


def line_fails(line: str, rules: Rules = Rules()) -> str:
    """The name of the first rule that a line fails, or an empty string."""
    raw = line.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return ""
    solid = sum(map(len, words))
    separators = sum(w in SEPARATORS for w in words)
    if separators >= rules.min_separators and len(words) - separators <= rules.max_entry_words * (separators + 1):
        return "navigation"
    odd = len(raw) - len(raw.translate(None, SYMBOLS))
    odd += sum(m.end() - m.start() for m in _REPEATED_MARK.finditer(raw))
    if odd > rules.symbol_share * solid:
        return "punctuation"
    if len(words) <= rules.max_boilerplate_words and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if len(words) < rules.min_open_words and not line.rstrip().endswith(TERMINAL):
        return "punctuation"
    return ""


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """How many words lie in windows of ``size`` words that occur twice or more in the text."""
    n = len(words)
    if n <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    key = ids[: n - size + 1]
    for k in range(1, size):  # windows of k + 1 words, numbered from 0 on, so that no product overflows
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : n - size + 1 + k]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(size):
        covered[k : n - size + 1 + k] |= twice
    return int(covered.sum())


def measure(text: str | None, rules: Rules = Rules()) -> Measured:
    """All figures and verdicts of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    seen: set[str] = set()
    dups = lost = 0
    good = []
    for line in lines:
        count = len(words_of(line))
        if count:
            dups += line in seen
            seen.add(line)
        if count and line_fails(line, rules):
            lost += count
        else:
            good.append(line)
    repeated = repeat_words(words)
    failed = len(words) < rules.min_words or 100 * repeated > rules.max_repeat_percent * len(words)
    return Measured(
        len(words), len(text) - sum(map(raw.count, (bytes([c]) for c in _SPACE))), len(raw) - len(raw.translate(None, CONTRACT_SYMBOLS)), dups, repeated,
        failed, lost, not failed and lost <= rules.max_lost_share * len(words), "\n".join(good),
    )


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lost_words long, kept boolean, cleaned string"


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), cleaned: bool = False) -> DataFrame:
    """One row a document: its id and figures; the cleaned text only on request."""

    def make():
        return lambda key, text: [(key, *(m := measure(text, rules)))[: None if cleaned else -1]]

    fields = FIGURES.split(", ")[: None if cleaned else -1]
    return map_rows(df, make, [plain(id_col), plain(text_col)], f"{plain(id_col)} {df.schema[id_col].dataType.simpleString()}, " + ", ".join(fields))


def clean(df: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, without their failing lines; columns as before."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = [measure(text.as_py(), rules) for text in part.column(at)]
                rows = [k for k, m in enumerate(made) if m.kept]
                if rows:
                    columns = [pa.array([made[k].cleaned for k in rows]) if n == at else part.column(n).take(pa.array(rows)) for n in range(part.num_columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return bounded(df).mapInArrow(run, df.schema)
