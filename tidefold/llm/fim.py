"""Fill-in-the-middle: texts cut at two places and written as prefix, suffix and middle, in an order from which they can be rebuilt.

Sparse checkpoint index: while the units of a text are counted, the byte and the code-point offset of every ``every``-th unit are
kept. A cut is found by binary search among these checkpoints and a short scan from there, so that a text is walked through once, however
long it is, and the index takes little beside it. A unit is a code point, or a match of the pattern ``unit`` (which may not look behind); cut k is
where unit k begins, and the last cut is the text's end.

Draws come from a digest of the seed and the id alone, so that they do not depend on partitions or on other rows: rows with equal ids
are cut by the same draws. ``markers`` that stand in a text would make its output ambiguous: such texts stay plain.

Null text counts as empty; an empty text is plain. A null id is drawn for as an empty one. Repeated rows give repeated rows. Other columns
of the input do not matter, whatever their names; results are named ``id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and
``output``. An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import map_rows, plain

#: Bytes that are counted at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1"
    plain_percent: int = 10
    spm_percent: int = 20
    every: int = 1024
    unit: str | None = None

    def __post_init__(self):
        marks = self.markers
        # a mark's first letter nowhere else in a mark: what is written between two marks cannot make a third with them
        if len(set(marks)) < 3 or not all(marks) or any(a[0] in b[1:] for a in marks for b in marks) or any(b.startswith(a) for a in marks for b in marks if a != b):
            raise ValueError("markers must differ, and none may begin inside another one")

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass
class Checkpoints:
    """``n`` units of ``data``; ``at_byte`` and ``at_char`` hold the offsets of units 0, every, 2 * every and so on."""

    data: bytes
    every: int
    pattern: regex.Pattern | None = None
    n: int = 0
    chars: int = 0
    units: array = field(default_factory=lambda: array("q", [0]))
    at_byte: array = field(default_factory=lambda: array("q", [0]))
    at_char: array = field(default_factory=lambda: array("q", [0]))

    def __post_init__(self):
        if self.pattern is None:
            self._count_code_points()
        else:
            self._count_matches()

    def _keep(self, unit: int, byte: int, char: int) -> None:
        if unit:
            self.units.append(unit)
            self.at_byte.append(byte)
            self.at_char.append(char)

    def _count_code_points(self) -> None:
        for at in range(0, len(self.data), BLOCK):
            begins = np.flatnonzero(_leading(self.data, at, at + BLOCK))
            for k in range(-self.n % self.every, len(begins), self.every):
                self._keep(self.n + k, at + int(begins[k]), self.n + k)
            self.n += len(begins)
        self.chars = self.n

    def _count_matches(self) -> None:
        text, byte, char = self.data.decode("utf-8", "replace"), 0, 0
        for m in self.pattern.finditer(text):
            if self.n % self.every == 0:
                byte, char = byte + len(text[char : m.start()].encode()), m.start()
                self._keep(self.n, byte, char)
            self.n += 1
        self.chars = len(text)

    def cut(self, unit: int) -> tuple[int, int]:
        """Where unit ``unit`` begins: byte and code point."""
        if unit <= 0:
            return 0, 0
        if unit >= self.n:
            return len(self.data), self.chars
        k = bisect_right(self.units, unit) - 1
        byte, char, more = self.at_byte[k], self.at_char[k], unit - self.units[k]
        if not more:
            return byte, char
        if self.pattern is None:  # a code point has four bytes at most
            return byte + int(np.flatnonzero(_leading(self.data, byte, byte + 4 * more + 4))[more]), char + more
        end = self.at_byte[k + 1] if k + 1 < len(self.at_byte) else len(self.data)
        text = self.data[byte:end].decode("utf-8", "replace")
        for i, m in enumerate(self.pattern.finditer(text)):
            if i == more:
                return byte + len(text[: m.start()].encode()), char + m.start()
        raise AssertionError(f"unit {unit} is not behind checkpoint {k}")


def _leading(data: bytes, start: int, end: int) -> np.ndarray:
    """Which bytes of a part begin a code point."""
    end = min(end, len(data))
    return (np.frombuffer(data, dtype=np.uint8, count=end - start, offset=start) & 0xC0) != 0x80


def draws(id_col: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 for each id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(df: DataFrame, id_col: str, text_col: str, settings: Settings = Settings()) -> DataFrame:
    """``id``, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (code points; null if plain) and ``output``."""
    s = settings

    def make():
        prefix, suffix, middle = (m.encode() for m in s.markers)
        pattern = regex.compile(s.unit) if s.unit else None

        def one(key, data, h1, h2, h3, h4) -> Iterable[tuple]:
            data = data or b""
            if pattern is not None:
                data = data.decode("utf-8", "replace").encode()
            index = Checkpoints(data, s.every, pattern)
            if not data or h3 % 100 >= 100 - s.plain_percent or prefix in data or suffix in data or middle in data:
                yield key, index.n, "plain", None, None, data
                return
            (b1, c1), (b2, c2) = (index.cut(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
            head, inside, tail = data[:b1], data[b1:b2], data[b2:]
            if h4 % 100 < s.spm_percent:
                yield key, index.n, "spm", c1, c2 - c1, b"".join((suffix, tail, prefix, head, middle, inside))
            else:
                yield key, index.n, "psm", c1, c2 - c1, b"".join((prefix, head, suffix, tail, middle, inside))

        return one

    key = F.col(plain(id_col))
    rows = df.select(key.alias("id"), F.col(plain(text_col)).cast("binary").alias("data"), *draws(key, s.seed))
    kind = df.schema[id_col].dataType.simpleString()
    made = map_rows(rows, make, rows.columns, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(settings: Settings = Settings(), form: str = "form", output: str = "output") -> Column:
    """The text that an output was made of: built-in functions on the form and the output alone."""
    s = settings

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(F.col(plain(output)), len(first) + 1, F.length(F.col(plain(output))))
        rest = F.substring_index(body, second, -1)
        return F.substring_index(body, second, 1), F.substring_index(rest, s.middle, 1), F.substring_index(rest, s.middle, -1)

    prefix, suffix, middle = parts(s.prefix, s.suffix)
    suffix2, prefix2, middle2 = parts(s.suffix, s.prefix)
    which = F.col(plain(form))
    return F.when(which == "psm", F.concat(prefix, middle, suffix)).when(which == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(F.col(plain(output)))
