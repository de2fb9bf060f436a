"""Best-fit packing by a plan over lengths.

``pieces`` turns documents into token pieces of at most ``capacity``; ``pack`` gives every piece a sequence and an
offset there. The plan is made from the histogram of lengths alone: at most ``capacity`` numbers reach the driver,
whatever the number of documents. Best fit goes over the lengths from long to short and treats all bins of one
free space as a class, so that a step of the plan places many pieces. A piece then takes the planned slot of its rank
among the pieces of its length.

Ranks: pieces of one length are dealt over BUCKETS buckets by a hash; a rank is the number of pieces in earlier
buckets plus the place inside its own, so that one very common length is not ranked by one task.

Null text counts as empty: one piece that holds the end token only. Rows with equal ids stay apart. Ties in rank go
by the key columns. An empty table gives an empty result. Other columns of the input do not matter; an id column that is named like a
column of the result comes back as ``id``.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidefold.llm.common import fresh, map_rows, plain

BUCKETS = 1024

# --- tokens -----------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter: printable Latin-1 bytes as themselves, the others
    in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Recent(dict):
    """A cache of at most 2 * ``most`` entries: when ``most`` are new, older ones that nobody asked for since go."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def keep(self, key: str | bytes, value: bytes) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Words(Recent):
    """From a word of the pre-tokenizer, lower-cased, to its ids; the model is asked for each word once."""

    def __init__(self, model, most: int):
        super().__init__(most)
        self.tokenize = model.tokenize
        self.letters = [x for _, x in sorted(_byte_letters().items())]

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            raw = word if word.isascii() and word.isalnum() else "".join(map(self.letters.__getitem__, word.encode()))
            made = array("I", [t.id for t in self.tokenize(raw)]).tobytes()
        return self.keep(word, made) if len(word) <= WordIds.LONGEST else made


class WordIds(Recent):
    """From a white-space-free UTF-8 chunk to its ids as little-endian unsigned 32-bit bytes.

    Where the tokenizer's file says that it normalises by NFC, white space to spaces and lower case, and then takes the words of
    one pattern that holds no white space, a text's ids are those of its chunks in order. For chunks of Latin letters below
    U+0250 the normaliser then only lowers case, and the file's pattern and the model give the ids; any other chunk, and
    one that holds a special token, goes through the whole tokenizer. With any other file whole texts do.
    Chunks and words over LONGEST characters are not kept.
    """

    LONGEST = 48

    def __init__(self, path: str, chunks: int = 100_000, words: int = 150_000):
        super().__init__(chunks)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = _word_pattern(spec)
        self.words = None if pattern is None else regex.compile(pattern)
        self.of_word = Words(self.whole.model, words)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.simple = re.compile(r"[\x21-\x7e\xa1-ɏ]+\Z")

    def __missing__(self, chunk: bytes) -> bytes:
        made = self.older.get(chunk)
        if made is None:
            of_word = self.of_word
            if chunk.isalpha():  # ASCII letters
                made = of_word[chunk.lower().decode()]
            elif chunk[:-1].isalpha() and chunk[-1:] in b".,;:!?":
                made = of_word[chunk[:-1].lower().decode()] + of_word[chunk[-1:].decode()]
            else:
                text = chunk.decode("utf-8", "replace")
                if not self.simple.match(text) or self.special.search(text):
                    made = self._library(text)
                else:
                    low = text.lower()
                    made = of_word[low] if low.isalpha() else b"".join([of_word[w] for w in self.words.findall(low)])
        return self.keep(chunk, made) if len(chunk) <= self.LONGEST else made

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words is None:
            return self._library(text.encode("utf-8", "replace").decode())
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


def _word_pattern(spec: dict) -> str | None:
    """The pattern of words of a tokenizer file, if the file normalises and splits in the way that ``WordIds`` takes chunks by."""
    normal = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (steps[0].get("pattern") or {}).get("Regex")
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
    letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    known = spec.get("normalizer") == normal and steps == [split, letters] and spec.get("post_processor") is None and spec["model"]["type"] == "BPE"
    plain_tokens = not any(t["content"].isalpha() or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    return pattern if known and plain_tokens and pattern.startswith("'s|'t|'re|'ve|'m|'ll|'d|") and pattern.endswith(r"|[^\s\p{L}\p{N}]+") else None


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: the id, ``piece`` (from 0), ``start`` (ids before it), ``length`` and ``ids`` (little-endian
    unsigned 32-bit). Only documents of more than ``capacity`` ids, end token included, are cut."""
    end = np.array([end_id], dtype="<u4").tobytes()
    wide = 4 * capacity

    def make():
        ids = word_ids(tokenizer_path)

        def cut(key, text) -> Iterable[tuple]:
            whole = ids.of_text(text) + end
            for at in range(0, len(whole), wide):
                part = whole[at : at + wide]
                yield key, at // wide, at // 4, len(part) // 4, part

        return cut

    kind = df.schema[id_col].dataType.simpleString()
    name = "id" if id_col.lower() in ("piece", "start", "length", "ids") else id_col
    return map_rows(df, make, [plain(id_col), plain(text_col)], f"{plain(name)} {kind}, piece int, start long, length long, ids binary")


# --- plan -------------------------------------------------------------------------------------------------------


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, how many, first sequence, offset): the pieces of a length with ranks from the
    first on go to as many sequences from the first on, all at that offset."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    slots: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first sequence, how many)
    sizes = np.zeros(capacity + 1, dtype=bool)  # which free spaces occur
    opened = 0

    def put_back(space: int, first: int, count: int) -> None:
        if space and count:
            free.setdefault(space, []).append((first, count))
            sizes[space] = True

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero(sizes[length:])
            if len(fits):
                space = length + int(fits[0])
                first, bins = free[space].pop()
                if not free[space]:
                    sizes[space] = False
            else:
                space, first = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            each = space // length  # best fit goes on in a bin that it has begun
            full = min(bins, left // each)
            for k in range(each if full else 0):
                slots.append((length, rank, full, first, capacity - space + k * length))
                rank += full
            left -= full * each
            put_back(space - each * length, first, full)
            first, bins = first + full, bins - full
            if left and bins:  # fewer than ``each`` are left for one more bin
                some = left
                for k in range(some):
                    slots.append((length, rank, 1, first, capacity - space + k * length))
                    rank += 1
                left = 0
                put_back(space - some * length, first, 1)
                first, bins = first + 1, bins - 1
            put_back(space, first, bins)
    return slots


def ranked(df: DataFrame, length_col: str, key_cols: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add ``rank`` (from 0) among the rows of one length."""
    bucket, n, before, inside = fresh(df, "bucket", "n", "before", "in")
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*key_cols), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(length_col, bucket).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(length_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(length_col, bucket, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    numbered = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(length_col, bucket).orderBy(*key_cols)) - 1)
    return numbered.join(offsets, [length_col, bucket]).withColumn("rank", F.col(before) + F.col(inside)).select(*(plain(c) for c in df.columns), "rank")


def pack(df: DataFrame, length_col: str, key_cols: list[str], capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset``, in place of columns of these names and of ``rank``. ``df`` is read twice (counts, then slots): give a stored table."""
    df = df.drop("sequence_id", "offset", "rank")
    counts = df.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    slots = np.array(plan({int(r[0]): int(r[1]) for r in counts}, capacity), dtype=np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(slots)
    rows = ranked(df, length_col, key_cols)
    schema = T.StructType([*(f for f in rows.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    wide = 50  # ranks stay below 2 ** 50

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = (table[:, 0] << wide) | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            length = np.asarray(batch.column(names.index(length_col)), dtype=np.int64)
            rank = np.asarray(batch.column(names.index("rank")), dtype=np.int64)
            slot = table[np.searchsorted(starts, (length << wide) | rank, side="right") - 1]
            kept = [n for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(n)) for n in kept), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])],
                names=[*kept, "sequence_id", "offset"],
            )

    return rows.mapInArrow(place, schema)
