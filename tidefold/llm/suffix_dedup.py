"""Repeated passages by sparse suffix arrays.

A passage of ``least`` words (50) that occurs again is found, whatever stands around it, and every occurrence but the
first is marked. The result is exact: a word is marked as repeated if and only if some window of ``least`` words that
holds it also occurs elsewhere. Passages are equal if 128 bits of hashes over their words are.

1. Suffixes are kept at minimisers only: of each ``window`` (25) neighbouring five-word grams the one with the least hash
   (the first, if equal). The choice looks at the words alone, so both occurrences of a passage keep the same suffixes.
   Every window of ``least`` words belongs to the suffix that is the minimiser of its first grams, and holds the
   first ``least - window + 1`` (26) words of that suffix.
2. The kept suffixes are sorted by those 26 words' hash, then by two hashes of all words their windows cover, over
   ranges that split even one very common suffix; neighbours are compared. A suffix unlike both its neighbours is unique.
   One that equals its neighbour over all its windows repeats as a whole.
3. The others match in part: each match is extended word by word to the left and the right of its suffix, over the at most 25
   windows that hold the suffix's head. An extension by one word is a window of its own, and its copies are met by grouping, so
   that any other text counts, not only the two neighbours in the order. Suffixes at both ends of a range are among
   these, as their neighbours are not known.
4. Marked windows merge into spans of words.

The first occurrence is the one with the least (id, text hash, position). Where passage and first occurrence overlap
in one text (a word repeated on and on), only the words after the first occurrence are marked.

Null ids, null texts and texts of fewer than ``least`` words take no part and stay as they are. Rows with equal id and
text count as one document and are treated alike; rows with equal ids and different texts are different documents. Ids
of other types than whole numbers stand under their 64-bit hashes, by which the first occurrence then goes. Other columns of the input come through
``remove_repeats`` as they are, whatever their names, and are not read by ``repeats``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm.common import bounded, fresh, map_rows, plain, stored, words_of

LEAST, WINDOW, GRAM = 50, 25, 5
#: Kinds of suffixes; one that begins a run of equal ones may be open too.
OPEN, BEGINS, WHOLE = 1, 2, 4
#: Two odd multipliers: of the first hash of a range of words and of the second.
_BASES = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


class Hashes:
    """64-bit hashes of word ranges of a text; keeps the hashes of at most MOST different words between texts."""

    MOST = 200_000

    class _Words(dict):
        def __missing__(self, word: bytes) -> int:
            made = xxhash.xxh64_intdigest(word)
            if len(word) <= 64:
                if len(self) >= Hashes.MOST:
                    self.clear()
                self[word] = made
            return made

    def __init__(self) -> None:
        self.words = self._Words()
        one = np.ones(1, dtype=np.uint64)
        self.up, self.down = [one, one], [one, one]

    def powers(self, n: int) -> None:
        if len(self.up[0]) < n:
            n = max(n, 2 * len(self.up[0]))
            with np.errstate(over="ignore"):
                for k, base in enumerate(_BASES):
                    for of, by in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                        factors = np.full(n, by, dtype=np.uint64)
                        factors[0] = 1
                        of[k] = np.cumprod(factors, dtype=np.uint64)

    def own(self, words: list[bytes]) -> np.ndarray:
        """A hash of each word."""
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))

    def sums(self, own: np.ndarray, which: int = 0) -> np.ndarray:
        n = len(own)
        self.powers(n + 1)
        if which:  # words that the first hash weighs alike, the second does not
            own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(own * self.up[which][:n], dtype=np.uint64)))

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.down[which][start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def kept_suffixes(sums: np.ndarray, n: int, of: Hashes, least: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the minimisers, and the first and last window start that belongs to each."""
    at = np.arange(n - gram + 1)
    grams = of.ranges(sums, at, at + gram)
    starts = n - least + 1
    parts = []
    for a in range(0, starts, 1 << 15):
        b = min(starts, a + (1 << 15))
        parts.append(np.lib.stride_tricks.sliding_window_view(grams[a : b + window - 1], window).argmin(axis=1) + np.arange(a, b))
    pos = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    return pos[first], first, np.concatenate((first[1:], [starts])) - 1


def _columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(_number(df, id_col).alias("doc"), F.col(plain(text_col)).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")


def _number(df: DataFrame, id_col: str) -> Column:
    """The id as a long: itself, or its hash if it is no whole number."""
    key = F.col(plain(id_col))
    return key.cast("long") if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.when(key.isNotNull(), F.xxhash64(key))


def _tag(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def suffixes(docs: DataFrame, least: int = LEAST, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The kept suffixes of ``doc``, ``text``: key (a hash of their first words), all and more (the second and the first hash of all their words), doc, tag, lo, hi (their first and
    last window start)."""
    head = least - window + 1
    names = ["key", "all", "more", "doc", "tag", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hashes()
        kept: list[list[np.ndarray]] = [[] for _ in names]
        count = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)) for k in kept], names=names)

        with np.errstate(over="ignore"):
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    words = words_of(text)
                    n = len(words)
                    if n < least:
                        continue
                    own = of.own(words)
                    sums = of.sums(own)
                    pos, lo, hi = kept_suffixes(sums, n, of, least, window, gram)
                    key = of.ranges(sums, pos, pos + head)
                    shape = np.uint64(31) * (pos - lo).astype(np.uint64) + (hi - lo).astype(np.uint64)
                    more = of.ranges(sums, lo, hi + least)
                    whole = of.ranges(of.sums(own, 1), lo, hi + least, 1) + shape
                    values = (key.view(np.int64), whole.view(np.int64), more.view(np.int64), np.full(len(pos), doc.as_py()), np.full(len(pos), _tag(text)), lo.astype(np.int32), hi.astype(np.int32))
                    for k, v in zip(kept, values):
                        k.append(v)
                    count += len(pos)
                    if count >= 50_000:
                        yield flush()
                        kept, count = [[] for _ in names], 0
        if count:
            yield flush()

    return bounded(docs).mapInArrow(run, "key long, all long, more long, doc long, tag long, lo int, hi int")


def compared(kept: DataFrame) -> DataFrame:
    """Sort and compare neighbours. Gives the suffixes that are not unique, as far as a range of the sort shows:
    ``whole`` ones repeat an earlier suffix over all their windows, whose first (doc, tag, lo) is at hand; the others are
    open: to be compared window by window."""
    ranges = kept.repartitionByRange("key", "all", "more", "doc", "tag", "lo").sortWithinPartitions("key", "all", "more", "doc", "tag", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far: its successor isn't known yet
        first: tuple | None = None  # of the run of equal suffixes that the held row is in
        begun = False

        def decide(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch | None:
            """All rows but the last one; with ``last`` that one too."""
            nonlocal first, begun
            key, whole, more, doc, tag, lo = (rows.column(k).to_numpy() for k in range(6))
            n = len(key)
            like = key[1:] == key[:-1]
            same = like & (whole[1:] == whole[:-1]) & (more[1:] == more[:-1])
            again = same & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (lo[1:] == lo[:-1])  # a repeated row
            before = np.concatenate(([begun and decide.like], like))
            equal = np.concatenate(([begun and decide.same], same))
            twice = np.concatenate(([begun and decide.again], again))
            after = np.concatenate((like, [False]))
            run_of = np.cumsum(~equal)  # 0: the run that began earlier
            starts = np.flatnonzero(~equal)
            # what begins a run is open if its key has another run, or if that can't be seen here
            many = before & ~equal
            group = np.cumsum(~before)
            mixed = np.bincount(group[many], minlength=group[-1] + 1)[group] > 0 if many.any() else np.zeros(n, dtype=bool)
            edge = (group == group[0]) | (group == group[-1])
            keep = (before | after | edge) & ~twice
            whole_ = equal & keep
            is_open = keep & ~equal & (mixed | edge)
            firsts = np.stack([doc, tag, lo.astype(np.int64)])[:, starts] if len(starts) else np.empty((3, 0), dtype=np.int64)
            if first is not None and equal[0]:
                firsts = np.concatenate((np.array(first, dtype=np.int64).reshape(3, 1), firsts), axis=1)
                at = run_of
            else:
                at = run_of - 1
            own = firsts[:, at]
            # the first of a run counts only if another text or place follows it
            copied = np.bincount(run_of[whole_], minlength=run_of[-1] + 1)[run_of] > 0
            take = whole_ | is_open | (keep & ~equal & copied)
            if not last:
                take[-1] = False
            first = tuple(own[:, -1].tolist())
            chosen = np.flatnonzero(take)
            if n > 1:
                decide.like, decide.same, decide.again, begun = bool(before[-1]), bool(equal[-1]), bool(twice[-1]), True
            elif not begun:
                decide.like = decide.same = decide.again = False
                begun = True
            if not len(chosen):
                return None
            kind = np.where(whole_, WHOLE, np.where(is_open, OPEN, 0) + np.where(copied, BEGINS, 0))[chosen].astype(np.int32)
            out = [rows.column(k).take(pa.array(chosen)) for k in range(3, 7)] + [pa.array(kind)] + [pa.array(own[k, chosen]) for k in range(3)]
            return pa.RecordBatch.from_arrays(out, names=["doc", "tag", "lo", "hi", "kind", "first_doc", "first_tag", "first_lo"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            made = decide(rows, False)
            if made is not None:
                yield made
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            made = decide(held, True)
            if made is not None:
                yield made

    return ranges.mapInArrow(run, "doc long, tag long, lo int, hi int, kind int, first_doc long, first_tag long, first_lo long")


def extended(docs: DataFrame, opened: DataFrame, least: int = LEAST) -> DataFrame:
    """The windows of open suffixes that occur twice or more: doc, tag, lo, and the first occurrence."""
    # merge joins at every size: what is joined to the documents grows with them
    wanted = opened.groupBy("doc").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("wanted")).hint("merge")

    def make():
        of = Hashes()

        def windows(doc, text, wanted):
            tag = _tag(text)
            ranges = [(w["lo"], w["hi"]) for w in wanted if w["tag"] == tag]
            if ranges:
                with np.errstate(over="ignore"):
                    own = of.own(words_of(text))
                    starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in ranges]))
                    found = [of.ranges(of.sums(own, k), starts, starts + least, k).view(np.int64).tolist() for k in (0, 1)]
                for start, value, more in zip(starts.tolist(), *found):
                    yield value, more, doc, tag, start

        return windows

    rows = map_rows(docs.join(wanted, "doc"), make, ["doc", "text", "wanted"], "win long, more long, doc long, tag long, lo int", 50_000)
    rows = stored(rows, "windows")
    place = F.struct("doc", "tag", "lo")
    window = ["win", "more"]
    twice = rows.groupBy(window).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select(*window, "first")
    return rows.join(twice.hint("merge"), window).select(
        "doc", "tag", "lo", F.col("lo").alias("hi"),
        F.col("first.doc").alias("first_doc"), F.col("first.tag").alias("first_tag"), F.col("first.lo").cast("long").alias("first_lo"),
    )


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """One row for each document that shares a passage: doc (the id, or its hash if it is no whole number), tag (its text's hash), ``again`` (spans of words, from and
    to, that occur earlier) and ``first`` (spans outside these that occur again later)."""
    docs = _columns(df, id_col, text_col)
    found = stored(compared(stored(suffixes(docs, least, window), "suffixes")), "repeats")
    names = ["doc", "tag", "lo", "hi", "first_doc", "first_tag", "first_lo"]
    wholes = found.filter(f"kind = {WHOLE}").select(*names)
    begins = found.filter(f"kind & {BEGINS} > 0").select(*names)
    windows = extended(docs, found.filter(f"kind & {OPEN} > 0").select("doc", "tag", "lo", "hi"), least)
    here = (F.col("doc") == F.col("first_doc")) & (F.col("tag") == F.col("first_tag"))
    end = F.col("hi") + least
    # in one text, what overlaps the first occurrence stays
    start = F.when(here, F.greatest(F.col("lo"), F.col("first_lo").cast("int") + least)).otherwise(F.col("lo"))
    is_first = here & (F.col("lo") == F.col("first_lo"))
    spans = wholes.union(windows).union(begins).select(
        "doc", "tag", is_first.alias("is_first"), F.when(is_first, F.col("lo")).otherwise(start).alias("a"), end.alias("b")
    )
    by_doc = spans.filter("a < b").groupBy("doc", "tag").agg(
        F.collect_set(F.when(~F.col("is_first"), F.struct("a", "b"))).alias("again"), F.collect_set(F.when(F.col("is_first"), F.struct("a", "b"))).alias("first")
    )

    def make():
        def tidy(doc, tag, again, first):
            again = merged([(x["a"], x["b"]) for x in again])
            yield doc, tag, again, without(merged([(x["a"], x["b"]) for x in first]), again)

        return tidy

    return map_rows(by_doc, make, ["doc", "tag", "again", "first"], "doc long, tag long, again array<array<int>>, first array<array<int>>")


def without(spans: list[list[int]], taken: list[list[int]]) -> list[list[int]]:
    """What of the merged spans lies in none of the merged ``taken`` ones."""
    out, k = [], 0
    for a, b in spans:
        while k and taken[k - 1][1] > a:
            k -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < b:
            if a < taken[j][0]:
                out.append([a, taken[j][0]])
            a = max(a, taken[j][1])
            j += 1
        if a < b:
            out.append([a, b])
    return out


def cut_text(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans; white space between the rest stays as it was."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)] + [len(raw)]
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = starts[b]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """``df`` with every repeated passage cut from all texts but the first that has it; texts of which nothing is left
    go, all other rows stay. Columns as before."""
    found = stored(repeats(df, id_col, text_col, least, window).filter("size(again) > 0"), "spans").groupBy("doc").agg(
        F.collect_list(F.struct("tag", "again")).alias("cuts")
    )
    of, cuts, new = fresh(df, "of", "cuts", "new")
    found = found.select(F.col("doc").alias(of), F.col("cuts").alias(cuts))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, found):
            if own is not None and text is not None:
                tag = _tag(text)
                spans = next((x["again"] for x in own if x["tag"] == tag), None)
                if spans is not None:
                    text = cut_text(text, [list(map(int, s)) for s in spans])
            out.append(text)
        return pd.Series(out, dtype=object)

    columns = [plain(c) for c in df.columns]
    joined = df.join(found.hint("merge"), _number(df, id_col) == F.col(of), "left")
    changed = joined.withColumn(new, F.when(F.col(cuts).isNull(), F.col(plain(text_col))).otherwise(cut(plain(text_col), cuts)))
    left = changed.filter(F.col(cuts).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn(text_col, F.col(new)).select(*columns)
