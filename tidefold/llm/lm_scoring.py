"""Cross-entropy difference with two matched bigram models over one vocabulary.

The background model counts all documents, the target model those whose ids are in ``target``. Both use the same
vocabulary: every word of all documents (lower-cased), and one more entry for words not seen. Both have the same form: bigram
shares, interpolated with smoothed unigram shares. Every document, word and bigram is counted, and nothing is capped, unless
``Settings`` asks for it (``vocabulary``: only the most frequent words, the others become one entry; ``bits``: bigrams in hash buckets).

Words and bigrams stand under 64-bit keys. Documents go in chunks of about CHUNK words. A chunk counts its own keys and sends
them, sorted, to the key ranges; so a common key is sent once a chunk. A range adds up its keys and answers every chunk in the
order of the keys sent, so that no model is gathered anywhere. The number of ranges follows the measured number of words; a chunk walks only
ranges that its own keys fall in. The driver holds four sums.

A document's losses are the mean negative log probabilities of its words, in nats; ``score`` is the target's less the
background's: low for text like the target. A document's own words and bigrams are left out of the models that judge it, so that
documents inside the target, outside it and rare ones are held to the same measure; a copy of it elsewhere stays in.

Null or empty text: no words, and null losses. A null id is never in the target. Repeated rows are scored and counted as
often as they stand there. Extra columns do not matter. An empty target leaves a smoothed uniform model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import bounded, plain, stored

#: Different words that a task counts before it passes them on.
MOST = 200_000
#: Words of a chunk, and of a key range, about; ranges at least.
CHUNK, RANGE, RANGES = 1 << 20, 1 << 21, 1024
#: So many numbers are worth being compressed.
FEW = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    vocabulary: int | None = None
    bits: int | None = None
    bigram_weight: float = 0.6
    smoothing: float = 0.5


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary) and ``n`` over all of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                if len(seen) > MOST:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()

    return bounded(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int) -> dict[bytes, int]:
    """All words that are at least as frequent as the least count that at most ``size`` words reach, numbered from the most
    frequent on. Words that occur once never belong to it."""
    top = [(r.n, bytes(r.word)) for r in word_counts(docs).filter("n > 1").orderBy(F.desc("n"), "word").limit(size + 1).collect()]
    least = top[size][0] + 1 if len(top) > size else 2
    return {word: k for k, (n, word) in enumerate(top) if n >= least}


def packed(a: np.ndarray) -> bytes:
    """The numbers compressed, all first bytes first: small numbers leave the other bytes zero. A few numbers stay as they are."""
    if len(a) < FEW:
        return a.tobytes()
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, kind: type) -> np.ndarray:
    if n < FEW:
        return np.frombuffer(blob, dtype=kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def chunks(df: DataFrame, id_col: str, text_col: str, known: dict[bytes, int] | None) -> DataFrame:
    """``chunk``, ``ids`` and ``lengths`` of its documents, ``words`` (the keys of its different words), ``at`` (for each word of the
    texts its place in ``words``, compressed) and ``n``."""
    shared = None if known is None else df.sparkSession.sparkContext.broadcast(known)
    names = ["chunk", "ids", "lengths", "words", "at", "n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        lengths: list[int] = []
        at: list[np.ndarray] = []
        place: dict[bytes, int] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            every = pa.concat_arrays(ids)
            keys = np.fromiter(map(xxhash.xxh64_intdigest, place), dtype=np.uint64, count=len(place))
            row = [[first + made], None, [np.array(lengths, dtype=np.int64).tobytes()], [keys.tobytes()], [packed(np.concatenate(at))], [n]]
            kinds = (pa.int64(), None, pa.binary(), pa.binary(), pa.binary(), pa.int64())
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every) if t is None else pa.array(x, t) for x, t in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            begun = 0
            for k, text in enumerate(batch.column(1)):
                found = words(text.as_py())
                if shared is not None:
                    found = [w if w in shared.value else b"" for w in found]
                at.append(np.fromiter((place.setdefault(w, len(place)) for w in found), dtype=np.uint32, count=len(found)))
                lengths.append(len(found))
                n += len(found)
                if n >= CHUNK:
                    ids.append(batch.column(0).slice(begun, k + 1 - begun))
                    yield flush()
                    ids, lengths, at, place, n, begun, made = [], [], [], {}, 0, k + 1, made + 1
            if begun < batch.num_rows:
                ids.append(batch.column(0).slice(begun))
        if lengths:
            yield flush()

    rows = df.select(F.col(plain(id_col)).alias("id"), F.col(plain(text_col)).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return bounded(rows).mapInArrow(cut, f"chunk long, ids array<{kind}>, lengths binary, words binary, at binary, n long")


class Chunk:
    """A row of ``chunks`` with its keys."""

    def __init__(self, lengths: bytes, keys: bytes, at: bytes, n: int, bits: int | None) -> None:
        self.lengths, self.keys = np.frombuffer(lengths, np.int64), np.frombuffer(keys, np.uint64)
        self.at = unpacked(at, n, np.uint32)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.order = np.argsort(self.keys)
        #: where a word has a predecessor, and the key of the two
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        pairs = self.keys[self.at[self.second - 1]] * MIX + self.keys[self.at[self.second]]
        self.pairs = pairs if bits is None else pairs >> np.uint64(64 - bits) << np.uint64(64 - bits)


def sent(marked: DataFrame, ranges: int, bits: int | None) -> DataFrame:
    """For each chunk and range: the sorted keys of words and of pairs (their steps), how many, and their counts in the background
    and the target."""
    names = ["part", "chunk", *(f"{side}{x}" for side in ("words", "pairs") for x in ("", "_n", "_b", "_t"))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row["lengths"], row["words"], row["at"], row["n"], bits)
                wanted = np.zeros(len(c.lengths), dtype=bool)
                wanted[row["inside"] or []] = True
                inside = wanted[c.doc]
                some = [np.bincount(x, minlength=len(c.keys))[c.order] for x in (c.at, c.at[inside])]
                pairs, count = np.unique(c.pairs, return_counts=True)
                mine, many = np.unique(c.pairs[inside[c.second]], return_counts=True)
                own = np.zeros(len(pairs), dtype=np.int64)
                own[np.searchsorted(pairs, mine)] = many
                out: list[list] = [[], []]
                sides = ((c.keys[c.order], *some), (pairs, count, own))
                of = [((arrays[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64) for arrays in sides]
                used = np.union1d(*of)  # only ranges that occur: a chunk's work does not grow with the corpus
                for place, arrays in enumerate(sides):
                    spans = list(map(slice, np.searchsorted(of[place], used).tolist(), np.searchsorted(of[place], used, side="right").tolist()))
                    small = [a.astype(np.uint32) for a in arrays[1:]]
                    keys = arrays[0]
                    steps = np.diff(keys, prepend=np.uint64(0))
                    begins = np.array([x.start for x in spans if x.stop > x.start], dtype=np.int64)
                    steps[begins] = keys[begins]  # each piece counts from its own first key
                    out[place] = [[packed(steps[x]) for x in spans], [x.stop - x.start for x in spans], *([packed(a[x]) for x in spans] for a in small)]
                columns = [pa.array(used), pa.array([row["chunk"]] * len(used), pa.int64())]
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for side in out for x, t in zip(side, kinds))], names=names)

    return marked.mapInArrow(send, "part long, chunk long, words binary, words_n long, words_b binary, words_t binary, pairs binary, pairs_n long, pairs_b binary, pairs_t binary")


def answers(parts: DataFrame) -> DataFrame:
    """For each chunk and range the sums over all chunks, in the order of the keys sent; and a row without chunk with the
    number of different words."""
    names = ["chunk", "part", *(f"{side}{x}" for side in ("words", "pairs") for x in ("_n", "_b", "_t")), "n"]

    def add(table: pa.Table) -> pa.Table:
        chunk, part = table.column("chunk").to_pylist(), table.column("part")[0].as_py()
        columns: list[list] = [[*chunk, None], [part] * (len(chunk) + 1)]
        different = 0
        for side in ("words", "pairs"):
            many = table.column(f"{side}_n").to_pylist()
            sent_keys = [np.cumsum(unpacked(b, n, np.uint64), dtype=np.uint64) for b, n in zip(table.column(side).to_pylist(), many)]
            keys, place = np.unique(np.concatenate(sent_keys), return_inverse=True)
            ends = np.cumsum([0] + many).tolist()
            columns.append([*many, None])
            for model in ("b", "t"):
                counts = np.concatenate([unpacked(b, n, np.uint32) for b, n in zip(table.column(f"{side}_{model}").to_pylist(), many)])
                total = np.bincount(place, counts, len(keys)).astype(np.int64)[place]
                columns.append([*(packed(total[x:y]) for x, y in zip(ends, ends[1:])), None])
            different = different or len(keys) * (side == "words")
        columns.append([None] * len(chunk) + [different])
        kinds = (pa.int64(), pa.int64(), *[pa.int64(), pa.binary(), pa.binary()] * 2, pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return parts.groupBy("part").applyInArrow(add, "chunk long, part long, words_n long, words_b binary, words_t binary, pairs_n long, pairs_b binary, pairs_t binary, n long")


def own_counts(places: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry how many entries of its document have its place."""
    _, at, count = np.unique(docs * (int(places.max(initial=0)) + 1) + places, return_inverse=True, return_counts=True)
    return count[at]


def losses(c: Chunk, single: np.ndarray, pairs: np.ndarray, own: tuple[np.ndarray, np.ndarray], inside: np.ndarray, total: int, size: int, s: Settings) -> np.ndarray:
    """The loss of each word of a chunk under one model, from the counts of its words and its pairs, less a document's own counts
    where the model holds it (``inside``); a text's first word has no predecessor."""
    known = inside[c.doc]
    ones = single[c.at] - own[0] * known
    share = (ones + s.smoothing) / ((total - c.lengths * inside)[c.doc] + s.smoothing * (size + 1))
    before = np.maximum(ones[c.second - 1], 1)
    share[c.second] = s.bigram_weight * np.minimum((pairs - own[1] * known[c.second]) / before, 1.0) + (1 - s.bigram_weight) * share[c.second]
    return -np.log(share)


def score(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row of ``df``: the id, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score``. ``target``'s first column holds
    the ids of the target's documents."""
    s = settings
    known = None if s.vocabulary is None else vocabulary(df.select(F.col(plain(text_col)).alias("text")), s.vocabulary)
    rows = stored(chunks(df, id_col, text_col, known), "chunks")
    marks = target.select(F.col(plain(target.columns[0])).alias("__t")).filter("__t IS NOT NULL").distinct()
    # the merge hint holds at every size: labels grow with the documents
    docs = rows.select("chunk", F.posexplode("ids").alias("pos", "id"))
    inside = stored(docs.join(marks.hint("merge"), F.col("id") == F.col("__t"), "left_semi").groupBy("chunk").agg(F.collect_list("pos").alias("inside")), "inside")
    total = rows.agg(F.sum("n")).first()[0] or 0
    marked = rows.select("chunk", "lengths", "words", "at", "n").join(inside, "chunk", "left")
    found = stored(answers(sent(marked, max(RANGES, total // RANGE), s.bits)), "answers")
    size = (found.agg(F.sum("n")).first()[0] or 0) if known is None else len(known)
    sizes = rows.join(inside, "chunk").select("lengths", "inside")
    wanted = _words_inside(sizes)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        ordered = right.filter(pc.is_valid(right.column("part"))).sort_by("part")
        marks = [x for row in right.column("inside").to_pylist() for x in row or ()]
        for row in left.select(["lengths", "words", "at", "n"]).to_pylist():
            c = Chunk(row["lengths"], row["words"], row["at"], row["n"], s.bits)
            place = np.unique(c.pairs, return_inverse=True)[1]
            own = own_counts(c.at.astype(np.int64), c.doc), own_counts(place, c.doc[c.second])
            inside = np.zeros(len(c.lengths), dtype=bool)
            inside[marks] = True
            sums = []
            for model, words_in, within in (("t", wanted, inside), ("b", total, np.ones_like(inside))):
                got = {side: np.concatenate([np.zeros(0, np.int64), *(unpacked(b, n, np.int64) for b, n in zip(ordered.column(f"{side}_{model}").to_pylist(), ordered.column(f"{side}_n").to_pylist()))]) for side in ("words", "pairs")}
                single = np.empty(len(c.keys), dtype=np.int64)
                single[c.order] = got["words"]
                sums.append(np.bincount(c.doc, losses(c, single, got["pairs"][place], own, within, words_in, size, s), len(c.lengths)))
            none = c.lengths == 0
            means = [x / np.maximum(c.lengths, 1) for x in (sums[0], sums[1], sums[0] - sums[1])]
            out = [pa.array(c.lengths), *(pa.array(m, mask=none) for m in means)]
        return pa.Table.from_arrays([left.column("ids").combine_chunks().flatten(), *out], names=["id", "n_tokens", "target_loss", "background_loss", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    by_chunk = found.filter("chunk IS NOT NULL").drop("n").unionByName(inside, allowMissingColumns=True).groupBy("chunk")
    done = rows.groupBy("chunk").cogroup(by_chunk).applyInArrow(judge, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return done.withColumnRenamed("id", id_col)


def _words_inside(marked: DataFrame) -> int:
    """The number of words of the target's documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [int(np.frombuffer(x, np.int64)[i].sum()) for x, i in zip(*(batch.column(k).to_pylist() for k in range(2)))]
            yield pa.RecordBatch.from_arrays([pa.array(many, pa.int64())], names=["n"])

    return marked.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
