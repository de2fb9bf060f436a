"""Byte-level BPE: tiktoken with a local rank file, whole texts, raw-byte decoding.

``encode`` gives every text its token ids; ``decode`` gives ids their bytes. A long text is cut before a
white-space run that follows something else: no match of the pattern holds white space after other characters, so
such a cut lies between two matches and the ids stay those of the whole text. Tokens need not be whole characters,
so decoding gives bytes, not text.

Null text: no ids (an empty array). Empty text: an empty array. Null ids: null. Extra columns pass through;
repeated rows stay repeated. An id that the rank file lacks raises KeyError in ``decode``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm.common import bounded

#: Texts over so many characters are cut into parts of about that size.
LONG = 100_000
#: Texts whose ids are held at once.
AT_ONCE = 200

#: The characters that Unicode calls white space, as the pattern's ``\\s`` does.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (lines of base64 token and rank), one a worker process."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of about ``size`` characters that end where a match of the pattern ends; their join is the text."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def ids_of(text: str | None, enc: tiktoken.Encoding, size: int = LONG) -> np.ndarray:
    """The ids of one whole text."""
    if not text:
        return np.empty(0, dtype=np.int32)
    parts = [np.array(enc.encode_ordinary(part), dtype=np.int32) for part in safe_parts(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, text_col: str, ranks_path: str, pattern: str, out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add ``out``, the ids (array<int>) of the whole text; with ``decoded`` also that column, the bytes that the ids stand
    for, read back from the ids in the same pass. Batches end after AT_ONCE rows or about a million ids."""
    schema = _with(df, out, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([*(f for f in schema if f.name != decoded), T.StructField(decoded, T.BinaryType())])
    kept = [f.name for f in schema if f.name not in (out, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)

        def made(part: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            columns = [part.column(part.schema.get_field_index(k)) for k in kept]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
            if decoded:
                columns.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids, start, size = [], 0, 0
            for k in range(batch.num_rows):
                ids.append(ids_of(texts[k].as_py(), enc))
                size += len(ids[-1])
                if size > 1_000_000 or len(ids) == AT_ONCE or k == batch.num_rows - 1:
                    yield made(batch.slice(start, len(ids)), ids)
                    ids, start, size = [], k + 1, 0

    return bounded(df).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str, ranks_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes (binary) that the ids stand for, without regard to character bounds."""
    schema = _with(df, out, T.BinaryType())
    kept = [f.name for f in schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                column = [part.column(part.schema.get_field_index(k)) for k in kept]
                raw = [None if x.as_py() is None else enc.decode_bytes(x.as_py()) for x in part.column(part.schema.get_field_index(ids_col))]
                yield pa.RecordBatch.from_arrays([*column, pa.array(raw, pa.binary())], names=[f.name for f in schema])

    return bounded(df).mapInArrow(run, schema)


def digests(df: DataFrame, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space) and ``decoded_sha256``."""
    return df.withColumns(
        {
            "n_tokens": F.size(ids_col).cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256),
            "decoded_sha256": F.sha2(F.col(decoded_col), 256),
        }
    )
