"""The registered queries over the smallest tables, against SQL or brute force over the same tables."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tidefold.llm import html_text, queries, suffix_dedup
from tokenizers import Tokenizer

from .test_simhash import slow_fingerprint, slow_groups
from .test_suffix_dedup import brute, covered

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


def run(spark, name):
    return queries.queries()[name](spark, FOLDER)


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    df, want = run(spark, name), duck.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda found, names: sorted((tuple(r[names.index(c)] for c in order) for r in found), key=str)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_op1(spark, docs, duck):
    import math
    from collections import Counter

    from tidefold.llm.lm_scoring import Settings

    from .test_lm_scoring import left_out

    got = run(spark, "op1_lm_scoring").collect()
    good = {r[0] for r in duck.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    split = [(d, (t or "").lower().encode().split()) for d, t in docs]
    models = [(Counter(w for d, ws in split if f(d) for w in ws), Counter(p for d, ws in split if f(d) for p in zip(ws, ws[1:]))) for f in (lambda d: d in good, lambda d: True)]
    by = {r.doc_id: r for r in got}
    for d, ws in split:
        if ws:
            want = [left_out(*m, ws, len(models[1][0]), Settings(), inside) for m, inside in zip(models, (d in good, True))]
            assert math.isclose(by[d].target_loss, want[0], abs_tol=2e-9) and math.isclose(by[d].background_loss, want[1], abs_tol=2e-9)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    assert {r.doc_id: r.n_tokens for r in got} == {d: len((t or "").lower().encode().split()) for d, t in docs}


def test_op2(spark, duck):
    import re

    got = {r.page_id: r for r in run(spark, "op2_html_text").collect()}
    for page, url, text in duck.sql("SELECT page_id, url, html FROM pages").fetchall():
        import html as H

        inner = re.search(r"<article>(.*?)(</article>|\Z)", text, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|article)\b[^>]*>", inner)]
        assert got[page].url == url and got[page].text == "\n".join(filter(None, parts)) and got[page].n_chars == len(got[page].text)
        assert html_text.marked_text(html_text.blocks(text)) == got[page].text


def test_op3(spark, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in run(spark, "op3_nearest_neighbours").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[ids[q]]
        hit += len({int(i) for i in ids[best]} & {i for i, _ in mine})
        total += 20
        assert len(mine) == 20 and all(abs(p - s[np.searchsorted(ids, i)]) < 1e-12 for i, p in mine)
    assert hit >= 0.9 * total


def test_op4(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in run(spark, "op4_byte_bpe").collect()}
    for doc, text in docs:
        ids = enc.encode_ordinary(text)
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op6(spark, docs):
    want = {k[0]: v for k, v in brute(docs, 50).items()}
    spans = lambda text: covered([tuple(map(int, s.split("-"))) for s in text.split(",") if s])
    got = {r.doc_id: (spans(r.again_spans), spans(r.first_spans)) for r in run(spark, "op6_suffix_dedup").collect()}
    assert got == want
    assert suffix_dedup.LEAST == 50


def test_op8(spark, docs):
    enc = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = run(spark, "op8_best_fit_packing").collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        ids = enc.encode(text, add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            r, part = by_doc[doc][piece], ids[start : start + 4096]
            assert (r.start, r.length, r.ids_crc32) == (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_op10(spark, docs):
    want = slow_groups([(d, slow_fingerprint(t)) for d, t in docs])
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in run(spark, "op10_simhash").collect()), key=str)
    assert got == want
