"""The pipeline's stages, each judged on its own input."""

import os

import corpus_pipeline
import numpy as np
import pytest
from tidefold.llm import quality, suffix_dedup

from .test_resemblance import judge
from .test_suffix_dedup import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], FOLDER).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 3:
            assert tables[-1].columns == docs.columns
    raw, cleaned, single, cut, packed = ([r.asDict() for r in t.collect()] for t in tables)
    judged = {r["doc_id"]: quality.measure(r["text"], corpus_pipeline.RULES) for r in raw}
    assert {r["doc_id"]: r["text"] for r in cleaned} == {d: m.cleaned for d, m in judged.items() if m.kept}
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned + cut)
    stay, missed, met = judge([(r["doc_id"], r["text"]) for r in cleaned], {r["doc_id"] for r in single})
    assert stay and missed <= 0.05 * met
    found = {k[0]: v[0] for k, v in brute([(r["doc_id"], r["text"]) for r in single], 50).items()}
    after = {r["doc_id"]: r["text"] for r in cut}
    for r in single:
        words = r["text"].encode().split()
        left = [w for k, w in enumerate(words) if k not in found.get(r["doc_id"], ())]
        assert after.get(r["doc_id"], "").encode().split() == left
        if r["doc_id"] not in found:
            assert after[r["doc_id"]] == r["text"]
    assert not any(again for again, _ in brute([(r["doc_id"], r["text"]) for r in cut], 50).values()) or suffix_dedup.LEAST == 50
    assert {r["doc_id"] for r in packed} == set(after)
    ends = {}
    for r in packed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in ends.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 4096


def test_odd_tables(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, length int, rank string"
    prose = " ".join(f"word{k}" for k in range(80)) + "."
    rows = [(1, prose, "en", "a", 3, 1, "x"), (1, prose, "en", "a", 3, 1, "x"), (2, None, None, None, None, None, None), (None, prose + " More.", "en", None, 1, 1, "x"), (4, "", "en", "a", 0, 0, "")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kinds)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/nowhere")
            assert docs.columns == [c.split()[0] for c in kinds.split(", ")]
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere").collect()
        assert (len(last) > 0) == bool(data)
