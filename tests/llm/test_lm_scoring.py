"""Cross-entropy difference: counts by hand, and held-out documents."""

import math
import random
from collections import Counter

import numpy as np
from tidefold.llm import lm_scoring as lm


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def left_out(single, pairs, words, size, s, inside):
    """The mean loss under counts, less the text's own where they hold it."""
    ones, twos = Counter(words), Counter(zip(words, words[1:]))
    n = single.total() - inside * len(words)
    count = lambda w: single[w] - inside * ones[w]
    loss = 0.0
    for k, w in enumerate(words):
        share = (count(w) + s.smoothing) / (n + s.smoothing * (size + 1))
        if k:
            pair = words[k - 1], w
            share = s.bigram_weight * min(1, (pairs[pair] - inside * twos[pair]) / max(1, count(words[k - 1]))) + (1 - s.bigram_weight) * share
        loss -= math.log(share)
    return loss / len(words)


def test_counts_and_losses(spark):
    texts = {1: "A b a B", 2: "b c c", 3: "", 4: None, 5: "a " * 70_000}
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()] + [(2, "b c c", 1, "x"), (None, "c", 1, "x")], "doc_id long, text string, score int, word string")
    s = lm.Settings(vocabulary=3, bits=16)
    known = lm.vocabulary(df.select("text"), s.vocabulary)
    every = Counter(w for r in df.collect() for w in (r.text or "").lower().split())
    assert known == {w.encode(): k for k, (w, _) in enumerate(sorted(every.items(), key=lambda x: (-x[1], x[0])))}
    assert lm.vocabulary(df.select("text"), 1) == {b"a": 0}
    good = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in lm.score(df, good, settings=s).collect()}
    single = {"b": every, "t": Counter("a b a b b c c b c c".split())}
    pairs = {"b": Counter(p for r in df.collect() for p in zip((r.text or "").lower().split(), (r.text or "").lower().split()[1:])), "t": Counter({("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 2, ("c", "c"): 2})}

    def loss(model, text, inside):
        words = text.lower().split()
        return left_out(single[model], pairs[model], words, 3, s, inside)

    for key in (1, 2, 5):
        assert math.isclose(got[key].target_loss, loss("t", texts[key], key != 5), rel_tol=1e-9) and math.isclose(got[key].background_loss, loss("b", texts[key], True), rel_tol=1e-9)
        assert math.isclose(got[key].score, got[key].target_loss - got[key].background_loss, abs_tol=1e-9) and got[key].n_tokens == len(texts[key].split())
    assert got[3].score is None and got[4].n_tokens == 0 and got[None].n_tokens == 1
    assert lm.score(df.limit(0), good.limit(0)).count() == 0


def test_held_out(spark):
    """Documents that neither model's target has seen are told apart."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(300)]
    fine, odd = base[:200], base[100:]
    rows = [(k, sentence(rng, fine if k % 2 else odd, 80)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(k,) for k in range(1, 200, 2)], "doc_id long")
    scores = {r.doc_id: r.score for r in lm.score(df, good).collect() if r.doc_id >= 200}
    inside, outside = (np.array([v for k, v in scores.items() if k % 2 == odd_]) for odd_ in (1, 0))
    assert (inside[:, None] < outside[None, :]).mean() > 0.99


def test_the_target_is_not_favoured(spark):
    """Of documents of one kind, those inside the target score like those outside; copies are told by the background."""
    rng = random.Random(3)
    rows = [(k, sentence(rng, [f"w{j}" for j in range(3000)], 60)) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(200, 240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, spark.createDataFrame([(k,) for k in range(100)], "doc_id long")).collect()}
    inside, outside = (np.array([got[k].score for k in ks]) for ks in (range(100), range(100, 200)))
    assert abs((inside[:, None] < outside[None, :]).mean() - 0.5) < 0.15
    twice, once = (np.array([got[k].score for k in ks]) for ks in (range(200, 240), range(240, 300)))
    assert (twice[:, None] > once[None, :]).mean() > 0.99


def test_nothing_is_capped(spark, monkeypatch):
    """More words and bigrams than the former caps, over several chunks: losses as of exact counts."""
    monkeypatch.setattr(lm, "CHUNK", 50_000)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60_000)}" for _ in range(2000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, spark.createDataFrame([(k,) for k in range(0, 200, 3)], "doc_id long")).collect()}
    s, models = lm.Settings(), []
    for own in (texts[::3], texts):
        split = [t.split() for t in own]
        models.append((Counter(w for t in split for w in t), Counter(p for t in split for p in zip(t, t[1:]))))
    size = len(models[1][0])
    assert size > 32_768 and len(models[1][1]) > 1 << 18
    for key in (0, 1, 150, 199):
        t = texts[key].split()
        want = [left_out(*models[0], t, size, s, key % 3 == 0), left_out(*models[1], t, size, s, True)]
        assert math.isclose(got[key].target_loss, want[0], rel_tol=1e-9) and math.isclose(got[key].background_loss, want[1], rel_tol=1e-9)


def test_a_chunk_does_not_walk_ranges_without_keys(spark):
    """With 400,000 ranges a chunk sends what it sends with 1,024, in more pieces, and takes not much longer."""
    import time

    import numpy as np
    from tidefold.llm import lm_scoring as lm

    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in rng.integers(0, 30_000, 60_000))
    rows = lm.stored(lm.chunks(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", None), "chunk").selectExpr("chunk", "lengths", "words", "at", "n", "array(0L) AS inside")
    keys, took = {}, {}
    for ranges in (1024, 400_000, 1024, 400_000):
        begun = time.time()
        pieces = lm.sent(rows, ranges, None).toPandas()
        took[ranges] = time.time() - begun
        every = pieces.sort_values("part")
        keys[ranges] = np.concatenate([np.cumsum(lm.unpacked(b, n, np.uint64), dtype=np.uint64) for b, n in zip(every["pairs"], every["pairs_n"])])
        assert every["pairs_n"].sum() == len(keys[ranges]) and len(every) <= every["words_n"].sum() + every["pairs_n"].sum()
    assert (keys[1024] == keys[400_000]).all() and (np.diff(keys[1024].astype(object)) > 0).all()
    assert took[400_000] < 20 * took[1024] + 5
