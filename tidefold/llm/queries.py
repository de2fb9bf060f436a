"""The registered queries of this subpackage and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import lm_scoring

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    made = lm_scoring.score(docs, good, "doc_id", "text")
    # nine decimals: sums of logarithms depend on their order beyond
    return made.select("doc_id", "n_tokens", *(F.round(c, 9).alias(c) for c in ("target_loss", "background_loss", "score")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import html_text

    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import ann

    found = ann.search_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0", "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidefold.llm import bpe

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = bpe.encode(docs, "text", path, pattern, decoded="decoded")
    return bpe.digests(made).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import licenses

    found = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return found.select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_unmatched"
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import chat

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], rows.schema)
    made = chat.format_chats(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    texts = made.select("conv_id", "state", "valid", chat.formatted(F.col("segments")).alias("formatted"), chat.learnt(F.col("segments")).alias("learnt"))
    read = texts.withColumn("turns", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "state", "valid",
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import suffix_dedup

    found = suffix_dedup.repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    words, spans = "aggregate({0}, 0L, (n, s) -> n + s[1] - s[0])", "array_join(transform({0}, s -> s[0] || '-' || s[1]), ',')"
    return found.select(
        F.col("doc").alias("doc_id"), F.expr(words.format("again")).alias("n_again"), F.expr(words.format("first")).alias("n_first"),
        F.expr(spans.format("again")).alias("again_spans"), F.expr(spans.format("first")).alias("first_spans"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidefold.llm import packing
    from tidefold.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), packing, stored)


def packed(docs: DataFrame, tokenizer_path: str, packing, stored) -> DataFrame:
    """Documents to packed pieces with the checksum of their ids."""
    pieces = packing.pieces(docs, "doc_id", "text", tokenizer_path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.pack(stored(pieces, "pieces"), "length", ["doc_id", "piece", "ids_crc32"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.report(docs, "doc_id", "text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import simhash
    from tidefold.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = stored(simhash.fingerprints(docs, "doc_id", "text"), "fingerprints")
    return simhash.groups(fps, "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import fim

    made = fim.transform(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256")
    )


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import pq

    return pq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import trie

    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text", shared_heads=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Lengths of marks: ``<s>`` once; ``[SYS]`` and ``[/SYS]`` 11, ``[INST]`` and ``[/INST]`` 13, ``[ANS]`` and ``</s>`` 9, other roles
#: 20 and their own name; each control string in a text grows by one character.
OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 20 + length(role) END
    + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:s>|/s>|SYS\]|/SYS\]|INST\]|/INST\]|ANS\]|ROLE\]|/ROLE\]|/TURN\])')) AS size
  FROM rows
), numbered AS (
  SELECT *, row_number() OVER w AS n, lag(role, 1, 'start') OVER w AS before FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), ordered AS (
  SELECT *, before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS ok FROM numbered
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(size) AS BIGINT) AS formatted_chars, CASE WHEN bool_and(ok) THEN arg_max(role, n) ELSE 'invalid' END AS state, bool_and(ok) AS valid
FROM ordered GROUP BY conv_id
"""


def _op5_sql() -> str:
    """The rule book as SQL: sentences by position, joined to the known ones, rules one after the other."""
    from tidefold.llm.licenses import ANCHORS, RULES, Rulebook

    known = ", ".join(f"('{text}', '{name}')" for text, name in Rulebook().known.items())
    left, found = "'(' || array_to_string(ids, ')(') || ')'", []
    steps = [f"s0 AS (SELECT doc_id, ids, {left} AS l0 FROM seen)"]
    for k, (name, run) in enumerate(RULES):
        text = "".join(f"({x})" for x in run)
        found.append(f"CASE WHEN contains(l{k}, '{text}') THEN '{name}' END")
        steps.append(f"s{k + 1} AS (SELECT *, replace(l{k}, '{text}', '-') AS l{k + 1} FROM s{k})")
    last = len(RULES)
    return f"""
WITH parts AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '\\n')) AS s FROM documents
  WHERE regexp_matches(lower(text), '{"|".join(ANCHORS)}')
), numbered AS (SELECT doc_id, row_number() OVER () AS pos, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM parts),
normal AS (SELECT doc_id, pos, CASE WHEN regexp_matches(s, '^copyright (c |[0-9]{{4}})') THEN 'copyright holder' ELSE s END AS s FROM numbered),
seen AS (SELECT doc_id, list(k.name ORDER BY pos) AS ids FROM normal JOIN (VALUES {known}) k(text, name) ON s = k.text GROUP BY doc_id),
{", ".join(steps)}
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN list_position(f, f[{k + 1}]) = {k + 1} THEN f[{k + 1}] END" for k in range(last))}], lambda x: x IS NOT NULL), ',') AS licenses,
  array_to_string(ids, ',') AS sentence_ids, CAST(length(l{last}) - length(replace(l{last}, '(', '')) AS BIGINT) AS n_unmatched
FROM (SELECT *, [{", ".join(found)}] AS f FROM s{last})
"""


def _op9_sql() -> str:
    """The base figures by words and windows, the line rules by lines."""
    from tidefold.llm.quality import BOILERPLATE, CALLS, SEPARATORS, Rules

    r, word = Rules(), r"[^\x20\x09-\x0D]+"
    separators = ", ".join(f"'{x.decode()}'" for x in sorted(SEPARATORS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
reps AS (SELECT rid, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY rid),
lines AS (SELECT rid, pos, l, regexp_extract_all(l, '{word}') AS lw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
sized AS (SELECT *, len(lw) AS n, list_sum(list_transform(lw, lambda x: strlen(x))) AS solid, len(list_filter(lw, lambda x: x IN ({separators}))) AS seps,
  len(regexp_extract_all(l, '[#*$%&|<>~^=_+@{{}}\[\]\\]')) + length(l) - length(regexp_replace(l, '!!+|\?\?+|,,+|;;+|::+', '', 'g')) AS odd,
  row_number() OVER (PARTITION BY rid, l ORDER BY pos) > 1 AS dup FROM lines WHERE len(lw) > 0),
judged AS (SELECT rid, n, dup, (seps >= {r.min_separators} AND n - seps <= {r.max_entry_words} * (seps + 1)) OR odd > {r.symbol_share} * solid
  OR (n <= {r.max_boilerplate_words} AND regexp_matches(lower(l), '(?:^|[^\p{{L}}\p{{N}}])(?:{"|".join(BOILERPLATE).replace("'", "''")})(?:[^\p{{L}}\p{{N}}]|$)|^[^\p{{L}}\p{{N}}]*(?:{"|".join(CALLS)})[^\p{{L}}\p{{N}}]*$'))
  OR (n < {r.min_open_words} AND NOT regexp_matches(l, '[.!?…:;"''”’»)\]}}。！？]\s*$')) AS bad FROM sized),
by_doc AS (SELECT rid, CAST(count_if(dup) AS BIGINT) AS dups, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS lost FROM judged GROUP BY rid),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(dups, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words FROM w LEFT JOIN reps USING (rid) LEFT JOIN by_doc USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed, n_lost_words,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words) AND n_lost_words <= {r.max_lost_share} * n_words AS kept
FROM base
"""


def _op1_sql() -> str:
    """Counts by word and by bigram, joined back to every word, less those of its own document."""
    from tidefold.llm.lm_scoring import Settings

    s = Settings()

    def loss(side: str, inside: str) -> str:
        one, before, pair = f"w.{side} - {inside} * o.n", f"greatest(b.{side} - {inside} * bo.n, 1)", f"p.{side} - {inside} * po.n"
        alone = f"({one} + {s.smoothing}) / (t.{side} - {inside} * d.n + {s.smoothing} * (t.size + 1))"
        return f"-ln(CASE WHEN x.prev IS NULL THEN {alone} ELSE {s.bigram_weight} * least(({pair}) / {before}, 1.0) + {1 - s.bigram_weight} * {alone} END)"

    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents),
d AS (SELECT rid, doc_id, len(ws) AS n, CAST(good AS INTEGER) AS g FROM docs),
tokens AS (SELECT rid, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS prev FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
o AS (SELECT rid, word, count(*) AS n FROM tokens GROUP BY ALL), po AS (SELECT rid, prev, word, count(*) AS n FROM tokens WHERE prev IS NOT NULL GROUP BY ALL),
w AS (SELECT word, sum(o.n) AS bg, sum(o.n * g) AS tg FROM o JOIN d USING (rid) GROUP BY word), p AS (SELECT prev, word, sum(po.n) AS bg, sum(po.n * g) AS tg FROM po JOIN d USING (rid) GROUP BY ALL),
t AS (SELECT (SELECT sum(n) FROM d) AS bg, (SELECT sum(n * g) FROM d) AS tg, (SELECT count(*) FROM w) AS size),
scored AS (SELECT x.rid, avg({loss("tg", "d.g")}) AS tl, avg({loss("bg", "1")}) AS bl FROM tokens x JOIN d ON d.rid = x.rid JOIN o ON o.rid = x.rid AND o.word = x.word JOIN w ON w.word = x.word
  LEFT JOIN o bo ON bo.rid = x.rid AND bo.word = x.prev LEFT JOIN w b ON b.word = x.prev LEFT JOIN po ON po.rid = x.rid AND po.prev = x.prev AND po.word = x.word LEFT JOIN p ON p.prev = x.prev AND p.word = x.word, t GROUP BY x.rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, round(tl, 9) AS target_loss, round(bl, 9) AS background_loss, round(tl - bl, 9) AS score FROM d LEFT JOIN scored USING (rid)
"""


#: For pages as they are supplied: one article, blocks at ``p`` and ``h1``, four character references.
OP2_SQL = r"""
WITH inside AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*?)(?:</article>|\z)', 1), '') AS t FROM pages),
parts AS (SELECT page_id, url, list_transform(string_split_regex(t, '</?(?:p|h1)\b[^>]*>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*(?:>|\z)', '', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS ps FROM inside)
SELECT page_id, url, array_to_string(list_filter(ps, lambda x: x <> ''), chr(10)) AS text, CAST(length(array_to_string(list_filter(ps, lambda x: x <> ''), chr(10))) AS BIGINT) AS n_chars FROM parts
"""

#: All windows of 50 words, one by one.
OP6_SQL = r"""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 50], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT k, min({'d': doc_id, 's': s}) AS f FROM win GROUP BY k HAVING count(*) > 1),
met AS (SELECT doc_id, s, f FROM win JOIN firsts USING (k)),
again AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = f.d THEN greatest(s, f.s + 50) ELSE s END, s + 50)) AS x FROM met WHERE doc_id <> f.d OR s <> f.s),
first AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS x FROM met WHERE doc_id = f.d AND s = f.s EXCEPT SELECT * FROM again),
every AS (SELECT doc_id, x, 'a' AS kind FROM again UNION ALL SELECT doc_id, x, 'f' FROM first),
islands AS (SELECT doc_id, kind, min(x) AS a, max(x) + 1 AS b FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, kind ORDER BY x) AS g FROM every) GROUP BY doc_id, kind, g)
SELECT doc_id, CAST(coalesce(sum(b - a) FILTER (kind = 'a'), 0) AS BIGINT) AS n_again, CAST(coalesce(sum(b - a) FILTER (kind = 'f'), 0) AS BIGINT) AS n_first,
  coalesce(string_agg(a || '-' || b, ',' ORDER BY a) FILTER (kind = 'a'), '') AS again_spans, coalesce(string_agg(a || '-' || b, ',' ORDER BY a) FILTER (kind = 'f'), '') AS first_spans
FROM islands GROUP BY doc_id
"""


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
cut AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y, t[1:least(a, b)] AS p, t[least(a, b) + 1:greatest(a, b)] AS m, t[greatest(a, b) + 1:] AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM cut
"""

#: All pairs, and components by reachability.
OP12_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a AS node, a AS seen FROM pairs UNION SELECT node, b FROM reach JOIN pairs ON a = seen),
low AS (SELECT node, min(seen) AS c FROM reach GROUP BY node), many AS (SELECT a AS node, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(c, vec_id), vec_id) AS component_id, coalesce(c, vec_id) >= vec_id AS kept FROM embeddings LEFT JOIN low ON low.node = vec_id LEFT JOIN many ON many.node = vec_id
"""

#: CRC-32 bit by bit; prefixes as digests of the turns' digests; every node meets the nodes above it on its owner's path.
OP13_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))),
  lambda r, e: CASE WHEN xor(r, e) % 2 = 1 THEN xor(xor(r, e) >> 1, 3988292384) ELSE xor(r, e) >> 1 END), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
made AS (SELECT convs.c, 0 AS part, pos, k, len FROM convs JOIN t ON t.c = base WHERE pos <= h UNION ALL SELECT t.c, 1, pos, k, len FROM t JOIN convs ON convs.c = t.c WHERE pos > h),
lists AS (SELECT convs.c, coalesce(ks, []) AS ks, coalesce(lens, []) AS lens FROM convs LEFT JOIN (SELECT c, list(k ORDER BY part, pos) AS ks, list(len ORDER BY part, pos) AS lens FROM made GROUP BY c) USING (c)),
steps AS (SELECT c, d, len(ks) AS last, CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS len, md5(array_to_string(ks[1:d], ',')) AS p, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ',')) END AS q FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM lists)),
nodes AS (SELECT d, p, min(q) AS q, min(c) AS c, count(*) AS n, (count(*) - 1) * min(len) AS saved, max(last) = d AS leaf, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last = d), '')) AS ends FROM steps GROUP BY d, p),
sums AS (SELECT s.d, s.p, CAST(sum(CAST(u.leaf AS INTEGER)) AS BIGINT) AS leaves, CAST(sum(u.saved) AS BIGINT) AS saved FROM nodes u JOIN steps s ON s.c = u.c AND s.d <= u.d GROUP BY s.d, s.p),
kids AS (SELECT d - 1 AS d, q AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, sums.saved AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN sums USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.p = nodes.q
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL, "op1_lm_scoring": _op1_sql(), "op2_html_text": OP2_SQL, "op6_suffix_dedup": OP6_SQL, "op5_license_scan": _op5_sql(), "op7_chat_format": OP7_SQL, "op9_quality_rules": _op9_sql()}
