"""The catalogue: operators applied to the supplied tables, each with the SQL that gives the same rows.

Customers stand for users, orders for agents and uploads, events for heartbeats, documents for file contents, labels for optional
attributes. Moments are fixed, so that results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.functions import predicates as P
from tidefold.functions import scalars as X
from tidefold.operators import paging, relational, stats, transitions, uploads
from tidefold.schemas import schema
from tidefold.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-02-01 00:00:00"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of a table reader, and its SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def as_users(customers: DataFrame) -> DataFrame:
    """Customers in the shape of users: the segment BUILDING are administrators, a negative balance disables."""
    return customers.select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("email"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"), (F.col("c_acctbal") < 0).alias("disabled"))


def as_agents(orders: DataFrame) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("int").alias("user_id"), F.col("o_orderpriority").alias("machine_name"), at.alias("created_at"),
        F.when(F.col("o_orderstatus") != "P", at).alias("last_seen_at"), F.when(F.col("o_orderstatus") == "F", at).alias("revoked_at"), F.col("o_orderstatus").alias("client_version"),
    )


def ntz(at: str | Column) -> Column:
    return P.col(at).cast("timestamp_ntz")


AGENTS_SQL = """agents AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS INTEGER) AS user_id, o_orderpriority AS machine_name, o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS last_seen_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS revoked_at, o_orderstatus AS client_version FROM orders)"""


# --- scans, projections, predicates -------------------------------------------------------------------------------


@registered("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def scan_project_filter(t):
    return t("customer").filter((F.col("c_acctbal") > 0) & P.in_domain("c_mktsegment", ("BUILDING",))).select("c_custkey", "c_name")


@registered("SELECT * FROM region")
def scan_all_columns(t):
    return t("region")


@registered("SELECT c_custkey FROM customer")
def scan_one_column(t):
    return t("customer").select("c_custkey")


@registered("SELECT * FROM orders WHERE o_orderkey = 42")
def point_lookup_pk(t):
    return t("orders").filter(P.key_is("o_orderkey", 42))


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def point_lookup_text_key(t):
    nations = t("nation")
    top = nations.agg(F.max("n_name").alias("top"))
    return nations.join(top, F.col("n_name") == F.col("top"), "left_semi").select("n_nationkey", "n_name")


@registered("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000042'")
def ci_lookup(t):
    return t("customer").filter(P.same_ignoring_case("c_name", "CUSTOMER#000000042")).select("c_custkey", "c_name")


@registered("SELECT c_custkey FROM customer WHERE sha256(c_name) = sha256('Customer#000000042')")
def hash_lookup(t):
    return t("customer").filter(P.secret_is(F.sha2("c_name", 256), "Customer#000000042")).select("c_custkey")


@registered(f"WITH {AGENTS_SQL} SELECT id, user_id FROM agents WHERE sha256(id) = sha256('42') AND revoked_at IS NULL")
def live_hash_lookup(t):
    return as_agents(t("orders")).filter(P.live_secret(F.sha2("id", 256), "42")).select("id", "user_id")


@registered("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND c_custkey <> 7")
def ci_conflict_excluding_self(t):
    return t("customer").filter(P.email_taken("c_mktsegment", "Building", "c_custkey", 7)).select("c_custkey")


@registered("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL AND d.n_chars > 500")
def pending(t):
    d = t("documents").select("doc_id", F.timestamp_seconds("n_chars").alias("expires_at"))
    used = t("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("used_at"))
    return d.join(used, F.col("doc_id") == F.col("id"), "left").filter(P.pending(F.timestamp_seconds(F.lit(500)))).select("doc_id")


@registered("SELECT user_id, max(ts) AS last_seen_at FROM events GROUP BY user_id HAVING max(ts) IS NOT NULL AND max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY")
def stale(t):
    seen = uploads.latest(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts").withColumnRenamed("ts", "last_seen_at")
    seen = seen.withColumn("revoked_at", F.lit(None).cast("timestamp"))
    return seen.filter(P.stale(AS_OF, 2)).select("user_id", ntz("last_seen_at").alias("last_seen_at"))


@registered("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal < 0")
def active_admins(t):
    return as_users(t("customer")).filter(P.active_admin()).select(F.col("id").cast("long").alias("c_custkey"), F.col("email").alias("c_name"))


@registered("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def owned_rows(t):
    return t("orders").filter(P.owned_by(7, "o_custkey")).select("o_orderkey")


@registered("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1997-01-01' AND NOT c_acctbal < 0")
def valid_sessions(t):
    s = as_agents(t("orders")).select("id", "user_id", "revoked_at", F.col("created_at").alias("expires_at"))
    u = as_users(t("customer")).withColumn("must_change_password", F.lit(False))
    return relational.session_with_user(s, u, P.not_revoked() & (F.col("expires_at") > P.moment("1997-01-01"))).filter(P.valid_session("1997-01-01")).select(F.col("id").cast("long").alias("o_orderkey"))


@registered("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def view_without_secrets(t):
    return t("customer").select("c_custkey", "c_name", "c_mktsegment")


@registered("SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '—') AS shown FROM documents d LEFT JOIN labels l USING (doc_id)")
def disp(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", X.shown("quality").alias("shown"))


@registered(f"WITH {AGENTS_SQL} SELECT id, CASE WHEN revoked_at IS NULL THEN 'active' ELSE 'revoked' END AS status FROM agents")
def status_flag(t):
    return as_agents(t("orders")).select("id", X.agent_status().alias("status"))


@registered("SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_totalprice < 0 THEN 'price' END], lambda x: x IS NOT NULL)[1] AS broken FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_totalprice < 0")
def domain_checks(t):
    return t("orders").filter(~P.in_domain("o_orderstatus", ("F", "O")) | (F.col("o_totalprice") < 0)).select("o_orderkey", F.when(~P.in_domain("o_orderstatus", ("F", "O")), "status").otherwise("price").alias("broken"))


# --- joins --------------------------------------------------------------------------------------------------------


@registered("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def inner_join_owner(t):
    return relational.with_owner(t("orders").filter("o_orderstatus = 'F'"), t("customer"), "o_custkey", "c_custkey", {"c_name": "c_name"}).select("o_orderkey", "c_name")


@registered("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def left_outer_owner(t):
    return relational.with_optional_owner(t("orders"), t("customer").filter("c_acctbal > 5000"), "o_custkey", "c_custkey", {"c_name": "c_name"}).select("o_orderkey", "c_name")


@registered("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_anti(t):
    return relational.without(t("orders"), "o_custkey", t("customer").filter("c_acctbal < 0"), "c_custkey").select("o_orderkey")


@registered("SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def orphan_count(t):
    return relational.orphans(t("orders"), "o_custkey", t("customer").filter("c_acctbal >= 0"), "c_custkey").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def set_null(t):
    return relational.nulled(t("orders"), "o_custkey", t("customer").filter("c_acctbal < 0"), "c_custkey").select("o_orderkey", "o_custkey")


@registered("SELECT l_orderkey, l_linenumber, o_orderpriority, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def device_attribution(t):
    ups = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("agent_registration_id"))
    made = relational.attributed(ups, as_agents(t("orders")), t("customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("email")))
    return made.select("l_orderkey", "l_linenumber", F.col("machine_name").alias("o_orderpriority"), F.col("user_email").alias("c_name"))


# --- aggregates, guards, pages -------------------------------------------------------------------------------------


@registered("SELECT count(*) AS total FROM orders")
def count_total(t):
    return paging.total(t("orders"))


@registered("SELECT count(*) AS total FROM orders WHERE o_custkey = 7")
def count_filtered(t):
    return paging.total(t("orders"), P.owned_by(7, "o_custkey"))


@registered("SELECT count(*) <= 1 AS refused FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal < 0")
def guard(t):
    return paging.total(as_users(t("customer")), P.active_admin()).select((F.col("total") <= 1).alias("refused"))


@registered("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0) AS found")
def exists_limit1(t):
    return relational.exists(t("customer"), F.col("c_acctbal") < 0)


@registered("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def page_pk(t):
    return paging.page(t("customer").select("c_custkey", "c_name"), "c_custkey", offset=100)


@registered("SELECT event_id, ts, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def page_recent(t):
    return paging.newest(t("events").filter(P.owned_by(7)).select("event_id", "ts", "event_type"), "ts", "event_id", 20, 20)


@registered("SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50")
def page_recent_joined(t):
    joined = relational.with_owner(t("orders"), t("customer"), "o_custkey", "c_custkey", {"c_name": "c_name"})
    return paging.newest(joined.select("o_orderkey", "o_orderdate", "c_name"), "o_orderdate", "o_orderkey", 50, 50)


@registered("SELECT d.doc_id, d.n_chars, quality FROM documents d LEFT JOIN labels USING (doc_id) ORDER BY n_chars DESC, doc_id DESC LIMIT 50 OFFSET 50")
def page_optional_joined(t):
    joined = relational.with_optional_owner(t("documents"), t("labels"), "doc_id", "doc_id", {"quality": "quality"})
    return paging.page(joined.select("doc_id", "n_chars", "quality"), F.desc("n_chars"), F.desc("doc_id"), limit=50, offset=50)


@registered("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id DESC LIMIT 50 OFFSET 550")
def page_nulls_first(t):
    joined = relational.with_optional_owner(t("documents"), t("labels"), "doc_id", "doc_id", {"quality": "quality"})
    return paging.newest(joined.select("doc_id", "quality"), "quality", "doc_id", 50, 550)


@registered("""WITH t AS (SELECT count(*) AS total FROM orders), p AS (SELECT total, greatest(0, least(50, total - 100)) AS n FROM t)
SELECT total, 3 AS page, CAST(CASE WHEN n > 0 THEN 101 ELSE 0 END AS BIGINT) AS first_index, CASE WHEN n > 0 THEN 100 + n ELSE 0 END AS last_index, n > 0 AS has_prev,
  n > 0 AND total > 100 + n AS has_next, total || CASE WHEN total = 1 THEN ' order' ELSE ' orders' END AS label FROM p""")
def page_meta(t):
    return paging.page_info(paging.total(t("orders")), 3, noun="order")


# --- content, heartbeats, ownership --------------------------------------------------------------------------------


@registered("SELECT doc_id, sha256 FROM (SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def content_dedup(t):
    return uploads.first_of_content(t("documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "sha256")


@registered("SELECT event_id, sha256 FROM (SELECT event_id, sha256(props) AS sha256, row_number() OVER (PARTITION BY sha256(props) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first_write(t):
    return uploads.first_of_content(t("events").select("event_id", "ts", "props"), "props", "ts", "event_id").select("event_id", "sha256")


@registered("SELECT event_id, row_number() OVER (PARTITION BY sha256(props) ORDER BY ts, event_id) > 1 AS deduped FROM events")
def dedup_flag(t):
    return uploads.marked_repeats(t("events").select("event_id", "ts", "props"), "props", "ts", "event_id").select("event_id", "deduped")


@registered("SELECT sha256(props) AS sha256, count(*) AS uploads, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def attribution_counts(t):
    return uploads.attribution_counts(t("events").select(X.sha256_hex("props").alias("sha256"), "user_id"))


@registered("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_heartbeat(t):
    return uploads.latest(t("events"), "user_id", "ts")


@registered("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def lww(t):
    return uploads.latest(t("events"), "user_id", "ts", "event_type")


@registered(f"""WITH {AGENTS_SQL}, beats AS (SELECT CAST(event_id AS VARCHAR) AS agent_id, max(ts) AS beat_at, arg_max(event_type, ts) AS v FROM events GROUP BY 1)
SELECT id, CASE WHEN agent_id IS NOT NULL AND revoked_at IS NULL THEN greatest(coalesce(last_seen_at, beat_at), beat_at) ELSE last_seen_at END AS last_seen_at,
  CASE WHEN agent_id IS NOT NULL AND revoked_at IS NULL THEN v ELSE client_version END AS client_version FROM agents LEFT JOIN beats ON id = agent_id""")
def heartbeats_applied(t):
    beats = t("events").select(F.col("event_id").cast("string").alias("agent_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("client_version"))
    new = transitions.heartbeat(as_agents(t("orders")), beats).tables["agents"]
    return new.select("id", ntz("last_seen_at").alias("last_seen_at"), "client_version")


#: The user with the least address takes over.
TARGET_SQL = "SELECT CAST(arg_min(c_custkey, c_name) AS INTEGER) FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _reassigned(t):
    users = as_users(t("customer"))
    target = users.filter("role = 'user'").agg(F.min("email")).first()[0]
    return transitions.reassign_agents(users, as_agents(t("orders")), users.sparkSession.createDataFrame([], schema("reassignment_log")), target.upper(), AS_OF)


@registered(f"WITH {AGENTS_SQL} SELECT id, CASE WHEN c_mktsegment = 'BUILDING' THEN ({TARGET_SQL}) ELSE user_id END AS user_id FROM agents JOIN customer ON user_id = c_custkey")
def reassign(t):
    return _reassigned(t).tables["agents"].select("id", "user_id")


@registered(f"""SELECT CAST(row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS id, CAST(o_orderkey AS VARCHAR) AS agent_id, CAST(o_custkey AS INTEGER) AS prior_user_id, ({TARGET_SQL}) AS new_user_id
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def reassign_log(t):
    return _reassigned(t).tables["reassignment_log"].select("id", "agent_id", "prior_user_id", "new_user_id")


@registered(f"WITH {AGENTS_SQL} SELECT id, CASE WHEN revoked_at IS NULL AND last_seen_at < TIMESTAMP '1997-01-01' - INTERVAL 90 DAY THEN TIMESTAMP '1997-01-01' ELSE revoked_at END AS revoked_at FROM agents")
def stale_revoked(t):
    return transitions.revoke_stale(as_agents(t("orders")), "1997-01-01").tables["agents"].select("id", ntz("revoked_at").alias("revoked_at"))


@registered("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT 0, 'new'")
def insert_or_update(t):
    customers = t("customer").select("c_custkey", "c_mktsegment")
    new = customers.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment")).union(customers.sparkSession.range(1).select("id", F.lit("new")))
    return transitions.insert_or_update(customers, new, "c_custkey")


@registered("SELECT sha256(text) AS sha256, bool_and(doc_id % 2 = 1) AS inserted FROM documents GROUP BY 1 HAVING bool_or(doc_id % 2 = 1)")
def insert_or_ignore(t):
    docs = t("documents").select(X.sha256_hex("text").alias("sha256"), "doc_id")
    had = docs.filter("doc_id % 2 = 0").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return transitions.insert_or_ignore(had, docs.filter("doc_id % 2 = 1"), "sha256", "doc_id").outcomes


# --- scalars --------------------------------------------------------------------------------------------------------


@registered("SELECT doc_id, substr(s, 1, 2) || '/' || substr(s, 3, 2) || '/' || s || '.dat' AS path FROM (SELECT doc_id, sha256(text) AS s FROM documents)")
def shard_path(t):
    return t("documents").select("doc_id", X.shard_path(X.sha256_hex("text"), ".dat").alias("path"))


@registered("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '.dat' WHEN 1 THEN '.xml' ELSE
  coalesce(nullif(regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '^\\.*[^.].*(\\.[^.]+)$', 1), ''), '.bin') END AS ext FROM pages""")
def ext_case(t):
    kind = F.element_at(F.array(*map(F.lit, ("match-log", "decklist", "unknown"))), (F.col("page_id") % 3 + 1).cast("int"))
    return t("pages").select("page_id", X.file_extension(kind, "url").alias("ext"))


@registered("SELECT page_id, trim(split_part(split_part(url, '//', 2), '/', 1)) AS ip FROM pages")
def xff(t):
    host = F.split_part("url", F.lit("//"), F.lit(2))
    chain = F.concat(F.lit(" "), F.split_part(host, F.lit("/"), F.lit(1)), F.lit(" , 10.0.0.1"))
    return t("pages").select("page_id", X.client_ip(chain, F.lit("peer")).alias("ip"))


@registered("""SELECT event_id, CASE WHEN h < 24 THEN h || 'h' ELSE CAST(floor(h / 24) AS BIGINT) || 'd' END AS age
FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000.0) AS BIGINT) AS h FROM events)""")
def age_bucket(t):
    return t("events").select("event_id", X.age("ts", AS_OF).alias("age"))


@registered("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_fmt(t):
    return t("events").select("event_id", X.minute("ts").alias("shown"), X.day("ts").alias("day"))


@registered("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events")
def iso_fmt(t):
    return t("events").select("event_id", X.iso_format("ts").alias("iso"))


@registered("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS ts FROM events")
def iso_lenient(t):
    text = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(*map(F.lit, ("", "soon", "2024-13-45"))), (F.floor(F.col("event_id") / 3) % 3 + 1).cast("int"))).otherwise(F.regexp_replace(X.iso_format("ts"), r"\+00:00", "Z"))
    return t("events").select("event_id", ntz(X.parse_iso(text)).alias("ts"))


@registered("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@registered("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'open' ELSE 'invite_only' END AS mode FROM events")
def json_default(t):
    value = F.when(F.col("event_id") % 3 == 0, F.lit('"open"')).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("not json")
    return t("events").select("event_id", X.registration_mode(value).alias("mode"))


@registered("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS payload FROM events")
def json_encode(t):
    return t("events").select("event_id", X.event_json("event_id", "event_type").alias("payload"))


@registered("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS size_bytes FROM documents")
def size_bytes(t):
    return t("documents").select("doc_id", F.octet_length("text").alias("size_bytes"))


@registered("SELECT doc_id, greatest(1, CAST(ceil(strlen(text) / 1000.0) AS INTEGER)) AS chunks, strlen(text) AS bytes FROM documents WHERE strlen(text) > 0")
def blob_chunks(t):
    from tidefold.sources.blobs import chunks

    files = t("documents").select(F.col("doc_id").alias("sha256"), F.col("text").cast("binary").alias("content"))
    return chunks(files, 1000).groupBy(F.col("sha256").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.sum(F.octet_length("chunk")).alias("bytes"))


@registered("SELECT event_id, event_type || event_id AS token FROM events WHERE event_id % 3 = 0")
def bearer(t):
    own = F.concat("event_type", F.col("event_id").cast("string"))
    header = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("BeArEr  "), own, F.lit(" \t"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Basic "), own)).otherwise("Bearer  ")
    return t("events").select("event_id", X.bearer_token(header).alias("token")).filter("token IS NOT NULL")


# --- statistics (an extension) --------------------------------------------------------------------------------------


@registered("SELECT c_mktsegment AS segment, count(*) AS games, CAST(count_if(o_totalprice > 150000) AS BIGINT) AS wins, CAST(count_if(o_totalprice IS NULL) AS BIGINT) AS undecided, avg(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS win_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def win_seg(t):
    joined = relational.with_owner(t("orders"), t("customer"), "o_custkey", "c_custkey", {"c_mktsegment": "segment"})
    return stats.rates(joined, F.col("o_totalprice") > 150000, "segment")


@registered("SELECT event_type, count(*) AS games, CAST(count_if(value > 50) AS BIGINT) AS wins, CAST(count_if(value IS NULL) AS BIGINT) AS undecided, avg(CASE WHEN value > 50 THEN 1 WHEN value <= 50 THEN 0 END) AS win_rate FROM events GROUP BY 1")
def rate_by_type(t):
    return stats.rates(t("events"), F.col("value") > 50, "event_type")


@registered("SELECT c_name AS user_email, o_orderpriority AS machine_name, count(*) AS uploads, count(DISTINCT l_partkey) AS files, max(l_shipdate) AS last_upload FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def device_counts(t):
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    shaped = lines.select(F.col("c_name").alias("user_email"), F.col("o_orderpriority").alias("machine_name"), F.col("l_partkey").alias("sha256"), F.col("l_shipdate").alias("uploaded_at"))
    return stats.device_counts(shaped)


@registered("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def tumbling(t):
    at = F.col("ts").cast("timestamp")
    return t("events").groupBy(F.window(at, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(ntz("w.start").alias("hour"), "n")


@registered("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events")
def user_history(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("n"), (F.col("value") - F.lag("value").over(w)).alias("change"))


# --- state changes over the supplied tables --------------------------------------------------------------------------


def as_sessions(orders: DataFrame) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("int").alias("user_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("refresh_token_hash"), at.alias("issued_at"),
        X.after(at, days=30).alias("expires_at"), F.when(F.col("o_orderstatus") == "F", at).alias("revoked_at"), F.lit(None).cast("string").alias("user_agent"), F.lit(None).cast("string").alias("ip"),
    )


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey <> 7")
def delete_user_cascade(t):
    tables = {"users": as_users(t("customer")), "agents": as_agents(t("orders"))}
    return transitions.delete_user(tables, 1, 7).tables["agents"].select("id")


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_custkey = 7 THEN TIMESTAMP '2024-02-01' END AS revoked_at FROM orders")
def revoke_sessions_of_user(t):
    done = transitions.revoke_sessions(as_users(t("customer")), as_sessions(t("orders")), 7, AS_OF)
    return done.tables["sessions"].select("id", ntz("revoked_at").alias("revoked_at"))


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderkey % 10 = 0 THEN TIMESTAMP '2024-02-01' END AS revoked_at FROM orders")
def logout_many(t):
    s = as_sessions(t("orders"))
    done = transitions.logout(s, s.filter("CAST(id AS long) % 10 = 0").select("id"), AS_OF)
    return done.tables["sessions"].select("id", ntz("revoked_at").alias("revoked_at"))


@registered("SELECT c_custkey AS seq, CASE WHEN c_acctbal < 0 OR c_custkey % 5 = 0 THEN 'invalid_credentials' ELSE 'ok' END AS code FROM customer")
def login_outcomes(t):
    tries = t("customer").select(F.col("c_custkey").alias("seq"), F.upper("c_name").alias("email"), (F.col("c_custkey") % 5 != 0).alias("verified"), F.lit("s").alias("session_id"), F.lit("h").alias("refresh_token_hash"), F.lit(None).cast("string").alias("user_agent"), F.lit(None).cast("string").alias("ip"))
    return transitions.login(as_users(t("customer")), as_sessions(t("orders")), tries, AS_OF).outcomes


@registered("""SELECT n * 100000000 + o_orderkey AS seq, CASE WHEN n = 0 AND o_orderstatus <> 'F' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01' AND NOT c_acctbal < 0 THEN 'ok' ELSE 'invalid_credentials' END AS code
FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES (0), (1)) v(n)""")
def rotate_outcomes(t):
    s = as_sessions(t("orders"))
    twice = s.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "id", F.col("refresh_token_hash").alias("old_hash"), "user_agent", "ip")
    asks = twice.select((F.col("n") * 100000000 + F.col("id").cast("long")).alias("seq"), "old_hash", F.lit("new").alias("new_hash"), F.lit("s").alias("session_id"), "user_agent", "ip")
    return transitions.rotate(as_users(t("customer")), s, asks, "1997-01-01").outcomes


@registered("SELECT doc_id AS seq, 'ok' AS code, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS deduped, row_number() OVER (ORDER BY doc_id) AS upload_id FROM documents")
def upload_batch(t):
    docs = t("documents")
    spark = docs.sparkSession
    empty = [spark.createDataFrame([], schema(n)) for n in ("files", "uploads")]
    batch = docs.select(F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("content"), F.lit("unknown").alias("content_type"), F.lit("a.txt").alias("original_filename"), F.lit(1).alias("user_id"), F.lit("a").alias("agent_registration_id"), P.moment(AS_OF).alias("uploaded_at"))
    return uploads.upload(*empty, batch).outcomes


@registered("SELECT c_custkey AS seq, CASE WHEN c_custkey % 7 = 0 THEN 'weak_password' WHEN row_number() OVER (PARTITION BY c_mktsegment, c_nationkey, c_custkey % 7 = 0 ORDER BY c_custkey) = 1 THEN 'ok' ELSE 'email_already_taken' END AS code FROM customer")
def register_outcomes(t):
    c = t("customer")
    spark = c.sparkSession
    settings = spark.range(1).select(F.lit("registration_mode").alias("key"), F.lit('"open"').alias("value"), P.moment(AS_OF).alias("updated_at"), F.lit(None).cast("int").alias("updated_by_user_id"))
    users, invites = (spark.createDataFrame([], schema(n)) for n in ("users", "invites"))
    asks = c.select(F.col("c_custkey").alias("seq"), F.concat_ws("@", F.initcap("c_mktsegment"), "c_nationkey").alias("email"), F.when(F.col("c_custkey") % 7 == 0, 3).otherwise(20).alias("password_length"), F.lit("h").alias("password_hash"), F.lit(None).cast("string").alias("token"))
    return transitions.register(users, invites, settings, asks, AS_OF).outcomes


@registered(f"WITH {AGENTS_SQL} SELECT id, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN ({TARGET_SQL}) ELSE user_id END AS user_id FROM agents JOIN customer ON user_id = c_custkey")
def reassign_and_undo(t):
    """Agents of administrators who are gone by then stay with the user who took over."""
    users = as_users(t("customer")).filter("role <> 'admin' OR id % 2 = 1")
    moved = _reassigned(t).tables
    return transitions.undo_reassignment(users, moved["agents"], moved["reassignment_log"]).tables["agents"].select("id", "user_id")
