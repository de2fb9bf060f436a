"""Queries over stores and streams of several micro-batches: tables that change together, contents known by hash, two topics that meet, machines that fall silent,
counts taken in passing, and cuts by several dimensions at once. Each has its SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions import predicates as P
from tidefold.functions import scalars as X
from tidefold.operators import stats, transitions
from tidefold.plans.catalogue import AS_OF, as_agents, as_sessions, ntz, oracle_sql, queries, registered
from tidefold.plans.changes import AGENTS_SQL, INVITES_SQL, USERS_SQL, _empty, _invites, _users
from tidefold.schemas import schema
from tidefold.session import scratch

#: All queries that are registered, those of the other modules too.
__all__ = ["oracle_sql", "queries"]


#: Files of a micro-batch: it is written, and read, by so many tasks at most, and its files by row groups.
FILES = 8


def staged(df: DataFrame, bucket: Column, root: str) -> DataFrame:
    """``df`` as a stream that gives one micro-batch for each value of ``bucket``, in their order: FILES files each, dated one second after the other. A bucket that has fewer gets empty ones."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    parts = df.withColumn("bucket", bucket.cast("int")).repartition("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(FILES)))
    parts.write.option("parquet.block.size", 16 << 20).partitionBy("bucket").parquet(root)
    where = jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = where.getFileSystem(conf)
    kind = spark.read.parquet(root).schema
    spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{root}-none")
    none = next(x.getPath() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}-none")) if x.getPath().getName().endswith(".parquet"))
    for folder in fs.listStatus(where):  # one for each micro-batch
        name = folder.getPath().getName()
        if name.startswith("bucket="):
            there = len(fs.listStatus(folder.getPath()))
            for k in range(there, FILES):
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, none, fs, jvm.org.apache.hadoop.fs.Path(folder.getPath(), f"none-{k}.parquet"), False, conf)
            for file in fs.listStatus(folder.getPath()):
                fs.setTimes(file.getPath(), 1_700_000_000_000 + 1000 * int(name[7:]), -1)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", FILES).parquet(root)


def ran(stream: DataFrame, root: str) -> DataFrame:
    """What a stream appended from its first micro-batch to its last."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


# --- tables that change together -----------------------------------------------------------------------------------------


@registered(f"""WITH {INVITES_SQL}, {USERS_SQL}, base AS (SELECT max(id) AS top FROM users WHERE id < 100),
tries AS (SELECT c_custkey, c_name, c_custkey % 2 AS writer, c_custkey % 120 AS doc FROM customer WHERE c_custkey >= 100),
won AS (SELECT * FROM tries JOIN invites ON doc_id = doc WHERE used_at IS NULL AND expires_at > TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY writer, c_custkey) = 1)
SELECT token_hash, CAST(top + row_number() OVER (ORDER BY writer, c_custkey) AS INTEGER) AS user_id, lower(c_name) AS email, 'invites, users' AS refused FROM won, base""")
def registrations_committed(t):
    """Two writers register from one snapshot, each a change of users and invites together. The second is refused whole, works on what the first left, and is entered then."""
    from tidefold.sources.snapshots import Conflict, Store

    invites, users, customers = _invites(t("labels")), _users(t("customer").filter("c_custkey < 100")), t("customer")
    store = Store(users.sparkSession, scratch(users.sparkSession, "store"))
    settings = transitions.seed_setting(_empty(users.sparkSession, "settings"), AS_OF).tables["table"]
    store.change(store.snapshot(), {"users": users, "invites": invites, "settings": settings})
    key = F.col("c_custkey")
    asks = customers.select(key.alias("seq"), F.lower("c_name").alias("email"), F.lit(20).alias("password_length"), F.lit("h").alias("password_hash"), F.concat(F.lit("t"), (key % 120).cast("string")).alias("token"))
    work = [lambda s, k=k: transitions.register(s.read("users"), s.read("invites"), s.read("settings"), asks.filter(F.col("seq") % 2 == k), AS_OF).tables for k in (0, 1)]
    one, two = store.snapshot(), store.snapshot()
    made = [work[0](one), work[1](two)]
    store.change(one, made[0])
    try:
        store.change(two, made[1])
        refused = "none"
    except Conflict as e:
        refused = str(e)
        store.attempt(work[1])
    after = store.snapshot()
    owner = after.read("users").select(F.col("id").alias("user_id"), "email")
    return after.read("invites").join(owner, F.col("used_by_user_id") == F.col("user_id")).select("token_hash", "user_id", "email", F.lit(refused).alias("refused"))


# --- contents known by hash ------------------------------------------------------------------------------------------------


@registered("""WITH d AS (SELECT doc_id, doc_id % 20 AS batch, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL),
f AS (SELECT sha256, min(batch) AS batch, count(*) AS uploads FROM d GROUP BY 1)
SELECT f.sha256, CAST(f.batch AS INTEGER) AS batch, CAST(min(d.doc_id) AS INTEGER) AS user_id, uploads FROM f JOIN d ON d.sha256 = f.sha256 AND d.batch = f.batch GROUP BY ALL""")
def contents_announced(t):
    """The documents as uploads in twenty micro-batches: each content is announced by the first that brings it, and later ones find it through the index by hash."""
    from tidefold.sources.versions import read_batches
    from tidefold.streaming.uploads import EACH, ingest_stream

    docs = t("documents")
    spark = docs.sparkSession
    root = scratch(spark, "contents")
    rows = docs.select(
        F.col("doc_id").cast("int").alias("seq"), F.col("text").cast("binary").alias("content"), F.lit("unknown").alias("content_type"), F.lit("a.txt").alias("original_filename"), F.col("doc_id").cast("int").alias("user_id"),
        F.lit("a").alias("agent_registration_id"), P.moment(AS_OF).alias("uploaded_at"),
    )
    stream = staged(rows, F.col("seq") % 20, f"{root}/in").drop("bucket")
    ingest_stream(stream, f"{root}/tables", f"{root}/checkpoint", f"{root}/events").awaitTermination()
    said = spark.read.schema("topic string, sha256 string, payload string, batch int").json(f"{root}/events")
    first = said.select("sha256", "batch", F.from_json("payload", schema("file.ingested"))["user_id"].alias("user_id"))
    uploads = read_batches(spark, f"{root}/tables", "uploads")
    # an upload's number tells its micro-batch: none may be older than the announcement
    many = uploads.groupBy("sha256").agg(F.count(F.lit(1)).alias("uploads"), F.min(F.expr(f"id div {EACH}")).alias("since"))
    return first.join(many, "sha256").filter(F.col("since") == F.col("batch")).select("sha256", "batch", "user_id", "uploads")


# --- topics ------------------------------------------------------------------------------------------------------------------


def _days(ts: Column) -> Column:
    """Five days a micro-batch."""
    return F.floor((F.dayofmonth(ts) - 1) / 5)


#: A message long after all others: the moment up to which everything is certain.
END = "2034-01-01 00:00:00"


@registered("""SELECT CAST(c.event_id AS VARCHAR) AS request_id, CAST(c.user_id AS VARCHAR) AS match_id, CAST(v.event_id AS INTEGER) AS game_count, v.ts AS parsed_at FROM (SELECT * FROM events WHERE event_type IN ('click', 'error')) c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.event_type = 'click' AND c.user_id = v.user_id AND v.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 6 HOUR""")
def insights_matched(t):
    """Requests and parsed matches as two streams over several micro-batches: clicks ask for views of the same user within six hours; errors ask for a match that nobody parses."""
    from tidefold.streaming import topics

    events = t("events").filter("event_type IN ('view', 'click', 'error')").withColumn("at", F.col("ts").cast("timestamp"))
    spark = events.sparkSession
    root = scratch(spark, "topics")
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    parsed = F.to_json(F.struct(user.alias("match_id"), user.alias("user_id"), event.cast("int").alias("game_count"), X.iso_format("at").alias("parsed_at")))
    asked = F.to_json(F.struct(F.when(F.col("event_type") == "error", F.concat(F.lit("-"), user)).otherwise(user).alias("match_id"), user.alias("user_id"), event.cast("string").alias("request_id")))
    messages = events.select(F.when(F.col("event_type") == "view", "match.parsed").otherwise("insight.requested").alias("topic"), F.when(F.col("event_type") == "view", parsed).otherwise(asked).alias("value"), "at")
    last = spark.createDataFrame([("match.parsed", '{"match_id": "end", "parsed_at": "2034-01-01T00:00:00+00:00"}'), ("insight.requested", '{"request_id": "end"}')], "topic string, value string").withColumn("at", P.moment(END))
    stream = staged(messages.unionByName(last), F.when(F.col("at") == P.moment(END), 9).otherwise(_days(F.col("at"))), f"{root}/in")
    made = ran(topics.insights(topics.requests_of(stream), topics.matches_of(stream), "6 hours"), root)
    return made.filter("request_id <> 'end'").select("request_id", F.regexp_replace("match_id", "^-", "").alias("match_id"), "game_count", ntz("parsed_at").alias("parsed_at"))


@registered("""SELECT CAST(user_id AS VARCHAR) AS agent_id, ts AS last_seen_at, ts + INTERVAL 24 HOUR AS silent_since FROM (SELECT DISTINCT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events)
WHERE next IS NULL OR next > ts + INTERVAL 24 HOUR""")
def silent_machines(t):
    """Every event a sign of life, in several micro-batches: a machine that says nothing for a day is reported by its timer."""
    from tidefold.streaming import codes, silence

    events = t("events")
    spark = events.sparkSession
    root = scratch(spark, "silence")
    beats = events.select(F.col("user_id").cast("string").alias("agent_id"), F.col("ts").cast("timestamp").alias("at"))
    last = spark.createDataFrame([("end",)], "agent_id string").withColumn("at", P.moment(END))
    codes.use_rocksdb(spark)
    stream = staged(beats.unionByName(last), F.when(F.col("at") == P.moment(END), 9).otherwise(_days(F.col("at"))), f"{root}/in")
    made = ran(silence.silences(stream, 86_400), root)
    return made.select("agent_id", ntz("last_seen_at").alias("last_seen_at"), ntz("silent_since").alias("silent_since"))


# --- counts and cuts -----------------------------------------------------------------------------------------------------------


@registered(f"""WITH {USERS_SQL}, {AGENTS_SQL} SELECT * FROM (SELECT 'sessions revoked' AS what, count(*) AS n FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'
UNION ALL SELECT 'stale agents revoked', count(*) FROM agents WHERE revoked_at IS NULL AND last_seen_at < TIMESTAMP '1996-10-03' UNION ALL SELECT 'agents reassigned', count(*) FROM agents JOIN users ON users.id = user_id WHERE role = 'admin')""")
def counts_in_passing(t):
    """Commands that report how many rows they changed: the tables are written, and the counts come from the passes that wrote them."""
    from tidefold.sources.snapshots import Store

    users, sessions = _users(t("customer")), as_sessions(t("orders"))
    agents = as_agents(t("orders")).withColumn("api_token_hash", F.sha2("id", 256))
    spark = users.sparkSession
    store = Store(spark, scratch(spark, "counts"))
    done = {"sessions revoked": transitions.revoke_sessions(users, sessions, 7, AS_OF), "stale agents revoked": transitions.revoke_stale(agents, "1997-01-01", 90)}
    admins = users.withColumn("email", F.lower("email"))
    target = admins.filter("role = 'user'").agg(F.min("email")).first()[0]
    done["agents reassigned"] = transitions.reassign_agents(admins, agents, _empty(spark, "reassignment_log"), target, AS_OF)
    for change in done.values():
        store.change(store.snapshot(), change.tables)
    return spark.createDataFrame([(what, change.count) for what, change in done.items()], "what string, n long")


_CUTS = [("since", "event_type"), ("since", "format"), ("archetype_played", "archetype_faced"), ("opponent",), ("format", "event_type"), ("since",), ()]


@registered(f"""WITH m AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS since, user_id, 'a' || user_id % 5 AS archetype_played, 'f' || event_id % 4 AS archetype_faced, CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS format, event_type,
  'o' || user_id % 7 AS opponent, CASE WHEN event_id % 11 > 0 THEN value > 50 END AS won FROM events)
SELECT CAST(since AS TIMESTAMP) AS since, archetype_played, archetype_faced, CAST(format AS VARCHAR) AS format, event_type, opponent,
  concat_ws(',', {", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in ("since", "archetype_played", "archetype_faced", "format", "event_type", "opponent"))}) AS cut,
  count(*) AS games, CAST(count_if(won) AS BIGINT) AS wins, CAST(count_if(won IS NULL) AS BIGINT) AS undecided, avg(CAST(won AS INTEGER)) AS win_rate
FROM m GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in _CUTS)})""")
def win_cuts(t):
    """All cuts of the win rate, by weeks and five dimensions, from one shuffle."""
    user, event = F.col("user_id"), F.col("event_id")
    matches = t("events").select(
        user, F.concat(F.lit("a"), user % 5).alias("archetype_played"), F.concat(F.lit("f"), event % 4).alias("archetype_faced"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("format"), "event_type",
        F.concat(F.lit("o"), user % 7).alias("opponent"), F.col("ts").cast("timestamp").alias("played_at"), F.when(event % 11 > 0, F.col("value") > 50).alias("won"),
    )
    return stats.cuts(matches, _CUTS, "7 days").withColumn("since", ntz("since"))


# --- codes and files as streams ----------------------------------------------------------------------------------------------------


@registered("""WITH c AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 3 = 0 THEN 'consume' ELSE 'mint' END AS kind, CAST(user_id AS INTEGER) AS user_id, 'c' || CAST(floor(event_id / 903) AS BIGINT) * 301 + event_id % 301 AS code FROM events),
w AS (SELECT *, lag(kind) OVER o AS before, lag(ts) OVER o AS since, lag(user_id) OVER o AS owner FROM c WINDOW o AS (PARTITION BY code ORDER BY seq))
SELECT code, seq, CASE WHEN before = 'mint' AND since + INTERVAL 24 HOUR > ts THEN owner END AS user_id FROM w WHERE kind = 'consume'""")
def codes_consumed(t):
    """Codes minted and consumed by the events as a stream of several micro-batches with a watermark of one day: codes live from one micro-batch to the next, and go by their timer if nobody consumes them. A consume
    wins if the command for its code before it was a mint that still holds."""
    from tidefold.streaming import codes

    events = t("events")
    spark = events.sparkSession
    root = scratch(spark, "codes")
    code = F.concat(F.lit("c"), (F.floor(F.col("event_id") / 903) * 301 + F.col("event_id") % 301).cast("string"))
    kind = F.when(F.col("event_id") % 3 == 0, "consume").otherwise("mint")
    commands = events.select(code.alias("code"), kind.alias("kind"), F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    codes.use_rocksdb(spark)
    stream = staged(commands, _days(F.col("at")), f"{root}/in")
    return ran(codes.consumed(stream, 24 * 3600), root)


@registered("SELECT DISTINCT sha256(text) AS sha256, md5(text) AS body FROM documents WHERE text <> ''")
def archive_streamed(t):
    """Texts as files of the raw archive, which a stream takes up: every file comes once, whole, under the hash in its name."""
    from tidefold.sources import blobs
    from tidefold.streaming import codes
    from tidefold.streaming.uploads import archive_stream

    docs = t("documents").filter("text <> ''").select(F.col("text").cast("binary").alias("content")).distinct()
    spark = docs.sparkSession
    root = scratch(spark, "raw")
    files = docs.select(X.shard_path(X.sha256_hex("content"), ".dat").alias("path"), "content")
    blobs.store(files, f"{root}/raw").write.format("noop").mode("overwrite").save()
    codes.use_rocksdb(spark)
    made = ran(archive_stream(spark, f"{root}/raw").select("path", "sha256", F.md5("content").alias("body")), root)
    return made.filter(F.col("path").contains(F.col("sha256"))).select("sha256", "body")


# --- layouts, listings, aggregates that are kept ---------------------------------------------------------------------------------------


@registered("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderkey = 42")
def token_lookup(t):
    """F6 over a table in buckets of the hash: the lookup opens one of them."""
    from tidefold.sources.layouts import write_keyed

    orders = t("orders")
    agents = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.sha2(F.concat(F.lit("token"), F.col("o_orderkey").cast("string")), 256).alias("api_token_hash"))
    table = write_keyed(agents, scratch(orders.sparkSession, "agents"), "api_token_hash", 16)
    return table.filter(P.secret_is("api_token_hash", "token42")).select("id", "user_id")


@registered("""SELECT o_orderkey AS id, o_custkey AS user_id, c_acctbal < 0 AS disabled FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""")
def sessions_of_users(t):
    """J1 over two tables in buckets of the user: no exchange."""
    from tidefold.sources.layouts import write_keyed

    orders, customers = t("orders"), t("customer")
    sessions = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("revoked_at"))
    users = customers.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("disabled"))
    s, u = (write_keyed(df, scratch(orders.sparkSession, name), "user_id", 16) for df, name in ((sessions, "sessions"), (users, "users")))
    return s.filter(P.not_revoked()).join(u.hint("merge"), "user_id").select("id", "user_id", "disabled")


@registered("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 1200")
def page_from_ranges(t):
    """A page far behind, newest first, from a layout by ranges: it opens the files that hold it, and knows the total without a count."""
    from tidefold.sources.layouts import write_ranged

    orders = t("orders").select("o_orderkey", "o_orderdate")
    laid = write_ranged(orders, scratch(orders.sparkSession, "pages"), [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").asc()], 24)
    return laid.page(40, 1200).withColumn("total", F.lit(laid.total))


@registered("""SELECT c_custkey AS id, c_name AS email, c_acctbal < 0 AS disabled, TIMESTAMP '2024-05-01 12:00:00' AS created_at, 'all' AS asked FROM customer
UNION ALL SELECT c_custkey, c_name, c_acctbal < 0, TIMESTAMP '2024-05-01 12:00:00', 'some' FROM customer WHERE c_custkey BETWEEN 100 AND 119""")
def listing_pages(t):
    """The customers as stored pages of a listing: all of them through the source as a stream, some through it in batch, with the key's bounds pushed down to pages."""
    from tidefold.sources import paged

    customers = t("customer")
    spark = customers.sparkSession
    root = scratch(spark, "listing")
    paged.register(spark)
    items = customers.select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("email"), F.lit("user").alias("role"), (F.col("c_acctbal") < 0).alias("disabled"), F.lit(False).alias("must_change_password"),
        F.lit("2024-05-01T14:00:00+02:00").alias("created_at"), F.floor(F.col("c_custkey") / 50).alias("page"),
    )
    paged.write_pages(items, "users", f"{root}/pages", "page")
    of = lambda read: read.format("listing").option("path", f"{root}/pages").option("listing", "users").load()
    every = ran(of(spark.readStream), root).withColumn("asked", F.lit("all"))
    some = of(spark.read).filter("id >= 100 AND id < 120").withColumn("asked", F.lit("some"))
    return every.union(some).select(F.col("id").cast("long").alias("id"), "email", "disabled", ntz("created_at").alias("created_at"), "asked")


@registered("""SELECT c_name AS user_email, o_orderpriority AS machine_name, count(*) AS uploads, count(DISTINCT l_partkey) AS files, max(l_shipdate) AS last_upload, true AS close FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def devices_kept(t):
    """A6 kept up over seven batches, one of which runs twice: counts from partial aggregates, contents from the exact table, and whether the merged sketch is within a tenth, or one, of that."""
    from tidefold.operators.kept import Devices
    from tidefold.sources.snapshots import Store

    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    shaped = lines.select("l_linenumber", F.col("c_name").alias("user_email"), F.col("o_orderpriority").alias("machine_name"), F.col("l_partkey").cast("string").alias("sha256"), F.col("l_shipdate").cast("timestamp").alias("uploaded_at"))
    spark = lines.sparkSession
    kept = Devices(Store(spark, scratch(spark, "devices")))
    # the tables meet once, and not twice for each batch
    root = scratch(spark, "batches")
    shaped.write.partitionBy("l_linenumber").parquet(root)
    batches = spark.read.parquet(root)
    for number in (1, 2, 3, 3, 4, 5, 6, 7):
        kept.add(batches.filter(F.col("l_linenumber") == number).drop("l_linenumber"), number)
    told = kept.estimates().select("user_email", "machine_name", F.col("files").alias("told"))
    near = F.abs(F.col("told") - F.col("files")) <= F.greatest(F.lit(1), F.col("files") / 10)
    return kept.exact().join(told, ["user_email", "machine_name"]).select("user_email", "machine_name", "uploads", "files", ntz("last_upload").alias("last_upload"), near.alias("close"))
