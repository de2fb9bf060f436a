"""State changes over the supplied tables: every query calls the operator and returns the tables or codes that it gives; each has its SQL.

Customers stand for users, orders for agents and sessions, labels for invitations, events for uploads and commands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions import predicates as P
from tidefold.functions import scalars as X
from tidefold.operators import paging, relational, transitions, uploads
from tidefold.plans.catalogue import AGENTS_SQL, AS_OF, as_agents, as_sessions, ntz, oracle_sql, queries, registered
from tidefold.schemas import broken_arguments, broken_rules, repeated_keys, schema
from tidefold.sources.listings import decoded

#: All queries that are registered, those of the catalogue and those here.
__all__ = ["oracle_sql", "queries"]
EARLY = "2024-01-01 00:00:00"


def _users(customers: DataFrame) -> DataFrame:
    early = P.moment(EARLY)
    return customers.select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("email"), F.sha2("c_name", 256).alias("password_hash"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"),
        (F.col("c_custkey") % 4 == 0).alias("must_change_password"), (F.col("c_acctbal") < 0).alias("disabled"), early.alias("created_at"), early.alias("updated_at"),
    )


USERS_SQL = f"""users AS (SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS email, sha256(c_name) AS password_hash, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role,
  c_custkey % 4 = 0 AS must_change_password, c_acctbal < 0 AS disabled, TIMESTAMP '{EARLY}' AS created_at, TIMESTAMP '{EARLY}' AS updated_at FROM customer)"""


def _hex_id(key: Column) -> Column:
    m = F.md5(key.cast("string"))
    return F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _hex_sql(key: str) -> str:
    m = f"md5(CAST({key} AS VARCHAR))"
    return " || '-' || ".join(f"substr({m}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _invites(labels: DataFrame) -> DataFrame:
    """An invitation a label; toxic ones have run out, every fifth is used."""
    at = P.moment(AS_OF)
    doc = F.col("doc_id")
    return labels.select(
        _hex_id(doc).alias("id"), F.sha2(F.concat(F.lit("t"), doc.cast("string")), 256).alias("token_hash"), F.col("quality").alias("created_by_user_id"), P.moment(EARLY).alias("created_at"),
        F.when(F.col("toxic") == 1, at).otherwise(X.after(at, hours=1)).alias("expires_at"), F.when(doc % 5 == 0, P.moment(EARLY)).alias("used_at"), F.lit(None).cast("int").alias("used_by_user_id"),
    )


INVITES_SQL = f"""invites AS (SELECT {_hex_sql("doc_id")} AS id, doc_id, sha256('t' || doc_id) AS token_hash, quality AS created_by_user_id,
  CASE WHEN toxic = 1 THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR END AS expires_at, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '{EARLY}' END AS used_at FROM labels)"""


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def _codes(spark: SparkSession, calls: dict[str, Callable[[], object]]) -> DataFrame:
    """``case``, ``code``: ``ok``, or why a command was refused."""
    found = []
    for case, call in calls.items():
        try:
            call()
            found.append((case, "ok"))
        except transitions.Refused as e:
            found.append((case, e.code))
        except ValueError:
            found.append((case, "out_of_range"))
    return spark.createDataFrame(found, "case string, code string")


# --- predicates, scalars, pages ----------------------------------------------------------------------------------------


@registered(f"SELECT o_orderkey FROM orders WHERE {_hex_sql('o_orderkey')} = lower('A1D0C6E8-3F02-7327-D846-1063F4AC58A6')")
def uuid_lookup(t):
    return t("orders").withColumn("id", _hex_id(F.col("o_orderkey"))).filter(P.uuid_is("id", "A1D0C6E8-3F02-7327-D846-1063F4AC58A6")).select("o_orderkey")


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_3'")
def text_key_lookup(t):
    return t("nation").filter(P.key_is("n_name", "NATION_3")).select("n_nationkey", "n_name")


@registered(f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {_hex_sql('event_id')} END AS id FROM events")
def uuid_parse(t):
    good = _hex_id(F.col("event_id"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper(good), F.lit("\n"))).when(F.col("event_id") % 3 == 1, F.substring(good, 1, 35)).otherwise(F.regexp_replace(good, "-", "g"))
    return t("events").select("event_id", X.uuid_or_null(text).alias("id"))


@registered("SELECT page_id, 'https://arena.example/register?token=' || md5(url) AS link FROM pages")
def invite_links(t):
    return t("pages").select("page_id", X.invite_url("https://arena.example//", F.md5("url")).alias("link"))


@registered("SELECT event_id, true AS fine FROM events")
def code_format(t):
    code = X.random_code()
    return t("events").select("event_id", code.alias("code")).select("event_id", F.col("code").rlike("^[A-HJ-NP-Z2-9]{4}-[A-HJ-NP-Z2-9]{4}$").alias("fine"))


@registered("""WITH r AS (SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_partkey % 260 - 20 NOT BETWEEN 1 AND 200 THEN 'limit' END, CASE WHEN l_suppkey % 4 - 1 < 0 THEN 'offset' END,
  CASE WHEN l_orderkey % 13 = 0 OR l_orderkey % 4000 NOT BETWEEN 1 AND 3650 THEN 'stale_days' END, CASE WHEN l_quantity * 20 NOT BETWEEN 1 AND 720 THEN 'hours' END, CASE WHEN l_linenumber = 7 OR l_partkey % 350 NOT BETWEEN 1 AND 320 THEN 'email' END,
  CASE WHEN l_returnflag <> 'R' AND l_linestatus <> 'F' THEN 'any of role, disabled' END], lambda x: x IS NOT NULL), ';') AS broken FROM lineitem) SELECT * FROM r WHERE broken <> ''""")
def argument_checks(t):
    """Commands with numbers, texts and optional fields: those that are refused, and for which arguments."""
    commands = t("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 260 - 20).alias("limit"), (F.col("l_suppkey") % 4 - 1).alias("offset"), F.when(F.col("l_orderkey") % 13 != 0, F.col("l_orderkey") % 4000).alias("stale_days"),
        (F.col("l_quantity") * 20).alias("hours"), F.when(F.col("l_linenumber") != 7, F.repeat(F.lit("x"), (F.col("l_partkey") % 350).cast("int"))).alias("email"), F.when(F.col("l_returnflag") == "R", "admin").alias("role"),
        F.when(F.col("l_linestatus") == "F", True).alias("disabled"),
    )
    limits = {"limit": (1, 200), "offset": (0, 1 << 40), "stale_days": (1, 3650), "hours": (1, 720)}
    return broken_arguments(commands, limits, {"email": (1, 320)}, ("role", "disabled")).select("l_orderkey", "l_linenumber", F.array_join("broken", ";").alias("broken"))


@registered("""WITH r AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN lang = 'de' THEN 'content_type_missing' END, CASE WHEN doc_id % 7 = 0 THEN 'storage_path_missing' END, CASE WHEN doc_id % 2 = 0 THEN 'sha256_too_long' END,
  CASE WHEN lang = 'en' THEN 'content_type_unknown' END, CASE WHEN n_chars < 500 THEN 'size_bytes_negative' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents) SELECT doc_id, broken FROM r WHERE broken <> ''""")
def broken_rows(t):
    kind = F.when(F.col("lang") == "en", "movie").when(F.col("lang") != "de", "unknown")
    rows = t("documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("a"), F.lit(65))).otherwise("a").alias("sha256"), (F.col("n_chars") - 500).alias("size_bytes"), kind.alias("content_type"),
        F.when(F.col("doc_id") % 7 != 0, "p").alias("storage_path"), P.moment(AS_OF).alias("first_uploaded_at"),
    )
    return broken_rules(rows, "files").select("doc_id", F.array_join("broken", ",").alias("broken"))


@registered("""SELECT 'id' AS rule, CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1
UNION ALL SELECT 'lower(email)', lower(c_mktsegment), count(*) FROM customer GROUP BY 2 HAVING count(*) > 1""")
def repeated_key_values(t):
    return repeated_keys(t("customer").select(F.col("c_nationkey").alias("id"), F.initcap("c_mktsegment").alias("email")), "users")


@registered("""SELECT * FROM (SELECT 'agents' AS "table", 'user_id' AS "column", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'sessions', 'user_id', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) WHERE n > 0""")
def broken_references(t):
    return relational.broken_references({"users": _users(t("customer").filter("c_acctbal > 0")), "agents": as_agents(t("orders")), "sessions": as_sessions(t("orders"))})


@registered("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 30 OFFSET 60")
def page_envelope(t):
    found = paging.envelope(t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), "o_orderkey", limit=30, offset=60)
    return found.items.crossJoin(found.total)


@registered("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 20 OR o_custkey = 20 AND o_orderkey > 100 ORDER BY 1, 2 LIMIT 50")
def page_after(t):
    return paging.after(t("orders").select("o_custkey", "o_orderkey"), {"o_custkey": 20, "o_orderkey": 100})


@registered("""SELECT CAST(c_custkey AS VARCHAR) AS agent_id, CAST(c_nationkey AS INTEGER) AS user_id, c_name AS machine_name, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-05-01 12:00:00' END AS created_at,
  CASE WHEN c_nationkey % 2 = 0 THEN 1000 + c_nationkey ELSE count(*) OVER (PARTITION BY c_nationkey) END AS total FROM customer""")
def listing_decoded(t):
    item = F.struct(
        F.col("c_custkey").cast("string").alias("agent_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("machine_name"), F.when(F.col("c_custkey") % 3 == 0, "2024-05-01T14:00:00+02:00").when(F.col("c_custkey") % 3 == 1, "soon").alias("created_at"),
        F.lit(1).alias("unknown"),
    )
    bodies = t("customer").groupBy("c_nationkey").agg(F.collect_list(item).alias("agents"))
    given = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") + 1000).cast("long").alias("total")
    made = decoded(bodies.select(F.to_json(F.struct("agents", given)).alias("body")), "agents")
    return made.select("agent_id", "user_id", "machine_name", ntz("created_at").alias("created_at"), "total")


@registered("""SELECT 'match.parsed' AS topic, '{"match_id":"' || event_id || '"' || CASE WHEN event_id % 2 = 0 THEN ',"user_id":"' || user_id || '"' ELSE '' END || ',"game_count":3}' AS value FROM events""")
def published(t):
    from tidefold.streaming.uploads import publish

    rows = t("events").select(F.col("event_id").cast("string").alias("match_id"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).alias("user_id"), F.lit(3).alias("game_count"))
    return publish(rows, "match.parsed")


@registered("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN md5(props) END AS sha256, CASE WHEN event_id % 4 < 2 THEN CAST(user_id AS INTEGER) END AS user_id FROM events")
def events_parsed(t):
    from tidefold.streaming.uploads import parse_events

    part = F.col("event_id") % 4
    body = F.when(part == 3, "no json").otherwise(F.to_json(F.struct(F.md5("props").alias("sha256"), F.when(part < 2, F.col("user_id")).alias("user_id"), F.lit(1).alias("more"), F.col("event_id").cast("string").alias("content_type"))))
    rows = t("events").select("event_id", body.alias("value"))
    return parse_events(rows, "file.ingested", keep=("event_id",)).select("event_id", "sha256", "user_id")


# --- users ----------------------------------------------------------------------------------------------------------------


@registered(f"WITH {USERS_SQL} SELECT id, CASE WHEN id = 3 THEN 'new.address@x.org' ELSE email END AS email, CASE WHEN id = 3 THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM users")
def email_changed(t):
    done = transitions.change_email(_users(t("customer")), 3, "  New.Address@X.org\t", AS_OF)
    return done.tables["users"].select("id", "email", ntz("updated_at").alias("updated_at"))


@registered(f"WITH {USERS_SQL} SELECT id, CASE WHEN id = 8 THEN 'new hash' ELSE password_hash END AS password_hash, id <> 8 AND must_change_password AS must_change_password, CASE WHEN id = 8 THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM users")
def password_changed(t):
    done = transitions.change_password(_users(t("customer")), as_sessions(t("orders")), 8, "new hash", AS_OF)
    return done.tables["users"].select("id", "password_hash", "must_change_password", ntz("updated_at").alias("updated_at"))


@registered(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_custkey = 8 THEN TIMESTAMP '{AS_OF}' END AS revoked_at FROM orders")
def password_change_ends_sessions(t):
    done = transitions.change_password(_users(t("customer")), as_sessions(t("orders")), 8, "new hash", AS_OF)
    return done.tables["sessions"].select("id", ntz("revoked_at").alias("revoked_at"))


@registered(f"WITH {USERS_SQL} SELECT id, CASE WHEN id = 9 THEN 'reset' ELSE password_hash END AS password_hash, id = 9 OR must_change_password AS must_change_password FROM users")
def password_reset(t):
    return transitions.reset_password(_users(t("customer")), 9, "reset", AS_OF).tables["users"].select("id", "password_hash", "must_change_password")


@registered(f"WITH {USERS_SQL} SELECT id, email, role, must_change_password, disabled FROM users UNION ALL SELECT CAST(max(id) + 1 AS INTEGER), 'As.Typed@X.org', 'admin', true, false FROM users")
def user_created(t):
    done = transitions.create_user(_users(t("customer")), "As.Typed@X.org", "hash", "admin", True, AS_OF)
    return done.tables["users"].select("id", "email", "role", "must_change_password", "disabled")


@registered(f"WITH {USERS_SQL} SELECT id, CASE WHEN id = 5 THEN 'admin' ELSE role END AS role, id = 5 OR disabled AS disabled, must_change_password FROM users")
def user_updated(t):
    return transitions.update_user(_users(t("customer")), 1, 5, AS_OF, role="admin", disabled=True).tables["users"].select("id", "role", "disabled", "must_change_password")


@registered(f"""WITH {USERS_SQL}, u AS (SELECT id, email, role FROM users WHERE role <> 'admin' OR disabled)
SELECT * FROM u UNION ALL SELECT CAST(max(id) + 1 AS INTEGER), 'first@x.org', 'admin' FROM u""")
def admin_bootstrapped(t):
    """Disabled administrators do not count; with an enabled one nothing happens."""
    users = _users(t("customer"))
    first = transitions.bootstrap_admin(users.filter("role <> 'admin' OR disabled"), "first@x.org", "hash", True, AS_OF)
    again = transitions.bootstrap_admin(first.tables["users"], "second@x.org", "hash", True, AS_OF)
    return again.tables["users"].select("id", "email", "role")


@registered(f"""WITH {USERS_SQL}, s(n) AS (SELECT count(*) FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F') SELECT * FROM (VALUES ('blank address', 'invalid_email'), ('own address', 'ok'), ('unknown user', 'user_not_found'),
  ('disable oneself', 'cannot_disable_self'), ('delete oneself', 'cannot_delete_self'), ('no field', 'out_of_range'), ('too many hours', 'out_of_range'), ('unknown invitation', 'invite_not_found'), ('mode by another', 'root_admin_required'),
  ('unknown mode', 'invalid_mode'), ('no setting', 'registration_mode_unconfigured'), ('unknown role', 'invalid_role'), ('missing agent', 'agent_not_found'), ('the last administrator', 'cannot_demote_last_admin'), ('the last one deleted', 'cannot_delete_last_admin')) c("case", code)
UNION ALL SELECT 'taken address', CASE WHEN EXISTS (SELECT 1 FROM users WHERE lower(email) = 'customer#000000004') THEN 'email_already_exists' ELSE 'ok' END
UNION ALL SELECT 'agent of another', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 42 AND o_custkey = -1) THEN 'ok' ELSE 'agent_not_found' END
UNION ALL SELECT 'sessions ended', 'ok ' || n FROM s UNION ALL SELECT 'sessions ended again', 'ok 0'""")
def guards(t):
    users, agents, sessions = _users(t("customer")), as_agents(t("orders")), as_sessions(t("orders"))
    spark = users.sparkSession
    settings, invites = _empty(spark, "settings"), _empty(spark, "invites")
    one = transitions.changed(users, F.col("id") != 1, role="user").transform(lambda u: transitions.changed(u, F.col("id") == 1, role="admin", disabled=False))
    calls = {
        "blank address": lambda: transitions.change_email(users, 3, "  \t", AS_OF), "own address": lambda: transitions.change_email(users, 3, "CUSTOMER#000000003", AS_OF), "taken address": lambda: transitions.change_email(users, 3, "CUSTOMER#000000004", AS_OF),
        "unknown user": lambda: transitions.reset_password(users, -5, "h", AS_OF), "disable oneself": lambda: transitions.update_user(users, 2, 2, AS_OF, disabled=True), "no field": lambda: transitions.update_user(users, 1, 2, AS_OF),
        "delete oneself": lambda: transitions.delete_user({"users": users}, 2, 2), "too many hours": lambda: transitions.mint_invite(invites, "i", "h", 1, AS_OF, 721), "unknown invitation": lambda: transitions.revoke_invite(invites, "i", AS_OF),
        "mode by another": lambda: transitions.set_registration_mode(users, settings, 2, "open", AS_OF), "unknown mode": lambda: transitions.set_registration_mode(users, settings, 1, "shut", AS_OF), "no setting": lambda: transitions.registration_mode(settings),
        "unknown role": lambda: transitions.create_user(users, "a@b.c", "h", "owner", False, AS_OF), "missing agent": lambda: transitions.revoke_own_agent(agents, "-1", 7, AS_OF), "agent of another": lambda: transitions.revoke_own_agent(agents, "42", -1, AS_OF),
        "the last administrator": lambda: transitions.update_user(one, 2, 1, AS_OF, role="user"), "the last one deleted": lambda: transitions.delete_user({"users": one}, 2, 1),
    }
    first = transitions.revoke_sessions(users, sessions, 7, AS_OF)
    again = transitions.revoke_sessions(users, first.tables["sessions"], 7, AS_OF)
    counts = spark.createDataFrame([("sessions ended", f"ok {first.count}"), ("sessions ended again", f"ok {again.count}")], "case string, code string")
    return _codes(spark, calls).union(counts)


# --- sessions ----------------------------------------------------------------------------------------------------------------


@registered(f"""WITH {USERS_SQL} SELECT 's' || id AS id, id AS user_id, 'h' || id AS refresh_token_hash, TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY AS expires_at FROM users WHERE NOT disabled AND id % 5 <> 0""")
def logged_in(t):
    users, sessions = _users(t("customer")), as_sessions(t("orders"))
    text = F.col("id").cast("string")
    tries = users.select(F.col("id").alias("seq"), F.upper("email").alias("email"), (F.col("id") % 5 != 0).alias("verified"), F.concat(F.lit("s"), text).alias("session_id"), F.concat(F.lit("h"), text).alias("refresh_token_hash"), F.lit("ua").alias("user_agent"), F.lit("ip").alias("ip"))
    after = transitions.login(users, sessions.limit(0), tries, AS_OF).tables["sessions"]
    return after.select("id", "user_id", "refresh_token_hash", ntz("expires_at").alias("expires_at"))


@registered(f"""WITH won AS (SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01' AND NOT c_acctbal < 0)
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS INTEGER) AS user_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderkey IN (SELECT o_orderkey FROM won) THEN TIMESTAMP '1997-01-01' END AS revoked_at FROM orders
UNION ALL SELECT 'n' || o_orderkey, CAST(o_custkey AS INTEGER), NULL FROM won""")
def rotated_sessions(t):
    """Old sessions are revoked and new ones begin; of two uses of a hash the first has it."""
    s = as_sessions(t("orders"))
    asks = s.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "*").select(
        (F.col("n") * 100000000 + F.col("id").cast("long")).alias("seq"), F.col("refresh_token_hash").alias("old_hash"), F.lit("new").alias("new_hash"), F.concat(F.lit("n"), "id").alias("session_id"), "user_agent", "ip"
    )
    return transitions.rotate(_users(t("customer")), s, asks, "1997-01-01").tables["sessions"].select("id", "user_id", ntz("revoked_at").alias("revoked_at"))


# --- invitations, settings, registration -------------------------------------------------------------------------------------


@registered(f"WITH {INVITES_SQL} SELECT id, token_hash, created_by_user_id, expires_at FROM invites UNION ALL SELECT 'new', 'hash', 7, TIMESTAMP '{AS_OF}' + INTERVAL 720 HOUR")
def invite_minted(t):
    return transitions.mint_invite(_invites(t("labels")), "new", "hash", 7, AS_OF, 720).tables["invites"].select("id", "token_hash", "created_by_user_id", ntz("expires_at").alias("expires_at"))


@registered(f"WITH {INVITES_SQL}, i AS (SELECT min(id) AS p FROM invites WHERE used_at IS NULL AND expires_at > TIMESTAMP '{AS_OF}') SELECT id, CASE WHEN id = p THEN TIMESTAMP '{AS_OF}' ELSE expires_at END AS expires_at FROM invites, i")
def invites_revoked(t):
    """The least pending one expires; a used one and one that has run out stay as they are."""
    invites = _invites(t("labels"))
    pending = P.pending(AS_OF)
    chosen = invites.agg(*(F.min(F.when(c, F.col("id"))) for c in (pending, F.col("used_at").isNotNull(), ~pending & F.col("used_at").isNull()))).first()
    for key in chosen:
        invites = transitions.revoke_invite(invites, key.upper(), AS_OF).tables["invites"] if key else invites
    return invites.select("id", ntz("expires_at").alias("expires_at"))


@registered(f"""SELECT 'registration_mode' AS key, '"open"' AS value, 1 AS updated_by_user_id, TIMESTAMP '{AS_OF}' AS updated_at UNION ALL SELECT 'other', '1', NULL, TIMESTAMP '{EARLY}'""")
def registration_mode_set(t):
    users = transitions.changed(_users(t("customer")), F.col("id") == 1, role="admin", disabled=False)
    settings = _empty(users.sparkSession, "settings")
    for key, value in (("registration_mode", '"invite_only"'), ("other", "1"), ("other", "2")):
        settings = transitions.seed_setting(settings, EARLY, key, value).tables["table"]
    after = transitions.set_registration_mode(users, settings, 1, "open", AS_OF).tables["settings"]
    return after.select("key", "value", "updated_by_user_id", ntz("updated_at").alias("updated_at"))


def _registered(t, mode: str):
    """Ten commands for each of the first labels' tokens, more without token, some of them weak or with taken addresses."""
    invites = _invites(t("labels"))
    users = _users(t("customer").filter("c_custkey < 100"))
    settings = transitions.seed_setting(_empty(users.sparkSession, "settings"), AS_OF, value=f'"{mode}"').tables["table"]
    key = F.col("c_custkey")
    asks = t("customer").select(
        (key * 3).alias("seq"), F.concat(F.lit(" "), F.upper("c_name")).alias("email"), F.when(key % 7 == 0, 3).otherwise(20).alias("password_length"), F.lit("h").alias("password_hash"),
        F.when(key % 11 != 0, F.concat(F.lit("t"), (key % 120).cast("string"), F.lit(" "))).alias("token"),
    )
    return transitions.register(users, invites, settings, asks, AS_OF)


#: An address is asked for once only, so a token goes to the first strong command for it whose address is free.
def _register_sql(mode: str) -> str:
    return f"""WITH {INVITES_SQL}, asks AS (SELECT c_custkey, c_custkey * 3 AS seq, lower(c_name) AS email, c_custkey % 7 = 0 AS weak, CASE WHEN c_custkey % 11 <> 0 THEN sha256('t' || c_custkey % 120) END AS hash, c_custkey < 100 AS taken FROM customer),
joined AS (SELECT asks.*, invites.id AS invite FROM asks LEFT JOIN invites ON token_hash = hash AND used_at IS NULL AND expires_at > TIMESTAMP '{AS_OF}'),
firsts AS (SELECT invite, min(seq) AS first FROM joined WHERE NOT weak AND NOT taken AND invite IS NOT NULL GROUP BY invite),
judged AS (SELECT seq, email, joined.invite, CASE WHEN weak THEN 'weak_password' WHEN hash IS NULL AND '{mode}' = 'invite_only' THEN 'invite_required' WHEN hash IS NOT NULL AND (joined.invite IS NULL OR first < seq) THEN 'invalid_invite_token'
  WHEN taken THEN 'email_already_exists' ELSE 'ok' END AS code FROM joined LEFT JOIN firsts ON joined.invite = firsts.invite)"""


@registered(f"{_register_sql('invite_only')} SELECT seq, code FROM judged")
def registrations_by_invite(t):
    return _registered(t, "invite_only").outcomes


@registered(f"{_register_sql('open')} SELECT seq, code FROM judged")
def registrations_in_open_mode(t):
    """A token that is given is checked and used up in open mode, too."""
    return _registered(t, "open").outcomes


@registered(f"{_register_sql('invite_only')} SELECT CAST((SELECT max(c_custkey) FROM customer WHERE c_custkey < 100) + row_number() OVER (ORDER BY seq) AS INTEGER) AS id, email FROM judged WHERE code = 'ok'")
def registered_users(t):
    return _registered(t, "invite_only").tables["users"].filter("password_hash = 'h'").select("id", "email")


@registered(f"""{_register_sql('invite_only')}, new AS (SELECT invite, CAST((SELECT max(c_custkey) FROM customer WHERE c_custkey < 100) + row_number() OVER (ORDER BY seq) AS INTEGER) AS id FROM judged WHERE code = 'ok')
SELECT invites.id, CASE WHEN new.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE used_at END AS used_at, new.id AS used_by_user_id FROM invites LEFT JOIN new ON invite = invites.id""")
def invites_consumed(t):
    return _registered(t, "invite_only").tables["invites"].select("id", ntz("used_at").alias("used_at"), "used_by_user_id")


# --- agents ------------------------------------------------------------------------------------------------------------------


def _consumed(t) -> DataFrame:
    return t("events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("user_id")).cast("int").alias("user_id"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("agent_id"), F.lit("pc").alias("machine_name"),
        F.md5("props").alias("api_token_hash"), F.lit("1").alias("client_version"),
    )


_CONSUMED_SQL = f"""WITH {USERS_SQL}, tried AS (SELECT event_id AS seq, CASE WHEN event_type <> 'error' THEN CAST(user_id AS INTEGER) END AS owner, 'a' || event_id AS agent_id FROM events),
judged AS (SELECT tried.*, CASE WHEN owner IS NULL THEN 'invalid_registration_code' WHEN coalesce(role, '') <> 'user' THEN 'admin_cannot_register_agent' ELSE 'ok' END AS code FROM tried LEFT JOIN users ON id = owner)"""


@registered(f"{_CONSUMED_SQL} SELECT seq, code FROM judged")
def agent_registrations(t):
    return transitions.register_agents(_users(t("customer")), _empty(t("region").sparkSession, "agents"), _consumed(t), AS_OF).outcomes


@registered(f"{_CONSUMED_SQL} SELECT agent_id AS id, owner AS user_id, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS last_seen_at FROM judged WHERE code = 'ok'")
def registered_agents(t):
    done = transitions.register_agents(_users(t("customer")), _empty(t("region").sparkSession, "agents"), _consumed(t), AS_OF)
    return done.tables["agents"].select("id", "user_id", ntz("created_at").alias("created_at"), ntz("last_seen_at").alias("last_seen_at"))


@registered(f"WITH {AGENTS_SQL} SELECT id, CASE WHEN revoked_at IS NULL AND CAST(id AS BIGINT) % 4 = 1 THEN TIMESTAMP '{AS_OF}' ELSE revoked_at END AS revoked_at FROM agents")
def agents_revoked(t):
    agents = as_agents(t("orders"))
    wanted = agents.filter("CAST(id AS long) % 4 = 1").select("id")
    return transitions.revoke_agents(agents, wanted.union(wanted), AS_OF).tables["agents"].select("id", ntz("revoked_at").alias("revoked_at"))


@registered(f"WITH {AGENTS_SQL}, own AS (SELECT min(id) AS mine FROM agents WHERE revoked_at IS NULL) SELECT id, CASE WHEN id = mine THEN TIMESTAMP '{AS_OF}' ELSE revoked_at END AS revoked_at FROM agents, own")
def own_agent_revoked(t):
    agents = as_agents(t("orders"))
    mine = agents.filter(P.not_revoked()).agg(F.min(F.struct("id", "user_id")).alias("m")).first().m
    return transitions.revoke_own_agent(agents, mine.id, mine.user_id, AS_OF).tables["agents"].select("id", ntz("revoked_at").alias("revoked_at"))


@registered("SELECT CAST(count(*) AS BIGINT) AS revoked, '1996-10-03T00:00:00+00:00' AS cutoff FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-10-03'")
def stale_cleanup_report(t):
    done = transitions.revoke_stale(as_agents(t("orders")), "1997-01-01", 90)
    return t("region").sparkSession.createDataFrame([(done.count, done.values["cutoff"])], "revoked long, cutoff string")


_LOG_SQL = f"""WITH {USERS_SQL}, log AS (SELECT o_orderkey AS id, CAST(o_orderkey % 500 AS VARCHAR) AS agent_id, CAST(o_custkey AS INTEGER) AS prior_user_id FROM orders),
last AS (SELECT agent_id, arg_max(prior_user_id, log.id) AS prior FROM log JOIN users ON users.id = prior_user_id WHERE users.id % 3 <> 0 GROUP BY 1), {AGENTS_SQL}"""


@registered(f"{_LOG_SQL} SELECT id, coalesce(prior, user_id) AS user_id FROM agents LEFT JOIN last ON agent_id = id")
def reassignment_undone(t):
    """Several moves of an agent, some from users who are gone: the latest entry of one who is there holds."""
    users, agents = _users(t("customer")).filter("id % 3 <> 0"), as_agents(t("orders"))
    key = F.col("o_orderkey")
    log = t("orders").select(key.cast("int").alias("id"), (key % 500).cast("string").alias("agent_id"), F.col("o_custkey").cast("int").alias("prior_user_id"), F.lit(1).alias("new_user_id"), P.moment(AS_OF).alias("reassigned_at"))
    return transitions.undo_reassignment(users, agents, log).tables["agents"].select("id", "user_id")


# --- uploads ------------------------------------------------------------------------------------------------------------------


def _upload(t):
    events = t("events")
    known = events.filter("event_id < 30").select(F.sha2("props", 256).alias("sha256")).distinct()
    files = known.select("sha256", F.lit(1).cast("long").alias("size_bytes"), F.lit("unknown").alias("content_type"), F.lit("old").alias("storage_path"), P.moment(EARLY).alias("first_uploaded_at"))
    kind = F.when(F.col("event_type") == "error", "movie").when(F.col("event_id") % 3 == 0, "decklist").when(F.col("event_id") % 3 == 1, "unknown")
    batch = events.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 != 1, F.col("props")).cast("binary").alias("content"), kind.alias("content_type"), F.lit("log.txt").alias("original_filename"), F.col("user_id").cast("int").alias("user_id"),
        F.lit("a").alias("agent_registration_id"), F.col("ts").cast("timestamp").alias("uploaded_at"),
    )
    return uploads.upload(files, _empty(events.sparkSession, "uploads"), batch)


_UPLOAD_SQL = """WITH known AS (SELECT DISTINCT sha256(props) AS sha256 FROM events WHERE event_id < 30),
tried AS (SELECT event_id, ts, user_id, props, CASE WHEN event_type = 'error' THEN 'movie' WHEN event_id % 3 = 0 THEN 'decklist' WHEN event_id % 3 = 1 THEN 'unknown' ELSE 'match-log' END AS kind, sha256(props) AS sha256 FROM events WHERE event_id % 50 <> 1),
good AS (SELECT *, row_number() OVER (ORDER BY event_id) AS id, row_number() OVER (PARTITION BY sha256 ORDER BY ts, event_id) AS n FROM tried WHERE kind <> 'movie')"""


@registered(f"{_UPLOAD_SQL} SELECT id, sha256, CAST(user_id AS INTEGER) AS user_id FROM good")
def uploads_attributed(t):
    return _upload(t).tables["new_uploads"].select("id", "sha256", "user_id")


@registered(f"""{_UPLOAD_SQL} SELECT sha256, 'unknown' AS content_type, 'old' AS storage_path FROM known UNION ALL
SELECT sha256, kind, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || CASE kind WHEN 'decklist' THEN '.xml' WHEN 'unknown' THEN '.txt' ELSE '.dat' END FROM good WHERE n = 1 AND sha256 NOT IN (SELECT sha256 FROM known)""")
def files_stored(t):
    return _upload(t).tables["files"].select("sha256", "content_type", "storage_path")


@registered(f"{_UPLOAD_SQL} SELECT sha256, event_id, CAST(user_id AS INTEGER) AS user_id, kind AS content_type FROM good WHERE n = 1 AND sha256 NOT IN (SELECT sha256 FROM known)")
def upload_events(t):
    """One event for each new content, read back from its payload."""
    said = _upload(t).tables["events"].select("sha256", F.from_json("payload", schema("file.ingested")).alias("e"))
    ids = t("events").select("event_id", F.col("user_id").cast("int").alias("u"), X.iso_format("ts").alias("at"), F.sha2("props", 256).alias("s"))
    same = (F.col("s") == F.col("sha256")) & (F.col("at") == F.col("e.uploaded_at")) & (F.col("u") == F.col("e.user_id"))
    return said.join(ids, same).select("sha256", "event_id", F.col("e.user_id").alias("user_id"), F.col("e.content_type").alias("content_type"))


@registered("SELECT sha256, CAST(min(doc_id) AS INTEGER) AS user_id, count(*) AS uploads, any_value(md5(text)) AS body FROM (SELECT doc_id, text, sha256(text) AS sha256 FROM documents WHERE text <> '') GROUP BY 1")
def upload_stream(t):
    """The documents as a stream of uploads, run to its end; files, uploads and announced events, and the stored bytes, must agree."""
    from tidefold.session import scratch
    from tidefold.sources.blobs import read_bodies
    from tidefold.sources.versions import read_batches
    from tidefold.streaming.uploads import ingest_stream

    docs = t("documents").filter("text <> ''")
    spark = docs.sparkSession
    root = scratch(spark, "uploads")
    docs.select(
        F.col("doc_id").cast("int").alias("seq"), F.col("text").cast("binary").alias("content"), F.lit("unknown").alias("content_type"), F.lit("a.txt").alias("original_filename"), F.col("doc_id").cast("int").alias("user_id"),
        F.lit("a").alias("agent_registration_id"), P.moment(AS_OF).alias("uploaded_at"),
    ).write.parquet(f"{root}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    ingest_stream(source, f"{root}/tables", f"{root}/checkpoint", f"{root}/events", f"{root}/raw").awaitTermination()
    stored = read_bodies(spark, f"{root}/raw").select("sha256", F.md5("content").alias("body"))
    said = spark.read.schema("topic string, sha256 string, payload string").json(f"{root}/events").select("sha256", F.from_json("payload", schema("file.ingested"))["user_id"].alias("user_id"))
    many = read_batches(spark, f"{root}/tables", "uploads").groupBy("sha256").agg(F.count(F.lit(1)).alias("uploads"))
    return said.join(many, "sha256").join(read_batches(spark, f"{root}/tables", "files").select("sha256"), "sha256").join(stored, "sha256")


@registered("""SELECT DISTINCT sha256(text) AS sha256, strlen(text) AS size_bytes, CASE WHEN strlen(text) > 1500 THEN 'file_too_large' ELSE 'ok' END AS code, CASE WHEN strlen(text) <= 1500 THEN md5(text) END AS body FROM documents""")
def archive_round_trip(t):
    """Texts stored under their hashes twice, which changes nothing, and read back; empty and large files have their codes."""
    from tidefold.session import scratch
    from tidefold.sources import blobs

    docs = t("documents").select(F.col("text").cast("binary").alias("content")).distinct()
    root = scratch(docs.sparkSession, "archive")
    files = docs.select(X.shard_path(X.sha256_hex("content"), ".dat").alias("path"), "content")
    for _ in range(2):
        blobs.store(files, root).write.format("noop").mode("overwrite").save()
    read = blobs.read_bodies(docs.sparkSession, root, 1500)
    return read.select(F.regexp_extract("path", "([0-9a-f]{64})[.]dat$", 1).alias("sha256"), "size_bytes", "code", F.md5("content").alias("body")).filter(F.coalesce("sha256", F.lit("")) != "")


@registered(f"""WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_custkey = 7), n AS (SELECT count(*) AS n FROM gone)
SELECT 'users' AS "table", (SELECT count(*) FROM customer) - n AS rows FROM n UNION ALL SELECT 'agents', (SELECT count(*) FROM orders WHERE o_custkey <> 7) UNION ALL SELECT 'sessions', (SELECT count(*) FROM orders WHERE o_custkey <> 7)
UNION ALL SELECT 'uploads', (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey <> 7 AND l_suppkey <> 7) UNION ALL SELECT 'files', (SELECT count(DISTINCT l_partkey) FROM lineitem)
UNION ALL SELECT 'invites', (SELECT count(*) FROM labels) UNION ALL SELECT 'invites without creator', (SELECT count(*) FROM labels WHERE doc_id % 10 = 7) UNION ALL SELECT 'settings without user', 1""")
def user_deleted_everywhere(t):
    """What belongs to the user goes, down to uploads of the user's machines; contents stay; pointers become null."""
    lines = t("lineitem").join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = lines.select(F.col("l_partkey").cast("string").alias("sha256"), F.col("l_suppkey").cast("int").alias("user_id"), F.col("l_orderkey").cast("string").alias("agent_registration_id"), F.lit(1).alias("id"))
    invites = t("labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 10).cast("int").alias("created_by_user_id"), F.lit(None).cast("int").alias("used_by_user_id"))
    settings = t("region").limit(1).select(F.lit("k").alias("key"), F.lit(7).alias("updated_by_user_id"))
    tables = {"users": _users(t("customer")), "agents": as_agents(t("orders")), "sessions": as_sessions(t("orders")), "uploads": made, "files": made.select("sha256").distinct(), "invites": invites, "settings": settings}
    after = transitions.delete_user(tables, 1, 7).tables
    counts = {k: after[k] for k in ("users", "agents", "sessions", "uploads", "files", "invites")}
    counts |= {"invites without creator": after["invites"].filter("created_by_user_id IS NULL"), "settings without user": after["settings"].filter("updated_by_user_id IS NULL")}
    return transitions.unioned([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("table"), "rows") for k, df in counts.items()])
