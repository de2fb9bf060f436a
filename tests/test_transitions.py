"""State changes on small tables: boundaries, guards, counts, winners."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidefold.operators import relational, transitions as M, uploads
from tidefold.schemas import broken_rules, repeated_keys, schema

NOW = datetime(2024, 5, 1, 12)
DAY, HOUR = timedelta(days=1), timedelta(hours=1)


def users(spark, *rows):
    """(id, email, role, disabled)"""
    return spark.createDataFrame([(i, e, "hash", r, False, d, NOW - DAY, NOW - DAY) for i, e, r, d in rows], schema("users"))


def sessions(spark, *rows):
    """(id, user, refresh hash, expires, revoked)"""
    return spark.createDataFrame([(i, u, h, NOW - DAY, e, r, None, None) for i, u, h, e, r in rows], schema("sessions"))


def agents(spark, *rows):
    """(id, user, created, last seen, revoked, version)"""
    return spark.createDataFrame([(i, u, f"pc-{i}", f"t-{i}", c, s, r, v) for i, u, c, s, r, v in rows], schema("agents"))


def invites(spark, *rows):
    """(id, token, created, expires, used)"""
    import hashlib

    return spark.createDataFrame([(i, hashlib.sha256(t.encode()).hexdigest(), 1, c, e, u, None) for i, t, c, e, u in rows], schema("invites"))


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


BASE = ((1, "Root@x.com", "admin", False), (2, "boss@x.com", "admin", False), (3, "ann@x.com", "user", False), (4, "off@x.com", "user", True))


def test_login_and_rotation(spark):
    u = users(spark, *BASE)
    s = sessions(spark, ("s1", 3, "h1", NOW + DAY, None), ("s2", 3, "h2", NOW, None), ("s3", 4, "h3", NOW + DAY, None), ("s4", 3, "h4", NOW + DAY, NOW - HOUR))
    tries = spark.createDataFrame([(1, "ANN@x.com", True, "n1", "r1", "ua", "ip"), (2, "ann@x.com", False, "n2", "r2", None, None), (3, "off@x.com", True, "n3", "r3", None, None), (4, "nobody@x.com", True, "n4", "r4", None, None)], "seq int, email string, verified boolean, session_id string, refresh_token_hash string, user_agent string, ip string")
    done = M.login(u, s, tries, NOW)
    assert by(done.outcomes, "seq", "code") == {1: "ok", 2: "invalid_credentials", 3: "invalid_credentials", 4: "invalid_credentials"}
    new = done.tables["sessions"].filter("id = 'n1'").first()
    assert new.user_id == 3 and new.expires_at - NOW == timedelta(seconds=2_592_000)
    asks = spark.createDataFrame([(k, old, f"new{k}", f"r{k}", None, None) for k, old in enumerate(["h1", "h1", "h2", "h3", "h4", "zz"])], "seq int, old_hash string, new_hash string, session_id string, user_agent string, ip string")
    done = M.rotate(u, s, asks, NOW)
    assert by(done.outcomes, "seq", "code") == {0: "ok", **{k: "invalid_credentials" for k in range(1, 6)}}
    after = by(done.tables["sessions"], "id", "revoked_at")
    assert after["s1"] == NOW and after["r0"] is None and after["s4"] == NOW - HOUR and after["s2"] is None and len(after) == 5


def test_rotation_meets_each_table_once(spark, tmp_path):
    """Old and new rows come from one pass: two joins, and a session is shuffled for these only."""
    for name, df in (("u", users(spark, *BASE)), ("s", sessions(spark, ("s1", 3, "h1", NOW + DAY, None)))):
        df.write.parquet(str(tmp_path / name))
    asks = spark.createDataFrame([(1, "h1", "new", "r1", "ua", "ip"), (0, "h1", "first", "r0", "ua0", "ip0")], "seq int, old_hash string, new_hash string, session_id string, user_agent string, ip string")
    after = M.rotate(spark.read.parquet(str(tmp_path / "u")), spark.read.parquet(str(tmp_path / "s")), asks, NOW).tables["sessions"]
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    new = after.filter("id = 'r0'").first()
    assert after.count() == 2 and (new.user_id, new.refresh_token_hash, new.user_agent, new.ip, new.issued_at) == (3, "first", "ua0", "ip0", NOW)


def test_logout_and_revocation(spark):
    u, s = users(spark, *BASE), sessions(spark, ("s1", 3, "h1", NOW + DAY, None), ("s2", 3, "h2", NOW - DAY, None), ("s3", 3, "h3", NOW, NOW - HOUR), ("s4", 2, "h4", NOW, None))
    ids = spark.createDataFrame([("s1",), ("s3",), ("nope",)], "id string")
    assert by(M.logout(s, ids, NOW).tables["sessions"], "id", "revoked_at") == {"s1": NOW, "s2": None, "s3": NOW - HOUR, "s4": None}
    first = M.revoke_sessions(u, s, 3, NOW)
    assert first.count == 2 and M.revoke_sessions(u, first.tables["sessions"], 3, NOW + HOUR).count == 0
    with pytest.raises(M.Refused, match="user_not_found"):
        M.revoke_sessions(u, s, 99, NOW)
    done = M.change_password(u, s, 3, "new", NOW)
    assert {r.revoked_at for r in done.tables["sessions"].filter("user_id = 3 AND id <> 's3'").collect()} == {NOW}
    assert M.reset_password(u, 3, "tmp", NOW).tables["users"].filter("id = 3 AND must_change_password AND password_hash = 'tmp'").count() == 1


def test_users(spark):
    u = users(spark, *BASE)
    assert M.change_email(u, 3, "  ANN@x.com ", NOW).tables["users"].filter("id = 3").first().email == "ann@x.com"
    for code, call in {
        "email_already_exists": lambda: M.change_email(u, 3, "BOSS@x.com", NOW),
        "invalid_email": lambda: M.change_email(u, 3, "   ", NOW),
        "user_not_found": lambda: M.update_user(u, 1, 77, NOW, role="user"),
        "cannot_disable_self": lambda: M.update_user(u, 1, 1, NOW, disabled=True),
    }.items():
        with pytest.raises(M.Refused, match=code):
            call()
    made = M.create_user(u, "New@X.com", "h", "user", True, NOW)
    assert made.values["user_id"] == 5 and made.tables["users"].filter("email = 'New@X.com'").count() == 1
    with pytest.raises(M.Refused, match="email_already_exists"):
        M.create_user(made.tables["users"], "new@x.COM", "h", "user", True, NOW)
    one = M.update_user(u, 1, 2, NOW, role="user").tables["users"]
    with pytest.raises(M.Refused, match="cannot_demote_last_admin"):
        M.update_user(one, 1, 1, NOW, role="user")
    with pytest.raises(ValueError):
        M.update_user(u, 1, 2, NOW)
    assert M.bootstrap_admin(u, "a@b.c", "h", True, NOW).count == 0
    assert M.bootstrap_admin(users(spark, (1, "r@x.com", "admin", True)), "a@b.c", "h", True, NOW).tables["users"].count() == 2


def test_deletion(spark):
    u = users(spark, *BASE)
    files = spark.createDataFrame([("a" * 64, 1, "unknown", "p", NOW)], schema("files"))
    tables = {
        "users": u, "sessions": sessions(spark, ("s1", 3, "h", NOW, None), ("s2", 2, "g", NOW, None)), "agents": agents(spark, ("a3", 3, NOW, None, None, None), ("a2", 2, NOW, None, None, None)),
        "uploads": spark.createDataFrame([(1, "a" * 64, 3, "a3", NOW, None), (2, "a" * 64, 2, "a3", NOW, None), (3, "a" * 64, 2, "a2", NOW, None)], schema("uploads")), "files": files,
        "settings": spark.createDataFrame([("k", '"open"', NOW, 3)], schema("settings")), "invites": invites(spark, ("i", "t", NOW, NOW, None)).withColumn("used_by_user_id", F.lit(3)),
    }
    after = M.delete_user(tables, 1, 3).tables
    assert {k: v.count() for k, v in after.items()} == {"users": 3, "sessions": 1, "agents": 1, "uploads": 1, "files": 1, "settings": 1, "invites": 1}
    assert after["settings"].first().updated_by_user_id is None and after["invites"].first().used_by_user_id is None and after["invites"].first().created_by_user_id == 1
    assert relational.broken_references(after).isEmpty()
    broken = relational.broken_references(tables | {"users": u.filter("id <> 3")})
    assert {(r.table, r.column) for r in broken.collect()} == {("sessions", "user_id"), ("agents", "user_id"), ("uploads", "user_id"), ("settings", "updated_by_user_id"), ("invites", "used_by_user_id")}
    with pytest.raises(M.Refused, match="cannot_delete_self"):
        M.delete_user(tables, 3, 3)
    alone = tables | {"users": u.filter("id <> 1")}
    with pytest.raises(M.Refused, match="cannot_delete_last_admin"):
        M.delete_user(alone, 1, 2)


def test_invites_and_settings(spark):
    i = invites(spark, ("p", "tp", NOW, NOW + 168 * HOUR, None), ("e", "te", NOW - 200 * HOUR, NOW - HOUR, None), ("u", "tu", NOW, NOW + DAY, NOW), ("b", "tb", NOW - HOUR, NOW, None))
    from tidefold.functions.predicates import pending

    assert [r.id for r in i.filter(pending(NOW)).collect()] == ["p"]
    gone = by(M.revoke_invite(i, "p", NOW).tables["invites"], "id", "expires_at")
    assert gone["p"] == NOW and by(M.revoke_invite(i, "e", NOW).tables["invites"], "id", "expires_at")["e"] == NOW - HOUR
    with pytest.raises(M.Refused, match="invite_not_found"):
        M.revoke_invite(i, "zz", NOW)
    for hours in (0, 721):
        with pytest.raises(ValueError):
            M.mint_invite(i, "n", "h", 1, NOW, hours)
    assert by(M.mint_invite(i, "n", "h", 1, NOW).tables["invites"], "id", "expires_at")["n"] == NOW + 168 * HOUR
    u, s = users(spark, *BASE), spark.createDataFrame([], schema("settings"))
    with pytest.raises(M.Refused, match="registration_mode_unconfigured"):
        M.registration_mode(s)
    s = M.seed_setting(s, NOW).tables["table"]
    assert M.registration_mode(s) == "invite_only" and M.seed_setting(s, NOW).tables["table"].count() == 1
    assert M.registration_mode(M.set_registration_mode(u, s, 1, "open", NOW).tables["settings"]) == "open"
    with pytest.raises(M.Refused, match="root_admin_required"):
        M.set_registration_mode(u, s, 2, "open", NOW)


def test_registration(spark):
    u = users(spark, *BASE)
    i = invites(spark, ("p", "tp", NOW, NOW + DAY, None), ("q", "tq", NOW, NOW + DAY, None), ("e", "te", NOW, NOW, None))
    asks = [
        (1, "  ", 20, "tp"), (2, "a@x.com", 11, "tp"), (3, "a@x.com", 12, None), (4, "a@x.com", 12, "te"), (5, "ANN@x.com", 12, "tp"), (6, "New@x.com ", 12, " tp "),
        (7, "b@x.com", 12, "tp"), (8, "new@X.com", 12, "tq"), (9, "c@x.com", 12, "tq"), (10, "c@x.com", 12, "bogus"),
    ]
    commands = spark.createDataFrame([(s, e, n, "h", t) for s, e, n, t in asks], "seq int, email string, password_length int, password_hash string, token string")
    settings = M.seed_setting(spark.createDataFrame([], schema("settings")), NOW).tables["table"]
    done = M.register(u, i, settings, commands, NOW)
    assert by(done.outcomes, "seq", "code") == {
        1: "invalid_email", 2: "weak_password", 3: "invite_required", 4: "invalid_invite_token", 5: "email_already_exists", 6: "ok", 7: "invalid_invite_token", 8: "email_already_taken", 9: "ok", 10: "invalid_invite_token",
    }
    assert by(done.tables["users"].filter("id > 4"), "id", "email") == {5: "new@x.com", 6: "c@x.com"}
    assert by(done.tables["invites"], "id", "used_by_user_id") == {"p": 5, "q": 6, "e": None}
    opened = M.set_registration_mode(u, settings, 1, "open", NOW).tables["settings"]
    done = M.register(u, i, opened, commands.filter("seq IN (3, 4, 7)"), NOW)
    assert by(done.outcomes, "seq", "code") == {3: "ok", 4: "invalid_invite_token", 7: "ok"}


def test_agents(spark):
    u = users(spark, *BASE)
    a = agents(
        spark, ("stale", 3, NOW - 120 * DAY, NOW - 100 * DAY, None, "1"), ("fresh", 3, NOW - 10 * DAY, NOW - 5 * DAY, None, "1"), ("gone", 3, NOW - 200 * DAY, NOW - 180 * DAY, NOW - 150 * DAY, "1"),
        ("never", 3, NOW - 200 * DAY, None, None, None), ("edge", 3, NOW - 200 * DAY, NOW - 90 * DAY, None, None),
    )
    done = M.revoke_stale(a, NOW)
    assert done.count == 1 and done.values["cutoff"] == "2024-02-01T12:00:00+00:00"
    assert by(done.tables["agents"], "id", "revoked_at") == {"stale": NOW, "fresh": None, "gone": NOW - 150 * DAY, "never": None, "edge": None}
    beats = spark.createDataFrame([("fresh", NOW - DAY, "2"), ("fresh", NOW, None), ("gone", NOW, "9"), ("who", NOW, "9"), ("never", NOW, None)], "agent_id string, at timestamp, client_version string")
    done = M.heartbeat(a, beats)
    got = by(done.tables["agents"], "id", "last_seen_at", "client_version")
    assert got["fresh"] == (NOW, "2") and got["gone"] == (NOW - 180 * DAY, "1") and got["never"] == (NOW, None) and got["stale"] == (NOW - 100 * DAY, "1")
    assert by(done.outcomes, "agent_id", "accepted") == {"fresh": True, "gone": False, "who": False, "never": True}
    codes = spark.createDataFrame([(1, 3, "n1", "pc", "t", "1"), (2, None, "n2", "pc", "t2", "1"), (3, 1, "n3", "pc", "t3", "1"), (4, 88, "n4", "pc", "t4", "1")], "seq int, user_id int, agent_id string, machine_name string, api_token_hash string, client_version string")
    done = M.register_agents(u, a, codes, NOW)
    assert by(done.outcomes, "seq", "code") == {1: "ok", 2: "invalid_registration_code", 3: "admin_cannot_register_agent", 4: "admin_cannot_register_agent"}
    assert done.tables["agents"].filter("id = 'n1' AND created_at = last_seen_at").count() == 1
    with pytest.raises(M.Refused, match="agent_not_found"):
        M.revoke_own_agent(a, "fresh", 2, NOW)
    assert by(M.revoke_own_agent(a, "gone", 3, NOW).tables["agents"], "id", "revoked_at")["gone"] == NOW - 150 * DAY


def test_reassignment_and_undo(spark):
    u = users(spark, *BASE)
    a = agents(spark, ("a1", 1, NOW, None, None, None), ("a2", 2, NOW, None, None, None), ("a3", 3, NOW, None, None, None))
    log = spark.createDataFrame([], schema("reassignment_log"))
    done = M.reassign_agents(u, a, log, "ANN@x.com", NOW)
    assert done.count == 2 and by(done.tables["agents"], "id", "user_id") == {"a1": 3, "a2": 3, "a3": 3}
    assert by(done.tables["reassignment_log"], "id", "agent_id", "prior_user_id", "new_user_id") == {1: ("a1", 1, 3), 2: ("a2", 2, 3)}
    for email, code in (("no@x.com", "target_not_found"), ("boss@x.com", "target_is_admin")):
        with pytest.raises(M.Refused, match=code):
            M.reassign_agents(u, a, log, email, NOW)
    assert M.reassign_agents(u, a.filter("user_id = 3"), log, "no@x.com", NOW).count == 0
    back = M.undo_reassignment(u.filter("id <> 2"), done.tables["agents"], done.tables["reassignment_log"])
    assert by(back.tables["agents"], "id", "user_id") == {"a1": 1, "a2": 3, "a3": 3} and back.tables["reassignment_log"].isEmpty()
    twice = done.tables["reassignment_log"].union(spark.createDataFrame([(3, "a1", 3, 3, NOW)], schema("reassignment_log")))
    assert by(M.undo_reassignment(u, done.tables["agents"], twice).tables["agents"], "id", "user_id")["a1"] == 3


def test_uploads(spark):
    files, ups = spark.createDataFrame([], schema("files")), spark.createDataFrame([], schema("uploads"))
    rows = [
        (1, b"one", "decklist", "a.xml", 3, "a3", NOW), (2, b"one", "match-log", None, 2, "a2", NOW), (3, b"more", "unknown", "game.log", 3, "a3", NOW), (4, None, None, None, 3, "a3", NOW),
        (5, b"123456", None, None, 3, "a3", NOW), (6, b"x", "movie", None, 3, "a3", NOW), (7, b"", None, None, 3, "a3", NOW),
    ]
    kinds = "seq int, content binary, content_type string, original_filename string, user_id int, agent_registration_id string, uploaded_at timestamp"
    done = uploads.upload(files, ups, spark.createDataFrame(rows, kinds), 5)
    assert by(done.outcomes, "seq", "code", "deduped") == {1: ("ok", False), 2: ("ok", True), 3: ("ok", False), 4: ("missing_file", None), 5: ("file_too_large", None), 6: ("invalid_content_type", None), 7: ("ok", False)}
    assert done.tables["uploads"].count() == 4 and sorted(r.id for r in done.tables["uploads"].collect()) == [1, 2, 3, 4]
    kinds_of = by(done.tables["files"], "size_bytes", "content_type", "storage_path")
    assert kinds_of[0][1].endswith(".dat") and {v[0] for v in kinds_of.values()} == {"decklist", "unknown", "match-log"}
    assert done.tables["events"].count() == 3 and "+00:00" in done.tables["events"].first().payload
    again = uploads.upload(done.tables["files"], done.tables["uploads"], spark.createDataFrame([(8, b"more", "decklist", None, 2, "a2", NOW)], kinds))
    assert again.tables["events"].count() == again.tables["blobs"].count() == 0 and again.tables["files"].count() == 3 and again.tables["uploads"].count() == 5


def test_rules(spark):
    bad = spark.createDataFrame([("a" * 65, -1, "movie", None, NOW), ("b", 1, "unknown", "p", NOW)], "sha256 string, size_bytes long, content_type string, storage_path string, first_uploaded_at timestamp")
    assert [set(r.broken) for r in broken_rules(bad, "files").collect()] == [{"sha256_too_long", "size_bytes_negative", "content_type_unknown", "storage_path_missing"}]
    assert {(r.rule, r.value) for r in repeated_keys(users(spark, (1, "A@x", "user", False), (2, "a@X", "user", False)), "users").collect()} == {("lower(email)", "a@x")}


def test_arrival_numbers_far_apart(spark):
    df = spark.createDataFrame([(k * 10**12,) for k in range(500)] + [(7,)], "seq long")
    got = sorted((r.seq, r.number) for r in M.numbered(df, M.arrival(df), "seq").collect())
    assert [n for _, n in got] == list(range(1, 502)) and df.select(M.arrival(df)).distinct().count() == 1


def test_registrations_in_chains(spark):
    """Commands that race for addresses and tokens at once, against one after the other."""
    import random

    rng = random.Random(4)
    i = invites(spark, *((f"i{k}", f"t{k}", NOW, NOW + DAY, None) for k in range(12)))
    asks = [(s, f"e{rng.randrange(14)}@x.com", rng.choice([5, 20, 20, 20]), f"t{rng.randrange(15)}") for s in range(60)]
    commands = spark.createDataFrame([(s, e, n, "h", t) for s, e, n, t in asks], "seq int, email string, password_length int, password_hash string, token string")
    settings = M.seed_setting(spark.createDataFrame([], schema("settings")), NOW).tables["table"]
    used, taken, want = set(), set(), {}
    for s, e, n, t in asks:
        want[s] = "weak_password" if n < 12 else "invalid_invite_token" if int(t[1:]) > 11 or t in used else "email_already_taken" if e in taken else "ok"
        if want[s] == "ok":
            used.add(t)
            taken.add(e)
    assert by(M.register(users(spark, *BASE), i, settings, commands, NOW).outcomes, "seq", "code") == want


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    """M14 and M16 report their counts without a job of their own once the tables are written; before that, one pass gives them."""
    tracker = spark.sparkContext.statusTracker()
    a = agents(spark, ("old", 3, NOW - 120 * DAY, NOW - 100 * DAY, None, "1"), ("new", 3, NOW - 10 * DAY, NOW - 5 * DAY, None, "1"), ("gone", 3, NOW - 200 * DAY, NOW - 180 * DAY, NOW - 150 * DAY, "1"))
    made = M.revoke_stale(a, NOW, 90)
    spark.sparkContext.setJobGroup("write", "")
    made.tables["agents"].write.parquet(str(tmp_path / "agents"))
    spark.sparkContext.setJobGroup("count", "")
    assert made.count == 1 and made.count == 1
    assert len(tracker.getJobIdsForGroup("write")) == 1 and len(tracker.getJobIdsForGroup("count")) == 0
    early = M.revoke_stale(a, NOW, 90)
    spark.sparkContext.setJobGroup("early", "")
    assert early.count == 1 and early.count == 1 and len(tracker.getJobIdsForGroup("early")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_replayed_hashes(spark):
    """Of many uses of one hash the first has it; uses without a hash have none."""
    u, s = users(spark, *BASE), sessions(spark, ("s1", 3, "h1", NOW + DAY, None), ("s2", 3, "h2", NOW + DAY, None))
    asks = spark.createDataFrame([(k, "h1", f"n{k}", f"x{k}", None, None) for k in range(50, 0, -1)] + [(99, None, "n", "x", None, None), (98, "h9", "n", "x", None, None), (97, "h2", "n97", "x97", None, None)], "seq int, old_hash string, new_hash string, session_id string, user_agent string, ip string")
    done = M.rotate(u, s, asks, NOW)
    assert sorted(r.seq for r in done.outcomes.filter("code = 'ok'").collect()) == [1, 97] and done.outcomes.count() == 53
    assert sorted(r.id for r in done.tables["sessions"].filter("revoked_at IS NULL").collect()) == ["x1", "x97"]


def test_versions_at_one_moment(spark):
    a = agents(spark, ("a", 3, NOW - DAY, NOW - DAY, None, "0"))
    beats = spark.createDataFrame([("a", NOW, v) for v in ("1", "3", None, "2")], "agent_id string, at timestamp, client_version string")
    assert M.heartbeat(a, beats).tables["agents"].first().client_version == "3"
