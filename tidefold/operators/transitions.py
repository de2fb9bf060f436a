"""State changes as pure functions: frames and commands in, frames and outcomes out. Nothing is written here; see ``sources.versions``.

Commands that come in numbers (logins, refreshes, heartbeats, registrations) are frames, one row each with an arrival number ``seq``; the
earliest valid one wins what only one can have. Commands of an administrator are arguments. Every change takes ``as_of``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidefold.functions import predicates as P
from tidefold.functions import scalars as X
from tidefold.functions.predicates import Moment, moment
from tidefold.operators.relational import removed
from tidefold.schemas import MODES, ROLES, check_any, check_limits, check_text, schema

REFRESH_SECONDS = 2_592_000
#: Fixed value: the root administrator, who alone may set the registration mode.
ROOT = 1


class Refused(ValueError):
    """The command is not allowed; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class Counted:
    """A count of the rows that a command changed, taken by the pass that writes them."""

    def __init__(self) -> None:
        self.seen, self.df = Observation(), None

    def of(self, df: DataFrame, hit: Column) -> DataFrame:
        self.df = df.observe(self.seen, F.count_if(hit).alias("n"))
        return self.df

    def __call__(self) -> int:
        if not self.seen._jo.future().isCompleted():  # nobody has written the table yet: one pass that keeps nothing
            self.df.write.format("noop").mode("overwrite").save()
        return int(self.seen.get["n"])


@dataclass(frozen=True)
class Change:
    """The tables that changed, the outcome of each command where there are many, and a count where the service reports one.

    ``count`` asks nothing of Spark once the changed table has been written whole (a first action that stops early, such as ``take``, counts early, too); before, it runs the table once."""

    tables: dict[str, DataFrame]
    outcomes: DataFrame | None = None
    counted: int | Counted | None = None
    values: dict[str, object] = field(default_factory=dict)

    @property
    def count(self) -> int | None:
        return self.counted() if isinstance(self.counted, Counted) else self.counted


def changed(df: DataFrame, condition: Column, counted: Counted | None = None, **new: Column | object) -> DataFrame:
    """``df`` with new values in the rows that fulfil the condition: a projection, whatever the number of rows."""
    hit = F.coalesce(condition, F.lit(False))
    kinds = dict(df.dtypes)
    df = df if counted is None else counted.of(df, hit)
    return df.withColumns({c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items()})


def appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.union(rows.select(*(F.col(c).cast(kinds[c]) for c in df.columns)))


def _one(df: DataFrame, name: str, **values: object) -> DataFrame:
    spark = df.sparkSession
    types = {f.name: f.dataType for f in schema(name)}
    return spark.range(1).select(*((v if isinstance(v, Column) else F.lit(v)).cast(types[c]).alias(c) for c, v in ((c, values.get(c)) for c in df.columns)))


def _next(df: DataFrame, key: str = "id") -> int:
    return int(df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]) + 1


def numbered(df: DataFrame, bucket: Column, *order: str, name: str = "number") -> DataFrame:
    """``df`` with ``name``, 1, 2, 3 ... in the order. ``bucket`` must rise with the order: rows are numbered within buckets, and only the buckets' counts meet in one place."""
    dealt = df.withColumn("__bucket", bucket)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    return inside.join(counts.select(F.col("__bucket").alias("__b"), "__before"), F.col("__bucket").eqNullSafe(F.col("__b"))).withColumn(name, F.col(name) + F.col("__before")).drop("__bucket", "__b", "__before")


def arrival(df: DataFrame, seq: str = "seq") -> Column:
    """Buckets of about 65,536 rows, if arrival numbers are spread evenly between the least and the largest."""
    low, high, many = df.agg(F.min(seq), F.max(seq), F.count(F.lit(1))).first()
    if not many or low is None:
        return F.lit(0)
    return F.floor((F.col(seq) - low) / ((int(high) - int(low)) // (many // 65_536 + 1) + 1))


def _user(users: DataFrame, user_id: int):
    row = users.filter(P.key_is("id", user_id)).select("id", "role", "disabled").first()
    if row is None:
        raise Refused("user_not_found")
    return row


def active_admins(users: DataFrame) -> int:
    return users.filter(P.active_admin()).count()


# --- insert-or-ignore, insert-or-update -----------------------------------------------------------------------------


def insert_or_ignore(df: DataFrame, rows: DataFrame, key: str, *order: str) -> Change:
    """Rows whose key is new are added, the first of each key by ``order``; outcomes are the keys with ``inserted``."""
    first = Window.partitionBy(key).orderBy(*(order or (key,)))
    best = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    new = best.join(df.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    had = best.select(key).join(new.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left").select(key, F.col("__key").isNotNull().alias("inserted"))
    return Change({"table": appended(df, new)}, had)


def insert_or_update(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` and the rows of ``df`` with other keys."""
    return appended(df.join(rows.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti"), rows)


# --- sessions -------------------------------------------------------------------------------------------------------


def login(users: DataFrame, sessions: DataFrame, attempts: DataFrame, as_of: Moment) -> Change:
    """M1. ``attempts``: seq, email, verified (was the password right), session_id, refresh_token_hash, user_agent, ip. An unknown or disabled user
    and a wrong password give the same answer."""
    u = users.select(F.col("id").alias("user_id"), F.lower("email").alias("__email"), "disabled")
    tried = attempts.join(u, F.lower("email") == F.col("__email"), "left")
    good = F.col("user_id").isNotNull() & ~F.coalesce("disabled", F.lit(True)) & F.coalesce("verified", F.lit(False))
    new = tried.filter(good).select(
        F.col("session_id").alias("id"), "user_id", "refresh_token_hash", moment(as_of).alias("issued_at"), X.after(moment(as_of), seconds=REFRESH_SECONDS).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("revoked_at"), "user_agent", "ip",
    )
    return Change({"sessions": appended(sessions, new)}, tried.select("seq", F.when(good, "ok").otherwise("invalid_credentials").alias("code")))


def rotate(users: DataFrame, sessions: DataFrame, requests: DataFrame, as_of: Moment) -> Change:
    """M2. ``requests``: seq, old_hash, new_hash, session_id, user_agent, ip. The old session is revoked and a new one begins together; a second use of
    the same hash is refused."""
    owners = users.select(F.col("id").alias("__owner"), "disabled")
    held = sessions.join(owners, F.col("user_id") == F.col("__owner"), "left").withColumn("__valid", F.coalesce(F.col("__owner").isNotNull() & P.valid_session(as_of), F.lit(False))).drop("__owner", "disabled")
    # the first use of each hash, with what it asks for, is a pre-aggregated minimum: a hash that is replayed very often is not sorted by one task. Sessions meet it once, and give their old and their new row
    # together; what nobody reads of either is not shuffled
    asked = {"__sid": "session_id", "__new": "new_hash", "__agent": "user_agent", "__ip": "ip"}
    first = requests.groupBy(F.col("old_hash").alias("__hash")).agg(F.min("seq").alias("__first"), *(F.min_by(c, "seq").alias(n) for n, c in asked.items()))
    met = held.join(first, F.col("refresh_token_hash") == F.col("__hash"), "left")
    won = F.col("__first").isNotNull() & F.col("__valid")
    rows = met.select("*", F.explode(F.when(won, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__row")).withColumn("__won", won)
    begun = {
        "id": F.col("__sid"), "refresh_token_hash": F.col("__new"), "issued_at": moment(as_of), "expires_at": X.after(moment(as_of), seconds=REFRESH_SECONDS), "revoked_at": F.lit(None).cast("timestamp"),
        "user_agent": F.col("__agent"), "ip": F.col("__ip"), "user_id": F.col("user_id"),
    }
    kept = {c: F.col(c) for c in sessions.columns} | {"revoked_at": F.when(F.col("__won"), moment(as_of)).otherwise(F.col("revoked_at"))}
    after = rows.select(*(F.when(F.col("__row") == 1, begun.get(f.name, F.lit(None)).cast(f.dataType)).otherwise(kept[f.name]).cast(f.dataType).alias(f.name) for f in sessions.schema))
    winners = met.filter(won).select(F.col("__hash").alias("__old"), F.col("__first").alias("__seq"))
    tried = requests.join(winners, (F.col("old_hash") == F.col("__old")) & (F.col("seq") == F.col("__seq")), "left")
    return Change({"sessions": after}, tried.select("seq", F.when(F.col("__seq").isNotNull(), "ok").otherwise("invalid_credentials").alias("code")))


def logout(sessions: DataFrame, ids: DataFrame, as_of: Moment) -> Change:
    """M3. ``ids``: session ids. Unknown and revoked ones are ignored; the first revocation's time stays."""
    return Change({"sessions": _revoked(sessions, ids, as_of)})


def _revoked(df: DataFrame, ids: DataFrame, as_of: Moment) -> DataFrame:
    wanted = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    return changed(df.join(wanted, F.col("id") == F.col("__id"), "left"), F.col("__id").isNotNull() & P.not_revoked(), revoked_at=moment(as_of)).drop("__id")


def revoke_sessions(users: DataFrame, sessions: DataFrame, user_id: int, as_of: Moment) -> Change:
    """M14. All sessions of a user; counts those that were active."""
    _user(users, user_id)
    active = P.active_of(user_id)
    n = Counted()
    return Change({"sessions": changed(sessions, active, n, revoked_at=moment(as_of))}, counted=n)


# --- users ----------------------------------------------------------------------------------------------------------


def change_email(users: DataFrame, user_id: int, email: str, as_of: Moment) -> Change:
    """M4. Stored trimmed and in lower case; the own address again is fine."""
    wanted = check_text("email", email, 1, 320).strip().lower()
    if not wanted:
        raise Refused("invalid_email")
    _user(users, user_id)
    if not users.filter(P.email_taken("email", wanted, "id", user_id)).isEmpty():
        raise Refused("email_already_exists")
    return Change({"users": changed(users, P.key_is("id", user_id), email=wanted, updated_at=moment(as_of))})


def change_password(users: DataFrame, sessions: DataFrame, user_id: int, password_hash: str, as_of: Moment) -> Change:
    """M5. Every active session of the user ends at the same moment."""
    _user(users, user_id)
    new = changed(users, P.key_is("id", user_id), password_hash=password_hash, must_change_password=False, updated_at=moment(as_of))
    return Change({"users": new, "sessions": changed(sessions, P.active_of(user_id), revoked_at=moment(as_of))})


def create_user(users: DataFrame, email: str, password_hash: str, role: str, must_change_password: bool, as_of: Moment) -> Change:
    """M6. Conflicts regardless of case; the address is stored as typed."""
    check_text("email", email, 1, 320)
    if role not in ROLES:
        raise Refused("invalid_role")
    if not users.filter(P.same_ignoring_case("email", email)).isEmpty():
        raise Refused("email_already_exists")
    key = _next(users)
    row = _one(users, "users", id=key, email=email, password_hash=password_hash, role=role, must_change_password=must_change_password, disabled=False, created_at=moment(as_of), updated_at=moment(as_of))
    return Change({"users": appended(users, row)}, values={"user_id": key})


def update_user(users: DataFrame, admin_id: int, user_id: int, as_of: Moment, role: str | None = None, disabled: bool | None = None, must_change_password: bool | None = None) -> Change:
    """M7. Only given fields change. Nobody disables themself; the last active administrator keeps the role."""
    check_any(role=role, disabled=disabled, must_change_password=must_change_password)
    target = _user(users, user_id)
    if disabled is True and admin_id == user_id:
        raise Refused("cannot_disable_self")
    if role == "user" and target.role == "admin" and not target.disabled and active_admins(users) <= 1:
        raise Refused("cannot_demote_last_admin")
    given = {c: v for c, v in (("role", role), ("disabled", disabled), ("must_change_password", must_change_password)) if v is not None}
    return Change({"users": changed(users, P.key_is("id", user_id), updated_at=moment(as_of), **given)})


def delete_user(tables: dict[str, DataFrame], admin_id: int, user_id: int) -> Change:
    """M8. With all that belongs to the user; stored files stay."""
    if admin_id == user_id:
        raise Refused("cannot_delete_self")
    users = tables["users"]
    target = _user(users, user_id)
    if target.role == "admin" and not target.disabled and active_admins(users) <= 1:
        raise Refused("cannot_delete_last_admin")
    return Change(removed(tables, "users", users.filter(P.key_is("id", user_id)).select("id")))


def reset_password(users: DataFrame, user_id: int, password_hash: str, as_of: Moment) -> Change:
    """M13. Must be changed at the next login; sessions go on."""
    _user(users, user_id)
    return Change({"users": changed(users, P.key_is("id", user_id), password_hash=password_hash, must_change_password=True, updated_at=moment(as_of))})


def bootstrap_admin(users: DataFrame, email: str, password_hash: str, must_change_password: bool, as_of: Moment) -> Change:
    """M18. Only where no enabled administrator is there."""
    if not users.filter(P.active_admin()).limit(1).isEmpty():
        return Change({"users": users}, counted=0)
    key = _next(users)
    row = _one(users, "users", id=key, email=email, password_hash=password_hash, role="admin", must_change_password=must_change_password, disabled=False, created_at=moment(as_of), updated_at=moment(as_of))
    return Change({"users": appended(users, row)}, counted=1, values={"user_id": key})


# --- invitations and registration ---------------------------------------------------------------------------------


def mint_invite(invites: DataFrame, invite_id: str, token_hash: str, admin_id: int, as_of: Moment, hours: int = 168) -> Change:
    """M11."""
    check_limits(hours=(hours, 1, 720))
    row = _one(invites, "invites", id=invite_id, token_hash=token_hash, created_by_user_id=admin_id, created_at=moment(as_of), expires_at=X.after(moment(as_of), hours=hours))
    return Change({"invites": appended(invites, row)})


def revoke_invite(invites: DataFrame, invite_id: str, as_of: Moment) -> Change:
    """M12. A pending one expires now; used and expired ones stay as they are, which is no failure. The row is kept."""
    if invites.filter(P.uuid_is("id", invite_id)).isEmpty():
        raise Refused("invite_not_found")
    return Change({"invites": changed(invites, P.uuid_is("id", invite_id) & P.pending(as_of), expires_at=moment(as_of))})


def registration_mode(settings: DataFrame) -> str:
    row = settings.filter(P.key_is("key", "registration_mode")).select(X.registration_mode("value").alias("mode")).first()
    if row is None:
        raise Refused("registration_mode_unconfigured")
    return row.mode


def set_registration_mode(users: DataFrame, settings: DataFrame, admin_id: int, mode: str, as_of: Moment) -> Change:
    """M17. Only the root administrator may."""
    if mode not in MODES:
        raise Refused("invalid_mode")
    if admin_id != ROOT or users.filter(P.key_is("id", admin_id) & P.active_admin()).isEmpty():
        raise Refused("root_admin_required")
    row = _one(settings, "settings", key="registration_mode", value=f'"{mode}"', updated_at=moment(as_of), updated_by_user_id=admin_id)
    return Change({"settings": insert_or_update(settings, row, "key")})


def seed_setting(settings: DataFrame, as_of: Moment, key: str = "registration_mode", value: str = '"invite_only"') -> Change:
    """M23."""
    return insert_or_ignore(settings, _one(settings, "settings", key=key, value=value, updated_at=moment(as_of)), "key")


def _kept(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, where the session has a checkpoint folder; else cached."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df.cache()


def register(users: DataFrame, invites: DataFrame, settings: DataFrame, commands: DataFrame, as_of: Moment, min_password: int = 12, rounds: int = 1000) -> Change:
    """M9 and M10. ``commands``: seq, email, password_length, password_hash, token. The checks go in this order: blank address, weak password, token needed,
    token valid, address taken. Of commands that want one token or one address the earliest that passes wins; the others get the code of what
    they lost. A command that fails leaves its token unused, so that a later one can have it. Accounts are numbered in arrival order."""
    mode = registration_mode(settings)
    token = X.stripped(F.coalesce("token", F.lit("")))
    c = commands.select("seq", X.clean_email("email").alias("email"), "password_length", "password_hash", F.when(token != "", F.sha2(token, 256)).alias("token_hash"))
    open_ = invites.filter(P.pending(as_of)).select(F.col("token_hash").alias("__token"), F.col("id").alias("invite_id"))
    taken = users.select(F.lower("email").alias("__email")).distinct()
    c = c.join(open_, F.col("token_hash") == F.col("__token"), "left").join(taken, F.col("email") == F.col("__email"), "left")
    code = (
        F.when(F.col("email").isNull(), "invalid_email").when(F.coalesce("password_length", F.lit(0)) < min_password, "weak_password")
        .when(F.col("token_hash").isNull() & F.lit(mode == "invite_only"), "invite_required")
        .when(F.col("token_hash").isNotNull() & F.col("invite_id").isNull(), "invalid_invite_token")
        .when(F.col("__email").isNotNull(), "email_already_exists")
    )
    c = _kept(c.withColumn("code", code).drop("__token", "__email"))
    settled, left = [c.filter("code IS NOT NULL")], c.filter("code IS NULL")
    for _ in range(rounds):  # a round settles the earliest command of every address and token
        if left.isEmpty():
            break
        # the earliest of each key, pre-aggregated; commands without a token have no group
        firsts = {k: left.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__{k}")).agg(F.min("seq").alias(f"__first_{k}")) for k in ("email", "token_hash")}
        for k, first in firsts.items():
            left = left.join(first, F.col(k) == F.col(f"__{k}"), "left").drop(f"__{k}")
        wins = (F.col("seq") == F.col("__first_email")) & (F.col("token_hash").isNull() | (F.col("seq") == F.col("__first_token_hash")))
        left = _kept(left.withColumn("code", F.when(wins, "ok")).drop("__first_email", "__first_token_hash"))
        won, rest = left.filter("code = 'ok'"), left.filter("code IS NULL")
        for k in firsts:
            rest = rest.join(won.select(F.col(k).alias(f"__{k}")).filter(F.col(f"__{k}").isNotNull()), F.col(k) == F.col(f"__{k}"), "left")
        lost = F.when(F.col("__token_hash").isNotNull(), "invalid_invite_token").when(F.col("__email").isNotNull(), "email_already_taken")
        rest = _kept(rest.withColumn("code", lost).drop("__email", "__token_hash"))
        settled += [won, rest.filter("code IS NOT NULL")]
        left = rest.filter("code IS NULL")
    else:
        raise RuntimeError("registrations did not settle")
    c = unioned(settled)
    won = c.filter("code = 'ok'")
    # a token comes before an address: who would have come too late for both hears of the token
    used = won.filter("token_hash IS NOT NULL").select(F.col("token_hash").alias("__token"), F.col("seq").alias("__used"))
    late = F.col("code").isin("email_already_exists", "email_already_taken") & (F.col("__used") < F.col("seq"))
    outcomes = c.join(used, F.col("token_hash") == F.col("__token"), "left").select("seq", F.when(late, "invalid_invite_token").otherwise(F.col("code")).alias("code"))
    first = _next(users)
    placed = numbered(won, arrival(won), "seq").withColumn("id", F.col("number") + (first - 1))
    now = moment(as_of)
    new = placed.select("id", "email", "password_hash", F.lit("user").alias("role"), F.lit(False).alias("must_change_password"), F.lit(False).alias("disabled"), now.alias("created_at"), now.alias("updated_at"))
    used = placed.filter("invite_id IS NOT NULL").select(F.col("invite_id").alias("__invite"), F.col("id").alias("__user"))
    stamped = changed(invites.join(used, F.col("id") == F.col("__invite"), "left"), F.col("__invite").isNotNull(), used_at=now, used_by_user_id=F.col("__user")).drop("__invite", "__user")
    return Change({"users": appended(users, new), "invites": stamped}, outcomes)


# --- agents ---------------------------------------------------------------------------------------------------------


def register_agents(users: DataFrame, agents: DataFrame, consumed: DataFrame, as_of: Moment) -> Change:
    """M19 and T3. ``consumed``: seq, user_id (of the code; null: no such code), agent_id, machine_name, api_token_hash, client_version. A code is used up even if its
    owner is gone or an administrator."""
    u = users.select(F.col("id").alias("__owner"), "role")
    tried = consumed.join(u, F.col("user_id") == F.col("__owner"), "left")
    code = F.when(F.col("user_id").isNull(), "invalid_registration_code").when(F.coalesce("role", F.lit("")) != "user", "admin_cannot_register_agent").otherwise("ok")
    tried = tried.withColumn("code", code)
    now = moment(as_of)
    new = tried.filter("code = 'ok'").select(
        F.col("agent_id").alias("id"), "user_id", "machine_name", "api_token_hash", now.alias("created_at"), now.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("revoked_at"), "client_version"
    )
    return Change({"agents": appended(agents, new)}, tried.select("seq", "code"))


def revoke_agents(agents: DataFrame, ids: DataFrame, as_of: Moment) -> Change:
    """M15. The first revocation's time stays."""
    return Change({"agents": _revoked(agents, ids, as_of)})


def revoke_own_agent(agents: DataFrame, agent_id: str, owner: int, as_of: Moment) -> Change:
    """M15 for an owner: a missing agent and someone else's give one answer."""
    own = P.owned_row("id", agent_id.lower(), owner)
    if agents.filter(own).isEmpty():
        raise Refused("agent_not_found")
    return Change({"agents": changed(agents, own & P.not_revoked(), revoked_at=moment(as_of))})


def revoke_stale(agents: DataFrame, as_of: Moment, days: int = 90) -> Change:
    """M16. Count and cutoff are reported; all get one moment."""
    check_limits(stale_days=(days, 1, 3650))
    old = P.stale(as_of, days)
    cutoff = agents.sparkSession.range(1).select(X.iso_format(moment(as_of) - F.make_dt_interval(days=F.lit(days))).alias("c")).first().c
    n = Counted()
    return Change({"agents": changed(agents, old, n, revoked_at=moment(as_of))}, counted=n, values={"cutoff": cutoff})


def heartbeat(agents: DataFrame, beats: DataFrame) -> Change:
    """T4 and W2 in batch. ``beats``: agent_id, at, client_version. The latest moment wins; the version is that of the latest beat that has one. Beats of revoked
    agents are refused: outcomes are agent_id and accepted."""
    # of two versions at one moment the greater one
    latest = beats.groupBy("agent_id").agg(F.max("at").alias("__at"), F.max_by("client_version", F.when(F.col("client_version").isNotNull(), F.struct("at", "client_version"))).alias("__version"))
    joined = agents.join(latest, F.col("id") == F.col("agent_id"), "left")
    live = F.col("agent_id").isNotNull() & P.not_revoked()
    new = changed(joined, live, last_seen_at=F.greatest("last_seen_at", "__at"), client_version=F.coalesce("__version", "client_version"))
    known = agents.filter(P.not_revoked()).select(F.col("id").alias("__id"))
    outcomes = latest.join(known, F.col("agent_id") == F.col("__id"), "left").select("agent_id", F.col("__id").isNotNull().alias("accepted"))
    return Change({"agents": new.select(*agents.columns)}, outcomes)


# --- reassignment ---------------------------------------------------------------------------------------------------


def reassign_agents(users: DataFrame, agents: DataFrame, log: DataFrame, target_email: str, as_of: Moment) -> Change:
    """M21. Agents of administrators go to the user with that address; every move is logged, in the order of agent ids. Nothing to do leaves all as it is; a missing
    target, or one that is an administrator, stops it before any move."""
    admins = users.filter(F.col("role") == "admin").select(F.col("id").alias("__admin"))
    moves = _kept(agents.join(admins, F.col("user_id") == F.col("__admin"), "left_semi").select(F.col("id").alias("agent_id"), F.col("user_id").alias("prior_user_id")))
    many = moves.count()
    if not many:
        return Change({"agents": agents, "reassignment_log": log}, counted=0)
    target = users.filter(P.same_ignoring_case("email", target_email)).select("id", "role").first()
    if target is None:
        raise Refused("reassignment_target_not_found")
    if target.role == "admin":
        raise Refused("reassignment_target_is_admin")
    placed = numbered(moves, F.substring("agent_id", 1, 4), "agent_id")
    logged = placed.select((F.col("number") + (_next(log) - 1)).alias("id"), "agent_id", "prior_user_id", F.lit(target.id).alias("new_user_id"), moment(as_of).alias("reassigned_at"))
    moved = agents.join(admins, F.col("user_id") == F.col("__admin"), "left")
    return Change({"agents": changed(moved, F.col("__admin").isNotNull(), user_id=target.id).select(*agents.columns), "reassignment_log": appended(log, logged)}, counted=many)


def undo_reassignment(users: DataFrame, agents: DataFrame, log: DataFrame) -> Change:
    """M22. The log in id order: the highest entry of an agent whose prior owner is still there wins. The log is empty afterwards."""
    there = log.join(users.select(F.col("id").alias("__user")), F.col("prior_user_id") == F.col("__user"), "left_semi")
    last = there.groupBy(F.col("agent_id").alias("__agent")).agg(F.max_by("prior_user_id", "id").alias("__prior"))
    back = agents.join(last, F.col("id") == F.col("__agent"), "left")
    return Change({"agents": changed(back, F.col("__agent").isNotNull(), user_id=F.col("__prior")).select(*agents.columns), "reassignment_log": log.limit(0)})


def unioned(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
