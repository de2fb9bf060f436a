"""Tables of the service as Spark schemas, with the rules that a write must keep.

Timestamps are instants under a UTC session. UUIDs are lower-case strings of 36 characters. JSON values are strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPEC: dict[str, str] = {
    "users": "id int NOT NULL, email string NOT NULL, password_hash string NOT NULL, role string NOT NULL, must_change_password boolean NOT NULL,"
    " disabled boolean NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "sessions": "id string NOT NULL, user_id int NOT NULL, refresh_token_hash string NOT NULL, issued_at timestamp NOT NULL, expires_at timestamp NOT NULL,"
    " revoked_at timestamp, user_agent string, ip string",
    "agents": "id string NOT NULL, user_id int NOT NULL, machine_name string NOT NULL, api_token_hash string NOT NULL, created_at timestamp NOT NULL,"
    " last_seen_at timestamp, revoked_at timestamp, client_version string",
    "settings": "key string NOT NULL, value string NOT NULL, updated_at timestamp NOT NULL, updated_by_user_id int",
    "invites": "id string NOT NULL, token_hash string NOT NULL, created_by_user_id int, created_at timestamp NOT NULL, expires_at timestamp NOT NULL,"
    " used_at timestamp, used_by_user_id int",
    "reassignment_log": "id int NOT NULL, agent_id string NOT NULL, prior_user_id int NOT NULL, new_user_id int NOT NULL, reassigned_at timestamp NOT NULL",
    "files": "sha256 string NOT NULL, size_bytes long NOT NULL, content_type string NOT NULL, storage_path string NOT NULL, first_uploaded_at timestamp NOT NULL",
    "uploads": "id long NOT NULL, sha256 string NOT NULL, user_id int NOT NULL, agent_registration_id string NOT NULL, uploaded_at timestamp NOT NULL,"
    " original_filename string",
    # payloads of topics: every field may be missing, unknown fields are ignored
    "file.ingested": "sha256 string, user_id int, agent_registration_id string, uploaded_at string, content_type string",
    "match.parsed": "match_id string, user_id string, game_count int, parsed_at string",
    "insight.requested": "match_id string, user_id string, request_id string",
    # an extension of ours: played matches, one row each; ``won`` null: drawn or unknown
    "matches": "match_id string NOT NULL, user_id int NOT NULL, opponent string, format string, event_type string, archetype_played string,"
    " archetype_faced string, played_at timestamp NOT NULL, won boolean",
}

#: Domains and lengths of columns.
ROLES = ("user", "admin")
CONTENT_TYPES = ("match-log", "decklist", "unknown")
MODES = ("open", "invite_only")
LENGTHS: dict[str, dict[str, int]] = {
    "users": {"email": 320, "password_hash": 128, "role": 32},
    "sessions": {"refresh_token_hash": 255, "user_agent": 512, "ip": 64},
    "agents": {"machine_name": 255, "api_token_hash": 255, "client_version": 64},
    "settings": {"key": 64},
    "invites": {"token_hash": 128},
    "files": {"sha256": 64, "content_type": 32, "storage_path": 512},
    "uploads": {"sha256": 64, "original_filename": 512},
}
DOMAINS: dict[str, dict[str, tuple[str, ...]]] = {"users": {"role": ROLES}, "files": {"content_type": CONTENT_TYPES}}
KEYS: dict[str, tuple[str, ...]] = {"users": ("id",), "sessions": ("id",), "agents": ("id",), "settings": ("key",), "invites": ("id",), "reassignment_log": ("id",), "files": ("sha256",), "uploads": ("id",)}
UNIQUE: dict[str, tuple[str, ...]] = {"users": ("lower(email)",), "sessions": ("refresh_token_hash",), "agents": ("api_token_hash",), "invites": ("token_hash",)}
#: (table, column, parent table, parent column, what a parent's removal does)
REFERENCES: tuple[tuple[str, str, str, str, str], ...] = (
    ("sessions", "user_id", "users", "id", "cascade"),
    ("agents", "user_id", "users", "id", "cascade"),
    ("uploads", "user_id", "users", "id", "cascade"),
    ("uploads", "agent_registration_id", "agents", "id", "cascade"),
    ("uploads", "sha256", "files", "sha256", "restrict"),
    ("settings", "updated_by_user_id", "users", "id", "set null"),
    ("invites", "created_by_user_id", "users", "id", "set null"),
    ("invites", "used_by_user_id", "users", "id", "set null"),
)


def schema(name: str) -> T.StructType:
    """The schema of a table or topic."""
    return T.StructType.fromDDL(_SPEC[name])


def broken_rules(df: DataFrame, name: str) -> DataFrame:
    """The rows that may not be written, with ``broken``, the names of the rules that each breaks; one pass, no shuffle."""
    rules: list[tuple[str, Column]] = [(f"{f.name}_missing", F.col(f.name).isNull()) for f in schema(name) if not f.nullable]
    rules += [(f"{c}_too_long", F.length(c) > n) for c, n in LENGTHS.get(name, {}).items()]
    rules += [(f"{c}_unknown", ~F.col(c).isin(*values)) for c, values in DOMAINS.get(name, {}).items()]
    if name == "files":
        rules.append(("size_bytes_negative", F.col("size_bytes") < 0))
    marks = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules)), lambda x: x.isNotNull())
    return df.withColumn("broken", marks).filter(F.size("broken") > 0)


def broken_arguments(df: DataFrame, limits: dict[str, tuple[float, float]] | None = None, texts: dict[str, tuple[int, int]] | None = None, any_of: tuple[str, ...] = ()) -> DataFrame:
    """The commands (rows) whose arguments are refused, with ``broken``, the names of those: numbers outside their limits or missing, texts that are too short, too long or missing, and ``any_of`` if none of
    these is given. The same rules as ``check_limits``, ``check_text`` and ``check_any``, for commands that come in numbers."""
    rules = [(name, F.col(name).isNull() | ~F.col(name).between(low, high)) for name, (low, high) in (limits or {}).items()]
    rules += [(name, F.col(name).isNull() | ~F.length(name).between(least, most)) for name, (least, most) in (texts or {}).items()]
    rules += [("any of " + ", ".join(any_of), reduce(Column.__and__, [F.col(c).isNull() for c in any_of]))] if any_of else []
    marks = F.filter(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in rules)), lambda x: x.isNotNull())
    return df.withColumn("broken", marks).filter(F.size("broken") > 0)


def repeated_keys(df: DataFrame, name: str) -> DataFrame:
    """Values that a key or a unique column holds more than once: ``rule``, ``value``, ``n``."""
    rules = [", ".join(KEYS[name]), *UNIQUE.get(name, ())]
    found = [df.groupBy(F.expr(rule).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), "value", "n") for rule in rules]
    return reduce(DataFrame.union, found)


def check_limits(**values: tuple[float | None, float, float]) -> None:
    """Each value must lie between its bounds; it is refused, never clamped."""
    for name, (value, low, high) in values.items():
        if value is None or isinstance(value, bool) or not low <= value <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")


def check_text(name: str, value: str | None, least: int, most: int) -> str:
    if value is None or not least <= len(value) <= most:
        raise ValueError(f"{name} must have {least} to {most} characters")
    return value


def check_any(**values: object) -> None:
    """A partial update needs a field at least."""
    if all(v is None for v in values.values()):
        raise ValueError("at least one of " + ", ".join(values) + " is needed")
