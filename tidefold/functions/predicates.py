"""Conditions as columns. Everything that depends on time takes ``as_of``; a moment equal to ``as_of`` counts as past."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = datetime | str | Column


def col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def moment(as_of: Moment) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def key_is(column: str | Column, value: int | str) -> Column:
    """Primary-key equality; pushed down to the scan."""
    return col(column) == F.lit(value)


def uuid_is(column: str | Column, value: str) -> Column:
    return col(column) == F.lit(value.lower())


def same_ignoring_case(column: str | Column, value: str) -> Column:
    return F.lower(col(column)) == F.lit(value.lower())


def email_taken(email: str | Column, value: str, key: str | Column, own: int) -> Column:
    """Someone else's row with that e-mail."""
    return same_ignoring_case(email, value) & (col(key) != F.lit(own))


def secret_is(hash_column: str | Column, secret: str | Column) -> Column:
    """The column holds the SHA-256 of the presented secret."""
    return col(hash_column) == F.sha2(secret if isinstance(secret, Column) else F.lit(secret), 256)


def not_revoked(revoked_at: str | Column = "revoked_at") -> Column:
    return col(revoked_at).isNull()


def live_secret(hash_column: str | Column, secret: str | Column, revoked_at: str | Column = "revoked_at") -> Column:
    return secret_is(hash_column, secret) & not_revoked(revoked_at)


def active_of(user: int, user_id: str | Column = "user_id", revoked_at: str | Column = "revoked_at") -> Column:
    """Sessions of a user that are not revoked (expired ones too)."""
    return (col(user_id) == F.lit(user)) & not_revoked(revoked_at)


def pending(as_of: Moment, used_at: str | Column = "used_at", expires_at: str | Column = "expires_at") -> Column:
    """An invitation that can still be used."""
    return col(used_at).isNull() & (col(expires_at) > moment(as_of))


def stale(as_of: Moment, days: int, last_seen_at: str | Column = "last_seen_at", revoked_at: str | Column = "revoked_at") -> Column:
    """Seen, but not for ``days`` days, and not revoked. What was never seen is kept."""
    seen = col(last_seen_at)
    return not_revoked(revoked_at) & seen.isNotNull() & (seen < moment(as_of) - F.make_dt_interval(days=F.lit(days)))


def active_admin(role: str | Column = "role", disabled: str | Column = "disabled") -> Column:
    return (col(role) == "admin") & ~col(disabled)


def owned_by(owner: int, user_id: str | Column = "user_id") -> Column:
    return col(user_id) == F.lit(owner)


def owned_row(key: str | Column, value: int | str, owner: int, user_id: str | Column = "user_id") -> Column:
    """Someone else's row looks just like a missing one."""
    return key_is(key, value) & owned_by(owner, user_id)


def valid_session(as_of: Moment, revoked_at: str | Column = "revoked_at", expires_at: str | Column = "expires_at", disabled: str | Column = "disabled") -> Column:
    """Session and user columns side by side: not revoked, not expired, user enabled."""
    return not_revoked(revoked_at) & (col(expires_at) > moment(as_of)) & ~col(disabled)


def in_domain(column: str | Column, values: tuple[str, ...]) -> Column:
    return col(column).isin(*values)
