"""Scalar functions as columns; all run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.functions.predicates import Moment, col, moment
from tidefold.schemas import MODES

#: Fixed value: the letters of registration codes, without look-alikes.
CODE_LETTERS = "ABCDEFGHJKMNPQRSTUVWXYZ23456789"


def stripped(text: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def clean_email(text: str | Column) -> Column:
    """Trimmed and lower-cased; empty becomes null."""
    return F.nullif(F.lower(stripped(text)), F.lit(""))


def bearer_token(header: str | Column) -> Column:
    """The token of an authorization header, or null."""
    h = col(header)
    return F.when(F.lower(h).startswith("bearer "), F.nullif(stripped(F.substring(h, 8, 1 << 30)), F.lit("")))


def client_ip(forwarded: str | Column, peer: str | Column) -> Column:
    """The first address of a forwarding header; without one, the peer's."""
    f = col(forwarded)
    return F.when(f.isNotNull() & (f != ""), stripped(F.split_part(f, F.lit(","), F.lit(1)))).otherwise(col(peer))


def sha256_hex(value: str | Column) -> Column:
    """SHA-256 of text (UTF-8) or bytes, lower-case hex."""
    return F.sha2(col(value), 256)


def file_suffix(name: str | Column) -> Column:
    """The last dot and what follows, if both sides of it hold something; leading dots do not count."""
    base = F.regexp_extract(col(name), r"([^/]*)/*$", 1)
    return F.regexp_extract(base, r"^\.*[^.].*(\.[^.]+)$", 1)


def file_extension(content_type: str | Column, name: str | Column) -> Column:
    suffix = F.nullif(F.coalesce(file_suffix(name), F.lit("")), F.lit(""))
    kind = col(content_type)
    return F.when(kind == "match-log", ".dat").when(kind == "decklist", ".xml").when(kind == "unknown", F.coalesce(suffix, F.lit(".bin"))).otherwise(".bin")


def shard_path(sha: str | Column, extension: str | Column) -> Column:
    """``aa/bb/<hash><extension>``."""
    s = col(sha)
    return F.concat(F.substring(s, 1, 2), F.lit("/"), F.substring(s, 3, 2), F.lit("/"), s, extension if isinstance(extension, Column) else F.lit(extension))


def random_code() -> Column:
    """A registration code XXXX-XXXX; a new one for each row and run."""
    letters = F.array(*(F.lit(c) for c in CODE_LETTERS))
    pick = [F.element_at(letters, (F.floor(F.rand() * len(CODE_LETTERS)) + 1).cast("int")) for _ in range(8)]
    return F.concat(*pick[:4], F.lit("-"), *pick[4:])


def uuid_or_null(text: str | Column) -> Column:
    """Lower-case UUID, or null if it is none."""
    t = F.lower(stripped(text))
    return F.when(t.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), t)


def after(at: str | Column, *, days: int = 0, hours: int = 0, seconds: int = 0) -> Column:
    return col(at) + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(0), F.lit(seconds))


def iso_format(at: str | Column) -> Column:
    """ISO 8601 with ``+00:00``; six digits of fraction, none if it is zero."""
    t = col(at).cast("timestamp")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(t, "SSSSSS")
    return F.concat(whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00"))


def parse_iso(text: str | Column) -> Column:
    """A timestamp; empty or malformed text gives null."""
    t = col(text)
    return F.when(t.rlike(r"^\d{4}-?\d{2}-?\d{2}"), F.try_to_timestamp(F.regexp_replace(t, "Z", "+00:00")))


def day(at: str | Column) -> Column:
    return F.date_format(col(at), "yyyy-MM-dd")


def minute(at: str | Column) -> Column:
    return F.date_format(col(at), "yyyy-MM-dd HH:mm")


def age(created_at: str | Column, as_of: Moment) -> Column:
    """``5h`` below a day, else ``3d``; floors, so that a moment ahead is ``-1h``."""
    seconds = F.unix_micros(moment(as_of)) - F.unix_micros(col(created_at).cast("timestamp"))
    hours = F.floor(seconds / F.lit(3_600_000_000)).cast("long")
    return F.when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("long").cast("string"), F.lit("d")))


def registration_mode(value: str | Column) -> Column:
    """The mode in a JSON value: anything but a string of MODES counts as ``invite_only``."""
    v = F.try_parse_json(col(value))
    said = F.try_variant_get(v, "$", "string")
    return F.when((F.schema_of_variant(v) == "STRING") & said.isin(*MODES), said).otherwise("invite_only")


def event_json(*columns: str) -> Column:
    """The JSON payload of an event."""
    return F.to_json(F.struct(*columns))


def shown(value: str | Column, instead: str = "—") -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(instead))


def agent_status(revoked_at: str | Column = "revoked_at") -> Column:
    return F.when(col(revoked_at).isNull(), "active").otherwise("revoked")


def invite_url(base: str, token: str | Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/register?token="), col(token))
