"""JSON listings of the service (one response a row) as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions import scalars as X

#: Items of the listings; moments are ISO texts and may be malformed.
ITEMS = {
    "agents": ("agents", "agent_id string, user_id int, user_email string, machine_name string, client_version string, created_at string, last_seen_at string, revoked_at string"),
    "users": ("users", "id int, email string, role string, disabled boolean, must_change_password boolean, created_at string"),
    "invites": ("invites", "invite_id string, created_by_email string, created_at string, expires_at string, used_at string"),
}


def decoded(responses: DataFrame, name: str, body: str = "body") -> DataFrame:
    """The items of each response with ``total``, which defaults to the number of items; bad JSON gives no rows."""
    field, item = ITEMS[name]
    parsed = F.from_json(F.col(body), f"{field} array<struct<{item.replace(' ', ':')}>>, total long".replace(",:", ", "))
    rows = responses.select(parsed.alias("r")).select(F.col(f"r.{field}").alias("items"), F.coalesce("r.total", F.size(f"r.{field}").cast("long")).alias("total"))
    flat = rows.select(F.explode("items").alias("i"), "total").select("i.*", "total")
    moments = [c for c in flat.columns if c.endswith("_at")]
    return flat.withColumns({c: X.parse_iso(c) for c in moments})
