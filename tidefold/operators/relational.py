"""Joins, reference checks and what the removal of a parent does. Sides are never forced to broadcast: Spark does so below its own
size limit, and splits skewed keys above it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.schemas import REFERENCES


def with_owner(df: DataFrame, users: DataFrame, user_id: str = "user_id", key: str = "id", take: dict[str, str] | None = None) -> DataFrame:
    """Rows with columns of their owner (by default ``user_email``); rows without one drop out."""
    return df.join(_taken(users, key, take), F.col(user_id) == F.col("__owner"), "inner").drop("__owner")


def with_optional_owner(df: DataFrame, users: DataFrame, user_id: str = "user_id", key: str = "id", take: dict[str, str] | None = None) -> DataFrame:
    """All rows; null where the owner is null or gone."""
    return df.join(_taken(users, key, take), F.col(user_id) == F.col("__owner"), "left").drop("__owner")


def _taken(users: DataFrame, key: str, take: dict[str, str] | None) -> DataFrame:
    return users.select(F.col(key).alias("__owner"), *(F.col(c).alias(as_) for c, as_ in (take or {"email": "user_email"}).items()))


def session_with_user(sessions: DataFrame, users: DataFrame, condition: Column) -> DataFrame:
    """Sessions that fulfil the condition, side by side with their user's id, e-mail, role and flags."""
    u = users.select(F.col("id").alias("owner_id"), "email", "role", "disabled", "must_change_password")
    return sessions.filter(condition).join(u, F.col("user_id") == F.col("owner_id"))


def exists(df: DataFrame, condition: Column, name: str = "found") -> DataFrame:
    """One row, one boolean: whether any row fulfils the condition."""
    return df.filter(condition).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that point to no parent; null points nowhere and is fine."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def broken_references(tables: dict[str, DataFrame]) -> DataFrame:
    """``table``, ``column``, ``n`` for every reference that some row breaks."""
    found = [
        orphans(tables[t], c, tables[p], k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit(c).alias("column"), "n")
        for t, c, p, k, _ in REFERENCES
        if t in tables and p in tables
    ]
    return reduce(DataFrame.union, found).filter("n > 0")


def without(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is none of the keys; rows with null stay."""
    return df.join(keys.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def nulled(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """All rows; the column is null where it was one of the keys."""
    gone = keys.select(F.col(key).alias("__key")).distinct()
    return df.join(gone, F.col(column) == F.col("__key"), "left").withColumn(column, F.when(F.col("__key").isNull(), F.col(column))).drop("__key").select(*df.columns)


def removed(tables: dict[str, DataFrame], table: str, keys: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """All tables after the rows of ``table`` with the keys are gone: rows that cascade go with them, down to the last child, pointers
    that survive are nulled, and what merely is pointed to stays."""
    out = dict(tables)
    todo = [(table, keys.select(F.col(key).alias("__gone")))]
    out[table] = without(tables[table], key, keys, key)
    while todo:
        parent, gone = todo.pop(0)
        for child, column, of, _, then in REFERENCES:
            if of != parent or child not in out:
                continue
            if then == "cascade":
                if any(of2 == child for _, _, of2, _, _ in REFERENCES):
                    todo.append((child, out[child].join(gone, F.col(column) == F.col("__gone"), "left_semi").select(F.col("id").alias("__gone"))))
                out[child] = without(out[child], column, gone, "__gone")
            elif then == "set null":
                out[child] = nulled(out[child], column, gone, "__gone")
    return out


def attributed(uploads: DataFrame, agents: DataFrame, users: DataFrame) -> DataFrame:
    """Uploads with the machine they came from and its owner, where these are still there."""
    a = agents.select(F.col("id").alias("__agent"), "machine_name", F.col("user_id").alias("agent_user_id"))
    return with_optional_owner(uploads.join(a, F.col("agent_registration_id") == F.col("__agent"), "left").drop("__agent"), users, "agent_user_id")
