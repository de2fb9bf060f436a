"""Pages of ordered rows, with totals. Every order ends with the key, so that pages neither overlap nor miss rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.schemas import check_limits

DEFAULT, MOST = 50, 200


def page_offset(page: int, per_page: int = DEFAULT) -> int:
    check_limits(page=(page, 1, 1 << 40), per_page=(per_page, 1, MOST))
    return (page - 1) * per_page


def page(df: DataFrame, *order: str | Column, limit: int = DEFAULT, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order: each partition keeps that many rows at most before they meet. Deep pages (see
    ``session.SETTINGS``) are sorted over ranges; ``after`` pages by key instead and costs the same at any depth."""
    check_limits(limit=(limit, 1, MOST), offset=(offset, 0, 1 << 40))
    return df.orderBy(*order).offset(offset).limit(limit)


def after(df: DataFrame, last: dict[str, object], limit: int = DEFAULT) -> DataFrame:
    """The page behind the row whose ordering columns (ascending, the last one a key, none null) have the values ``last``; without values, the first page."""
    check_limits(limit=(limit, 1, MOST))
    behind = F.struct(*last) > F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in last.items())) if all(v is not None for v in last.values()) else F.lit(True)
    return df.filter(behind).orderBy(*last).limit(limit)


def newest(df: DataFrame, at: str, key: str, limit: int = DEFAULT, offset: int = 0) -> DataFrame:
    """By ``at``, the latest first; ties by key, the largest first. Null moments come first, as in the service's database."""
    return page(df, F.desc_nulls_first(at), F.desc(key), limit=limit, offset=offset)


def total(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row, ``total``: 0 where nothing is there."""
    return (df if condition is None else df.filter(condition)).agg(F.count(F.lit(1)).alias("total"))


@dataclass(frozen=True)
class Envelope:
    items: DataFrame
    total: DataFrame


def envelope(df: DataFrame, *order: str | Column, limit: int = DEFAULT, offset: int = 0) -> Envelope:
    """The page, and the total over the same rows."""
    return Envelope(page(df, *order, limit=limit, offset=offset), total(df))


def page_info(totals: DataFrame, number: int, per_page: int = DEFAULT, noun: str = "row") -> DataFrame:
    """From ``total``: first and last index on the page (0 if it is empty), whether pages stand before and after, and a label. A page
    out of range has no neighbours."""
    start = page_offset(number, per_page)
    t = F.col("total")
    on_page = F.greatest(F.lit(0), F.least(F.lit(per_page).cast("long"), t - start))
    some = on_page > 0
    return totals.select(
        t.alias("total"), F.lit(number).alias("page"),
        F.when(some, F.lit(start + 1).cast("long")).otherwise(F.lit(0).cast("long")).alias("first_index"),
        F.when(some, start + on_page).otherwise(F.lit(0).cast("long")).alias("last_index"),
        (some & F.lit(number > 1)).alias("has_prev"), (some & (t > start + on_page)).alias("has_next"),
        F.concat(t.cast("string"), F.when(t == 1, f" {noun}").otherwise(f" {noun}s")).alias("label"),
    )
