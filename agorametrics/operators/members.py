"""Members, usernames and display names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions.text import ascii_only, name_or_id, username_without_emoji


def non_bot_members(members: DataFrame) -> DataFrame:
    return members.where(~F.col("bot")).select("id", "display_name")


def cleaned_usernames(members: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Mapping rows for all members: the display name without emoji, and when."""
    return members.select(
        F.col("id").alias("author_id"),
        username_without_emoji(F.col("display_name")).alias("username"),
        F.lit(as_of).alias("last_updated"),
    )


def refresh_due(last_refresh: dt.datetime | None, now: dt.datetime) -> bool:
    """Usernames are refreshed at most once a day."""
    if last_refresh is None:
        return True
    return (now - last_refresh).total_seconds() >= fixed.USERNAME_REFRESH_SECONDS


def latest_usernames(updates: DataFrame) -> DataFrame:
    """One username per author, the one written last."""
    newest = F.max_by(F.struct("username", "last_updated"), F.struct("last_updated", "username"))
    return updates.groupBy("author_id").agg(newest.alias("u")).select("author_id", "u.*")


def member_labels(ids: DataFrame, members: DataFrame) -> DataFrame:
    """ASCII display names for ``ids(id)``; ``User <id>`` for nameless or gone members."""
    return ids.join(members.select("id", "display_name"), "id", "left").select(
        "id", name_or_id(ascii_only(F.col("display_name")), F.col("id")).alias("name")
    )
