"""Message content predicates and name cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed


def is_blank(content: Column) -> Column:
    return ~F.coalesce(content, F.lit("")).rlike(fixed.NON_BLANK_PATTERN)


def is_too_short(content: Column) -> Column:
    """Fewer code points than a message needs."""
    return F.char_length(content) < fixed.MIN_MESSAGE_LENGTH


def has_link(content: Column) -> Column:
    return content.contains(fixed.LINK_TOKEN)


def has_custom_emoji(content: Column) -> Column:
    return content.rlike(fixed.EMOJI_PATTERN)


def has_tag(content: Column) -> Column:
    return content.rlike(fixed.TAG_PATTERN)


def is_valid_message(content: Column) -> Column:
    excluded = has_link(content) | has_custom_emoji(content) | has_tag(content)
    return ~is_too_short(content) & ~excluded


def username_without_emoji(display_name: Column) -> Column:
    return F.regexp_replace(display_name, fixed.USERNAME_STRIP_PATTERN, "")


def ascii_only(name: Column) -> Column:
    return F.regexp_replace(name, fixed.NON_ASCII_PATTERN, "")


def name_or_id(name: Column, user_id: Column) -> Column:
    """The name, or ``User <id>`` when it is missing or empty."""
    fallback = F.concat(F.lit(fixed.NAMELESS_PREFIX), user_id.cast("string"))
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


def member_name(display_name: Column, user_id: Column) -> Column:
    """The name of a member, or ``User <id>`` when there is no such member."""
    fallback = F.concat(F.lit(fixed.NAMELESS_PREFIX), user_id.cast("string"))
    return F.coalesce(display_name, fallback)
