"""Table schemas. Ids and counts are BIGINT; month keys are two INT columns."""

from __future__ import annotations

from pyspark.sql import types as T

USER_STATS_MONTHLY = T.StructType(
    [
        T.StructField("author_id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("total_messages", T.LongType()),
        T.StructField("total_reactions", T.LongType()),
    ]
)

USER_MAPPING = T.StructType(
    [
        T.StructField("author_id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("last_updated", T.TimestampType()),
    ]
)

USER_REACTIONS = T.StructType(
    [
        T.StructField("giver_id", T.LongType()),
        T.StructField("receiver_id", T.LongType()),
        T.StructField("reaction_count", T.LongType()),
    ]
)

USER_REACTIONS_MONTHLY = T.StructType(
    [
        T.StructField("giver_id", T.LongType()),
        T.StructField("receiver_id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("reaction_count", T.LongType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("reaction_count", T.LongType()),
        T.StructField("author_id", T.LongType()),
        T.StructField("reply_to_id", T.LongType()),
        T.StructField("reply_to_author", T.StringType()),
        T.StructField("reply_to_content", T.StringType()),
    ]
)

SCAN_OFFSETS = T.StructType(
    [
        T.StructField("channel_id", T.LongType()),
        T.StructField("last_scanned", T.TimestampType()),
    ]
)

MEMBERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("bot", T.BooleanType()),
    ]
)

CHANNELS = T.StructType(
    [
        T.StructField("channel_id", T.LongType()),
        T.StructField("can_read", T.BooleanType()),
    ]
)

REACTIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("emoji", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField(
                "users",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("id", T.LongType()),
                            T.StructField("bot", T.BooleanType()),
                        ]
                    )
                ),
            ),
        ]
    )
)

# The message a reply points to, as far as the source could resolve it.
REFERENCE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("author", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

RAW_MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("channel_id", T.LongType()),
        T.StructField(
            "author",
            T.StructType(
                [
                    T.StructField("id", T.LongType()),
                    T.StructField("display_name", T.StringType()),
                    T.StructField("bot", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("reference", REFERENCE),
        T.StructField("reactions", REACTIONS),
        # When this copy of the message was taken; the newest copy of an id counts.
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

# Additive facts of all stored tables, one wide row type; a table uses the columns it needs.
FACTS = T.StructType(
    [
        T.StructField("a", T.LongType()),
        T.StructField("b", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("reactions", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seen", T.TimestampType()),
        T.StructField("content", T.StringType()),
        T.StructField("reply_to_id", T.LongType()),
        T.StructField("reply_to_author", T.StringType()),
        T.StructField("reply_to_content", T.StringType()),
    ]
)

# The folders they are kept in.
FACT_KEYS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("batch", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)
