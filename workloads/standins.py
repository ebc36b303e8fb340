"""Community tables derived from the given tables.

There are no chat tables in the test data, so messages, reactions and members are
derived from events, orders, line items and customers. ``standin_sql`` has the same
derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametrics.operators.facts import (
    all_time_reactions,
    author_months_from_counts,
    reaction_months,
    resolve_references,
)
from agorametrics.operators.members import cleaned_usernames
from agorametrics.schemas import REACTIONS, REFERENCE

# The member whose own messages are skipped on ingest.
SELF_ID = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events: one month of messages ------------------------------------------------


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author months; an event is a message with floor(value) reactions."""
    return author_months_from_counts(
        table(spark, sf_dir, "events").select(
            F.col("user_id").alias("author_id"), F.floor("value").alias("reaction_count"), "ts"
        )
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaction months; the user reacts to the user named in the properties."""
    return reaction_months(
        table(spark, sf_dir, "events").select(
            F.col("user_id").alias("giver_id"), _k().alias("receiver_id"), F.col("ts").alias("created_at")
        )
    )


def event_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time reactions, the rollup of the reaction months."""
    return all_time_reactions(event_edges(spark, sf_dir))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def raw_from_events(events: DataFrame) -> DataFrame:
    """Raw messages with nested reactions, row by row, so also for streams.

    ``reply_to_id`` is the id k before, none for k = 0. The properties are parsed once a row.
    """
    events = events.withColumn("_k", _k())
    k = F.col("_k")
    ups = F.floor(F.col("value") / 20)
    user = lambda i: F.struct((k + i).alias("id"), (k + i >= 100).alias("bot"))
    up_users = F.when(
        ups > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), ups), user)
    ).otherwise(F.array().cast(REACTIONS.elementType["users"].dataType))
    zero = F.lit(0).cast("bigint")
    reactions = F.array(
        F.struct(F.lit("up").alias("emoji"), ups.alias("count"), up_users.alias("users")),
        F.struct(
            F.lit("down").alias("emoji"),
            F.lit(1).cast("bigint").alias("count"),
            F.array(user(zero)).alias("users"),
        ),
    )
    author = F.struct(
        F.col("user_id").alias("id"),
        F.concat(F.lit("Member "), F.col("user_id").cast("string")).alias("display_name"),
        (F.col("user_id") < 5).alias("bot"),
    )
    content = (
        F.when(k < 20, F.concat(F.lit("clicked the item "), "props"))
        .when(k < 35, F.concat(F.lit("see http://x.y for "), "props"))
        .when(k < 50, F.concat(F.lit("thanks <@!42> for "), "props"))
        .when(k < 60, F.concat(F.lit("so good <:pog:12> "), "props"))
        .when(k < 70, F.lit("　\t "))
        .when(k < 80, F.col("props"))
        .otherwise(F.concat(F.lit("time is: now @home "), "props"))
    )
    created = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"),
        _channel().alias("channel_id"),
        author.alias("author"),
        content.alias("content"),
        created.alias("created_at"),
        F.when(k > 0, F.col("event_id") - k).alias("reply_to_id"),
        reactions.cast(REACTIONS).alias("reactions"),
        created.alias("fetched_at"),
    )


def _channel() -> Column:
    return (
        F.when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "purchase", 3)
        .when(F.col("event_type") == "signup", 4)
        .otherwise(5)
        .cast("bigint")
    )


def unresolved_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages for reports that do not look at replies."""
    raw = raw_from_events(table(spark, sf_dir, "events")).drop("reply_to_id")
    return raw.withColumn("reference", F.lit(None).cast(REFERENCE))


def replying_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages that carry the id they reply to."""
    return raw_from_events(table(spark, sf_dir, "events"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_from_events(table(spark, sf_dir, "events"))
    return resolve_references(raw, raw)


def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder, as a stream; replies are unresolved."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return raw_from_events(events).drop("reply_to_id").withColumn(
        "reference", F.lit(None).cast(REFERENCE)
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels are the event types; the error channel is closed to us."""
    return (
        table(spark, sf_dir, "events")
        .select(_channel().alias("channel_id"), (F.col("event_type") != "error").alias("can_read"))
        .distinct()
    )


# --- customers: members -----------------------------------------------------------


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit are members; the others have left. Machinery is for bots."""
    segment = F.col("c_mktsegment")
    name = (
        F.when(segment == "BUILDING", F.concat("c_name", F.lit(" \U0001f389")))
        .when(segment == "FURNITURE", F.concat(F.lit("Ünï "), "c_name"))
        .when(segment == "HOUSEHOLD", F.lit("\U0001f680"))
        .otherwise(F.col("c_name"))
    )
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") >= 0)
        .select(
            F.col("c_custkey").alias("id"),
            name.alias("display_name"),
            (segment == "MACHINERY").alias("bot"),
        )
    )


def mapping(spark: SparkSession, sf_dir: str, as_of) -> DataFrame:
    return cleaned_usernames(members(spark, sf_dir), as_of)


# --- orders: 80 months of messages ------------------------------------------------


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages by customers; their line items are the reactions."""
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("items"))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(items, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("author_id"),
            F.col("o_orderdate").alias("ts"),
            F.coalesce("items", F.lit(0).cast("bigint")).alias("reaction_count"),
        )
    )


def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_months_from_counts(order_messages(spark, sf_dir))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers react to the customers whose orders they serve."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("giver_id")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("receiver_id"), F.col("o_orderdate").alias("created_at")
    )
    return reaction_months(items.join(orders, "o_orderkey"))


def order_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_time_reactions(order_edges(spark, sf_dir))


def nation_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactions between nations: of the supplier to that of the customer."""
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("giver_id"), F.col("s_nationkey").alias("giver_nation")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("receiver_id"), F.col("c_nationkey").alias("receiver_nation")
    )
    return (
        order_reactions(spark, sf_dir)
        .join(suppliers, "giver_id")
        .join(customers, "receiver_id")
        .groupBy(
            F.col("giver_nation").cast("bigint").alias("giver_id"),
            F.col("receiver_nation").cast("bigint").alias("receiver_id"),
        )
        .agg(F.sum("reaction_count").alias("reaction_count"))
    )


# --- documents and conversations: texts --------------------------------------------


def document_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents; those of some sources with a token the message filter looks for."""
    text, source = F.col("text"), F.col("source")
    content = (
        F.when(source == "src1", F.concat(text, F.lit(" <:pog:12>")))
        .when(source == "src2", F.concat(F.lit("<@!42> "), text))
        .when(source == "src3", F.concat(text, F.lit(" http://x.y")))
        .when(source == "src4", F.concat(text, F.lit(" HTTP://X.Y")))
        .when(source == "src5", F.concat(text, F.lit(" <a:wave:1>")))
        .when(source == "src6", F.concat(F.lit("<@\n> "), text))
        .when(source == "src7", F.concat(F.lit("<@\r> "), text))
        .when(source == "src8", F.concat(text, F.lit(" <:x:1,a>")))
        .when(source == "src9", F.concat(F.lit("<@&7> "), text))
        .otherwise(text)
    )
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw messages with the document of the same id as content, if any."""
    documents = document_contents(spark, sf_dir).withColumnRenamed("doc_id", "id")
    like = F.struct(
        F.lit("like").alias("emoji"),
        F.col("reaction_count").alias("count"),
        F.lit(None).cast(REACTIONS.elementType["users"].dataType).alias("users"),
    )
    created = F.col("ts").cast("timestamp")
    return (
        order_messages(spark, sf_dir)
        .join(documents, "id", "left")
        .select(
            "id",
            F.struct(F.col("author_id").alias("id")).alias("author"),
            F.coalesce("content", F.lit("")).alias("content"),
            created.alias("created_at"),
            F.lit(None).cast(REFERENCE).alias("reference"),
            F.array(like).cast(REACTIONS).alias("reactions"),
        )
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages that reply to the turn before.

    System turns have no author and no content, and reply to a turn that is gone.
    """
    turn_id = F.col("conv_id") * 100_000 + F.col("turn")
    system = F.col("role") == "system"
    gone = F.col("conv_id") * 100_000 + 99_999
    return table(spark, sf_dir, "conversations").select(
        turn_id.alias("id"),
        F.struct(F.when(~system, F.col("role")).alias("display_name")).alias("author"),
        F.when(~system, F.col("text")).alias("content"),
        F.when(system, gone).when(F.col("turn") > 0, turn_id - 1).alias("reply_to_id"),
    )
