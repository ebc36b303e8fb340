"""All reports over one store.

Every method takes the time it is asked at (``as_of``, UTC) and returns DataFrames.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions.months import from_month, shift_month
from agorametrics.operators import activity, clusters, inflation, influence, matrix, sampling
from agorametrics.operators import members as people
from agorametrics.operators import trade, volume
from agorametrics.options import parse_rpm_options
from agorametrics.plans.tables import write_once
from agorametrics.sources import store as tables
from agorametrics.sources.quotes import read_quotes
from agorametrics.sources.store import Store


class Community:
    """Reports of a community with facts in ``store`` and ``members(id, display_name, bot)``.

    Reports that only add up counts read the stored batches as they are: adding up
    partial counts gives the same sums with one shuffle less.
    """

    def __init__(self, store: Store, members: DataFrame):
        self.store = store
        self.members = members

    def rpm(self, words: Iterable[str], author_id: int, as_of: dt.datetime) -> DataFrame:
        """The leaderboard or one author's months, depending on the option words."""
        options = parse_rpm_options(words)
        if options.leaderboard:
            return self.leaderboard(as_of, least=options.least, all_users=options.all_users)
        return self.personal(author_id, as_of)

    def leaderboard(
        self, as_of: dt.datetime, month_offset: int = 0, least: bool = False, all_users: bool = False
    ) -> DataFrame:
        """The leaderboard of this month, or of one ``month_offset`` months away."""
        return activity.leaderboard(
            self.store.user_stats_monthly(),
            self.store.user_mapping(),
            *shift_month(as_of.year, as_of.month, month_offset),
            as_of.date(),
            least=least,
            all_users=all_users,
        )

    def leaderboard_summary(self, as_of: dt.datetime, month_offset: int = 0) -> DataFrame:
        """The month that the leaderboard shows, its average, and why it may be empty."""
        year, month = shift_month(as_of.year, as_of.month, month_offset)
        return activity.leaderboard_summary(self.store.user_stats_monthly(), year, month, as_of.date())

    def leaderboard_lines(self, as_of: dt.datetime, month_offset: int = 0, **options: bool) -> DataFrame:
        return activity.leaderboard_lines(self.leaderboard(as_of, month_offset, **options))

    def monthly_stats(self, year: int, month: int) -> DataFrame:
        """All authors of one month, highest reactions per message first."""
        stats = self.store.user_stats_monthly()
        return activity.monthly_stats(stats, self.store.user_mapping(), year, month)

    def user_month(self, author_id: int, year: int, month: int) -> DataFrame:
        return activity.user_month(self.store.user_stats_monthly(), author_id, year, month)

    def active_users(self, year: int, month: int, min_messages: int = fixed.ACTIVE_MIN_MESSAGES) -> DataFrame:
        return activity.active_users(self.store.user_stats_monthly(), year, month, min_messages)

    def personal_lines(self, author_id: int, as_of: dt.datetime) -> DataFrame:
        return activity.personal_lines(self.personal(author_id, as_of)).orderBy("step")

    def personal(self, author_id: int, as_of: dt.datetime) -> DataFrame:
        stats = self.store.user_stats_monthly().where(F.col("author_id") == author_id)
        author = self.store.spark.range(1).select(F.lit(author_id).cast("bigint").alias("author_id"))
        return activity.personal_months(stats, author, as_of).orderBy("step")

    def totals(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        return activity.totals_in_range(
            self.store.batches(tables.STATS), self.store.user_mapping(), start, end
        )

    def inflation(self) -> tuple[DataFrame, DataFrame]:
        """Monthly and yearly inflation."""
        return inflation.inflation_report(self.store.user_stats_monthly())

    def inflation_bars(self) -> tuple[DataFrame, DataFrame]:
        """Bars of the monthly and the yearly chart."""
        monthly, yearly = self.inflation()
        return inflation.monthly_inflation_bars(monthly), inflation.yearly_inflation_bars(yearly)

    def monthly_rpm(self, months: int | None = None) -> DataFrame:
        """Mean over authors of reactions per message, as maintained by ingest."""
        return inflation.monthly_rpm_from_changes(self.store.batches(tables.RPM_CHANGES), months)

    def inflation_from_edges(self, monthly: bool, months: int | None = None) -> DataFrame:
        """Reactions per message counted from the reaction edges."""
        stats, edges = self.store.batches(tables.STATS), self.store.batches(tables.EDGES)
        if monthly:
            return inflation.monthly_rpm_from_edges(stats, edges, months)
        return inflation.yearly_rpm_from_edges(stats, edges)

    def trade(self, user_id: int, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
        """Top partners of both directions, and totals with the trade status."""
        edges = trade.edges_with(self.store.batches(tables.EDGES), user_id, as_of)
        mine = write_once(edges, "trade")
        return (
            trade.user_trade_partners(mine, self.members, user_id, as_of),
            trade.user_trade_summary(mine, user_id, as_of),
        )

    def gdp(self) -> DataFrame:
        stats = self.store.batches(tables.STATS)
        since = volume.first_of_newest([stats])
        return volume.messages_per_month(stats.where(from_month(*since)) if since else stats)

    def hdi(self) -> DataFrame:
        stats = self.store.batches(tables.STATS)
        since = volume.first_of_newest([self.store.batches(tables.MESSAGES), stats])
        if since:
            stats = stats.where(from_month(*since))
        return volume.quality_ratio_per_month(self.store.messages(["ts"], since=since), stats)

    def gdp_points(self) -> DataFrame:
        return volume.chart_points(self.gdp(), "total_messages")

    def hdi_points(self) -> DataFrame:
        return volume.chart_points(self.hdi(), "hdi_ratio")

    def most_liked_report(self, as_of: dt.datetime, month_offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """The month shown with the outcome, and the ranking."""
        return influence.most_liked_report(
            self.store.user_reactions_monthly(),
            self.store.user_mapping(),
            self.store.user_stats_monthly(),
            *shift_month(as_of.year, as_of.month, month_offset),
            as_of.date(),
        )

    def most_liked(self, as_of: dt.datetime, month_offset: int = 0) -> DataFrame:
        return self.most_liked_report(as_of, month_offset)[1]

    def reaction_percentages(
        self, as_of: dt.datetime, min_messages: int = fixed.ACTIVE_MIN_MESSAGES
    ) -> DataFrame:
        """Who of this month's active users gives how much of their reactions to whom."""
        stats = self.store.user_stats_monthly()
        active = activity.active_users(stats, as_of.year, as_of.month, min_messages)
        cells = matrix.reaction_matrix(self.store.user_reactions(), matrix.numbered_members(active))
        return matrix.reaction_percentages(cells)

    def user_clusters(self, k: int = fixed.CLUSTERS) -> DataFrame:
        return clusters.user_clusters(self.store.batches(tables.ALL_TIME), self.members, k)

    def member_labels(self, ids: DataFrame) -> DataFrame:
        return people.member_labels(ids, self.members)

    def random_message(self, seed: int | None = None) -> DataFrame:
        """The content of a random quality message; only the pick's text is read."""
        pick = write_once(sampling.random_message(self.store.messages(["ts"]), seed), "pick")
        return self.store.messages(["content"], ids=pick).select("content")

    def random_quote(self, path: str, seed: int | None = None) -> DataFrame:
        return sampling.random_quote(read_quotes(self.store.spark, path), seed)

    def reset(self) -> None:
        """Empty the monthly author counts and the all-time reactions; all else stays."""
        self.store.reset()
