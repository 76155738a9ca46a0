"""Daily active and new users from an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_activity(events: DataFrame, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Per day: distinct active users, users seen for the first time, events.

    Plan: one partial aggregation to (user, day) pairs, which is skew-proof
    (a hot user collapses to one row per day map-side); both roll-ups then
    read that small exchange, which Spark reuses instead of rescanning.
    """
    ud = (events.select(F.col(user).alias("_u"), F.to_date(F.col(ts)).alias("day"))
          .groupBy("_u", "day").agg(F.count(F.lit(1)).alias("_n")))
    per_day = ud.groupBy("day").agg(F.count(F.lit(1)).alias("active_users"),
                                    F.sum("_n").alias("n_events"))
    new = (ud.groupBy("_u").agg(F.min("day").alias("day"))
           .groupBy("day").agg(F.count(F.lit(1)).alias("new_users")))
    return (per_day.join(new, "day", "left")
            .select("day", "active_users",
                    F.coalesce(F.col("new_users"), F.lit(0).cast("long")).alias("new_users"),
                    "n_events"))
