"""Check-in history: days, weeks, tags, trends, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import relative_day, signed, week_start
from pulsegrid.operators.records import newest_n


def day_scores(checkins: DataFrame, user: str = "user_id") -> DataFrame:
    """Check-ins and mean score per user and day."""
    return checkins.groupBy(user, F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("n"), F.avg("fused").alias("mean_score"))


def calendar(days: DataFrame, start: Column, end: Column, user: str = "user_id") -> DataFrame:
    """Every date of a range per user, with the day's aggregates where there are any."""
    users = days.select(user).distinct()
    grid = users.withColumn("day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    return grid.join(days, [user, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def month_grid(days: DataFrame, month: Column, user: str = "user_id") -> DataFrame:
    """A month with Monday-first leading blanks: `cell` is the position in the grid."""
    first = F.trunc(month, "MM")
    out = calendar(days, first, F.last_day(month), user)
    lead = F.weekday(first)
    return out.withColumn("cell", F.dayofmonth("day") - 1 + lead)


def trend(checkins: DataFrame, now: Column, days: int = 14, user: str = "user_id") -> DataFrame:
    """Daily mean score over the last days that have one."""
    d = day_scores(checkins, user).filter("mean_score IS NOT NULL")
    ago = F.datediff(F.to_date(now), F.col("day"))
    return d.filter((ago >= 0) & (ago < days)).select(user, "day", "mean_score")


def week_summary(checkins: DataFrame, now: Column, user: str = "user_id") -> DataFrame:
    """This week against last week, calmest and highest check-in, and a phrase. Users with no check-in at all
    in both weeks are left out."""
    ws = week_start(now)
    day = F.to_date("created_at")
    this, last = day >= ws, (day >= F.date_sub(ws, 7)) & (day < ws)
    scored = this & F.col("fused").isNotNull()
    low = F.when(scored, F.struct(F.col("fused"), F.col("created_at"), F.col("id")))
    high = F.when(scored, F.struct(F.col("fused"), F.col("created_at"), F.col("id"), F.col("tag")))
    agg = checkins.filter(this | last).groupBy(user).agg(
        F.count(F.when(this, 1)).alias("n"), F.avg(F.when(this, F.col("fused"))).alias("average"),
        F.avg(F.when(last, F.col("fused"))).alias("last_week"), F.count(F.when(scored, 1)).alias("n_scored"),
        F.min(low).alias("_low"), F.max(high).alias("_high"))
    a, b = F.col("average"), F.col("last_week")
    gap = F.format_string("%.2f", F.abs(a - b))
    phrase = (F.when(a.isNull() | b.isNull(), None).when(F.abs(a - b) < 0.05, "About the same as last week.")
              .when(a > b, F.concat(F.lit("A little higher than last week, by "), gap, F.lit(".")))
              .otherwise(F.concat(F.lit("Calmer than last week, by "), gap, F.lit("."))))
    several = F.col("n_scored") > 1
    return agg.select(
        user, "n", "average", "last_week", "n_scored", F.when(several, F.to_date("_low.created_at")).alias("calmest_day"),
        F.when(several, F.to_date("_high.created_at")).alias("highest_day"),
        F.when(several, F.col("_high.tag")).alias("highest_tag"), phrase.alias("phrase"))


def tag_trends(checkins: DataFrame, by: list[str] = ["user_id"], min_n: int = 2) -> DataFrame:
    """Mean score per tag with at least `min_n` scored check-ins."""
    return (checkins.filter("fused IS NOT NULL").groupBy(*by, "tag")
            .agg(F.count("*").alias("n"), F.avg("fused").alias("mean_score")).filter(F.col("n") >= min_n))


def explode_tags(checkins: DataFrame, tags: str = "tags") -> DataFrame:
    return checkins.withColumn("tag", F.explode(tags)).drop(tags)


def tag_counts(checkins: DataFrame, by: list[str] = ["user_id"]) -> DataFrame:
    return checkins.groupBy(*by, "tag").agg(F.count("*").alias("n"))


def tag_suggestions(checkins: DataFrame, chosen: DataFrame, defaults: list[str], user: str = "user_id", n: int = 10) -> DataFrame:
    """Up to n tags: own ones by recency, then the defaults, without those already chosen (user, chosen array).

    Recency is one row per (user, tag); chosen tags go first, then only the n newest are put together.
    """
    own = checkins.groupBy(user, "tag").agg(F.max("created_at").alias("_t"))
    free = own.join(chosen.select(user, F.explode("chosen").alias("tag")), [user, "tag"], "left_anti")
    top = newest_n(free, [user], ["_t", "tag"], n).groupBy(user).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_t", "tag")), asc=False), lambda x: x["tag"]).alias("_own"))
    none = F.array().cast("array<string>")
    d = own.select(user).distinct().join(top, user, "left").join(chosen, user, "left")
    pool = F.array_distinct(F.concat(F.coalesce("_own", none), F.array(*[F.lit(t) for t in defaults])))
    return d.select(user, F.slice(F.array_except(pool, F.coalesce("chosen", none)), 1, n).alias("tags"))


def filtered(checkins: DataFrame, *, tag: str | None = None, day: Column | None = None, month: Column | None = None,
             last_days: int | None = None, now: Column | None = None) -> DataFrame:
    d = F.to_date("created_at")
    out = checkins
    if tag is not None:
        out = out.filter(F.col("tag") == tag)
    if day is not None:
        out = out.filter(d == day)
    if month is not None:
        out = out.filter(F.trunc(d, "MM") == F.trunc(month, "MM"))
    if last_days is not None:
        out = out.filter((F.datediff(now, d) >= 0) & (F.datediff(now, d) < last_days))
    return out


def suggestion(checkins: DataFrame, now: Column, user: str = "user_id") -> DataFrame:
    """One sentence per user from recency, this week's tags and the calmest day."""
    ws = week_start(now)
    day = F.to_date("created_at")
    week = (day >= ws) & (F.col("created_at") <= now)
    scored = week & F.col("fused").isNotNull()
    base = checkins.filter(F.col("created_at") <= now)
    agg = base.groupBy(user).agg(
        F.max("created_at").alias("_last"), F.count(F.when(week, 1)).alias("_week"), F.count(F.when(scored, 1)).alias("_scored"),
        F.min(F.when(scored, F.struct(F.col("fused"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("_o"), day.alias("d")))).alias("_calm"))
    tags = tag_trends(base.filter(week), [user])
    best = tags.groupBy(user).agg(F.max(F.struct(F.col("mean_score").alias("m"), F.col("tag").alias("t"))).alias("_tag"))
    today = F.to_date(now)
    since = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))
    last_day = F.to_date("_last")
    name = lambda d: F.date_format(d, "EEEE")
    old = F.concat(F.lit("You haven't done a check-in since "),
                   F.when(F.datediff(today, last_day) == 1, "yesterday").otherwise(name(last_day)), F.lit("."))
    high = F.concat(F.lit('This week, check-ins tagged "'), F.col("_tag.t"), F.lit('" read highest, averaging '),
                    signed(F.round("_tag.m", 6)), F.lit("."))
    calm = F.concat(F.col("_week").cast("string"), F.when(F.col("_week") == 1, " check-in").otherwise(" check-ins"),
                    F.lit(" this week. Your calmest was "),
                    F.when(F.col("_calm.d") == today, "today").otherwise(name(F.col("_calm.d"))), F.lit("."))
    text = (F.when(since > 2 * 86_400_000_000, old)
            .when((F.col("_scored") >= 3) & (F.col("_tag.m") >= 0.1), high).when(F.col("_scored") >= 3, calm)
            .when(last_day == today, "You have checked in today. Another one later helps you compare your morning and evening.")
            .otherwise("A check-in at about the same time each day makes days easier to compare."))
    return agg.join(best, user, "left").select(user, text.alias("suggestion"))


def newest_first(checkins: DataFrame, now: Column) -> DataFrame:
    """Listing, newest first, with a relative day label."""
    return (checkins.withColumn("label", relative_day(F.to_date("created_at"), F.to_date(now)))
            .orderBy(F.desc("created_at"), F.desc("id")))
