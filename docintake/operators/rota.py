"""Duty rotation: rosters, the calendar, and the reminder ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_roster(lists: DataFrame) -> DataFrame:
    """ordinal, name, user_id from texts (list_id, text) of members, ``name=ou_id``, ``ou_id`` or a name alone,
    divided by commas and line breaks; of members with one key the first stays."""
    member = F.trim("member")
    pattern = r"^(?:([^=:@]+)\s*[=:]\s*)?(ou_[A-Za-z0-9_-]+)$"
    rows = lists.select("list_id", F.posexplode(F.split("text", "[,\n]")).alias("pos", "member")).select("list_id", "pos", member.alias("member")).filter("member <> ''")
    ident, name = F.regexp_extract("member", pattern, 2), F.trim(F.regexp_extract("member", pattern, 1))
    rows = rows.select("list_id", "pos", F.when(ident != "", F.when(name != "", name).otherwise(ident)).otherwise(F.col("member")).alias("name"), F.when(ident != "", ident).otherwise(F.col("member")).alias("user_id"))
    first = F.row_number().over(Window.partitionBy("list_id", "user_id").orderBy("pos"))
    rows = rows.withColumn("n", first).filter("n = 1")
    return rows.select("list_id", (F.row_number().over(Window.partitionBy("list_id").orderBy("pos")) - 1).alias("ordinal"), "name", "user_id")


def replace_roster(members: DataFrame) -> DataFrame:
    """Contiguous ordinals from 0 after blank ids are dropped (list_id, ordinal, name, user_id)."""
    rows = members.filter(F.trim("user_id") != "")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("list_id").orderBy("ordinal")) - 1)


def rotation(dates: DataFrame, roster: DataFrame, start: Column) -> DataFrame:
    """The member on duty at each date: the roster's ((date - start) mod size)-th, also before the start.

    The roster is a list of people: its size is counted first, and dates meet members by number. Without members
    nobody is on duty."""
    size = max(roster.count(), 1)
    days = dates.withColumn("ordinal", F.pmod(F.datediff("date", F.coalesce(start, F.col("date"))), F.lit(size)))
    return days.join(roster.select(F.col("ordinal").cast("int").alias("ordinal"), "name", "user_id"), "ordinal").select("date", "ordinal", "name", "user_id")


def calendar(first: Column, last: Column, frame: DataFrame) -> DataFrame:
    return frame.select(F.explode(F.sequence(first, last)).alias("date")).distinct()


def reminder_texts(assigned: DataFrame) -> DataFrame:
    """date and text with the members of that day and the next (date, name); the rows of the day after serve as
    the next day's, so days are matched by date, not collected in one order."""
    after = assigned.select(F.date_sub("date", 1).alias("date"), F.col("name").alias("next_name"))
    got = assigned.join(after, "date", "left")
    return got.select("date", F.concat(F.lit("今天（"), F.col("date").cast("string"), F.lit("）值班："), "name", F.lit("\n明天（"), F.date_add("date", 1).cast("string"), F.lit("）值班："), F.coalesce("next_name", F.lit("未配置"))).alias("text"))


def reminder_ledger(log: DataFrame) -> DataFrame:
    """date, status, attempts from a log (date, seq, event) of reserve, sent and failed. A date that was sent
    takes no more reservations; attempts are the reservations before that."""
    sent = F.min(F.when(F.col("event") == "sent", F.col("seq")))
    first = log.groupBy("date").agg(sent.alias("sent_seq"))
    rows = log.join(first, "date").filter(F.col("sent_seq").isNull() | (F.col("seq") <= F.col("sent_seq")))
    status = F.max_by("event", "seq")
    got = rows.groupBy("date").agg(F.count_if(F.col("event") == "reserve").alias("attempts"), status.alias("last"))
    return got.select("date", F.when(F.col("last") == "reserve", "sending").otherwise(F.col("last")).alias("status"), "attempts")


def due_dates(dates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Dates whose reminder hasn't been sent."""
    return dates.join(ledger.filter("status = 'sent'").select("date"), "date", "left_anti")
