"""Who wrote a comment: bots, owners, humans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "username", "email", "_account_id")


def identities(person: Column) -> Column:
    """An array of the lower-cased non-empty names of a person."""
    return F.filter(F.array_compact(F.array(*(F.lower(person[f].cast("string")) for f in FIELDS))), lambda x: x != "")


def is_owner(author: Column, owner: Column) -> Column:
    """Equal account ids, or any equal non-empty address, user name or name (case counts)."""
    same = [author["_account_id"] == owner["_account_id"]]
    same += [(author[f] == owner[f]) & (author[f] != "") for f in ("email", "username", "name")]
    out = F.lit(False)
    for s in same:
        out = out | F.coalesce(s, F.lit(False))
    return out


def is_automatic(tag: Column) -> Column:
    return F.coalesce(tag.startswith("autogenerated:"), F.lit(False))


def without_bots(messages: DataFrame, bots: DataFrame, names: Column) -> DataFrame:
    """Messages none of whose author's names (an array of strings) is in bots (identity). Bot lists are small, but not assumed to be.

    Authors are told apart by their whole list of names, so every one is looked up once, however much they write.
    """
    keyed = messages.withColumn("_names", names)
    named = keyed.select("_names").distinct().withColumn("identity", F.explode("_names"))
    return keyed.join(named.join(bots, "identity", "left_semi").select("_names").distinct(), "_names", "left_anti").drop("_names")


def human_messages(messages: DataFrame, bots: list[str] | None = None) -> DataFrame:
    """Comments that are not automatic, not by a bot (a literal list of lower-cased names) and not by the change's owner. Needs author, owner, tag."""
    out = messages.filter(~is_automatic(F.col("tag")) & ~is_owner(F.col("author"), F.col("owner")))
    if bots:
        listed = F.array(*(F.lit(b) for b in bots))
        out = out.filter(~F.arrays_overlap(identities(F.col("author")), listed))
    return out


def human_times(messages: DataFrame) -> DataFrame:
    """change_number, times: when humans wrote, ascending. Needs change_number, date."""
    return messages.filter("date is not null").groupBy("change_number").agg(F.array_sort(F.collect_list("date")).alias("times"))


def message_rows(changes: DataFrame) -> DataFrame:
    """One row per message with its position; changes without messages give their comments."""
    own = F.when(F.size("messages") > 0, F.col("messages")).otherwise(F.flatten(F.map_values("comments")))
    return changes.select("change_number", "owner", F.posexplode(own).alias("pos", "m")).select("change_number", "owner", "pos", "m.*")
