"""Robots rules: parsing of bodies, and which URLs they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import origin


def robots_rules(df: DataFrame, body: str = "body", origin_col: str = "origin") -> DataFrame:
    """origin, grp, agents, type, path: one row for each allow or disallow line. User-agent lines in a row share
    a group; a group begins at a user-agent line that follows a rule or nothing."""
    lines = F.split(F.coalesce(body, F.lit("")), "\r?\n", -1)
    df = df.select(F.col(origin_col).alias("origin"), F.posexplode(lines).alias("ord", "line"))
    df = df.withColumn("line", F.trim(F.regexp_extract("line", r"^([^#]*)", 1))).where(F.instr("line", ":") > 0)
    df = df.select("origin", "ord", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("val"))
    df = df.where(F.col("key").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("origin").orderBy("ord")
    agent = F.col("key") == "user-agent"
    new = agent & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    df = df.withColumn("grp", F.sum(new.cast("int")).over(w)).where("grp > 0")
    agents = df.where(agent).groupBy("origin", "grp").agg(F.sort_array(F.collect_set(F.lower("val"))).alias("agents"))
    rules = df.where(~agent & (F.col("val") != "")).select("origin", "grp", F.col("key").alias("type"), F.col("val").alias("path"), "ord")
    return rules.join(agents, ["origin", "grp"]).select("origin", "grp", "agents", "type", "path", "ord")


def robots_allows(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with `allowed`: by the rules of the agent's groups, else of `*`, the longest matching path wins and
    allow wins a tie. An origin without rules allows everything. A path is looked up by its beginnings, those of the
    lengths that rules of its origin have, so the work grows with the paths and the rules and not with their product.
    Different paths of an origin are looked up once."""
    mine = F.array_contains("agents", agent.lower())
    named = rules.withColumn("_mine", mine).where(F.col("_mine") | F.array_contains("agents", "*"))
    own = named.groupBy("origin").agg(F.max("_mine").alias("_own"))
    named = named.join(own, "origin").where(F.col("_mine") | ~F.col("_own")).select("origin", "type", "path")
    tail = F.regexp_replace(F.regexp_replace(F.col(url), r"^https?://[^/?#]+", ""), "#.*$", "")
    tail = F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail))
    asked = urls.withColumns({"_origin": F.lower(origin(F.col(url))), "_tail": tail})
    distinct = asked.select("_origin", "_tail").distinct()
    rules_ = named.groupBy("origin", "path").agg(F.bool_or(F.col("type") == "allow").alias("_allow"), F.bool_or(F.col("type") == "disallow").alias("_disallow"))
    lengths = rules_.groupBy(F.col("origin").alias("_origin")).agg(F.collect_set(F.char_length("path")).alias("_lengths"))  # no more than the longest path has characters
    probe = distinct.join(lengths, "_origin").select("_origin", "_tail", F.explode("_lengths").alias("_n")).where(F.col("_n") <= F.char_length("_tail"))
    probe = probe.select(F.col("_origin").alias("origin"), F.left("_tail", F.col("_n")).alias("path"), "_tail", "_n")
    longest = lambda t: F.max(F.when(F.col(t), F.col("_n")))
    judged = probe.join(rules_, ["origin", "path"]).groupBy(F.col("origin").alias("_origin"), "_tail").agg(longest("_allow").alias("_a"), longest("_disallow").alias("_d"))
    out = asked.join(judged, ["_origin", "_tail"], "left")
    return out.withColumn("allowed", F.col("_d").isNull() | F.coalesce(F.col("_a") >= F.col("_d"), F.lit(False))).select(*urls.columns, "allowed")
