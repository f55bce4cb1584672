"""Candidate pairs for similarity joins by prefix filtering (Chaudhuri et al. 2006).

Tokens of a record are ordered from rare to frequent. If two records must share
at least ``need`` of their tokens, their first ``size - need + 1`` tokens in that
order have one in common, so only those are joined. No pair that could qualify
is lost, and the frequent tokens, which would pair everything with everything,
take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import settle


def numbered(rows: DataFrame, keys: list[str], token: str) -> DataFrame:
    """(keys..., tokens): one row per key from one row per token, the k-th occurrence of x becoming (x, k).

    Counting comes before numbering, so the cost is linear in the tokens. A record's
    tokens are collected into one row, as they were before.
    """
    counted = rows.groupBy(*keys, token).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    each = counted.select(*keys, token, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"))
    return each.groupBy(*keys).agg(F.collect_list(F.concat(F.col(token), F.lit("\u0001"), F.col("_k").cast("string"))).alias("tokens"))


def prefixes(records: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., token) for each record's rarest size - need + 1 tokens.

    ``records``: keys..., tokens array (distinct), need. A record is one row of
    bounded size, so collecting its tokens back stays within one row.
    """
    spread = records.select(*keys, "need", F.explode("tokens").alias("token"))
    ranked = (spread.join(frequency, "token")
              .groupBy(*keys, "need").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("order")))
    kept = F.greatest(F.size("order") - F.col("need") + 1, F.lit(0))
    return (ranked.select(*keys, F.explode(F.slice("order", F.lit(1), F.greatest(kept, F.lit(0)))).alias("o"))
            .select(*keys, F.col("o.token").alias("token")))


def candidate_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Distinct (left_id, right_id) that share a prefix token within a family; without ``right`` the left with itself, left_id < right_id.

    Both sides: id, family, tokens, need. Hot tokens only meet when they are among
    a record's rarest; AQE splits a join partition that still turns out large.
    """
    spread = left.select("family", F.explode("tokens").alias("token"))
    if right is not None:
        spread = spread.unionByName(right.select("family", F.explode("tokens").alias("token")))
    frequency = spread.select(F.concat_ws("\u0002", "family", "token").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("f"))
    tagged = lambda df: df.withColumn("tokens", F.transform(
        "tokens", lambda t: F.concat(F.col("family"), F.lit("\u0002"), t))).filter("need > 0")
    lp = prefixes(tagged(left), frequency, ["id"]).withColumnRenamed("id", "left_id")
    if right is None:
        lp = settle(lp, "prefixes")
        return lp.join(lp.withColumnRenamed("left_id", "right_id"), "token").filter("left_id < right_id").select("left_id", "right_id").distinct()
    rp = prefixes(tagged(right), frequency, ["id"]).withColumnRenamed("id", "right_id")
    return lp.join(rp, "token").select("left_id", "right_id").distinct()
