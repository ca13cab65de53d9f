"""Ranking replies and level quotas: which candidates are checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import LEVELS, level_quota, level_rank


def rank_candidates(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates (doc_id, cand_id, ...) in the order of a reply (doc_id, ranked_ids).

    An id counts at its first place; ids outside the candidates drop out, and so do
    candidates that a usable reply leaves out.  A document without a usable reply keeps
    the order of generation."""
    ids = replies.select("doc_id", F.posexplode("ranked_ids").alias("pos", "cand_id")).groupBy("doc_id", "cand_id").agg(F.min("pos").alias("pos"))
    joined = candidates.join(ids, ["doc_id", "cand_id"], "left")
    usable = F.max(F.col("pos").isNotNull()).over(Window.partitionBy("doc_id"))
    order = Window.partitionBy("doc_id").orderBy("pos", "cand_id")
    return joined.withColumn("_u", usable).where(~F.col("_u") | F.col("pos").isNotNull()).withColumn("rank", F.row_number().over(order)).drop("_u", "pos")


def select_by_level(ranked: DataFrame, n: int) -> DataFrame:
    """The best of each level up to its quota, shortfalls filled by rank; then the rest.

    Adds picked and place (order in which candidates are tried): picks by level and rank,
    then the others by rank."""
    quota = F.create_map(*(F.lit(x) for pair in level_quota(n).items() for x in pair))
    in_level = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("rank"))
    within = F.col("type").isin(*LEVELS) & (in_level <= F.coalesce(F.try_element_at(quota, F.col("type")), F.lit(0)))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("_q"), "rank"))
    out = ranked.withColumn("_q", F.coalesce(within, F.lit(False))).withColumn("picked", first <= n)
    place = Window.partitionBy("doc_id").orderBy(F.desc("picked"), F.when(F.col("picked"), level_rank("type")), "rank")
    return out.withColumn("place", F.row_number().over(place)).drop("_q")


def order_by_level(questions: DataFrame, by: str = "rank") -> DataFrame:
    return questions.orderBy("doc_id", level_rank("type"), by)


def candidate_plan(n: int, chunks: int, factor: float = 1.5) -> dict[str, int]:
    """How many candidates to ask for: in all, per chunk, and in the pass over the whole document.

    Halves of the last round to even."""
    target = -int(-n * factor // 1)
    return {"target": target, "per_chunk": max(3, -(-target // chunks)) if chunks else 0, "overview": max(2, round(target * 0.2 * 1.5))}
