"""Request and response slots: pairing by turn, gate verdicts, what was lost and added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gate as G
from ..functions.text import response_failed


def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", asked: str = "user", answered: str = "assistant") -> DataFrame:
    """Each asking turn with the next turn of its conversation, if that answers it."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = turns.withColumns({"_role": F.lead(role).over(w), "response": F.lead(text).over(w)})
    out = rows.filter(F.col(role) == asked)
    return out.select(conv, turn, F.col(text).alias("source"), F.when(F.col("_role") == answered, F.col("response")).alias("response"))


def gate(pairs: DataFrame, script: str | None = None) -> DataFrame:
    """Pairs with `reason`: request_failed, a structural reason, untranslated, or empty."""
    failed, invalid = response_failed("response"), G.invalid_reason("source", "response")
    late = G.untranslated("source", "response", *([script] if script else []))
    return pairs.withColumn("reason", F.when(failed, "request_failed").when(invalid != "", invalid).when(late, "untranslated").otherwise(""))


def reason_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def echoes(pairs: DataFrame, least: float = 0.92) -> DataFrame:
    """Pairs whose response copies its source, with the ratio."""
    return pairs.filter("response IS NOT NULL").withColumn("ratio", G.copy_ratio("source", "response")).filter(F.col("ratio") >= least)
