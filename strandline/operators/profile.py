"""Where the time of an alignment goes: seconds of each stage, per task, and their spread over tasks."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages that Aligner.profile() tells apart, in the order in which a read goes through them.
STAGES = ["seeds", "chains", "filter", "extend", "distinct", "rank", "records"]


class Clock:
    """clock(stage, f, *args) is f(*args); the seconds that it takes are added to those of the stage."""

    def __init__(self):
        self.seconds = dict.fromkeys(STAGES, 0.0)

    def __call__(self, stage, f, *args):
        began = time.perf_counter()
        try:
            return f(*args)
        finally:
            self.seconds[stage] += time.perf_counter() - began


def summary(spent: DataFrame, stage: str, worker: str, amount: Column) -> DataFrame:
    """A row per stage: over its workers, how many there are and the total, least, greatest and mean amount of one worker.

    Amounts of one worker are added up first. Null amounts count as nothing; a stage of null amounts only has null figures."""
    each = spent.groupBy(F.col(stage).alias("stage"), F.col(worker).alias("_worker")).agg(F.sum(amount).alias("_amount"))
    return each.groupBy("stage").agg(
        F.count("*").alias("workers"), F.sum("_amount").alias("total"), F.min("_amount").alias("least"), F.max("_amount").alias("greatest"), F.avg("_amount").alias("mean")
    )
