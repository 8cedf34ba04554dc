"""Reports as datasets complete: every dataset once, at the batch in which its last planned record has come."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.records import SCORED


def progress(records: DataFrame, keys: list[str], dataset: str = "dataset_id", status: str = "status", score: str = "score") -> DataFrame:
    """Per dataset, as records come: n, n_scored, n_error, total and n_values of the score, in update mode.

    A record that comes again counts once.  What is kept is a key for each
    record, spread over all tasks, and a row for each dataset; a dataset with
    most of the rows is added up before it is shuffled.
    """
    first = records.dropDuplicates([dataset, *keys])
    scored = F.col(status).isin(*SCORED)
    value = F.when(scored & ~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    return first.groupBy(dataset).agg(F.count("*").alias("n"), F.count_if(scored).alias("n_scored"), F.count_if(F.col(status) == "error").alias("n_error"), F.sum(value).alias("total"), F.count(value).alias("n_values"))


class CompletionReport:
    """A foreachBatch sink of `progress`: appends the datasets that this batch completes, and says what is complete so far.

    planned: dataset, planned (rows).  A batch that is run again writes the same
    report again.  A dataset that gets more records than were planned is not
    reported a second time; one without a plan is never complete.
    """

    def __init__(self, path: str, planned: DataFrame, dataset: str = "dataset_id"):
        self.path, self.planned, self.dataset = path, planned, dataset

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All datasets that are complete, with the batch that completed them."""
        try:
            return spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        found = batch.join(self.planned.select(self.dataset, "planned"), self.dataset).where("n >= planned")
        before = self.read(batch.sparkSession)
        if before is not None:
            found = found.join(before.where(F.col("batch") < epoch).select(self.dataset), self.dataset, "left_anti")
        report = found.select(self.dataset, "planned", "n", "n_scored", "n_error", F.when(F.col("n_values") > 0, F.col("total") / F.col("n_values")).otherwise(0.0).alias("score"), (F.col("n_scored") / F.col("planned")).alias("coverage"))
        # a row for each dataset; coalesced, one task would hold the state of all partitions
        report.repartition(1).write.mode("overwrite").parquet(f"{self.path}/batch={epoch}")
