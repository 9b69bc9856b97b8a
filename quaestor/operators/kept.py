"""A dashboard that is kept: what results add up to by experiment is stored lot by lot, and a view is laid over the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators.evaluation import KEYS, METRICS
from quaestor.operators.store import Store

STATE, VIEW = "dashboard_state", "v_experiment_dashboard"
AVERAGED = [*METRICS, "latency_ms"]
SUMS = {"n_results": "BIGINT", **{f"{kind}_{m}": t for m in AVERAGED for kind, t in (("sum", "DOUBLE"), ("count", "BIGINT"))}, "total_tokens": "BIGINT", "total_cost": "DECIMAL(28,6)"}


def summed(results: DataFrame) -> DataFrame:
    """What results add to each experiment: their number, sums and numbers of values that are not null. Sums of sums are sums, so lots may come in any order."""
    each = [a for m in AVERAGED for a in (F.sum(F.col(m).cast("double")).alias(f"sum_{m}"), F.count(m).alias(f"count_{m}"))]
    return results.groupBy("experiment_id").agg(F.count("experiment_result_id").alias("n_results"), *each, F.sum("total_tokens").alias("total_tokens"), F.sum("cost").cast("decimal(28,6)").alias("total_cost"))


def create_dashboard(store: Store) -> None:
    """The table of sums, a partition for each lot, and the view of the dashboard over it, the experiments and the models."""
    spark, d = store.spark, store.database
    spark.sql(f"CREATE TABLE IF NOT EXISTS {d}.{STATE} (experiment_id STRING, {', '.join(f'{c} {t}' for c, t in SUMS.items())}, lot STRING) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (lot)")
    total = ", ".join(f"sum({c}) AS {c}" for c in SUMS)
    means = ", ".join(f"sum_{m} / nullif(count_{m}, 0) AS avg_{m}" for m in AVERAGED)
    keys = ", ".join("m.model_name AS embedding_model" if k == "embedding_model" else f"e.{k}" for k in KEYS)
    spark.sql(f"""CREATE OR REPLACE VIEW {d}.{VIEW} AS
      SELECT {keys}, coalesce(n_results, 0) AS total_questions, {means}, total_tokens, total_cost
      FROM {d}.experiments e LEFT JOIN {d}.embedding_models m ON m.embedding_model_id = e.embedding_model_id
      LEFT JOIN (SELECT experiment_id, {total} FROM {d}.{STATE} GROUP BY experiment_id) s ON s.experiment_id = e.experiment_id""")


def add_results(store: Store, results: DataFrame, lot: str) -> None:
    """Adds a lot of results to the sums. Only these results are read; a lot that is given again replaces itself."""
    table = f"{store.database}.{STATE}"
    rows = summed(results).withColumn("lot", F.lit(lot))
    rows.select(*store.spark.table(table).columns).coalesce(1).write.mode("overwrite").insertInto(table)


def compact(store: Store, lot: str = "all") -> None:
    """Makes one lot of all: the sums stay what they are."""
    table = store.spark.table(f"{store.database}.{STATE}")
    lots = [r[0] for r in table.select("lot").distinct().collect()]
    rows = table.groupBy("experiment_id").agg(*(F.sum(c).cast(t).alias(c) for c, t in SUMS.items())).withColumn("lot", F.lit(lot)).select(*table.columns)
    from quaestor.sources.stored import staged

    kept = staged(rows, "compacted")
    for old in lots:
        store.spark.sql(f"ALTER TABLE {store.database}.{STATE} DROP PARTITION (lot = '{old}')")
    kept.write.mode("overwrite").insertInto(f"{store.database}.{STATE}")


def dashboard_view(store: Store) -> DataFrame:
    return store.spark.table(f"{store.database}.{VIEW}")
