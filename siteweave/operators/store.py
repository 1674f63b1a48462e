"""Session tables: queue, status log and results, append-only with latest-wins reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUEUE = "fetch_url string, dedup_key string, depth int, page_type string, page_weight double"
STATUS = "fetch_url string, status string, seq long"
RESULTS = "url string, data string, seq long"
META = "key string, value string"


def latest(log: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    """The last value of each key: a mergeable maximum in place of an update."""
    return log.groupBy(key).agg(F.max_by(value, order).alias(value))


def pending(queue: DataFrame, status: DataFrame) -> DataFrame:
    """Queue rows whose last status is pending, or that have none yet."""
    now = latest(status, "fetch_url", "status")
    return queue.join(now, "fetch_url", "left").where(F.coalesce("status", F.lit("pending")) == "pending").drop("status")


def seen_keys(queue: DataFrame, status: DataFrame) -> DataFrame:
    """Dedup keys of all rows that are no longer pending; rows under way count as seen."""
    now = latest(status, "fetch_url", "status").where("status <> 'pending'")
    return queue.join(now, "fetch_url", "left_semi").where("dedup_key <> ''").select("dedup_key").distinct()


class SessionStore:
    """A crawl session in Parquet tables under one folder; a crawl can be resumed from it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def initialize(self) -> None:
        """Create what is missing, with the schema's version."""
        for name, schema in (("queue", QUEUE), ("status", STATUS), ("results", RESULTS)):
            self._append(name, self.spark.createDataFrame([], schema), schema)
        if self._read("meta", META).isEmpty():
            self._append("meta", self.spark.createDataFrame([("schema_version", "1")], META), META)

    def _append(self, name: str, rows: DataFrame, schema: str) -> None:
        columns = [c.split()[0] for c in schema.split(", ")]
        rows.select(*columns).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def enqueue(self, rows: DataFrame) -> None:
        """Add rows of new fetch_urls; ones already there are ignored."""
        fresh = rows.dropDuplicates(["fetch_url"]).join(self._read("queue", QUEUE), "fetch_url", "left_anti")
        self._append("queue", fresh, QUEUE)

    def mark(self, rows: DataFrame) -> None:
        self._append("status", rows, STATUS)

    def save_results(self, rows: DataFrame) -> None:
        """Save results as JSON of all columns but url and seq."""
        data = F.to_json(F.struct(*[c for c in rows.columns if c not in ("url", "seq")]))
        self._append("results", rows.withColumn("data", data), RESULTS)

    def pending(self) -> DataFrame:
        return pending(self._read("queue", QUEUE), self._read("status", STATUS))

    def seen(self) -> DataFrame:
        return seen_keys(self._read("queue", QUEUE), self._read("status", STATUS))

    def results(self) -> DataFrame:
        return latest(self._read("results", RESULTS), "url", "data")

    def clear(self) -> None:
        """Empty queue, status and results; the meta table stays."""
        for name, schema in (("queue", QUEUE), ("status", STATUS), ("results", RESULTS)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")
