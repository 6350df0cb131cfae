"""SparkSession defaults for the metric jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job wants regardless of cluster size. Shuffle partitions and
# file split size are left to the cluster (and to AQE, which coalesces small
# partitions and splits skewed ones at runtime).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "keelson", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sized_conf(input_bytes: int, total_cores: int, split_bytes: int = 256 << 20,
               shuffle_bytes_per_partition: int = 256 << 20, shuffle_ratio: float = 0.25) -> dict[str, str]:
    """Partitioning settings for a job reading ``input_bytes`` on ``total_cores``.

    - scan splits of ``split_bytes`` (``spark.sql.files.maxPartitionBytes``)
    - initial shuffle partitions sized for the largest shuffle, estimated as
      ``shuffle_ratio`` of the input after map-side combining (the usage
      rollup), at ``shuffle_bytes_per_partition`` each and at least two per core.
      AQE then coalesces small partitions to the advisory size and splits
      skewed ones.

    At 100 TB on 1000 executors x 8 cores this gives 256 MB splits (~400k
    scan tasks) and ~100k initial shuffle partitions, which AQE coalesces
    after measuring the actual map output.
    """
    shuffle_parts = max(2 * total_cores, int(input_bytes * shuffle_ratio // shuffle_bytes_per_partition) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_bytes_per_partition // 2),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 << 20),
    }
