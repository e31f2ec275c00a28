"""The parcel table and the tasks it is made in."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plotshift.sources import parcels as P


def test_rows_of_one_row_group_are_dealt(spark, tmp_path, monkeypatch):
    """A file with many splits and all rows in one row group is not left to a single task."""
    monkeypatch.setattr(P, "ORDERS_AT_ONCE", 500, raising=False)
    n = 4000
    day = pa.scalar(0, pa.timestamp("us"))
    table = pa.table({"o_orderkey": pa.array(range(n), pa.int64()), "o_orderdate": pa.array([day.as_py()] * n, pa.timestamp("us"))})
    pq.write_table(table, tmp_path / "orders.parquet", row_group_size=n, compression="none", use_dictionary=False)
    keys = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "2048")
        df = P.parcels(spark, str(tmp_path))
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert sum(sizes) == n and len(sizes) >= 8 and max(sizes) < 1000
