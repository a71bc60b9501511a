"""Flow templates on disk: compressed, and read back whole."""

import gzip

from pyspark.sql import functions as F

from weftline.sources import flows


def test_flow_files_are_compressed(spark, tmp_path):
    """As plain text 500 orders took ten times as much."""
    folder = str(tmp_path / "flows")
    flows.write_flows(spark, spark.range(500).select(F.col("id").alias("k")), folder)
    files = list((tmp_path / "flows").glob("part-*"))
    plain = sum(len(gzip.decompress(f.read_bytes())) for f in files)
    assert len(files) == 10 and sum(f.stat().st_size for f in files) * 10 < plain
    assert flows.flow_links(spark, folder).count() == 1000
    assert flows.flow_parameters(spark, folder).count() == 1500
