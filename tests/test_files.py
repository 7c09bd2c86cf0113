import hashlib

import pytest
from pyspark.sql import functions as F

from tilecask.functions import quality
from tilecask.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in files.fingerprints(spark, f"file://{tmp_path}").collect()}
    assert got == {"x.bin": (3, hashlib.sha256(b"abc").hexdigest())}
    assert files.stored_bytes(spark, f"file://{tmp_path}") == 3
    rows = spark.createDataFrame([(1, 0, [1.0, 3.0, 3.0])], "case_id bigint, pos int, logits array<float>")
    files.write_logits(rows, f"{tmp_path}/logits")
    with pytest.raises(Exception, match="already exists"):
        files.write_logits(rows, f"{tmp_path}/logits")
    row = rows.select(quality.top(F.col("logits")).alias("t"), F.round(quality.nll(F.col("logits"), F.lit(0)), 6).alias("n")).first()
    assert row["t"] == 2 and abs(row["n"] - 2.758624) < 1e-5
