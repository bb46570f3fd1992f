"""A batch-fitted preprocessing pipeline applied to a file stream."""

import os
import tempfile

from pyspark.sql import functions as F

from ebbtide.operators.preprocess import build_preprocessing_pipeline
from ebbtide.plans.fixtures import build_cust_feat
from ebbtide.operators.split import stratified_split
from ebbtide.streaming.scoring import read_stream, score_stream
from tests.conftest import SF_SMALL


def test_stream_scoring_matches_batch(spark):
    tmp = tempfile.mkdtemp(prefix="ebbtide-stream-")
    stratified_split(build_cust_feat(spark, SF_SMALL), "cust_id", "churn").write.parquet(os.path.join(tmp, "split"))
    data = spark.read.parquet(os.path.join(tmp, "split"))  # the fit starts from files, not from the joins
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = build_preprocessing_pipeline().fit(data.where("split = 'train'"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # a fit leaves nothing cached
    src = os.path.join(tmp, "in")
    data.where("split = 'test'").withColumn("fold", F.lit(None).cast("int")).write.parquet(src)
    test = spark.read.parquet(src)
    q = score_stream(model, read_stream(spark, src, test.schema), os.path.join(tmp, "out"), name="t",
                     available_now=True)
    q.awaitTermination(300)
    out = spark.read.parquet(os.path.join(tmp, "out"))
    batch = model.transform(test)
    assert sorted(out.columns) == sorted(batch.columns)
    key = lambda r: r["cust_id"]
    streamed = sorted(out.select(*batch.columns).collect(), key=key)
    assert streamed and streamed == sorted(batch.collect(), key=key)
