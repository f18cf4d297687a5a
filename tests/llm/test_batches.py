import corpus_pipeline as pipeline
import pyarrow as pa
from verity.llm import common

SF = "/root/testdata/sf0.1"


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])


def test_python_gets_small_batches(spark):
    """By the tables that operators read, and by a stage of the pipeline that is given its documents."""
    spark.conf.unset(common.BATCH_SETTING)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").coalesce(1)
    count = lambda: docs.mapInArrow(sizes, "n long, b long").collect()
    assert max(r.b for r in count()) > 2 * common.BATCH_BYTES
    for ask in (lambda: common.table(spark, SF, "documents"), lambda: pipeline.packing(spark, docs.limit(0).selectExpr("1L as doc_id", "text"), SF)):
        spark.conf.unset(common.BATCH_SETTING)
        ask()
        got = count()
        assert max(r.b for r in got) < 2 * common.BATCH_BYTES and sum(r.n for r in got) == docs.count()
