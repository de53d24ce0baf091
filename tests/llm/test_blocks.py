"""Sections follow the bytes of the texts, whatever made the rows."""

from pyspark.sql import functions as F

from epiframe.llm import blocks, bpe

SF = "/root/testdata/sf0.001"


def test_a_joined_input_has_no_more_sections(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    joined = docs.join(labels, "doc_id", "left").join(sources, "source")
    assert blocks.sections(docs) == blocks.sections(joined) == blocks.sections(docs.limit(0)) == 8
    key = lambda r: (r.doc_id, list(r.ids))
    assert sorted(map(key, bpe.encode(joined).collect())) == sorted(map(key, bpe.encode(docs).collect()))
