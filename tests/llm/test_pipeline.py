"""The pipeline on small tables: each stage works on what the one before kept."""

import __spark_entry__
import corpus_pipeline

from pulse.llm.queries import QUERIES

from test_packing import check

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs = after
        kept.append(docs.count())
    assert kept[1] == kept[2] and kept[3] == kept[4] and kept[0] >= kept[1] > 0 and kept[2] > kept[3] > 0
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    check(rows, 4096)
