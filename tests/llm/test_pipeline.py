"""The pipeline's stages keep what they should, each on what its predecessor kept."""

import corpus_pipeline
from assayframe.llm import bpe, simhash, toxicity
from assayframe.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        kept.append(out.count())
        docs = out
    assert table(spark, sf_dir, "documents").count() >= kept[0] >= kept[1] == kept[2] >= kept[3] > 0
    assert toxicity.keep_clean(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).count() == kept[0]
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == kept[-1]
    assert simhash.near_groups(docs).count() == kept[-1] and bpe.load_ranks
