"""Physical-plan properties: pushdown, pruning, map-side aggregation, and the
vectorized (Arrow) path for the one Python step."""

from bitext.operators import vocab as V
from bitext.plans import fixtures as fx
from bitext.plans import registry

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_role_filter_pushed_into_scan(spark):
    plan = _plan(fx.line_pairs(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan
    assert "EqualTo(role,assistant)" in plan


def test_document_scan_reads_only_needed_columns(spark):
    plan = _plan(fx.mono(spark, SF_SMALL))
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "text" in schema and "doc_id" in schema
    assert "lang" not in schema and "source" not in schema and "n_chars" not in schema


def test_word_counts_combine_map_side(spark):
    plan = _plan(registry.queries()["word_counts"](spark, SF_SMALL))
    assert "partial_count" in plan


def test_bpe_encode_is_vectorized(spark):
    words = V.word_counts(fx.vocab_corpus(spark, SF_SMALL))
    model = V.train_bpe(words, max_merges=3)
    from pyspark.sql import functions as F

    plan = _plan(fx.line_pairs(spark, SF_SMALL).select(V.bpe_encode_column(model, F.col("src"))))
    assert "ArrowEvalPython" in plan
    assert "BatchEvalPython" not in plan
