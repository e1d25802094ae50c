import numpy as np
import pytest

from keystrata.llm import suffix_dedup
from tests.llm.test_operators import collected, cut_of


@pytest.mark.parametrize("ids", [[1], [1, 2, 3], [1000], [1000, 1001, 1002]])
def test_a_seed_common_in_one_batch_still_meets_the_others(spark, ids):
    """A passage that one batch holds in over COMMON contexts and another batch in a single one, with smaller or larger ids."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    hot, before, behind = word(60), word(40), word(40)
    many = [(100 + i, f"{word(40)}{hot}{word(40)}") for i in range(2 * suffix_dedup.COMMON)]
    one = [(i, before + hot + behind) for i in ids]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([many, one], 2).flatMap(lambda rows: rows), "doc_id long, text string")  # a partition each
    expected = cut_of(many + one)
    assert sum(r[2] >= 60 for r in expected) == len(expected) - 1
    assert collected(suffix_dedup.shared_spans(docs)) == expected
