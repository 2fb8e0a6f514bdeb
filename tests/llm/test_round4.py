"""Plans whose sizes Spark reckons too low."""

import re

from ledgerweave.llm import simhash


def test_postings_are_never_broadcast(spark):
    """An explode is sized as if every fingerprint had one posting, so the join of thin keys is not left to the estimate."""
    fps = spark.range(4000).selectExpr("xxhash64(id) as fp")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    kinds = re.findall(r"(\w+Join)\b[^\n]*bit_count", plan)
    assert kinds and set(kinds) == {"SortMergeJoin"}, plan
