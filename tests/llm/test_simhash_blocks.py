"""Pairs of blocks of one hot key are dealt out anew before they are compared."""

from keepwell.llm import simhash


def test_block_pairs_are_dealt_out(spark):
    plan = simhash.links(spark.createDataFrame([(i,) for i in range(50)], "fp long"))._jdf.queryExecution().optimizedPlan().toString()
    assert any("RepartitionByExpression" in x and "block" in x and "other" in x for x in plan.split("\n")), plan
