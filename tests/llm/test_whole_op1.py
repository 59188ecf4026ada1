"""What the first review found missing in op1: fails on the code that did less."""

import pytest

from coppice.llm import mixing


@pytest.mark.parametrize("text,want", [("see the MIT LICENSE here", "legal"), ("COPYRIGHT NOTICE", "legal"), ("a Licence", "legal"), ("copyRight", "legal"), ("ask me: a.b-c@host.x", "contact"), ("thanks to @host.x", "prose"), ("call +49 (30)", "contact"), ("@host.x https://a", "web"), (None, "prose")])
def test_topics_take_capitals_and_whole_addresses(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(mixing.topic(mixing.F.col("text"))).first()[0] == want
