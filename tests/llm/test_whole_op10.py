"""What the first review found missing in op10: fails on the code that did less."""

from coppice.llm import langid


def test_a_language_of_copies_is_learnt(spark):
    """Twenty distinct texts in 4,000 rows: a rate of per_language / rows draws none of them."""
    rows = [(f"wort schön grün {'abcdefghijklmnopqrst'[i % 20]}ung", "de") for i in range(4000)] + [(f"the word {i} thing", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs, per_language=20)
    assert model.languages == ("de", "en")
    assert model.predict(["wort schön grün aung"])[0] == ["de"]
    # Copies count once: the same model as from each text once.
    once = langid.train(docs.distinct(), per_language=20)
    assert (model.scores == once.scores).all() and (model.allowed == once.allowed).all()
