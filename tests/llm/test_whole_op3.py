"""What the first review found missing in op3: fails on the code that did less."""

import inspect

import numpy as np
from pyspark.sql import functions as F
from test_operators import random_net

from coppice.llm import attention_lm


def test_language_model_keeps_its_size_and_inner_layer():
    rng = np.random.default_rng(7)
    how = {k: p.default for k, p in inspect.signature(attention_lm.fit).parameters.items()}
    assert (how["context"], how["width"], how["singles"], how["groups"], how["rows"]) == (48, 24, 64, 48, 2048)
    net, *_ = random_net(rng, 900, [rng.integers(0, 900, 400) for _ in range(30)], context=48, singles=64, groups=48)
    assert (net.context, net.p["emb"].shape[1], int(net.class_of.max()) + 1) == (48, 24, 64 + 48)
    assert net.p["w1"].shape == (24, 48) and net.p["w2"].shape == (48, 24)
    x = rng.integers(0, 900, (3, 48))
    y = net.class_of[rng.integers(0, 900, (3, 48))]
    full, _ = net.forward(x)
    want = np.take_along_axis(full - np.log(np.exp(full).sum(2, keepdims=True)), y[..., None], 2)[..., 0]
    assert np.allclose(net.log_class(x, y, slice(0, 48)), want, atol=1e-4)
    # The inner layer's gradient against a difference quotient.
    mask = np.ones(x.shape, np.float32)
    _, g = net.gradients(x, y, mask)
    i, j = np.unravel_index(np.abs(g["w1"]).argmax(), g["w1"].shape)
    loss = []
    for step in (1e-2, -1e-2):
        net.p["w1"][i, j] += step
        loss.append(net.gradients(x, y, mask)[0])
        net.p["w1"][i, j] -= step
    assert np.isclose((loss[0] - loss[1]) / 2e-2, g["w1"][i, j], rtol=0.1)


def test_what_is_learnt_grows_with_the_corpus(spark):
    """Windows are a share of the corpus: twice the texts draw twice the windows, and copies draw the same ones."""
    rng = np.random.default_rng(8)
    texts = spark.createDataFrame([(i, f"{i} " + "abcd " * 2000) for i in range(900)], "id long, text string")
    due = {r["id"]: r["due"] for r in texts.union(texts).select("id", attention_lm.due_windows(F.col("text"), 1e-4).alias("due")).collect()}
    half = sum(due[i] for i in range(450))
    assert abs(half - 450) < 60 and abs(sum(due.values()) - 900) < 80
    own = [" ".join(map(str, rng.integers(0, 900, 2000))) for _ in range(20)]
    keys, n = rng.integers(0, 1 << 60, 20), np.full(20, 3)
    once = attention_lm.pieces(own, n, keys, 48)
    twice = attention_lm.pieces(own + own, np.concatenate([n, n]), np.concatenate([keys, keys]), 48)
    assert len(twice) == 2 * len(once) == 120 and set(twice) == set(once) and len(set(once)) == 60
