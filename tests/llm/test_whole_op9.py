"""What the first review found missing in op9: fails on the code that did less."""

import math

import numpy as np
from pyspark.sql import functions as F

from coppice.llm import embedding_dedup


def pairs_at(cosine, n, d, rng):
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, d))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, a * cosine + b * math.sqrt(1 - cosine**2)


def test_no_link_is_lost_among_a_thousand_cells():
    rng = np.random.default_rng(8)
    a, b = pairs_at(0.9001, 1500, 64, rng)
    c = rng.standard_normal((1000, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    (ha, ca), (hb, cb) = embedding_dedup.lookups(a, c, 0.9), embedding_dedup.lookups(b, c, 0.9)
    rows = np.arange(len(a))
    assert ((ha == hb) | ca[rows, hb] | cb[rows, ha]).all()
    assert not (ca[rows, hb] & cb[rows, ha]).any()  # nor evaluated twice
    # Cells that can't hold a link are left out: tight clusters look up few.
    near = c[rng.integers(0, 1000, 300)] + 0.01 * rng.standard_normal((300, 64))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    assert embedding_dedup.lookups(near, c, 0.9)[1].sum(1).mean() < 50


def test_links_of_dispersed_vectors_are_exact(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([*pairs_at(0.902, 500, 64, rng), rng.standard_normal((600, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = (x @ x.T >= 0.9).sum(1) - 1
    for how in ({"most_lookups": 1e9}, {}):
        got = embedding_dedup.near_duplicates(df, cell_size=16, block=300, **how).orderBy("vec_id").toPandas()
        assert got.n_links.tolist() == want.tolist()


def test_every_length_has_links(spark):
    """Two lengths have centroids here, the other three don't; before, lengths past the 64 most common were dropped."""
    rows = [(100 * d + i, [float(d)] + [1.0 + i / 100] * (d - 1)) for d in range(2, 7) for i in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(df, lengths=2).where(F.col("n_links") != 1).count() == 0
