"""What the first review found missing in op7: fails on the code that did less."""

import numpy as np
import public_tokenizers

from coppice.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def counts(routes, tokens, window):
    """[window, queue] tokens; every place is taken once."""
    total = sum(tokens)
    out, seen = np.zeros((-(-total // window), len(tokens)), int), np.zeros(total, int)
    for q, n in enumerate(tokens):
        at = 0
        for size in [n // 3, n - n // 3]:
            start, length, seq, off = packing._routed(routes[q], at, size) if size else [np.zeros(0, int)] * 4
            assert length.sum() == size and start.tolist() == [0, *np.cumsum(length)[:-1]][: len(start)]
            at += size
            for w, o, k in zip(seq.tolist(), off.tolist(), length.tolist()):
                seen[w * window + o : w * window + o + k] += 1
                out[w, q] += k
    assert (seen == 1).all()
    return out


def test_two_hundred_sources_hold_their_shares():
    tokens = [400] * 200
    got = counts(packing.routes(tokens, [1.0] * 200, 512, 8), tokens, 512)
    due = np.arange(1, len(got)) * 512 / 200
    # Off by a quantum of the innermost round-robin at most: windows of 64 over 3 queues.
    assert np.abs(got.cumsum(0)[:-1] - due[:, None]).max() < 64 / 3 + 1
    tokens = [5000, 3, 0, 90, 1, 700, 2, 2, 2, 40]
    counts(packing.routes(tokens, [float(i % 3) for i in range(10)], 64, 3), tokens, 64)


def test_pooled_sources_have_their_own_shares(spark):
    rows = [(100 * s + i, "word " * 31, f"s{s:02d}") for s in range(12) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    shares = {f"s{s:02d}": 3.0 if s == 11 else 1.0 for s in range(12)}
    got = packing.pack(docs, TOKENIZER, window=256, shares=shares, max_queues=4).toPandas()
    first = got[got.sequence_id < 8].groupby("queue").length.sum()
    for name, share in shares.items():
        assert abs(first[name] - 8 * 256 * share / 14) < 30, (name, first.to_dict())
