"""The attention layer of op3 learns from every training text: fails on the code that drew a share of all windows."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from coppice.llm import attention_lm, tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_every_text_moves_the_layer(spark):
    letters = "abcdefghijklmnopqrst"
    texts = [f"{a}{b} " * 10 for a in letters for b in letters]
    coded = tokens.encode(pa.array(texts), tokens.encoder_of(TOKENIZER), attention_lm.BOUNDARY)
    by_id = np.bincount(coded.ids, minlength=attention_lm.VOCABULARY).astype(float)
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    net = attention_lm.fit(train, TOKENIZER, by_id, least_windows=1, rounds=1)
    began = np.random.default_rng(0).standard_normal(net.p["emb"].shape) * 0.3
    own = net.row_of[np.unique(coded.ids)]
    assert len(own) > 100 and (np.abs(net.p["emb"][own] - began[own]).max(1) > 1e-6).all()


def test_every_id_is_a_target_once():
    rng = np.random.default_rng(3)
    ids, b = [rng.integers(0, 900, n) for n in (0, 1, 46, 47, 48, 49, 83, 84, 85, 500)], attention_lm.BOUNDARY
    column = attention_lm.whole(tokens.Coded(np.concatenate([np.append(x, b) for x in ids]), np.cumsum([0, *(len(x) + 1 for x in ids)]), None, None))
    held = [np.frombuffer(x, np.uint16).tolist() for x in column.to_pylist()]
    assert held == [[b, *x, b] for x in ids]
    for parts in (1, 3):
        seen = []
        for part in range(parts):
            w, first = attention_lm.cover(*attention_lm._held(column.slice(0)), np.arange(len(ids)), 48, part, parts)
            for x, begins in zip(w.tolist(), first):
                assert begins == (x[0] == b)
                seen += [(x[max(0, i - 12) : i], x[i]) for i in range(1 if begins else 13, 49) if x[i] != attention_lm.NONE]
        want = [(x[max(0, i - 12) : i], x[i]) for x in held for i in range(1, len(x))]
        assert sorted(seen) == sorted(want)
    one, _ = attention_lm.cover(*attention_lm._held(column.slice(9)), np.arange(1), 48)
    assert one[0].tolist() == held[9][:49]


def test_classes_come_from_every_text(spark):
    """Rare ids are grouped on the executors as all neighbours in all texts have it."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    texts = [" ".join(rng.choice(words, 60, p=np.arange(400, 0, -1) / 80200)) for _ in range(120)]
    coded = tokens.encode(pa.array(texts), tokens.encoder_of(TOKENIZER), attention_lm.BOUNDARY)
    by_id = np.bincount(coded.ids, minlength=attention_lm.VOCABULARY).astype(float)
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    net = attention_lm.fit(train, TOKENIZER, by_id, singles=8, groups=2, least_windows=1, rounds=1)
    stream = np.concatenate([[-1, attention_lm.BOUNDARY, *coded.ids[a:b]] for a, b in zip(coded.edge, coded.edge[1:])])[None]
    cell, n = attention_lm.neighbours(stream, attention_lm.sides_of(by_id))
    want, ids = attention_lm.classes_of(by_id, (cell // (2 * attention_lm.SIDES), cell % (2 * attention_lm.SIDES), n.astype(float)), 8, 2)
    assert len(ids) > 8 + 2 * attention_lm.PER_GROUP + 100 and (net.class_of == want).all()
