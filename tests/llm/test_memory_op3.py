"""What op3 holds in memory on the executors: fails on the code that was stopped over 3000 MB of one."""

import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from coppice.llm import attention_lm, tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def held_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_workers_give_back_what_a_task_held():
    def run(batches):
        own = [np.ones(1000) for _ in range(20_000)]  # 160 MB in small pieces, the last of which outlives the task
        kept.append(own[-1])
        yield from batches

    kept = []
    tokens.encoder_of(TOKENIZER)
    assert list(attention_lm.lean(run, encodes=True)(iter([1, 2]))) == [1, 2] and tokens.encoder_of.cache_info().currsize == 1
    before = held_mb()
    assert list(attention_lm.lean(run)(iter([3]))) == [3] and tokens.encoder_of.cache_info().currsize == 0
    assert held_mb() < before + 20


def test_texts_cross_in_small_batches(spark, monkeypatch):
    """All stages that read texts or ids pass a bounded number of rows at once, and the session's limit holds afterwards."""
    before, seen, written = spark.conf.get(LIMIT), [], attention_lm.written
    assert int(before) > attention_lm.BATCH_ROWS
    monkeypatch.setattr(attention_lm, "written", lambda df: seen.append((set(df.columns), int(spark.conf.get(LIMIT)))) or written(df))
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more") for i in range(60)], "doc_id long, text string")
    assert attention_lm.score(docs, TOKENIZER, rounds=1, least_windows=1).count() == 60
    for column in ("ids", "rare"):
        assert [n for names, n in seen if column in names] == [attention_lm.BATCH_ROWS]
    assert spark.conf.get(LIMIT) == before
    with pytest.raises(KeyError), attention_lm.small_batches(spark, 100):
        sizes = spark.range(0, 1000, 1, 1).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
        assert max(r["n"] for r in sizes.collect()) <= 100
        raise KeyError
    assert spark.conf.get(LIMIT) == before


def test_gradients_of_large_exponents_are_those_of_small_ones():
    """A number added to all classes changes nothing, if exponents of it overflow or vanish too."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 40, 3000)
    by_id = np.bincount(ids, minlength=attention_lm.VOCABULARY).astype(float)
    class_of = np.arange(attention_lm.VOCABULARY) % 12
    w = ids[:2940].reshape(60, 49)
    net = attention_lm.begin(by_id, class_of, attention_lm.by_frequency(by_id), lambda row, r, c: attention_lm.follows(w, row, r, class_of, c), rows=64)
    x, y = w[:, :-1], class_of[w[:, 13:]]
    loss, want = net.gradients(x, y, np.ones(y.shape, np.float32), slice(12, None))
    for more in (300, -300):
        far = attention_lm.Net(net.p | {"bias": net.p["bias"] + np.float32(more)}, net.row_of, net.class_of, net.context)
        got_loss, got = far.gradients(x, y, np.ones(y.shape, np.float32), slice(12, None))
        assert np.isclose(got_loss, loss, rtol=1e-3)
        for k in ("out", "w1", "wq", "wk", "wv", "bias"):
            assert np.allclose(got[k], want[k], rtol=1e-2, atol=1e-4 * np.abs(want[k]).max() + 1e-6)
