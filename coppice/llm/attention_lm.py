"""Scoring texts with a causal self-attention model over subword ids.

The output layer is factored: attention gives the class of the next id, and the id
within its class follows counts over all training texts, given the id before it in the
word.  Frequent ids are classes of their own.  Probabilities of all ids sum to one at
every position.

All training texts are learnt from, whole and copies included: counts of words, ids and
pairs of ids cover them, and the attention layer has every id of them as a target, in
passes that every partition makes from the same weights and whose results are averaged.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import cut, fold, slices, text_col, written
from .embedding_dedup import spherical_kmeans

#: Id of the text boundary: begins every input, ends every text.
BOUNDARY = 49407
VOCABULARY = 49408
#: No id, among ids of 16 bits.
NONE = 65535
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Returns freed memory of this process to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Batches], Batches], encodes: bool = False) -> Callable[[Batches], Batches]:
    """``run`` in Python workers that Spark keeps for later tasks, waiting ones too: they hold nothing that is not in use.

    Tasks that don't encode drop the encoder that one before them has left.
    """

    def held(batches: Batches) -> Batches:
        if not encodes:
            T.encoder_of.cache_clear()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


#: Rows of an Arrow batch: without it a whole partition's texts cross at once, in buffers of the next power of two.
BATCH_ROWS = 2048


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Actions in here pass at most ``rows`` rows at once to Python; the session's own limit holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name, "10000"))
    spark.conf.set(name, str(rows if before <= 0 else min(rows, before)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


@dataclass
class Net:
    """One attention layer over ``context`` positions; ``row_of`` maps an id to its input row, ``class_of`` to its class."""

    p: dict[str, np.ndarray]
    row_of: np.ndarray
    class_of: np.ndarray
    context: int

    def forward(self, x: np.ndarray, keep: slice = slice(None), checked: bool = True):
        """Class log-probabilities, up to a number a position, after each position of ``x`` [batch, context] that ``keep`` selects.

        Unless ``checked``, exponents go without a look at their size: what comes of those too large is not finite.
        """
        p, d = self.p, self.p["wq"].shape[1]
        row = self.row_of[x]
        e = p["emb"].take(row, axis=0)
        e += p["pos"][: x.shape[1]]
        ek = e[:, keep]
        q, k, v = _times(ek, p["wq"] * np.float32(d**-0.5)), _times(e, p["wk"]), _times(e, p["wv"])
        s = q @ k.transpose(0, 2, 1)
        before = self.before[keep, : x.shape[1]]
        if checked and _large(s):
            s += np.where(before > 0, np.float32(0), np.float32(-1e9))
            s -= s.max(2, keepdims=True)
        a = np.exp(s, out=s)
        a *= before
        sums = _sums(a)[..., None]
        c = a @ v
        c /= sums
        z = _times(c, p["wo"])
        z += ek
        u = _tanh_of_half(_times(z, 2 * p["w1"]))
        top = np.empty((z.shape[0] * z.shape[1], d + 1), np.float32)  # the last column meets the bias
        np.add(z.reshape(-1, d), u.reshape(-1, u.shape[-1]) @ p["w2"], out=top[:, :d])
        top[:, d] = 1
        y = p["near"].take(row[:, keep], axis=0)
        y += (top @ np.concatenate([p["out"], p["bias"][None]])).reshape(y.shape)
        if checked and _large(y):
            y -= y.max(2, keepdims=True)
        return y, (row, e, q, k, v, a, sums, c, z, u, top)

    def log_class(self, x: np.ndarray, target: np.ndarray, keep: slice) -> np.ndarray:
        """Log-probability of each target class: ``forward`` in fewer passes over the large arrays.

        What depends on an input alone is looked up.  Exponents go without a subtracted maximum;
        where that overflows, the windows take ``forward``.
        """
        p, d, t = self.p, self.p["wq"].shape[1], x.shape[1]
        row = self.row_of[x]
        by_row, by_place = self.inputs
        h = by_row.take(row, axis=0)
        h += by_place[:t]
        hk = h[:, keep]
        with np.errstate(over="ignore", invalid="ignore"):
            a = hk[..., :d] @ h[..., d : 2 * d].transpose(0, 2, 1)
            np.exp(a, out=a)
            a *= self.before[keep, :t]
            c = a @ h[..., 2 * d : 3 * d + 1]  # the last column sums the weights
            z = c[..., :d] / c[..., d:]
            z += hk[..., 3 * d + 1 :]
            z = z.reshape(-1, d)
            u = _tanh_of_half(z @ (2 * p["w1"]))
            z += u @ p["w2"]
            y = z @ p["out"]
            y += self.direct.take(row[:, keep].reshape(-1), axis=0)
            own = y.take(np.arange(len(y)) * y.shape[1] + target.reshape(-1))
            out = own - np.log(np.exp(y, out=y) @ np.ones(y.shape[1], np.float32))
        out = out.reshape(target.shape)
        bad = np.flatnonzero(~np.isfinite(out).all(1))
        if len(bad):
            full, _ = self.forward(x[bad], keep)
            out[bad] = np.take_along_axis(full, target[bad][..., None], 2)[..., 0] - np.log(np.exp(full).sum(2))
        return out

    @cached_property
    def direct(self) -> np.ndarray:
        return self.p["near"] + self.p["bias"]

    @cached_property
    def before(self) -> np.ndarray:
        return np.tril(np.ones((self.context, self.context), np.float32))

    @cached_property
    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Query, key, value as it is added to the input, a one, and the input itself, by row and by place."""
        p = self.p
        scale = np.float32(p["wq"].shape[1] ** -0.5)
        parts = lambda e, one: np.concatenate([e @ p["wq"] * scale, e @ p["wk"], e @ p["wv"] @ p["wo"], np.full((len(e), 1), one, np.float32), e], 1)
        return parts(p["emb"], 1), parts(p["pos"], 0)

    def gradients(self, x: np.ndarray, target: np.ndarray, mask: np.ndarray, keep: slice = slice(None)):
        """(loss a token, gradients) of the masked positions among those that ``keep`` selects; target and mask are of these.

        Of ``emb`` and ``near`` the gradients are (rows, values): all other rows have none.
        """
        p, d = self.p, self.p["wq"].shape[1]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            y, (row, e, q, k, v, a, weights, c, z, u, top) = self.forward(x, keep, checked=False)
            np.exp(y, out=y)
            sums = _sums(y)
        if not all(t.min() > 1e-20 and t.max() < 1e30 for t in (sums, weights)):  # nor if one is no number
            y, (row, e, q, k, v, a, weights, c, z, u, top) = self.forward(x, keep)
            np.exp(y, out=y)
            sums = _sums(y)
        n = max(1, mask.sum())
        flat = lambda m: m.reshape(-1, m.shape[-1])
        own = np.arange(sums.size), target.reshape(-1)
        loss = float(-(np.log(np.maximum(flat(y)[own] / sums.reshape(-1), 1e-30)) * mask.reshape(-1)).sum() / n)
        weight = (mask / n).astype(np.float32)
        y *= (weight / sums)[..., None]
        dy = flat(y)
        dy[own] -= weight.reshape(-1)
        both = top.T @ dy
        g = {"bias": both[d], "out": both[:d], "near": _scatter(row[:, keep], dy)}
        dtop = dy @ p["out"].T
        g["w2"] = flat(u).T @ dtop
        du = dtop @ p["w2"].T
        u *= u
        np.subtract(1, u, out=u)
        du *= flat(u)
        g["w1"] = flat(z).T @ du
        dz = dtop
        dz += du @ p["w1"].T
        g["wo"] = flat(c).T @ dz
        dc = (dz @ p["wo"].T).reshape(c.shape)
        dc /= weights  # a is up to these sums
        da = dc @ v.transpose(0, 2, 1)
        dv = flat(a.transpose(0, 2, 1) @ dc)
        c *= dc
        da -= _sums(c)[..., None]  # the sum of da * a, as c is a @ v
        da *= a
        dq, dk = flat(da @ k), flat(da.transpose(0, 2, 1) @ q)
        dq *= np.float32(d**-0.5)
        g["wq"], g["wk"], g["wv"] = flat(e[:, keep]).T @ dq, flat(e).T @ dk, flat(e).T @ dv
        de = (dk @ p["wk"].T + dv @ p["wv"].T).reshape(e.shape)
        de[:, keep] += (dz + dq @ p["wq"].T).reshape(c.shape)
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][: x.shape[1]] = de.sum(0)
        g["emb"] = _scatter(row, de)
        return loss, g


def _times(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x @ m as one product, whatever axes come before the last."""
    return (x.reshape(-1, x.shape[-1]) @ m).reshape(*x.shape[:-1], m.shape[1])


def _tanh_of_half(x: np.ndarray) -> np.ndarray:
    """tanh(x / 2), in the place of ``x``."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def _large(x: np.ndarray) -> bool:
    """Whether exponents of ``x`` can overflow, or all of a sum vanish."""
    return bool(x.size) and not (x.max() < 60 and x.min() > -60)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis."""
    return x @ np.ones(x.shape[-1], x.dtype)


def _scatter(row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in ``row``, sums of the rows of x by them)."""
    r, f = row.ravel().astype(np.uint16), x.reshape(-1, x.shape[-1])  # short integers sort by digits
    order = np.argsort(r, kind="stable")
    r, f = r[order], f.take(order, axis=0)
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    if f.shape[1] <= 32:
        return r[at].astype(np.int64), np.add.reduceat(f, at, axis=0)
    n, out, k = np.diff(np.append(at, len(r))), f.take(at, axis=0), 1
    more = np.flatnonzero(n > 1)
    while len(more) > 24:  # the k-th of each row that has one
        out[more] += f.take(at[more] + k, axis=0)
        k += 1
        more = more[n[more] > k]
    for i in more.tolist():
        rest = f[at[i] + k : at[i] + n[i]]
        out[i] += np.ones(len(rest), f.dtype) @ rest
    return r[at].astype(np.int64), out


def by_frequency(by_id: np.ndarray) -> np.ndarray:
    """The ids that occur, the most frequent first behind BOUNDARY."""
    ids = np.argsort(-by_id, kind="stable")
    ids = ids[by_id[ids] > 0]
    return np.concatenate([[BOUNDARY], ids[ids != BOUNDARY]])


#: So many ids a group, the most frequent, make its centroids; all others are assigned.
PER_GROUP = 64


def classes_of(by_id: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray], singles: int, groups: int, seed: int = 0, assign=None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, ids by frequency): frequent ids alone, the others grouped by the ids beside them.

    ``near`` are arrays of ids, places (2 * SIDES of them) and counts.  With ``assign``, from centroids to
    (ids, their groups), they are only of the ids that make centroids.
    """
    ids = by_frequency(by_id)
    class_of = np.full(VOCABULARY, min(singles, len(ids)), np.int64)  # ids that training lacks share the first group
    class_of[ids[:singles]] = np.arange(min(singles, len(ids)))
    rest = ids[singles:]
    if len(rest):
        make = rest if assign is None else rest[: PER_GROUP * groups]
        place = np.full(VOCABULARY, -1)
        place[make] = np.arange(len(make))
        who, side, n = near
        ok = place[who] >= 0
        x = np.full((len(make), 2 * SIDES), 1e-9, np.float32)
        x[place[who[ok]], side[ok]] = np.sqrt(n[ok])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = spherical_kmeans(x[: PER_GROUP * groups], min(groups, len(rest)), 10, seed)
        class_of[make] = singles + (x @ c.T).argmax(1)
        if assign is not None and len(make) < len(rest):
            class_of[rest[len(make) :]] = singles + c.sum(1).argmax()  # those that nothing stands beside
            who, group = assign(c)
            ok = (by_id[who] > 0) & (class_of[who] >= singles) & (place[who] < 0)
            class_of[who[ok]] = singles + group[ok]
    return class_of, ids


#: Neighbours that are told apart when ids are grouped: the most frequent ids, and all others as one.
SIDES = 128


def sides_of(by_id: np.ndarray) -> np.ndarray:
    """The place of each id as a neighbour."""
    side = np.full(VOCABULARY, SIDES - 1)
    top = np.argsort(-by_id, kind="stable")[: SIDES - 1]
    side[top] = np.arange(len(top))
    return side


def neighbours(w: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id * 2 * SIDES + place, count): the ids before and behind each id in the rows of ``w``; -1 is no id."""
    x, y = w[:, :-1], w[:, 1:]
    ok = (x >= 0) & (y >= 0)
    a, b = x[ok].astype(np.int64), y[ok].astype(np.int64)
    return np.unique(np.concatenate([b * 2 * SIDES + side[a], a * 2 * SIDES + SIDES + side[b]]), return_counts=True)


def begin(by_id: np.ndarray, class_of: np.ndarray, ids: np.ndarray, follow, context: int = 48, width: int = 24, rows: int = 2048, seed: int = 0) -> Net:
    """A model before training: class bigrams ``follow(row_of, n_rows, n_class)`` make the direct input-to-class weights."""
    rng = np.random.default_rng(seed)
    n_class = int(class_of.max()) + 1
    row_of = (rows + class_of).astype(np.int64)
    row_of[ids[:rows]] = np.arange(min(rows, len(ids)))
    pairs = follow(row_of, rows + n_class, n_class)
    uni = pairs.sum(0) + 0.5
    uni = uni / uni.sum()
    near = np.log((pairs + 8 * uni) / (pairs.sum(1, keepdims=True) + 8)) - np.log(uni)
    init = lambda *s: (rng.standard_normal(s) * s[0] ** -0.5).astype(np.float32)
    p = {"emb": init(rows + n_class, width), "pos": init(context, width) * 0.1, "wq": init(width, width), "wk": init(width, width), "wv": init(width, width), "wo": init(width, width) * 0.1, "w1": init(width, 2 * width), "w2": init(2 * width, width) * 0.1, "out": init(width, n_class) * 0.1, "bias": np.log(uni).astype(np.float32), "near": near.astype(np.float32)}
    p["emb"] *= np.float32((rows + n_class) ** 0.5 * 0.3)
    return Net(p, row_of, class_of, context)


def follows(w: np.ndarray, row_of: np.ndarray, n_rows: int, class_of: np.ndarray, n_class: int) -> np.ndarray:
    """[rows, classes] how often a class follows a row in the rows of ``w``; -1 is no id."""
    x, y = w[:, :-1], w[:, 1:]
    ok = (x >= 0) & (y >= 0)
    return np.bincount(row_of[x[ok]] * n_class + class_of[y[ok]], minlength=n_rows * n_class).reshape(n_rows, n_class).astype(float)


def passes(net: Net, w: np.ndarray, first: np.ndarray, n_passes: int = 1, batch: int = 48, rate: float = 8e-3, last_rate: float = 8e-4, seed: int = 0) -> Net:
    """A model trained further with Adam on windows ``w`` [windows, context + 1], padded with -1 or NONE, in shuffled batches.

    Positions count that have a quarter of a context before them, or the text's begin (``first``): batches
    hold windows of one kind, so that the others' first positions are inputs alone.  Rows of ``emb`` and
    ``near`` move with the batches that hold them.
    """
    rng = np.random.default_rng(seed)
    by_rows, dense = ("emb", "near"), [k for k in net.p if k not in ("emb", "near")]
    flat = np.concatenate([net.p[k].ravel() for k in dense])  # all that moves with every batch is one array
    edge = np.cumsum([0, *(net.p[k].size for k in dense)])
    p = {k: net.p[k].copy() for k in by_rows} | {k: flat[a:b].reshape(net.p[k].shape) for k, a, b in zip(dense, edge, edge[1:])}
    out = Net({k: p[k] for k in net.p}, net.row_of, net.class_of, net.context)
    state = {k: (x, np.zeros_like(x), np.zeros_like(x)) for k, x in (("", flat), *((k, p[k]) for k in by_rows))}
    quarter, kinds = net.context // 4, (np.flatnonzero(first), np.flatnonzero(~first))
    total, step = n_passes * sum(-(-len(at) // batch) for at in kinds), 0
    for _ in range(n_passes):
        drawn = [(x[i : i + batch], keep) for at, keep in zip(kinds, (slice(0, None), slice(quarter, None))) for x in [rng.permutation(at)] for i in range(0, len(x), batch)]
        for k in rng.permutation(len(drawn)).tolist():
            at, keep = drawn[k]
            step += 1
            own = w[at].astype(np.int64)
            own[own == NONE] = -1
            x, y = own[:, :-1], own[:, 1 + keep.start :]
            _, g = out.gradients(np.maximum(x, 0), net.class_of[np.maximum(y, 0)], (y >= 0).astype(np.float32), keep)
            lr = min(1, step / 20) * (rate + (last_rate - rate) * step / total)
            moves = [(k, *g[k]) for k in by_rows] + [("", slice(None), np.concatenate([g[k].ravel() for k in dense]))]
            for name, rows, grad in moves:
                x, m, v = state[name]
                m1, v1 = m[rows], v[rows]
                m1 *= np.float32(0.9)
                m1 += np.float32(0.1) * grad
                v1 *= np.float32(0.99)
                grad *= grad
                grad *= np.float32(0.01)
                v1 += grad
                if name:
                    m[rows], v[rows] = m1, v1
                else:
                    m1, v1 = m1.copy(), v1.copy()
                m1 *= np.float32(lr * (0.1 if name == "near" else 1) / (1 - 0.9**step))
                v1 *= np.float32(1 / (1 - 0.99**step))
                np.sqrt(v1, out=v1)
                v1 += np.float32(1e-8)
                m1 /= v1
                x[rows] -= m1
    return out


def due_windows(text: Column, rate: float) -> Column:
    """How many windows to draw of a text: ``rate`` of its bytes on average, by a hash of the text alone."""
    chance = F.pmod(F.xxhash64(text), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.octet_length(text) * F.lit(rate) + chance).cast("long")


#: Characters that a window is cut from, for each of its places: more than an id of a word has.
CHARS = 16


def pieces(texts: list[str], due: np.ndarray, keys: np.ndarray, context: int) -> list[tuple[str, bool, bool]]:
    """(characters, whether the text begins, whether it ends there) of ``due`` places of each text.

    A piece begins with a word: the one after a place that the text's key alone draws, so copies draw the same.
    """
    out, most = [], CHARS * (context + 1)
    for k in np.flatnonzero(due).tolist():
        text = texts[k]
        for at in np.random.default_rng(int(keys[k]) % (1 << 63)).integers(0, max(1, len(text)), int(due[k])).tolist():
            space = _SPACE.search(text, at) if at else None
            start = space.end() if space and space.end() < len(text) else 0
            out.append((text[start : start + most], start == 0, start + most >= len(text)))
    return out


def windows(found: list[tuple[str, bool, bool]], encoder: T.Encoder, context: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows [n, context + 1] padded with -1, whether each begins its text) of ``pieces``: BOUNDARY is before a text and behind it."""
    coded = T.encode(pa.array([x for x, *_ in found], pa.string()), encoder, BOUNDARY)
    out = np.full((len(found), context + 1), -1, np.int32)
    for i, (_, first, last) in enumerate(found):
        ids = coded.ids[coded.edge[i] : coded.edge[i + 1] - (not last)].astype(np.int32)
        ids = np.concatenate([[BOUNDARY], ids]) if first else ids
        out[i, : len(ids)] = ids[: context + 1]
    return out, np.array([first for _, first, _ in found], bool)


@dataclass
class Within:
    """log p(id | class, id before it in the word), backing off to the class's own counts; BOUNDARY stands before a word.

    ``alone`` is p(id | class).  Of a pair (before, id) seen n times, and ``total`` times with any id of
    that class, the probability is (n + back * alone) / (total + back).
    """

    alone: np.ndarray
    class_of: np.ndarray
    single: np.ndarray
    back: float = 20.0

    @classmethod
    def of(cls, by_id: np.ndarray, class_of: np.ndarray) -> Within:
        mass = by_id + 0.1
        alone = (mass / np.bincount(class_of, weights=mass)[class_of]).astype(np.float64)
        return cls(alone, class_of, np.bincount(class_of)[class_of] == 1)

    def log(self, ids: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(self.single[ids], 0.0, np.log((n + self.back * self.alone[ids]) / (total + self.back)))

    @property
    def end(self) -> float:
        """Of a text's end, which no id of a word stands before."""
        return float(self.log(np.array([BOUNDARY]), np.zeros(1), np.zeros(1))[0])


@dataclass
class Pairs:
    """Counts of pairs before * VOCABULARY + id, sorted, and of before * VOCABULARY + class."""

    keys: np.ndarray
    counts: np.ndarray
    by_class: np.ndarray
    class_counts: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, class_of: np.ndarray) -> Pairs:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        by_class, at = np.unique(_with_class(keys, class_of), return_inverse=True)
        return cls(keys, counts, by_class, np.bincount(at, weights=counts, minlength=len(by_class)))

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(want))
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at], 0.0)

    def look(self, want: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(times seen, times seen with an id of the class) of each pair."""
        return self._get(self.keys, self.counts, want), self._get(self.by_class, self.class_counts, _with_class(want, class_of))


def _with_class(pairs: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    return pairs // VOCABULARY * VOCABULARY + class_of[pairs % VOCABULARY]


def word_pairs(own: T.Ids) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of all words one after another, the word of each)."""
    ids = own.ids.astype(np.int64)
    before = np.concatenate([[BOUNDARY], ids[:-1]])[: len(ids)]
    heads = own.edge[:-1]
    before[heads[heads < own.edge[1:]]] = BOUNDARY
    return before * VOCABULARY + ids, np.repeat(np.arange(len(heads)), own.counts)


def class_scores(net: Net, ids: np.ndarray, edge: np.ndarray, stride: int, batch: int = 32) -> np.ndarray:
    """Log-probability of the classes of each text's ids, its end last, by windows.

    Windows of ``context`` inputs overlap by context - stride; each scores the
    positions that none before it has, so every id is scored once, after at least
    context - stride ids where there are as many.
    """
    t = net.context
    n, base = np.diff(edge), edge
    y = ids.astype(np.int64)
    x = np.concatenate([[BOUNDARY], y[:-1]])[: len(y)]
    x[base[:-1]] = BOUNDARY
    target = net.class_of[y]
    cls = np.zeros(len(y), np.float32)
    steps = np.arange(t)

    def run(starts: np.ndarray, ends: np.ndarray, keep: slice):
        for i in range(0, len(starts), batch):
            at = starts[i : i + batch, None] + steps
            ok = at < ends[i : i + batch, None]
            at = np.where(ok, at, starts[i : i + batch, None])
            got = net.log_class(x[at], target[at[:, keep]], keep)
            cls[at[:, keep][ok[:, keep]]] = got[ok[:, keep]]

    run(base[:-1], base[1:], slice(0, t))
    more = np.maximum(0, -(-(n - t) // stride))
    doc = np.repeat(np.arange(len(n)), more)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(more) - more, more) + 1
    run(base[doc] + k * stride, base[doc + 1], slice(t - stride, t))
    return np.bincount(np.repeat(np.arange(len(n)), n), weights=cls, minlength=len(n))


def word_counts(src: DataFrame) -> DataFrame:
    """(word, c) over the words of all texts, lower-cased A-Z: c counts those in rows that are not held out.

    A partition sums its words before they are shuffled: ``text`` and ``held_out`` are read by Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, size=4 << 20):
            c = T.chunked(T.strings(b.column("text")))
            if not len(c.distinct):
                continue
            train = np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False), np.diff(c.first))
            n = np.bincount(c.index, weights=train, minlength=len(c.distinct)).astype(np.int64)
            held.append(pa.table({"word": pc.ascii_lower(c.distinct), "c": n}))
            size += held[-1].num_rows
            if size > 1 << 20:
                held = [_summed(held)]
                size = 0
                if held[0].num_rows > 1 << 19:
                    yield from held.pop().to_batches()
        if held:
            yield from _summed(held).to_batches()

    return src.select("text", "held_out").mapInArrow(lean(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])


def pair_counts(counts: DataFrame, tokenizer: str) -> DataFrame:
    """(pair, n): how often each id follows another in a word, in texts with these word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = T.encoder_of(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 1 << 17):
                s = b.slice(i, 1 << 17)
                pairs, word = word_pairs(encoder.encode(T.strings(s.column(0))))
                pair, at = np.unique(pairs, return_inverse=True)
                n = np.bincount(at, weights=s.column(1).to_numpy()[word], minlength=len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    return counts.where("c > 0").mapInArrow(lean(run, True), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, pairs: DataFrame, within: Within, tokenizer: str, most_pairs: int = 2_000_000) -> DataFrame:
    """(word, c, w) of all words: w is the log-probability of its ids within their classes.

    Up to ``most_pairs`` distinct pairs (a checked size) are broadcast; more are joined.
    """
    spark = counts.sparkSession
    if pairs.limit(most_pairs + 1).count() <= most_pairs:
        known = pairs.toPandas()
        shared = spark.sparkContext.broadcast((within, Pairs.of(known["pair"].to_numpy(np.int64), known["n"].to_numpy(), within.class_of)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, (w, p) = T.encoder_of(tokenizer), shared.value
            for b in batches:
                for i in range(0, b.num_rows, 1 << 17):
                    s = b.slice(i, 1 << 17)
                    keys, word = word_pairs(encoder.encode(T.strings(s.column("word"))))
                    got = np.bincount(word, weights=w.log(keys % VOCABULARY, *p.look(keys, w.class_of)), minlength=s.num_rows)
                    yield pa.RecordBatch.from_arrays([s.column("word"), s.column("c"), pa.array(got)], ["word", "c", "w"])

        return counts.select("word", "c").mapInArrow(lean(run, True), "word string, c long, w double")
    shared = spark.sparkContext.broadcast(within)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, w = T.encoder_of(tokenizer), shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1 << 17):
                s = b.slice(i, 1 << 17)
                keys, word = word_pairs(encoder.encode(T.strings(s.column("word"))))
                at = pa.array(word)
                yield pa.RecordBatch.from_arrays([s.column("word").take(at), pa.array(keys), pa.array(_with_class(keys, w.class_of))], ["word", "pair", "of"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            n, total = (np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("n", "total"))
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(w.log(b.column("pair").to_numpy() % VOCABULARY, n, total))], ["word", "w"])

    class_of = F.broadcast(spark.createDataFrame(list(enumerate(within.class_of.tolist())), "id long, class long"))  # a row for each id
    coded = pairs.withColumn("id", F.col("pair") % VOCABULARY).join(class_of, "id")
    totals = coded.groupBy((F.expr(f"pair div {VOCABULARY}") * VOCABULARY + F.col("class")).alias("of")).agg(F.sum("n").alias("total"))
    spread = counts.select("word").mapInArrow(lean(expand, True), "word string, pair long, of long")
    found = spread.join(pairs, "pair", "left").join(totals, "of", "left").select("word", "pair", "n", "total")
    sums = found.mapInArrow(finish, "word string, w double").groupBy("word").agg(F.sum("w").alias("w"))
    return counts.join(sums, "word", "left").select("word", "c", F.coalesce("w", F.lit(0.0)).alias("w"))


def whole(coded: T.Coded) -> pa.BinaryArray:
    """The ids of each text as little-endian unsigned 16-bit numbers, BOUNDARY before and behind: ``coded`` ends texts with it."""
    n = len(coded.edge) - 1
    ids = np.insert(coded.ids.astype("<u2"), coded.edge[:-1], BOUNDARY)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * (coded.edge + np.arange(n + 1))).astype(np.int32)), pa.py_buffer(ids)])


def _held(blob: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, edges) of a column that ``whole`` made."""
    edge = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64) // 2
    return np.frombuffer(blob.buffers()[2], "<u2")[edge[0] : edge[-1]], edge - edge[0]


def coded_texts(src: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``src`` with ids (``whole``) and key, a hash of the text, in a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = T.encoder_of(tokenizer)
        for b in slices(batches, size=4 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], whole(T.encode(b.column("text"), encoder, BOUNDARY)), b.columns[-1]], [*b.schema.names[:-1], "ids", "key"])

    keyed = src.withColumn("key", F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in src.schema)
    return written(keyed.mapInArrow(lean(run, True), f"{kinds}, ids binary, key long"))


def streams(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[np.ndarray]:
    """The ids of texts in one row, a -1 between texts, from batches of ``size`` bytes."""
    for b in slices(batches, "ids", 1 << 14, size):
        ids, edge = _held(b.column("ids"))
        yield np.insert(ids.astype(np.int64), edge[1:-1], -1)[None]


def cover(ids: np.ndarray, edge: np.ndarray, key: np.ndarray, context: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(windows [n, context + 1], whether each begins its text) of whole texts: windows as ``class_scores`` has them.

    Each id after a text's BOUNDARY is once a target of ``passes``: of the text's first window, or of a later
    one behind its first quarter.  Places behind a text's end
    are NONE.  Of ``parts`` a window is in the one that its number and its text's ``key`` give.
    """
    stride = context - context // 4
    n = np.diff(edge) - 1
    count = 1 + np.maximum(0, -(-(n - context) // stride))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    own = np.flatnonzero((key[doc] + k) % parts == part)
    doc, k = doc[own], k[own]
    at = (edge[doc] + k * stride)[:, None] + np.arange(context + 1)
    out = ids.take(np.minimum(at, max(0, len(ids) - 1)))
    out[at >= edge[doc + 1][:, None]] = NONE
    return out, k == 0


def _averaged(rows: DataFrame, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray] | None:
    """The mean of (part, weight, p) rows by weight; groups of partitions are summed before the driver sees 32 rows, a few at a time."""

    def total(table: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(p, np.float64) for p in table["p"].to_pylist())
        return pa.table({"weight": pa.array([float(pc.sum(table["weight"]).as_py())]), "p": pa.array([x.tobytes()], pa.binary())})

    weight, flat, out, at = 0.0, 0.0, {}, 0
    for r in rows.groupBy((F.col("part") % 32).alias("g")).applyInArrow(total, "weight double, p binary").toLocalIterator():
        weight += r["weight"]
        flat = flat + np.frombuffer(r["p"], np.float64)
    if not weight:
        return None
    flat = flat / weight
    for k, shape in shapes.items():
        n = int(np.prod(shape))
        out[k], at = flat[at : at + n].reshape(shape).astype(np.float32), at + n
    return out


def fit(train: DataFrame, tokenizer: str, by_id: np.ndarray, context: int = 48, width: int = 24, singles: int = 64, groups: int = 48, rows: int = 2048, least_windows: int = 16_000, rounds: int = 4, seed: int = 0) -> Net:
    """The attention model of ``train`` (text, or what ``coded_texts`` made of it), whose ids occur ``by_id`` times.

    Classes, class bigrams and the layer learn from every text.  In each of
    ``rounds`` every partition trains the model on its own windows, and the models are averaged by their
    windows: no window reaches the driver, and a partition holds 16-bit ids of those of a round.  The rounds
    deal all windows out among them, so that each id is a target once, if each round has ``least_windows``
    then; with fewer windows a round takes a larger part, up to all, and repeats those until it has had so many.
    """
    spark = train.sparkSession

    coded = (train if "ids" in train.columns else coded_texts(train, tokenizer)).select("ids", "key")
    side = sides_of(by_id)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in streams(batches):
            cells, n = neighbours(w, side)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n)], ["cell", "n"])

    near = cut(coded.select("ids").mapInArrow(lean(beside), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))  # at most 2 * SIDES rows an id
    of = F.expr(f"cell div {2 * SIDES}").cast("int").alias("id")
    make = spark.createDataFrame([(int(i),) for i in by_frequency(by_id)[singles : singles + PER_GROUP * groups]], "id int")
    known = near.select(of, "cell", "n").join(F.broadcast(make), "id").select("cell", "n").toArrow()
    cell = known["cell"].to_numpy().astype(np.int64)

    def assign(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells, n = b.column("cells"), np.sqrt(b.column("ns").flatten().to_numpy().astype(np.float32))
                who = np.repeat(np.arange(b.num_rows), pc.list_value_length(cells).to_numpy())
                x = np.zeros((b.num_rows, 2 * SIDES), np.float32)
                x[who, cells.flatten().to_numpy() % (2 * SIDES)] = n
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array((x @ c.T).argmax(1).astype(np.int32))], ["id", "group"])

        lists = near.groupBy(of).agg(F.collect_list(F.struct("cell", "n")).alias("l")).select("id", F.col("l.cell").alias("cells"), F.col("l.n").alias("ns"))
        got = lists.mapInArrow(lean(run), "id int, group int").toArrow()  # a row for each id
        return got["id"].to_numpy(), got["group"].to_numpy()

    class_of, ids = classes_of(by_id, (cell // (2 * SIDES), cell % (2 * SIDES), known["n"].to_numpy().astype(float)), singles, groups, seed, assign)
    del known, cell

    def follow(row_of: np.ndarray, n_rows: int, n_class: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_rows, n_class))
            for w in streams(batches):
                total += follows(w, row_of, n_rows, class_of, n_class)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

        got = coded.select("ids").mapInArrow(lean(run), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most n_rows * n_class rows
        out = np.zeros(n_rows * n_class)
        out[got["cell"].to_numpy()] = got["n"].to_numpy()
        return out.reshape(n_rows, n_class)

    net = begin(by_id, class_of, ids, follow, context, width, rows, seed)
    n_windows = max(1.0, by_id.sum() / (context - context // 4))
    parts = int(min(rounds, max(1, n_windows // least_windows)))
    again = max(1, round(least_windows / n_windows))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(net)
        high, low = (8e-3 * (1 - 0.9 * x / rounds) for x in (r, r + 1))

        def run(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared, high: float = high, low: float = low) -> Iterator[pa.RecordBatch]:
            found = [cover(*_held(b.column("ids")), b.column("key").to_numpy(), context, r % parts, parts) for b in slices(batches, "ids", 1 << 14, 1 << 22)]
            if sum(len(first) for _, first in found):
                w, first = (np.concatenate(x) for x in zip(*found))
                got = passes(shared.value, w, first, again, 48, high, low, seed + r)
                p = np.concatenate([x.ravel().astype(np.float64) for x in got.p.values()]) * len(w)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(len(w))]), pa.array([p.tobytes()], pa.binary())], ["part", "weight", "p"])

        p = _averaged(coded.mapInArrow(lean(run), "part int, weight double, p binary"), {k: x.shape for k, x in net.p.items()})
        if p is None:
            break
        net = Net(p, net.row_of, net.class_of, context)
    return net


def score(docs: DataFrame, tokenizer: str, folds: int = 7, held: int = 2, often: float = 1e-6, most_pairs: int = 2_000_000, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Counts of words, ids and pairs cover all rows outside the held-out fold; ``fit`` tells what the
    attention layer learns from.  Words that make up ``often`` of the training tokens (so at
    most 1 / ``often`` words) are broadcast; all rarer words are looked up by a join, where none
    is a hot key.  Null and empty texts are an end alone.  Without training rows every class is as likely.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), text_col(text).alias("text"), (fold(id_col, folds) == held).alias("held_out"))
    n_texts = src.where(~F.col("held_out")).count()
    with small_batches(spark):
        counts = written(word_counts(src))
    sums = counts.agg(F.count_if(F.col("c") > 0).alias("v"), F.sum("c").alias("n")).first()
    n, v = (sums["n"] or 0) + n_texts, sums["v"] + (n_texts > 0)
    over = n + v + 1
    hot_at = max(2, often * n)
    pairs = cut(pair_counts(counts, tokenizer))
    ids = pairs.groupBy((F.col("pair") % VOCABULARY).alias("id")).agg(F.sum("n").alias("n")).toPandas()
    by_id = np.zeros(VOCABULARY)
    by_id[ids["id"].to_numpy(np.int64)] = ids["n"].to_numpy()
    by_id[BOUNDARY] += n_texts
    with small_batches(spark):
        coded = coded_texts(src, tokenizer)
        net = fit(coded.where(~F.col("held_out")), tokenizer, by_id, **how)
    within = Within.of(by_id, net.class_of)
    lex = written(lexicon(counts, pairs, within, tokenizer, most_pairs))
    often_used = lex.where(F.col("c") >= hot_at).toPandas()
    hot = {w: i for i, w in enumerate(often_used["word"])}
    table = np.append(np.log10((often_used["c"].to_numpy(float) + 1) / over), 0.0), np.append(often_used["w"].to_numpy(float), 0.0)  # the last for words that aren't here
    shared = spark.sparkContext.broadcast((net, within.end, hot, table))
    end = (n_texts + 1) / over
    stride = net.context * 3 // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, within_end, hot, (base_of, within_of) = shared.value
        part, row = TaskContext.get().partitionId(), 0
        for b in slices(batches, size=2 << 20):
            ids, edge = _held(b.column("ids"))
            c, n_rows = T.chunked(T.strings(b.column("text"))), b.num_rows
            low = pc.ascii_lower(c.distinct)
            at = np.fromiter(map(hot.get, low.to_pylist(), repeat(-1)), np.int64, len(low))
            known = at >= 0
            doc = np.repeat(np.arange(n_rows), np.diff(c.first))
            per = lambda x: np.bincount(doc, weights=x, minlength=n_rows)  # noqa: E731, B023
            scores = class_scores(net, np.delete(ids, edge[:-1]), edge - np.arange(n_rows + 1), stride) + per(within_of[at][c.index]) + within_end
            n_tokens = np.diff(c.first) + 1
            rare = ~known[c.index]
            # A row's rare words once each, with how often they occur.
            which, k = np.unique(doc[rare] * np.int64(len(known)) + c.index[rare], return_counts=True)
            edge = np.searchsorted(which // max(1, len(known)), np.arange(n_rows + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([low.take(pa.array(which % max(1, len(known)))), pa.array(k)], ["word", "k"])
            keys = (part << 40) + row + np.arange(n_rows)
            row += n_rows
            arrays = [pa.array(keys), b.column("doc_id"), b.column("held_out"), pa.array(n_tokens), pa.array(n_tokens - 1 - np.bincount(doc[rare], minlength=n_rows) + (n_texts > 0)), pa.array(per(base_of[at][c.index]) + log10(end)), pa.array(scores / log(10)), pa.ListArray.from_arrays(pa.array(edge), items)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    kind = src.schema["doc_id"].dataType.simpleString()
    with small_batches(spark):
        part = written(coded.drop("key").mapInArrow(lean(run), f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,k:long>>"))
    rare = part.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.k")
    cold = lex.where(F.col("c") < hot_at).select("word", F.when(F.col("c") > 0, 1).otherwise(0).alias("seen"), F.log10((F.col("c") + 1) / F.lit(float(over))).alias("b"), "w")
    found = rare.join(cold, "word").groupBy("key").agg(F.sum(F.col("k") * F.col("seen")).alias("more_known"), F.sum(F.col("k") * F.col("b")).alias("more_base"), F.sum(F.col("k") * F.col("w")).alias("more_within"))
    out = part.drop("rare").join(found, "key", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base")).alias("base_score"), (F.col("score") + more("more_within") / F.lit(log(10))).alias("score"),
    )
