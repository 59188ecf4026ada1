"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every window (a sequence of ``window`` tokens) gives each live queue a quantum in
proportion to its target share.  A queue's quanta are rounded on the cumulative
share, so what one window owes a queue is carried into the next: after w windows a
queue has had floor or ceil of its exact due, and every window is full.  When a
queue runs dry, the others share its part from the next window on.  As the schedule
is a function of the position within a queue, each task places its own documents
once the number of tokens ahead of its partition is known; no window is ever
filled by one task alone and no token ids are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import tokens as T
from .common import cut, slices, written


def tokenize(docs: DataFrame, tokenizer: str, own: list[str], end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source") -> DataFrame:
    """(doc_id, queue, no, chunk, start, doc_tokens, ids) of every row, in a table in the shared folder.

    no is the queue's place in ``own``, len(own) if it isn't there; chunk is the
    partition that the row is in, start the number of tokens of the same no before
    it there, ids the token ids and ``end_id`` as little-endian unsigned 32-bit
    numbers.  Null texts are empty; a null queue is ''.
    """
    names = pa.array(own, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, encoder = TaskContext.get().partitionId(), T.encoder_of(tokenizer)
        ahead = np.zeros(len(own) + 1, np.int64)
        for b in slices(batches, size=4 << 20):
            coded = T.encode(b.column("text"), encoder, end_id)
            n = np.diff(coded.edge)
            nos = pc.fill_null(pc.index_in(b.column("queue"), names), len(own)).to_numpy()
            starts = np.empty(len(n), np.int64)
            for q in np.unique(nos):
                at = np.flatnonzero(nos == q)
                ends = ahead[q] + np.cumsum(n[at])
                starts[at] = ends - n[at]
                ahead[q] = ends[-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), pa.array(nos, pa.int32()), pa.array(np.full(len(n), chunk, np.int32)), pa.array(starts), pa.array(n), T.lists(coded)], ["doc_id", "queue", "no", "chunk", "start", "doc_tokens", "ids"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return written(src.mapInArrow(run, f"doc_id {kind}, queue string, no int, chunk int, start long, doc_tokens long, ids binary"))


@dataclass(frozen=True)
class Schedule:
    """Phases of the round-robin: in phase p, windows [first[p], first[p+1]) serve the queues with lo[p, q] < hi[p, q],
    the cumulative shares as integers over ``unit[p]``; given[p, q] tokens of a queue went out before."""

    window: int
    first: tuple[int, ...]
    lo: np.ndarray
    hi: np.ndarray
    unit: tuple[int, ...]
    given: np.ndarray
    total: int

    def bounds(self, p: int, q: int, w: np.ndarray) -> np.ndarray:
        """Tokens of queue q given out in phase p before its w-th window."""
        a, b, u = int(self.lo[p, q]), int(self.hi[p, q]), self.unit[p]
        f = lambda x: self.window * (w // u) * x + self.window * (w % u) * x // u  # noqa: E731  without overflow
        return f(b) - f(a)

    def offset(self, p: int, q: int, w: np.ndarray) -> np.ndarray:
        """Where queue q's quantum begins in the phase's w-th window."""
        a, u = int(self.lo[p, q]), self.unit[p]
        f = lambda v: self.window * (v // u) * a + self.window * (v % u) * a // u
        return f(w + 1) - f(w)


#: Shares are whole numbers over at most this, so that products stay below 2**63.
UNIT = 1 << 24


def _cumulative(shares: list[float]) -> list[int]:
    total, run, out = sum(map(Fraction, shares)), Fraction(0), [0]
    for s in shares:
        run += Fraction(s)
        out.append(int(run * UNIT / total + Fraction(1, 2)))
    return out


def schedule(tokens: list[int], shares: list[float], window: int) -> Schedule:
    """Phases until all queues are dry.  A phase ends with the last window that all of its queues can fill;
    the window in which one runs dry takes what it has left and fills up from the fullest of the others."""
    left, given, w = list(tokens), [0] * len(tokens), 0
    first, los, his, gives = [], [], [], []
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        least = sum(shares[i] for i in live) * 1.1 / window or 1.0  # a queue gets a token a window at least, else quanta could turn negative
        serve = set(live)
        cum = _cumulative([max(shares[i], least) if i in serve else 0 for i in range(len(left))])
        got = lambda i, n: window * n * cum[i + 1] // UNIT - window * n * cum[i] // UNIT
        lo, hi = 0, min((left[i] * UNIT) // (window * max(1, cum[i + 1] - cum[i])) + 2 for i in live)
        while lo < hi:  # the most windows that no live queue falls short in
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if all(got(i, mid) <= left[i] for i in live) else (lo, mid - 1)
        if lo:
            first.append(w), los.append(cum[:-1]), his.append(cum[1:]), gives.append(list(given))
            for i in live:
                n = got(i, lo)
                left[i] -= n
                given[i] += n
            w += lo
        live = [i for i, n in enumerate(left) if n]
        if live:  # one window by hand: each queue's due as far as it has it, the rest from the fullest
            room = min(window, sum(left))
            due = {i: min(left[i], room * max(1, cum[i + 1] - cum[i]) // UNIT) for i in live}
            short = room - sum(due.values())
            for i in sorted(live, key=lambda i: (due[i] - left[i], i)):
                more = min(short, left[i] - due[i])
                due[i] += more
                short -= more
            edges = [0]
            for i in range(len(left)):
                edges.append(edges[-1] + due.get(i, 0))
            first.append(w), los.append(edges[:-1]), his.append(edges[1:]), gives.append(list(given))
            for i in live:
                left[i] -= due[i]
                given[i] += due[i]
            w += 1
    units = tuple(window if a[-1] <= window and max(b) <= window else UNIT for a, b in zip(los, his))
    shape = (len(first), len(tokens))
    return Schedule(window, (*first, w), np.array(los, np.int64).reshape(shape), np.array(his, np.int64).reshape(shape), units, np.array(gives, np.int64).reshape(shape), sum(tokens))


def _pieces(s: Schedule, q: int, begin: int, n: int):
    """(start in the document, length, sequence, offset) arrays of queue positions [begin, begin + n)."""
    given = s.given[:, q]
    out = []
    at, end = begin, begin + n
    p = int(np.searchsorted(given, at, side="right")) - 1
    while at < end:
        stop = int(given[p + 1]) if p + 1 < len(given) else end
        if stop <= at:  # a phase that serves none of this queue
            p += 1
            continue
        upto = min(end, stop)
        rate = s.window * (int(s.hi[p, q]) - int(s.lo[p, q])) / s.unit[p]
        w0 = max(0, int((at - int(given[p])) / rate) - 2)
        w1 = int((upto - int(given[p])) / rate) + 3
        w = np.arange(w0, min(w1, s.first[p + 1] - s.first[p]) + 1, dtype=np.int64)
        edge = s.bounds(p, q, w) + int(given[p])
        a, b = np.maximum(edge[:-1], at), np.minimum(edge[1:], upto)
        ok = b > a
        w, a, b, base = w[:-1][ok], a[ok], b[ok], edge[:-1][ok]
        out.append((a - begin, b - a, s.first[p] + w, s.offset(p, q, w) + a - base))
        at, p = upto, p + 1
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def routes(tokens: list[int], shares: list[float], window: int, most: int = 64) -> list[tuple[tuple[Schedule, int], ...]]:
    """For each queue the schedules that place it, innermost first, and its place in each.

    The ``most`` - 1 queues with the most tokens have places of their own; all others share one, whose
    tokens come from a round-robin among them: one schedule, or a tree of them, each over ``most``
    queues at most.  A pool's window is the least in which each of its queues has a token, so a deficit
    is carried over that many of the pool's tokens (64 at least, or pieces get too short).  The pool's share is the sum of its queues' shares;
    when one of them runs dry, its part goes to the others of its schedule first.
    """
    out: list[tuple[tuple[Schedule, int], ...]] = [()] * len(tokens)

    def place(groups: list[list[int]], window: int) -> None:
        s = schedule([sum(tokens[q] for q in g) for g in groups], [sum(shares[q] for q in g) for g in groups], window)
        for i, g in enumerate(groups):
            if len(g) > 1:
                inner = [[q] for q in g] if len(g) <= most else [g[k::most] for k in range(most)]
                sizes = [sum(shares[q] for q in x) for x in inner]
                need = 1.1 * max(len(inner), sum(sizes) / min((x for x in sizes if x > 0), default=1.0))
                place(inner, next((1 << b for b in range(6, 15) if 1 << b >= need), 1 << 15))
            for q in g:
                out[q] = (*out[q], (s, i))

    if len(tokens) <= most:
        place([[q] for q in range(len(tokens))], window)
    else:
        order = sorted(range(len(tokens)), key=lambda q: (-tokens[q], q))
        place([*([q] for q in sorted(order[: most - 1])), order[most - 1 :]], window)
    return out


def _routed(route: tuple[tuple[Schedule, int], ...], begin: int, n: int):
    """``_pieces`` through the schedules of a route: places in an inner one are positions in the queue of the next."""
    (s, q), *outer = route
    got = _pieces(s, q, begin, n)
    for s2, q2 in outer:
        parts = []
        for at, k, w, o in zip(*(x.tolist() for x in got)):
            start, *rest = _pieces(s2, q2, w * s.window + o, k)
            parts.append((start + at, *rest))
        got, s = [np.concatenate(x) for x in zip(*parts)], s2
    return got


def place(routed: list[tuple[tuple[Schedule, int], ...]], nos: np.ndarray, begin: np.ndarray, n: np.ndarray):
    """(document, start, length, sequence, offset) arrays of the pieces of documents, by document and start.

    Document k holds the positions [begin[k], begin[k] + n[k]) of queue nos[k].  Documents that follow one
    another in a queue are placed as one run and cut apart afterwards.
    """
    order = np.lexsort((begin, nos))
    q, at, size = nos[order], begin[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (at[1:] != at[:-1] + size[:-1])])) if len(q) else np.zeros(0, int)
    out = []
    for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(q)]):
        first = int(at[i])
        piece, _, seq, off = _routed(routed[q[i]], first, int(at[j - 1] + size[j - 1]) - first)
        doc = at[i:j] - first
        cuts = np.union1d(piece, doc)
        d, p = np.searchsorted(doc, cuts, side="right") - 1, np.searchsorted(piece, cuts, side="right") - 1
        length = np.diff(np.append(cuts, doc[-1] + size[j - 1]))
        out.append((order[i + d], cuts - doc[d], length, seq[p], off[p] + cuts - piece[p]))
    if not out:
        return [np.zeros(0, np.int64)] * 5
    got = [np.concatenate(x).astype(np.int64) for x in zip(*out)]
    by = np.lexsort((got[1], got[0]))
    return [x[by] for x in got]


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shares: dict[str, float] | None = None, alpha: float = 0.7, max_queues: int = 64, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, queue, target, start, length, ids (binary), doc_tokens, sequence_id, offset.

    ``shares`` are the target token proportions of the queues; those that it lacks get the least share
    given.  By default they are the queues' tokens to the power ``alpha``: small queues are
    ahead of their part until they run dry, and 1 makes all run dry together.  target is the
    queue's share of the sum.  Every source is a queue; of more than ``max_queues``, those with the
    fewest tokens take turns within one (``routes``).  The driver holds the sources' names and totals.
    Every row is packed, repeated rows too; the last sequence alone may be short.  No rows give no
    pieces.  Token ids stay in the partition that they were made in, unless partitions and queues make
    over 500,000 pairs: then the ids are shuffled once, to meet their partition's place.
    """
    if window & (window - 1) or window > 1 << 15:
        raise ValueError("a window is a power of two, 32768 at most")
    spark = docs.sparkSession
    own = sorted(r["queue"] for r in docs.select(F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue")).distinct().collect())
    tokens = tokenize(docs, tokenizer, own, end_id, id_col, text_col, queue_col)
    per_chunk = cut(tokens.groupBy("chunk", "no").agg(F.sum("doc_tokens").alias("n")))
    totals = {r["no"]: r["n"] for r in per_chunk.groupBy("no").agg(F.sum("n").alias("n")).collect()}
    n = [int(totals.get(i, 0)) for i in range(len(own))]
    if shares:
        least = min(shares.values())
        target = [float(shares.get(name, least)) for name in own]
    else:
        target = [float(x) ** alpha for x in n]
    whole = sum(target) or 1.0
    plan = spark.sparkContext.broadcast((routes(n, target, window, max_queues), np.array([x / whole for x in target])))
    # A chunk's tokens of a queue follow those of the chunks before it.
    order = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_chunk.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select("chunk", "no", "base")
    placed = tokens.join(F.broadcast(bases) if per_chunk.count() <= 500_000 else bases, ["chunk", "no"])
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routed, part = plan.value
        for b in slices(batches, "ids", rows=4096, size=4 << 20):
            begin, size, nos = (b.column(c).to_numpy() for c in ("begin", "doc_tokens", "no"))
            doc, start, length, seq, off = place(routed, nos, begin, size)
            blob = b.column("ids")
            edge = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset]
            # Pieces by document and start are the column's bytes in their order.
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((edge + np.concatenate([[0], 4 * np.cumsum(length)])).astype(np.int32)), blob.buffers()[2]])
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("queue").take(at), pa.array(part[nos[doc]]), pa.array(start), pa.array(length), ids, pa.array(size[doc]), pa.array(seq), pa.array(off)], ["doc_id", "queue", "target", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    cols = placed.select("doc_id", "queue", (F.col("base") + F.col("start")).alias("begin"), "doc_tokens", "no", "ids")
    return cols.mapInArrow(run, f"doc_id {kind}, queue string, target double, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def attained(pieces: DataFrame, last: int | None = None) -> DataFrame:
    """(queue, target, share, worst): each queue's share of the tokens in sequences up to ``last`` (all), and how far
    the share of any one of them is from its target at most; a queue without a piece in one has nothing there."""
    some = pieces if last is None else pieces.where(F.col("sequence_id") <= last)
    per = some.groupBy("sequence_id", "queue", "target").agg(F.sum("length").alias("n"))
    size = per.groupBy("sequence_id").agg(F.sum("n").alias("size"))
    n_windows, tokens = size.agg(F.count("*"), F.sum("size")).first()
    far = F.max(F.abs(F.col("n") / F.col("size") - F.col("target")))
    by = per.join(size, "sequence_id").groupBy("queue", "target").agg((F.sum("n") / F.lit(tokens)).alias("share"), far.alias("far"), F.count("*").alias("_in"))
    return by.select("queue", "target", "share", F.when(F.col("_in") < n_windows, F.greatest("far", "target")).otherwise(F.col("far")).alias("worst"))
