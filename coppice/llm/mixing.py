"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, written

#: Topics by what a text holds, the first that matches; else prose.
TOPIC_RULES = (
    ("legal", r"[Ll][Ii][Cc][Ee][Nn][SsCc][Ee]|[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]"),
    ("contact", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[a-z]|\+[0-9]{1,3} ?\("),
    ("web", r"https?://"),
    ("table", r" \| [^|\n]* \| "),
    ("symbols", r"[#*$%&]{3}"),
)


def topic(text: Column) -> Column:
    """A coarse topic of a text; null and empty texts are prose."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPIC_RULES):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(text.isNull(), F.lit("prose")).otherwise(out)


def token_count(text: Column) -> Column:
    """Words of a text, one at least: an empty document still counts."""
    return F.greatest(F.lit(1), F.size(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 48 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def tempered(tokens: float | Column, alpha: float = 0.7):
    return F.pow(tokens, F.lit(alpha)) if isinstance(tokens, Column) else tokens**alpha


def feasible(mass: dict, shares: dict, budget: float) -> dict:
    """Tokens wanted of each value: ``budget`` by shares, none above its mass; what those lack goes to the others by their shares."""
    want = {v: 0.0 for v in mass}
    full: set = set()
    while True:
        open_ = [v for v in mass if v not in full and shares.get(v, 0.0) > 0]
        left, total = budget - sum(mass[v] for v in full), sum(shares[v] for v in open_)
        over = [v for v in open_ if shares[v] / total * left >= mass[v]]
        if not over:
            return want | {v: float(mass[v]) for v in full} | {v: shares[v] / total * left for v in open_}
        full |= set(over)


#: A rate from here on is a saturated cell's: rounding must not decide it.
FULL = 1 - 1e-9
#: Sweeps end when no margin is further from its target than this share of the budget, or at ``rounds``.
TOLERANCE = 1e-10


def _sweep(r: np.ndarray, tokens: np.ndarray, code: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Rates scaled to one margin: down in proportion; up with saturated cells left out, none above 1."""
    now = np.bincount(code, r * tokens, len(want))
    held = np.bincount(code, np.where(r >= FULL, tokens, 0), len(want))
    up = want > now
    over, under = np.where(up, want - held, want), np.where(up, now - held, now)
    factor = np.divide(over, under, out=np.where(up, 1.0, 0.0), where=under > 0)[code]
    return np.where(up[code] & (r >= FULL), 1.0, np.minimum(1.0, r * factor))


def _rake_local(cells, margins: Sequence[str], want: dict[str, dict], budget: float, rounds: int) -> np.ndarray:
    r = np.full(len(cells), min(1.0, budget / max(cells["tokens"].sum(), 1)))
    tokens = cells["tokens"].to_numpy(float)
    codes = {m: cells[m].astype("category") for m in margins}
    due = {m: np.array([want[m][v] for v in c.cat.categories]) for m, c in codes.items()}
    for _ in range(rounds):
        for m in margins:
            r = _sweep(r, tokens, codes[m].cat.codes.to_numpy(), due[m])
        far = max(np.abs(np.bincount(codes[m].cat.codes, r * tokens, len(due[m])) - due[m]).max(initial=0) for m in margins)
        if far <= TOLERANCE * max(budget, 1):
            break
    return r


def rake(cells: DataFrame, margins: Sequence[str], targets: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, rounds: int = 60, alpha: float = 0.7, most_local: int = 200_000) -> DataFrame:
    """``cells`` (the margins' columns and ``tokens``) with a ``rate`` in [0, 1] for each.

    Every sweep scales the rates to each margin's target tokens in turn; cells at 1 are frozen while
    their value is scaled up.  Targets default to each value's tokens to the power ``alpha``,
    normalised; values without a target get 0.  What a value lacks to reach its target with
    all rates at 1 goes to the margin's other values.  Margins can still contradict
    one another: ``attained`` tells how far each is from its target.  Up to ``most_local``
    cells (a checked size) are raked on the driver; beyond that the same sweeps run as joins on the cluster.
    """
    spark = cells.sparkSession
    cells = cut(cells)
    if cells.limit(most_local + 1).count() > most_local:
        return _rake_far(cells, margins, targets, budget_share, rounds, alpha)
    local = cells.toPandas()
    if not len(local):
        return cells.withColumn("rate", F.lit(0.0))
    budget, want = budget_share * float(local["tokens"].sum()), {}
    for m in margins:
        mass = {v: float(t) for v, t in local.groupby(m)["tokens"].sum().sort_index().items()}
        given = (targets or {}).get(m)
        want[m] = feasible(mass, given or {v: tempered(t, alpha) for v, t in mass.items()}, budget)
    local["rate"] = _rake_local(local, margins, want, budget, rounds)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", rate double"
    return spark.createDataFrame(local, schema)


def _wanted(cells: DataFrame, m: str, given: dict[str, float] | None, budget: float, alpha: float) -> DataFrame:
    """(margin, asked, want): target tokens before and after what some values lack went to the others."""
    mass = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t"))
    raw = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in given.items() for y in kv]), F.col(m)), F.lit(0.0)) if given else tempered(F.col("t"), alpha)
    mass = cut(mass.withColumn("raw", raw).withColumn("full", F.lit(False)))
    total = mass.agg(F.sum("raw")).first()[0] or 1.0
    while True:
        held, open_ = mass.agg(F.sum(F.when(F.col("full"), F.col("t")).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("raw")))).first()
        due = F.col("raw") / F.lit(open_ or 1.0) * F.lit(budget - (held or 0.0))
        more = mass.where(~F.col("full") & (F.col("raw") > 0) & (due >= F.col("t"))).limit(1).count()
        if not more:
            return cut(mass.select(m, (F.col("raw") / F.lit(total) * F.lit(budget)).alias("asked"), F.when(F.col("full"), F.col("t")).otherwise(due).alias("want")))
        mass = cut(mass.withColumn("full", F.col("full") | ((F.col("raw") > 0) & (due >= F.col("t")))))


def _rake_far(cells: DataFrame, margins: Sequence[str], targets, budget_share: float, rounds: int, alpha: float) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    budget = budget_share * total
    want = {m: _wanted(cells, m, (targets or {}).get(m), budget, alpha).select(m, "want") for m in margins}
    out = cells.withColumn("rate", F.lit(min(1.0, budget / total)))
    mass = F.col("rate") * F.col("tokens")
    for _ in range(rounds):
        for m in margins:
            sums = out.groupBy(m).agg(F.sum(mass).alias("now"), F.sum(F.when(F.col("rate") >= FULL, F.col("tokens")).otherwise(0)).cast("double").alias("held"))
            up = F.col("want") > F.col("now")
            scale = F.when(up, F.when(F.col("now") > F.col("held"), (F.col("want") - F.col("held")) / (F.col("now") - F.col("held"))).otherwise(1.0)).otherwise(F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0))
            factor = want[m].join(sums, m).select(m, up.alias("up"), scale.alias("factor"))
            rate = F.when(F.col("up") & (F.col("rate") >= FULL), 1.0).otherwise(F.least(F.lit(1.0), F.col("rate") * F.col("factor")))
            out = out.join(factor, m).withColumn("rate", rate).drop("factor", "up")
        out = cut(out)
        far = [want[m].join(out.groupBy(m).agg(F.sum(mass).alias("now")), m).agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0 for m in margins]
        if max(far) <= TOLERANCE * budget:
            break
    return out


def attained(rated: DataFrame, margins: Sequence[str], targets: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, alpha: float = 0.7) -> DataFrame:
    """(margin, value, tokens, asked, want, got) of cells with rates: a value's expected tokens against its target, as it
    was asked for and after the shortfall of saturated values was dealt out; ``got`` below ``asked`` is infeasible."""
    budget = budget_share * (rated.agg(F.sum("tokens")).first()[0] or 0)
    parts = []
    for m in margins:
        want = _wanted(rated, m, (targets or {}).get(m), budget, alpha)
        now = rated.groupBy(m).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("rate") * F.col("tokens")).alias("got"))
        parts.append(want.join(now, m).select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), "tokens", "asked", "want", "got"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


KEYS = ("source", "lang", "topic")
#: Rates are broadcast up to so many cells, else joined.
FEW_CELLS = 200_000


def _cell(docs: DataFrame, text_col: str) -> list[Column]:
    text = F.col(text_col)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [part("source"), part("lang"), topic(text), token_count(text)]


def _rates(cells_of: DataFrame, keys: Sequence[str], tokens: str, targets, budget_share: float, rounds: int, alpha: float) -> DataFrame:
    cells = cells_of.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, KEYS)]).agg(F.sum(tokens).alias("tokens"))
    return rake(cells, KEYS, targets, budget_share, rounds, alpha)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW_CELLS + 1).count() <= FEW_CELLS else df


def decisions(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, rounds: int = 60, alpha: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, source, lang, topic, tokens, rate, kept and met_source, met_lang, met_topic; texts are read once.

    met_<margin> is the expected share of the row's value over the share that was asked for: 1, or how far the
    value falls short or stands in for one that does.  A document is kept if the uniform number
    of its id is below its cell's rate, so repeated rows share their fate and a rerun draws
    the same sample.  A null source or language is the value ''.  The cells' tokens are
    aggregated before any shuffle; rates come back by a broadcast of a checked size, or a join.
    """
    small = written(docs.select(F.col(id_col).alias("id"), *[c.alias(n) for c, n in zip(_cell(docs, text_col), (*KEYS, "tokens"))]))
    rated = cut(_rates(small, KEYS, "tokens", targets, budget_share, rounds, alpha))
    out = small.join(_few(rated.drop("tokens")), list(KEYS))
    met = cut(attained(rated, KEYS, targets, budget_share, alpha))
    for m in KEYS:
        own = met.where(F.col("margin") == m).select(F.col("value").alias(m), F.when(F.col("asked") > 0, F.col("got") / F.col("asked")).alias(f"met_{m}"))
        out = out.join(_few(own), m)
    return out.select(F.col("id").alias(id_col), *KEYS, "tokens", "rate", (uniform(F.col("id").cast("string")) < F.col("rate")).alias("kept"), *[f"met_{m}" for m in KEYS])


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, rounds: int = 60, alpha: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``decisions`` keeps, with the columns that they have, whatever their names.

    Topics and tokens are found once: rows go to a table with them, which the cells and the sample are read from.
    """
    *keys, tokens, rate = fresh(docs, *KEYS, "tokens", "rate")
    named = written(docs.withColumns(dict(zip((*keys, tokens), _cell(docs, text_col)))))
    rated = _rates(named, keys, tokens, targets, budget_share, rounds, alpha)
    own = rated.select(*[F.col(n).alias(k) for k, n in zip(keys, KEYS)], F.col("rate").alias(rate))
    return named.join(_few(own), keys).where(uniform(F.col(id_col).cast("string")) < F.col(rate)).select(docs.columns)


#: The result of the registered query as DuckDB SQL: the sweeps unrolled.
def oracle(rounds: int = 60, budget_share: float = 0.5, alpha: float = 0.7, fills: int = 8) -> str:
    rules = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{name}'" for name, p in TOPIC_RULES)
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, CASE WHEN text IS NULL THEN 'prose' {rules} ELSE 'prose' END AS t,
            greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')))::BIGINT AS tokens FROM documents)""",
        "c0 AS (SELECT s, l, t, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        f"b AS (SELECT sum(tokens) * {budget_share} AS budget FROM c0)",
    ]
    for m in "slt":
        ctes.append(f"f{m}0 AS MATERIALIZED (SELECT {m}, sum(tokens) AS mass, pow(sum(tokens), {alpha}) AS share, false AS full_ FROM c0 GROUP BY {m})")
        due = "share / sum(CASE WHEN full_ THEN 0 ELSE share END) OVER () * ((SELECT budget FROM b) - sum(CASE WHEN full_ THEN mass ELSE 0 END) OVER ())"
        for k in range(fills):
            ctes.append(f"f{m}{k + 1} AS MATERIALIZED (SELECT {m}, mass, share, full_ OR {due} >= mass AS full_ FROM f{m}{k})")
        ctes.append(f"w{m} AS MATERIALIZED (SELECT {m}, share / sum(share) OVER () * (SELECT budget FROM b) AS asked, CASE WHEN full_ THEN mass ELSE {due} END AS want FROM f{m}{fills})")
    ctes.append(f"r0 AS MATERIALIZED (SELECT *, least(1.0, {budget_share})::DOUBLE AS r FROM c0)")
    i = 0
    for _ in range(rounds):
        for m in "slt":
            ctes.append(f"""r{i + 1} AS MATERIALIZED (SELECT s, l, t, tokens, CASE WHEN want > now AND r >= {FULL} THEN 1.0e0 WHEN want > now THEN least(1.0e0, r * CASE WHEN now > held THEN (want - held) / (now - held) ELSE 1 END) ELSE r * want / now END AS r
                FROM (SELECT x.*, want, sum(r * tokens) OVER p AS now, sum(CASE WHEN r >= {FULL} THEN tokens ELSE 0 END) OVER p AS held FROM r{i} x JOIN w{m} USING ({m}) WINDOW p AS (PARTITION BY x.{m})))""")
            i += 1
    for m in "slt":
        ctes.append(f"g{m} AS (SELECT {m}, sum(r * tokens) / any_value(asked) AS met FROM r{i} JOIN w{m} USING ({m}) GROUP BY {m})")
    return (
        "WITH " + ",\n".join(ctes) + f"""
    SELECT doc_id, d.t AS topic, d.tokens AS n_tokens, round(r, 6) AS rate, round(gs.met, 6) AS met_source, round(gl.met, 6) AS met_lang, round(gt.met, 6) AS met_topic,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < r AS kept
    FROM d JOIN r{i} USING (s, l, t) JOIN gs USING (s) JOIN gl USING (l) JOIN gt USING (t)"""
    )
