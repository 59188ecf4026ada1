"""License scans: Dice coefficient of word bigrams against templates; DataFrame functions only.

Texts are compared as one run of words: line breaks, comment marks and letter case don't count.  A
template is compared with the whole text, and with every window of its own number of bigrams
that begins at a bigram of the template.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, written
from .license_texts import TEMPLATES

WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"


def normal_words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits (a dot may join digits)."""
    return F.regexp_extract_all(lower_az(c), F.lit(WORDS), F.lit(0))


def bigrams(text: str) -> list[str]:
    w = re.findall(WORDS, text.lower())
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def anchors(templates=TEMPLATES, least: float = 0.8) -> list[str]:
    """Words of which every text that matches a template holds one at least.

    A match shares least / (2 - least) of the template's bigrams, so it can't lack all
    bigrams of a set that is larger than the rest; long words are taken until they touch so many.
    """
    chosen: set[str] = set()
    for _, text in templates:
        grams = [g.split(" ") for g in bigrams(text)]
        spare = len(grams) - ceil(len(grams) * least / (2 - least) - 1e-9)
        own: set[str] = set()
        for x in sorted({x for g in grams for x in g}, key=lambda x: (-(x in chosen), -len(x), x)):
            if sum(bool(own & set(g)) for g in grams) > spare:
                break
            own.add(x)
        chosen |= own
    return sorted(chosen)


def matches(docs: DataFrame, least: float = 0.8, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """(digest, template, dice) of each distinct text, named by its md5, and each template that it matches.

    Dice of two runs of a and b bigrams that have o in common, repeats included, is 2o / (a + b).  A
    bigram of a window counts unless it has occurred in the window as often as the template has
    it, so each hit carries the position of that earlier occurrence.  Size bounds prune: a run shares
    least / 2 of both sizes with a template or can't match it, so texts with fewer hits of a template
    are dropped, and windows are scored only where as many hits lie within reach.
    """
    if any(len(bigrams(x)) < 1 for _, x in templates):
        raise ValueError("a template has two words at least")
    rows = [(g, i, k, len(bigrams(x))) for i, (_, x) in enumerate(templates) for g, k in Counter(bigrams(x)).items()]
    posting = F.broadcast(docs.sparkSession.createDataFrame(rows, "gram string, template int, often int, m int"))  # a row for each bigram of the templates
    hits = docs.select("digest", "n", F.explode("hits").alias("h")).select("digest", "n", F.col("h.gram").alias("gram"), F.col("h.pos").alias("pos")).join(posting, "gram")
    # Copies of a text bring the same positions.
    by = hits.groupBy("digest", "n", "template", "m", "gram", "often").agg(F.array_sort(F.collect_set("pos")).alias("q"))
    back = F.transform("q", lambda x, i: F.struct(x.alias("pos"), F.when(i >= F.col("often"), F.element_at("q", i - F.col("often") + 1)).otherwise(F.lit(-1)).alias("back")))
    by = by.withColumn("back", back).withColumn("shared", F.least(F.size("q"), F.col("often")))
    one = by.groupBy("digest", "n", "template", "m").agg(F.array_sort(F.flatten(F.collect_list("back"))).alias("hits"), F.sum("shared").alias("shared"))
    one = one.where(F.col("shared") * (2 - least) + 1e-9 >= F.col("m") * least)
    whole = 2.0 * F.col("shared") / (F.col("n") + F.col("m"))
    size = lambda h: F.least(F.col("m"), F.col("n") - h["pos"])
    need = lambda h: F.ceil((size(h) + F.col("m")) * (least / 2) - 1e-9).cast("int")
    at = F.transform("hits", lambda h, i: F.struct(h["pos"].alias("pos"), i.alias("i")))
    dense = F.filter(at, lambda h: F.coalesce(F.get("hits", h["i"] + need(h) - 1)["pos"] < h["pos"] + F.col("m"), F.lit(False)))

    def dice(h: Column) -> Column:
        inside = F.filter(F.slice("hits", h["i"] + 1, F.col("m")), lambda x: (x["pos"] < h["pos"] + F.col("m")) & (x["back"] < h["pos"]))
        return 2.0 * F.size(inside) / (size(h) + F.col("m"))

    best = F.greatest(whole, F.coalesce(F.array_max(F.transform(dense, dice)), F.lit(0.0)))
    return one.select("digest", "template", best.alias("dice")).where(F.col("dice") >= least)


def found_hits(docs: DataFrame, least: float, templates, id_col: str, text: str) -> DataFrame:
    """(doc_id, digest, n, hits) of every row in a table: digest, the number of bigrams and the hits are null without a hit."""
    grams = sorted({g for _, x in templates for g in bigrams(x)})
    likely = "(?i)" + "|".join(re.escape(x) for x in anchors(templates, least))
    w = F.when(F.col(text).rlike(likely), normal_words(F.col(text)))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), w.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.slice("w", 2, F.size("w") - 1), lambda x, i: F.struct(F.concat(F.element_at("w", i + 1), F.lit(" "), x).alias("gram"), i.alias("pos"))))
    df = df.withColumn("hits", F.filter(pairs, lambda p: p["gram"].isin(grams)))
    some = F.size("hits") > 0
    return written(df.select("doc_id", F.when(some, F.md5(F.col("text").cast("binary"))).alias("digest"), F.when(some, F.size("w") - 1).alias("n"), F.when(some, F.col("hits")).alias("hits")))


def scan(docs: DataFrame, least: float = 0.8, templates=TEMPLATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, dice, licenses) for every row: the best template's license and the names of all that match, sorted.

    Ties go to the first template listed.  Rows without a match, null and empty texts have a null
    license, dice 0 and no names.  Equal texts are compared once; repeated ids and rows with a null
    id are rows like any other.
    """
    table = found_hits(docs, least, templates, id_col, text)
    names = docs.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(templates)], "template int, name string")
    m = matches(table.where("digest is not null"), least, templates, text).join(F.broadcast(names), "template")  # a row for each template
    best = m.groupBy("digest").agg(F.max(F.struct("dice", -F.col("template"), "name")).alias("best"), F.array_sort(F.collect_set("name")).alias("licenses"))
    none = F.array().cast("array<string>")
    some = table.where("digest is not null").select("doc_id", "digest").join(best, "digest", "left")
    some = some.select("doc_id", F.col("best.name").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), F.coalesce("licenses", none).alias("licenses"))
    # Rows without a hit stay out of the join, where they would be one key.
    rest = table.where("digest is null").select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("dice"), none.alias("licenses"))
    return some.unionByName(rest)


def oracle(least: float = 0.8) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(n)}, {quote(x)})" for i, (n, x) in enumerate(TEMPLATES))
    norm = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"
    return f"""WITH t0(template, license, text) AS (VALUES {values}), t1 AS (SELECT template, license, {norm('text')} AS w FROM t0),
    t2 AS (SELECT template, license, len(w) - 1 AS m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t1),
    t AS (SELECT template, license, m, gram, count(*) AS often FROM t2 GROUP BY ALL),
    d0 AS (SELECT DISTINCT md5(text) AS digest, text FROM documents WHERE text IS NOT NULL), d1 AS (SELECT digest, {norm('text')} AS w FROM d0),
    d2 AS (SELECT digest, len(w) - 1 AS n, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d1 WHERE len(w) > 1),
    h0 AS (SELECT digest, n, pos, gram, template, license, m, often, row_number() OVER (PARTITION BY digest, template, gram ORDER BY pos) AS rn FROM d2 JOIN t USING (gram)),
    h AS (SELECT a.*, coalesce(b.pos, -1) AS back FROM h0 a LEFT JOIN h0 b ON a.digest = b.digest AND a.template = b.template AND a.gram = b.gram AND b.rn = a.rn - a.often),
    whole AS (SELECT digest, template, license, 2.0e0 * sum(CASE WHEN rn <= often THEN 1 ELSE 0 END) / (any_value(n) + any_value(m)) AS dice, sum(CASE WHEN rn <= often THEN 1 ELSE 0 END) AS shared, any_value(m) AS m FROM h GROUP BY digest, template, license),
    enough AS (SELECT digest, template FROM whole WHERE shared * (2 - {least}) + 1e-9 >= m * {least}),
    hs AS (SELECT h.* FROM h SEMI JOIN enough USING (digest, template)),
    win AS (SELECT s.digest, s.template, s.license, s.pos, 2.0e0 * count(*) / (least(any_value(s.m), any_value(s.n) - s.pos) + any_value(s.m)) AS dice FROM hs s JOIN hs x ON x.digest = s.digest AND x.template = s.template AND x.pos >= s.pos AND x.pos < s.pos + s.m AND x.back < s.pos GROUP BY s.digest, s.template, s.license, s.pos),
    m AS (SELECT digest, template, license, max(dice) AS dice FROM (SELECT digest, template, license, dice FROM whole UNION ALL SELECT digest, template, license, dice FROM win) GROUP BY ALL HAVING max(dice) >= {least}),
    best AS (SELECT digest, arg_max(license, dice * 1000 - template * 1e-6) AS license, max(dice) AS dice, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses FROM m GROUP BY digest)
    SELECT doc_id, license, round(coalesce(dice, 0.0), 6) AS dice, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN best ON best.digest = md5(documents.text)"""
