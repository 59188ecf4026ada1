"""Quality rules: divergence of a text from its language's reference; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_az, lower_words, text_col, words, written

#: The histogram's character classes in order; the last takes what is left over.
CLASSES = (("lower", "[a-z]+"), ("space", r"[\x20\x09-\x0D]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("mark", r"[.,;:!?'\"()-]+"), ("far", r"[^\x00-\x7F]+"), ("symbol", None))
WINDOW = 8


def class_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_<class> and n_symbols; each class is peeled off what the ones before it left."""
    last = text
    for i, (name, pattern) in enumerate(CLASSES[:-1]):
        df = df.withColumn(f"_t{i}", F.regexp_replace(last, pattern, "")).withColumn(f"n_{name}", (F.length(last) - F.length(f"_t{i}")).cast("long"))
        last = f"_t{i}"
    df = df.withColumn("n_symbol", F.length(last).cast("long")).withColumn("n_symbols", (F.length(last) - F.length(F.regexp_replace(last, "[#*$%&|<>]+", ""))).cast("long"))
    return df.drop(*[f"_t{i}" for i in range(len(CLASSES) - 1)])


def window_hashes(df: DataFrame, w: str, out: str, size: int = WINDOW) -> DataFrame:
    """Adds a hash of every window of ``size`` words (a power of two): hashes of halves are paired log2(size) times.

    Each step is a column of its own, so that no step's array is built twice.
    """
    df = df.withColumn("_w1", F.transform(w, lambda x: F.xxhash64(x)))
    step = 1
    while step < size:
        h, n = f"_w{step}", F.size(f"_w{step}") - step
        pair = F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + step, n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"_w{2 * step}", F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(pair))
        step *= 2
    return df.withColumnRenamed(f"_w{size}", out).drop(*[f"_w{1 << i}" for i in range(size.bit_length() - 1)])


def covered_words(h: Column, size: int = WINDOW) -> Column:
    """Words in windows whose hash occurs twice or more: sorted, so equal hashes stand side by side."""
    n = F.size(h)
    s = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    empty = F.lit(None).cast("struct<h:bigint,i:int>")
    z = F.arrays_zip(s.alias("x"), F.concat(F.array(empty), F.slice(s, 1, n - 1)).alias("p"), F.concat(F.slice(s, 2, n - 1), F.array(empty)).alias("q"))
    pos = F.array_sort(F.transform(F.filter(z, lambda y: F.coalesce(y["x"]["h"] == y["p"]["h"], F.lit(False)) | F.coalesce(y["x"]["h"] == y["q"]["h"], F.lit(False))), lambda y: y["x"]["i"]))
    after = lambda p: F.concat(F.slice(p, 2, F.size(p)), F.array(F.element_at(p, -1) + size))
    total = lambda p: F.aggregate(F.zip_with(p, after(p), lambda a, b: F.least(F.lit(size), b - a)), F.lit(0), lambda acc, x: acc + x)
    one = F.aggregate(F.transform(F.array(pos), total), F.lit(0), lambda acc, x: acc + x)  # binds pos once
    return F.when((n < 2) | (F.size(F.array_distinct(h)) == n), F.lit(0)).otherwise(one).cast("long")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, words, low (words, A-Z in lower case) and the counts of the contract for every row."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), text_col(text).alias("text"))
    df = class_counts(df.withColumn("words", words(F.col("text"))))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length("text") - F.col("n_space"))
    df = df.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = window_hashes(df, "words", "_h").withColumn("n_repeat_words", covered_words(F.col("_h")))
    return df.withColumn("low", lower_words(F.col("words"))).drop("_lines", "_h", "text")


def common_words(docs: DataFrame, common: int = 20, least_words: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, common array<string>, shares array<double>) from all rows of each language.

    ``common`` are the language's most frequent words, A-Z in lower case (ties: in order of the word),
    among those that make up a thousandth of its words, at most a thousand; shares
    are theirs, then all other words'.  Words are counted as they are written, and put into lower case
    once a distinct one.  Languages with fewer than ``least_words`` words have no reference.
    """
    df = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.explode(words(text_col(text))).alias("written"))
    counts = df.groupBy("lang", "written").count()
    counts = cut(counts.groupBy("lang", lower_az(F.col("written")).alias("word")).agg(F.sum("count").alias("count")))
    sums = counts.groupBy("lang").agg(F.sum("count").alias("total")).where(F.col("total") >= least_words)
    often = counts.join(_few(sums), "lang").where(F.col("count") * 1000 >= F.col("total"))
    top = often.groupBy("lang", "total").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "word"))), 1, common).alias("top"))
    share = F.transform("top", lambda x: -x["c"] / F.col("total"))
    top = top.select("lang", F.transform("top", lambda x: x["word"]).alias("common"), share.alias("_s"))
    return cut(top.select("lang", "common", F.concat("_s", F.array(1.0 - F.aggregate("_s", F.lit(0.0), lambda a, x: a + x))).alias("shares")))


#: Languages whose references are broadcast; more are joined, each language's rows dealt to SALTS tasks.
MOST_LANGUAGES, SALTS = 512, 32


def _few(df: DataFrame) -> DataFrame:
    """A hint to broadcast a table of a row for each language, if its size allows."""
    return F.broadcast(df) if df.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else df


def with_language(df: DataFrame, refs: DataFrame) -> DataFrame:
    """``df`` with the columns of its language's row of ``refs``, null where there is none."""
    if refs.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES:
        return df.join(F.broadcast(refs), "lang", "left")
    dealt = refs.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["lang", "_salt"], "left").drop("_salt")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    d = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(F.lit(0.0), d / 2))


#: The character before the first common word's; there is one for each of MOST_COMMON words.
ZERO, MOST_COMMON = ord("@"), 60


def with_hits(df: DataFrame, common: int, known: list[str] | None = None) -> DataFrame:
    """Adds hits array<long>: how often each of the columns ``common``'s words occurs among ``low``, words in lower case.

    Words that are common are spelt as a string of a character each, the place in ``common``; what
    is gone when a character is taken out is its count.  ``known``, if given, are all words that any row has in ``common``.
    """
    if common > MOST_COMMON:
        raise ValueError(f"at most {MOST_COMMON} common words")
    some = F.filter("low", lambda w: w.isin(known)) if known else F.col("low")
    spelt = F.array_join(F.transform(some, lambda w: F.chr(F.array_position("common", w) + ZERO)), "")
    df = df.withColumn("_spelt", F.coalesce(spelt, F.lit("")))
    hits = [(F.length("_spelt") - F.length(F.replace(F.col("_spelt"), F.lit(chr(ZERO + k)), F.lit("")))).cast("long") for k in range(1, common + 1)]
    return df.withColumn("hits", F.array(*hits)).drop("_spelt")


def judge(docs: DataFrame, least_words: int = 50, most_char: float = 0.3, most_word: float = 0.45, common: int = 20, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, counts, js_char, js_word, base_failed and kept for every row.

    Distances are null, and don't count against the text, below ``least_words`` words
    or where its language has no reference.  Null and empty texts have no words and
    fail.  Repeated rows are judged alike.  Texts are read twice: for the languages' common
    words, and for the counts of each row, which go to a table that the character
    references are summed from.
    """
    refs = common_words(docs, common, text=text, lang=lang)
    few = refs.limit(MOST_LANGUAGES + 1).collect()  # MOST_LANGUAGES * common words at most
    known = sorted({w for r in few for w in r["common"]}) if len(few) <= MOST_LANGUAGES else None
    df = with_language(base_counts(docs, id_col, text, lang), refs)
    names = [f"n_{n}" for n, _ in CLASSES]
    df = with_hits(df, common, known).select("doc_id", "lang", *names, "n_symbols", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "hits", "shares")
    df = written(df)
    total = lambda f: F.greatest(sum(f(n) for n in names), F.lit(1))
    chars = df.where("shares is not null").groupBy("lang").agg(F.array(*[F.sum(n) / total(F.sum) for n in names]).alias("chars"))
    df = with_language(df, chars)
    ok = (F.col("n_words") >= least_words) & F.col("chars").isNotNull()
    df = df.withColumn("js_char", F.when(ok, js_distance(F.array(*[F.col(n) / total(F.col) for n in names]), F.col("chars"))))
    size = F.size("shares") - 1
    share = F.transform(F.slice("hits", 1, size), lambda n: n / F.greatest("n_words", F.lit(1)))
    df = df.withColumn("_own", share)
    own = F.concat("_own", F.array(1.0 - F.aggregate("_own", F.lit(0.0), lambda a, x: a + x)))
    df = df.withColumn("js_word", F.when(ok, js_distance(own, F.col("shares"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = F.coalesce((F.col("js_char") > most_char) | (F.col("js_word") > most_word), F.lit(False))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_char", "js_word", "base_failed", "kept")
