"""Language identification of mixed-language texts.

Each word gets a log-probability per language from hashed character trigrams;
languages that do not use the word's script are ruled out; Viterbi with a
switching penalty then labels every word, and runs of one label are spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices

#: Trigrams fall into 2**BITS buckets; into fewer, in halves, where the scores of many languages would outgrow MOST_SCORES numbers.
BITS, MOST_SCORES = 16, 1 << 25
#: First code point of each block of letters, and the script it starts ("" ends one).
SCRIPTS = (
    (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xAA, "latin"), (0xAB, ""), (0xB5, "latin"), (0xB6, ""), (0xBA, "latin"), (0xBB, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0xF7, ""), (0xF8, "latin"), (0x250, "latin"), (0x2B0, ""),
    (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"), (0x780, "thaana"), (0x7C0, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFE00, ""), (0x20000, "han"), (0x32000, ""),
)
SCRIPT_NAMES = tuple(sorted({s for _, s in SCRIPTS if s}))


def _script_table() -> np.ndarray:
    """Script number of each code point: letters are those of Unicode's categories L, "other" where no range names a script; else -1."""
    n = 0x33480  # no letters are assigned beyond
    names = np.array([SCRIPT_NAMES.index(s or "other") for _, s in SCRIPTS], np.int8)
    at = np.searchsorted([c for c, _ in SCRIPTS], np.arange(n), side="right") - 1
    script = np.where(at >= 0, names[np.maximum(at, 0)], SCRIPT_NAMES.index("other"))
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(n)), bool, n)
    return np.append(np.where(letter, script, -1), -1).astype(np.int8)


_SCRIPT = _script_table()


def _scripts(cp: np.ndarray) -> np.ndarray:
    """Script number of each code point, -1 for what is no letter."""
    return _SCRIPT[np.minimum(cp, len(_SCRIPT) - 1)]


def _units(texts: list[str], bits: int = BITS):
    """(trigram bucket of each character, starts of words, script of each word, letters of each word, first word of each text)."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer("".join(x + "\n" for x in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    plain = np.where(space, np.uint32(32), cp)
    h = plain * np.uint32(0x85EBCA77)
    h[1:] ^= plain[:-1] * np.uint32(0x9E3779B1)
    h[:-1] ^= plain[1:] * np.uint32(0xC2B2AE3D)
    h *= np.uint32(0x27D4EB2F)
    bucket = (h >> np.uint32(32 - bits)).astype(np.int32)
    script = _scripts(cp)
    ends = np.cumsum([len(x) + 1 for x in low])
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    if len(starts):
        letters = np.add.reduceat((script >= 0).astype(np.int64), starts)
        word_script = np.maximum.reduceat(script, starts)
    else:
        letters, word_script = np.zeros(0, np.int64), np.zeros(0, np.int8)
    return bucket, space, starts, word_script, letters, first


@dataclass(frozen=True)
class Model:
    """``scores`` is float32 [2**bits + 1, languages]; the last bucket is white space and scores 0."""

    languages: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray  # bool [scripts + 1, languages]; the last row is for words without letters
    penalty: float
    bits: int = BITS

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Runs (first word, end word, language) of each text."""
        labels, _, _, first = self.label(texts)
        out = []
        for i, j in zip(first[:-1], first[1:]):
            x = labels[i:j]
            at = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else [0]
            out.append([(s, e, self.languages[x[s]]) for s, e in zip(at[:-1], at[1:])])
        return out

    def label(self, texts: list[str]):
        """(language of each word, log-probabilities, letters of each word, first word of each text)."""
        bucket, space, starts, script, letters, first = _units(texts, self.bits)
        if not len(starts):
            return np.zeros(0, np.int16), np.zeros((0, len(self.languages)), np.float32), letters, first
        e = np.add.reduceat(self.scores[np.where(space, 1 << self.bits, bucket)], starts)
        e += np.where(self.allowed[script], np.float32(0), np.float32(-1e4))
        e[letters == 0] = 0
        return _viterbi(e, first, self.penalty), e, letters, first

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language with the most letters in its spans, and its share of them tempered by its certainty.

        Ties go to the first language by name, in the spans as in the choice.
        """
        labels, e, letters, first = self.label([t or "" for t in texts])
        n, k = len(texts), len(self.languages)
        doc = np.repeat(np.arange(n), np.diff(first))
        mass = np.bincount(doc * k + labels, weights=letters, minlength=n * k).reshape(n, k)
        best = mass.argmax(1)
        total = mass.sum(1)
        # Mean log-odds per letter against the runner-up, over the words that carry the label.
        own = labels == best[doc]
        top = e[np.arange(len(e)), best[doc]] if len(e) else np.zeros(0)
        rest = e.copy()
        if len(e):
            rest[np.arange(len(e)), best[doc]] = -np.inf
        gap = np.where(own & (letters > 0), top - (rest.max(1) if len(e) and k > 1 else top - 20), 0)
        odds = np.bincount(doc, weights=np.clip(gap, -20, 20), minlength=n)
        share = mass[np.arange(n), best] / np.maximum(total, 1)
        score = share / (1 + np.exp(-np.clip(odds, -50, 50)))
        none = total == 0
        return [("und" if z else self.languages[b]) for b, z in zip(best.tolist(), none.tolist())], np.where(none, 0.0, np.clip(score, 0, 1)).tolist()


def _viterbi(e: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of all texts at once: one step per word position, over the texts that reach it."""
    n_words = np.diff(first)
    out = np.zeros(len(e), np.int16)
    if e.shape[1] == 1 or not len(e):
        return out
    order = np.argsort(-n_words, kind="stable")
    order = order[n_words[order] > 0]
    begin, count = first[:-1][order], n_words[order]
    steps = int(count[0])
    alive = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")
    v = e[begin].astype(np.float64)
    stay, came = [], []
    for t in range(1, steps):
        m = alive[t]
        v = v[:m]
        prev = v.argmax(1)
        jump = v[np.arange(m), prev] - penalty
        keep = v >= jump[:, None]
        stay.append(keep)
        came.append(prev.astype(np.int16))
        v = np.where(keep, v, jump[:, None]) + e[begin[:m] + t]
        ends = np.flatnonzero(count[:m] == t + 1)
        if len(ends):
            out[begin[ends] + t] = v[ends].argmax(1)
    single = np.flatnonzero(count == 1)
    if len(single):
        out[begin[single]] = e[begin[single]].argmax(1)
    for t in range(steps - 1, 0, -1):
        m = alive[t]
        now = out[begin[:m] + t]
        out[begin[:m] + t - 1] = np.where(stay[t - 1][np.arange(m), now], now, came[t - 1])
    return out


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, kind, id, n): trigrams (kind 0) and letters by script (kind 1) of each language in a slice of the partition."""
    for b in slices(batches):
        langs = b.column("lang").to_pylist()
        texts = b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            bucket, space, _, script, letters, _ = _units([t for t, x in zip(texts, langs) if x == lang and t], bits)
            has = script >= 0
            tri = np.bincount(bucket[~space], minlength=1 << bits)
            scr = np.bincount(script[has].astype(np.int64), weights=letters[has], minlength=len(SCRIPT_NAMES)).astype(np.int64)
            for kind, x in ((0, tri), (1, scr)):
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "kind", "id", "n"])


def train(docs: DataFrame, per_language: int = 2000, penalty: float = 6.0, smoothing: float = 0.5, most_scores: int = MOST_SCORES, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns trigram and script counts from rows with a text and a language.

    About ``per_language`` distinct texts of each language, drawn by a hash of the text,
    are the bounded sample the model is fitted on (languages with fewer are used whole); copies count once.
    The driver holds a score for each language and bucket of trigrams: up to ``most_scores`` with 2**16
    buckets (512 languages), beyond with half as many, and so on.  Without languages every text is ``und``.
    """
    src = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = src.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("count"))
    langs = tuple(sorted(r["lang"] for r in sizes.select("lang").collect()))
    if not langs:
        return Model((), np.zeros(((1 << BITS) + 1, 0), np.float32), np.ones((len(SCRIPT_NAMES) + 1, 0), bool), penalty)
    bits = BITS
    while len(langs) << bits > most_scores and bits > 8:
        bits -= 1
    rate = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")) * (1 << 20)
    rated = src.join(F.broadcast(sizes) if len(langs) <= 100_000 else sizes, "lang")
    drawn = rated.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate).dropDuplicates(["lang", "text"]).select("text", "lang")
    counts = drawn.mapInArrow(lambda b: _count(b, bits), "lang string, kind int, id int, n long").groupBy("lang", "kind", "id").agg(F.sum("n").alias("n")).toPandas()
    place = counts["lang"].map({x: j for j, x in enumerate(langs)}).to_numpy()
    tables = []
    for kind, height in ((0, 1 << bits), (1, len(SCRIPT_NAMES))):
        x, own = np.zeros((height, len(langs))), (counts["kind"] == kind).to_numpy()
        x[counts["id"].to_numpy()[own], place[own]] = counts["n"].to_numpy()[own]
        tables.append(x)
    tri, scr = tables
    used = max(1, int((tri.sum(1) > 0).sum()))
    scores = np.zeros(((1 << bits) + 1, len(langs)), np.float32)
    scores[:-1] = np.log((tri + smoothing) / (tri.sum(0) + smoothing * used))
    allowed = np.ones((len(SCRIPT_NAMES) + 1, len(langs)), bool)
    allowed[:-1] = scr >= 0.002 * np.maximum(scr.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script no language uses rules none out
    return Model(langs, scores, allowed, penalty, bits)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``und`` and 0 where the text is null or has no letter."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, size=(8 << 20) // max(4, len(m.languages))):
            texts = b.column(1).to_pylist()
            lang, score = m.predict(texts) if m.languages else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    return docs.where(fold(id_col, folds) != 0)


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, text_col, size=(8 << 20) // max(4, len(m.languages))):
            if m.languages:
                lang, score = m.predict(b.column(text_col).to_pylist())
                yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)]))

    return docs.mapInArrow(run, docs.schema)
