"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1 bits. For each bit a binary naive Bayes classifier over
hashed byte n-grams gives a margin; the language whose codeword loses least against the margins
wins, each bit weighted by how well it separates the training rows. Of equal losses the language
that comes first in the order of names wins.

Training uses n-gram counts of a bounded sample of labelled rows: at most about ``sample_rows``
rows (one for each language if there are more languages), dealt evenly over the languages and chosen
by the hash of key and text, so that null and repeated keys don't matter; rows alike in both count
once in it. A language of which the sample has no letter is not learned. The model grows with the
logarithm of the number of languages, its codewords with the number; neither grows with the rows.

Prediction reads whole texts and nothing but texts, in stretches of ``STRETCH`` bytes. A null text
and one without a letter (a character of Unicode's categories L) are ``und``, and so is every text
if nothing was learned. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import documents, prepared
from evenkeel.session import discard, materialize

ORDERS = (2, 3, 4)
BUCKETS = 1 << 14
FEATURES = BUCKETS * len(ORDERS)
STRETCH = 1 << 19
UNDETERMINED = "und"
_word_like = re.compile(r"[^\W\d_]")
_fold = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numerals such as ½ or Ⅷ are none."""
    return any(m[0].isalpha() for m in _word_like.finditer(text))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all two-way splits up to 7 languages, else random rows that differ in many bits."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = range(1, 2 ** (n - 1))
        return np.array([[1 if c == 0 or not s >> (c - 1) & 1 else -1 for s in splits] for c in range(n)], np.int8)
    rng = np.random.default_rng(n)
    bits = 16 * int(np.ceil(np.log2(n)))
    if n > 256:  # by then the least distance hardly differs
        return rng.choice(np.array([-1, 1], np.int8), (n, bits))
    best, most = None, -1
    for _ in range(50):
        rows = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - rows.astype(int) @ rows.T.astype(int)) // 2
        np.fill_diagonal(apart, bits)
        if apart.min() > most:
            best, most = rows, int(apart.min())
    return best


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text's byte n-grams, a stretch at a time; letters are lower-cased, all else counts as one space."""
    folded = text.lower().encode("utf-8", "replace").translate(_fold) + b" "
    held, in_space = np.array([32], np.uint32), True
    for at in range(0, len(folded), STRETCH):
        raw = np.frombuffer(folded, np.uint8, min(STRETCH, len(folded) - at), at)
        space = raw == 32
        again = space & np.concatenate([[in_space], space[:-1]])
        in_space = bool(space[-1])
        new = raw[~again].astype(np.uint32)
        stream, n_held = np.concatenate([held, new]), len(held)
        out = []
        for k, n in enumerate(ORDERS):
            part = stream[max(0, n_held - n + 1) :]
            if len(part) >= n:
                h = np.zeros(len(part) - n + 1, np.uint32)
                for j in range(n):
                    h = (h ^ part[j : len(part) - n + 1 + j]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                out.append((h & np.uint32(BUCKETS - 1)) + np.uint32(k * BUCKETS))
        held = stream[-(max(ORDERS) - 1) :]
        if out:
            yield np.concatenate(out)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the batch's texts; languages are emitted once they are many."""
    total: dict[str, np.ndarray] = {}

    def emitted() -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at])], ["lang", "gram", "n"])
        total.clear()

    for batch in batches:
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            if has_letter(text):
                if len(total) >= 64 and lang not in total:
                    yield from emitted()
                total.setdefault(lang, np.zeros(FEATURES, np.int64))
                for found in grams(text):
                    total[lang] += np.bincount(found, minlength=FEATURES)
    yield from emitted()


class Model:
    """languages, codewords (languages x bits), weight of each bit, log-odds (features x bits)."""

    def __init__(self, languages: list[str], counts: Iterator[np.ndarray]):
        """counts: of each language in turn, its features' counts."""
        self.languages, self.codes = languages, codewords(len(languages))
        bits = self.codes.shape[1] if len(languages) else 0
        high, total = np.zeros((bits, FEATURES)), np.zeros(FEATURES)
        for code, n in zip(self.codes, counts, strict=True):
            share = (n + 0.1) / (n + 0.1).sum()
            high[code > 0] += share
            total += share
        ups = (self.codes > 0).sum(axis=0)
        self.odds = np.zeros((FEATURES, bits), np.float32)
        self.weights = np.ones(bits)
        for b in range(bits):
            if 0 < ups[b] < len(languages):
                pos, neg = high[b] / ups[b], (total - high[b]) / (len(languages) - ups[b])
                self.odds[:, b] = np.log(pos) - np.log(neg)
                self.weights[b] = abs((pos - neg) @ self.odds[:, b])
        if bits:
            self.weights /= max(self.weights.sum(), 1e-9)

    def margins(self, text: str) -> np.ndarray:
        """Mean log-odds of each bit over the text's n-grams, sharpened by the text's length."""
        total, n = np.zeros(self.odds.shape[1]), 0
        for found in grams(text):
            n += len(found)
            if len(found) * 4 < FEATURES:
                total += self.odds[found].sum(axis=0, dtype=np.float64)
            else:
                total += np.bincount(found, minlength=FEATURES).astype(np.float32) @ self.odds
        return total / max(n, 1) * min(n, 200) ** 0.5

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), and whether the two best codewords are about as near."""
        if not self.languages or text is None or not has_letter(text):
            return UNDETERMINED, 0.0, True
        margins = self.margins(text)
        loss = np.logaddexp(0, -self.codes * margins) @ self.weights
        chance = np.exp(-4 * (loss - loss.min()))
        chance /= chance.sum()
        order = np.argsort(loss, kind="stable")
        best = order[0]
        ambiguous = len(order) > 1 and bool(loss[order[1]] - loss[best] < AMBIGUOUS_GAP)
        return self.languages[best], float(chance[best]), ambiguous


#: Least difference between the two smallest losses for a clear decision.
AMBIGUOUS_GAP = 0.02


def train(labelled: DataFrame, key: str, sample_rows: int = 8000) -> Model:
    """Fit on a sample of rows with columns ``key``, text and lang; rows with a null text or lang don't count.

    The sample takes each language's rows whose hash of key and text is below a threshold of that
    language, set so that about sample_rows / languages of them remain.
    """
    prepared(labelled.sparkSession)
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    if not found:
        return Model([], iter(()))
    steps = 1 << 30
    names = [r["lang"] for r in found]
    limits = F.map_from_arrays(F.lit(names), F.lit([min(steps, -(-sample_rows * steps // (len(found) * r["n"]))) for r in found]))
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(key), F.col("text")), F.lit(steps)) < limits[F.col("lang")])
    sample = chosen.select(F.col(key).alias("key"), "lang", "text").distinct().select("lang", "text")
    summed = materialize(sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    languages = [r["lang"] for r in summed.select("lang").distinct().orderBy("lang").collect()]
    ordered = summed.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("counts")).orderBy("lang")  # at most FEATURES in each list

    def counts() -> Iterator[np.ndarray]:
        for r in ordered.toLocalIterator():
            n = np.zeros(FEATURES)
            pairs = np.array(r["counts"], np.int64).reshape(-1, 2)
            n[pairs[:, 0]] = pairs[:, 1]
            yield n

    model = Model(languages, counts())
    discard(summed)
    return model


def with_language(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with lang_pred, score and ambiguous; columns of these names are replaced.

    A null text and one without a letter are ``und`` with score 0 and ambiguous.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.decide(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    judged = df.withColumn("__language", decide(text))
    return judged.withColumns({c: F.col(f"__language.{c}") for c in ("lang_pred", "score", "ambiguous")}).drop("__language")


def held_out(key: Column) -> Column:
    """Rows kept from training: CRC-32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepared(spark), sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), "doc_id")
    judged = with_language(docs.select("doc_id", "text"), "text", model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language can be told; those without a letter, or of no clear language, go."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), "doc_id")
    judged = with_language(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), "text", model)
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select("row.*")
