"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-cased whole text, everything but
letters being a blank, are hashed to a fixed number of slots.  Document
frequencies cover every document that may be learned from.  The weights are
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded
sample per language, and a temperature is fitted on a part of the sample that
the weights haven't seen.  What reaches the driver is bounded: a number per
slot, and SAMPLE_ROWS documents' features.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced
from .token_counts import LETTER, _classes, char_batches

SLOTS = 1 << 15
#: Bound of the sample that the weights and the temperature are fitted on, all languages together.
SAMPLE_ROWS = 1600
#: Rows that are ranked for each row of the sample.
OVERSHOOT = 8
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 2e-3, 1e-4
UNKNOWN = "und"
BATCH_CHARS = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return _classes() == LETTER


def slots_of(texts: list[str]):
    """Yields for each text the slots of its n-grams that hold a letter, repeats included."""
    joined = "".join(f" {t} " for t in texts).lower()
    if len(joined) != sum(len(t) + 2 for t in texts):  # a character whose lower case is longer
        if len(texts) > 1:
            for t in texts:
                yield from slots_of([t])
            return
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    grams = [(g >> np.uint32(17)).astype(np.int32) for g in (one, two, three)]
    held = [letter, letter[:-1] | letter[1:], letter[:-2] | letter[1:-1] | letter[2:]]
    begin = 0
    for t in texts:
        end = begin + len(t) + 2 if len(texts) > 1 else len(codes)
        yield np.concatenate([g[begin : end - n][h[begin : end - n]] for n, (g, h) in enumerate(zip(grams, held))])
        begin = end


def counts_of(texts: list[str]):
    """Yields (slots, counts) of each text."""
    for run in char_batches(texts, BATCH_CHARS):
        for slots in slots_of(run):
            counts = np.bincount(slots, minlength=SLOTS)
            present = np.flatnonzero(counts)
            yield present, counts[present]


def weighed(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length, with logarithmic term frequency."""
    x = (1 + np.log(counts)) * idf[slots]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def scores(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax(weighed(slots, counts, self.idf) @ self.weights[slots] / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_langs: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by slot and language after follow-the-regularised-leader over the rows of (slots, values)."""
    z, n = np.zeros((SLOTS, n_langs)), np.zeros((SLOTS, n_langs))
    solve = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(epochs):
        for (slots, x), label in zip(rows, labels):
            w = solve(z[slots], n[slots])
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA * w
            n[slots] += g * g
    return solve(z, n)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(logits):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the rows that hold a letter and a language; None if there are none.

    Document frequencies count all of them; the weights are fitted on the same
    number of rows from each language, sample_rows in all and no more however ids
    and rows repeat, picked by a hash of id and text.  Rows without an id aren't picked.
    """
    rows = labelled.filter(has_letter(text_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches):
        seen, total = np.zeros(SLOTS + 1, np.int64), 0
        for pdf in sliced(batches):
            for slots, _ in counts_of(pdf["text"].tolist()):
                seen[slots] += 1
                total += 1
        seen[SLOTS] = total
        held = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": held, "n": seen[held]})

    table = rows.select("text").mapInPandas(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(SLOTS + 1)
    seen[table["slot"].to_numpy()] = table["n"].to_numpy()
    if not seen[SLOTS]:
        return None
    idf = np.log((1 + seen[SLOTS]) / (1 + seen[:SLOTS])) + 1

    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(held)
    wanted = max(1, sample_rows // len(langs))
    # a share of each language by the hash, several times what is wanted, so that no language is ranked whole
    key = F.xxhash64("id", "text")
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, OVERSHOOT * wanted / n))) for lang, n in held.items()])
    keyed = rows.select("id", "lang", key.alias("key")).filter(F.pmod("key", F.lit(1 << 30)) <= share * (1 << 30)).distinct()
    order = Window.partitionBy("lang").orderBy("key", "id")
    picked = keyed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= wanted).select("id", "lang", "key", "n")
    # rows that share all three are copies of one, which stands for them
    met = rows.withColumn("key", key).join(F.broadcast(picked), ["id", "lang", "key"])
    sample = met.groupBy("lang", "n").agg(F.first("text").alias("text"), F.xxhash64(F.first("id")).alias("h"))

    def featured(batches):
        for pdf in batches:
            got = list(counts_of(pdf["text"].tolist()))
            yield pd.DataFrame({"lang": pdf["lang"], "n": pdf["n"], "h": pdf["h"], "slots": [s for s, _ in got], "counts": [c for _, c in got]})

    got = sample.mapInPandas(featured, "lang string, n int, h long, slots array<int>, counts array<int>").toPandas()
    got = got.sort_values(["n", "h", "lang"], kind="stable")
    x = [(np.asarray(s), weighed(np.asarray(s), np.asarray(c), idf)) for s, c in zip(got["slots"], got["counts"])]
    y = np.array([langs.index(lang) for lang in got["lang"]])
    kept = got["n"].to_numpy() % 5 != 0
    if not kept.any() or kept.all():
        kept[:] = True
    weights = ftrl([r for r, k in zip(x, kept) if k], y[kept], len(langs))
    rest = [v @ weights[s] for (s, v), k in zip(x, kept) if not k]
    return Model(langs, idf, weights, calibrated(np.array(rest), y[~kept]) if rest else 1.0)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with a language and a score, all rows kept; columns of the names given for them are replaced.

    The language is `und` with score 0 where the text is null, empty or without a
    letter, and everywhere if no language was learned.  Equal texts get equal
    results; equal scores go to the first language in order.
    """
    docs = docs.drop(lang_out, score_out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{lang_out}` string, `{score_out}` double"
    if model is None:
        return docs.withColumns({lang_out: F.lit(UNKNOWN), score_out: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature))

    def run(batches):
        own = Model(*shared.value)
        letter = _is_letter()
        for pdf in sliced(batches):
            texts = ["" if t is None else t for t in pdf[text_col]]
            langs, scores = [], []
            for t, (slots, counts) in zip(texts, counts_of(texts)):
                if len(slots) and letter[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any():
                    p = own.scores(slots, counts)
                    best = int(p.argmax())
                    langs.append(own.langs[best])
                    scores.append(float(p[best]))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            yield pdf.assign(**{lang_out: langs, score_out: scores})

    return docs.mapInPandas(run, schema)


def remainder(id_col: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def learnable(docs: DataFrame, id_col: str = "doc_id", fold: int = 1) -> DataFrame:
    """The rows that may be learned from: those outside the fold; rows with a null id are in no fold and aren't learned from."""
    return docs.filter(F.coalesce(remainder(id_col) != fold, F.lit(False)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 1) -> DataFrame:
    """docs with held_out, lang_pred and score: fitted on learnable(docs), predicted on all."""
    model = fit(learnable(docs, id_col, fold), id_col, text_col, lang_col)
    return predict(docs, model, text_col).withColumn("held_out", F.coalesce(remainder(id_col) == fold, F.lit(True)))
