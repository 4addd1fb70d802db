"""An approximate index of vectors: cells around centres, one byte a dimension for what is left, and exact scores in the end.

Centres and scales are fitted on a bounded sample (SAMPLE vectors for each cell, those with
the least hashes of their ids).  Every vector is then coded, and every one can be found.
How many cells a question looks into is fitted too: TRIED vectors of the sample are compared with
all of it, and their nearest have to lie in these cells at a share of AIM.  The sample is thinner than
the rows, so its neighbours are farther and the number is rather too high.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from .retrieval import DIGITS, ranked

#: Vectors of the sample for each cell; cells at most; rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 64, 1024, 10
#: Vectors that probes are fitted with, their nearest that count, and the share of these to be found.
TRIED, NEAREST, AIM = 256, 10, 0.96
#: Codes of a block, and questions that meet a block together, about.
BLOCK, CHUNK = 4096, 512


@dataclass
class Model:
    centres: np.ndarray
    scales: np.ndarray
    probes: int = 1


def _unit(rows) -> np.ndarray:
    v = np.array([np.asarray(r, np.float64) for r in rows])
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector without a null or non-finite number."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~bad)


def fit(rows: DataFrame, cells: int | None = None, seed: int = 1) -> Model:
    """Centres by rounds of k-means on the sphere; as many as the square root of the number of rows (id, v), if not given."""
    n = rows.count()
    cells = cells or min(MOST_CELLS, max(1, int(n**0.5)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * cells).toPandas()
    if not len(sample):
        return Model(np.zeros((1, 1)), np.ones(1))
    v, rng = _unit(sample["v"]), np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        empty = ~np.isin(np.arange(len(centres)), own)
        sums[empty] = centres[empty]
        centres = _unit(sums)
    rest = v - centres[np.argmax(v @ centres.T, axis=1)]
    return Model(centres, np.maximum(np.abs(rest).max(axis=0), 1e-9) / 127, _probes(v, centres))


def _probes(v: np.ndarray, centres: np.ndarray) -> int:
    """The cells to look into so that the nearest of the first vectors lie there at a share of AIM."""
    own = np.argmax(v @ centres.T, axis=1)
    tried = v[:TRIED]
    near = np.argsort(-(tried @ v.T), axis=1, kind="stable")[:, 1 : NEAREST + 1]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return 1 + int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) if len(needed) else 1


def build(rows: DataFrame, model: Model) -> DataFrame:
    """(cell, ids, codes): blocks of the codes of all rows (id, v); a large cell has many blocks."""

    def code(batches):
        for pdf in batches:
            if len(pdf):
                v = _unit(pdf["v"])
                cell = np.argmax(v @ model.centres.T, axis=1)
                codes = np.clip(np.rint((v - model.centres[cell]) / model.scales), -127, 127).astype(np.int8)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": pdf["id"], "code": [c.tobytes() for c in codes]})

    coded = stored(rows.mapInPandas(code, "cell int, id long, code binary"))
    parts = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # one row a cell
    spread = coded.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return stored(spread.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "code")).alias("x")).select("cell", F.col("x.id").alias("ids"), F.col("x.code").alias("codes")))


def search(index: DataFrame, model: Model, rows: DataFrame, questions: DataFrame, k: int = 10, probes: int | None = None, looked_at: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by cosine; questions (query_id, vector) without a usable vector find nothing.

    A question's cells give their best looked_at * k codes; these alone are scored exactly,
    against rows (id, v).
    """
    probes = probes or model.probes
    asked = stored(usable(questions, "query_id", "vector").withColumnRenamed("id", "query_id"))
    centres, scales, most = model.centres, model.scales, looked_at * k

    def probe(batches):
        for pdf in batches:
            if len(pdf):
                v = _unit(pdf["v"])
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"cell": near.ravel().astype(np.int32), "query_id": np.repeat(pdf["query_id"].to_numpy(), near.shape[1]), "v": [x for x in v for _ in range(near.shape[1])]})

    def score(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                codes = np.frombuffer(b"".join(r.codes), np.int8).reshape(len(r.ids), -1)
                vectors = centres[r.cell] + codes * scales
                ids, found = np.asarray(r.ids), np.stack(r.vs) @ vectors.T
                top = np.argsort(-found, axis=1, kind="stable")[:, :most]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(r.queries), top.shape[1]), "id": ids[top.ravel()], "near": np.take_along_axis(found, top, axis=1).ravel()})

    wanted = asked.mapInPandas(probe, "cell int, query_id long, v array<double>")
    wanted = stored(wanted)
    chunks = wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    wanted = wanted.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")))
    wanted = wanted.groupBy("cell", "chunk").agg(F.collect_list(F.struct("query_id", "v")).alias("x")).select("cell", F.col("x.query_id").alias("queries"), F.col("x.v").alias("vs"))
    near = wanted.join(index, "cell").mapInPandas(score, "query_id long, id long, near double")
    near = ranked(near, most, "near").select("query_id", "id")
    exact = near.join(rows, "id").join(asked.withColumnRenamed("v", "q"), "query_id").select("query_id", "id", F.round(T.cosine(F.col("q"), F.col("v")), DIGITS).alias("score"))
    return ranked(exact, k)
