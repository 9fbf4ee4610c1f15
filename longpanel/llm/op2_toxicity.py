"""Toxicity by maximum-scoring segment search.

Tokens get log-odds of the toxic against the other class under Dirichlet priors: a token's prior is
the estimate for its prefix (five, then four characters), whose own prior is the pooled corpus, so
an unseen form of a known family still carries its family's evidence.  One linear scan of a
document finds all maximal scoring segments (disjoint, each with no better extension).  Scores are
calibrated by extreme values: with lambda from ``sum p exp(lambda s) = 1`` over clean tokens and K
from the clean documents' best segments, ``E = K n exp(-lambda S)``; significant passages have
``E <= SIGNIFICANT``.  The document's score is a logistic function of the best segment's log E and
of the significant passages' total, fitted on the same training rows.

The classifier is fitted on at most ``SAMPLE`` labelled rows a class, the smallest hashes of
doc_id; the training fold is crc32(doc_id) mod 5 <> 0.  All weights that the sample supports are kept,
so it bounds them too.  Scoring covers every document whole, a very long text in one pass.

Edge cases: null and empty texts have no tokens and get the score of no evidence.  Labels that
contradict each other for an id count as toxic.  Without training rows of both classes every score
is the share of toxic labels (0 without any).  A null doc_id is in no fold: it is neither learnt from nor
held out.  Of segments with equal sums the shortest counts, then the first.  Repeated rows give repeated
results.  score() reads doc_id and text alone; unmarked() carries all other columns along, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, fresh, release, stored

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Words whose weights a worker remembers.
REMEMBERED = 200_000
PRIOR = 4.0
SIGNIFICANT = 1e-3
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def segments(scores: np.ndarray, at: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), by one linear scan.

    at gives the positions of scores when zero or constant stretches between them were summed up.
    """
    found: list[list] = []  # first, end, sum before first, sum at end, nearest earlier one with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]  # all between have no smaller sum either
            if j < 0 or found[j][3] >= new[3]:
                break
            # everything from candidate j on is one better segment
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
        found.append([*new, j])
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


class Weights(dict):
    """The weight of each word asked for, kept for the next time."""

    def __init__(self, weights: dict):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        v = self[word] = _weight(word, self.weights)
        return v


def token_segments(words: list[str], weights: dict, background: float) -> list[tuple[int, int, float]]:
    """Segments in token positions.  Runs of tokens without evidence are summed up before the scan."""
    values = list(map((weights if isinstance(weights, Weights) else Weights(weights)).__getitem__, words))
    hit = [i for i, v in enumerate(values) if v is not None]
    if not hit:
        return []
    scores, where, last = [], [], -1
    for i in hit:
        if i - last > 1:
            scores.append(background * (i - last - 1))
            where.append(-1)
        scores.append(values[i])
        where.append(i)
        last = i
    return [(where[a], where[b - 1] + 1, s) for a, b, s in segments(np.array(scores))]


def _weight(word: str, weights: dict):
    v = weights.get(word)
    if v is None:
        v = weights.get(("5", word[:5]))
        if v is None:
            v = weights.get(("4", word[:4]))
    return v


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of the bounded sample of the training fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc32_of_id(F.col("doc_id")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # 2 * sample rows at most


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: weights, background, lambda, K and the logistic's coefficients."""
    rows = stored(training_rows(docs, labels, sample))  # read several times

    def count(batches):
        for pdf in batches:
            out: dict = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                # once a document: a repeated word proves its document, not its class
                for w in set(tokens(text)):
                    c = out.setdefault(w, [0, 0])
                    c[toxic] += 1
            yield pd.DataFrame({"token": list(out), "clean": [c[0] for c in out.values()], "toxic": [c[1] for c in out.values()]})

    sums = {"clean": F.sum("clean").alias("clean"), "toxic": F.sum("toxic").alias("toxic")}
    # read for totals, prefixes and each kind of weight
    counted = stored(rows.mapInPandas(count, "token string, clean bigint, toxic bigint").groupBy("token").agg(*sums.values()))
    four, five = (counted.groupBy(F.substring("token", 1, k).alias(f"p{k}")).agg(F.sum("clean").alias(f"c{k}"), F.sum("toxic").alias(f"t{k}")) for k in (4, 5))
    total = counted.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    docs_of = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(total[0]), float(total[1])
    model = {"weights": {}, "background": 0.0, "lam": 1.0, "K": 1.0, "coef": None, "share": docs_of.get(1, 0) / max(1, sum(docs_of.values()))}
    if not n0 or not n1:
        release(rows, counted)
        return model
    share1 = n1 / (n0 + n1)

    def odds(c, t, prior):
        """Log-odds of a rate under a Dirichlet prior, the prior share of toxic uses given."""
        return F.log((t + PRIOR * prior) / n1) - F.log((c + PRIOR * (1 - prior)) / n0)

    def rate(c, t, prior):
        return (t + PRIOR * prior) / (c + t + PRIOR)

    both = counted.select("*", F.substring("token", 1, 4).alias("p4"), F.substring("token", 1, 5).alias("p5")).join(four, "p4").join(five, "p5")
    r4 = rate(F.col("c4"), F.col("t4"), F.lit(share1))
    r5 = rate(F.col("c5"), F.col("t5"), r4)
    scored = stored(both.select("token", "p4", "p5", "clean", "toxic", odds(F.col("clean"), F.col("toxic"), r5).alias("w"), odds(F.col("c5"), F.col("t5"), r4).alias("w5"), odds(F.col("c4"), F.col("t4"), F.lit(share1)).alias("w4"), (F.col("c4") + F.col("t4")).alias("n4"), (F.col("c5") + F.col("t5")).alias("n5")))
    strong = lambda w, n: (F.abs(w) > 1.0) & (n >= 3)
    names = (
        scored.select(F.lit("").alias("kind"), F.col("token").alias("key"), F.col("w"), (F.col("clean") + F.col("toxic")).alias("n"))
        .unionByName(scored.select(F.lit("5").alias("kind"), F.col("p5").alias("key"), F.col("w5").alias("w"), F.col("n5").alias("n")).distinct())
        .unionByName(scored.select(F.lit("4").alias("kind"), F.col("p4").alias("key"), F.col("w4").alias("w"), F.col("n4").alias("n")).distinct())
    )
    kept = names.where(strong(F.col("w"), F.col("n")) & ((F.col("kind") == "") | (F.length("key") >= F.col("kind").try_cast("int")))).select("kind", "key", "w").toPandas()  # no more than the sample's tokens
    weights = {(k if not kind else (kind, k)): float(w) for kind, k, w in zip(kept["kind"], kept["key"], kept["w"], strict=True)}
    # tokens without a weight of their own share what is left, as one class
    own = scored.where(strong(F.col("w"), F.col("clean") + F.col("toxic"))).agg(F.sum("clean"), F.sum("toxic")).first()
    rest0, rest1 = n0 - float(own[0] or 0), n1 - float(own[1] or 0)
    background = min(float(np.log((rest1 + 1) / n1) - np.log((rest0 + 1) / n0)), -0.02)
    model |= {"weights": weights, "background": background}

    def features(batches):
        known = Weights(weights)
        for pdf in batches:
            out = [(y, _measure(ws, known, background)[0], len(ws)) for ws, y in zip(map(tokens, pdf["text"]), pdf["toxic"], strict=True)]
            yield pd.DataFrame(out, columns=["y", "best", "n"])

    # extreme values from the clean rows: token score distribution for lambda, best segments for K
    hist = scored.where("clean > 0").select(F.when(strong(F.col("w"), F.col("clean") + F.col("toxic")), F.round("w", 2)).otherwise(F.lit(background)).alias("s"), "clean").groupBy("s").agg(F.sum("clean").alias("c")).toPandas()
    model["lam"] = _lambda(hist["s"].to_numpy(float), hist["c"].to_numpy(float))
    best = rows.where("toxic = 0").mapInPandas(features, "y int, best double, n bigint").agg(F.sum(F.col("n") * F.exp(-model["lam"] * F.col("best"))), F.count("*")).first()
    model["K"] = float(best[1]) / max(float(best[0] or 0), 1e-9)

    def evidence(batches):
        known = model | {"weights": Weights(weights)}
        for pdf in batches:
            out = [(int(y), *_features(tokens(t), known)) for t, y in zip(pdf["text"], pdf["toxic"], strict=True)]
            yield pd.DataFrame(out, columns=["y", "x0", "x1"])

    data = rows.mapInPandas(evidence, "y int, x0 double, x1 double").toPandas()  # 2 * sample rows at most
    release(rows, counted, scored)
    x = np.c_[np.ones(len(data)), data[["x0", "x1"]].to_numpy(float)]
    model["coef"] = logistic(x, data["y"].to_numpy(float))
    return model


def _lambda(s: np.ndarray, c: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection."""
    p = c / c.sum()
    if not (s > 0).any() or float(p @ s) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while float(p @ np.exp(np.minimum(high * s, 500))) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(np.minimum(mid * s, 500))) < 1 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is not penalised."""
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _measure(words: list[str], weights: dict, background: float) -> tuple[float, list]:
    found = token_segments(words, weights, background)
    return max((s for _, _, s in found), default=0.0), found


def _features(words: list[str], model: dict, measured: tuple | None = None) -> tuple[float, float]:
    """Minus the log E of the best segment, and the log of one plus the significant passages' sum, both bounded."""
    best, found = measured or _measure(words, model["weights"], model["background"])
    if best <= 0:
        return 0.0, 0.0
    log_e = np.log(model["K"] * len(words)) - model["lam"] * best
    cut = (np.log(model["K"] * len(words)) - np.log(SIGNIFICANT)) / model["lam"]
    return float(np.clip(-log_e, -20, 40)), float(np.log1p(sum(s for _, _, s in found if s >= cut)))


def passages(words: list[str], model: dict, measured: tuple | None = None) -> list[tuple[int, int, float, float]]:
    """Significant passages: first and end token, score, E."""
    found = (measured or _measure(words, model["weights"], model["background"]))[1]
    with_e = [(a, b, s, float(model["K"] * len(words) * np.exp(-model["lam"] * s))) for a, b, s in found]
    return [x for x in with_e if x[3] <= SIGNIFICANT]


def probability(words: list[str], model: dict, measured: tuple | None = None) -> float:
    if model["coef"] is None:
        return float(model["share"])
    z = float(np.dot(model["coef"], (1.0, *_features(words, model, measured))))
    return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def _scored(docs: DataFrame, model: dict, text: str, name: str) -> DataFrame:
    """docs with a struct of score (double) and passages (array of first, end, score, e)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    known: dict = {}  # a task's own, filled there

    @F.pandas_udf("struct<score:double,passages:array<struct<first:int,end:int,score:double,e:double>>>")
    def run(column: pd.Series) -> pd.DataFrame:
        if not known:
            known.update(shared.value | {"weights": Weights(shared.value["weights"])})
        out = []
        for t in column:
            words = tokens(t)
            measured = _measure(words, known["weights"], known["background"])
            out.append((probability(words, known, measured), [dict(zip(("first", "end", "score", "e"), p, strict=True)) for p in passages(words, known, measured)]))
        return pd.DataFrame(out, columns=["score", "passages"])

    return docs.withColumn(name, run(F.col(text)))


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """doc_id, score and passages of each row of docs."""
    return _scored(docs.select("doc_id", text), model, text, "_tox").select("doc_id", "_tox.score", "_tox.passages")


def unmarked(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under 0.5."""
    name = fresh(docs, "_tox")
    return _scored(docs, model, text, name).where(F.col(name)["score"] < 0.5).select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
