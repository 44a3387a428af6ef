"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each has a logistic
regression over hashed words and word beginnings, and from the second on also
over the probabilities of the categories before it. While the chain is fitted,
these come from models that have not seen the row: the rows are dealt into
folds by their key, and each fold is predicted by a model of the others. Later
models so learn from probabilities as good as those they get in use.

The models are fitted in one task on a bounded sample of the labelled rows of
``docs``, each with all its features: rows of ``docs`` whose hashed number falls
below a share of the range, drawn before the labels are joined, so that neither ``max_rows`` rows nor ``MAX_FEATURES``
features in all are exceeded in expectation. Scoring covers all rows, and all
their words.

Nulls and corner cases: a null text has no words and is scored by the
intercepts; labelled rows with a null category or without a document are left
out of the fit; repeated labelled rows count as often as they appear. A
category of which the sample holds one value only, or none, gets a probability
near that value, or 0.5. Rows that repeat are scored alike. Columns other than
those named are passed through, those of the scores are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.llm.common import compared_words
from shelltrace.session import broadcast_if_bounded, write_through

MAX_ROWS = 20_000
MAX_FEATURES = 10_000_000
FOLDS = 3
FEATURES = 1 << 17
PREFIX = 4
THRESHOLD = 0.5
_STEPS = 300
_STEP = 0.5
_PENALTY = 1e-4
_SIGNIFICANT = 5.5


def features(text: Column, prefix: int = PREFIX, count: int = FEATURES) -> Column:
    """Numbers of the distinct words and of the beginnings of longer ones."""
    words = F.array_distinct(compared_words(text))

    def number(token: Column, kind: int) -> Column:
        return F.pmod(F.xxhash64(token, F.lit(kind)), F.lit(count)).cast("int")

    whole = F.transform(words, lambda w: number(w, 0))
    starts = F.transform(
        F.filter(words, lambda w: F.length(w) > prefix),
        lambda w: number(F.substring(w, 1, prefix), 1),
    )
    return F.array_distinct(F.concat(whole, starts))


@dataclass(frozen=True)
class Rows:
    """Sparse rows: the features of all of them, and how many each has."""

    flat: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(lists) -> Rows:
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.concatenate(list(lists)) if len(lists) else np.zeros(0)
        return Rows(flat.astype(np.int64), sizes)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the features' weights."""
        return np.bincount(self.owner, weights[self.flat], len(self.sizes))

    def only(self, rows: np.ndarray) -> Rows:
        return Rows(self.flat[rows[self.owner]], self.sizes[rows])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(
    rows: Rows, before: np.ndarray, y: np.ndarray, count: int = FEATURES
) -> np.ndarray:
    """Weights of the features, of the earlier probabilities, and a constant.

    Features whose share among positive rows does not differ from that among
    negative ones by ``_SIGNIFICANT`` standard deviations stay out, so that a
    few rows do not teach chance. Gradient descent, with a step of its own for
    each weight, fits the others.
    """
    n, extra = len(y), before.shape[1]
    weights = np.zeros(count + extra + 1)
    if not n:
        return weights
    good = y > 0
    share = np.clip(good.mean(), 0.5 / n, 1 - 0.5 / n)
    weights[-1] = np.log(share / (1 - share))
    if good.all() or not good.any():
        return weights
    owner = rows.owner
    positive = np.bincount(rows.flat, good[owner], count)
    both = np.bincount(rows.flat, minlength=count).astype(np.float64)
    p, m = share * n, (1 - share) * n
    spread = np.sqrt(np.maximum(both / n * (1 - both / n), 1e-9) * (1 / p + 1 / m))
    telling = np.abs(positive / p - (both - positive) / m) >= _SIGNIFICANT * spread
    chosen = np.flatnonzero(telling)
    place = np.full(count, -1)
    place[chosen] = np.arange(len(chosen))
    held = place[rows.flat] >= 0
    owner, column = owner[held], place[rows.flat[held]]
    inner = np.zeros(len(chosen) + extra + 1)
    inner[-1] = weights[-1]
    squares = np.full_like(inner, 1e-12)
    k = len(chosen)
    for _ in range(_STEPS):
        z = np.bincount(owner, inner[column], n) + before @ inner[k:-1] + inner[-1]
        error = (_sigmoid(z) - y) / n
        gradient = np.concatenate(
            [np.bincount(column, error[owner], k), before.T @ error, [error.sum()]]
        )
        gradient[:-1] += _PENALTY * inner[:-1]
        squares += gradient**2
        inner -= _STEP * gradient / np.sqrt(squares)
    weights[chosen] = inner[:k]
    weights[count:] = inner[k:]
    return weights


def predict(rows: Rows, before: np.ndarray, weights: np.ndarray) -> np.ndarray:
    count = len(weights) - before.shape[1] - 1
    return _sigmoid(rows.sums(weights[:count]) + before @ weights[count:-1] + weights[-1])


def fit_models(
    rows: Rows, labels: np.ndarray, fold: np.ndarray, count: int = FEATURES
) -> list[np.ndarray]:
    """A model per column of ``labels``, later ones over out-of-fold predictions."""
    before = np.zeros((len(labels), 0))
    models = []
    for k in range(labels.shape[1]):
        models.append(fit_linear(rows, before, labels[:, k], count))
        held_out = np.zeros(len(labels))
        for f in np.unique(fold) if k + 1 < labels.shape[1] else []:
            inside = fold == f
            other = fit_linear(
                rows.only(~inside), before[~inside], labels[~inside, k], count
            )
            held_out[inside] = predict(rows.only(inside), before[inside], other)
        before = np.column_stack([before, held_out])
    return models


@dataclass(frozen=True)
class Chain:
    """Fitted models of ``categories``, in order."""

    categories: tuple[str, ...]
    models: tuple[np.ndarray, ...]

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with the probability of each category as ``p_<category>``."""
        names = [f"p_{c}" for c in self.categories]
        shared = docs.sparkSession.sparkContext.broadcast(self.models)

        @F.pandas_udf("array<double>")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for lists in batches:
                rows = Rows.of(lists.tolist())
                before = np.zeros((len(lists), 0))
                for model in shared.value:
                    before = np.column_stack([before, predict(rows, before, model)])
                yield pd.Series(list(before))

        kept = [c for c in docs.columns if c not in names]
        scored = docs.select(*kept, scores(features(F.col(text_col))).alias("_p"))
        return scored.select(
            *kept, *[F.get("_p", F.lit(k)).alias(n) for k, n in enumerate(names)]
        )


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    folds: int = FOLDS,
) -> Chain:
    """Fit on the labelled rows of ``docs``.

    ``categories`` are boolean columns of ``labels``, in the order of the
    chain, which ``id_col`` ties to ``docs``.
    """
    names = list(categories)
    known = labels.select(
        labels[id_col].alias("_id"),
        *[c.cast("double").alias(n) for n, c in categories.items()],
    ).dropna()
    known = broadcast_if_bounded(known)
    # Rows are counted by their ids, so that texts move for the sample alone.
    rows = docs.select(docs[id_col].alias("_id")).join(known, "_id").count()
    share = min(1.0, max_rows / max(rows, 1))
    # Ids repeat, so the sample is of the documents' rows.
    level = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    labelled = write_through(
        docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
        .where(level < int((1 << 20) * share))
        .join(known, "_id")
        .select(
            features(F.col("_text")).alias("features"),
            F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(folds)).alias("fold"),
            F.array(*names).alias("labels"),
        ),
        "labelled",
    )
    total = labelled.agg(F.sum(F.size("features").cast("long"))).first()[0] or 0
    fewer = min(1.0, MAX_FEATURES / max(total, 1))
    sample = labelled.where(level < int((1 << 20) * fewer)).select(
        "features", "fold", "labels", F.lit("sample").alias("task")
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        models = fit_models(
            Rows.of(rows["features"].tolist()),
            np.array(rows["labels"].tolist()),
            rows["fold"].to_numpy(),
        )
        return pd.DataFrame(
            {"k": range(len(models)), "weights": [m.tobytes() for m in models]}
        )

    fitted = sample.groupBy("task").applyInPandas(fit, "k int, weights binary")
    found = {r.k: np.frombuffer(r.weights) for r in fitted.collect()}
    return Chain(
        tuple(names),
        tuple(found.get(k, np.zeros(FEATURES + k + 1)) for k in range(len(names))),
    )


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``p_junk``, ``p_toxic`` and ``toxic``.

    ``labels`` has ``quality`` and ``toxic``, 0 or 1; junk is what has no
    quality.
    """
    categories = {"junk": labels["quality"] == 0, "toxic": labels["toxic"] == 1}
    chain = fit_chain(docs, labels, categories, id_col, text_col)
    scored = chain.score(docs.drop("toxic"), text_col)
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
