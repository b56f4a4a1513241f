"""Mixing to target weights with soft membership.

A classifier trained on a labelled table gives each document the posteriors of the domains. The
rates of the documents, nonnegative, are fitted by projected gradients so that the expected tokens
of the domains meet their targets. One step needs the sums of all domains, a vector as long as there
are domains; a document's rate is a function of its own row and of the steps so far, so no state is
kept for documents, and a lost executor costs nothing but its task.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from .linear import score, train

#: Steps end when every domain's tokens are this close to the target, relatively.
TOLERANCE = 1e-4
MOST_STEPS = 60
#: With a free total, steps end when the shares are this close, or when the largest error fell by less than a
#: tenth in so many steps: then the bounds keep the shares from the targets.
SHARE_TOLERANCE = 1e-3
STALLED = 20

SHAPE = "doc_id bigint, n_tokens bigint, posteriors array<double>"


def posteriors(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens (words) and posteriors: the one-against-rest scores, made to sum to 1."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return scored.select("doc_id", F.col("n_words").alias("n_tokens"), F.transform("scores", lambda x: x / total).alias("posteriors"))


def rates_of(p: np.ndarray, steps: Sequence[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps, from 1: each takes p @ step off and projects to >= least. Also the
    rates ahead of them by momentum, at which the next gradient is taken."""
    r = ahead = np.ones(len(p))
    for k, g in enumerate(steps):
        now = np.maximum(ahead - p @ g, least)
        ahead = now + k / (k + 3) * (now - r)
        r = now
    return r, ahead


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)


def _moments(k: int, steps: list[np.ndarray], least: float, scale: float):
    """Per task: domain sums under the present rates and ahead of them, and the Gram matrix of the incidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ahead, gram = np.zeros(k), np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("n_tokens").to_numpy(zero_copy_only=False) / scale
            p = _matrix(batch.column("posteriors"), k)
            a = p * t[:, None]
            rates = rates_of(p, steps, least)
            sums += rates[0] @ a
            ahead += rates[1] @ a
            gram += p.T @ a
        at = np.arange(2 * k + k * k, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate((sums, ahead, gram.ravel())))], names=["at", "v"])

    return run


def fit_rates(members: DataFrame, targets: Sequence[float], least: float = 0.0, tokens: float | None = None, free: bool = False, most_steps: int = MOST_STEPS) -> tuple[list[np.ndarray], np.ndarray]:
    """Fits rates for ``members`` (doc_id, n_tokens, posteriors) and returns the steps and the domain
    sums reached (tokens).

    ``targets`` are the domains' shares of the tokens, ``tokens`` is the total that they share
    (as many as the members have, if not given); with ``free`` any total will do: what a domain has
    beyond its share of the sums' own total is then the residual. The objective is the squared residual. Gradients are scaled by the documents' tokens,
    so that a rate depends on posteriors and not on length, and taken in the metric of the inverse
    Gram matrix, in which a step of length 1 always descends; momentum speeds them up. Rates start at 1.
    """
    share = np.array(targets, float)
    if (share < 0).any() or share.sum() <= 0:
        raise ValueError("targets must not be negative nor all 0")
    share /= share.sum()
    k = len(share)
    n, total = members.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    if not n or not total:
        return [], np.zeros(k)
    scale = total / n
    want = np.zeros(k) if free else share * (tokens if tokens is not None else total) / scale
    beyond = np.eye(k) - (np.outer(share, np.ones(k)) if free else 0)
    steps: list[np.ndarray] = []
    errors: list[float] = []
    while True:
        rows = members.mapInArrow(_moments(k, steps, least, scale), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        v = np.zeros(2 * k + k * k)
        v[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
        sums, ahead, gram = v[:k], v[k : 2 * k], v[2 * k :].reshape(k, k)
        if free:
            errors.append(np.abs(sums / max(sums.sum(), 1e-300) - share).max())
            done = errors[-1] <= SHARE_TOLERANCE or (len(steps) >= STALLED and min(errors[-STALLED:]) > 0.9 * min(errors[:-STALLED]))
        else:
            done = len(steps) == most_steps or (np.abs(sums - want) <= TOLERANCE * np.maximum(want, want.sum() * 1e-3)).all()
        if done:
            return steps, sums * scale
        curve = beyond @ gram @ beyond.T
        steps.append(beyond.T @ np.linalg.lstsq(curve + np.eye(k) * 1e-9 * max(np.trace(gram), 1e-300), beyond @ ahead - want, rcond=None)[0])


def with_rates(members: DataFrame, steps: list[np.ndarray], domains: int, least: float = 0.0) -> DataFrame:
    """members with their rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates_of(_matrix(batch.column("posteriors"), domains), steps, least)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    return members.mapInArrow(run, SHAPE + ", rate double")


def mix(docs: DataFrame, labels: DataFrame, targets: Sequence[float], least: float = 0.0, grow: bool = False) -> DataFrame:
    """doc_id, n_tokens (words), posteriors and rate of every document.

    ``labels`` (doc_id, label) holds domain numbers from 0; ``targets`` are the shares of the
    domains. The mixture has as many tokens as the documents or, with ``grow``, any number; with ``least``
    1 every document is kept, and the mixture grows from all documents until the shares are met. A rate is the expected
    number of copies. Where the bounds of the rates keep the mixture from its shares by more than 0.01,
    a warning says how far it came.

    Null texts count as empty; a text without words has the rate of its posteriors,
    and changes no sum. Null and
    repeated ids are rows like others. An empty table gives an empty result. Extra columns are not
    read.
    """
    ship_package(docs.sparkSession)
    k = len(targets)
    weights = train(docs, labels, classes=k)
    members = materialize(posteriors(docs, weights), "mixing-members")
    steps, sums = fit_rates(members, targets, least, free=grow)
    share, goal = sums / max(sums.sum(), 1e-300), np.asarray(targets, float) / sum(targets)
    if steps and np.abs(share - goal).max() > 0.01:
        warnings.warn(f"the mixture's shares are {share.round(4).tolist()}, the targets {goal.round(4).tolist()}", stacklevel=2)
    return with_rates(members, steps, k, least)


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole number of copies with the rate as its mean; the same for the same id and rate."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")
