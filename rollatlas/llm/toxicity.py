"""Toxicity by weak supervision (operator 9).

Lexicon voters (whole words) and pattern voters (word beginnings of four to six bytes) are found
from labelled rows by how much likelier they are in toxic texts. A generative label model, fitted
by expectation maximisation, estimates how often each voter fires in either class and how far
voters fire together beyond that; correlated voters share one voice. Its posteriors are the
labels on which a logistic classifier over all found terms is trained.

Voters and posteriors are surer than they should be, and a long text meets more terms by chance. So
a model is first learned without a quarter of the rows, on which the classifier's sum and the
logarithm of the text's length are fitted to the labels: 0.5 is where toxic and other texts are as
likely. Then voters, label model and classifier are learned from all rows. With less than
``MIN_TOXIC`` rows of either class in that quarter, scores are left as they are.

Null or empty text has no terms and gets the classifier's bias. At most ``train_rows`` labelled
rows are used, those with the smallest hash of doc_id; a document with several labels counts as
toxic if one says so. Every whole text is scored; a very long one alone, and held whole. Repeated
rows get equal scores. Without labelled rows all scores are 0; an empty table gives an empty
result. A column that bears the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.llm import bytetext
from rollatlas.llm.shared import stage

TRAIN_ROWS = 20_000
#: Terms that the classifier knows, and how many of the best of them vote.
TERMS = 2000
VOTERS = 200
MIN_TOXIC = 4
#: Least log odds, after taking off its standard error one and a half times.
MIN_LOG_ODDS = 1.5
#: Correlation within a class from which two voters count as hearing each other.
CORRELATED = 0.5
#: Weight of the labels against the voters' posterior while fire rates are estimated.
ANCHOR = 1
#: One in so many labelled rows is kept for the calibration.
CALIBRATION = 4
BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    #: Sorted hashes of the terms, their weights, and the bias.
    terms: np.ndarray
    weight: np.ndarray
    bias: float
    #: What the sum of weights, a constant and the length add to a score.
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)
    #: Mean, least and largest logarithm of the number of words where ``scale`` was fitted.
    length: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def logits(self, row: np.ndarray, term: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Scores before the logistic curve, of (row, term) pairs and the rows' numbers of words."""
        own = self.bias + np.bincount(row, self.weight[term], len(words))
        mean, low, high = self.length
        return self.scale[0] * own + self.scale[1] + self.scale[2] * (np.clip(np.log1p(words), low, high) - mean)


def row_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every word and word beginning, with repeats, and the rows' numbers of words."""
    w = bytetext.words(bytetext.LOWER[data], offsets, bytetext.MARKS)
    rows, hashes = [w.row], [w.hash]
    for n in BEGINNINGS:
        long = w.end - w.start > n
        start = w.start[long]
        rows.append(w.row[long])
        hashes.append(bytetext.span_hash(w.sums, start, start + n) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(hashes), np.bincount(w.row, minlength=len(offsets) - 1)


def found_terms(terms: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (row, position in ``terms``) pairs of the texts, and the texts' numbers of words."""
    sieve = np.zeros(1 << 16, bool)
    sieve[(terms >> np.uint64(48)).astype(np.int64)] = True
    row, hashes, words = row_terms(data, offsets)
    maybe = sieve[(hashes >> np.uint64(48)).astype(np.int64)]
    row, hashes = row[maybe], hashes[maybe]
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    right = terms[at] == hashes if len(terms) else np.zeros(0, bool)
    both = np.unique(row[right] * max(1, len(terms)) + at[right])
    return both // max(1, len(terms)), both % max(1, len(terms)), words


def labelled_rows(docs: DataFrame, labels: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``train_rows`` documents that may be learned from."""
    known = labels.filter(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # The chosen rows are bounded, so they are sent to the documents.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def choose_terms(rows: DataFrame, terms: int = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms that speak most for toxic text, best first, and their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for first, end, data, offsets in bytetext.steps(batch.column(0), 8 << 20):
                row, hashes, _ = row_terms(data, offsets)
                order = np.lexsort((row, hashes))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                row, hashes = row[new], hashes[new]
                term, begin = np.unique(hashes, return_index=True)
                own = toxic[first:end][row].astype(np.int64)
                hits = np.add.reduceat(own, begin) if len(begin) else begin
                size = np.diff(begin, append=len(hashes))
                yield pa.RecordBatch.from_pydict({
                    "term": pa.array(term.view(np.int64)), "toxic": pa.array(hits, pa.int64()), "clean": pa.array(size - hits, pa.int64()),
                })

    sizes = rows.agg(F.sum((F.col("toxic") > 0).cast("long")), F.count(F.lit(1))).first()
    n_toxic, n_clean = sizes[0] or 0, sizes[1] - (sizes[0] or 0)
    counts = rows.mapInArrow(count, "term long, toxic long, clean long")
    totals = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (
        totals.filter(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds - 1.5 * error)
        .filter(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(terms).select("term", "odds").toArrow()
    )
    return best.column("term").to_numpy().view(np.uint64), best.column("odds").to_numpy()


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior of class 1 for each row of ``votes`` (rows by voters, 0 or 1).

    Fire rates of each voter in each class are fitted to the votes, anchored by the labels as one
    more source that counts ``ANCHOR`` times as much as all voters together. A voter's voice is
    divided by the correlation it has with others within classes.
    A voter that does not fire abstains; only the silence of all of them is a vote of its own.
    """
    fires = np.column_stack([votes, ~votes.any(axis=1)]).astype(np.float64)
    given = labels.astype(np.float64)
    posterior = given
    for _ in range(rounds):
        posterior = (posterior + ANCHOR * given) / (1 + ANCHOR)
        mass1, mass0 = posterior.sum(), (1 - posterior).sum()
        rate1 = (posterior @ fires + 0.1) / (mass1 + 0.2)
        rate0 = ((1 - posterior) @ fires + 0.1) / (mass0 + 0.2)
        rest = fires - np.outer(posterior, rate1) - np.outer(1 - posterior, rate0)
        cover = rest.T @ rest
        scale = np.sqrt(np.maximum(np.diag(cover), 1e-12))
        together = np.clip(cover / np.outer(scale, scale), 0, 1)
        together[together < CORRELATED] = 0
        voice = 1 / together.sum(axis=1)
        prior = np.clip(mass1 / len(labels), 1e-4, 1 - 1e-4)
        logit = np.log(prior / (1 - prior)) + fires @ (voice * np.log(rate1 / rate0))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def logistic(row: np.ndarray, term: np.ndarray, target: np.ndarray, terms: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for sparse 0/1 features, by gradient steps of each weight's own size."""
    weight, bias = np.zeros(terms), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    step, step_bias = np.full(terms, 1e-6), 1e-6
    for _ in range(rounds):
        logit = bias + np.bincount(row, weight[term], len(target))
        slip = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        slope = np.bincount(term, slip[row], terms) + 0.05 * weight
        step += slope**2
        weight -= 0.5 * slope / np.sqrt(step)
        step_bias += slip.sum() ** 2
        bias -= 0.5 * slip.sum() / np.sqrt(step_bias)
    return weight, bias


def calibrate(model: Model, logit: np.ndarray, words: np.ndarray, labels: np.ndarray, rounds: int = 60) -> None:
    """Set the weights of the logit, 1 and the length that fit the labels best."""
    size = np.log1p(words)
    model.length = float(size.mean()), float(size.min()), float(size.max())
    given = np.column_stack([logit, np.ones(len(logit)), size - size.mean()])
    weight = np.array([1.0, 0.0, 0.0])
    ridge = 1e-2 * np.eye(3)
    for _ in range(rounds):
        shown = 1 / (1 + np.exp(-np.clip(given @ weight, -30, 30)))
        slope = given.T @ (shown - labels) + ridge @ weight
        bend = (given * (shown * (1 - shown))[:, None]).T @ given + ridge
        step = np.linalg.solve(bend, slope)
        # A full step may overshoot far from the best weights.
        weight -= step / max(1.0, np.abs(step).max())
    model.scale = tuple(weight.tolist())


@dataclass
class Seen:
    """Labelled rows as the classifier sees them: label, number of words, and (row, term) pairs."""

    labels: np.ndarray
    words: np.ndarray
    row: np.ndarray
    term: np.ndarray

    def part(self, chosen: np.ndarray) -> Seen:
        place = np.cumsum(chosen) - 1
        inside = chosen[self.row]
        return Seen(self.labels[chosen], self.words[chosen], place[self.row[inside]], self.term[inside])


def seen_rows(rows: DataFrame, terms: np.ndarray) -> tuple[Seen, np.ndarray]:
    """All rows with the terms that they hold, and which of them are kept for the calibration."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            words = np.zeros(batch.num_rows, np.int64)
            for first, end, data, offsets in bytetext.steps(batch.column(0)):
                row, term, words[first:end] = found_terms(terms, data, offsets)
                for r, t in zip(row.tolist(), term.tolist()):
                    found[first + r].append(t)
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column(1).cast(pa.int64()), "kept": batch.column(2),
                "words": pa.array(words), "terms": pa.array(found, pa.list_(pa.int32())),
            })

    table = rows.select("text", "toxic", "kept").mapInArrow(hits, "toxic long, kept boolean, words long, terms array<int>").toArrow()
    lists = table.column("terms").combine_chunks()
    n = table.num_rows
    term = lists.flatten().to_numpy().astype(np.int64) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy()) if n else term
    seen = Seen(table.column("toxic").to_numpy() > 0, table.column("words").to_numpy(), row, term)
    return seen, table.column("kept").to_numpy().astype(bool)


def learned(seen: Seen, ranked: np.ndarray) -> Model:
    """Label model and classifier of rows; ``ranked`` terms, of which the first vote."""
    terms = np.sort(ranked)
    voters = np.searchsorted(terms, ranked[:VOTERS])
    place = np.full(len(terms), -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(seen.labels), len(voters)), bool)
    fired = place[seen.term] >= 0
    votes[seen.row[fired], place[seen.term][fired]] = True
    posterior = label_model(votes, seen.labels) if len(voters) else np.full(len(seen.labels), seen.labels.mean())
    return Model(terms, *logistic(seen.row, seen.term, posterior, len(terms)))


def fit(rows: DataFrame) -> Model:
    """Learn from (text, toxic) rows; their number bounds what comes to the driver."""
    kept = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(CALIBRATION)) == 0
    rows = stage(rows.select("text", "toxic", kept.alias("kept")), "toxic-rows")
    ranked, _ = choose_terms(rows.select("text", "toxic"))
    seen, out = seen_rows(rows, np.sort(ranked))
    if not len(seen.labels):
        return Model(np.sort(ranked), np.zeros(len(ranked)), -np.inf)
    model = learned(seen, ranked)
    if min(seen.labels[out].sum(), (~seen.labels[out]).sum()) >= MIN_TOXIC and not out.all():
        some, _ = choose_terms(rows.filter(~F.col("kept")).select("text", "toxic"))
        seen, out = seen_rows(rows, np.sort(some))
        first, rest = learned(seen.part(~out), some), seen.part(out)
        calibrate(model, first.logits(rest.row, rest.term, rest.words), rest.words, rest.labels)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with score (0 to 1) and predicted (0 or 1)."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        value = np.zeros(len(texts))
        for first, end, data, offsets in bytetext.steps(texts):
            logit = model.logits(*found_terms(model.terms, data, offsets))
            value[first:end] = np.where(np.isfinite(logit), 1 / (1 + np.exp(-np.clip(logit, -500, 500))), 0.0)
        return pa.array(value)

    keep = [c for c in keep if c not in ("score", "predicted")]
    # Told to vary, so that the two columns share one run.
    scored = docs.withColumn("_score", run.asNondeterministic()(F.col(text_col)))
    return scored.select(*keep, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
