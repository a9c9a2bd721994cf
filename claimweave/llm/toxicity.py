"""Toxicity by weak supervision.

Voters are lexicon words and word-beginning patterns mined from the labelled rows. A generative label model with a
latent class estimates how accurate each voter is and how strongly voters are correlated within a class; its posterior
labels train the linear classifier that scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

WORD = re.compile(r"[^\W_]+")
# Insults of the built-in lexicon.
LEXICON = "bastard clown coward creep disgusting dumb filth freak fool garbage idiot imbecile jerk loser moron pathetic pig scum stupid trash ugly vermin worthless".split()
#: Lengths of the word beginnings that patterns are made of; whole words count too.
PREFIXES = (3, 4, 5, 6, 8)
#: Bound on the labelled rows that the models are fitted on; a hash of doc_id picks them.
FIT_ROWS = 20_000
#: A feature votes if its log odds are surely above 0.7: standard errors that the estimate is lowered by.
SURE = 3.0


def features(text: str) -> set[str]:
    """Distinct word beginnings (with a trailing *) and words."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


class Voters:
    """Which voters vote on a text."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.words = {v: k for k, v in enumerate(names) if not v.endswith("*")}
        self.starts: dict[int, dict[str, int]] = {}
        for k, v in enumerate(names):
            if v.endswith("*"):
                self.starts.setdefault(len(v) - 1, {})[v[:-1]] = k
        self.lengths = sorted(self.starts.items())
        self.first = {v[:2] for v in names}

    def __call__(self, text: str) -> list[int]:
        found = set()
        for w in set(WORD.findall(text.lower())):
            if w[:2] in self.first:
                if w in self.words:
                    found.add(self.words[w])
                for n, starts in self.lengths:
                    if len(w) > n and w[:n] in starts:
                        found.add(starts[w[:n]])
        return sorted(found)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """doc_id, text, toxic of at most about fit_rows labelled rows that aren't held out."""
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = save(known, "labels")
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return base.join(known, "doc_id")


def mine(rows: DataFrame, least: int = 5, sure: float = SURE) -> list[str]:
    """The lexicon, then the features that the labels support, by the lower end of their log odds."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                counts[1 - toxic.as_py()].update(features(text.as_py()))
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], schema=schema)

    totals = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    p, n = (float(x or 0) for x in totals)
    found = rows.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (p + 1)) - F.log((F.col("n") + 0.5) / (n + 1))
    low = odds - sure * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = found.filter(F.col("p") >= least).withColumn("low", low).filter("low > 0.7").orderBy(F.desc(F.col("low") * F.sqrt("p")), "feature")
    return list(dict.fromkeys(LEXICON + [r["feature"] for r in best.select("feature").collect()]))


class Votes:
    """Who voted on which text, as a sparse 0-1 matrix of texts by voters."""

    def __init__(self, found: list[list[int]], voters: int) -> None:
        self.shape = len(found), voters
        self.text = np.repeat(np.arange(len(found)), [len(f) for f in found])
        self.voter = np.array([k for f in found for k in f], np.int64)

    def of_voters(self, x: np.ndarray) -> np.ndarray:
        """Sums of x over the texts that each voter votes on."""
        return np.bincount(self.voter, x[self.text], self.shape[1])

    def of_texts(self, x: np.ndarray) -> np.ndarray:
        """Sums of x over the voters of each text."""
        return np.bincount(self.text, x[self.voter], self.shape[0])

    def together(self, rows: int = 2_000) -> np.ndarray:
        """How many texts each two voters both vote on."""
        out = np.zeros((self.shape[1], self.shape[1]), np.float32)  # counts of texts, exact below 2**24
        ends = np.searchsorted(self.text, np.arange(0, self.shape[0] + rows, rows))
        for k, (low, high) in enumerate(zip(ends, ends[1:])):
            part = np.zeros((rows, self.shape[1]), np.float32)
            part[self.text[low:high] - k * rows, self.voter[low:high]] = 1
            out += part.T @ part
        return out


class LabelModel:
    """Latent-class model of binary voters, fitted by expectation maximisation.

    Each voter has a vote rate per class, which is its accuracy; the class balance is given. Labels are no voter: they
    tell which class is the toxic one, by the rates that the rounds begin with. Voters that agree beyond what the class
    explains are correlated: the model estimates the correlations of their residuals within the classes in every round,
    and a voter's evidence is divided by one plus the sum of its correlations.
    """

    def __init__(self, rounds: int = 30, correlated: float = 0.5) -> None:
        self.rounds, self.correlated = rounds, correlated

    def fit(self, votes: Votes, labels: np.ndarray) -> np.ndarray:
        """Posterior probabilities of class 1."""
        self.prior = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.weights = np.ones(votes.shape[1])
        together = votes.together()
        q = labels.astype(float)
        for step in range(self.rounds):
            in_class = np.stack([votes.of_voters(1 - q), votes.of_voters(q)])
            self.rates = np.stack([(in_class[0] + 0.1) / ((1 - q).sum() + 1), (in_class[1] + 0.5) / (q.sum() + 1)])
            if step:
                self._correlate(together, in_class, q)
            yes = np.log(self.rates[1] / self.rates[0]) * self.weights
            no = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.weights
            logit = np.log(self.prior / (1 - self.prior)) + votes.of_texts(yes - no) + no.sum()
            before, q = q, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(q - before).max() < 1e-4:
                break
        return q

    def _correlate(self, together: np.ndarray, in_class: np.ndarray, q: np.ndarray) -> None:
        # Products of residuals, votes less what the class explains, multiplied out: no pass over the texts is needed.
        p = np.stack([1 - q, q])
        half = self.rates.T @ (in_class - (p @ p.T) @ self.rates / 2)
        rest = together - half - half.T
        scale = np.sqrt(np.maximum(np.diag(rest), 0)) + 1e-9
        self.correlations = rest / np.outer(scale, scale)
        strong = np.where(self.correlations > self.correlated, self.correlations, 0)
        np.fill_diagonal(strong, 0)
        self.weights = 1 / (1 + strong.sum(1))


def linear(votes: Votes, target: np.ndarray, ridge: float = 0.1, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps that are solved by conjugate gradients."""
    n = votes.shape[1]
    penalty = np.append(np.full(n, ridge), 1e-6)
    w = np.zeros(n + 1)

    def of_texts(x: np.ndarray) -> np.ndarray:
        return votes.of_texts(x[:n]) + x[n]

    def of_voters(x: np.ndarray) -> np.ndarray:
        return np.append(votes.of_voters(x), x.sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(of_texts(w), -30, 30)))
        curve = p * (1 - p)
        step = _solved(lambda x: of_voters(curve * of_texts(x)) + (penalty + 1e-6) * x, of_voters(curve) + penalty + 1e-6, of_voters(target - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def _solved(product: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of product(x) = right, product symmetric and positive definite, to a millionth of right."""
    x, rest = np.zeros(len(right)), right.copy()
    near = rest / diagonal
    way, size = near.copy(), rest @ near
    least = 1e-12 * size
    for _ in range(2 * len(right)):
        if size <= least:
            break
        along = product(way)
        far = size / (way @ along)
        x += far * way
        rest -= far * along
        near = rest / diagonal
        size, before = rest @ near, size
        way = near + size / before * way
    return x


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, least: int = 5) -> tuple[list[str], np.ndarray, float]:
    """Voters, their weights and the bias. The fitted sample is bounded by fit_rows, so it may reach the driver as votes."""
    rows = save(training_rows(docs, labels, id_col, text_col, label_col, fit_rows), "labelled")
    names = mine(rows, least)
    found_by = Voters(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([found_by(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], names=["doc_id", "toxic", "votes"])

    known = sorted(tuple(r) for r in rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, votes array<long>").collect())
    if not any(t for _, t, _ in known):  # nothing to learn from: the lexicon alone
        return names, np.full(len(names), 3.0), -2.0
    votes = Votes([found for _, _, found in known], len(names))
    posterior = LabelModel().fit(votes, np.array([t for _, t, _ in known], float))
    return names, *linear(votes, posterior)


def _probability(names: list[str], weights: np.ndarray, bias: float) -> Callable[[Iterable[str]], np.ndarray]:
    """Scores of texts, by the votes on them."""
    voters = Voters(names)

    def run(texts: Iterable[str]) -> np.ndarray:
        out = np.array([bias + sum(weights[k] for k in voters(t)) for t in texts], float)
        return 1 / (1 + np.exp(-out.clip(-30, 30)))

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, fit_rows: int = FIT_ROWS, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns only from labelled rows whose crc32(doc_id as text) mod 4 is not 2; those are held_out, and so is a null
    doc_id. Inputs of a score are the votes on the whole text alone; null counts as empty, and empty texts get the
    score of no votes. Repeated rows get a row each; of repeated labels the toxic one counts, null labels are left out;
    without any toxic label the lexicon decides. Other columns are ignored; an empty table gives an empty result.
    """
    probability = _probability(*fit(docs, labels, id_col, text_col, label_col, fit_rows, **options))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(t.as_py() for t in batch.column(1)))], schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(True))
    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, fit_rows: int = FIT_ROWS, **options) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns.

    Each row is judged by its own text in one pass that moves nothing, so a null or repeated doc_id makes no difference.
    """
    probability = _probability(*fit(docs, labels, id_col, text_col, label_col, fit_rows, **options))

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        return pa.array(probability(t.as_py() for t in texts))

    return docs.filter(toxic(text_of(text_col)) < threshold)
