"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Their accuracies
are not known; expectation-maximisation estimates them, and the share of good
documents, from how often each pattern of votes occurs over all documents (the
patterns, not the documents, come to the driver: at most 3 to the number of
labellers).  The posterior of a document's pattern is its soft label, and a
logistic scorer over hashed byte n-grams and the votes' own measures is fitted to
these labels.  The scorer rates every whole text.

The scorer is fitted on a sample of bounded size (``SAMPLE_ROWS``), drawn evenly
from both verdicts by a hash of id and text and cut to the bound by rank; votes, pattern
counts and scores cover all rows.

Defined results: a null text counts as empty; an empty or blank text is rejected
with score 0; a null doc_id stays null and is drawn like any other; repeated rows get
equal results; a score equal to the limit is kept; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_schema, give_back, materialize
from .hashed_linear import fit_logistic, ngram_counts, normal, sigmoid

DIMS = 2048
#: Documented bound: most rows of the scorer's training sample.
SAMPLE_ROWS = 6000
KEEP_SCORE = 0.5
GOOD, BAD, NONE = 2, 1, 0
SYMBOLS = b"#*$%&|<>"
DRAWS = 1 << 40
LABEL, SIDE, SHARE = "sample label", "sample side", "sample share"
_LINE = re.compile(rb"[^\n]*[^\x20\x09-\x0D\n][^\n]*")
_STOP = re.compile(rb"[.?!]['\")]*$")


def measure(data: bytes) -> dict[str, float]:
    """What the labellers look at, over the whole text."""
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    lines = _LINE.findall(data)
    n = max(1, len(words))
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    visible = max(1, int(seen[33:].sum()))
    return {
        "words": len(words),
        "symbols": int(seen[list(SYMBOLS)].sum()) / n,
        "bars": int(seen[124]) / n,
        "shouts": data.count(b"!!") / n,
        "capitals": upper / max(1, upper + lower) if upper + lower >= 20 else 0.1,
        "digits": int(seen[48:58].sum()) / visible,
        "length": visible / n,
        "unique": len(set(words)) / n,
        "runs": sum(map(eq, words, words[1:])) / n,
        "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "stops": int(seen[46] + seen[63]) / n,
    }


def _vote(value: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Labellers: name and the vote from the measures; they overlap, and any may abstain.
LABELLERS = (
    ("symbols", lambda m: _vote(0, m["symbols"] > 0.3, m["symbols"] < 0.02)),
    ("bars", lambda m: _vote(0, m["bars"] > 0.25, False)),
    ("shouts", lambda m: _vote(0, m["shouts"] > 0.15, False)),
    ("capitals", lambda m: _vote(0, m["capitals"] > 0.4, m["capitals"] < 0.15)),
    ("digits", lambda m: _vote(0, m["digits"] > 0.4, m["digits"] < 0.1)),
    ("length", lambda m: _vote(0, m["words"] > 0 and not 2 <= m["length"] <= 20, 3 <= m["length"] <= 12)),
    ("unique", lambda m: _vote(0, m["words"] >= 100 and m["unique"] < 0.1, m["words"] >= 50 and m["unique"] > 0.25)),
    ("runs", lambda m: _vote(0, m["words"] >= 5 and m["runs"] > 0.2, m["words"] >= 5 and m["runs"] < 0.05)),
    ("dup_lines", lambda m: _vote(0, m["dup_lines"] > 0.5, m["dup_lines"] < 0.1)),
    ("stops", lambda m: _vote(0, m["words"] >= 30 and m["stops"] < 0.005, m["stops"] > 0.01 and m["symbols"] < 0.3)),
    ("empty", lambda m: _vote(0, m["words"] == 0, False)),
)


def pattern(data: bytes, measured: dict[str, float] | None = None) -> int:
    """The votes as one base-3 number."""
    measured, code = measure(data) if measured is None else measured, 0
    for _, vote in LABELLERS:
        code = code * 3 + vote(measured)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Votes by labeller (0 none, 1 bad, 2 good)."""
    n = len(LABELLERS)
    return (codes[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3


class LabelModel:
    """Votes independent given the class; fitted by expectation-maximisation on pattern counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 100):
        votes, weight = votes_of(codes), counts.astype(float)
        # start: each labeller sees few kinds of bad text, so one vote for bad outweighs the rest
        good = np.where((votes == BAD).any(axis=1), 0.1, 0.95)
        for _ in range(rounds):
            self.prior = float(np.clip((weight * good).sum() / max(weight.sum(), 1e-9), 0.02, 0.98))
            share = np.stack([weight * good, weight * (1 - good)])
            table = np.stack([share @ (votes == v) for v in range(3)], axis=2)  # class, labeller, vote
            self.chance = (table + 0.5) / (table.sum(2, keepdims=True) + 1.5)
            # a labeller's vote may never speak against what it says
            odds = np.log(self.chance[0]) - np.log(self.chance[1])
            odds[:, GOOD], odds[:, BAD] = np.maximum(odds[:, GOOD], 0), np.minimum(odds[:, BAD], 0)
            self.odds = np.clip(odds, -8, 8)
            good = self.posterior(codes)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        votes = votes_of(codes)
        gain = self.odds[np.arange(votes.shape[1])[None, :], votes].sum(1)
        # abstentions alone, with no vote for bad, never make a document worse than the average one
        gain = np.where((votes == BAD).any(axis=1), gain, np.maximum(gain, 0))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + gain)


def features(data: bytes, m: dict[str, float] | None = None) -> np.ndarray:
    """Hashed n-grams, then the measures, each squeezed to 0..1."""
    m = measure(data) if m is None else m
    own = np.array([min(m[k] / top, 1.0) for k, top in (("symbols", 1), ("bars", 1), ("shouts", 1), ("capitals", 1), ("digits", 1), ("length", 20), ("unique", 1), ("runs", 1), ("dup_lines", 1), ("stops", 0.2))] + [m["words"] == 0], dtype=np.float32)
    return np.concatenate([normal(ngram_counts(data, DIMS)), own])


def _draw():
    """The number that a row is drawn by: a hash of id and text."""
    return F.xxhash64("doc_id", "text", F.lit("sample"))


def vote_patterns(docs: DataFrame) -> DataFrame:
    """doc_id, draw, pattern."""
    import pyarrow as pa

    ddl = "doc_id long, draw long, pattern long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast("int64"), part.column(1), pa.array([pattern(t or b"") for t in part.column(2).to_pylist()], "int64")], schema=schema)
        give_back()

    return docs.select("doc_id", _draw(), F.col("text").cast("binary")).mapInArrow(run, ddl)


class Scorer:
    """Linear scorer with the label model behind it."""

    def __init__(self, labels: LabelModel, weight: np.ndarray | None, bias: np.ndarray | None):
        self.labels, self.weight, self.bias = labels, weight, bias

    def score(self, data: bytes) -> tuple[float, float]:
        """(score, posterior of the votes)."""
        m = measure(data)
        label = float(self.labels.posterior(np.array([pattern(data, m)]))[0])
        if not m["words"]:
            return 0.0, label
        return (label if self.weight is None else float(sigmoid(features(data, m) @ self.weight[:, 0] + self.bias[0]))), label


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    voted = materialize(vote_patterns(docs), "votes")
    place = F.pmod(F.col("draw"), F.lit(DRAWS))
    found = voted.groupBy("pattern").agg(F.count("*").alias("count"), F.min(place).alias("least")).orderBy("pattern").collect()  # one row a pattern
    codes = np.array([r["pattern"] for r in found], dtype=np.int64)
    counts = np.array([r["count"] for r in found], dtype=np.int64)
    if not len(codes):
        return Scorer(LabelModel(np.zeros(1, dtype=np.int64), np.ones(1)), None, None)
    labels = LabelModel(codes, counts)
    good = labels.posterior(codes)
    # the same number from either side; a side that is absent leaves the votes to decide
    sides = [counts[good >= 0.5].sum(), counts[good < 0.5].sum()]
    if min(sides) == 0:
        return Scorer(labels, None, None)
    # as many of either side; a share of each by a hash of id and text, then by rank, so the bound holds whatever repeats
    each = max(1, sample_rows // 2)
    # the row with the least draw always comes, so a side of few different rows is not missed
    least = [min(r["least"] for r, g in zip(found, good) if (g >= 0.5) == side) for side in (True, False)]
    limit = [max(int(DRAWS * min(1.0, (2 * each + 20) / n)), first + 1) for n, first in zip(sides, least)]
    shares = docs.sparkSession.createDataFrame([(int(c), float(g), bool(g >= 0.5), limit[0 if g >= 0.5 else 1]) for c, g in zip(codes, good)], f"pattern long, `{LABEL}` double, `{SIDE}` boolean, `{SHARE}` long")
    small = voted.join(F.broadcast(shares), "pattern").filter(place < F.col(SHARE))
    small = small.withColumn("rank", F.row_number().over(Window.partitionBy(SIDE).orderBy("draw", "doc_id"))).filter(F.col("rank") <= each)
    small = materialize(small.select("draw", F.col(LABEL).alias(LABEL)), "votes-sample")
    picked = small.groupBy("draw").agg(F.count("*").alias("times"), F.max(LABEL).alias(LABEL))
    ddl = "draw long, label double, times long, x binary"
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([features(t or b"").tobytes() for t in part.column(3).to_pylist()], "binary")], schema=schema)

    # equal rows share a draw: one of them comes, weighing as many as were picked
    texts = docs.select(_draw().alias("draw"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "draw")
    texts = texts.groupBy("draw", LABEL, "times").agg(F.first("text").alias("text"))
    sample = texts.select("draw", LABEL, "times", "text").mapInArrow(run, ddl).toArrow().sort_by([("label", "ascending"), ("draw", "ascending")])  # the same sums whatever order rows came in
    y, times = sample["label"].to_numpy(), sample["times"].to_numpy().astype(float)
    if len(y) == 0 or min((y >= 0.5).sum(), (y < 0.5).sum()) == 0:
        return Scorer(labels, None, None)
    x = np.empty((len(y), DIMS + len(LABELLERS)), dtype=np.float32)
    at = 0
    for chunk in sample["x"].chunks:  # straight from Arrow's buffers: the driver holds the sample twice at most
        for row in chunk:
            x[at] = np.frombuffer(row.as_buffer(), dtype=np.float32)
            at += 1
    del sample, chunk, row
    share = times * np.where(y >= 0.5, 1 / times[y >= 0.5].sum(), 1 / times[y < 0.5].sum())
    scorer = Scorer(labels, *fit_logistic(x, y[:, None].astype(np.float32), share))
    del x
    give_back()
    return scorer


def score_quality(docs: DataFrame, scorer: Scorer, keep_score: float = KEEP_SCORE) -> DataFrame:
    """doc_id, score, label_posterior, kept."""
    import pyarrow as pa

    ddl = "doc_id long, score double, label_posterior double, kept boolean"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [scorer.score(t or b"") for t in part.column(1).to_pylist()]
                score = [s for s, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0).cast("int64"), pa.array(score, "float64"), pa.array([p for _, p in found], "float64"), pa.array([s >= keep_score for s in score])], schema=schema)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, ddl)


def classify_quality(docs: DataFrame) -> DataFrame:
    """Fits the label model and the scorer on ``docs`` and rates all of them."""
    return score_quality(docs, train(docs))


def drop_low_quality(docs: DataFrame, keep_score: float = KEEP_SCORE) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, all their columns; rated in place, with no join."""
    scorer, place = train(docs), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep = [scorer.score((t or "").encode())[0] >= keep_score for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(keep, "bool"))
        give_back()

    return docs.mapInArrow(run, docs.schema)
