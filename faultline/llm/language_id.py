"""Language identification by error-correcting output codes.

Every language has a codeword; each bit is predicted by a logistic classifier
over hashed byte n-grams.  A text's language is the codeword with the least
weighted logistic loss against the bits' margins, where a bit weighs as much as
its classifier is better than chance.  When the second codeword is close, the
text is flagged as ambiguous.

Training uses a sample of the labelled rows of bounded size (``SAMPLE_ROWS``),
drawn evenly by language through a hash of the id; prediction reads every row
and whole texts, and nothing but the text.

Defined results: null text or no letter gives ``und`` with score 0; a null doc_id
is in no fold but the training rows' (not held out); rows that repeat an id are drawn
by id and text, equal rows are told apart by nothing and get equal results; of
languages at the same loss the first by name wins; with no language to learn everything is ``und``; with one, it is given to all texts that
have letters; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_schema, fold_of
from .hashed_linear import fit_logistic, ngram_counts, normal

DIMS = 4096
#: Documented bound: most rows of the training sample, over all languages.
SAMPLE_ROWS = 4000
AMBIGUOUS = 0.2
#: Documented bound: most labels that are learnt; rarer ones are noise in the label column.
MOST_LANGUAGES = 200
FOLDS, HELD_OUT = 3, 1
DRAWS = 1 << 40
LABEL, SHARE, DRAW = "sample label", "sample share", "sample draw"


def _letters_table() -> np.ndarray:
    """ASCII letters and all bytes of other characters as they are, the rest as a blank."""
    table = np.full(256, 32, dtype=np.uint8)
    for b in [*range(65, 91), *range(97, 123), *range(128, 256)]:
        table[b] = b
    return table


def features(text: str) -> np.ndarray:
    return normal(ngram_counts(b" " + text.lower().encode() + b" ", DIMS, _letters_table()))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of -1 / +1: all splits of the classes for up to six, else random columns far apart."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        columns = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(classes)] for c in range((1 << (classes - 1)) - 1)]
        return np.array(columns).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(classes)))
    for _ in range(50):
        code = rng.choice([-1, 1], size=(classes, bits))
        code = code[:, np.abs(code.sum(0)) < classes]
        apart = min(int((code[i] != code[j]).sum()) for i in range(classes) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


class LanguageModel:
    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        if len(names) < 2:
            return
        targets = (self.code[y] > 0).astype(np.float32)
        share = 1 / np.bincount(y, minlength=len(names))[y]
        self.w, self.b = fit_logistic(x, targets, share, steps=150)
        right = ((x @ self.w + self.b > 0) == (targets > 0)) * share[:, None]
        self.weight = np.maximum(2 * right.sum(0) / share.sum() - 1, 1e-3)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not any(map(str.isalpha, text)) or not self.names:
            return "und", 0.0, False
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        margin = features(text) @ self.w + self.b
        loss = (self.weight * np.log1p(np.exp(-np.clip(self.code * margin, -40, 40)))).sum(1) / self.weight.sum()
        share = np.exp(-(loss - loss.min()) * len(margin) / 2)
        share /= share.sum()
        order = np.argsort(loss, kind="stable")
        return self.names[order[0]], float(share[order[0]]), bool(share[order[0]] - share[order[1]] < AMBIGUOUS)


def train(docs: DataFrame, usable: Column, label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on at most ``sample_rows`` of the rows where ``usable`` holds, as many of each language as there is room for.

    With more than ``MOST_LANGUAGES`` labels the most frequent are learnt.  Rows are drawn by a hash of id and text,
    first by a share of their language, which spares the sort, then by rank, which holds the bound whatever repeats.
    """
    rows = docs.filter(usable & F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col(label).cast("string").alias(LABEL), "text", F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(DRAWS)).alias(DRAW))
    found = rows.groupBy(LABEL).agg(F.count("*").alias("n"), F.min(DRAW).alias("least")).orderBy(F.desc("n"), LABEL).limit(MOST_LANGUAGES).collect()
    counts = {r[LABEL]: (r["n"], r["least"]) for r in found}
    names = sorted(counts)
    if not names:
        return LanguageModel([], np.zeros((0, DIMS), np.float32), np.zeros(0, int))
    each = max(1, sample_rows // len(names))
    # the row with the least draw always comes, so a language of few different rows is not missed
    shares = docs.sparkSession.createDataFrame([(v, max(int(DRAWS * min(1.0, (2 * each + 20) / n)), least + 1)) for v, (n, least) in counts.items()], f"`{LABEL}` string, `{SHARE}` long")
    drawn = rows.join(F.broadcast(shares), LABEL).filter(F.col(DRAW) < F.col(SHARE))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(LABEL).orderBy(DRAW, "text"))).filter(F.col("rank") <= each)
    schema = arrow_schema("label string, x binary")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(t).tobytes() for t in part.column(1).to_pylist()], "binary")], schema=schema)

    found = drawn.select(F.col(LABEL).alias("label"), "text").mapInArrow(run, "label string, x binary").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist()), dtype=np.float32).reshape(-1, DIMS)
    place = {n: i for i, n in enumerate(names)}
    y = np.array([place[v] for v in found["label"].to_pylist()], dtype=int)
    seen = sorted(set(y.tolist()))
    return LanguageModel([names[i] for i in seen], x, np.searchsorted(seen, y))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous."""
    import pyarrow as pa

    ddl = "doc_id long, lang_pred string, score double, ambiguous boolean"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*[model.predict(t) for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast("int64"), *[pa.array(c, f.type) for c, f in zip(found, list(schema)[1:])]], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def language_id(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Learns from the other folds' rows and predicts all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs, F.coalesce(fold_of(F.col("doc_id"), folds) != held_out, F.lit(True)))
    found = identify(docs, model)
    is_held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", is_held.alias("held_out"), "lang_pred", "score", "ambiguous")
