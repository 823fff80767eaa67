"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x) for ordered thresholds: one weight vector over sparse
text features serves all of them, and the expected severity is the sum of P(grade > k).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Most labelled rows that a fit uses, half of them toxic where there are so many. The fit's cost is bounded by it.
SAMPLE = 6000
#: Most features kept, by significance.
FEATURES = 4000
#: A feature is kept when its log odds ratio is so many standard errors from 0.
SIGNIFICANT = 4.0
#: Bytes of the word beginnings that serve as features beside the whole words.
PREFIXES = (4, 5, 6)
#: A feature occurs in so many labelled rows at least.
LEAST_ROWS = 5
#: Penalty of the squared weights against the mean log likelihood.
L2 = 5e-4

_ASCII = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_WORDS = 400_000


def words(text: str | None) -> set[bytes]:
    """Distinct lower-cased words: runs of ASCII letters and non-ASCII characters, as UTF-8."""
    return set((text or "").lower().encode("utf-8").translate(_ASCII).split())


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings (marked by a following ``*``)."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Weights of features, ordered thresholds, and the probability of a grade over 0 at and above
    which a row counts as toxic."""

    weights: dict[bytes, float]
    thresholds: list[float]
    cut: float = 0.5

    def score(self, x: float) -> tuple[float, int, float]:
        """(expected severity, most probable grade, probability of a grade over 0)."""
        over = [1 / (1 + np.exp(np.clip(t - x, -50, 50))) for t in self.thresholds]
        p = -np.diff([1.0, *over, 0.0])
        return float(sum(over)), int(np.argmax(p)), float(over[0]) if over else 0.0


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_cols: int, weight: np.ndarray | None = None, l2: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds for binary features given as (row, column) entries.

    Full-batch Adam on the penalised likelihood; thresholds are a first value and positive
    increments, so they stay ordered."""
    n, k = len(grades), int(grades.max()) if len(grades) else 0
    if k == 0:
        return np.zeros(n_cols), np.zeros(0)
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    p = np.zeros(n_cols + k)
    share = [np.clip(weight[grades > j].sum(), 1e-3, 1 - 1e-3) for j in range(k)]
    start = -np.log(np.array(share) / (1 - np.array(share)))
    p[n_cols] = start[0]
    p[n_cols + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    up, low = np.minimum(grades, k - 1), np.maximum(grades - 1, 0)
    for t in range(1, steps + 1):
        x = np.bincount(rows, p[cols], n)
        steps_up = np.exp(p[n_cols + 1 :])
        theta = p[n_cols] + np.concatenate([[0.0], np.cumsum(steps_up)])
        hi = np.where(grades < k, sig(theta[up] - x), 1.0)
        lo = np.where(grades > 0, sig(theta[low] - x), 0.0)
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / like * weight, lo * (1 - lo) / like * weight
        gx = dhi - dlo  # derivative of the negative log likelihood by x
        gt = np.bincount(low, dlo * (grades > 0), k) - np.bincount(up, dhi * (grades < k), k)
        g = np.empty_like(p)
        g[:n_cols] = np.bincount(cols, gx[rows], n_cols) + l2 * p[:n_cols]
        tail = np.cumsum(gt[::-1])[::-1]
        g[n_cols] = tail[0]
        g[n_cols + 1 :] = tail[1:] * steps_up
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    theta = p[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_cols + 1 :]))])
    return p[:n_cols], theta


def select(found: list[list[bytes]], toxic: np.ndarray, most: int = FEATURES, least: float = SIGNIFICANT) -> dict[bytes, float]:
    """Features and the significance of their log odds ratios between toxic and other rows."""
    a, b = Counter(), Counter()
    for x, t in zip(found, toxic.tolist(), strict=True):
        (a if t else b).update(x)
    na, nb = int(toxic.sum()), int((~toxic).sum())
    z = {}
    for f, n in a.items():
        m = b.get(f, 0)
        if n + m >= LEAST_ROWS:
            parts = (n + 0.5, na - n + 0.5, m + 0.5, nb - m + 0.5)
            s = (np.log(parts[0] / parts[1]) - np.log(parts[2] / parts[3])) / np.sqrt(sum(1 / x for x in parts))
            if abs(s) >= least:
                z[f] = float(s)
    return dict(sorted(z.items(), key=lambda x: (-abs(x[1]), x[0]))[:most])


def fit(texts: list[list[bytes]], grades: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """A model from the distinct words and the grades of labelled rows."""
    found = [sorted({f for w in x for f in features(w)}) for x in texts]
    z = select(found, grades > 0) if len(grades) and 0 < (grades > 0).sum() < len(grades) else {}
    index = {f: i for i, f in enumerate(z)}
    rows, cols = [], []
    for r, x in enumerate(found):
        hit = [index[f] for f in x if f in index]
        rows += [r] * len(hit)
        cols += hit
    w, theta = fit_ordinal(np.array(rows, np.int64), np.array(cols, np.int64), grades, len(index), weight, L2)
    model = Model({f: float(w[i]) for f, i in index.items()}, [float(t) for t in theta])
    x = np.bincount(np.array(rows, np.int64), w[np.array(cols, np.int64)], len(grades)) if rows else np.zeros(len(grades))
    # A row without any feature is never toxic, however little the labelled rows say.
    bare = model.score(0.0)[2]
    model.cut = max(best_cut(np.array([model.score(float(v))[2] for v in x]), grades > 0), bare + (1 - bare) * 1e-3)
    return model


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that best divides the labelled rows (most of the toxic less of the others); the
    penalty keeps probabilities low, so a half would miss rows with a single toxic word."""
    if not 0 < toxic.sum() < len(toxic):
        return 0.5
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(toxic[order]) / toxic.sum() - np.cumsum(~toxic[order]) / (~toxic).sum()
    ends = np.append(np.flatnonzero(np.diff(p[order])), len(p) - 1)
    best = ends[int(np.argmax(gain[ends]))]
    if gain[best] <= 0:
        return 1.0
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float(max(np.sqrt(p[order][best] * below), below + 1e-9))


def severity_grades(texts: list[list[bytes]], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 from labels that say only toxic or not: toxic rows with more significant
    words than the median toxic row, in proportion to their words, are the severe ones."""
    found = [sorted({f for w in x for f in features(w)}) for x in texts]
    grades = toxic.astype(np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return grades
    strong = {f for f, s in select(found, toxic).items() if s > 0}
    rate = np.array([sum(any(f in strong for f in features(w)) for w in x) / max(len(x), 1) for x in texts])
    grades[toxic & (rate > np.median(rate[toxic]))] = 2
    return grades


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their ids; weights restore the
    labels' shares. A label is a grade; where there are only two, severity_grades() makes three.
    Rows without a label are not used; without labelled rows, or with one grade only, no row scores
    above grade 0."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y >= 0")
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    parts = [known.where(c).orderBy(F.xxhash64("i"), "i").limit(sample // 2) for c in ("y > 0", "y = 0")]
    chosen = spark.createDataFrame([r for p in parts for r in p.collect()], "i bigint, y int")

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([b" ".join(sorted(words(t))) for t in b.column(1).to_pylist()], pa.binary())], names=["y", "words"])

    # The chosen rows are bounded by the parameter, so they can be broadcast.
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i").select("y", "t").mapInArrow(run, "y int, words binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["words"])))
    texts, y = [bytes(r["words"]).split() for r in rows], np.array([r["y"] for r in rows], np.int64)
    if len(y) == 0 or y.max() == 0:
        return Model({}, [50.0])
    toxic = y > 0
    weight = np.where(toxic, counts.get(True, 0) / max(toxic.sum(), 1), counts.get(False, 0) / max((~toxic).sum(), 1))
    return fit(texts, severity_grades(texts, toxic) if y.max() == 1 else y, weight)


class Scorer:
    """Scores texts, remembering the features of words (a bounded memo)."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[bytes, tuple[bytes, ...]] = {}

    def of(self, word: bytes) -> tuple[bytes, ...]:
        found = self.memo.get(word)
        if found is None:
            found = tuple(f for f in features(word) if f in self.model.weights)
            if len(self.memo) >= _WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def score(self, text: str | None) -> tuple[float, int, float]:
        seen = {f for w in words(text) for f in self.of(w)}
        return self.model.score(sum(self.model.weights[f] for f in sorted(seen)))


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row: expected severity, most probable
    grade, probability of a grade over 0, and whether that reaches the model's cut.

    Null and empty texts have no features and get the score of the thresholds alone; null and
    repeated ids are carried through; other columns are ignored; an empty table gives an empty
    table."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for b in batches:
            out = [scorer.score(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[2] >= held.value.cut for x in out], pa.bool_())], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose probability of a grade over 0 is below the model's cut."""
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(held.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t)[2] < held.value.cut for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
