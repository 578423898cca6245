"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Small trees are grown on the statistics of a bounded sample of labelled rows, every path from a root to a node becomes a
conjunctive rule, lasso logistic regression weighs the rules and leaves most at zero, and those that remain are compiled
into one Spark column expression. Only the statistics need Python; scoring is an expression of them.

Defined results: a null text counts as empty; an empty text gets the score that its (zero) statistics give. Without usable
labels every score is 0.5; with labels of one kind only, the score is a constant near that kind. Null or contradictory
labels: nulls are left out, and a document's labels are averaged (0.5 and more counts as 1). Labels without a document
and repeated documents change nothing in how a row is scored. Columns called like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepipe.llm.common import free, payloads

#: Statistics of a text, all numbers that need only the text itself.
STATISTICS = (
    "log_words",
    "mean_word",
    "distinct_words",
    "top_word",
    "upper",
    "digit",
    "symbol",
    "pipe",
    "bang",
    "stop",
    "foreign",
    "blank",
    "words_per_line",
    "repeated_lines",
    "longest_word",
    "symbol_words",
)

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#$%&*+/<=>@\\^_`{|}~"
_STOP = b".,;:?"
_ASCII = bytes(range(128))
_KEEP_SYMBOL = bytes(set(range(256)) - set(_SYMBOL))


def statistics(text: bytes | None) -> tuple[float, ...]:
    """One number for each of STATISTICS."""
    if not text:
        return (0.0,) * len(STATISTICS)
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * 11 + (1.0,) + (0.0,) * (len(STATISTICS) - 12)
    left = lambda chars: size - len(text.translate(None, chars))
    solid = sum(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    # words that end in a symbol, seen as a symbol before white space or the end
    ends = b" ".join(words) + b" "
    symbol_words = sum(ends.count(bytes((c, 32))) for c in _SYMBOL) if left(_SYMBOL) else 0
    return (
        float(np.log1p(n)),
        solid / n,
        len(counts) / n,
        max(counts.values()) / n,
        left(_UPPER) / solid,
        left(_DIGIT) / solid,
        left(_SYMBOL) / solid,
        text.count(b"|") / n,
        text.count(b"!") / n,
        left(_STOP) / n,
        (size - left(_ASCII)) / solid,
        (size - solid) / size,
        n / len(lines),
        1.0 - len(set(lines)) / len(lines),
        float(np.log1p(max(map(len, words)))),
        symbol_words / n,
    )


_STRUCT = T.StructType([T.StructField(s, T.DoubleType(), False) for s in STATISTICS])


@F.arrow_udf(_STRUCT)
def _statistics(text: pa.Array) -> pa.Array:
    rows = np.array([statistics(b) for b in payloads(text)], dtype=np.float64).reshape(-1, len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], names=list(STATISTICS))


# ---- trees

#: Rows that a node has at least.
LEAST = 2


def _grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, features: np.ndarray, n_bins: int, depth: int, path: tuple, found: set, least: int) -> None:
    """Adds the path of every node below the root to ``found``. A condition is (feature, bin, True for at most)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return
    best = None
    total, ones = weight.sum(), (weight * y).sum()
    for f in features:
        w = np.bincount(bins[:, f], weights=weight, minlength=n_bins).cumsum()
        p = np.bincount(bins[:, f], weights=weight * y, minlength=n_bins).cumsum()
        rows = np.bincount(bins[:, f], minlength=n_bins).cumsum()
        rest, rest_p = total - w, ones - p
        with np.errstate(divide="ignore", invalid="ignore"):
            gini = p * (1 - p / w) + rest_p * (1 - rest_p / rest)
        gini[(rows < least) | (len(y) - rows < least) | ~np.isfinite(gini)] = np.inf
        at = int(gini.argmin())
        if np.isfinite(gini[at]) and (best is None or gini[at] < best[0] - 1e-12):
            best = (gini[at], int(f), at)
    if best is None or best[0] > ones * (1 - ones / total) - 1e-9:
        return
    _, f, at = best
    low = bins[:, f] <= at
    for side, rows in ((True, low), (False, ~low)):
        new = (*path, (f, at, side))
        found.add(_merged(new))
        _grow(bins[rows], y[rows], weight[rows], features, n_bins, depth - 1, new, found, least)


def _merged(path: tuple) -> tuple:
    """The same conjunction with one bound a feature and side, in one order."""
    kept: dict = {}
    for f, at, side in path:
        old = kept.get((f, side))
        kept[(f, side)] = at if old is None else min(old, at) if side else max(old, at)
    return tuple(sorted((f, at, side) for (f, side), at in kept.items()))


# ---- lasso


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _lasso(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, penalty: float, start=None, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of rows that ``weigh`` (0 or 1) with an L1 penalty on all but the intercept, by accelerated proximal
    gradient steps from ``start`` on."""
    n, k = weigh.sum(), x.shape[1]
    beta = np.zeros(k + 1, dtype=np.float32)
    if start is None:
        share = np.clip((y * weigh).sum() / n, 1e-3, 1 - 1e-3)
        beta[0] = np.log(share / (1 - share))
    else:
        beta[1:], beta[0] = start
    momentum, t = beta.copy(), 1.0
    v = np.ones(k + 1, dtype=np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        u = (v[0] + x @ v[1:]) * weigh
        v = np.concatenate([[u.sum()], u @ x])
        length = np.linalg.norm(v)
        v /= length
    step = np.float32(3.6 * n / length)
    for _ in range(steps):
        r = (_sigmoid(momentum[0] + x @ momentum[1:]) - y) * weigh
        new = momentum - step * np.concatenate([[r.sum()], r @ x]) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((momentum - new) @ (new - beta)) > 0:  # past the lowest point: without momentum from here
            t, nxt = 1.0, 1.0
        momentum = (new + np.float32((t - 1) / nxt) * (new - beta)).astype(np.float32)
        moved = np.abs(new - beta).max()
        beta, t = new.astype(np.float32), nxt
        if moved < 1e-4:
            break
    return beta[1:].astype(np.float64), float(beta[0])


def _losses(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


@dataclass(frozen=True)
class Rule:
    """``weight`` is added where every (statistic, bound, True for at most) holds."""

    conditions: tuple[tuple[str, float, bool], ...]
    weight: float

    def sql(self, prefix: str) -> str:
        return " AND ".join(f"{prefix}.{f} {'<=' if low else '>'} {bound!r}D" for f, bound, low in self.conditions)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def column(self, prefix: str) -> Column:
        """The score, over a struct column of statistics called ``prefix``."""
        terms = [f"{self.intercept!r}D", *(f"IF({r.sql(prefix)}, {r.weight!r}D, 0D)" for r in self.rules)]
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
        keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
        name = free(docs, "__statistics")[0]
        rows = docs.withColumn(name, _statistics(docs[text]))
        return rows.select(*keep, self.column(name).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    def accepted(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``docs`` that are predicted 1, with their own columns."""
        name = free(docs, "__statistics")[0]
        return docs.withColumn(name, _statistics(docs[text])).where(self.column(name) >= 0.5).drop(name)


#: Penalties that are tried, the strongest first.
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)


def _folds(y: np.ndarray, n: int) -> np.ndarray:
    """A fold for each row, each with its share of either label."""
    fold = np.empty(len(y), dtype=np.int64)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        fold[rows] = np.arange(len(rows)) % n
    return fold


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, n_bins: int = 32, seed: int = 7, tree_rows: int = 4000, folds: int = 5) -> RuleEnsemble:
    """From a matrix of STATISTICS and 0/1 labels.

    Each tree is grown on up to ``tree_rows`` rows, drawn anew. The lasso is fitted without each of ``folds`` parts of the rows in
    turn. The penalty is the strongest whose loss on the parts that were left out is within a standard error of the least, and
    a rule weighs what it weighs on average over the folds, so that no single rows decide.
    """
    if not len(y):
        return RuleEnsemble(0.0, ())
    y = y.astype(np.float32)
    if y.min() == y.max():
        return RuleEnsemble(3.0 if y[0] else -3.0, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.int16)
    found: set = set()
    k = max(4, x.shape[1] // 2)
    for _ in range(trees):
        rows = rng.choice(len(y), size=min(len(y), tree_rows), replace=True)
        balance = np.where(y[rows] > 0, 1 / max(1, (y[rows] > 0).sum()), 1 / max(1, (y[rows] == 0).sum())) * len(rows) / 2
        _grow(bins[rows], y[rows], balance, rng.choice(x.shape[1], size=k, replace=False), n_bins + 1, depth, (), found, max(LEAST, len(rows) // 500))
    # a bound beyond the last cut holds for all rows
    paths = sorted(p for p in found if all(at < len(cuts[f]) for f, at, _ in p))
    columns, seen = [], {}
    for j, p in enumerate(paths):
        hit = np.ones(len(y), dtype=bool)
        for f, at, low in p:
            hit &= (bins[:, f] <= at) if low else (bins[:, f] > at)
        if 0 < hit.sum() < len(y) and seen.setdefault(np.packbits(hit).tobytes(), j) == j:
            columns.append((p, hit))
    if not columns:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    paths = [p for p, _ in columns]
    hits = np.empty((len(y), len(paths)), dtype=np.float32)  # the one large table here
    for j, (_, hit) in enumerate(columns):
        hits[:, j] = hit
    del columns, seen, bins
    part = _folds(y, folds) if len(y) >= 2 * folds else np.zeros(len(y), np.int64)
    parts = range(folds) if part.any() else (-1,)
    loss = np.zeros((len(PENALTIES), len(y)))
    models: list[list] = [[] for _ in PENALTIES]
    for i in parts:
        weigh = (part != i).astype(np.float32)
        start = None
        for j, penalty in enumerate(PENALTIES):
            start = w, b = _lasso(hits, y, weigh, penalty, start)
            models[j].append((w, b))
            out = part == i
            loss[j, out] = _losses(_sigmoid(b + hits[out] @ w), y[out])
    if part.any():
        mean = loss.mean(axis=1)
        best = int(mean.argmin())
        error = (loss[best]).std() / np.sqrt(len(y))
        chosen = int(np.flatnonzero(mean <= mean[best] + error)[0])
    else:
        chosen = PENALTIES.index(0.003)
    w, b = np.mean([w for w, _ in models[chosen]], axis=0), float(np.mean([b for _, b in models[chosen]]))
    rules = [Rule(tuple((STATISTICS[f], float(cuts[f][at]), low) for f, at, low in p), float(v)) for p, v in zip(paths, w, strict=True) if abs(v) > 1e-3]
    return RuleEnsemble(b, tuple(rules))


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that nothing is learned from: crc32 of the id as text, mod 3, is 1. False for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000, **how) -> RuleEnsemble:
    """Fits on up to ``sample_rows`` labelled documents, those with the smallest hash of their id; held-out rows are not read.

    That bound is also the bound of what is broadcast and of what comes to the driver.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    y = y.groupBy("doc_id").agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("__y"))
    y = y.withColumn("__h", F.xxhash64(F.lit(3), "doc_id")).orderBy("__h", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("__h", "__y", _statistics("text").alias("s"))
    rows = rows.select("__h", "__y", "s.*").orderBy("__h", *STATISTICS).limit(sample_rows).toArrow()
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, rows.column("__y").to_numpy(), **how)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, by rules learned from ``labels``."""
    return learn(docs, labels, **how).score(docs)
