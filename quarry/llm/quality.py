"""Quality classifier: a sparse rule ensemble that runs as one Spark column expression.

Statistics of a text are DataFrame expressions. Shallow trees are grown on a bounded sample of labelled
rows, each path from a root to a node is a rule (a conjunction of thresholds), and a logistic model with
a lasso penalty weighs rules and scaled statistics; most weights end at zero. What is left is
compiled into a column: the sigmoid of a sum of CASE expressions.

The sample is the `sample_rows` labelled rows of least hash, so it is the same at every partitioning;
beyond that bound (and a fifth more, drawn by hash before the sort) more labels don't change the cost. Statistics are taken
of these rows to fit, and of every document to score it.

Defined cases: null and empty texts have all statistics zero and get a score like any other; labels
that are null are left out, of several labels of a document the least counts; without labels of both kinds
the score is the share of good ones (0.5 without any). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, none of which grows with its length but log_words."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")
    chars, n_words, n_lines = F.length(text), F.size(words), F.size(lines)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(chars, n_words),
        "upper": share(F.regexp_count(text, F.lit(r"\p{Lu}")), chars),
        "stops": share(F.regexp_count(text, F.lit(r"[.,;:?]")), chars),
        "signs": share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:?'\"()-]")), chars),
        "digits": share(F.regexp_count(text, F.lit(r"[0-9]")), chars),
        "unique_words": share(F.size(F.array_distinct(words)), n_words),
        "unique_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "line_words": share(n_words, n_lines),
    }


@dataclass
class RuleModel:
    """Weights of rules (conjunctions of (name, at most?, threshold)) and of scaled statistics."""

    intercept: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)  # name, low, high, weight

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            test = F.lit(True)
            for name, at_most, t in conditions:
                test = test & (F.col(name) <= t if at_most else F.col(name) > t)
            z = z + F.when(test, weight).otherwise(0.0)
        for name, low, high, weight in self.linear:
            z = z + F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) * weight
        return 1 / (1 + F.exp(-z))


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int, depth: int, seed: int) -> list[tuple]:
    """Paths of trees on random halves of rows, fitted to what the trees before leave over."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    score, rules = np.zeros(len(y)), {}

    def split(rows: np.ndarray, left: int, path: tuple, r: np.ndarray) -> None:
        if path:
            rules[path] = None
        if not left or len(rows) < 20:
            score[rows] += r[rows].mean() if len(rows) else 0
            return
        best = (1e-9, None, None)
        total, n = r[rows].sum(), len(rows)
        for j in rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)]:
            below = x[rows, j][:, None] <= cuts[j]
            m = below.sum(0)
            s = r[rows] @ below
            ok = (m >= 5) & (m <= n - 5)
            gain = np.where(ok, s**2 / np.maximum(m, 1) + (total - s) ** 2 / np.maximum(n - m, 1) - total**2 / n, 0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (gain[k], j, cuts[j][k])
        _, j, t = best
        if j is None:
            score[rows] += r[rows].mean()
            return
        at_most = x[rows, j] <= t
        for side, part in ((True, rows[at_most]), (False, rows[~at_most])):
            split(part, left - 1, path + ((names[j], side, float(t)),), r)

    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-score))
        split(rng.permutation(len(y))[: max(1, len(y) // 2)], depth, (), r)
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept isn't penalised."""
    n, p = x.shape
    a = np.column_stack((np.ones(n), x))
    w = v = np.zeros(p + 1)
    vec = np.ones(p + 1)
    for _ in range(20):  # the largest eigenvalue bounds the step
        vec = a.T @ (a @ vec)
        vec /= np.linalg.norm(vec)
    step = 4 * n / max(1e-9, np.linalg.norm(a @ vec) ** 2)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -40, 40))) - y) / n
        u = v - step * g
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        w, t = u, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    good = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or good in (0.0, 1.0):
        good = min(max(good, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(good / (1 - good))))
    rules = grow_rules(x, y, names, trees, depth, seed)
    at = {n: i for i, n in enumerate(names)}
    hits = np.ones((len(y), len(rules)))
    for k, path in enumerate(rules):
        for name, at_most, t in path:
            hits[:, k] *= x[:, at[name]] <= t if at_most else x[:, at[name]] > t
    low, high = np.quantile(x, 0.01, 0), np.quantile(x, 0.99, 0)
    clipped = np.clip(x, low, high)
    scale = 0.4 / np.maximum(clipped.std(0), 1e-9)
    intercept, w = lasso_logistic(np.column_stack((hits, (clipped - low) * scale)), y, penalty)
    k = len(rules)
    linear = [(n, float(low[i]), float(high[i]), float(w[k + i] * scale[i])) for i, n in enumerate(names) if w[k + i] and high[i] > low[i]]
    return RuleModel(intercept - sum(lo * b for _, lo, _, b in linear), [(r, float(b)) for r, b in zip(rules, w) if b], linear)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (1 if the score is at least 0.7)."""
    model, stats = learn(docs, labels, sample_rows), statistics(F.col("text"))
    scored = docs.select("doc_id", *[c.alias(n) for n, c in stats.items()]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """The model from at most sample_rows labelled documents, none of them held out. Only theirs are texts that it looks at."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").cast("double").alias("_y"))
    draw, stats = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), statistics(F.col("text"))
    there = docs.select("doc_id").join(known, F.col("doc_id") == F.col("labelled"), "left_semi").count()
    texts = docs.select("doc_id", "text", draw.alias("_draw"))
    share = 1.2 * sample_rows / max(1, there)
    if share < 1:  # a sort with a limit sends its rows from every task; few of each are in the running
        texts = texts.where(F.col("_draw") < int(share * (1 << 40)))
    met = texts.join(known, F.col("doc_id") == F.col("labelled")).select("doc_id", "_draw", "_y", *[c.alias(n) for n, c in stats.items()])
    rows = met.orderBy("_draw", "doc_id", *stats).limit(sample_rows).select(*stats, "_y").toPandas()
    return fit(rows[list(stats)].to_numpy("float64"), rows["_y"].to_numpy("float64"), list(stats))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with a score of at least the limit, all columns as they were."""
    model, stats = learn(docs, labels, sample_rows), statistics(F.col("text"))
    inner = {n: f"_quality_{n}" for n in stats}
    renamed = RuleModel(model.intercept, [(tuple((inner[n], s, t) for n, s, t in r), w) for r, w in model.rules], [(inner[n], a, b, w) for n, a, b, w in model.linear])
    return docs.withColumns({inner[n]: c for n, c in stats.items()}).where(renamed.column() >= limit).select(*docs.columns)
