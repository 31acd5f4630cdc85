"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Statistics of the whole text are Spark columns. On a bounded labelled sample, small boosted trees are grown on them; every path from a
root to a node is a rule, a conjunction of comparisons. A lasso logistic regression weighs the rules, most get zero, and those that
remain become one column expression, so scoring is a projection without Python, shuffle or model files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, word_count

#: Labelled rows that a fit takes at most: those with the smallest hash of their id.
SAMPLE_ROWS = 8000
TREES, DEPTH, BINS = 25, 3, 32

_COUNTS = {
    "upper": r"\p{Lu}", "digit": r"[0-9]", "mark": r"[#*$%&|~^<>{}\[\]=_\\/]", "shout": r"!", "stop": r"[.?]", "comma": r"[,;:]", "line": r"\n",
}


def statistics(text: Column) -> dict[str, Column]:
    """Columns of one text's statistics; null counts as empty. Shares are of characters or words, and 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    base = {"chars": F.length(t), "words": F.size(words), "kinds": F.size(F.array_distinct(words)), "octets": F.octet_length(t)}
    return {k: v.cast("double") for k, v in base.items()} | {f"n_{k}": F.regexp_count(t, F.lit(p)).cast("double") for k, p in _COUNTS.items()}


def shares(c: dict[str, Column]) -> dict[str, Column]:
    """What the rules compare, from the columns of statistics(). Distinct words are set against all words by their logarithms: the plain share falls
    with length, and would count long texts as repetitive."""
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "chars": c["chars"], "words": c["words"], "word_length": per(c["chars"], c["words"]), "kinds_share": F.log(c["kinds"] + 1) / F.log(c["words"] + 2), "wide_share": per(c["octets"] - c["chars"], c["chars"]),
        "words_per_line": per(c["words"], c["n_line"] + 1), "words_per_stop": per(c["words"], c["n_stop"] + 1),
        **{f"{k}_share": per(c[f"n_{k}"], c["chars"]) for k in _COUNTS},
    }


def with_shares(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Two structs: _k with the columns of keep, and _s with the shares; and _n, a number that accepted() uses."""
    kept = F.struct(*map(column, keep)).alias("_k")
    stats = docs.select(kept, F.monotonically_increasing_id().alias("_n"), *(v.alias(k) for k, v in statistics(column(text_col)).items()))
    made = shares({k: F.col(k) for k in stats.columns[2:]})
    return stats.select("_k", "_n", F.struct(*(v.alias(k) for k, v in made.items())).alias("_s"))


Rule = tuple[tuple[str, str, float], ...]


@dataclass
class RuleModel:
    """Rules of (name, "<=" or ">", threshold) conditions, a weight for each, and the intercept."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def probability(self, share) -> Column:
        """The score as a column; share(name) gives a statistic's column."""
        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, (share(n) <= F.lit(t) if op == "<=" else share(n) > F.lit(t) for n, op, t in rule))

        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(holds(rule), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _edges(col: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf"))


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, rate: float = 0.3) -> list[Rule]:
    """Paths of gradient-boosted trees of the logistic loss, without repeats."""
    edges = [_edges(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    least = max(5, len(y) // 500)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z, rules = np.full(len(y), np.log(prior / (1 - prior))), {}

    def split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int] | None:
        best, g, h, n = None, grad[rows].sum(), hess[rows].sum(), len(rows)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            size = len(e) + 1
            gs, hs, ns = (np.cumsum(np.bincount(binned[rows, j], w, size))[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (n - ns < least)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = gain[k], j, k
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = y - p, p * (1 - p)
        front: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            after = []
            for rows, rule in front:
                if rule:
                    rules.setdefault(tuple(sorted(rule)), None)
                found = split(rows, grad, hess) if level < depth else None
                if found is None:
                    z[rows] += rate * grad[rows].sum() / (hess[rows].sum() + 1)
                    continue
                _, j, k = found
                low = binned[rows, j] <= k
                t = float(edges[j][k])
                after += [(rows[low], (*rule, (names[j], "<=", t))), (rows[~low], (*rule, (names[j], ">", t)))]
            front = after
    return list(rules)


def rule_matrix(x: np.ndarray, names: list[str], rules: list[Rule]) -> np.ndarray:
    at = {n: j for j, n in enumerate(names)}
    out = np.ones((len(x), len(rules)), np.float32)
    for r, rule in enumerate(rules):
        for n, op, t in rule:
            out[:, r] *= x[:, at[n]] <= t if op == "<=" else x[:, at[n]] > t
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the free intercept: accelerated proximal gradient on the mean logistic loss + penalty * sum of |weights|."""
    n, k = a.shape
    rate = 4.0 / max(1.0, float(np.linalg.norm(a, ord="fro") ** 2 / n + 1) if k < 2 else _top_eigenvalue(a) + 1)
    w = np.zeros(k + 1) if start is None else start.copy()
    v, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v[:-1].astype(np.float32) + v[-1])))
        d = (p - y) / n
        new = v - rate * np.append(d @ a, d.sum())
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def _top_eigenvalue(a: np.ndarray) -> float:
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    return float(np.linalg.norm(a @ v) ** 2 / len(a))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Rules from the trees, the penalty from every fourth row held back, the weights from all rows. One label only: the intercept alone."""
    n, ones = len(y), int(y.sum())
    if n == 0 or ones in (0, n):
        return RuleModel([], [], float(np.log((ones + 1) / (n - ones + 1))))
    rules = grow_rules(x, y, names)
    a = rule_matrix(x, names, rules)
    if not rules:
        return RuleModel([], [], float(np.log(ones / (n - ones))))
    back = np.arange(n) % 4 == 0
    best, start = (np.inf, 1e-2), None
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3, 3e-4):
        start = lasso_logistic(a[~back], y[~back], penalty, start=start)
        z = a[back] @ start[:-1] + start[-1]
        loss = float(np.mean(np.logaddexp(0, z) - y[back] * z))
        best = min(best, (loss, penalty))
    w = lasso_logistic(a, y, best[1], steps=500, start=start)
    used = np.flatnonzero(np.abs(w[:-1]) > 1e-4)
    return RuleModel([rules[i] for i in used], [float(w[i]) for i in used], float(w[-1]))


def held_out(id_col: Column) -> Column:
    """Rows that no fit learns from: crc32 of the id as text divisible by 5. False for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model of label_col > 0 from texts alone. It learns from at most sample_rows labelled rows outside held_out(); null labels and ids
    are left out, and an id with several labels has the largest."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").where(~held_out(F.col("_id")))
    own = own.groupBy("_id").agg((F.max("_y") > 0).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(own), docs[id_col] == F.col("_id"))  # sample_rows rows at most
    rows = with_shares(rows.select("_id", "_y", docs[text_col].alias("_t")), "_t", ["_id", "_y"])
    rows = rows.select("_k.*", "_s.*").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    got = rows.toPandas()
    names = list(got.columns[2:])
    return fit_rules(got[names].to_numpy(float), got["_y"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (by default all columns) and `score`, 0 to 1; every row gets one, null and empty texts as well. An own `score` column is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    return with_shares(docs, text_col, keep).select("_k.*", model.probability(lambda n: F.col(f"_s.{n}")).alias("score"))


def accepted(docs: DataFrame, model: RuleModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`; null and empty texts are scored like others, repeated rows stay or go together.

    A filter on the score alone would be pushed below the statistics, and Catalyst would then compute each of them anew in every rule that
    names it. Since the filter also reads _n, which isn't deterministic, it stays above, and every statistic is computed once.
    """
    rows = with_shares(docs, text_col, docs.columns)
    return rows.where((model.probability(lambda n: F.col(f"_s.{n}")) >= least) & (F.col("_n") >= 0)).select("_k.*")
