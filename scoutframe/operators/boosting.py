"""Gradient boosting on binned features, grown level by level: one scan a level, whatever the number of rows.

Features become bins between exact quantiles, missing values a bin of their own.  For a level, every task adds the
gradients and curvatures of its rows to histograms (node, feature, bin), which
are summed; the best split of each node follows from these sums alone.  The driver holds the
histograms of a level and the trees.  A fitted model is an expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.operators.quantiles import from_counts
from scoutframe.sources.sinks import stored


@dataclass
class Node:
    """A split (rows with a bin up to ``bin`` of ``feature`` go left, missing ones where ``missing_left`` says) or, without a feature, a value."""

    value: float = 0.0
    feature: int | None = None
    bin: int = 0
    missing_left: bool = True


@dataclass
class Model:
    """Edges of the bins of each feature, and trees as nodes by number (children of k are 2k + 1 and 2k + 2)."""

    names: list[str]
    edges: list[list[float]]
    base: float
    trees: list[dict[int, Node]] = field(default_factory=list)
    logistic: bool = False

    def bins(self) -> list[Column]:
        """Of each feature the number of edges below the value; -1 where it is missing."""
        out = []
        for name, edges in zip(self.names, self.edges, strict=True):
            v = X.num(name)
            below = reduce(lambda a, b: a + b, [(v > F.lit(e)).cast("int") for e in edges], F.lit(0))
            out.append(F.when(v.isNull(), -1).otherwise(below))
        return out

    def _value(self, tree: dict[int, Node], bins: list[Column], k: int = 0) -> Column:
        node = tree[k]
        if node.feature is None:
            return F.lit(float(node.value))
        return F.when(self._left(node, bins), self._value(tree, bins, 2 * k + 1)).otherwise(self._value(tree, bins, 2 * k + 2))

    @staticmethod
    def _left(node: Node, bins: list[Column]) -> Column:
        b = bins[node.feature]
        return (b <= node.bin) & ((b >= 0) | F.lit(node.missing_left))

    def score(self, bins: list[Column] | None = None) -> Column:
        """The sum over all trees; ``logistic`` makes it a chance."""
        bins = bins if bins is not None else self.bins()
        total = reduce(lambda a, b: a + b, [self._value(t, bins) for t in self.trees], F.lit(float(self.base)))
        return X.logistic(total) if self.logistic else total


def _edges(df: DataFrame, names: list[str], most: int) -> list[list[float]]:
    """Distinct inner quantiles of each feature; what lies at an edge lies below it."""
    long = df.select(*[X.num(n).alias(n) for n in names]).unpivot([], names, "name", "v").where("v IS NOT NULL")
    counts = long.groupBy("name", "v").agg(F.count("*").alias("n"))
    found = {r.name: r.quantiles for r in from_counts(counts, ["name"], "v", [k / most for k in range(1, most)]).collect()}  # a few numbers for each feature
    return [sorted(set(found.get(n, []))) for n in names]


def best_split(sums: dict[tuple[int, int], tuple[float, float]], features: int, bins: int, ridge: float, least: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, missing left) of the best split of one node; ``sums``: (feature, bin) to gradient and curvature, -1 for missing.

    Ties go to the first feature, the lowest bin, and missing values to the left.
    """
    best = None
    for f in range(features):
        own = {b: s for (g, b), s in sums.items() if g == f}
        whole = [sum(s[i] for s in own.values()) for i in (0, 1)]
        for missing_left in (True, False):
            gone = own.get(-1, (0.0, 0.0))
            left = list(gone) if missing_left else [0.0, 0.0]
            for b in range(bins):
                more = own.get(b, (0.0, 0.0))
                left = [left[0] + more[0], left[1] + more[1]]
                right = [whole[0] - left[0], whole[1] - left[1]]
                if left[1] < least or right[1] < least:
                    continue
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9 * abs(best[0])):
                    best = (gain, f, b, missing_left)
    return best


def fit(df: DataFrame, names: list[str], target: str, trees: int = 20, depth: int = 3, rate: float = 0.1, ridge: float = 1.0, least: float = 1.0, most_bins: int = 32, logistic: bool = False) -> Model:
    """Boosted trees on squared error, or with ``logistic`` on log loss of a target of 0 and 1; rows without a target play no part."""
    known = df.where(F.col(target).isNotNull())
    mean = known.agg(F.avg(F.col(target).cast("double"))).first()[0]
    if mean is None:
        raise ValueError("no row has a target")
    if logistic and mean in (0.0, 1.0):
        raise ValueError("both labels are needed")
    import math

    model = Model(names, _edges(known, names, most_bins), math.log(mean / (1 - mean)) if logistic else float(mean), [], logistic)
    binned = stored(known.select(F.col(target).cast("double").alias("y"), *[b.alias(f"b{k}") for k, b in enumerate(model.bins())]))
    bins = [F.col(f"b{k}") for k in range(len(names))]
    widest = max((len(e) for e in model.edges), default=0) + 1
    for _ in range(trees):
        now = model.score(bins)
        slope = now - F.col("y")
        curve = now * (1 - now) if logistic else F.lit(1.0)
        rows = binned.select(*bins, slope.alias("g"), curve.alias("h"))
        tree: dict[int, Node] = {0: Node()}
        open_ = [0]
        for level in range(depth + 1):
            if not open_:
                break
            sums = _histograms(rows, model, tree, bins, open_)
            following = []
            for k in open_:
                own = sums.get(k, {})
                g, h = (sum(s[i] for (f, _), s in own.items() if f == 0) for i in (0, 1))
                split = best_split(own, len(names), widest, ridge, least) if level < depth else None
                if split is None:
                    tree[k] = Node(value=-rate * g / (h + ridge))
                else:
                    _, f, b, missing_left = split
                    tree[k] = Node(0.0, f, b, missing_left)
                    tree[2 * k + 1], tree[2 * k + 2] = Node(), Node()
                    following += [2 * k + 1, 2 * k + 2]
            open_ = following
        model.trees.append(tree)
    return model


def _histograms(rows: DataFrame, model: Model, tree: dict[int, Node], bins: list[Column], open_: list[int]) -> dict[int, dict[tuple[int, int], tuple[float, float]]]:
    """Node to (feature, bin) to sums, of the nodes of a level: one scan, summed before it moves."""

    def at(k: int) -> Column:
        node = tree[k]
        return F.lit(k) if node.feature is None else F.when(model._left(node, bins), at(2 * k + 1)).otherwise(at(2 * k + 2))

    placed = rows.withColumn("node", at(0)).where(F.col("node").isin(open_))
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), b.alias("b")) for f, b in enumerate(bins)])
    long = placed.select("node", "g", "h", F.explode(pairs).alias("p"))
    out: dict[int, dict[tuple[int, int], tuple[float, float]]] = {}
    # nodes times features times bins
    for r in long.groupBy("node", "p.f", "p.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out.setdefault(r.node, {})[(r.f, r.b)] = (r.g, r.h)
    return out
