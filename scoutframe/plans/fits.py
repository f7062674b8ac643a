"""Queries: fits of all expanding folds and what their out-of-fold rows are worth, beside twins that solve the same equations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.operators import folds as D
from scoutframe.operators import metrics as M
from scoutframe.plans.queries import RATES_SQL, rates, registrar, rounded
from scoutframe.sources.sinks import stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)

FIRST_TEST = 1997
_NAMES = ["points_per_game", "rebounds_per_40", "assists_per_40"]
#: Season rows with outcomes: who is drafted, and how early; a fifth of the assists is missing.
LEARN_SQL = f"""{RATES_SQL}, learn AS (SELECT season, athlete_id, position, points_per_game AS f1, rebounds_per_40 AS f2, CASE WHEN athlete_id % 5 > 0 THEN assists_per_40 END AS f3,
  (((athlete_id * 7 + season * 3) % 10 + games_played) > 8)::INT AS drafted, CASE WHEN ((athlete_id * 7 + season * 3) % 10 + games_played) > 8 THEN (1 + (athlete_id * 13 + season) % 60)::DOUBLE END AS pick FROM rates WHERE minutes > 0),
tests AS (SELECT DISTINCT season AS t FROM learn WHERE season >= {FIRST_TEST})"""


def learnable(spark, sf_dir) -> DataFrame:
    x, k = rates(spark, sf_dir).where("minutes > 0"), F.col("athlete_id")
    drafted = ((k * 7 + F.col("season") * 3) % 10 + F.col("games_played")) > 8
    # the years, every pass of a fit and the scores read it
    return stored(x.select(
        "season", "athlete_id", "position", "points_per_game", "rebounds_per_40", F.when(k % 5 > 0, F.col("assists_per_40")).alias("assists_per_40"),
        drafted.cast("int").alias("drafted"), F.when(drafted, (1 + (k * 13 + F.col("season")) % 60).cast("double")).alias("pick"),
    ))


def _years(x: DataFrame) -> dict[int, list[int]]:
    return D.fold_years([r[0] for r in x.select("season").distinct().collect()], FIRST_TEST)  # a handful


def _solved(a: list[list[str]], b: list[str]) -> list[str]:
    """The solution of three symmetric equations by determinants, as SQL."""

    def det(m):
        return " + ".join(f"({m[0][i]}) * (({m[1][(i + 1) % 3]}) * ({m[2][(i + 2) % 3]}) - ({m[1][(i + 2) % 3]}) * ({m[2][(i + 1) % 3]}))" for i in range(3))

    whole = det(a)
    return [f"({det([[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)])}) / ({whole})" for k in range(3)]


def _shaped(rows: str, names: list[str], target: str) -> str:
    """Training rows of every test season, imputed by their medians and scaled; ``shape`` has the figures of each fold."""
    fill = ", ".join(f"coalesce({n}, m_{n}) AS {n}" for n in names)
    return f"""train AS (SELECT t, {', '.join(names)}, {target}::DOUBLE AS y FROM tests JOIN learn ON season < t WHERE {rows}),
med AS (SELECT t, {', '.join(f'quantile_cont({n}, 0.5) AS m_{n}' for n in names)} FROM train GROUP BY t),
filled AS (SELECT t, {fill}, y FROM train JOIN med USING (t)),
shape AS (SELECT t, {', '.join(f'avg({n}) AS u_{n}, stddev_pop({n}) AS s_{n}' for n in names)}, avg(y) AS uy, stddev_pop(y) AS sy, count(*) AS n FROM filled GROUP BY t),
z AS (SELECT t, {', '.join(f'({n} - u_{n}) / s_{n} AS z_{n}' for n in names)}, y, (y - uy) / sy AS zy, n / (2 * CASE WHEN y = 1 THEN uy * n ELSE n - uy * n END) AS w FROM filled JOIN shape USING (t))"""


def _scores(names: list[str]) -> str:
    return ", ".join(f"(coalesce({n}, m_{n}) - u_{n}) / s_{n} AS z_{n}" for n in names)


_F = ["f1", "f2", "f3"]
_GRAM = [[f"g{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
RIDGE_SQL = f"""{LEARN_SQL}, {_shaped('pick IS NOT NULL', _F, 'pick')},
gram AS (SELECT t, {', '.join(f"sum(z_{_F[i]} * z_{_F[j]}){' + 10' if i == j else ''} AS g{i}{j}" for i in range(3) for j in range(i, 3))}, {', '.join(f'sum(z_{_F[i]} * zy) AS b{i}' for i in range(3))} FROM z GROUP BY t),
fit AS (SELECT t, {', '.join(f'{s} AS w{i}' for i, s in enumerate(_solved(_GRAM, ['b0', 'b1', 'b2'])))} FROM gram)"""


@query(f"""WITH {RIDGE_SQL}, x AS (SELECT season, athlete_id, {_scores(_F)}, uy, sy, w0, w1, w2 FROM learn JOIN fit ON fit.t = season JOIN med ON med.t = season JOIN shape ON shape.t = season)
SELECT season, athlete_id, round(uy + sy * (w0 * z_f1 + w1 * z_f2 + w2 * z_f3), 6) AS predicted FROM x""")
def ridge_folds(spark, sf_dir):
    """Picks of every test season, each by the fit of the seasons before it."""
    x = learnable(spark, sf_dir)
    fits = D.ridge_folds(D.Rows.of(x, _NAMES, "season", "pick"), _years(x))
    return rounded(D.out_of_fold(x, fits, "season", None, "predicted").select("season", "athlete_id", "predicted"))


_STEPS = 12
_L = ["f1", "f3"]


def _newton(k: int) -> str:
    """One Newton step of the penalised, balanced loss for all folds."""
    v = ["z_f1", "z_f3", "1.0::DOUBLE"]
    gram = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    sums = [f"sum(w * p * (1 - p) * {v[i]} * {v[j]}){' + 4.0::DOUBLE' if i == j and i < 2 else ''} AS h{i}{j}" for i in range(3) for j in range(i, 3)]
    sums += [f"sum(w * (p - y) * {v[i]}){f' + 4.0::DOUBLE * max(c{i})' if i < 2 else ''} AS q{i}" for i in range(3)]
    step = _solved(gram, ["q0", "q1", "q2"])
    scored = f"SELECT z.*, c0, c1, c2, 1 / (1 + exp(-(c0 * z_f1 + c1 * z_f3 + c2))) AS p FROM z JOIN n{k - 1} USING (t)"
    return f"n{k} AS MATERIALIZED (SELECT t, {', '.join(f'c{i} - ({step[i]}) AS c{i}' for i in range(3))} FROM (SELECT t, max(c0) AS c0, max(c1) AS c1, max(c2) AS c2, {', '.join(sums)} FROM ({scored}) GROUP BY t))"


LOGIT_SQL = f"""{LEARN_SQL}, {_shaped('true', _L, 'drafted')}, n0 AS (SELECT t, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM shape WHERE uy > 0 AND uy < 1),
{', '.join(_newton(k) for k in range(1, _STEPS + 1))}, oof AS (SELECT season, athlete_id, drafted, round(1 / (1 + exp(-(c0 * z_f1 + c1 * z_f3 + c2))), 9) AS chance
  FROM (SELECT season, athlete_id, drafted, {_scores(_L)}, c0, c1, c2 FROM learn JOIN n{_STEPS} f ON f.t = season JOIN med ON med.t = season JOIN shape ON shape.t = season))"""


def _out_of_fold(spark, sf_dir) -> DataFrame:
    x = learnable(spark, sf_dir)
    fits = D.logit_folds(D.Rows.of(x, ["points_per_game", "assists_per_40"], "season", "drafted"), _years(x))
    return D.out_of_fold(x, fits, "season", None, "z").withColumn("chance", F.round(X.logistic(F.col("z")), 9))


@query(f"WITH {LOGIT_SQL} SELECT season, athlete_id, round(chance, 6) AS chance FROM oof")
def logit_folds(spark, sf_dir):
    """Chances of every test season, each by the fit of the seasons before it."""
    return rounded(_out_of_fold(spark, sf_dir).where("z IS NOT NULL").select("season", "athlete_id", "chance"))


def _worth(key: str, name: str) -> str:
    return f"""{name} AS (SELECT k, auc, average_precision, log_loss, brier FROM
 (SELECT k, (sum(r) FILTER (drafted = 1) - sum(drafted) * (sum(drafted) + 1) / 2) / nullif(sum(drafted) * (count(*) - sum(drafted)), 0) AS auc FROM (SELECT {key} AS k, drafted, rank() OVER (PARTITION BY {key} ORDER BY chance) + (count(*) OVER (PARTITION BY {key}, chance) - 1) / 2 AS r FROM oof) GROUP BY k)
 JOIN (SELECT k, sum(tp * ctp / cn) / sum(tp) AS average_precision FROM (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (SELECT {key} AS k, chance, sum(drafted) AS tp, count(*) AS n FROM oof GROUP BY ALL) WINDOW w AS (PARTITION BY k ORDER BY chance DESC)) GROUP BY k) USING (k)
 JOIN (SELECT {key} AS k, avg(-(drafted * ln(least(greatest(chance, 1e-9), 1 - 1e-9)) + (1 - drafted) * ln(1 - least(greatest(chance, 1e-9), 1 - 1e-9)))) AS log_loss, avg((chance - drafted) ** 2) AS brier FROM oof GROUP BY 1) USING (k))"""


_METRICS = ["auc", "average_precision", "log_loss", "brier"]


@query(f"""WITH {LOGIT_SQL}, {_worth('season', 'per_fold')}, {_worth("'all'", 'whole')}
{' UNION ALL '.join(f"SELECT '{m}' AS metric, (SELECT round(avg({m}), 6) FROM per_fold) AS macro, (SELECT round(stddev_pop({m}), 6) FROM per_fold) AS sd, (SELECT round(min({m}), 6) FROM per_fold) AS low, (SELECT round({m}, 6) FROM whole) AS pooled" for m in _METRICS)}""")
def fold_metrics(spark, sf_dir):
    """Chances by fold and pooled."""
    rows = stored(_out_of_fold(spark, sf_dir).where("z IS NOT NULL").select("season", "chance", "drafted"))
    return rounded(M.fold_report(rows, "season", "chance", "drafted"))


@query()
def logit_fit(spark, sf_dir):
    """Chances of every test season with positions; tests hold these fits against the conditions of their optimum."""
    x = learnable(spark, sf_dir)
    fits = D.logit_folds(D.Rows.of(x, _NAMES, "season", "drafted", "position"), _years(x))
    return D.out_of_fold(x, fits, "season", "position", "z").select("season", "athlete_id", X.logistic(F.col("z")).alias("chance"))


@query()
def ridge_fit(spark, sf_dir):
    """Picks of every test season with positions; tests hold these fits against a refit of each fold."""
    x = learnable(spark, sf_dir)
    fits = D.ridge_folds(D.Rows.of(x, _NAMES, "season", "pick", "position"), _years(x))
    return D.out_of_fold(x, fits, "season", "position", "predicted").select("season", "athlete_id", "predicted")
