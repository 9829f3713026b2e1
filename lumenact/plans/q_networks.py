"""Queries: confidence and lock-in under a network with given weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import lockin as lock
from ..operators import network_curve as net
from ..operators import temporal as tmp
from . import fixtures as fx
from .catalog import query
from .oracle import cte, decisions, with_ctes
from .q_temporal import LOCKIN_LEVEL, STEP_GRID
from .study import K, Study

HIDDEN = 4


def given_network(n_classes: int):
    """Weights by formula, as the SQL below has them."""
    i, j, c = np.arange(K)[:, None], np.arange(HIDDEN), np.arange(n_classes)
    return [(((7 * i + 3 * j) % 11 - 5) / 4.0, (j % 3 - 1) / 8.0),
            (((5 * j[:, None] + 2 * c) % 7 - 3) / 2.0, (c % 4) / 16.0)]


def _scores(name: str, grid: str, seen: str) -> None:
    cte(f"{name}_scores", ("test", "picks", "samples"), f"""
      SELECT h.sample_id, h.label, h.t, c.cls,
        max((c.i % 4)::DOUBLE / 16) + sum(greatest(h.z, 0) * ((5 * h.j + 2 * c.i) % 7 - 3)::DOUBLE / 2) AS score
      FROM (SELECT s.sample_id, s.label, g.t::INTEGER AS t, j.j,
              max((j.j % 3 - 1)::DOUBLE / 8) + coalesce(sum(((7 * (p.rank - 1) + 3 * j.j) % 11 - 5)::DOUBLE / 4), 0) AS z
            FROM test s CROSS JOIN {grid} g(t) CROSS JOIN range({HIDDEN}) j(j)
            LEFT JOIN picks p ON p.sample_id = s.sample_id AND {seen}
            GROUP BY s.sample_id, s.label, g.t, j.j) h
      CROSS JOIN (SELECT label AS cls, row_number() OVER (ORDER BY label) - 1 AS i
                  FROM (SELECT DISTINCT label FROM samples)) c
      GROUP BY h.sample_id, h.label, h.t, c.cls""")
    decisions(name, f"{name}_scores", "sample_id, label, t")


_scores("net_curve", f"range(0, {fx.MAX_STEPS})", "p.first_step <= g.t")
_scores("net_grid", f"range(1, {fx.MAX_STEPS + 1})", "p.first_step < g.t")
_scores("net_pred", "range(0, 1)", "true")


def _curve(s: Study):
    return net.network_curve(
        s.picks(s.test_first), s.test, given_network(len(s.classes)), s.ids, s.classes, STEP_GRID, inclusive=True)


def _analysed(s: Study):
    return lock.analysed(_curve(s), lock.step_coverage(s.test))


@query("c02_network_predictions", with_ctes("net_pred", "SELECT sample_id, label, pred, confidence, p_true FROM net_pred"))
def c02(spark, sf_dir):
    s = Study(spark, sf_dir)
    return net.network_predictions(s.picks(s.test_first), s.test, given_network(len(s.classes)), s.ids, s.classes)


@query("d04_network_confidence", with_ctes("net_grid", "SELECT * FROM net_grid"))
def d04(spark, sf_dir):
    s = Study(spark, sf_dir)
    grid = list(range(1, fx.MAX_STEPS + 1))
    return net.network_curve(s.picks(s.test_first), s.test, given_network(len(s.classes)), s.ids, s.classes, grid)


@query("d05_network_curve", with_ctes("net_grid", """
  SELECT t, round(avg((pred = label)::INTEGER), 7) AS accuracy, round(avg(confidence), 7) AS mean_confidence,
    round(quantile_cont(confidence, 0.5), 7) AS median_confidence FROM net_grid GROUP BY t"""))
def d05(spark, sf_dir):
    rows = tmp.curve_summary(d04(spark, sf_dir))
    return rows.select("t", *[F.round(c, 7).alias(c) for c in ("accuracy", "mean_confidence", "median_confidence")])


@query("d19_network_topic_confidence", with_ctes("net_curve coverage", """
  SELECT label, t, round(avg(p_true), 7) AS mean_p_true
  FROM net_curve WHERE t IN (SELECT step FROM coverage) GROUP BY label, t"""))
def d19(spark, sf_dir):
    return lock.topic_confidence(_analysed(Study(spark, sf_dir))).withColumn("mean_p_true", F.round("mean_p_true", 7))


cte("net_lockin", ("net_curve", "coverage"), """
  SELECT sample_id, label, CAST(coalesce(min(t) FILTER (p_true >= 0.2::DOUBLE), -1) AS INTEGER) AS lockin
  FROM net_curve WHERE t IN (SELECT step FROM coverage) GROUP BY sample_id, label""")


@query("d20_network_lockin", with_ctes("net_lockin", "SELECT * FROM net_lockin"))
def d20(spark, sf_dir):
    return lock.lockin_steps(_analysed(Study(spark, sf_dir)), LOCKIN_LEVEL)


@query("d21_network_lockin_summary", with_ctes("net_lockin", """
  SELECT label, quantile_cont(lockin, 0.5) FILTER (lockin >= 0)::DOUBLE AS median,
    round(stddev_pop(lockin) FILTER (lockin >= 0), 9) AS std, count(*) FILTER (lockin >= 0) AS n_reached,
    count(*) AS n_samples, round(100.0::DOUBLE * count(*) FILTER (lockin >= 0) / count(*), 9) AS pct_reached
  FROM net_lockin GROUP BY label"""))
def d21(spark, sf_dir):
    rows = lock.lockin_summary(d20(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("std", "pct_reached")})
