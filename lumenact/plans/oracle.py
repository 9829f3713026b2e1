"""SQL twins of the fixtures and of the shared chain, as common table expressions."""

from __future__ import annotations

# name -> (needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(names: str, select: str) -> str:
    """`select` preceded by the named expressions and all they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in names.split():
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{select}"


cte("samples", (), """
  SELECT vec_id AS sample_id, label,
    CAST(coalesce(list_min(list_filter(range(8), lambda s: embedding[8 * s + 1]::DOUBLE > 0.2::DOUBLE)), 8)
         AS INTEGER) AS n_steps
  FROM embeddings""")

cte("alive", ("samples",), "SELECT * FROM samples WHERE n_steps > 0")

cte("hidden", ("samples",), """
  SELECT s.sample_id, s.label, l.layer::INTEGER AS layer, t.step::INTEGER AS step, e.d,
    (CASE WHEN l.layer = 0 THEN x.embedding[8 * t.step + e.d + 1]
          ELSE x.embedding[8 * e.d + t.step + 1] END)::DOUBLE AS x
  FROM samples s JOIN embeddings x ON x.vec_id = s.sample_id,
    range(2) l(layer), range(8) t(step), range(8) e(d)
  WHERE t.step < s.n_steps""")

cte("w", (), """
  SELECT l.layer::INTEGER AS layer, f.f::INTEGER AS feature_id, e.d,
    ((7 * f.f + 3 * e.d + 5 * l.layer + (f.f * e.d) % 7) % 11 - 5)::DOUBLE / 4.0::DOUBLE AS w,
    ((f.f % 5) - 2)::DOUBLE / 16.0::DOUBLE AS b_enc,
    0.25::DOUBLE + (f.f % 4)::DOUBLE / 10.0::DOUBLE AS threshold,
    ((e.d % 3) - 1)::DOUBLE / 64.0::DOUBLE AS b_dec
  FROM range(2) l(layer), range(32) f(f), range(8) e(d)""")

cte("pre", ("hidden", "w"), """
  SELECT h.sample_id, h.label, h.layer, h.step, w.feature_id,
    sum(h.x * w.w) + max(w.b_enc) AS plain,
    sum((h.x - w.b_dec) * w.w) + max(w.b_enc) AS centred,
    max(w.threshold) AS threshold
  FROM hidden h JOIN w USING (layer, d)
  GROUP BY h.sample_id, h.label, h.layer, h.step, w.feature_id""")

cte("fired", ("pre",), """
  SELECT sample_id, label, layer, step, feature_id FROM pre WHERE centred > threshold""")

cte("first_fire", ("fired",), """
  SELECT sample_id, label, layer, feature_id, min(step) AS first_step
  FROM fired GROUP BY sample_id, label, layer, feature_id""")

cte("split", ("alive",), """
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id)
      <= floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
  FROM alive""")

cte("train", ("split",), "SELECT * FROM split WHERE split = 'train'")
cte("test", ("split",), "SELECT * FROM split WHERE split = 'test'")


def dense_variance(name: str, first: str, people: str) -> None:
    """Variance of the rate over a full (layer, label, feature) grid with zeros."""
    cte(f"{name}_rates", (first, people), f"""
      SELECT g.layer, g.feature_id, n.label, coalesce(c.n, 0)::DOUBLE / n.n_label AS rate
      FROM (SELECT l.layer::INTEGER AS layer, f.f::INTEGER AS feature_id FROM range(2) l(layer), range(32) f(f)) g
      CROSS JOIN (SELECT label, count(*) AS n_label FROM {people} GROUP BY label) n
      LEFT JOIN (SELECT layer, label, feature_id, count(*) AS n FROM {first}
                 WHERE sample_id IN (SELECT sample_id FROM {people})
                 GROUP BY layer, label, feature_id) c
        ON c.layer = g.layer AND c.feature_id = g.feature_id AND c.label = n.label""")
    cte(f"{name}_var", (f"{name}_rates",), f"""
      SELECT layer, feature_id, var_pop(rate) AS variance FROM {name}_rates GROUP BY layer, feature_id""")
    cte(f"{name}_ranked", (f"{name}_var",), f"""
      SELECT *, CAST(row_number() OVER (PARTITION BY layer ORDER BY round(variance, 12) DESC, feature_id)
        AS INTEGER) AS rank FROM {name}_var""")
    cte(f"{name}_scores", (f"{name}_ranked",), f"""
      SELECT layer, sum(variance) / 8 AS score FROM {name}_ranked WHERE rank <= 8 GROUP BY layer""")
    cte(f"{name}_best", (f"{name}_scores",), f"""
      SELECT layer FROM {name}_scores ORDER BY round(score, 12) DESC, layer LIMIT 1""")
    cte(f"{name}_chosen", (f"{name}_ranked", f"{name}_best"), f"""
      SELECT * FROM {name}_ranked WHERE rank <= 8 AND layer = (SELECT layer FROM {name}_best)""")


dense_variance("all", "first_fire", "alive")
dense_variance("tr", "first_fire", "train")

cte("picks", ("first_fire", "tr_chosen"), """
  SELECT f.*, c.rank FROM first_fire f JOIN tr_chosen c ON c.layer = f.layer AND c.feature_id = f.feature_id""")

cte("nb_counts", ("picks", "train", "tr_chosen"), """
  SELECT l.label AS cls, c.feature_id, c.rank, coalesce(k.n, 0) AS n_fired, l.n_label,
    (SELECT count(*) FROM train) AS n
  FROM (SELECT label, count(*) AS n_label FROM train GROUP BY label) l CROSS JOIN tr_chosen c
  LEFT JOIN (SELECT label, feature_id, count(*) AS n FROM picks
             WHERE sample_id IN (SELECT sample_id FROM train) GROUP BY label, feature_id) k
    ON k.label = l.label AND k.feature_id = c.feature_id""")


def bayes(name: str, counts: str, keys: str = "", alpha: str = "1.0::DOUBLE") -> None:
    """Weights and bias of a smoothed Bernoulli model per `keys`."""
    lead = f"{keys}, " if keys else ""
    cte(f"{name}_w", (counts,), f"""
      SELECT {lead}cls, feature_id, ln(p) - ln(1 - p) AS w, ln(1 - p) AS miss, ln(n_label::DOUBLE / n) AS prior
      FROM (SELECT *, (n_fired + {alpha}) / (n_label + 2 * {alpha}) AS p FROM {counts})""")
    cte(f"{name}_b", (f"{name}_w",), f"""
      SELECT {lead}cls, max(prior) + sum(miss) AS b FROM {name}_w GROUP BY {lead}cls""")


def decisions(name: str, scores: str, keys: str) -> None:
    """Class, confidence and probability of the true class from class scores."""
    cte(name, (scores,), f"""
      SELECT {keys}, CAST(min(cls) FILTER (score >= m - 1e-9::DOUBLE) AS INTEGER) AS pred,
        round(1 / sum(exp(score - m)), 9) AS confidence,
        round(sum(exp(score - m)) FILTER (cls = label) / sum(exp(score - m)), 9) AS p_true
      FROM (SELECT *, max(score) OVER (PARTITION BY {keys}) AS m FROM {scores})
      GROUP BY {keys}""")


bayes("nb", "nb_counts")

cte("pred_scores", ("test", "nb_w", "nb_b", "picks"), """
  SELECT s.sample_id, s.label, b.cls, max(b.b) + coalesce(sum(w.w), 0) AS score
  FROM test s CROSS JOIN nb_b b
  LEFT JOIN picks p ON p.sample_id = s.sample_id
  LEFT JOIN nb_w w ON w.cls = b.cls AND w.feature_id = p.feature_id
  GROUP BY s.sample_id, s.label, b.cls""")
decisions("pred", "pred_scores", "sample_id, label")


def curve(name: str, grid: str, seen: str) -> None:
    cte(f"{name}_scores", ("test", "nb_w", "nb_b", "picks"), f"""
      SELECT s.sample_id, s.label, g.t::INTEGER AS t, b.cls, max(b.b) + coalesce(sum(w.w), 0) AS score
      FROM test s CROSS JOIN {grid} g(t) CROSS JOIN nb_b b
      LEFT JOIN picks p ON p.sample_id = s.sample_id AND p.first_step {seen} g.t
      LEFT JOIN nb_w w ON w.cls = b.cls AND w.feature_id = p.feature_id
      GROUP BY s.sample_id, s.label, g.t, b.cls""")
    decisions(name, f"{name}_scores", "sample_id, label, t")


curve("curve", "range(1, 9)", "<")
curve("steps_curve", "range(0, 8)", "<=")
