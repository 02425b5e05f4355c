"""SQL of the count model: Newton's steps written out one after the other."""

from __future__ import annotations

POISSON_STEPS, JOINT_STEPS = 9, 40

_ROWS = """usable AS MATERIALIZED (
  SELECT grp, recordable_cases::DOUBLE AS y, exposure::DOUBLE AS h, ln(workers) AS x FROM clean
  WHERE workers > 0 AND exposure > 0 AND recordable_cases >= 0
    AND grp IN (SELECT grp FROM clean WHERE workers > 0 AND exposure > 0 GROUP BY grp HAVING SUM(recordable_cases) > 0)),
beyond AS MATERIALIZED (
  SELECT j, COUNT(*) AS c FROM usable, generate_series(0, (SELECT MAX(y)::BIGINT FROM usable)) AS t(j)
  WHERE y > j GROUP BY j)"""


def _poisson_step(k: int) -> str:
    return f"""at{k}(b) AS MATERIALIZED (
  SELECT b + SUM(xy - yy * m1) / SUM(yy * (m2 - m1 * m1))
  FROM (SELECT b, grp, SUM(x * y) AS xy, SUM(y) AS yy,
          SUM(h * x * exp(b * x)) / SUM(h * exp(b * x)) AS m1,
          SUM(h * x * x * exp(b * x)) / SUM(h * exp(b * x)) AS m2
        FROM usable, at{k - 1} GROUP BY b, grp) GROUP BY b)"""


_START = f"""joint0 AS MATERIALIZED (
  SELECT grp, b, ln(SUM(y) / SUM(h * exp(b * x))) AS a, 1.0::DOUBLE AS th
  FROM usable, at{POISSON_STEPS} GROUP BY grp, b),
poisson_mu AS MATERIALIZED (SELECT y, x, grp, b, h * exp(a + b * x) AS mu FROM usable JOIN joint0 USING (grp)),
poisson_parts AS (
  SELECT grp, ANY_VALUE(b) AS b, COUNT(*) AS n, SUM(mu) AS i, SUM(mu * x) AS ix, SUM(mu * x * x) AS ixx,
         SUM((y - mu) * x) AS ux, SUM(abs((y - mu) * x)) AS tx, SUM((y - mu) ** 2 / mu) AS pearson
  FROM poisson_mu GROUP BY grp)"""


def _joint_step(k: int) -> str:
    """Constants, slope and size from the scores at the step before."""
    p = f"joint{k - 1}"
    return f"""mean{k} AS MATERIALIZED (
  SELECT y, x, grp, a, b, th, h * exp(a + b * x) AS mu FROM usable JOIN {p} USING (grp)),
sums{k} AS MATERIALIZED (
  SELECT grp, a, b, th, SUM((y - mu) / (1 + mu / th)) AS u, SUM(mu / (1 + mu / th)) AS i,
         SUM(x * mu / (1 + mu / th)) AS ix, SUM(x * x * mu / (1 + mu / th)) AS ixx,
         SUM(x * (y - mu) / (1 + mu / th)) AS ux,
         SUM(ln(th) + 1 - ln(th + mu) - (y + th) / (mu + th)) AS s,
         SUM(1 / th - 2 / (th + mu) + (y + th) / ((th + mu) * (th + mu))) AS c
  FROM mean{k} GROUP BY grp, a, b, th),
size{k} AS MATERIALIZED (
  SELECT b, th, SUM(ux - ix * u / i) / SUM(ixx - ix * ix / i) AS db,
         th * (SUM(s) + (SELECT SUM(c / (th + j)) FROM beyond)) AS d1,
         th * (SUM(s) + (SELECT SUM(c / (th + j)) FROM beyond))
           + th * th * (SUM(c) - (SELECT SUM(c / ((th + j) * (th + j))) FROM beyond)) AS d2
  FROM sums{k} GROUP BY b, th),
joint{k} AS MATERIALIZED (
  SELECT grp, g.b + db AS b, a + (u - ix * db) / i AS a,
         g.th * exp(greatest(-1, least(1, CASE WHEN d2 < 0 THEN -d1 / d2 ELSE 0.5 * sign(d1) END))) AS th
  FROM sums{k} g, size{k})"""


def _figures(model: str, parts: str, dispersion: str, pearson: str, solved: str) -> str:
    z = "1.959963984540054::DOUBLE"
    error = "sqrt(1 / SUM(ixx - ix * ix / i))"
    slope = "ANY_VALUE(b)"
    return f"""SELECT '{model}' AS model, SUM(n)::BIGINT AS n, COUNT(*) AS n_groups,
  ROUND({slope}, 6) AS slope, ROUND({error}, 6) AS std_error, ROUND({slope} - {z} * {error}, 6) AS ci_low,
  ROUND({slope} + {z} * {error}, 6) AS ci_high, ROUND(2 ** {slope}, 6) AS rate_ratio_per_doubling,
  ROUND({dispersion}, 6) AS dispersion, ROUND(SUM({pearson}) / (SUM(n) - COUNT(*) - 1), 6) AS pearson_per_df,
  {solved} AS solved FROM {parts}"""


def count_model() -> tuple[str, list[str]]:
    """The statement's body and its tables, over ``clean``."""
    last = f"joint{JOINT_STEPS}"
    tables = [_ROWS, "at0(b) AS (SELECT 0.0::DOUBLE)"]
    tables += [_poisson_step(k) for k in range(1, POISSON_STEPS + 1)]
    tables.append(_START)
    tables += [_joint_step(k) for k in range(1, JOINT_STEPS + 1)]
    tables.append(f"""joint_parts AS (
  SELECT grp, ANY_VALUE(b) AS b, ANY_VALUE(th) AS th, COUNT(*) AS n, SUM(mu / (1 + mu / th)) AS i,
         SUM(x * mu / (1 + mu / th)) AS ix, SUM(x * x * mu / (1 + mu / th)) AS ixx,
         SUM((y - mu) / (1 + mu / th)) AS u, SUM(abs(y - mu) / (1 + mu / th)) AS t,
         SUM((y - mu) ** 2 / (mu * (1 + mu / th))) AS pearson
  FROM (SELECT y, x, grp, b, th, h * exp(a + b * x) AS mu FROM usable JOIN {last} USING (grp)) GROUP BY grp)""")
    body = " UNION ALL ".join(
        [
            _figures("poisson", "poisson_parts", "0.0::DOUBLE", "pearson", "abs(SUM(ux)) / SUM(tx) <= 1e-8"),
            _figures("negative binomial", "joint_parts", "1 / ANY_VALUE(th)", "pearson", "MAX(abs(u) / t) <= 1e-8"),
        ]
    )
    return body, tables
