"""EM models unrolled for a fixed number of rounds, as SQL text."""

from __future__ import annotations


def _labels(k: int) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i})" for i in range(k)) + ") AS ks(v)"


def _posterior(name: str, lik_cte: str, k: int, prior: str) -> list[str]:
    """``name(task_id, z, g, ev)`` from ``lik_cte(task_id, z, p)`` and a prior query (z, p)."""
    return [
        f"""{name}_s AS (SELECT task_id, z, sum(CASE WHEN p > 0 THEN ln(p) END) AS s,
          sum(CASE WHEN p <= 0 THEN 1 ELSE 0 END) AS zeros FROM {lik_cte} GROUP BY 1, 2)""",
        f"""{name}_w AS (SELECT task_id, s.z, CASE WHEN zeros = 0 AND q.p > 0 THEN coalesce(s, 0) + ln(q.p) END AS w
          FROM {name}_s s JOIN ({prior}) q ON q.z = s.z)""",
        f"""{name}_m AS (SELECT *, max(w) OVER (PARTITION BY task_id) AS m FROM {name}_w)""",
        f"""{name}_e AS (SELECT *, coalesce(exp(w - m), 0) AS e FROM {name}_m)""",
        f"""{name} AS MATERIALIZED (SELECT task_id, z,
          CASE WHEN m IS NULL THEN {1.0 / k!r}e0 ELSE e / sum(e) OVER (PARTITION BY task_id) END AS g,
          CASE WHEN m IS NULL THEN 0 ELSE m + ln(sum(e) OVER (PARTITION BY task_id)) END AS ev FROM {name}_e)""",
    ]


def _uniform(k: int) -> str:
    return f"SELECT v AS z, {1.0 / k!r}e0 AS p FROM ks"


def _llh(post: str) -> str:
    return f"(SELECT sum(ev) FROM {post} WHERE z = 0)"


def ds_ctes(ann: str, k: int, rounds: int, quality: float = 0.7) -> str:
    off = (1 - quality) / (k - 1)
    init = f"CASE WHEN z = y THEN {quality!r}e0 ELSE {off!r}e0 END"
    ctes = [
        f"ks AS ({_labels(k)})",
        f"ann AS MATERIALIZED (SELECT DISTINCT task_id, worker_id, label FROM ({ann}) AS src)",
        f"""p0 AS (SELECT worker_id, z, y, {init} AS p FROM (SELECT DISTINCT worker_id FROM ann) w,
          (SELECT v AS z FROM ks) a, (SELECT v AS y FROM ks) b)""",
        f"q0 AS ({_uniform(k)})",
    ]
    for t in range(1, rounds + 2):
        ctes.append(
            f"""l{t} AS (SELECT a.task_id, p.z, p.p FROM ann a JOIN p{t-1} p
              ON p.worker_id = a.worker_id AND p.y = a.label)"""
        )
        ctes += _posterior(f"e{t}", f"l{t}", k, f"SELECT * FROM q{t-1}")
        ctes.append(f"q{t} AS MATERIALIZED (SELECT z, avg(g) AS p FROM e{t} GROUP BY z)")
        ctes.append(
            f"""p{t} AS MATERIALIZED (SELECT worker_id, z, y, CASE WHEN n > 0 THEN c / n ELSE {init} END AS p FROM (
              SELECT a.worker_id, e.z, b.v AS y, sum(e.g) AS n,
                sum(CASE WHEN a.label = b.v THEN e.g ELSE 0 END) AS c
              FROM ann a JOIN e{t} e ON e.task_id = a.task_id CROSS JOIN ks b GROUP BY 1, 2, 3) x)"""
        )
    return ",\n".join(ctes)


def zc_ctes(ann: str, k: int, rounds: int) -> str:
    """``rounds`` counted rounds after one unreported round."""
    ctes = [
        f"ks AS ({_labels(k)})",
        f"ann AS MATERIALIZED (SELECT DISTINCT task_id, worker_id, label FROM ({ann}) AS src)",
        "c0 AS (SELECT DISTINCT worker_id, 0.8e0 AS c FROM ann)",
        f"q0 AS ({_uniform(k)})",
    ]
    for t in range(1, rounds + 3):
        ctes.append(
            f"""l{t} AS (SELECT a.task_id, ks.v AS z,
              CASE WHEN a.label = ks.v THEN c.c ELSE (1e0 - c.c) / {k - 1} END AS p
              FROM ann a JOIN c{t-1} c ON c.worker_id = a.worker_id CROSS JOIN ks)"""
        )
        ctes += _posterior(f"e{t}", f"l{t}", k, f"SELECT * FROM q{t-1}")
        ctes.append(f"q{t} AS MATERIALIZED (SELECT z, avg(g) AS p FROM e{t} GROUP BY z)")
        ctes.append(
            f"""c{t} AS MATERIALIZED (SELECT a.worker_id, avg(e.g) AS c FROM ann a JOIN e{t} e
              ON e.task_id = a.task_id AND e.z = a.label GROUP BY 1)"""
        )
    return ",\n".join(ctes)


def shrunk_coin_ctes(ann: str, k: int, rounds: int, start: float, weight: float) -> str:
    """One competence per worker, shrunk towards ``start`` as by ``weight`` more labels."""
    ctes = [
        f"ks AS ({_labels(k)})",
        f"ann AS MATERIALIZED (SELECT DISTINCT task_id, worker_id, label FROM ({ann}) AS src)",
        f"c0 AS (SELECT DISTINCT worker_id, {start!r}e0 AS c FROM ann)",
        f"q0 AS ({_uniform(k)})",
    ]
    for t in range(1, rounds + 1):
        ctes.append(
            f"""l{t} AS (SELECT a.task_id, ks.v AS z,
              CASE WHEN a.label = ks.v THEN c.c ELSE (1e0 - c.c) / {k - 1} END AS p
              FROM ann a JOIN c{t-1} c ON c.worker_id = a.worker_id CROSS JOIN ks)"""
        )
        ctes += _posterior(f"e{t}", f"l{t}", k, f"SELECT * FROM q{t-1}")
        ctes.append(f"q{t} AS MATERIALIZED (SELECT z, avg(g) AS p FROM e{t} GROUP BY z)")
        ctes.append(
            f"""c{t} AS MATERIALIZED (SELECT a.worker_id, (sum(e.g) + {start * weight!r}e0) / (count(*) + {weight!r}e0) AS c
              FROM ann a JOIN e{t} e ON e.task_id = a.task_id AND e.z = a.label GROUP BY 1)"""
        )
    return ",\n".join(ctes)


def likelihood_trace_sql(rounds: int, threshold: float) -> str:
    """Rounds and log likelihoods of the unrolled posteriors up to the first small relative change."""
    values = " UNION ALL ".join(f"SELECT {t} AS t, {_llh(f'e{t}')} AS v" for t in range(1, rounds + 2))
    return f"""SELECT CAST(t - 1 AS INT) AS iter, 'log_likelihood' AS metric, round(v, 4) AS value FROM (
      SELECT t, v, coalesce(min(CASE WHEN small THEN t END) OVER (), 0) AS last FROM (
        SELECT t, v, abs((v - lag(v) OVER (ORDER BY t)) / lag(v) OVER (ORDER BY t)) < {threshold!r} AS small
        FROM ({values}) AS x) AS y) AS z WHERE t >= 2 AND t <= last"""


def mace_ctes(ann: str, k: int, rounds: int, alpha: float = 0.5, beta: float = 0.5, delta: float = 0.01) -> str:
    """Smoothed EM; round 1 starts from vote shares of the largest label per (task, worker)."""
    ctes = [
        f"ks AS ({_labels(k)})",
        f"""ann AS MATERIALIZED (SELECT task_id, worker_id, max(label) AS label FROM ({ann}) AS src GROUP BY 1, 2)""",
        "s0 AS (SELECT DISTINCT worker_id, 0.5e0 AS s FROM ann)",
        f"x0 AS (SELECT worker_id, v AS y, {1.0 / k!r}e0 AS x FROM (SELECT DISTINCT worker_id FROM ann) w, ks)",
        f"q0 AS ({_uniform(k)})",
        """e1 AS MATERIALIZED (SELECT task_id, ks.v AS z,
          avg(CASE WHEN label = ks.v THEN 1e0 ELSE 0e0 END) AS g, 0e0 AS ev FROM ann CROSS JOIN ks GROUP BY 1, 2)""",
        *_mace_rounds(k, rounds, alpha, beta, delta),
    ]
    return ",\n".join(ctes)


def _mace_likelihood(name: str, before: int) -> str:
    return f"""{name} AS (SELECT a.task_id, ks.v AS z,
      CASE WHEN a.label = ks.v THEN 1e0 - s.s ELSE 0e0 END + s.s * x.x AS p
      FROM ann a JOIN s{before} s ON s.worker_id = a.worker_id
      JOIN x{before} x ON x.worker_id = a.worker_id AND x.y = a.label CROSS JOIN ks)"""


def mace_restart_ctes(
    ann: str, k: int, rounds: int, restarts: int, noise: float = 0.5, alpha: float = 0.5, beta: float = 0.5, delta: float = 0.01
) -> str:
    """Independent fits of every start (task and worker ids carry ``#start``); ``best`` is the posterior of the likeliest."""

    def u(j: str) -> str:
        return f"(CAST(CAST('0x' || substr(md5('0:' || r || ':' || id || ':' || {j}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0)"

    starts = ", ".join(f"('{r}')" for r in range(restarts))
    move = f"CASE WHEN r = '0' THEN 0e0 ELSE {noise!r}e0 END"
    ctes = [
        f"ks AS ({_labels(k)})",
        f"""ann AS MATERIALIZED (SELECT task_id || '#' || r AS task_id, worker_id || '#' || r AS worker_id,
          max(label) AS label FROM ({ann}) AS src CROSS JOIN (VALUES {starts}) AS starts(r) GROUP BY 1, 2)""",
        """w AS MATERIALIZED (SELECT worker_id, split_part(worker_id, '#', 1) AS id, split_part(worker_id, '#', 2) AS r
          FROM (SELECT DISTINCT worker_id FROM ann))""",
        f"s0 AS MATERIALIZED (SELECT worker_id, 0.5e0 + {move} * ({u('0')} - 0.5e0) AS s FROM w)",
        f"""x0 AS MATERIALIZED (SELECT worker_id, y, x / sum(x) OVER (PARTITION BY worker_id) AS x FROM (
          SELECT worker_id, v AS y, 1e0 + {move} * {u('(v + 1)')} AS x FROM w CROSS JOIN ks))""",
        f"q0 AS ({_uniform(k)})",
        _mace_likelihood("l1", 0),
        *_posterior("e1p", "l1", k, "SELECT * FROM q0"),
        """e1 AS MATERIALIZED (SELECT * FROM e1p WHERE NOT ends_with(task_id, '#0') UNION ALL
          SELECT task_id, ks.v AS z, avg(CASE WHEN label = ks.v THEN 1e0 ELSE 0e0 END) AS g, 0e0 AS ev
          FROM ann CROSS JOIN ks WHERE ends_with(task_id, '#0') GROUP BY 1, 2)""",
        *_mace_rounds(k, rounds, alpha, beta, delta),
        f"""final AS MATERIALIZED (SELECT split_part(task_id, '#', 2) AS r, sum(ev) AS llh FROM e{rounds + 1} WHERE z = 0 GROUP BY 1)""",
        "chosen AS (SELECT r FROM final ORDER BY round(llh, 6) DESC, CAST(r AS INT) LIMIT 1)",
        f"""best AS MATERIALIZED (SELECT CAST(split_part(task_id, '#', 1) AS BIGINT) AS task_id, z, g
          FROM e{rounds} JOIN chosen ON chosen.r = split_part(task_id, '#', 2))""",
    ]
    return ",\n".join(ctes)


def _mace_rounds(k: int, rounds: int, alpha: float, beta: float, delta: float) -> list[str]:
    """Later posteriors e2.. and the parameters s1.., x1.. of the smoothed form."""
    ctes = []
    for t in range(1, rounds + 2):
        if t > 1:
            ctes.append(_mace_likelihood(f"l{t}", t - 1))
            ctes += _posterior(f"e{t}", f"l{t}", k, "SELECT * FROM q0")
        ctes.append(
            f"""m{t} AS MATERIALIZED (SELECT a.worker_id, a.label,
              e.g * (s.s * x.x / (1e0 - s.s + s.s * x.x)) + (1e0 - e.g) AS spam
              FROM ann a JOIN s{t-1} s ON s.worker_id = a.worker_id
              JOIN x{t-1} x ON x.worker_id = a.worker_id AND x.y = a.label
              JOIN e{t} e ON e.task_id = a.task_id AND e.z = a.label)"""
        )
        ctes.append(
            f"""s{t} AS MATERIALIZED (SELECT worker_id, (sum(spam) + {alpha}e0) / (count(*) + {alpha + beta}e0) AS s
              FROM m{t} GROUP BY 1)"""
        )
        ctes.append(
            f"""x{t} AS MATERIALIZED (SELECT worker_id, ks.v AS y,
              (sum(CASE WHEN label = ks.v THEN spam ELSE 0 END) + {delta}e0) / (sum(spam) + {delta * k!r}e0) AS x
              FROM m{t} CROSS JOIN ks GROUP BY 1, 2)"""
        )
    return ctes


def digamma_sql(x: str) -> str:
    """psi(x): recurrence up to an argument of at least 8, then five terms of the asymptotic series."""
    up = " - ".join(f"1e0 / (({x}) + {i}e0)" for i in range(8))
    y = f"(({x}) + 8e0)"
    series = (
        f"ln({y}) - 1e0 / (2e0 * {y}) - 1e0 / (12e0 * pow({y}, 2)) + 1e0 / (120e0 * pow({y}, 4)) "
        f"- 1e0 / (252e0 * pow({y}, 6)) + 1e0 / (240e0 * pow({y}, 8))"
    )
    return f"({series} - {up})"


def mace_variational_ctes(ann: str, k: int, rounds: int, alpha: float = 0.5, beta: float = 0.5, delta: float = 0.01) -> str:
    """The smoothed form with exp(psi - psi) in place of the ratios; s holds spamming (s) and copying (c)."""

    def ratio(x: str, total: str) -> str:
        return f"exp({digamma_sql(x)} - {digamma_sql(total)})"

    ctes = [
        f"ks AS ({_labels(k)})",
        f"""ann AS MATERIALIZED (SELECT task_id, worker_id, max(label) AS label FROM ({ann}) AS src GROUP BY 1, 2)""",
        "s0 AS (SELECT DISTINCT worker_id, 0.5e0 AS s, 0.5e0 AS c FROM ann)",
        f"x0 AS (SELECT worker_id, v AS y, {1.0 / k!r}e0 AS x FROM (SELECT DISTINCT worker_id FROM ann) w, ks)",
        f"q0 AS ({_uniform(k)})",
        """e1 AS MATERIALIZED (SELECT task_id, ks.v AS z,
          avg(CASE WHEN label = ks.v THEN 1e0 ELSE 0e0 END) AS g, 0e0 AS ev FROM ann CROSS JOIN ks GROUP BY 1, 2)""",
    ]
    for t in range(1, rounds + 1):
        if t > 1:
            ctes.append(
                f"""l{t} AS (SELECT a.task_id, ks.v AS z,
                  CASE WHEN a.label = ks.v THEN s.c ELSE 0e0 END + s.s * x.x AS p
                  FROM ann a JOIN s{t-1} s ON s.worker_id = a.worker_id
                  JOIN x{t-1} x ON x.worker_id = a.worker_id AND x.y = a.label CROSS JOIN ks)"""
            )
            ctes += _posterior(f"e{t}", f"l{t}", k, "SELECT * FROM q0")
        ctes.append(
            f"""m{t} AS MATERIALIZED (SELECT a.worker_id, a.label,
              e.g * (s.s * x.x / (s.c + s.s * x.x)) + (1e0 - e.g) AS spam
              FROM ann a JOIN s{t-1} s ON s.worker_id = a.worker_id
              JOIN x{t-1} x ON x.worker_id = a.worker_id AND x.y = a.label
              JOIN e{t} e ON e.task_id = a.task_id AND e.z = a.label)"""
        )
        ctes.append(
            f"""s{t} AS MATERIALIZED (SELECT worker_id, {ratio(f'spam + {alpha}e0', f'n + {alpha + beta}e0')} AS s,
              {ratio(f'n - spam + {beta}e0', f'n + {alpha + beta}e0')} AS c
              FROM (SELECT worker_id, sum(spam) AS spam, CAST(count(*) AS DOUBLE) AS n FROM m{t} GROUP BY 1) AS u)"""
        )
        ctes.append(
            f"""x{t} AS MATERIALIZED (SELECT worker_id, y, {ratio(f'part + {delta}e0', f'spam + {delta * k!r}e0')} AS x FROM (
              SELECT worker_id, ks.v AS y, sum(CASE WHEN label = ks.v THEN spam ELSE 0e0 END) AS part, sum(spam) AS spam
              FROM m{t} CROSS JOIN ks GROUP BY 1, 2) AS u)"""
        )
    return ",\n".join(ctes)


def glad_ctes(ann: str, k: int, rounds: int, steps: int, step_size: float, strength: float = 1.0) -> str:
    """One unreported round, then ``rounds``; ``steps`` fixed-length ascent steps per M-step."""
    prior = f"SELECT v AS z, CASE WHEN v = 1 THEN {0.99 / k + 0.01!r}e0 ELSE {0.99 / k!r}e0 END AS p FROM ks"
    ctes = [
        f"ks AS ({_labels(k)})",
        f"ann AS MATERIALIZED (SELECT DISTINCT task_id, worker_id, label FROM ({ann}) AS src)",
        "a0 AS (SELECT DISTINCT worker_id, 1e0 AS alpha FROM ann)",
        "b0 AS (SELECT DISTINCT task_id, 1e0 AS beta FROM ann)",
    ]
    n = 0

    def rows(i: int) -> str:
        return f"""(SELECT a.task_id, a.worker_id, a.label, w.alpha, exp(t.beta) AS easy, w.alpha * exp(t.beta) AS x
          FROM ann a JOIN a{i} w ON w.worker_id = a.worker_id JOIN b{i} t ON t.task_id = a.task_id)"""

    for t in range(1, rounds + 2):
        ctes.append(
            f"""l{t} AS (SELECT r.task_id, ks.v AS z, CASE WHEN r.label = ks.v THEN 1e0 / (1e0 + exp(-r.x))
              ELSE 1e0 / (1e0 + exp(r.x)) / {k - 1} END AS p FROM {rows(n)} r CROSS JOIN ks)"""
        )
        ctes += _posterior(f"e{t}", f"l{t}", k, prior)
        for _ in range(steps):
            ctes.append(
                f"""g{n + 1} AS MATERIALIZED (SELECT r.task_id, r.worker_id, (e.g - 1e0 / (1e0 + exp(-r.x))) * r.easy AS da,
                  (e.g - 1e0 / (1e0 + exp(-r.x))) * r.x AS db
                  FROM {rows(n)} r JOIN e{t} e ON e.task_id = r.task_id AND e.z = r.label)"""
            )
            for new, old, key, grad, col in (("a", "a", "worker_id", "da", "alpha"), ("b", "b", "task_id", "db", "beta")):
                ctes.append(
                    f"""{new}{n + 1} AS MATERIALIZED (SELECT {key}, {col} + {step_size}e0 * greatest(least(
                      (d - {strength}e0 * ({col} - 1e0)) / (n + 1), 2e0), -2e0) AS {col} FROM (
                      SELECT o.{key}, any_value(o.{col}) AS {col}, sum(g.{grad}) AS d, count(*) AS n
                      FROM g{n + 1} g JOIN {old}{n} o ON o.{key} = g.{key} GROUP BY 1) x)"""
                )
            n += 1
    ctes.append(f"a_end AS (SELECT * FROM a{n}), b_end AS (SELECT * FROM b{n})")
    return ",\n".join(ctes)


def glad_conjugate_ctes(ann: str, k: int, rounds: int, steps: int, step_size: float, strength: float = 1.0) -> str:
    """One unreported round, then ``rounds``; ``steps`` conjugate-gradient steps of fixed length per M-step.

    Round t ends with workers wa{t}, tasks wb{t} and the largest gradient component top{t}(g).
    """
    prior = f"SELECT v AS z, CASE WHEN v = 1 THEN {0.99 / k + 0.01!r}e0 ELSE {0.99 / k!r}e0 END AS p FROM ks"
    ctes = [
        f"ks AS ({_labels(k)})",
        f"ann AS MATERIALIZED (SELECT DISTINCT task_id, worker_id, label FROM ({ann}) AS src)",
        "wa0 AS (SELECT DISTINCT worker_id, 1e0 AS alpha FROM ann)",
        "wb0 AS (SELECT DISTINCT task_id, 1e0 AS beta FROM ann)",
    ]

    def rows(a: str, b: str) -> str:
        return f"""(SELECT a.task_id, a.worker_id, a.label, w.alpha, exp(t.beta) AS easy, w.alpha * exp(t.beta) AS x
          FROM ann a JOIN {a} w ON w.worker_id = a.worker_id JOIN {b} t ON t.task_id = a.task_id)"""

    sides = (("a", "worker_id", "alpha", "r.easy"), ("b", "task_id", "beta", "r.x"))
    for t in range(1, rounds + 2):
        at = {"a": f"wa{t - 1}", "b": f"wb{t - 1}"}
        ctes.append(
            f"""l{t} AS (SELECT r.task_id, ks.v AS z, CASE WHEN r.label = ks.v THEN 1e0 / (1e0 + exp(-r.x))
              ELSE 1e0 / (1e0 + exp(r.x)) / {k - 1} END AS p FROM {rows(at['a'], at['b'])} r CROSS JOIN ks)"""
        )
        ctes += _posterior(f"e{t}", f"l{t}", k, prior)
        for i in range(steps + 1):
            n, last = f"{t}_{i}", f"{t}_{i - 1}"
            for side, key, col, factor in sides:
                old = "0e0 AS old, 0e0 AS dir, s.h + 1e0 AS h" if i == 0 else "o.g AS old, o.d AS dir, o.h"
                join = "" if i == 0 else f"JOIN d{side}{last} o ON o.{key} = p.{key}"
                ctes.append(
                    f"""g{side}{n} AS MATERIALIZED (SELECT p.{key}, p.{col}, s.g - {strength}e0 * (p.{col} - 1e0) AS g, {old} FROM {at[side]} p JOIN (
                      SELECT r.{key}, sum({factor} * {factor} / ((1e0 + exp(-r.x)) * (1e0 + exp(r.x)))) AS h, sum((e.g - 1e0 / (1e0 + exp(-r.x))) * {factor}) AS g
                      FROM {rows(at['a'], at['b'])} r JOIN e{t} e ON e.task_id = r.task_id AND e.z = r.label GROUP BY 1) s ON s.{key} = p.{key} {join})"""
                )
            both = f"(SELECT h, g, old FROM ga{n} UNION ALL SELECT h, g, old FROM gb{n})"
            ctes.append(f"s{n} AS MATERIALIZED (SELECT sum(g * g / h) AS own, sum(g * old / h) AS cr, max(abs(g)) AS top FROM {both} AS u)")
            if i == steps:
                break
            momentum = "0e0" if i == 0 else f"(SELECT greatest(0e0, (x.own - x.cr) / y.own) FROM s{n} x, s{last} y)"
            for side, key, col, _ in sides:
                ctes.append(f"d{side}{n} AS MATERIALIZED (SELECT {key}, {col}, g, h, g / h + {momentum} * dir AS d FROM g{side}{n})")
                ctes.append(f"x{side}{n} AS (SELECT {key}, {col} + {step_size}e0 * d AS {col} FROM d{side}{n})")
                at[side] = f"x{side}{n}"
        ctes.append(f"wa{t} AS MATERIALIZED (SELECT * FROM {at['a']}), wb{t} AS MATERIALIZED (SELECT * FROM {at['b']})")
        ctes.append(f"top{t} AS (SELECT top AS g FROM s{t}_{steps})")
    return ",\n".join(ctes)


def labels_sql(post: str, hard_score: bool = False) -> str:
    """Decoded labels of a posterior CTE: larger label on ties."""
    score = "CAST(b.z AS DOUBLE)" if hard_score else f"round((SELECT max(p.g) FROM {post} p WHERE p.task_id = b.task_id AND p.z = 1), 6)"
    return f"""SELECT b.task_id, CAST(b.z AS INT) AS label, {score} AS score FROM (
      SELECT task_id, z, row_number() OVER (PARTITION BY task_id ORDER BY round(g, 12) DESC, z DESC) AS rn
      FROM {post}) b WHERE rn = 1"""
