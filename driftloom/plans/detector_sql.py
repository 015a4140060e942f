"""The detector in SQL: p-values by joins, wealth by a recursive query."""

from __future__ import annotations

from collections.abc import Callable

from driftloom.functions.theta import theta_sql

FLOOR = "ln(1e-300::DOUBLE)"


def default_bet(p: str) -> str:
    """The default bet on a p-value."""
    c = f"greatest(1e-10::DOUBLE, least(1.0::DOUBLE, {p}))"
    return " + ".join(f"(1.0::DOUBLE/3.0::DOUBLE)*{e}::DOUBLE*pow({c}, {e}::DOUBLE - 1.0::DOUBLE)" for e in (0.7, 0.8, 0.9))


def lse(x: str) -> str:
    """Log-sum-exp of a list."""
    return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))))"


def log_bet(p: str) -> str:
    """The log of the default bet, with a floor."""
    return f"ln(greatest({default_bet(p)}, 1e-300::DOUBLE))"


def spread_sql(n: int, upto: str) -> str:
    """Sample covariances of the ``n`` features x1.. over the rows of the frame ``upto``, with a little added on the diagonal, as c11, c12, .."""
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i, n + 1)]
    return ", ".join(f"covar_samp(x{i}, x{j}) OVER {upto} {'+ 1e-6::DOUBLE ' if i == j else ''}AS c{i}{j}" for i, j in pairs)


def form_sql(n: int, d: str) -> str:
    """The form d' C^-1 d for 2 or 3 features, from the columns of :func:`spread_sql` and the list ``d``."""
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    if n == 2:
        return f"(c22 * {d}[1] * {d}[1] - 2 * c12 * {d}[1] * {d}[2] + c11 * {d}[2] * {d}[2]) / (c11 * c22 - c12 * c12)"

    def minor(i: int, j: int) -> str:
        (r, q), (s, u) = ([m for m in (1, 2, 3) if m != x] for x in (i, j))
        return f"({c(r, s)} * {c(q, u)} - {c(r, u)} * {c(q, s)})"

    det = " + ".join(f"{c(1, j)} * {'-1' if j == 2 else '1'} * {minor(1, j)}" for j in (1, 2, 3))
    terms = " + ".join(f"{d}[{i}] * {d}[{j}] * {'-1' if (i + j) % 2 else '1'} * {minor(i, j)}" for i in (1, 2, 3) for j in (1, 2, 3))
    return f"({terms}) / ({det})"


def distance_sql(metric: str, n: int, x: str, c: str, d: str, rows: str) -> str:
    """The distance of the list ``x`` from the centroid ``c`` (``d`` their difference) over so many ``rows``; Mahalanobis needs the columns c11, .. too."""
    euclid = f"sqrt(list_sum(list_transform({d}, lambda v: v * v)))"
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    s = {
        "euclidean": euclid,
        "chebyshev": f"list_max(list_transform({d}, lambda v: abs(v)))",
        "cosine": f"CASE WHEN {dot(x, x)} * {dot(c, c)} > 0 THEN 1 - {dot(x, c)} / (sqrt({dot(x, x)}) * sqrt({dot(c, c)})) ELSE {euclid} END",
        "mahalanobis": f"CASE WHEN {rows} < 2 THEN {euclid} ELSE sqrt(greatest(0.0::DOUBLE, {form_sql(n, d)})) END",
    }[metric]
    return f"CASE WHEN {rows} < 1 THEN 0.0::DOUBLE ELSE {s} END"


def detector_sql(
    source: str, startup: int, window: int, threshold: float, cooldown: int, alpha: float = 0.5, seed: int = 0, final: str = "trace", ahead: bool = True,
    observed: bool = True, k: int = 3, joint: str | None = None, weights: tuple[float, ...] | None = None, holt: tuple[float, float] | None = None, horizon: int = 1,
    scaled: bool = False, forecasts: str | None = None, with_p: bool = True, bet: Callable[[str], str] = log_bet,
) -> str:
    """The trace of a detector over ``k`` features.

    ``source`` is SQL giving ``series_id, t, k, x`` with t from 0 without gaps.
    ``observed`` and ``ahead`` are the two streams, ``joint`` a metric,
    ``weights`` those of the horizons, ``holt`` the parameters of that forecaster
    in place of the weighted mean, ``scaled`` for features normalised by the
    start-up, ``bet`` the log of a bet on a p-value, ``forecasts`` SQL giving ``series_id, t, k, f`` in place of a
    forecaster. ``final`` chooses the result: ``trace`` or ``alarms``.
    """
    first = max(startup, window)
    horizons = list(range(1, len(weights) + 1)) if weights else [horizon]
    share = [alpha**j for j in range(1, window + 1)]
    listed = ", ".join(f"{w / sum(share)!r}::DOUBLE" for w in share)
    hs = ", ".join(map(str, horizons))
    prior = "(PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sofar = "(PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)"
    zeros = lambda n: "[" + ", ".join(["0.0::DOUBLE"] * n) + "]"
    add = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda z: greatest(z[1] + z[2], {FLOOR}))"
    many = k * len(horizons)
    xs = f"xs0 AS MATERIALIZED ({source}), xs AS MATERIALIZED (SELECT series_id, t::INT AS t, k::INT AS k, x FROM xs0)"
    if scaled:
        xs = f"""xs0 AS MATERIALIZED ({source}), mo AS (SELECT series_id, k, avg(x) AS mu, stddev_samp(x) AS sigma FROM xs0 WHERE t < {startup} GROUP BY 1, 2),
    xs AS MATERIALIZED (SELECT series_id, t::INT AS t, k::INT AS k, (x - mu) / CASE WHEN sigma < 1e-10 THEN 1 ELSE sigma END AS x FROM xs0 JOIN mo USING (series_id, k))"""
    if forecasts:
        fc = f"SELECT series_id, t, k, h, f FROM ({forecasts}) CROSS JOIN (SELECT unnest([{hs}]) AS h) WHERE t >= {first}"
    elif holt:
        a, b = holt
        level = f"({a}::DOUBLE * q.l + {1.0 - a!r}::DOUBLE * (p.l + p.d))"
        fold = f"""list_reduce(list_prepend({{'l': w[1], 'd': w[2] - w[1]}}, list_transform(w[2:], lambda v: {{'l': v, 'd': 0.0::DOUBLE}})),
            lambda p, q: {{'l': {level}, 'd': {b}::DOUBLE * ({level} - p.l) + {1.0 - b!r}::DOUBLE * p.d}})"""
        fc = f"""SELECT series_id, t, k, h, st.l + h * st.d AS f FROM (SELECT series_id, t, k, {fold} AS st FROM (SELECT series_id, t, k,
            list(x) OVER (PARTITION BY series_id, k ORDER BY t ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS w FROM xs) WHERE t >= {first}) CROSS JOIN (SELECT unnest([{hs}]) AS h)"""
    else:
        fc = f"""SELECT a.series_id, a.t, a.k, h, sum(wt.w * b.x) AS f FROM sc a JOIN (SELECT unnest([{listed}]) AS w, unnest(range({window})) AS j) wt ON true
        JOIN xs b ON b.series_id = a.series_id AND b.k = a.k AND b.t = a.t - wt.j CROSS JOIN (SELECT unnest([{hs}]) AS h) WHERE a.t >= {first} GROUP BY 1, 2, 3, 4"""
    rank = lambda s, of: (
        f"count(b.t) AS n, count(CASE WHEN b.{of} > a.{s} THEN 1 END) AS gt, count(CASE WHEN b.{of} = a.{s} THEN 1 END) AS eq, count(CASE WHEN b.{of} >= a.{s} THEN 1 END) AS ge"
    )
    smooth = lambda j: f"CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE (gt + {theta_sql(seed, 'series_id', 't', j)} * (1 + eq)) / (n + 1)::DOUBLE END"
    body = f"""
    WITH RECURSIVE {xs},
    cs AS (SELECT *, sum(x) OVER (PARTITION BY series_id, k ORDER BY t) AS upto,
        sum(x) OVER (PARTITION BY series_id, k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM xs),
    sc AS MATERIALIZED (SELECT series_id, t, k, x, abs(x - CASE WHEN t > 0 THEN before / t::DOUBLE END) AS s, upto / (t + 1)::DOUBLE AS c FROM cs WHERE t >= {startup}),
    fc AS MATERIALIZED ({fc}),
    pt AS (SELECT fc.*, abs(fc.f - sc.c) AS sf FROM fc JOIN sc USING (series_id, t, k)),
    pv AS (SELECT *, {smooth("k")} AS p FROM (SELECT a.series_id, a.t, a.k, {rank("s", "s")} FROM sc a
        LEFT JOIN sc b ON a.series_id = b.series_id AND a.k = b.k AND b.t < a.t GROUP BY 1, 2, 3)),
    ph_ AS (SELECT *, (ge + 1)::DOUBLE / (n + 1)::DOUBLE AS p FROM (SELECT a.series_id, a.t, a.k, a.h, {rank("sf", "s")} FROM pt a
        LEFT JOIN sc b ON a.series_id = b.series_id AND a.k = b.k AND b.t < a.t GROUP BY 1, 2, 3, 4)),
    now_ AS (SELECT series_id, t, list(p ORDER BY k) AS pl, list({bet("p")} ORDER BY k) AS lg FROM pv GROUP BY 1, 2),
    next_ AS (SELECT series_id, t, list(p ORDER BY h, k) AS phl, list({bet("p")} ORDER BY h, k) AS lgh FROM ph_ GROUP BY 1, 2)"""
    extra, extra_join = "NULL::DOUBLE AS jl, NULL::DOUBLE AS jlh", ""
    if joint:
        wide = ", ".join(f"x[{i}] AS x{i}" for i in range(1, k + 1))
        spread = joint == "mahalanobis"
        body += f""",
    v0 AS (SELECT series_id, t, list(x ORDER BY k) AS x, list(coalesce(before / t::DOUBLE, 0) ORDER BY k) AS c0, list(upto / (t + 1)::DOUBLE ORDER BY k) AS c1 FROM cs GROUP BY 1, 2),
    v1 AS (SELECT *, {wide} FROM v0),
    v2 AS (SELECT *, list_transform(list_zip(x, c0), lambda z: z[1] - z[2]) AS d{", " + spread_sql(k, prior) if spread else ""} FROM v1),
    js AS MATERIALIZED (SELECT series_id, t, {distance_sql(joint, k, "x", "c0", "d", "t")} AS s FROM v2),
    f0 AS (SELECT series_id, t, list(f ORDER BY k) AS f FROM fc WHERE h = {horizons[-1]} GROUP BY 1, 2),
    f1 AS (SELECT *{", " + spread_sql(k, sofar) if spread else ""} FROM v1),
    f2 AS (SELECT f1.*, f, list_transform(list_zip(f, c1), lambda z: z[1] - z[2]) AS d FROM f1 JOIN f0 USING (series_id, t)),
    jf AS MATERIALIZED (SELECT series_id, t, {distance_sql(joint, k, "f", "c1", "d", "(t + 1)")} AS s FROM f2),
    pool AS (SELECT * FROM js WHERE t >= {startup}),
    jp AS (SELECT series_id, t, {bet(smooth(str(k)))} AS jl FROM (SELECT a.series_id, a.t, {rank("s", "s")} FROM pool a
        LEFT JOIN pool b ON a.series_id = b.series_id AND b.t < a.t GROUP BY 1, 2)),
    jh_ AS (SELECT series_id, t, {bet("(ge + 1)::DOUBLE / (n + 1)::DOUBLE")} AS jlh FROM (SELECT a.series_id, a.t, {rank("s", "s")} FROM jf a
        LEFT JOIN pool b ON a.series_id = b.series_id AND b.t < a.t GROUP BY 1, 2))"""
        extra, extra_join = "jl, jlh", " LEFT JOIN jp USING (series_id, t) LEFT JOIN jh_ USING (series_id, t)"
    mixed = "ph_now"
    if weights:
        parts = ", ".join(f"ph_now[{i * k} + j] + ln({w}::DOUBLE)" for i, w in enumerate(weights) if w > 0)
        mixed = f"list_transform(range(1, {k + 1}), lambda j: {lse(f'[{parts}]')})"
    total, total_h = ("ja_now", "jh_now") if joint else (lse("pa_now"), lse("hz"))
    body += f""",
    bets AS MATERIALIZED (SELECT series_id, t, pl, lg, phl, coalesce(lgh, {zeros(many)}) AS lgh, {extra} FROM now_ LEFT JOIN next_ USING (series_id, t){extra_join}),
    fold AS (
        SELECT series_id, {startup - 1}::INT AS t, {zeros(k)} AS a, {zeros(many)} AS h, 0.0::DOUBLE AS ja, 0.0::DOUBLE AS jh, {zeros(k)} AS pa, {zeros(k)} AS ph,
            {-cooldown - 1}::INT AS last, NULL::DOUBLE AS sa, NULL::DOUBLE AS sh, false AS fired, NULL::VARCHAR AS fired_by FROM bets WHERE t = {startup}
        UNION ALL
        SELECT series_id, t, CASE WHEN fired THEN {zeros(k)} ELSE pa_now END, CASE WHEN fired THEN {zeros(many)} ELSE ph_now END,
            CASE WHEN fired THEN 0 ELSE ja_now END, CASE WHEN fired THEN 0 ELSE jh_now END, pa_now, hz, CASE WHEN fired THEN t ELSE last END, sa, sh, fired, fired_by
        FROM (SELECT *, ready AND (coalesce(sa >= lam, false) OR coalesce(sh >= lam, false)) AS fired,
                CASE WHEN ready AND coalesce(sa >= lam, false) THEN 'traditional' WHEN ready AND coalesce(sh >= lam, false) THEN 'horizon' END AS fired_by
            FROM (SELECT *, CASE WHEN {str(observed).lower()} THEN {total} END AS sa, CASE WHEN {str(ahead).lower()} AND t >= {first} THEN {total_h} END AS sh,
                    t - last > {cooldown} AS ready, ln({threshold}::DOUBLE) AS lam
                FROM (SELECT *, CASE WHEN {str(ahead).lower()} AND t >= {first} THEN {mixed} ELSE {"h_before" if weights else "ph_now"} END AS hz
                    FROM (SELECT f.series_id, b.t::INT AS t, f.last, {"f.ph AS h_before, " if weights else ""}
                            {add("f.a", "b.lg") if observed else "f.a"} AS pa_now,
                            CASE WHEN {str(ahead).lower()} AND b.t >= {first} THEN {add("f.h", "b.lgh")} ELSE f.h END AS ph_now,
                            {"greatest(f.ja + b.jl, " + FLOOR + ")" if joint and observed else "f.ja"} AS ja_now,
                            CASE WHEN {str(bool(joint) and ahead).lower()} AND b.t >= {first} THEN greatest(f.jh + b.jlh, {FLOOR}) ELSE f.jh END AS jh_now
                        FROM fold f JOIN bets b ON b.series_id = f.series_id AND b.t = f.t + 1))))
    ),
    steps AS (SELECT DISTINCT series_id, t FROM xs)"""
    if final == "alarms":
        of = "CASE WHEN fired_by = 'horizon' THEN ph ELSE pa END"
        return body + f"""
    SELECT series_id, t, fired_by, (list_position(m, list_max(m)) - 1)::INT AS driver,
        round(100.0::DOUBLE / list_sum(list_transform(m, lambda v: exp(v - list_max(m)))), 6) AS driver_pct
    FROM (SELECT *, {of} AS m FROM fold WHERE fired)"""
    each = ", ".join(f"coalesce(round(f.pa[{i + 1}], 6), 0) AS logm_{i}, coalesce(round(f.ph[{i + 1}], 6), 0) AS logmh_{i}" for i in range(k))
    if with_p:
        last = k * (len(horizons) - 1)
        each += "".join(f", round(b.pl[{i + 1}], 9) AS p_{i}, round(b.phl[{last + i + 1}], 9) AS ph_{i}" for i in range(k))
    return body + f"""
    SELECT s.series_id, s.t, round(f.sa, 6) AS logm_trad, round(f.sh, 6) AS logm_hrzn, {each}, coalesce(f.fired, false) AS fired, f.fired_by
    FROM steps s LEFT JOIN fold f ON s.series_id = f.series_id AND s.t = f.t LEFT JOIN bets b ON b.series_id = s.series_id AND b.t = s.t"""
