"""SQL re-statements of the fitted regimes: clusters, decoding with a given model, and steps of its estimation, as recursive CTEs."""

from __future__ import annotations

from ..operators import regime as rg
from ..operators.regime_models import COV_FLOOR, EM_TOLERANCE, LLOYD_STEPS, LLOYD_TOLERANCE, TINY
from .common import cte
from .decision_sql import NAME
from .price_sql import full, rows

D = len(rg.HMM_FEATURES)
S = range(3)
#: The given model: chances of the first state and of moves, and by state the mean and covariance of the three standardised features.
START = (0.3, 0.4, 0.3)
TRANS = (0.92, 0.06, 0.02, 0.04, 0.9, 0.06, 0.03, 0.07, 0.9)
MEAN = ((-0.8, 0.7, 0.4), (0.1, -0.5, -0.4), (0.7, 0.1, 0.3))
COV = (
    (1.2, -0.3, 0.1, -0.3, 1.1, 0.4, 0.1, 0.4, 0.9),
    (0.5, 0.05, 0.0, 0.05, 0.4, 0.1, 0.0, 0.1, 0.3),
    (0.8, 0.2, 0.1, 0.2, 0.9, 0.3, 0.1, 0.3, 0.8),
)


def numbers(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def rule_ctes(p: str, source: str) -> None:
    """<p>ruled: the rule's regime of each bar of `source`."""
    wide = full("quantile_cont", "w12", 252, 60).replace("quantile_cont(w12)", "quantile_cont(w12, 0.2)")
    cte(
        f"{p}ruled",
        f"""SELECT *, CASE WHEN coalesce(w12 < {wide}, FALSE) THEN 1 WHEN close > MA_200 AND MA_50 > MA_200 THEN 2 WHEN close > MA_200 THEN 1 ELSE 0 END AS rule_code
FROM (SELECT *, round(BB_Width, 12) AS w12 FROM {source})""",
    )


def marked(p: str, source: str, columns, least: int, train: str = "TRUE") -> None:
    """<p>mark: the bars with what a model may use and learn from; <p>x: standardised features of the used ones, numbered."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    rule_ctes(p, source)
    cte(
        f"{p}mark",
        f"""SELECT *, use_ AND {train} AS fit_, count(*) FILTER (WHERE use_ AND {train}) OVER (PARTITION BY instrument) >= {least} AS enough FROM (SELECT *, {whole} AS use_ FROM {p}ruled)""",
    )
    of = lambda agg, c: f"{agg}({c}) FILTER (WHERE fit_) OVER (PARTITION BY instrument)"
    z = ", ".join(f"({c} - {of('avg', c)}) / coalesce(nullif({of('stddev_pop', c)}, 0), 1)" for c in columns)
    cte(
        f"{p}x",
        f"""SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) AS t, count(*) OVER (PARTITION BY instrument) AS n
FROM (SELECT instrument, date, Return_5d, fit_, [{z}] AS x FROM {p}mark WHERE use_ AND enough)""",
    )


def nearest(c0: str, c1: str, c2: str, d: int) -> str:
    gap = lambda c: "(" + " + ".join(f"(x[{j}] - {c}[{j}]) * (x[{j}] - {c}[{j}])" for j in range(1, d + 1)) + ")"
    g = [gap(c) for c in (c0, c1, c2)]
    return f"CASE WHEN {g[0]} <= {g[1]} AND {g[0]} <= {g[2]} THEN 0 WHEN {g[1]} <= {g[2]} THEN 1 ELSE 2 END"


def lloyd_ctes(p: str, d: int) -> None:
    """<p>centers: c0, c1, c2 of each instrument, from the fit rows of <p>x."""
    mean = lambda g, k: "[" + ", ".join(f"avg(x[{j}]) FILTER (WHERE {g} = {k})" for j in range(1, d + 1)) + "]"
    cte(f"{p}thirds", f"SELECT instrument, x, ntile(3) OVER (PARTITION BY instrument ORDER BY x) - 1 AS g FROM {p}x WHERE fit_")
    firsts = ", ".join(f"{mean('g', k)} AS c{k}" for k in S)
    moved = ", ".join(
        "[" + ", ".join(f"coalesce(avg(x[{j}]) FILTER (WHERE label = {k}), any_value(c{k}[{j}]))" for j in range(1, d + 1)) + f"] AS n{k}" for k in S
    )
    gap = "greatest(" + ", ".join(f"abs(n{k}[{j}] - c{k}[{j}])" for k in S for j in range(1, d + 1)) + ")"
    olds = ", ".join(f"any_value(c{k}) AS c{k}" for k in S)
    cte(
        f"{p}lloyd",
        f"""--recursive
SELECT instrument, 0 AS step, FALSE AS done, {firsts} FROM {p}thirds GROUP BY instrument UNION ALL
SELECT instrument, step + 1, {gap} < {LLOYD_TOLERANCE!r}, n0, n1, n2 FROM (SELECT instrument, step, {olds}, {moved}
 FROM (SELECT l.*, r.x, {nearest('c0', 'c1', 'c2', d)} AS label FROM {p}lloyd l JOIN {p}thirds r USING (instrument) WHERE NOT done AND step < {LLOYD_STEPS}) GROUP BY instrument, step)""",
    )
    cte(f"{p}centers", f"SELECT instrument, c0, c1, c2 FROM {p}lloyd QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY step DESC) = 1")


def ordered_ctes(p: str, states: str) -> None:
    """<p>ord: rows of `states` (state, Return_5d, fit_) with the state's rank by mean return of the fit rows."""
    less = lambda s, u: f"CAST(m{u} < m{s} OR (m{u} = m{s} AND {u} < {s}) AS INT)"
    means = ", ".join(f"coalesce(avg(Return_5d) FILTER (WHERE state = {s} AND fit_) OVER (PARTITION BY instrument), 'infinity'::DOUBLE) AS m{s}" for s in S)
    ranks = ", ".join(" + ".join(less(s, u) for u in S if u != s) + f" AS r{s}" for s in S)
    cte(f"{p}ord", f"SELECT *, CASE state WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS Regime FROM (SELECT *, {ranks} FROM (SELECT *, {means} FROM {states}))")


def kmeans_ctes(p: str, source: str, train: str = "TRUE") -> None:
    """<p>kmeans: Regime and Regime_Label of every bar of `source`."""
    columns = rg.KMEANS_FEATURES
    marked(p, source, columns, rg.KMEANS_LEAST, train)
    lloyd_ctes(p, len(columns))
    cte(f"{p}state", f"SELECT x.*, {nearest('c0', 'c1', 'c2', len(columns))} AS state FROM {p}x x JOIN {p}centers USING (instrument)")
    ordered_ctes(p, f"{p}state")
    counts = ", ".join(f"sum(CAST(Regime = {k} AS INT)) OVER {rows(5)} AS n{k}" for k in S)
    cte(f"{p}mode", f"SELECT instrument, date, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS code FROM (SELECT *, {counts} FROM {p}ord)")
    cte(
        f"{p}kmeans",
        f"""SELECT *, {NAME.format('Regime')} AS Regime_Label FROM (SELECT m.*, CASE WHEN enough THEN coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING), 1) ELSE rule_code END AS Regime
FROM {p}mark m LEFT JOIN {p}mode USING (instrument, date))""",
    )


# ---- hidden Markov model: tables of instrument, s (3), t (9), u0..u2 (means), v0..v2 (covariances) ----


def given_ctes(p: str) -> None:
    fixed = ", ".join([f"{numbers(START)} AS s", f"{numbers(TRANS)} AS t"] + [f"{numbers(MEAN[k])} AS u{k}, {numbers(COV[k])} AS v{k}" for k in S])
    cte(f"{p}model", f"SELECT DISTINCT instrument, {fixed} FROM {p}x")


def densities(p: str, model: str, points: str, q: str) -> None:
    """<q>e: points with log densities l and, scaled by their largest, b; m is that largest one."""
    shapes = []
    for k in S:
        v = lambda i, j, k=k: f"v{k}[{D * i + j + 1}]"
        minor = lambda a, b, c, d: f"({v(*a)} * {v(*d)} - {v(*b)} * {v(*c)})"
        adj = [
            minor((1, 1), (1, 2), (2, 1), (2, 2)), f"-{minor((0, 1), (0, 2), (2, 1), (2, 2))}", minor((0, 1), (0, 2), (1, 1), (1, 2)),
            minor((0, 0), (0, 2), (2, 0), (2, 2)), f"-{minor((0, 0), (0, 2), (1, 0), (1, 2))}", minor((0, 0), (0, 1), (1, 0), (1, 1)),
        ]
        det = f"({v(0, 0)} * {adj[0]} + {v(0, 1)} * ({adj[1]}) + {v(0, 2)} * {adj[2]})"
        shapes.append(f"{det} AS det{k}, [{', '.join(adj)}] AS a{k}")
    cte(f"{q}shape", f"SELECT *, {', '.join(shapes)} FROM {model}")

    def density(k: int) -> str:
        g = [f"(x[{i + 1}] - u{k}[{i + 1}])" for i in range(D)]
        a = [f"a{k}[{i}]" for i in range(1, 7)]
        form = f"{a[0]}*{g[0]}*{g[0]} + {a[3]}*{g[1]}*{g[1]} + {a[5]}*{g[2]}*{g[2]} + 2*({a[1]}*{g[0]}*{g[1]} + {a[2]}*{g[0]}*{g[2]} + {a[4]}*{g[1]}*{g[2]})"
        return f"-0.5::DOUBLE * (ln(det{k}) + {D} * ln(2 * pi()) + ({form}) / det{k})"

    cte(f"{q}l", f"SELECT r.instrument, r.date, r.t AS pos, r.n, r.x, [{', '.join(density(k) for k in S)}] AS l FROM {points} r JOIN {q}shape h USING (instrument)")
    cte(f"{q}e", f"SELECT *, [exp(l[1] - m), exp(l[2] - m), exp(l[3] - m)] AS b FROM (SELECT *, greatest(l[1], l[2], l[3]) AS m FROM {q}l)")


def passes(model: str, q: str) -> None:
    """<q>f and <q>k: forward and backward shares; <q>g: posteriors; <q>like: log likelihood."""
    first = ", ".join(f"s[{j}] * b[{j}]" for j in (1, 2, 3))
    into = lambda j: f"(a[1] * t[{j}] + a[2] * t[{3 + j}] + a[3] * t[{6 + j}]) * b[{j}]"
    share = "[r[1] / (r[1] + r[2] + r[3]), r[2] / (r[1] + r[2] + r[3]), r[3] / (r[1] + r[2] + r[3])]"
    cte(
        f"{q}f",
        f"""--recursive
SELECT instrument, pos, {share} AS a, ln(r[1] + r[2] + r[3]) + m AS part FROM (SELECT e.*, [{first}] AS r FROM {q}e e JOIN {model} USING (instrument) WHERE pos = 1) UNION ALL
SELECT instrument, pos, {share}, ln(r[1] + r[2] + r[3]) + m FROM (SELECT e.instrument, e.pos, e.m, [{into(1)}, {into(2)}, {into(3)}] AS r FROM {q}f f JOIN {q}e e ON e.instrument = f.instrument AND e.pos = f.pos + 1 JOIN {model} o ON o.instrument = e.instrument)""",
    )
    out = lambda i: f"t[{3 * i + 1}] * b[1] * c[1] + t[{3 * i + 2}] * b[2] * c[2] + t[{3 * i + 3}] * b[3] * c[3]"
    even = "[1.0::DOUBLE / 3, 1.0::DOUBLE / 3, 1.0::DOUBLE / 3]"
    cte(
        f"{q}k",
        f"""--recursive
SELECT instrument, pos, {even} AS c FROM {q}e WHERE pos = n UNION ALL
SELECT instrument, pos, {share} FROM (SELECT k.instrument, k.pos - 1 AS pos, [{out(0)}, {out(1)}, {out(2)}] AS r FROM {q}k k JOIN {q}e e ON e.instrument = k.instrument AND e.pos = k.pos JOIN {model} o ON o.instrument = k.instrument WHERE k.pos > 1)""",
    )
    cte(f"{q}g", f"SELECT instrument, pos, {share} AS g FROM (SELECT instrument, pos, [a[1] * c[1], a[2] * c[2], a[3] * c[3]] AS r FROM {q}f JOIN {q}k USING (instrument, pos))")
    cte(f"{q}like", f"SELECT instrument, sum(part) AS like_ FROM {q}f GROUP BY instrument")


def decode_ctes(p: str) -> None:
    """<p>dec: used rows with the best path's state and the posteriors p0..p2, by <p>model."""
    densities(p, f"{p}model", f"{p}x", p)
    passes(f"{p}model", p)
    came = lambda i, j: f"(d[{i}] + ln(t[{3 * (i - 1) + j}]))"
    pick = lambda a, b, c: f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"
    cte(
        f"{p}v",
        f"""--recursive
SELECT e.instrument, pos, [{', '.join(f'ln(s[{j}]) + l[{j}]' for j in (1, 2, 3))}] AS d, [0, 0, 0] AS back FROM {p}e e JOIN {p}model USING (instrument) WHERE pos = 1 UNION ALL
SELECT e.instrument, e.pos, [{', '.join(f'greatest({came(1, j)}, {came(2, j)}, {came(3, j)}) + l[{j}]' for j in (1, 2, 3))}], [{', '.join(pick(came(1, j), came(2, j), came(3, j)) for j in (1, 2, 3))}]
FROM {p}v v JOIN {p}e e ON e.instrument = v.instrument AND e.pos = v.pos + 1 JOIN {p}model o ON o.instrument = e.instrument""",
    )
    cte(
        f"{p}path",
        f"""--recursive
SELECT v.instrument, v.pos, {pick('d[1]', 'd[2]', 'd[3]')} AS state FROM {p}v v JOIN {p}e e ON e.instrument = v.instrument AND e.pos = v.pos WHERE v.pos = e.n UNION ALL
SELECT w.instrument, w.pos - 1, v.back[w.state + 1] FROM {p}path w JOIN {p}v v ON v.instrument = w.instrument AND v.pos = w.pos WHERE w.pos > 1""",
    )
    cte(
        f"{p}dec",
        f"""SELECT x.instrument, x.date, x.Return_5d, x.fit_, w.state, g[1] AS p0, g[2] AS p1, g[3] AS p2
FROM {p}x x JOIN {p}path w ON w.instrument = x.instrument AND w.pos = x.t JOIN {p}g g ON g.instrument = x.instrument AND g.pos = x.t""",
    )


def hmm_ctes(p: str, source: str, train: str = "TRUE") -> None:
    """<p>hmm: Regime, its label and the two probabilities of every bar of `source`, by the given model."""
    marked(p, source, rg.HMM_FEATURES, rg.HMM_LEAST, train)
    given_ctes(p)
    decode_ctes(p)
    ordered_ctes(p, f"{p}dec")
    prob = lambda code: f"CASE WHEN r0 = {code} THEN p0 WHEN r1 = {code} THEN p1 ELSE p2 END"
    cte(f"{p}named", f"SELECT instrument, date, Regime AS code, {prob(0)} AS bear, {prob(2)} AS bull FROM {p}ord")
    both = lambda c: (
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    )
    cte(
        f"{p}hmm",
        f"""SELECT *, {NAME.format('Regime')} AS Regime_Label FROM (SELECT m.*, CASE WHEN enough THEN {both('code')} ELSE rule_code END AS Regime,
{both('bear')} AS Regime_Prob_Bear, {both('bull')} AS Regime_Prob_Bull FROM {p}mark m LEFT JOIN {p}named USING (instrument, date))""",
    )


def em_ctes(p: str, steps: int) -> None:
    """<p>fit0 .. <p>fit<steps>: the model after each step of its estimation on the fit rows of <p>x."""
    lloyd_ctes(p, D)
    cov = "[" + ", ".join(f"covar_samp(x[{i}], x[{j}])" + (f" + {COV_FLOOR}" if i == j else "") for i in (1, 2, 3) for j in (1, 2, 3)) + "]"
    third = "1.0::DOUBLE / 3"
    cte(
        f"{p}fit0",
        f"""SELECT instrument, [{', '.join([third] * 3)}] AS s, [{', '.join([third] * 9)}] AS t, c0 AS u0, c1 AS u1, c2 AS u2, v AS v0, v AS v1, v AS v2, 0.0::DOUBLE AS like_, 0 AS steps, FALSE AS done
FROM {p}centers JOIN (SELECT instrument, {cov} AS v FROM {p}x WHERE fit_ GROUP BY instrument) USING (instrument)""",
    )
    cte(f"{p}learn", f"SELECT instrument, date, x, row_number() OVER (PARTITION BY instrument ORDER BY date) AS t, count(*) OVER (PARTITION BY instrument) AS n FROM {p}x WHERE fit_")
    for step in range(steps):
        q, model = f"{p}s{step}", f"{p}fit{step}"
        densities(p, model, f"{p}learn", q)
        passes(model, q)
        raw = [f"a[{i}] * t[{3 * (i - 1) + j}] * b[{j}] * c[{j}]" for i in (1, 2, 3) for j in (1, 2, 3)]
        cte(
            f"{q}moves",
            f"""SELECT instrument, [{', '.join(f'sum(w[{k}] / list_sum(w))' for k in range(1, 10))}] AS moved FROM (SELECT f.instrument, [{', '.join(raw)}] AS w
FROM {q}f f JOIN {q}e e ON e.instrument = f.instrument AND e.pos = f.pos + 1 JOIN {q}k k ON k.instrument = f.instrument AND k.pos = f.pos + 1 JOIN {model} o ON o.instrument = f.instrument) GROUP BY instrument""",
        )
        sums = []
        for k in S:
            g = f"g[{k + 1}]"
            sums.append(f"sum({g}) AS w{k}")
            sums += [f"sum({g} * x[{i}]) AS y{k}_{i}" for i in (1, 2, 3)]
            sums += [f"sum({g} * (x[{i}] * x[{j}])) AS q{k}_{i}{j}" for i in (1, 2, 3) for j in range(i, 4)]
        cte(f"{q}sums", f"SELECT g.instrument, any_value(g) FILTER (WHERE g.pos = 1) AS s1, {', '.join(sums)} FROM {q}g g JOIN {q}e e USING (instrument, pos) GROUP BY g.instrument")
        mean = lambda k, i: f"(y{k}_{i} / (w{k} + {TINY!r}))"

        def cell(k: int, i: int, j: int) -> str:
            a, b = min(i, j), max(i, j)
            floor = f" + {COV_FLOOR}" if i == j else ""
            return f"(q{k}_{a}{b} - {mean(k, i)} * y{k}_{j} - {mean(k, j)} * y{k}_{i} + {mean(k, i)} * {mean(k, j)} * w{k}{floor}) / (w{k} + {TINY!r})"

        new = {
            "s": "s1",
            "t": "[" + ", ".join(f"(moved[{3 * i + j}] + {TINY!r}) / (moved[{3 * i + 1}] + moved[{3 * i + 2}] + moved[{3 * i + 3}] + 3 * {TINY!r})" for i in S for j in (1, 2, 3)) + "]",
            **{f"u{k}": f"[{', '.join(mean(k, i) for i in (1, 2, 3))}]" for k in S},
            **{f"v{k}": f"[{', '.join(cell(k, i, j) for i in (1, 2, 3) for j in (1, 2, 3))}]" for k in S},
        }
        gained = f"(steps = 0 OR e.like_ - o.like_ >= {EM_TOLERANCE!r})"
        chosen = ", ".join(f"CASE WHEN NOT done AND {gained} THEN {v} ELSE o.{c} END AS {c}" for c, v in new.items())
        cte(
            f"{p}fit{step + 1}",
            f"""SELECT o.instrument, {chosen}, CASE WHEN done THEN o.like_ ELSE e.like_ END AS like_, CASE WHEN done THEN steps ELSE steps + 1 END AS steps, done OR NOT {gained} AS done
FROM {model} o JOIN {q}like e USING (instrument) JOIN {q}sums USING (instrument) LEFT JOIN {q}moves USING (instrument)""",
        )
