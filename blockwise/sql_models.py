"""The models' results in plain SQL, for comparison: matrices are lists of lists, iterations are recursive tables.

Each function returns common table expressions (to stand after ``WITH RECURSIVE``) over a table of cells.
"""

from __future__ import annotations


def times(m: str, v: str) -> str:
    return f"list_transform({m}, lambda r_: list_dot_product(r_, {v}))"


def scaled(v: str, by: str) -> str:
    return f"list_transform({v}, lambda x_: x_ * ({by}))"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x_: x_ / sqrt(list_dot_product({v}, {v})))"


def less_outer(m: str, a: str, b: str, by: str) -> str:
    """``m - by * a b'``."""
    return f"list_transform({m}, lambda r_, i_: list_transform(r_, lambda x_, j_: x_ - ({by}) * ({a})[i_] * ({b})[j_]))"


def upright(v: str) -> str:
    """The vector with its entry of largest size positive; of equals the first counts."""
    top = f"list_max(list_transform({v}, lambda x_: abs(x_))) * (1 - 1e-9)"
    return scaled(v, f"CASE WHEN list_filter({v}, lambda x_: abs(x_) >= {top})[1] < 0 THEN -1 ELSE 1 END")


def cross_products(cells: str, name: str, row: str = "vec_id") -> str:
    """``name``(m): centred cross-products of the cells (row, i, v), features in the order of ``i``."""
    return f"""{name}_c AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*) AS c FROM {cells} a JOIN {cells} b ON a.{row} = b.{row} GROUP BY 1, 2),
{name} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM {name}_c GROUP BY i))"""


def leading(source: str, name: str, squarings: int = 18) -> str:
    """``name``(l, v): largest eigenvalue and its unit vector, by squaring the matrix ``source``(m) until one direction is left."""
    trace = "list_sum(list_transform(m, lambda r_, i_: r_[i_]))"
    return f"""{name}_p(k, m) AS (SELECT 0, list_transform(m, lambda r_: list_transform(r_, lambda x_: x_ / {trace})) FROM {source}
 UNION ALL SELECT k + 1, list_transform(s, lambda r_: list_transform(r_, lambda x_: x_ / {trace.replace('(m,', '(s,')})) FROM (SELECT k, list_transform(m, lambda a_: list_transform(m, lambda b_: list_dot_product(a_, b_))) AS s FROM {name}_p WHERE k < {squarings})),
{name}_v AS (SELECT {unit('w')} AS v FROM (SELECT m[list_position(d, list_max(d))] AS w FROM (SELECT m, list_transform(m, lambda r_, i_: r_[i_]) AS d FROM {name}_p WHERE k = {squarings}))),
{name} AS (SELECT list_dot_product(u, {times('m', 'u')}) AS l, u AS v FROM (SELECT m, {upright('v')} AS u FROM {name}_v CROSS JOIN {source}))"""


def principal(cells: str, n: int, row: str = "vec_id") -> str:
    """``pc1`` ... (l, v) of the leading components, ``total``(t): the trace."""
    out = [cross_products(cells, "m1", row), "total AS (SELECT list_sum(list_transform(m, lambda r_, i_: r_[i_])) AS t FROM m1)"]
    for a in range(1, n + 1):
        out.append(leading(f"m{a}", f"pc{a}"))
        out.append(f"m{a + 1} AS (SELECT {less_outer('m', 'v', 'v', 'l')} AS m FROM m{a} CROSS JOIN pc{a})")
    return ",\n".join(out)


def pls(cells: str, n: int, row: str = "vec_id") -> str:
    """``w1`` ... (w, p, q, tt): components of PLS2 by NIPALS with one column per label; cells are (row, grp, i, v).

    Weights start from the first label's column and stop where they move by less than 1e-6 (squared), as the operator's do.
    """
    labels = f"lab AS (SELECT grp, row_number() OVER (ORDER BY grp) AS g, count(*) AS n FROM (SELECT DISTINCT {row}, grp FROM {cells}) GROUP BY grp)"
    total = f"(SELECT count(DISTINCT {row}) FROM {cells})"
    xy = f"""xy AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY g) AS r FROM (SELECT t.i, g, coalesce(s, 0) - t.t * n / {total} AS c
 FROM (SELECT i, sum(v) AS t FROM {cells} GROUP BY i) t CROSS JOIN lab LEFT JOIN (SELECT i, grp, sum(v) AS s FROM {cells} GROUP BY 1, 2) u ON u.i = t.i AND u.grp = lab.grp) GROUP BY i))"""
    out = [cross_products(cells, "s0", row), labels, xy, "d1 AS (SELECT m AS s, c FROM s0 CROSS JOIN xy)"]
    for a in range(1, n + 1):
        turned = "list_transform(range(1, len(c[1]) + 1), lambda g_: list_transform(c, lambda r_: r_[g_]))"
        out.append(f"""t{a} AS (SELECT s, c, {turned} AS ct FROM d{a}),
i{a}(k, w, moved) AS (SELECT 1, {unit('ct[1]')}, CAST(1 AS DOUBLE) FROM t{a}
 UNION ALL SELECT k + 1, n_, list_sum(list_transform(n_, lambda x_, j_: (x_ - w[j_]) * (x_ - w[j_]))) FROM (SELECT k, w, {unit('g_')} AS n_ FROM (SELECT k, w, {times('c', times('ct', 'w'))} AS g_ FROM i{a} CROSS JOIN t{a} WHERE moved >= 1e-6 AND k < 500))),
f{a} AS (SELECT {upright('w')} AS w FROM i{a} ORDER BY k DESC LIMIT 1),
w{a} AS (SELECT w, {scaled('sw', '1 / tt')} AS p, {scaled(times('ct', 'w'), '1 / tt')} AS q, tt FROM (SELECT w, ct, sw, list_dot_product(w, sw) AS tt FROM (SELECT w, ct, {times('s', 'w')} AS sw FROM f{a} CROSS JOIN t{a}))),
d{a + 1} AS (SELECT {less_outer('s', 'p', 'p', 'tt')} AS s, {less_outer('c', 'p', 'q', 'tt')} AS c FROM d{a} CROSS JOIN w{a})""")
    return ",\n".join(out)


def multiblock(cells: str, blocks: list[tuple[str, str, list[str]]], design: float = 0.1, row: str = "sample_id") -> str:
    """``lo``(block, feature, loading) and ``va``(row, grp, block, score): one component of the multi-block model with all features kept.

    ``cells`` are (row, grp, block, feature, value); each block comes with a short name and its features in order. The label
    block is one column per label. Blocks are updated in turn until a round moves them by less than 1e-6 in all.
    """
    names = [b[1] for b in blocks] + ["y_"]
    order = "CASE " + " ".join(f"WHEN block = '{b}' AND feature = '{f}' THEN {i}" for b, _, fs in blocks for i, f in enumerate(fs, 1)) + " END"
    ones = f"(SELECT x.{row}, g, CASE WHEN x.grp = lab.grp THEN 1.0 ELSE 0.0 END AS v FROM (SELECT DISTINCT {row}, grp FROM {cells}) x CROSS JOIN lab)"
    short = "CASE block " + " ".join(f"WHEN '{b}' THEN '{s}'" for b, s, _ in blocks) + " END"
    out = [
        f"lab AS (SELECT grp, row_number() OVER (ORDER BY grp) AS g FROM (SELECT DISTINCT grp FROM {cells}))",
        f"all_ AS (SELECT {row}, {short} AS b, {order} AS i, CAST(value AS DOUBLE) AS v FROM {cells} UNION ALL SELECT {row}, 'y_', g, v FROM {ones})",
        f"cr AS (SELECT a.b AS ba, b.b AS bb, a.i, b.i AS j, sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*) AS c FROM all_ a JOIN all_ b ON a.{row} = b.{row} GROUP BY 1, 2, 3, 4)",
        "gs AS (SELECT ba, bb, list(r ORDER BY i) AS m FROM (SELECT ba, bb, i, list(c ORDER BY j) AS r FROM cr GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    ]
    for b in names:
        out.append(f"own_{b} AS (SELECT m FROM gs WHERE ba = '{b}' AND bb = '{b}')")
        out.append(leading(f"own_{b}", f"st_{b}"))
    pairs = [(a, b) for a in names for b in names if a != b]
    out.append("g AS (SELECT " + ", ".join(f"max(CASE WHEN ba = '{a}' AND bb = '{b}' THEN m END) AS {a}_{b}" for a, b in [*pairs, *[(n, n) for n in names]]) + " FROM gs)")

    def step(i: int, inner: str) -> str:
        me = names[i]
        others = [b for b in names if b != me]
        # The sum of the linked blocks' products, entry by entry.
        terms = " + ".join(f"{1.0 if 'y_' in (me, b) else design} * list_dot_product({me}_{b}[e_], {b})" for b in others)
        grad = f"list_transform(range(1, len({me}) + 1), lambda e_: {terms})"
        keep = ", ".join(n for n in names if n != me)
        return f"(SELECT k, {keep}, {unit('d_')} AS {me}, change + list_sum(list_transform({unit('d_')}, lambda x_, j_: (x_ - {me}[j_]) * (x_ - {me}[j_]))) AS change, {', '.join(f'{a}_{b}' for a, b in pairs)} FROM (SELECT *, {grad} AS d_ FROM {inner}))"

    state = ", ".join(names)
    inner = f"(SELECT k + 1 AS k, {state}, CAST(0 AS DOUBLE) AS change, {', '.join(f'{a}_{b}' for a, b in pairs)} FROM it CROSS JOIN g WHERE change >= 1e-6 AND k < 100)"
    for i in range(len(names)):
        inner = step(i, inner)
    out.append(f"it(k, {state}, change) AS (SELECT 0, {', '.join(f'(SELECT v FROM st_{b})' for b in names)}, CAST(1 AS DOUBLE) UNION ALL SELECT k, {state}, change FROM {inner})")
    first = names[0]
    sign = lambda b: f"CASE WHEN list_dot_product({first}, {times(f'{first}_{b}', b)}) >= 0 THEN 1 ELSE -1 END"
    out.append(f"en AS (SELECT {upright(first)} AS {first}, {', '.join(names[1:])}, {', '.join(f'{first}_{b}' for b in names[1:])} FROM (SELECT * FROM it CROSS JOIN g ORDER BY k DESC LIMIT 1))")
    out.append(f"fin AS (SELECT {first}, {', '.join(f'{scaled(b, sign(b))} AS {b}' for b in names[1:])} FROM en)")
    out.append("lo AS (" + " UNION ALL ".join(f"SELECT '{b}' AS block, '{f}' AS feature, {s}[{i}] AS loading FROM fin" for b, s, fs in blocks for i, f in enumerate(fs, 1)) + ")")
    out.append(f"va AS (SELECT {row}, grp, block, sum((value - mid) * loading) AS score FROM (SELECT *, avg(value) OVER (PARTITION BY block, feature) AS mid FROM {cells}) JOIN lo USING (block, feature) GROUP BY 1, 2, 3)")
    return ",\n".join(out)
