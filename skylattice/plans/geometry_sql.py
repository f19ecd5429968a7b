"""Pieces of SQL for the oracle: pixel geometry by the planar projection, the distance ansatz, and the fixtures with distance."""

from __future__ import annotations

from .fixtures import FLAT

#: Deepest order of the bits that are taken apart.
_BITS = 9


def _bits(p: str, odd: int) -> str:
    return "(" + " + ".join(f"((({p}) >> {2 * j + odd}) & 1) * {1 << j}" for j in range(_BITS)) + ")"


def _angles(t: str, v: str) -> tuple[str, str]:
    """(z, phi) of a point of the plane; phi of a pole is 0."""
    turn = f"(({t}) + 8 - 4 * floor((({t}) + 8) / 4))"
    sigma = f"(2 * (1 - abs({v})))"
    z = f"(CASE WHEN abs({v}) <= 0.5 THEN 4 * ({v}) / 3 ELSE sign({v}) * (1 - {sigma} * {sigma} / 3) END)"
    phi = f"(CASE WHEN abs({v}) <= 0.5 THEN {turn} WHEN abs({v}) > 0.9999999 THEN 0 ELSE floor({turn}) + 0.5 + ({turn} - floor({turn}) - 0.5) / {sigma} END * pi() / 2)"
    return z, phi


def cells(source: str, dx: str = "0.5", dy: str = "0.5") -> str:
    """``source`` (with k, p: order and nested pixel) with z and phi of a point of each pixel, by default its centre."""
    z, phi = _angles("t", "v")
    return f"""(SELECT * EXCLUDE (t, v, base, x, y, n), {z} AS z, {phi} AS phi FROM (
        SELECT *, ((CASE WHEN base BETWEEN 4 AND 7 THEN base % 4 ELSE base % 4 + 0.5 END) + (x + {dx} - y - {dy}) / (2 * n))::DOUBLE AS t,
               ((CASE WHEN base < 4 THEN 0.5 WHEN base < 8 THEN 0 ELSE -0.5 END) + (x + {dx} + y + {dy}) / (2 * n) - 0.5)::DOUBLE AS v
        FROM (SELECT *, p // (n * n)::BIGINT AS base, {_bits('p % (n * n)::BIGINT', 0)} AS x, {_bits('p % (n * n)::BIGINT', 1)} AS y FROM (SELECT *, pow(2, k)::DOUBLE AS n FROM {source}))))"""


def corners(order: int) -> str:
    """(p, key) of the four corners of all pixels of an order; pixels that share a key are neighbours."""
    own = f"(SELECT {order} AS k, p, d FROM range({12 * 4**order}) r(p), range(4) s(d))"
    return f"(SELECT p, (round(z, 6) + 0.0)::VARCHAR || ':' || (round(round(phi / (pi() / 2), 6) % 4 * (abs(z) < 0.999999)::INT, 6) + 0.0)::VARCHAR AS key FROM {cells(own, '(d % 2)', '(d // 2)')})"


def lookup(source: str, order: int) -> str:
    """``source`` (with z, phi) with p, the nested pixel of an order that holds each direction."""
    n = 1 << order
    spread = lambda c, odd: " + ".join(f"((({c}) >> {j}) & 1) * {1 << (2 * j + odd)}" for j in range(order)) or "0"
    return f"""(SELECT * EXCLUDE (t, s, tt, vv, ia, ib, fa, fb, base, x, y), base * {n * n} + {spread('x', 0)} + {spread('y', 1)} AS p FROM (
        SELECT *, least(greatest(ia - fa * {n}, 0), {n - 1}) AS x, least(greatest({n - 1} - (ib - fb * {n}), 0), {n - 1}) AS y,
               CASE WHEN fa = fb THEN 4 + fa % 4 WHEN fa > fb THEN fb % 4 ELSE 8 + fa % 4 END AS base FROM (
        SELECT * REPLACE (least(fa, fb + 1) AS fa, least(fb, fa + 1) AS fb) FROM (
        SELECT *, ia // {n} AS fa, ib // {n} AS fb FROM (
        SELECT *, floor((0.5 + tt + vv) * {n})::BIGINT AS ia, floor((0.5 + tt - vv) * {n})::BIGINT AS ib FROM (
        SELECT *, CASE WHEN abs(z) > 2.0 / 3 THEN floor(t) + 0.5 + (t - floor(t) - 0.5) * least(s, 1) ELSE t END AS tt, CASE WHEN abs(z) > 2.0 / 3 THEN sign(z) * (1 - s / 2) ELSE 0.75 * z END AS vv FROM (
        SELECT *, (phi / (pi() / 2))::DOUBLE AS t, sqrt(3 * (1 - abs(z)))::DOUBLE AS s FROM {source})))))))"""


def weights(order: int, order_out: int) -> str:
    """(o, p, w): weight of pixel p of an order in the bilinear value at the centre of pixel o of another; rings by their heights."""
    return f"""(WITH own AS (SELECT p, round(z, 9) AS h, z, phi FROM {cells(f'(SELECT {order} AS k, p FROM range({12 * 4**order}) r(p))')}),
        pix AS (SELECT p, z, dense_rank() OVER (ORDER BY h DESC) AS ring, row_number() OVER (PARTITION BY h ORDER BY phi) - 1 AS nth, count(*) OVER (PARTITION BY h) AS n, min(phi) OVER (PARTITION BY h) AS phi0 FROM own),
        rings AS (SELECT ring, max(z) AS rz, max(n) AS n, max(phi0) AS phi0 FROM pix GROUP BY 1), most AS (SELECT max(ring) AS last FROM rings),
        target AS (SELECT p AS o, z, phi, (SELECT count(*) FROM rings WHERE rz >= t.z - 1e-12) AS u FROM {cells(f'(SELECT {order_out} AS k, p FROM range({12 * 4**order_out}) r(p))')} t),
        part AS (SELECT o, phi, u, last, (coalesce(a.rz, 1) - z) / (coalesce(a.rz, 1) - coalesce(b.rz, -1)) AS down FROM target, most LEFT JOIN rings a ON a.ring = u LEFT JOIN rings b ON b.ring = u + 1),
        two AS (SELECT o, phi, u AS ring, 1 - down AS w FROM part WHERE u >= 1 UNION ALL SELECT o, phi, u + 1, down FROM part WHERE u < last),
        place AS (SELECT o, r.ring, n, w, (phi - phi0) / (2 * pi() / n) AS x FROM two JOIN rings r USING (ring)),
        found AS (SELECT o, ring, ((floor(x)::BIGINT + j) % n + n) % n AS nth, w * (CASE j WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM place, range(2) t(j)
            UNION ALL SELECT o, 1, j, (1 - down) / 4 FROM part, range(4) t(j) WHERE u = 0 UNION ALL SELECT o, last, j, down / 4 FROM part, range(4) t(j) WHERE u = last)
        SELECT o, p, f.w FROM found f JOIN pix USING (ring, nth))"""


def phi_cdf(x: str) -> str:
    """Normal distribution: the series of the error function within 5, the asymptotic series of the tail beyond."""
    term = f"exp(i * ln(greatest(({x}) * ({x}) / 2, 1e-300)) - lgamma(i + 1)) * (CASE i % 2 WHEN 0 THEN 1 ELSE -1 END) / (2 * i + 1)"
    tail = f"exp(-0.5 * ({x}) * ({x})) / sqrt(2 * pi()) / abs({x}) * (1 - 1 / pow({x}, 2) + 3 / pow({x}, 4) - 15 / pow({x}, 6) + 105 / pow({x}, 8))"
    return f"(CASE WHEN ({x}) > 5 THEN 1 - {tail} WHEN ({x}) < -5 THEN {tail} ELSE 0.5 + ({x}) / sqrt(2 * pi()) * list_sum(list_transform(range(100), lambda i: {term})) END)"


def _x234(z: str) -> tuple[str, str, str]:
    h = f"(exp(-0.5 * ({z}) * ({z})) / sqrt(2 * pi()) / {phi_cdf(z)})"
    return f"(({z}) * ({z}) + 1 + ({z}) * {h})", f"(({z}) * (({z}) * ({z}) + 3) + (({z}) * ({z}) + 2) * {h})", f"(({z}) * ({z}) * (({z}) * ({z}) + 6) + 3 + ({z}) * (({z}) * ({z}) + 5) * {h})"


def parameters(name: str, source: str, extra: str) -> str:
    """CTEs that end in ``name``: ``source`` (mean, std and the columns ``extra``) with mu, sigma, norm, by bisection on mu / sigma."""
    x2, x3, x4 = _x234("(low + high) / 2")
    y2, y3, _ = _x234("z")
    return f"""{name}_b AS (
        SELECT 0 AS step, {extra}, mean, std, -1.5::DOUBLE AS low, 6.5::DOUBLE AS high FROM {source}
        UNION ALL SELECT step + 1, {extra}, mean, std, CASE WHEN more THEN (low + high) / 2 ELSE low END, CASE WHEN more THEN high ELSE (low + high) / 2 END
        FROM (SELECT *, {x4} * {x2} / pow({x3}, 2) > pow(std / mean, 2) + 1 AS more FROM {name}_b WHERE step < 48)),
    {name}_r AS (SELECT {extra}, mean, (low + high) / 2 AS z FROM {name}_b WHERE step = 48),
    {name} AS (SELECT {extra}, mean * {y2} / {y3} * z AS mu, mean * {y2} / {y3} AS sigma, 1 / (pow(mean * {y2} / {y3}, 2) * {y2} * {phi_cdf('z')}) AS norm FROM {name}_r)"""


def ansatz_cdf(r: str, m: str = "mu", s: str = "sigma", n: str = "norm") -> str:
    hi, lo = f"(({r} - {m}) / {s})", f"(-{m} / {s})"
    return f"({n} * (({m} * {m} + {s} * {s}) * ({phi_cdf(hi)} - {phi_cdf(lo)}) + {s} / sqrt(2 * pi()) * ({m} * exp(-0.5 * {lo} * {lo}) - ({r} + {m}) * exp(-0.5 * {hi} * {hi}))))"


def ansatz_pdf(r: str, m: str = "mu", s: str = "sigma", n: str = "norm") -> str:
    return f"({n} * {r} * {r} * exp(-0.5 * pow(({r} - {m}) / {s}, 2)) / ({s} * sqrt(2 * pi())))"


#: The map with distance at order 1, with moments, then with parameters (dmap).
DMOM = """dmom AS (SELECT ipix, w / sum(w) OVER () AS prob, m AS mean, m * 0.25 AS std FROM (
    SELECT c_custkey % 48 AS ipix, sum(abs(c_acctbal)) AS w, floor(sum(CAST(round(abs(c_acctbal) * 100) AS BIGINT)) / count(*) / 100) + 0.25 AS m FROM customer GROUP BY 1))"""
DMAP = f"{DMOM}, {parameters('dmap', 'dmom', 'ipix, prob')}"

MODE_FLAT = f"""{FLAT}, corner AS {corners(2)}, near AS (SELECT DISTINCT a.p AS a, b.p AS b FROM corner a JOIN corner b ON a.key = b.key AND a.p <> b.p)"""
