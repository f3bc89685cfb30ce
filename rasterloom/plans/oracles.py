"""DuckDB SQL for the catalogue's queries, written for the same relations and independently of the DataFrame code."""

from __future__ import annotations

# The tile and figure relations.
_PX = """px AS (
  SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
         CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 256))) AS INTEGER) AS q
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
_RGB = """rgb AS (
  SELECT image_id // 3 AS image_id, y, x, max(q) FILTER (image_id % 3 = 0) AS r, max(q) FILTER (image_id % 3 = 1) AS g, max(q) FILTER (image_id % 3 = 2) AS b
  FROM px GROUP BY ALL HAVING count(*) = 3)"""
_FIG = """grid AS (
  SELECT s_suppkey AS image_id, y, x, s_suppkey % 8 AS k FROM supplier, (SELECT unnest(range(48)) AS y), (SELECT unnest(range(48)) AS x)
), lab AS (
  SELECT *, CAST(CASE WHEN x BETWEEN 30 AND 45 AND y BETWEEN 30 AND 45 THEN 3 WHEN abs(x + y - 47) <= 1 THEN 2
    WHEN (x - 16) * (x - 16) + (y - 16) * (y - 16) <= (10 + k) * (10 + k) THEN 1 ELSE 0 END AS INTEGER) AS label FROM grid
), fig AS (
  SELECT image_id, y, x, label,
    CASE label WHEN 0 THEN 250 WHEN 1 THEN 226 WHEN 2 THEN 32 ELSE 18 + 22 * (x - 30) // 15 END AS r,
    CASE label WHEN 0 THEN 249 WHEN 1 THEN 92 WHEN 2 THEN 32 ELSE 58 + 132 * (x - 30) // 15 END AS g,
    CASE label WHEN 0 THEN 246 WHEN 1 THEN 28 + 8 * k WHEN 2 THEN 40 ELSE 200 + 20 * (x - 30) // 15 END AS b
  FROM lab)"""
_RINGS = """rings AS (
  SELECT s_suppkey AS image_id, CAST(seq AS INTEGER) AS seq,
    CAST(CASE WHEN seq < 4 THEN seq WHEN seq < 8 THEN 4 WHEN seq < 12 THEN 12 - seq ELSE 0 END * (3 + s_suppkey % 5) + seq % 3 AS DOUBLE) AS x,
    CAST(CASE WHEN seq < 4 THEN 0 WHEN seq < 8 THEN seq - 4 WHEN seq < 12 THEN 4 ELSE 16 - seq END * (3 + s_suppkey % 7) + seq % 2 AS DOUBLE) AS y
  FROM supplier, (SELECT unnest(range(16)) AS seq))"""
_LONG = "long AS (UNPIVOT (SELECT image_id, label, y, x, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM fig) ON r, g, b INTO NAME channel VALUE v)"
_MED = "med AS (SELECT image_id, label, median(r) AS p_r, median(g) AS p_g, median(b) AS p_b FROM fig GROUP BY ALL)"
_RES = """res AS (
  SELECT fig.*, p_r, p_g, p_b, greatest(abs(r - p_r), abs(g - p_g), abs(b - p_b)) AS e, (abs(r - p_r) + abs(g - p_g) + abs(b - p_b)) / 3 AS act
  FROM fig JOIN med USING (image_id, label))"""
_SLOPES = """slopes AS (
  SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS l FROM fig
), gr AS (
  SELECT *, CASE WHEN x = 0 THEN lead(l) OVER wx - l WHEN x = 47 THEN l - lag(l) OVER wx ELSE (lead(l) OVER wx - lag(l) OVER wx) / 2 END AS gx,
            CASE WHEN y = 0 THEN lead(l) OVER wy - l WHEN y = 47 THEN l - lag(l) OVER wy ELSE (lead(l) OVER wy - lag(l) OVER wy) / 2 END AS gy
  FROM slopes WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))"""
_CORE = """off3 AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE abs(dy) + abs(dx) <= 3
), core AS (
  SELECT a.image_id, a.y, a.x, a.label, any_value(a.r) AS r, any_value(a.g) AS g, any_value(a.b) AS b
  FROM fig a, off3 JOIN fig c ON c.image_id = a.image_id AND c.y = a.y + dy AND c.x = a.x + dx AND c.label = a.label
  GROUP BY a.image_id, a.y, a.x, a.label HAVING count(*) = 25)"""
_PAIRS = """pairs AS (
  SELECT DISTINCT s.image_id, least(s.label, t.label) AS a, greatest(s.label, t.label) AS b FROM fig s JOIN fig t
  ON s.image_id = t.image_id AND ((t.y = s.y AND t.x = s.x + 1) OR (t.x = s.x AND t.y = s.y + 1)) AND s.label <> t.label)"""
_PACK = """packed AS (
  SELECT image_id, CAST((r // 8) * 1024 + (g // 8) * 32 + b // 8 AS INTEGER) AS key, count(*) AS n FROM fig GROUP BY ALL
), peaks AS (
  SELECT p.*, total FROM packed p JOIN (SELECT image_id, CAST(sum(n) AS BIGINT) AS total FROM packed GROUP BY ALL) USING (image_id) WHERE n >= greatest(64, floor(total * 0.0002)))"""


def m(expression: str, name: str = "") -> str:
    """Whole millionths of an expression."""
    return f"CAST(floor(({expression}) * 1000000 + 0.5) AS BIGINT)" + (f" AS {name}" if name else "")


def micros(*names: str) -> str:
    return ", ".join(m(n, n) for n in names)


_PLACE = "count(*) AS n, CAST(sum(y * 1000 + x) AS BIGINT) AS places"
_COLORS = ((250, 249, 246), (226, 92, 56), (32, 32, 40), (25, 120, 210))
_DIST = [f"pow(r - {a}.0, 2) + pow(g - {b}.0, 2) + pow(b - {c}.0, 2)" for a, b, c in _COLORS]
_NEAREST = "CAST(CASE " + " ".join(f"WHEN {' AND '.join(f'{d} <= {e}' for j, e in enumerate(_DIST) if j != i)} THEN {i}" for i, d in enumerate(_DIST)) + " END AS INTEGER)"
_LINEAR = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
_CUBE = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t} * 7.787 + 16.0 / 116.0 END"
_HEX = lambda c: f"lpad(lower(to_hex(CAST(round_even(greatest(0, least(1, {c} / 255.0)) * 255, 0) AS BIGINT))), 2, '0')"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _blur(mode: str) -> str:
    at = {"nearest": "greatest(0, least(7, {0}))", "reflect": "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"}[mode]
    return (
        _with(_PX, "raw AS (SELECT t, exp(-t * t / 2.0) AS w FROM (SELECT unnest(range(-4, 5)) AS t))", "taps AS (SELECT t, w / (SELECT sum(w) FROM raw) AS w FROM raw)")
        + f", one AS (SELECT a.image_id, a.y, a.x, sum(w * c.q) AS q FROM px a, taps JOIN px c ON c.image_id = a.image_id AND c.x = a.x AND c.y = {at.format('a.y + t')} GROUP BY ALL)"
        + f" SELECT a.image_id, a.y, a.x, {m('sum(w * c.q)', 'q')} FROM one a, taps JOIN one c ON c.image_id = a.image_id AND c.y = a.y AND c.x = {at.format('a.x + t')} GROUP BY ALL"
    )


def _principal(source: str, keep: str) -> str:
    """Unit eigenvectors from columns xx, xy, yy of a relation."""
    return (
        f", top AS (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS t FROM {source}), vec AS (SELECT *, xy * xy + pow(t - xx, 2) >= xy * xy + pow(t - yy, 2) AS first FROM top)"
        ", dir AS (SELECT *, CASE WHEN first THEN xy ELSE t - yy END AS vx, CASE WHEN first THEN t - xx ELSE xy END AS vy FROM vec)"
        ", unit AS (SELECT *, sqrt(vx * vx + vy * vy) AS n_, CASE WHEN vx < -1e-12 OR (abs(vx) <= 1e-12 AND vy < 0) THEN -1.0 ELSE 1.0 END AS sg FROM dir)"
        f" SELECT {keep}, {m('CASE WHEN n_ <= 1e-12 THEN 1.0 ELSE sg * vx / n_ END', 'ux')}, {m('CASE WHEN n_ <= 1e-12 THEN 0.0 ELSE sg * vy / n_ END', 'uy')} FROM unit"
    )


def _normalised(position: str, least: float) -> str:
    return (
        f", pos AS ({position}), ends AS (SELECT image_id, label, quantile_cont(t, 0.01) AS lo, quantile_cont(t, 0.99) AS hi FROM pos GROUP BY ALL HAVING hi - lo >= {least})"
        ", nrm AS (SELECT pos.*, least(greatest((t - lo) / (hi - lo), 0.0), 1.0) AS u FROM pos JOIN ends USING (image_id, label))"
    )


_BINS = " SELECT image_id, label, CAST(least(floor(u * 10), 9) AS INTEGER) AS bin, count(*) AS n, " + ", ".join(m(f"median({c})", c) for c in "rgb") + " FROM nrm GROUP BY ALL HAVING count(*) >= 15"
_HORIZONTAL = "SELECT fig.*, (x - cx) * 1.0 + (y - cy) * 0.0 AS t FROM fig JOIN (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy FROM fig GROUP BY ALL) USING (image_id, label)"
_AROUND = """, n AS (SELECT a.*, p.x AS px1, p.y AS py1, m.x AS mx1, m.y AS my1, q.x AS px2, q.y AS py2 FROM rings a
  JOIN rings p ON p.image_id = a.image_id AND p.seq = (a.seq + 1) % 16 JOIN rings m ON m.image_id = a.image_id AND m.seq = (a.seq + 15) % 16
  JOIN rings q ON q.image_id = a.image_id AND q.seq = (a.seq + 2) % 16)"""
_CLAMP = lambda v: f"CASE WHEN sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]}) > 0.55 * side THEN 0.55 * side / sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]}) ELSE 1.0 END"
_FIRST, _SECOND = ("((px1 - mx1) / 6)", "((py1 - my1) / 6)"), ("((x - px2) / 6)", "((y - py2) / 6)")
_RECTS = ", ".join((_FIG, _MED)) + """, boxes AS (
  SELECT f.image_id, f.label, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1, any_value(p_r) AS r, any_value(p_g) AS g, any_value(p_b) AS b
  FROM fig f JOIN med USING (image_id, label) WHERE label > 0 GROUP BY ALL
), docs AS (
  SELECT image_id, '<svg xmlns="http://www.w3.org/2000/svg" width="48" height="48" viewBox="0 0 48 48"><g id="regions">' ||
    string_agg('<rect x="' || x0 || '" y="' || y0 || '" width="' || (x1 - x0) || '" height="' || (y1 - y0) || '" fill="#' || """ + " || ".join(_HEX(c) for c in "rgb") + """ || '"/>', '' ORDER BY label) || '</g></svg>' AS svg
  FROM boxes GROUP BY ALL)"""
_COMPACT = lambda v, p: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(printf('%.{p}f', {v}), '\\.?0+$', ''), '^-?0?$', '0'), '^0\\.', '.'), '^-0\\.', '-.')"

def _taps(name: str, sigma: float, order: int = 0) -> str:
    """Gaussian weights w at t, those of the derivative for order 1."""
    r = int(4 * sigma + 0.5)
    w = f"exp(-t * t / {2 * sigma * sigma}) / sum(exp(-t * t / {2 * sigma * sigma})) OVER ()"
    return f"{name} AS (SELECT t, {w}{f' * t / {sigma * sigma}' if order else ''} AS w FROM (SELECT unnest(range({-r}, {r + 1}))::DOUBLE AS t))"


_EDGES = {"nearest": "greatest(0, least({1} - 1, {0}))", "reflect": "CASE WHEN (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) < {1} THEN (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) ELSE 2 * {1} - 1 - (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) END"}


def _along(name: str, source: str, axis: str, weights: str, mode: str, size: int = 48, keys: str = "image_id", value: str = "v") -> str:
    """A pass of a separable filter over (keys, y, x, v)."""
    other = "x" if axis == "y" else "y"
    at = _EDGES[mode].format(f"a.{axis} + CAST(t AS BIGINT)", size)
    same = " AND ".join(f"a.{k} = c.{k}" for k in (*keys.split(", "), other))
    return f"{name} AS MATERIALIZED (SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.y, a.x, sum(w * c.{value}) AS v FROM (SELECT a.*, w, CAST({at} AS BIGINT) AS at_ FROM {source} a, {weights}) a JOIN {source} c ON {same} AND c.{axis} = at_ GROUP BY ALL)"


def _smooth(name: str, source: str, weights: str, mode: str, keys: str = "image_id") -> str:
    return _along(f"{name}_1", source, "y", weights, mode, keys=keys) + ", " + _along(name, f"{name}_1", "x", weights, mode, keys=keys)


_RAW = "raw AS (SELECT image_id, channel, y, x, any_value(v) / 255.0 AS v FROM long GROUP BY image_id, channel, y, x)"
_TENSOR = ", ".join((
    _FIG, _LONG, _RAW, _taps("g1", 1.0), _taps("d1", 1.0, 1), _taps("g25", 2.5),
    _along("sx", "raw", "y", "g1", "nearest", keys="image_id, channel"), _along("dx", "sx", "x", "d1", "nearest", keys="image_id, channel"),
    _along("sy", "raw", "y", "d1", "nearest", keys="image_id, channel"), _along("dy", "sy", "x", "g1", "nearest", keys="image_id, channel"),
    "prod AS (SELECT dx.image_id, dx.y, dx.x, sum(dx.v * dx.v) / 3 AS xx, sum(dx.v * dy.v) / 3 AS xy, sum(dy.v * dy.v) / 3 AS yy FROM dx JOIN dy USING (image_id, channel, y, x) GROUP BY ALL)",
    "three AS (UNPIVOT prod ON xx, xy, yy INTO NAME part VALUE v)", _smooth("soft", "three", "g25", "nearest", keys="image_id, part"),
    "ten AS (SELECT image_id, y, x, max(v) FILTER (part = 'xx') AS xx, max(v) FILTER (part = 'xy') AS xy, max(v) FILTER (part = 'yy') AS yy FROM soft GROUP BY ALL)",
    "eig AS (SELECT image_id, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS l1, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS l2 FROM ten)",
))
_TEXTURE = ", ".join((
    _FIG, "lum AS (SELECT image_id, y, x, (0.299 * r + 0.587 * g + 0.114 * b) / 255.0 AS v FROM fig)", _taps("g25", 2.5), _taps("g6", 6.0), _smooth("low", "lum", "g25", "reflect"),
    "fine AS (SELECT image_id, y, x, pow(lum.v - low.v, 2) AS v FROM lum JOIN low USING (image_id, y, x))", _smooth("tex", "fine", "g6", "reflect"),
))
_CLOSE8 = "abs(a.y - c.y) <= 1 AND abs(a.x - c.x) <= 1 AND (a.y <> c.y OR a.x <> c.x)"
_CROSS4 = "abs(a.y - c.y) + abs(a.x - c.x) <= 1"


def _sinc(v: str) -> str:
    return f"CASE WHEN {v} = 0 THEN 1.0 ELSE sin(pi() * ({v})) / (pi() * ({v})) END"


_LANCZOS = f"""ker AS (SELECT m, n, ({_sinc('d')}) * ({_sinc('d / 3')}) AS k FROM (SELECT m, n, n - ((m + 0.5) * 48 / 72 - 0.5) AS d FROM (SELECT unnest(range(72)) AS m), (SELECT unnest(range(48)) AS n)) WHERE abs(d) < 3),
 wei AS (SELECT m, n, k / sum(k) OVER (PARTITION BY m) AS w FROM ker),
 ry AS (SELECT image_id, channel, m AS y, x, sum(w * v) AS v FROM raw JOIN wei ON n = y GROUP BY ALL),
 rx AS (SELECT image_id, channel, y, m AS x, greatest(0, least(1, sum(w * v))) AS v FROM ry JOIN wei ON n = x GROUP BY ALL)"""
_MASK2 = "mask AS (SELECT image_id, y, x FROM fig WHERE label = 2)"
_ERODED = "(SELECT a.image_id, a.y, a.x FROM {0} a JOIN {0} c ON a.image_id = c.image_id AND " + _CROSS4 + " GROUP BY ALL HAVING count(*) = 5)"
_DILATED = "(SELECT DISTINCT a.image_id, a.y, a.x FROM fig a JOIN {0} c ON a.image_id = c.image_id AND " + _CROSS4 + " AND c.y BETWEEN a.y - 1 AND a.y + 1)"

ORACLE: dict[str, str] = {
    "px_scan": _with(_PX) + "SELECT image_id, y, x, q FROM px",
    "px_normalize": _with(_PX, _RGB) + "SELECT image_id, y, x, " + ", ".join(m(f"greatest(0, least(1, {c} / 255.0))", c) for c in "rgb") + " FROM rgb",
    "px_luma": _with(_PX, _RGB) + f"SELECT image_id, y, x, {m('r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE', 'luma')} FROM rgb",
    "px_saturation": _with(_PX, _RGB) + "SELECT image_id, y, x, greatest(r, g, b) - least(r, g, b) AS sat FROM rgb",
    "px_lab_chroma": _with(_PX, _RGB, "lin AS (SELECT image_id, y, x, " + ", ".join(f"{_LINEAR(c)} AS {c}" for c in "rgb") + " FROM rgb)", "xyz AS (SELECT *, (r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.95047 AS u, r * 0.212671 + g * 0.715160 + b * 0.072169 AS v, (r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.08883 AS w FROM lin)", "f AS (SELECT image_id, y, x, " + ", ".join(f"{_CUBE(t)} AS f{t}" for t in "uvw") + " FROM xyz)") + f"SELECT image_id, y, x, {m('sqrt(pow((fu - fv) * 500, 2) + pow((fv - fw) * 200, 2))', 'chroma')} FROM f",
    "hex_colors": _with(_PX, _RGB) + "SELECT image_id, y, x, '#' || " + " || ".join(_HEX(c) for c in "rgb") + " AS hex FROM rgb",
    "border_pixels": _with(_FIG) + f"SELECT image_id, label, {_PLACE} FROM fig WHERE y IN (0, 47) OR x IN (0, 47) GROUP BY ALL",
    "hist_packed_color": _with(_PX, _RGB) + "SELECT image_id, CAST((r // 32) * 64 + (g // 32) * 8 + b // 32 AS INTEGER) AS key, count(*) AS n FROM rgb GROUP BY ALL",
    "palette_peaks": _with(_FIG, _PACK) + "SELECT image_id, key, n FROM peaks",
    "palette_coverage": _with(_FIG, _PACK) + f"SELECT image_id, count(*) AS n_peaks, {m('sum(n) / any_value(total)', 'coverage')} FROM peaks GROUP BY ALL",
    "lut_nearest_color": _with(_FIG) + f"SELECT image_id, {_NEAREST} AS cluster, count(*) AS n FROM fig GROUP BY ALL",
    "kmeans_assign": _with(_PX, _RGB) + f"SELECT image_id, y, x, {_NEAREST} AS cluster FROM rgb",
    "lloyd_step": _with(_PX, _RGB) + f"SELECT {_NEAREST} AS cluster, count(*) AS n, {', '.join(m(f'avg({c})', c) for c in 'rgb')} FROM rgb GROUP BY 1",
    "region_area": _with(_FIG) + "SELECT image_id, label, count(*) AS area FROM fig GROUP BY ALL",
    "region_bbox": _with(_FIG) + "SELECT image_id, label, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM fig GROUP BY ALL",
    "region_mean": _with(_FIG) + f"SELECT image_id, label, {', '.join(m(f'avg({c})', c) for c in 'rgb')} FROM fig GROUP BY ALL",
    "region_median": _with(_FIG, _MED) + f"SELECT image_id, label, {', '.join(m(f'p_{c}', c) for c in 'rgb')} FROM med",
    "region_spread": _with(_FIG, _LONG) + f", q AS (SELECT image_id, label, channel, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS d FROM long GROUP BY ALL) SELECT image_id, label, {m('max(d)', 'spread')} FROM q GROUP BY ALL",
    "region_mean_sat": _with(_FIG) + f"SELECT image_id, label, {m('avg(greatest(r, g, b) - least(r, g, b))', 'sat')}, avg(greatest(r, g, b) - least(r, g, b)) > 100 AS protected FROM fig GROUP BY ALL",
    "region_having_min_area": _with(_FIG) + "SELECT image_id, label, count(*) AS area FROM fig GROUP BY ALL HAVING count(*) >= 300",
    "region_fill_color": _with(_FIG, _MED, _CORE) + ", inn AS (SELECT image_id, label, median(r) AS i_r, median(g) AS i_g, median(b) AS i_b FROM core GROUP BY ALL HAVING count(*) >= 200) SELECT image_id, label, " + ", ".join(m(f"coalesce(i_{c}, p_{c})", c) for c in "rgb") + " FROM med LEFT JOIN inn USING (image_id, label)",
    "region_order": _with(_FIG) + ", a AS (SELECT image_id, label, count(*) AS area FROM fig GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS INTEGER) AS rank FROM a",
    "region_fit_mode": _with(_FIG) + "SELECT image_id, label, CASE WHEN avg(CASE WHEN x < 24 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'bezier' ELSE 'cr' END AS fit FROM fig GROUP BY ALL",
    "component_size_filter": _with(_FIG) + f"SELECT image_id, {_PLACE} FROM fig SEMI JOIN (SELECT image_id, label FROM fig GROUP BY ALL HAVING count(*) >= 300) USING (image_id, label) GROUP BY ALL",
    "background_label": _with(_FIG) + ", c AS (SELECT image_id, label, count(*) AS n FROM fig WHERE y IN (0, 47) OR x IN (0, 47) GROUP BY ALL) SELECT image_id, label, n FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) = 1",
    "dense_relabel": _with(_FIG) + f", d AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) - 1 AS INTEGER) AS dense FROM fig WHERE label <> 1) SELECT image_id, label, dense, {_PLACE} FROM d GROUP BY ALL",
    "adjacency_pairs": _with(_FIG, _PAIRS) + "SELECT image_id, a, b FROM pairs",
    "adjacency_color_distance": _with(_FIG, _PAIRS) + ", mean AS (SELECT image_id, label, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM fig GROUP BY ALL), d AS (SELECT p.image_id, a, p.b, sqrt(pow(s.r - t.r, 2) + pow(s.g - t.g, 2) + pow(s.b - t.b, 2)) AS d FROM pairs p JOIN mean s ON s.image_id = p.image_id AND s.label = a JOIN mean t ON t.image_id = p.image_id AND t.label = p.b)" + f" SELECT image_id, a, b, {m('d', 'd')}, CAST(row_number() OVER (PARTITION BY image_id ORDER BY d.d, a, b) AS INTEGER) AS rank FROM d",
    "region_boundary_pixels": _with(_FIG) + f", e AS (SELECT DISTINCT s.image_id, s.y, s.x, s.label FROM fig s JOIN fig t ON s.image_id = t.image_id AND abs(s.y - t.y) + abs(s.x - t.x) = 1 AND s.y BETWEEN t.y - 1 AND t.y + 1 AND s.label <> t.label) SELECT image_id, label, {_PLACE} FROM e GROUP BY ALL",
    "erosion_core": _with(_FIG, _CORE) + f"SELECT image_id, label, {_PLACE} FROM core GROUP BY ALL",
    "dilation": _with(_FIG) + f", g AS (SELECT DISTINCT f.image_id, f.y + dy AS y, f.x + dx AS x FROM fig f, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE label = 3 AND abs(dy) + abs(dx) <= 2) SELECT image_id, label, {_PLACE} FROM fig SEMI JOIN g USING (image_id, y, x) GROUP BY ALL",
    "min_max_filter_core": _with(_FIG) + f", w AS (SELECT a.image_id, a.y, a.x, a.label FROM fig a, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) JOIN fig c ON c.image_id = a.image_id AND c.y = a.y + dy AND c.x = a.x + dx GROUP BY ALL HAVING min(c.label) = max(c.label)) SELECT image_id, label, {_PLACE} FROM w GROUP BY ALL",
    "set_union_masks": _with(_FIG) + f"SELECT image_id, {_PLACE} FROM (SELECT image_id, y, x FROM fig WHERE label IN (1, 2) UNION SELECT image_id, y, x FROM fig WHERE x < 24) GROUP BY ALL",
    "set_intersect_masks": _with(_FIG) + f"SELECT image_id, {_PLACE} FROM (SELECT image_id, y, x FROM fig WHERE label IN (1, 2) INTERSECT SELECT image_id, y, x FROM fig WHERE x < 24) GROUP BY ALL",
    "set_except_masks": _with(_FIG) + f"SELECT image_id, {_PLACE} FROM (SELECT image_id, y, x FROM fig WHERE label IN (1, 2) EXCEPT SELECT image_id, y, x FROM fig WHERE x < 24) GROUP BY ALL",
    "central_gradient": _with(_PX) + ", g AS (SELECT *, CASE WHEN x = 0 THEN CAST(lead(q) OVER wx - q AS DOUBLE) WHEN x = 7 THEN CAST(q - lag(q) OVER wx AS DOUBLE) ELSE (lead(q) OVER wx - lag(q) OVER wx) / 2.0 END AS gx, CASE WHEN y = 0 THEN CAST(lead(q) OVER wy - q AS DOUBLE) WHEN y = 7 THEN CAST(q - lag(q) OVER wy AS DOUBLE) ELSE (lead(q) OVER wy - lag(q) OVER wy) / 2.0 END AS gy FROM px WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))" + f" SELECT image_id, y, x, {micros('gx', 'gy')} FROM g",
    "mean_abs_gradient": _with(_PX) + ", g AS (SELECT image_id, abs(q - lag(q) OVER (PARTITION BY image_id, y ORDER BY x)) AS dx, abs(q - lag(q) OVER (PARTITION BY image_id, x ORDER BY y)) AS dy FROM px)" + f" SELECT image_id, {m('avg(dx) + avg(dy)', 'g')} FROM g GROUP BY ALL",
    "gaussian_blur_nearest": _blur("nearest"),
    "gaussian_blur_reflect": _blur("reflect"),
    "distance_transform": _with(_FIG) + f"SELECT a.image_id, CAST(a.y AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, {m('sqrt(min(pow(a.y - c.y, 2) + pow(a.x - c.x, 2)))', 'd')} FROM fig a JOIN fig c ON a.image_id = c.image_id AND c.label = 2 GROUP BY ALL",
    "pca_axis": _with(_FIG) + ", u AS (SELECT image_id, label, x, y, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b FROM fig), mo AS (SELECT image_id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, " + ", ".join(f"covar_pop({p}, {c}) AS {p}{c}" for p in "xy" for c in "rgb") + " FROM u GROUP BY ALL), s AS (SELECT image_id, label, n, cx, cy, xr * xr + xg * xg + xb * xb AS xx, xr * yr + xg * yg + xb * yb AS xy, yr * yr + yg * yg + yb * yb AS yy FROM mo)" + _principal("s", f"image_id, label, n, {micros('cx', 'cy')}"),
    "tensor_axis": _with(_FIG, _SLOPES, "t AS (SELECT image_id, label, avg(gx * (gx * gx + gy * gy)) AS ax, avg(gy * (gx * gx + gy * gy)) AS ay FROM gr GROUP BY ALL)", "u AS (SELECT *, sqrt(ax * ax + ay * ay) AS n, CASE WHEN ax < -1e-12 OR (abs(ax) <= 1e-12 AND ay < 0) THEN -1.0 ELSE 1.0 END AS sg FROM t)")
    + f"SELECT image_id, label, {m('CASE WHEN n > 1e-12 THEN sg * ax / n ELSE 1.0 END', 'ux')}, {m('CASE WHEN n > 1e-12 THEN sg * ay / n ELSE 0.0 END', 'uy')} FROM u",
    "ramp_bins": _with(_FIG) + _normalised(_HORIZONTAL, 4.0) + _BINS,
    "ramp_gain": _with(_FIG) + _normalised(_HORIZONTAL, 4.0) + ", flat AS (SELECT image_id, label, count(*) * (var_pop(r) + var_pop(g) + var_pop(b)) AS flat FROM nrm GROUP BY ALL), ins AS (SELECT *, CAST(floor(u * 8) AS INTEGER) AS bin FROM nrm WHERE floor(u * 8) < 8), mid AS (SELECT image_id, label, bin, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM ins GROUP BY ALL HAVING count(*) > 15), err AS (SELECT image_id, label, sum(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)) AS axis FROM ins JOIN mid USING (image_id, label, bin) GROUP BY ALL)" + f" SELECT image_id, label, {m('1 - coalesce(axis, 0) / (flat + 1e-12)', 'gain')} FROM flat LEFT JOIN err USING (image_id, label)",
    "radial_center_lsq": _with(_FIG, _SLOPES) + ", s AS (SELECT image_id, label, avg(x) AS mx, avg(y) AS my, (min(x) + max(x)) / 2.0 AS bx, (min(y) + max(y)) / 2.0 AS by_, sum(gy * gy) AS a11, -sum(gx * gy) AS a12, sum(gx * gx) AS a22, sum(gy * (gy * x - gx * y)) AS b1, -sum(gx * (gy * x - gx * y)) AS b2 FROM gr GROUP BY ALL)" + "".join(f"{' UNION ALL' if i else ''} SELECT image_id, label, '{k}' AS kind, {m(a, 'cx')}, {m(b, 'cy')} FROM s{w}" for i, (k, a, b, w) in enumerate((("centroid", "mx", "my", ""), ("box", "bx", "by_", ""), ("lines", "(a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12)", "(a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12)", " WHERE a11 * a22 - a12 * a12 > 1e-3 * pow(a11 + a22, 2)")))),
    "radial_bins": _with(_FIG) + _normalised("SELECT fig.*, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS t FROM fig JOIN (SELECT image_id, label, (min(x) + max(x)) / 2.0 AS cx, (min(y) + max(y)) / 2.0 AS cy FROM fig GROUP BY ALL) USING (image_id, label)", 2.0) + _BINS,
    "fill_residual": _with(_FIG, _MED, _RES) + f"SELECT image_id, label, {m('sum(e)', 'e')}, {m('sum(act)', 'act')} FROM res GROUP BY ALL",
    "fill_stats": _with(_FIG, _MED, _RES) + f"SELECT image_id, label, count(*) FILTER (e > 5) AS nbad, {m('sqrt(avg(e * e))', 'rms')}, {m('avg(pow(greatest(e - 5, 0), 2))', 'excess')} FROM res GROUP BY ALL",
    "refine_trigger": _with(_FIG, _MED, _RES) + "SELECT image_id, label, count(*) AS area, count(*) FILTER (e > 5) AS nbad FROM res GROUP BY ALL HAVING count(*) >= 200 AND nbad >= 25 AND avg(pow(greatest(e - 5, 0), 2)) > 0",
    "error_split_axis": _with(_FIG, _MED, _RES) + ", w AS (SELECT image_id, label, sum(e * e) AS sw, sum(e * e * x) AS sx, sum(e * e * y) AS sy, sum(e * e * x * x) AS sxx, sum(e * e * x * y) AS sxy, sum(e * e * y * y) AS syy FROM res GROUP BY ALL HAVING sum(e * e) > 0), s AS (SELECT image_id, label, sx / sw AS cx, sy / sw AS cy, sxx / sw - (sx / sw) * (sx / sw) AS xx, sxy / sw - (sx / sw) * (sy / sw) AS xy, syy / sw - (sy / sw) * (sy / sw) AS yy FROM w)" + _principal("s", f"image_id, label, {micros('cx', 'cy')}"),
    "weighted_median_cut": _with(_FIG, _MED, _RES) + ", t AS (SELECT image_id, label, y, x, e * e AS w, x - avg(x) OVER (PARTITION BY image_id, label) AS t FROM res), r AS (SELECT *, sum(w) OVER (PARTITION BY image_id, label ORDER BY t, y, x ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY image_id, label) AS total FROM t)" + f" SELECT image_id, label, {m('least(greatest(min(t) FILTER (upto >= total / 2), quantile_cont(t, 0.25)), quantile_cont(t, 0.75))', 'cut')} FROM r GROUP BY ALL",
    "psnr_mae": _with(_FIG, _MED, _RES) + ", s AS (SELECT image_id, avg((pow(r - p_r, 2) + pow(g - p_g, 2) + pow(b - p_b, 2)) / 3) AS mse, avg(act) AS mae FROM res GROUP BY ALL)" + f" SELECT image_id, {m('CASE WHEN mse > 0 THEN 10 * log10(65025.0 / mse) ELSE 99 END', 'psnr')}, {m('mae', 'mae')} FROM s",
    "interior_mae": _with(_FIG, _MED, _RES, _SLOPES) + f" SELECT image_id, count(*) AS n, {m('avg(act)', 'mae')} FROM res JOIN gr USING (image_id, y, x) WHERE abs(gx) + abs(gy) < 3 GROUP BY ALL",
    "activity_residual": _with(_FIG, _MED, _RES) + ", c AS (SELECT s.image_id, s.y, s.x FROM fig s JOIN fig t ON s.image_id = t.image_id AND abs(s.y - t.y) + abs(s.x - t.x) <= 1 AND s.y BETWEEN t.y - 1 AND t.y + 1 AND s.label = t.label GROUP BY ALL HAVING count(*) = 5)" + f" SELECT image_id, label, {m('avg(act)', 'activity')} FROM res SEMI JOIN c USING (image_id, y, x) GROUP BY ALL HAVING count(*) >= 50",
    "shoelace_area": _with(_RINGS) + _AROUND + f" SELECT image_id, {m('abs(sum(x * py1 - y * px1)) / 2', 'area')} FROM n GROUP BY ALL",
    "corner_angles": _with(_RINGS) + _AROUND + f" SELECT image_id, seq, {m('abs(degrees(atan2((x - mx1) * (py1 - y) - (y - my1) * (px1 - x), (x - mx1) * (px1 - x) + (y - my1) * (py1 - y))))', 'angle')} FROM n",
    "chord_param": _with(_RINGS) + ", s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS s FROM rings WINDOW w AS (PARTITION BY image_id ORDER BY seq)), c AS (SELECT *, sum(s) OVER (PARTITION BY image_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto, sum(s) OVER (PARTITION BY image_id) AS total FROM s)" + f" SELECT image_id, seq, {m('CASE WHEN total > 0 THEN upto / total ELSE 0 END', 'u')} FROM c",
    "catmull_rom_controls": _with(_RINGS) + _AROUND + ", k AS (SELECT *, sqrt(pow(px1 - x, 2) + pow(py1 - y, 2)) AS side FROM n)" + f" SELECT image_id, seq, {m(f'x + {_FIRST[0]} * {_CLAMP(_FIRST)}', 'c1x')}, {m(f'y + {_FIRST[1]} * {_CLAMP(_FIRST)}', 'c1y')}, {m(f'px1 + {_SECOND[0]} * {_CLAMP(_SECOND)}', 'c2x')}, {m(f'py1 + {_SECOND[1]} * {_CLAMP(_SECOND)}', 'c2y')} FROM k",
    "profile_smoothing": _with(_RINGS) + f"SELECT image_id, seq, {m('avg(x) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'x_avg')} FROM rings",
    "last_value_fill": _with(_RINGS) + f"SELECT a.image_id, a.seq, {m('b.x', 'v')} FROM rings a JOIN rings b ON a.image_id = b.image_id AND b.seq = a.seq - a.seq % 3",
    "neighbor_runs": _with(_RINGS) + ", v AS (SELECT image_id, seq, CAST(x > 6 AS INTEGER) AS v FROM rings), c AS (SELECT *, coalesce(CAST(v <> lag(v) OVER (PARTITION BY image_id ORDER BY seq) AS INTEGER), 0) AS ch FROM v), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY image_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c), e AS (SELECT *, max(run) OVER (PARTITION BY image_id) AS last, first_value(v) OVER w AS fv, last_value(v) OVER w AS lv FROM r WINDOW w AS (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT image_id, CASE WHEN run = last AND fv = lv THEN 0 ELSE run END AS run, v, min(seq) AS first, count(*) AS n FROM e GROUP BY ALL",
    "slim_number": _with(_PX) + f"SELECT image_id, y, x, {_COMPACT('(q - 128) / 64.0', 1)} AS one, {_COMPACT('(q - 128) / 64.0', 2)} AS two FROM px",
    "svg_document": "WITH " + _RECTS + " SELECT image_id, svg FROM docs",
    "svg_layer_counts": "WITH " + _RECTS + ", l AS (SELECT unnest(['regions', 'strokes', 'edges', 'shade']) AS layer) SELECT image_id, layer, CAST(CASE WHEN layer = 'regions' THEN len(regexp_extract_all(svg, '<(path|rect)')) ELSE 0 END AS BIGINT) AS n FROM docs, l",
    "mosaic_bands": _with(_PX) + f", b AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(((image_id // 20) * 8 + y) % 4 AS INTEGER) AS label, q FROM px) SELECT image_id, label, {m('quantile_cont(q, 0.05)', 'p0')}, {m('quantile_cont(q, 0.5)', 'p1')} FROM b GROUP BY ALL",
    "structure_tensor": "WITH " + _TENSOR + f" SELECT image_id, count(*) AS n, {m('avg((l1 - l2) / (l1 + l2 + 1e-12))', 'coh')}, {m('max(l1)', 'l1')}, {m('avg(l2)', 'l2')} FROM eig GROUP BY ALL",
    "texture_map": "WITH " + _TEXTURE + f" SELECT image_id, {m('avg(v)', 'texture')}, {m('max(v)', 'most')} FROM tex GROUP BY ALL",
    "denoised": _with(_FIG, "u AS (SELECT image_id, y, x, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b FROM fig)", "o AS (SELECT dy, dx FROM (SELECT unnest(range(-4, 5)) AS dy), (SELECT unnest(range(-4, 5)) AS dx))")
    + ", p AS MATERIALIZED (SELECT *, CAST(greatest(0, least(47, y + dy)) AS BIGINT) AS ny, CAST(greatest(0, least(47, x + dx)) AS BIGINT) AS nx FROM u, o), k AS (SELECT a.image_id, a.y, a.x, c.r, c.g, c.b, exp(-(dy * dy + dx * dx) / 8.0 - (pow(c.r - a.r, 2) + pow(c.g - a.g, 2) + pow(c.b - a.b, 2)) / 0.02) AS w FROM p a JOIN u c ON c.image_id = a.image_id AND c.y = ny AND c.x = nx)"
    + ", s AS (SELECT image_id, y, x, sum(w * r) / sum(w) AS r, sum(w * g) / sum(w) AS g, sum(w * b) / sum(w) AS b FROM k GROUP BY ALL)"
    + f" SELECT image_id, {', '.join(m(f'avg({c})', c) for c in 'rgb')}, {m('stddev_pop(r)', 'spread')} FROM s GROUP BY ALL",
    "resized": _with(_FIG, _LONG, _RAW, _LANCZOS) + "SELECT image_id, count(*) FILTER (channel = 'r') AS n, " + ", ".join(m(f"avg(v) FILTER (channel = '{c}')", c) for c in "rgb") + f", {m(chr(40) + 'stddev_pop(v) FILTER (channel = ' + chr(39) + 'r' + chr(39) + '))', 'spread')} FROM rx GROUP BY ALL",
    "mask_opening": _with(_FIG, _MASK2) + f", e AS {_ERODED.format('mask')}, o AS {_DILATED.format('e')} SELECT image_id, {_PLACE} FROM o GROUP BY ALL",
    "mask_closing": _with(_FIG, _MASK2) + f", e AS {_DILATED.format('mask')}, o AS {_ERODED.format('e')} SELECT image_id, {_PLACE} FROM o GROUP BY ALL",
    "connected_components": "WITH RECURSIVE " + _PX + ", v AS (SELECT image_id, y, x, q // 64 AS v, y * 8 + x AS i FROM px), near AS (SELECT a.image_id, a.i AS a, c.i AS b FROM v a JOIN v c ON a.image_id = c.image_id AND a.v = c.v AND " + _CLOSE8 + "), reach(image_id, a, b) AS (SELECT image_id, i, i FROM v UNION SELECT reach.image_id, reach.a, near.b FROM reach JOIN near ON reach.image_id = near.image_id AND reach.b = near.a)"
    + ", root AS (SELECT image_id, a AS i, min(b) AS r FROM reach GROUP BY ALL), named AS (SELECT image_id, i, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY r) - 1 AS INTEGER) AS component FROM root)"
    + f" SELECT image_id, component, {_PLACE} FROM named JOIN v USING (image_id, i) GROUP BY ALL",
    "hysteresis": "WITH RECURSIVE " + _PX + ", v AS (SELECT image_id, y, x, q FROM px WHERE q > 130), kept(image_id, y, x) AS (SELECT image_id, y, x FROM v WHERE q > 180 UNION SELECT c.image_id, c.y, c.x FROM kept a JOIN v c ON a.image_id = c.image_id AND " + _CLOSE8 + f") SELECT image_id, {_PLACE} FROM kept GROUP BY ALL",
    "palette_lookup": _with(_FIG, _PACK.replace("greatest(64,", "greatest(16,")) + ", fits AS (SELECT image_id FROM peaks GROUP BY image_id HAVING count(*) BETWEEN 2 AND 512 AND sum(n) / any_value(total) >= 0.9), pal AS (SELECT image_id, key, n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, key) - 1 AS INTEGER) AS label FROM peaks SEMI JOIN fits USING (image_id))"
    + ", near AS (SELECT k.image_id, k.key, k.n, p.label, pow((k.key // 1024 - p.key // 1024) * 8.0, 2) + pow((k.key // 32 % 32 - p.key // 32 % 32) * 8.0, 2) + pow((k.key % 32 - p.key % 32) * 8.0, 2) AS d FROM packed k JOIN pal p USING (image_id))"
    + ", best AS (SELECT image_id, key, n, label FROM near QUALIFY row_number() OVER (PARTITION BY image_id, key ORDER BY d, label) = 1) SELECT image_id, label, CAST(sum(n) AS BIGINT) AS n FROM best GROUP BY ALL",
    "refine_accept": _with(_FIG, _MED, _RES) + ", halves AS (SELECT image_id, label, x >= 24 AS h, median(r) AS h_r, median(g) AS h_g, median(b) AS h_b FROM fig GROUP BY ALL), e0 AS (SELECT image_id, label, avg(pow(greatest(e - 5, 0), 2)) AS ex, sqrt(avg(e * e)) AS rms FROM res GROUP BY ALL)"
    + ", r1 AS (SELECT fig.image_id, fig.label, greatest(abs(r - h_r), abs(g - h_g), abs(b - h_b)) AS e FROM fig JOIN halves h ON h.image_id = fig.image_id AND h.label = fig.label AND h.h = (x >= 24)), e1 AS (SELECT image_id, label, avg(pow(greatest(e - 5, 0), 2)) AS ex, sqrt(avg(e * e)) AS rms FROM r1 GROUP BY ALL)"
    + " SELECT e0.image_id, e0.label FROM e0 JOIN e1 USING (image_id, label) WHERE e1.ex <= 0.8 * e0.ex AND e1.rms <= 1.05 * e0.rms",
    "fixed_number": _with(_PX) + "SELECT image_id, y, x, " + ", ".join(f"regexp_replace(regexp_replace(printf('%.{p}f', (q - 128) / 64.0), '\\.?0+$', ''), '^-?0?$', '0') AS {n}" for p, n in ((1, "one"), (3, "three"))) + " FROM px",
    "human_sizes": _with(_FIG) + ", c AS (SELECT image_id, label, count(*) AS k FROM fig GROUP BY ALL), a AS (SELECT image_id, label, k * k * (image_id % 50 + 1) AS n FROM c) SELECT image_id, label, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN CAST(round(n / 1024, 1) AS VARCHAR) || ' KB' ELSE CAST(round(n / 1048576, 2) AS VARCHAR) || ' MB' END AS size FROM a",
    "svg_slim": "WITH " + _RECTS + " SELECT image_id, svg, true AS valid, true AS packed FROM docs",
    "classify_regions": "WITH " + _TEXTURE + ", off2 AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE abs(dy) + abs(dx) <= 2), inn AS (SELECT a.image_id, a.y, a.x, a.label FROM fig a, off2 JOIN fig c ON c.image_id = a.image_id AND c.y = a.y + dy AND c.x = a.x + dx AND c.label = a.label GROUP BY ALL HAVING count(*) = 13)"
    + ", n AS (SELECT image_id, label, count(*) AS area FROM fig GROUP BY ALL), ni AS (SELECT image_id, label, count(*) AS k FROM inn GROUP BY ALL), used AS (SELECT fig.image_id, label, y, x FROM fig LEFT JOIN ni USING (image_id, label) LEFT JOIN (SELECT *, true AS i FROM inn) USING (image_id, label, y, x) WHERE i OR coalesce(k, 0) < 30)"
    + ", t AS (SELECT image_id, label, avg(v) AS t FROM used JOIN tex USING (image_id, y, x) GROUP BY ALL), sc AS (SELECT image_id, greatest(quantile_cont(v, 0.995), 1e-12) AS scale FROM tex GROUP BY ALL), " + _LONG + ", q AS (SELECT image_id, label, channel, (quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) / 255.0 AS d FROM long GROUP BY ALL), sp AS (SELECT image_id, label, max(d) AS s FROM q GROUP BY ALL)"
    + ", f AS (SELECT n.image_id, n.label, area, scale, CASE WHEN area >= 50 THEN t ELSE 0 END AS t, CASE WHEN area >= 50 THEN s ELSE 0 END AS s FROM n JOIN t USING (image_id, label) JOIN sp USING (image_id, label) JOIN sc USING (image_id))"
    + f" SELECT image_id, label, area, {m('t', 'tex')}, {m('s', 'spread')}, t / scale < 3 AND s < 0.02 AS geo FROM f",
    "small_region_merge": _with(_PX, _RGB, "v AS (SELECT image_id, y, x, r // 64 AS v FROM rgb)", "sizes AS (SELECT image_id, v, count(*) >= 8 AS keep FROM v GROUP BY ALL)", "k AS (SELECT v.*, keep OR NOT bool_or(keep) OVER (PARTITION BY image_id) AS keep FROM v JOIN sizes USING (image_id, v))")
    + ", near AS (SELECT a.image_id, a.y, a.x, c.v FROM k a JOIN k c ON a.image_id = c.image_id AND c.keep WHERE NOT a.keep OR (a.y = c.y AND a.x = c.x) QUALIFY row_number() OVER (PARTITION BY a.image_id, a.y, a.x ORDER BY pow(a.y - c.y, 2) + pow(a.x - c.x, 2), c.x, c.y) = 1)"
    + f", d AS (SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY v) - 1 AS INTEGER) AS label FROM near) SELECT image_id, label, {_PLACE} FROM d GROUP BY ALL",
}
