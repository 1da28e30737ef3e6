"""The catalogue's queries in DuckDB SQL, from the tables on."""

from __future__ import annotations

import numpy as np

from wavecrest.functions.signal import butter_bandpass, savgol_weights, slepian
from wavecrest.functions.spectral import BANDS
from wavecrest.operators.channels import CZ, CZ_NEIGHBOURS
from wavecrest.sources.recordings import CHANNELS_63

_EPS = "1e-20"
_MONTAGE = "montage AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CHANNELS_63)) + ") v(ch_idx, channel))"
_PLACES = """places AS (SELECT ch_idx, channel,
  CASE WHEN lower(channel) LIKE '%z' OR NOT regexp_matches(channel, '[0-9]$') THEN 'MID' WHEN CAST(regexp_extract(channel, '([0-9]+)$', 1) AS INT) % 2 = 1 THEN 'LH' ELSE 'RH' END AS hemisphere,
  CASE WHEN upper(channel) LIKE 'F%' OR upper(channel) LIKE 'AF%' THEN 'frontal' WHEN upper(channel) LIKE 'C%' THEN 'central' WHEN upper(channel) LIKE 'T%' THEN 'temporal'
    WHEN upper(channel) LIKE 'P%' THEN 'parietal' WHEN upper(channel) LIKE 'O%' THEN 'occipital' ELSE 'central' END AS region FROM montage)"""
_SIG = """sig AS (SELECT vec_id // 126 AS subject, CASE WHEN vec_id % 126 < 63 THEN '1_rest' ELSE '1_idea generation' END AS task, CAST(vec_id % 63 AS INT) AS ch_idx, embedding
  FROM embeddings WHERE vec_id // 126 IN (SELECT vec_id // 126 FROM embeddings GROUP BY 1 HAVING count(*) = 126)),
smp AS (SELECT subject, task, ch_idx, t, CAST(embedding[t + 1] AS DOUBLE) AS x FROM sig, (SELECT unnest(range(64)) AS t))"""


def _welch(source: str, keys: str, n: int, hop: int, k: int, fs: float) -> str:
    """psd(keys, b, f, p) of ``source`` (keys, t, x)."""
    return f"""seg AS (SELECT {keys}, k, t - k * {hop} AS j, x FROM {source}, (SELECT unnest(range({k})) AS k) WHERE t BETWEEN k * {hop} AND k * {hop} + {n - 1}),
win AS (SELECT {keys}, k, j, (x - avg(x) OVER (PARTITION BY {keys}, k)) * (0.5e0 - 0.5e0 * cos(2 * pi() * j / {n})) AS y FROM seg),
dft AS (SELECT {keys}, k, b, sum(y * cos(2 * pi() * b * j / {n})) AS re, sum(y * sin(2 * pi() * b * j / {n})) AS im FROM win, (SELECT unnest(range({n // 2 + 1})) AS b) GROUP BY ALL),
psd AS (SELECT {keys}, b, b * {fs}e0 / {n} AS f, avg(re * re + im * im) / ({fs}e0 * {0.375 * n}e0) * CASE WHEN b IN (0, {n // 2}) THEN 1 ELSE 2 END AS p FROM dft GROUP BY {keys}, b)"""


_K = "subject, task, ch_idx"
_PSD = _SIG + ",\n" + _welch("smp", _K, 32, 16, 3, 64.0)
_BANDS = "bands AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {lo}e0, {hi}e0)" for b, (lo, hi) in BANDS.items()) + ", ('total', 1e0, 45e0)) v(band, lo, hi))"
_POWER = _BANDS + f""",
pts AS (SELECT {_K}, band, p, row_number() OVER (PARTITION BY {_K}, band ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY {_K}, band) AS n FROM psd JOIN bands ON f BETWEEN lo AND hi),
pw AS (SELECT {_K}, band, 2e0 * CASE WHEN any_value(n) = 1 THEN 0 WHEN any_value(n) = 2 THEN sum(p) / 2
    ELSE sum(CASE WHEN i < n - 1 + n % 2 THEN p * CASE WHEN i = 0 OR i = n - 2 + n % 2 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END ELSE 0 END) / 3
      + CASE WHEN any_value(n) % 2 = 0 THEN sum(p * CASE n - i WHEN 1 THEN 5e0 WHEN 2 THEN 8e0 WHEN 3 THEN -1e0 ELSE 0 END) / 12 ELSE 0 END END AS power
  FROM pts GROUP BY {_K}, band)"""
_IN = f"inn AS (SELECT {_K}, f, p FROM psd WHERE f BETWEEN 1 AND 45)"

_SMOOTHED = "wts AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {j}, {w!r}::DOUBLE)" for r, row in enumerate(savgol_weights().tolist()) for j, w in enumerate(row)) + f""") v(r, j, w)),
num AS (SELECT {_K}, f, p, row_number() OVER (PARTITION BY {_K} ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY {_K}) AS n FROM inn),
plc AS (SELECT *, greatest(least(i - 5, n - 11), 0) AS s FROM num),
sm AS (SELECT a.subject, a.task, a.ch_idx, a.f, sum(w * b.p) AS p FROM plc a JOIN wts ON r = a.i - a.s JOIN num b ON a.subject = b.subject AND a.task = b.task AND a.ch_idx = b.ch_idx AND b.i = a.s + j GROUP BY ALL)"""


def _edge(share: float, name: str, keys: str = _K) -> str:
    return f"""cum AS (SELECT {keys}, f, sum(p) OVER (PARTITION BY {keys} ORDER BY f) AS c, sum(p) OVER (PARTITION BY {keys}) AS s FROM inn),
edge AS (SELECT {keys}, coalesce(min(f) FILTER (WHERE c >= {share}e0 * (s + {_EPS})), min(f)) AS {name} FROM cum GROUP BY {keys})"""


def _trp(mode: str, base: str = "'1_rest'") -> str:
    ratio = f"(a.power + {_EPS}) / (b.power + {_EPS})"
    form = {"logratio": f"log10({ratio})", "ln": f"ln({ratio})", "db": f"10 * log10({ratio})", "ratio": f"(a.power - b.power) / (b.power + {_EPS})"}[mode]
    return f"trp AS (SELECT a.subject, a.task, a.band, a.ch_idx, {form} AS trp FROM pw a JOIN pw b ON a.subject = b.subject AND a.band = b.band AND a.ch_idx = b.ch_idx AND b.task = {base} WHERE a.task <> {base} AND a.band <> 'total')"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_ROWS = f"SELECT subject, task, band, ch_idx, round(trp, 6) + 0.0e0 AS trp FROM trp"
_MEANS = "rm AS (SELECT subject, task, band, hemisphere, region, avg(trp) AS value FROM trp JOIN places USING (ch_idx) WHERE hemisphere <> 'MID' GROUP BY ALL)"
_SEM = "round(avg(value), 6) + 0.0e0 AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END, 6) + 0.0e0 AS sem, count(value) AS n"

_EV = """evh AS (SELECT user_id // 50 AS subject, event_type AS ch, CAST((day(ts) - 1) * 24 + hour(ts) AS INT) AS h, value FROM events WHERE (day(ts) - 1) * 24 + hour(ts) BETWEEN 0 AND 719),
evm AS (SELECT subject, ch, h, avg(value) AS x FROM evh GROUP BY subject, ch, h),
evt AS (SELECT subject, ch, dense_rank() OVER (ORDER BY ch) - 1 AS ci FROM (SELECT DISTINCT subject, ch FROM evh)),
ev AS (SELECT subject, subject || ':' || (h // 240) AS task, e.ch, CAST(ci AS INT) AS ci, h % 240 AS t, h, coalesce(x, 0e0) AS x FROM evt e CROSS JOIN (SELECT unnest(range(720)) AS h) LEFT JOIN evm m USING (subject, ch, h))"""
_EDGES = """fx AS (SELECT task, ci, b, sum(x * cos(2 * pi() * ((b * t) % 240) / 240)) AS re, -sum(x * sin(2 * pi() * ((b * t) % 240) / 240)) AS im FROM ev, (SELECT unnest(range(121)) AS b) GROUP BY ALL),
hil AS (SELECT task, ci, t, sum(CASE WHEN b IN (0, 120) THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((b * t) % 240) / 240) - im * sin(2 * pi() * ((b * t) % 240) / 240))) / 240 AS re,
  sum(CASE WHEN b IN (0, 120) THEN 1 ELSE 2 END * (re * sin(2 * pi() * ((b * t) % 240) / 240) + im * cos(2 * pi() * ((b * t) % 240) / 240))) / 240 AS im FROM fx, (SELECT unnest(range(240)) AS t) GROUP BY ALL),
edges AS (SELECT a.task, a.ci AS i, b.ci AS j, CASE WHEN avg(abs(a.im * b.re - a.re * b.im)) < 1e-15 THEN 0 ELSE abs(avg(a.im * b.re - a.re * b.im)) / avg(abs(a.im * b.re - a.re * b.im)) END AS w
  FROM hil a JOIN hil b ON a.task = b.task AND a.t = b.t AND a.ci < b.ci GROUP BY ALL)"""


def _graph(least: float) -> str:
    return f"""thr AS (SELECT task, i, j, CASE WHEN w < {least} THEN 0 ELSE w END AS w FROM edges),
nodes AS (SELECT task, node FROM (SELECT task, i AS node FROM edges UNION SELECT task, j FROM edges)),
str AS (SELECT task, node, sum(w) AS strength FROM (SELECT task, i AS node, w FROM edges UNION ALL SELECT task, j, w FROM edges) GROUP BY ALL)"""


_THR = _graph(0.05)
_BETWEEN = """arcs AS (SELECT task, i AS a, j AS b, 1 / w AS d FROM thr WHERE w > 0 UNION ALL SELECT task, j, i, 1 / w FROM thr WHERE w > 0),
walk AS (SELECT task, a AS s, b AS e, [a, b] AS path, d FROM arcs UNION ALL SELECT w.task, s, b, list_append(path, b), w.d + arcs.d FROM walk w JOIN arcs ON w.task = arcs.task AND w.e = arcs.a WHERE NOT list_contains(path, b)),
best AS (SELECT *, min(d) OVER (PARTITION BY task, s, e) AS m FROM walk),
short AS (SELECT task, s, e, path, count(*) OVER (PARTITION BY task, s, e) AS n FROM best WHERE d = m),
btw AS (SELECT nodes.task, node, coalesce(sum(1e0 / n), 0) / 2 AS betweenness FROM nodes LEFT JOIN short ON nodes.task = short.task AND list_contains(path, node) AND node <> s AND node <> e GROUP BY ALL)"""


def _bandpass(lo: float, hi: float, fs: float) -> str:
    """bp(task, ci, t, x): ev filtered there and back by the fixed taps, 15 samples reflected oddly at each end."""
    b, a = butter_bandpass(lo, hi, fs)
    step = np.zeros((4, 4))
    step[:, 0] = -a[1:]
    step[[0, 1, 2], [1, 2, 3]] = 1
    rest = np.linalg.solve(np.eye(4) - step, b[1:] - a[1:] * b[0])

    def run(name: str, source: str) -> str:
        start = ", ".join(f"{r!r}::DOUBLE * e[1]" for r in rest.tolist())
        y, v = f"({float(b[0])!r} * e[i] + z1)", "e[i]"
        state = [f"z{k + 1} + {float(b[k])!r} * {v} - {float(a[k])!r} * {y}" if k < 4 else f"{float(b[4])!r} * {v} - {float(a[4])!r} * {y}" for k in range(1, 5)]
        return f"""{name}(task, ci, e, i, z1, z2, z3, z4, y) AS (SELECT task, ci, e, 1, {start}, CAST([] AS DOUBLE[]) FROM {source}
  UNION ALL SELECT task, ci, e, i + 1, {", ".join(state)}, list_append(y, {y}) FROM {name} WHERE i <= 270)"""

    return f"""xs AS (SELECT task, ci, list(CAST(x AS DOUBLE) ORDER BY t) AS x FROM ev GROUP BY task, ci),
ex AS (SELECT task, ci, list_concat([2 * x[1] - x[k + 1] for k in range(15, 0, -1)], x, [2 * x[240] - x[240 - k] for k in range(1, 16)]) AS e FROM xs),
{run("there", "ex")},
turned AS (SELECT task, ci, list_reverse(y) AS e FROM there WHERE i = 271),
{run("back", "turned")},
bp AS (SELECT task, ci, t, list_reverse(y)[t + 16] AS x FROM back, (SELECT unnest(range(240)) AS t) WHERE i = 271)"""


_LAB = "lab AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, event_type AS label FROM events)"
_RUNS = """mk AS (SELECT *, CASE WHEN lag(label) OVER o IS DISTINCT FROM label THEN 1 ELSE 0 END AS nw FROM lab WINDOW o AS (PARTITION BY subject ORDER BY t)),
rid AS (SELECT *, sum(nw) OVER (PARTITION BY subject ORDER BY t) AS run FROM mk),
runs AS (SELECT subject, run, any_value(label) AS label, min(t) AS start_sample, max(t) + 1 AS end_sample FROM rid GROUP BY subject, run)"""
_SMOOTH = """nr AS (SELECT a.subject, a.t, a.label AS own, b.label AS near, count(*) AS c FROM lab a JOIN lab b ON a.subject = b.subject AND b.t BETWEEN a.t - 2 AND a.t + 2 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY subject, t ORDER BY c DESC, CASE WHEN near = own THEN 0 ELSE 1 END, near) AS r FROM nr)"""
# runs of smoothed labels as lists; the first run shorter than two samples joins the longer neighbour until none is left
_MERGED = """sm AS (SELECT subject, t, near AS label FROM rk WHERE r = 1),
sk AS (SELECT *, CASE WHEN lag(label) OVER o IS DISTINCT FROM label THEN 1 ELSE 0 END AS nw FROM sm WINDOW o AS (PARTITION BY subject ORDER BY t)),
sr AS (SELECT subject, run, any_value(label) AS l, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY subject ORDER BY t) AS run FROM sk) GROUP BY subject, run),
mg(subject, r, k) AS (SELECT subject, r, coalesce(list_position([x.n < 2 for x in r], true), 0) FROM (SELECT subject, list({'l': l, 'n': n} ORDER BY run) AS r FROM sr GROUP BY subject)
  UNION ALL SELECT subject, r, coalesce(list_position([x.n < 2 for x in r], true), 0) FROM (
    SELECT subject, list_concat(r[1 : lo - 1], [{'l': l, 'n': CAST(list_sum([x.n for x in r[lo : hi]]) AS BIGINT)}], r[hi + 1 :]) AS r FROM (
      SELECT subject, r, l, CASE WHEN k > 1 AND r[k - 1].l = l THEN k - 1 ELSE k END AS lo, CASE WHEN k < len(r) AND r[k + 1].l = l THEN k + 1 ELSE k END AS hi FROM (
        SELECT subject, r, k, CASE WHEN coalesce(CASE WHEN k > 1 THEN r[k - 1].n END, -1) >= coalesce(r[k + 1].n, -1) THEN r[k - 1].l ELSE r[k + 1].l END AS l FROM mg WHERE k > 0 AND len(r) > 1)))),
mr AS (SELECT subject, unnest(r) AS x, generate_subscripts(r, 1) AS run FROM mg WHERE k = 0 OR len(r) = 1),
rw AS (SELECT subject, run, x.l AS label, x.n AS n, sum(x.n) OVER (PARTITION BY subject ORDER BY run) AS e FROM mr)"""
_GROUPS5 = """grp AS (SELECT rid.subject, rid.t // 5 AS grp, count(*) AS n, 100.0e0 * count(*) FILTER (WHERE end_sample - start_sample < 2) / count(*) AS hardness FROM rid JOIN runs USING (subject, run) GROUP BY ALL)"""
_FEAT = "ft AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS label, {c} AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")"
_STATS = """gs AS (SELECT feature, label, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, var_pop(value) * count(value) AS ss FROM ft GROUP BY ALL),
an AS (SELECT feature, count(*) - 1 AS df_b, CAST(sum(n) - count(*) AS BIGINT) AS df_w, (sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))) AS f, sum(ss) / (sum(n) - count(*)) AS msw FROM gs GROUP BY feature)"""
# three groups: F with two degrees of freedom has a closed tail; the range of three means by quadrature over place z and scale s
_RANGE = """zg AS (SELECT i, -9 + i * 0.005e0 AS z, exp(-pow(-9 + i * 0.005e0, 2) / 2) / sqrt(2 * pi()) AS phi FROM (SELECT unnest(range(3601)) AS i)),
zc AS (SELECT i, phi, sum(phi) OVER (ORDER BY i) * 0.005e0 - phi * 0.0025e0 AS c FROM zg),
qs AS (SELECT a.feature, a.label AS g1, b.label AS g2, abs(a.mean - b.mean) / sqrt(msw / 2 * (1e0 / a.n + 1e0 / b.n)) AS q, df_w FROM gs a JOIN gs b ON a.feature = b.feature AND a.label < b.label JOIN an ON an.feature = a.feature),
ss AS (SELECT *, 1 + (m - 60) / 60e0 * 8 / sqrt(2e0 * df_w) AS s, 8 / sqrt(2e0 * df_w) / 60 AS h FROM qs, (SELECT unnest(range(121)) AS m)),
sd AS (SELECT *, exp(df_w / 2e0 * ln(df_w) - lgamma(df_w / 2e0) - (df_w / 2e0 - 1) * ln(2e0) + (df_w - 1) * ln(s) - df_w * s * s / 2) AS w FROM ss),
sz AS (SELECT sd.*, zc.phi, zc.c, CAST(floor(zc.i - q * s / 0.005e0) AS BIGINT) AS lo, zc.i - q * s / 0.005e0 - floor(zc.i - q * s / 0.005e0) AS part FROM sd, zc),
sr AS (SELECT feature, g1, g2, m, any_value(w) AS w, any_value(h) AS h, sum(3 * phi * pow(sz.c - (coalesce(x.c, 0) * (1 - part) + coalesce(y.c, 0) * part), 2)) * 0.005e0 AS below
  FROM sz LEFT JOIN (SELECT i, c FROM zc) x ON x.i = lo LEFT JOIN (SELECT i, c FROM zc) y ON y.i = lo + 1 GROUP BY ALL),
tk AS (SELECT feature, g1, g2, least(1e0, greatest(0e0, 1 - sum(w * h * below))) AS p FROM sr GROUP BY ALL)"""
_SPLIT = """spl AS (SELECT vec_id AS sample_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.2e0) AS test FROM embeddings)"""
_SCALED = """lg AS (SELECT sample_id, label, test, k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM spl, (SELECT CAST(unnest(range(64)) AS INT) AS k)),
sc AS (SELECT k, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM lg WHERE NOT test GROUP BY k),
z AS (SELECT sample_id, label, test, k, (v - m) / s AS v FROM lg JOIN sc USING (k))"""
_KNN = """zz AS (SELECT sample_id, label, test, list(v ORDER BY k) AS v FROM z GROUP BY ALL),
dd AS (SELECT q.sample_id, q.label, t.label AS near, row_number() OVER (PARTITION BY q.sample_id ORDER BY list_distance(q.v, t.v), t.sample_id) AS r FROM zz q JOIN zz t ON q.test AND NOT t.test),
vt AS (SELECT sample_id, label, near, count(*) AS c FROM dd WHERE r <= 5 GROUP BY ALL),
knn AS (SELECT sample_id, label, arg_min(near, -c * 1000 + near) AS predicted FROM vt GROUP BY ALL)"""

_FOLDS = """fd AS (SELECT sample_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id) - 1) % 5 AS INT) AS fold FROM spl WHERE NOT test),
zf AS (SELECT sample_id, any_value(label) AS label, any_value(fold) AS fold, list(v ORDER BY k) AS v FROM z JOIN fd USING (sample_id) GROUP BY sample_id),
df AS (SELECT q.sample_id, q.label, q.fold, t.label AS near, row_number() OVER (PARTITION BY q.sample_id ORDER BY list_distance(q.v, t.v), t.sample_id) AS r FROM zf q JOIN zf t ON q.fold <> t.fold),
vf AS (SELECT sample_id, label, fold, near, count(*) AS c FROM df WHERE r <= 5 GROUP BY ALL),
kf AS (SELECT sample_id, label, fold, arg_min(near, -c * 1000 + near) AS predicted FROM vf GROUP BY ALL)"""

_EVW = "wx AS (SELECT CAST(subject * 6 + h // 120 AS INT) AS window_index, ci AS ch_idx, h % 120 AS t, x FROM ev)"
_TAPERS, _SHARES = slepian(200, 4.0)
_SC = f"""tp AS (SELECT k, j - 1 AS j, v[j] AS v, s FROM (SELECT k, v, s, unnest(range(1, 201)) AS j FROM (VALUES {", ".join(f"({k}, {[float(x) for x in taper]}::DOUBLE[], {float(s)!r}::DOUBLE)" for k, (taper, s) in enumerate(zip(_TAPERS, _SHARES, strict=True)))}) w(k, v, s))),
ep AS (SELECT subject, ci, e, h - e * 100 AS j, x - avg(x) OVER (PARTITION BY subject, ci, e) AS x FROM ev, (SELECT unnest(range(6)) AS e) WHERE h BETWEEN e * 100 AND e * 100 + 199),
sf AS (SELECT subject, ci, e, k, s, b, sum(x * v * cos(2 * pi() * b * ep.j / 200)) AS re, -sum(x * v * sin(2 * pi() * b * ep.j / 200)) AS im FROM ep JOIN tp USING (j), (SELECT unnest(range(16, 27)) AS b) GROUP BY ALL),
ce AS (SELECT p.subject, p.ci AS i, q.ci AS j, p.e, p.b, sum(p.s * (p.re * q.re + p.im * q.im)) / sum(p.s) AS re, sum(p.s * (p.im * q.re - p.re * q.im)) / sum(p.s) AS im,
  sum(p.s * (p.re * p.re + p.im * p.im)) / sum(p.s) AS pa, sum(p.s * (q.re * q.re + q.im * q.im)) / sum(p.s) AS pb
  FROM sf p JOIN sf q ON p.subject = q.subject AND p.e = q.e AND p.k = q.k AND p.b = q.b AND p.ci < q.ci GROUP BY ALL),
sb AS (SELECT subject, i, j, b, abs(avg(im)) / avg(abs(im)) AS wpli, sqrt(avg(re) * avg(re) + avg(im) * avg(im)) / sqrt(avg(pa) * avg(pb)) AS coh,
  sqrt(pow(avg(re / sqrt(re * re + im * im)), 2) + pow(avg(im / sqrt(re * re + im * im)), 2)) AS plv FROM ce GROUP BY ALL)"""

_MI = """st AS (SELECT task, ci, min(x) AS lo, max(x) AS hi, CAST(round_even(sqrt(count(*)), 0) AS INT) AS nb FROM ev GROUP BY ALL),
bn AS (SELECT task, ci, t, least(CAST(floor((x - lo) / (hi - lo) * nb) AS INT), nb - 1) AS b FROM ev JOIN st USING (task, ci)),
jt AS (SELECT p.task, p.ci AS i, q.ci AS j, p.b AS bi, q.b AS bj, count(*) AS c FROM bn p JOIN bn q ON p.task = q.task AND p.t = q.t AND p.ci <= q.ci GROUP BY ALL),
cl AS (SELECT *, sum(c) OVER (PARTITION BY task, i, j) AS n, sum(c) OVER (PARTITION BY task, i, j, bi) AS ni, sum(c) OVER (PARTITION BY task, i, j, bj) AS nj FROM jt),
mi AS (SELECT task, i, j, sum(c / n * (log2(c / n) - log2(ni / n) - log2(nj / n))) AS w FROM cl GROUP BY ALL)"""

ORACLE_SQL = {
    "montage_regions": _with(_MONTAGE, _PLACES, _SIG) + "SELECT CAST(ch_idx AS INT) AS ch_idx, channel, hemisphere, region, count(*) AS n_signals FROM places JOIN sig USING (ch_idx) GROUP BY ALL",
    "cz_interpolate": _with(_SIG) + f"SELECT subject, task, CAST(ch_idx + CASE WHEN ch_idx >= {CZ} THEN 1 ELSE 0 END AS INT) AS ch_idx, CAST(t AS BIGINT) AS t, round(x, 9) + 0.0e0 AS x FROM smp UNION ALL SELECT subject, task, CAST({CZ} AS INT), CAST(t AS BIGINT), round(avg(x), 9) + 0.0e0 FROM smp WHERE ch_idx IN {CZ_NEIGHBOURS} GROUP BY subject, task, t",
    "cz_verify": _with(_SIG) + "SELECT DISTINCT subject, task, block, true AS ok FROM sig, (VALUES ('before'), ('cz'), ('after')) v(block)",
    "welch_psd": _with(_PSD) + f"SELECT {_K}, CAST(b AS INT) AS bin, f, round(p, 12) + 0.0e0 AS p FROM psd",
    "band_power_abs": _with(_PSD, _POWER) + f"SELECT {_K}, band, round(power, 12) + 0.0e0 AS power FROM pw WHERE band <> 'total'",
    "band_power_rel": _with(_PSD, _POWER) + f"SELECT a.subject, a.task, a.ch_idx, a.band, round(a.power / (t.power + {_EPS}), 9) + 0.0e0 AS power FROM pw a JOIN pw t ON a.subject = t.subject AND a.task = t.task AND a.ch_idx = t.ch_idx AND t.band = 'total' WHERE a.band <> 'total'",
    "spectral_entropy": _with(_PSD, _IN, f"sh AS (SELECT {_K}, p / (sum(p) OVER (PARTITION BY {_K}) + {_EPS}) AS q FROM inn)") + f"SELECT {_K}, round(-sum(q * ln(q + {_EPS})), 9) + 0.0e0 AS entropy FROM sh GROUP BY {_K}",
    "spectral_moments": _with(_PSD, _IN, f"c AS (SELECT {_K}, sum(p) AS s, sum(f * p) / sum(p) AS m FROM inn GROUP BY {_K})", f"v AS (SELECT {_K}, any_value(s) AS s, any_value(m) AS m, sum(pow(f - m, 2) * p) / any_value(s) AS v, sum(pow(f - m, 3) * p) AS c3, sum(pow(f - m, 4) * p) AS c4 FROM inn JOIN c USING ({_K}) GROUP BY {_K})") + f"SELECT {_K}, round(m, 6) + 0.0e0 AS centroid, round(v, 6) + 0.0e0 AS variance, round(c3 / (s * pow(sqrt(v) + {_EPS}, 3)), 6) + 0.0e0 AS skewness, round(c4 / (s * pow(v + {_EPS}, 2)), 6) + 0.0e0 AS kurtosis FROM v",
    "spectral_edge_95": _with(_PSD, _IN, _edge(0.95, "sef95")) + "SELECT * FROM edge",
    "median_frequency": _with(_PSD, _IN, _edge(0.5, "f50")) + "SELECT * FROM edge",
    "peak_smoothed": _with(_PSD, _IN, _SMOOTHED) + f"SELECT {_K}, CASE WHEN max(p) > median(p) + 1e-12 THEN min(f) FILTER (WHERE p = m) END AS peak FROM (SELECT *, max(p) OVER (PARTITION BY {_K}) AS m FROM sm) GROUP BY {_K}",
    "peak_alpha": _with(_PSD) + f"SELECT {_K}, CASE WHEN max(p) > median(p) + 1e-12 THEN min(f) FILTER (WHERE p = m) END AS iaf FROM (SELECT *, max(p) OVER (PARTITION BY {_K}) AS m FROM psd WHERE f BETWEEN 8 AND 13) GROUP BY {_K}",
    "alpha_asymmetry": _with(_MONTAGE, _PSD, f"tz AS (SELECT {_K}, f, p, lag(p) OVER o AS q, lag(f) OVER o AS g FROM psd WHERE f BETWEEN 8 AND 13 WINDOW o AS (PARTITION BY {_K} ORDER BY f))", f"ar AS (SELECT subject, task, channel, sum((p + q) / 2 * (f - g)) AS a FROM tz JOIN montage USING (ch_idx) GROUP BY ALL)") + f"SELECT subject, task, round(ln(max(a) FILTER (WHERE channel = 'F4') + {_EPS}) - ln(max(a) FILTER (WHERE channel = 'F3') + {_EPS}), 9) + 0.0e0 AS faa FROM ar GROUP BY subject, task",
    "trp_logratio": _with(_PSD, _POWER, _trp("logratio")) + _ROWS,
    "trp_ln": _with(_PSD, _POWER, _trp("ln")) + _ROWS,
    "trp_db": _with(_PSD, _POWER, _trp("db")) + _ROWS,
    "trp_ratio": _with(_PSD, _POWER, _trp("ratio")) + _ROWS,
    "trp_auto_baseline": _with(_PSD, _POWER, _trp("logratio", "'1_idea generation'")) + _ROWS,
    "trp_region_mean_sem": _with(_MONTAGE, _PLACES, _PSD, _POWER, _trp("logratio"), _MEANS) + f"SELECT task, band, hemisphere, region, {_SEM} FROM rm GROUP BY ALL",
    "trp_collapsed_merged": _with(_MONTAGE, _PLACES, _PSD, _POWER, _trp("logratio"), _MEANS, "cl AS (SELECT subject, 'ideas' AS task, band, region, avg(value) AS value FROM rm GROUP BY ALL)") + f"SELECT task, band, region, {_SEM} FROM cl GROUP BY ALL",
    "wpli_edges": _with(_EV, _EDGES) + "SELECT task, i, j, round(w, 9) + 0.0e0 AS w FROM edges",
    "wpli_edges_bandpass": "WITH RECURSIVE " + ",\n".join((_EV, _bandpass(8.0, 13.0, 100.0), _EDGES.replace("FROM ev,", "FROM bp,"))) + "\nSELECT task, i, j, round(w, 9) + 0.0e0 AS w FROM edges",
    "mutual_information": _with(_EV, _MI) + "SELECT task, i, j, round(w, 6) + 0.0e0 AS mi FROM mi",
    "mi_graph_features": "WITH RECURSIVE " + ",\n".join((_EV, _MI, "edges AS (SELECT * FROM mi WHERE i < j)", _graph(0.7), _BETWEEN)) + "\nSELECT task, list_concat(list(round(betweenness, 6) + 0.0e0 ORDER BY node), list(round(strength, 6) + 0.0e0 ORDER BY node)) AS features FROM btw JOIN str USING (task, node) GROUP BY task",
    "spectral_connectivity": _with(_EV, _SC) + "SELECT CAST(subject AS VARCHAR) AS subject, i, j, round(avg(wpli), 6) + 0.0e0 AS wpli, round(avg(coh), 6) + 0.0e0 AS coh, round(avg(plv), 6) + 0.0e0 AS plv FROM sb GROUP BY subject, i, j UNION ALL SELECT DISTINCT CAST(subject AS VARCHAR), ci, ci, 0e0, 1e0, 1e0 FROM ev",
    "node_strength": _with(_EV, _EDGES, _THR) + "SELECT task, node, round(strength, 6) + 0.0e0 AS strength FROM str",
    "threshold_edges": _with(_EV, _EDGES, _THR) + "SELECT task, i, j, round(w, 6) + 0.0e0 AS w FROM thr",
    "node_betweenness": "WITH RECURSIVE " + ",\n".join((_EV, _EDGES, _THR, _BETWEEN)) + "\nSELECT task, node, round(betweenness, 6) + 0.0e0 AS betweenness FROM btw",
    "graph_features": "WITH RECURSIVE " + ",\n".join((_EV, _EDGES, _THR, _BETWEEN)) + "\nSELECT task, list_concat(list(round(betweenness, 6) + 0.0e0 ORDER BY node), list(round(strength, 6) + 0.0e0 ORDER BY node)) AS features FROM btw JOIN str USING (task, node) GROUP BY task",
    "graph_summary": _with(_EV, _EDGES, _THR) + "SELECT task, count(*) FILTER (WHERE w > 0) AS n_edges, round(count(*) FILTER (WHERE w > 0) / count(*), 9) + 0.0e0 AS density, (WITH RECURSIVE reach(task, node) AS (SELECT n.task, min(n.node) FROM nodes n GROUP BY n.task UNION SELECT r.task, CASE WHEN e.i = r.node THEN e.j ELSE e.i END FROM reach r JOIN thr e ON e.task = r.task AND e.w > 0 AND r.node IN (e.i, e.j)) SELECT count(*) FROM reach WHERE reach.task = thr.task) = (SELECT count(*) FROM nodes WHERE nodes.task = thr.task) AS connected FROM thr GROUP BY task",
    "top_strength": _with(_EV, _EDGES, _THR) + "SELECT task, node, round(strength, 6) + 0.0e0 AS strength, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY strength DESC, node) AS r FROM str) WHERE r <= 2",
    "connectivity_matrix": _with(_EV, _EDGES, _THR, "cells AS (SELECT task, i, j, w FROM edges UNION ALL SELECT task, j, i, w FROM edges UNION ALL SELECT task, node, node, 0 FROM nodes)", "mrow AS (SELECT task, i, list(round(w, 6) + 0.0e0 ORDER BY j) AS r FROM cells GROUP BY task, i)") + "SELECT task, list(i ORDER BY i) AS nodes, list(r ORDER BY i) AS matrix FROM mrow GROUP BY task",
    "label_runs": _with(_LAB, _RUNS) + "SELECT subject, label, start_sample, end_sample FROM runs",
    "label_smooth": _with(_LAB, _SMOOTH) + "SELECT subject, t, near AS label FROM rk WHERE r = 1",
    "run_windows": "WITH RECURSIVE " + ",\n".join((_LAB, _SMOOTH, _MERGED)) + "\nSELECT subject, CAST(run AS BIGINT) AS run, label, CAST(e - n AS BIGINT) AS start_sample, CAST(e AS BIGINT) AS end_sample, CAST(n AS BIGINT) AS n_samples, CASE WHEN n < 2 THEN 'shorter_than_min_window_samples' END AS reason, CAST(e - n AS DOUBLE) AS start_sec, CAST(e AS DOUBLE) AS end_sec, CAST(n AS DOUBLE) AS duration_sec FROM rw",
    "fine_groups": _with(_LAB, _RUNS, _GROUPS5) + "SELECT subject, grp, n, round(hardness, 6) + 0.0e0 AS hardness FROM grp",
    "macro_windows": _with(_LAB, _RUNS, _GROUPS5, "mw AS (SELECT subject, grp, row_number() OVER (PARTITION BY subject ORDER BY grp) - 1 AS k, avg(hardness) OVER o AS hardness, count(*) OVER o AS m FROM grp WINDOW o AS (PARTITION BY subject ORDER BY grp ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))") + "SELECT subject, k // 2 AS macro, grp AS first_group, round(hardness, 6) + 0.0e0 AS hardness FROM mw WHERE k % 2 = 0 AND (m = 3 OR k = 0)",
    "window_metrics": _with(_EV, _EVW, _welch("wx", "window_index, ch_idx", 64, 32, 2, 100.0), "inn AS (SELECT window_index, ch_idx, f, p FROM psd WHERE f BETWEEN 1 AND 45)", f"sh AS (SELECT window_index, ch_idx, p / (sum(p) OVER (PARTITION BY window_index, ch_idx) + {_EPS}) AS q FROM inn)", f"en AS (SELECT window_index, ch_idx, round(-sum(q * ln(q + {_EPS})), 6) + 0.0e0 AS entropy FROM sh GROUP BY ALL)", _edge(0.95, "sef95", "window_index, ch_idx")) + "SELECT window_index, ch_idx, entropy, sef95 FROM en JOIN edge USING (window_index, ch_idx)",
    "anova_groups": _with(_FEAT, _STATS) + "SELECT feature, label, n, round(mean, 6) + 0.0e0 AS mean, round(std, 6) + 0.0e0 AS std FROM gs",
    "anova_f": _with(_FEAT, _STATS) + "SELECT feature, round(f, 6) + 0.0e0 AS f, df_b, df_w, round(f * df_b / (f * df_b + df_w), 9) + 0.0e0 AS eta2 FROM an",
    "select_features": _with(_FEAT, _STATS) + "SELECT feature, round(f, 6) + 0.0e0 AS f FROM an ORDER BY an.f DESC, feature LIMIT 2",
    "bonferroni_t": _with(_FEAT, _STATS) + "SELECT a.feature, a.label AS g1, b.label AS g2, round(a.mean - b.mean, 6) + 0.0e0 AS diff, round((a.mean - b.mean) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1e0 / a.n + 1e0 / b.n)), 6) + 0.0e0 AS t, a.n + b.n - 2 AS df FROM gs a JOIN gs b ON a.feature = b.feature AND a.label < b.label",
    "tukey_q": _with(_FEAT, _STATS) + "SELECT a.feature, a.label AS g1, b.label AS g2, round(b.mean - a.mean, 6) + 0.0e0 AS diff, round(abs(a.mean - b.mean) / sqrt(msw / 2 * (1e0 / a.n + 1e0 / b.n)), 6) + 0.0e0 AS q FROM gs a JOIN gs b ON a.feature = b.feature AND a.label < b.label JOIN an ON an.feature = a.feature",
    "anova_p": _with(_FEAT, _STATS) + "SELECT feature, round(pow(df_w / (df_w + 2e0 * f), df_w / 2e0), 6) + 0.0e0 AS p FROM an",
    "tukey_p": _with(_FEAT, _STATS, _RANGE) + "SELECT feature, g1, g2, round(p, 4) + 0.0e0 AS p, p < 0.05 AS significant FROM tk",
    "stratified_split": _with(_SPLIT) + "SELECT sample_id, label, test FROM spl",
    "stratified_folds": _with(_SPLIT) + "SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id) - 1) % 5 AS INT) AS fold FROM spl WHERE NOT test",
    "standardise": _with(_SPLIT, _SCALED) + "SELECT sample_id, k, round(v, 6) + 0.0e0 AS v FROM z",
    "knn_predict": _with(_SPLIT, _SCALED, _KNN) + "SELECT sample_id, label, predicted FROM knn",
    "knn_confusion": _with(_SPLIT, _SCALED, _KNN) + "SELECT label, predicted, count(*) AS count FROM knn GROUP BY ALL",
    "knn_summary": _with(_SPLIT, _SCALED, _KNN) + "SELECT round(avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END), 9) + 0.0e0 AS accuracy, count(*) AS n FROM knn",
    "knn_report": _with(_SPLIT, _SCALED, _KNN, "sd AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = predicted) AS hit FROM knn GROUP BY label)", "pd AS (SELECT predicted AS label, count(*) AS said FROM knn GROUP BY predicted)", "pr AS (SELECT label, support, CASE WHEN coalesce(said, 0) > 0 THEN hit / said ELSE 0 END AS precision, hit / support AS recall FROM sd LEFT JOIN pd USING (label))") + "SELECT label, round(precision, 9) + 0.0e0 AS precision, round(recall, 9) + 0.0e0 AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) + 0.0e0 AS f1, support FROM pr",
    "knn_folds": _with(_SPLIT, _SCALED, _FOLDS) + "SELECT fold, round(avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END), 9) + 0.0e0 AS accuracy, count(*) AS n FROM kf GROUP BY fold",
    "task_classes": _with(_SIG) + "SELECT DISTINCT subject, task, CASE WHEN task LIKE '%idea generation%' THEN 'IDG' WHEN task LIKE '%rest%' THEN 'RST' END AS label FROM sig",
    "nonfinite_to_null": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN value END AS value FROM events",
}
