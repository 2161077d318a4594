"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import numpy as np

from ..operators.ridge import UPPER, N
from ..functions.uri import PARTS
from ..operators.references import ENTRY, FILE_BYTES, PRIVATE, SITE_BYTES, SITE_FILES, SUFFIXES
from ..operators.scan import (
    ACTIVE,
    ASSETS,
    ATTRIBUTE,
    BARE_LINK,
    CANONICAL,
    COMMENT,
    CONTAINERS,
    CREDENTIALS,
    CSS_URL,
    DRAWN,
    FETCHED,
    LINK,
    NETWORK,
    RELEASED_CREDENTIALS,
    REMOTE,
    RUNTIME,
    SCRIPT,
    SECURE,
    STYLE,
    SVG,
    TAG,
)
from ..operators.select import BLOCKED_SUFFIXES
from ..sources.synthetic import PARTITION
from .queries import COMPARED, FORECASTS, GLOBAL_WEIGHTS, ODD_PROPS, ROLE_WEIGHTS

TRACKS = r"""
ev AS (
  SELECT user_id, value AS x, CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS y, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
fr AS (
  SELECT 101 + user_id % 6 AS game_id, n // 20 + 1 AS play_id, user_id + 1 AS nfl_id, n % 20 + 1 AS f, x, y, event_type
  FROM ev QUALIFY count(*) OVER (PARTITION BY user_id, n // 20) = 20),
obs AS (SELECT game_id, play_id, nfl_id, f AS frame_id, x, y FROM fr WHERE f <= 8),
lab AS (SELECT game_id, play_id, nfl_id, f - 8 AS frame_id, x, y FROM fr WHERE f > 8),
ball AS (SELECT game_id, play_id, CAST(sum(CAST(round_even(x * 1e6::DOUBLE, 0) AS BIGINT)) AS DOUBLE) / (count(*) * 1e6::DOUBLE) AS bx,
         CAST(sum(CAST(round_even(y * 1e6::DOUBLE, 0) AS BIGINT)) AS DOUBLE) / (count(*) * 1e6::DOUBLE) AS bz FROM obs GROUP BY ALL),
st1 AS (
  SELECT *, (frame_id - lag(frame_id) OVER w) / 10.0::DOUBLE AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy,
         row_number() OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id DESC) AS back
  FROM obs WINDOW w AS (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id)),
st2 AS (
  SELECT *, (dx / dt - lag(dx / dt) OVER w) / ((dt + lag(dt) OVER w) / 2) AS ax, (dy / dt - lag(dy / dt) OVER w) / ((dt + lag(dt) OVER w) / 2) AS ay
  FROM st1 WINDOW w AS (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id)),
slope AS (
  SELECT game_id, play_id, nfl_id, n, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, n + 1), lambda i: (ts[i] - mt) * (xs[i] - mx))), lambda a, b: a + b) / spread AS sx,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, n + 1), lambda i: (ts[i] - mt) * (ys[i] - my))), lambda a, b: a + b) / spread AS sy
  FROM (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, list_transform(ts, lambda t: (t - mt) * (t - mt))), lambda a, b: a + b) AS spread FROM (
    SELECT *, list_reduce(list_prepend(0.0::DOUBLE, ts), lambda a, b: a + b) / n AS mt, list_reduce(list_prepend(0.0::DOUBLE, xs), lambda a, b: a + b) / n AS mx,
           list_reduce(list_prepend(0.0::DOUBLE, ys), lambda a, b: a + b) / n AS my FROM (
      SELECT game_id, play_id, nfl_id, count(*) AS n, list(frame_id / 10.0::DOUBLE ORDER BY frame_id) AS ts, list(x ORDER BY frame_id) AS xs, list(y ORDER BY frame_id) AS ys
      FROM st1 WHERE back <= 5 GROUP BY ALL)))),
cnt AS (SELECT game_id, play_id, nfl_id, count(*) AS n_observed, min(frame_id) = 1 AND max(frame_id) = count(*) AND count(*) >= 2 AS contiguous FROM obs GROUP BY ALL),
st AS (
  SELECT s.game_id, s.play_id, s.nfl_id, s.x, s.y, coalesce(dx / dt, 0) AS vx, coalesce(dy / dt, 0) AS vy, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy,
         coalesce(ax, 0) AS ax, coalesce(ay, 0) AS ay, CASE WHEN p.n < 2 THEN 0 ELSE p.sx END AS sx, CASE WHEN p.n < 2 THEN 0 ELSE p.sy END AS sy,
         bx, bz, fr.event_type AS player_role, n_observed, contiguous
  FROM st2 s JOIN slope p USING (game_id, play_id, nfl_id) JOIN cnt USING (game_id, play_id, nfl_id) JOIN ball USING (game_id, play_id)
       JOIN fr ON fr.game_id = s.game_id AND fr.play_id = s.play_id AND fr.nfl_id = s.nfl_id AND fr.f = 8
  WHERE s.back = 1),
rq AS (SELECT l.game_id, l.play_id, l.nfl_id, l.frame_id, l.x AS tx, l.y AS ty, st.* EXCLUDE (game_id, play_id, nfl_id), l.frame_id / 10.0::DOUBLE AS t,
         l.frame_id / 12.0::DOUBLE AS q FROM lab l JOIN st USING (game_id, play_id, nfl_id))"""

KEYS = "game_id, play_id, nfl_id, frame_id"
ENTITY = "game_id, play_id, nfl_id"


#: 0.9 + 0.9**2 + ..., added step by step, for each frame of a forecast.
_DAMPED = "(SELECT list(m ORDER BY k) FROM (WITH RECURSIVE s AS (SELECT 1 AS k, 0.9::DOUBLE AS m, 0.9::DOUBLE * 0.9::DOUBLE AS v UNION ALL SELECT k + 1, m + v, v * 0.9::DOUBLE FROM s WHERE k < 12) SELECT k, m FROM s))"


def _exact(expression: str) -> str:
    """To 6 digits as text, which DuckDB writes from the exact value, ties to even."""
    return f"CAST(format('{{:.6f}}', {expression}) AS DOUBLE)"


def _model(name: str, a: str) -> str:
    ball = "bx" if a == "x" else "bz"
    return {
        "last_position": f"{a}",
        "constant_velocity": f"{a} + v{a} * t",
        "constant_velocity_frames": _exact(f"{a} + frame_id * d{a}"),
        "smoothed_velocity": f"{a} + s{a} * t",
        "constant_acceleration": f"{a} + v{a} * t + a{a} * t * t / 2",
        "ball_arrival": f"{a} + ({ball} - {a}) * q",
        "damped_velocity": _exact(f"{a} + {_DAMPED}[frame_id] * d{a}"),
    }[name]


def _errors(models: tuple[str, ...] = COMPARED) -> str:
    each = [f"SELECT '{m}' AS model, {KEYS}, {_model(m, 'x')} - tx AS dx, {_model(m, 'y')} - ty AS dy FROM rq" for m in models]
    return TRACKS + ",\ner AS (" + "\n UNION ALL ".join(each) + "),\nsq AS (SELECT *, dx * dx + dy * dy AS e, sqrt(dx * dx + dy * dy) AS d FROM er)"


_PARTITIONS = "part AS (SELECT * FROM (VALUES " + ", ".join(f"({g}, '{p}')" for g, p in PARTITION.items()) + ") v(game_id, partition))"


def _with(body: str, select: str) -> str:
    return f"WITH {body}\n{select}"


def _pooled(by: str, models: tuple[str, ...] = COMPARED, named: str = "", where: str = "", join: str = "", extra: str = "") -> str:
    return _with(
        _errors(models) + extra,
        f"SELECT model, {named or by}, count(*) AS n, round(sqrt(sum(e) / (2.0 * count(*))), 6) AS rmse FROM sq {join} {where} GROUP BY model, {by}",
    )


def _terms(a: str) -> list[str]:
    ball = "bx" if a == "x" else "bz"
    return [f"v{a} * t", f"s{a} * t", f"a{a} * t * t / 2", f"({ball} - {a}) * q", f"({ball} - {a}) * q * q", f"({ball} - {a}) * q * q * q"]


_BASIS = TRACKS + ",\nba AS (SELECT *, " + ", ".join(f"{e} AS f{a}{k}" for a in "xy" for k, e in enumerate(_terms(a), 1)) + " FROM rq)"
_ROUNDED_BASIS = ", ".join(f"{_exact(f'f{a}{k}')} AS f{a}{k}" for a in "xy" for k in range(1, N + 1))
_GRAM = ", ".join(
    [f"round(sum(fx{i} * fx{j} + fy{i} * fy{j}) / (2 * count(*)), 4) AS g{i}{j}" for i, j in UPPER]
    + [f"round(sum(fx{i} * (tx - x) + fy{i} * (ty - y)) / (2 * count(*)), 4) AS r{i}" for i in range(1, N + 1)]
)


def _weight(k: int) -> str:
    cases = " ".join(f"WHEN '{r}' THEN {w[k]}::DOUBLE" for r, w in ROLE_WEIGHTS.items())
    return f"CASE player_role {cases} ELSE {GLOBAL_WEIGHTS[k]}::DOUBLE END"


def _ridge(a: str) -> str:
    return _exact(f"{a} + " + " + ".join(f"f{a}{k + 1} * {_weight(k)}" for k in range(N))) + f" AS {a}"


_INCOMPLETE = (
    TRACKS
    + f",\ntr AS (SELECT * FROM lab WHERE NOT (frame_id = 12 AND nfl_id % 7 = 0)), pr AS (SELECT {KEYS}, x, y FROM rq WHERE (frame_id + nfl_id) % 10 <> 0)"
)
_PAIRS = (
    _errors()
    + """,
gs AS (SELECT model, game_id, count(*) AS n, sum(e) AS sse FROM sq GROUP BY ALL),
pg AS (SELECT a.model AS model_a, b.model AS model_b, a.game_id, a.n, a.sse AS sa, b.sse AS sb FROM gs a JOIN gs b USING (game_id) WHERE a.model < b.model)"""
)
_GAMES = "gm AS (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) * 100 + user_id % 2 AS game_id, user_id FROM events)"
_SPLIT = (
    _GAMES
    + """,
dg AS (SELECT DISTINCT game_id, strptime(substr(CAST(game_id AS VARCHAR), 1, 8), '%Y%m%d')::DATE AS game_date FROM gm),
dy AS (SELECT game_date, row_number() OVER (ORDER BY game_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT game_date FROM dg)),
sp AS (
  SELECT game_id, CAST(game_date AS VARCHAR) AS game_date,
         CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'holdout' END AS split
  FROM dg JOIN dy USING (game_date))"""
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _hits(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), {_quoted(pattern)}))"


_LINKS = (
    f"pg AS (SELECT page_id, coalesce(html, '') AS html, list_concat(regexp_extract_all(coalesce(html, ''), {_quoted(LINK)}, 1), "
    f"regexp_extract_all(coalesce(html, ''), {_quoted(BARE_LINK)}, 1)) AS l FROM pages)"
)
#: Tags with their attributes; `fe`: the addresses that are fetched with a page.
_TAGS = f"""tg AS (
  SELECT *, row_number() OVER () AS tag_id FROM (
    SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      {_quoted(COMMENT)}, '', 'g'), {_quoted(SCRIPT)}, '\\1\\2', 'g'), {_quoted(STYLE)}, '\\1\\2', 'g'), {_quoted(TAG)})) AS tag FROM pages)),
av AS (
  SELECT page_id, url, tag_id, lower(regexp_extract(tag, '^<([A-Za-z0-9]+)', 1)) AS name, lower(regexp_extract(a, {_quoted(ATTRIBUTE)}, 1)) AS attribute,
         trim(replace(regexp_replace(regexp_extract(a, {_quoted(ATTRIBUTE)}, 2), '^["'']|["'']$', '', 'g'), '&amp;', '&')) AS value
  FROM (SELECT *, unnest(regexp_extract_all(tag, {_quoted(ATTRIBUTE)})) AS a FROM tg)),
cn AS (SELECT DISTINCT tag_id FROM av WHERE name = 'link' AND attribute = 'rel' AND lower(value) = 'canonical'),
fe AS (SELECT page_id, value FROM av ANTI JOIN cn USING (tag_id)
       WHERE name IN ({", ".join(map(_quoted, RUNTIME))}) AND attribute IN ({", ".join(map(_quoted, FETCHED))}))"""


def _without_dots(path: str) -> str:
    fold = (
        f"list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace({path}, '^/', ''), '/'), lambda s: [s])), "
        "lambda k, s: CASE s[1] WHEN '.' THEN k WHEN '..' THEN k[:-2] ELSE list_append(k, s[1]) END)"
    )
    return (
        f"CASE WHEN regexp_matches({path}, '(?:^|/)\\.\\.?(?:/|$)') THEN CASE WHEN {path} LIKE '/%' THEN '/' ELSE '' END || "
        f"array_to_string(list_concat({fold}, CASE WHEN regexp_matches({path}, '(?:^|/)\\.\\.?$') THEN [''] ELSE []::VARCHAR[] END), '/') ELSE {path} END"
    )


def _part(address: str, k: int) -> str:
    return f"regexp_extract({address}, {_quoted(PARTS)}, {k})"


_KEY = "lower({0}_scheme) || '://' || lower({0}_host) || url_decode(CASE WHEN {0}_path = '' THEN '/' ELSE {0}_path END) || CASE WHEN {0}_query <> '' THEN '?' || {0}_query ELSE '' END"
_GRAPH = f"""{_TAGS},
rf AS (
  SELECT page_id, CASE WHEN name = 'a' THEN 'link' WHEN tag_id IN (FROM cn) THEN 'canonical' ELSE 'runtime' END AS kind, value AS reference, url
  FROM av WHERE value <> '' AND (name = 'a' AND attribute = 'href' OR name IN ({", ".join(map(_quoted, RUNTIME))}) AND attribute IN ({", ".join(map(_quoted, FETCHED))}))
  UNION ALL SELECT * FROM (SELECT page_id, 'css', unnest(regexp_extract_all(coalesce(html, ''), {_quoted(CSS_URL)}, 1)) AS r, url FROM pages) WHERE r <> ''),
sp AS (
  SELECT *, {_part("url", 1)} AS b_scheme, {_part("url", 2)} AS b_host, {_part("url", 3)} AS b_path, {_part("url", 4)} AS b_query,
         lower({_part("reference", 1)}) AS scheme, {_part("reference", 2)} AS host, {_part("reference", 3)} AS path, {_part("reference", 4)} AS query FROM rf),
rs AS (
  SELECT *, CASE WHEN scheme <> '' THEN scheme ELSE b_scheme END AS t_scheme, CASE WHEN scheme <> '' OR host <> '' THEN host ELSE b_host END AS t_host,
         CASE WHEN scheme = '' AND host = '' AND path = '' THEN b_path WHEN scheme <> '' OR host <> '' OR path LIKE '/%' THEN {_without_dots("path")}
              ELSE {_without_dots("(regexp_extract(b_path, '^(.*/)?') || path)")} END AS t_path,
         CASE WHEN scheme = '' AND host = '' AND path = '' AND query = '' THEN b_query ELSE query END AS t_query FROM sp),
ta AS (SELECT *, {_KEY.format("t")} AS key,
         t_scheme || ':' || CASE WHEN t_host <> '' THEN '//' || t_host ELSE '' END || t_path || CASE WHEN t_query <> '' THEN '?' || t_query ELSE '' END AS target FROM rs),
kn AS (SELECT DISTINCT {_KEY.format("u")} AS key FROM (
  SELECT {_part("url", 1)} AS u_scheme, {_part("url", 2)} AS u_host, {_part("url", 3)} AS u_path, {_part("url", 4)} AS u_query FROM pages WHERE url IS NOT NULL))"""

#: The pages as files of their hosts, `index.html` where the path ends in a slash.
_SITE = f"""fl AS (
  SELECT site, path, strlen(text) AS bytes, text, lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1)) AS kind FROM (
    SELECT {_part("url", 2)} AS site, ltrim({_part("url", 3)} || CASE WHEN regexp_matches({_part("url", 3)}, '(^|/)$') THEN 'index.html' ELSE '' END, '/') AS path,
           coalesce(html, '') AS text FROM pages WHERE url IS NOT NULL)),
si AS (SELECT site, sum(bytes) AS bytes, count(*) AS n, list(path) AS paths,
         coalesce(bool_or(regexp_matches(text, '(?i)synthetic')) FILTER (path LIKE '%.html'), false) AS marked FROM fl GROUP BY site)"""


def _rule(name: str, broken: str, detail: str = "''") -> str:
    return f"SELECT site, path, '{name}' AS rule, {detail} AS detail FROM fl WHERE {broken}"


_SITE_RULES = [
    _rule("suffix", f"kind NOT IN ({', '.join(map(_quoted, SUFFIXES))})", "kind"),
    _rule("size", f"bytes > {FILE_BYTES}", "CAST(bytes AS VARCHAR)"),
    *[_rule("credential", f"regexp_matches(text, {_quoted(p)})", _quoted(k)) for k, p in RELEASED_CREDENTIALS.items()],
    _rule("private_locator", f"regexp_matches(text, {_quoted(PRIVATE)})"),
    _rule("network", f"regexp_matches(text, {_quoted(NETWORK)}) OR regexp_matches(text, '\\bimport\\s*\\(|\\bimportScripts\\s*\\(')"),
    _rule("container", f"kind = '.html' AND regexp_matches(text, '(?i)<({'|'.join(CONTAINERS)})\\b')"),
    _rule("css_import", f"kind IN ('.html', '.svg', '.css') AND regexp_matches(text, '(?i)@import')"),
    *[f"SELECT site, NULL, 'entry', '{e}' FROM si WHERE NOT list_contains(paths, '{e}')" for e in ENTRY],
    f"SELECT site, NULL, 'total_size', CAST(bytes AS VARCHAR) FROM si WHERE bytes > {SITE_BYTES}",
    f"SELECT site, NULL, 'count', CAST(n AS VARCHAR) FROM si WHERE n > {SITE_FILES}",
    "SELECT site, NULL, 'marker', '(?i)synthetic' FROM si WHERE NOT marked",
]

def _draws(seed: int, repeats: int) -> str:
    """`dr`: draws of rep and g, each of `gn`'s k games, by a permuted congruential generator of 128 bits in two halves."""
    start, multiplier = np.random.PCG64(seed).state["state"], 0x2360ED051FC65DA44385DF649FCCF645
    half = 1 << 64
    (s1, s0), (m1, m0), (c1, c0) = (divmod(v, half) for v in (start["state"], multiplier, start["inc"]))
    u = lambda v: f"{v}::UHUGEINT"
    low = f"(lo * {u(m0)}) % {u(half)} + {u(c0)}"
    high = f"(lo * {u(m0)}) // {u(half)} + (lo * {u(m1)}) % {u(half)} + (hi * {u(m0)}) % {u(half)} + {u(c1)} + ({low}) // {u(half)}"
    return f"""pc AS (
  SELECT 0 AS i, {u(s1)} AS hi, {u(s0)} AS lo UNION ALL
  SELECT i + 1, ({high}) % {u(half)}, ({low}) % {u(half)} FROM pc WHERE i < {repeats} * (SELECT max(k) FROM gn) / 2 + 8),
ou AS (SELECT i, xor(hi::UBIGINT, lo::UBIGINT)::UHUGEINT AS x, (hi // {u(1 << 58)})::INTEGER AS r FROM pc WHERE i > 0),
wo AS (SELECT i, x // (1::UHUGEINT << r::UHUGEINT) + (x * (1::UHUGEINT << (64 - r)::UHUGEINT)) % {u(half)} AS v FROM ou),
w32 AS (SELECT 2 * i AS p, (v % {u(1 << 32)})::BIGINT AS w FROM wo UNION ALL SELECT 2 * i + 1, (v // {u(1 << 32)})::BIGINT FROM wo),
ac AS (SELECT row_number() OVER (ORDER BY p) - 1 AS place, (w::HUGEINT * k // {1 << 32})::BIGINT AS g, k
       FROM w32, (SELECT max(k) AS k FROM gn) WHERE (w::HUGEINT * k) % {1 << 32} >= {1 << 32} % k),
dr AS (SELECT place // k AS rep, g FROM ac WHERE place < {repeats} * k)"""


_DRAWS = _draws(2026, 2000)

ORACLES: dict[str, str] = {
    "terminal_state": _with(
        TRACKS,
        f"SELECT {ENTITY}, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in ("x", "y", "vx", "vy", "dx", "dy", "ax", "ay"))
        + ", player_role, n_observed, contiguous FROM st",
    ),
    "smoothed_slope": _with(TRACKS, f"SELECT {ENTITY}, round(sx, 6) AS sx, round(sy, 6) AS sy FROM st"),
    "motion_basis": _with(_BASIS, f"SELECT {KEYS}, {_ROUNDED_BASIS} FROM ba"),
    "role_gram": _with(
        _BASIS, f"SELECT player_role, grouping(player_role) = 1 AS is_total, 2 * count(*) AS n, {_GRAM} FROM ba GROUP BY ROLLUP (player_role)"
    ),
    "ridge_forecast": _with(_BASIS, f"SELECT {KEYS}, {_ridge('x')}, {_ridge('y')} FROM ba"),
    "rmse_by_game": _pooled("game_id", ("constant_velocity_frames", "last_position")),
    "metrics_all": _with(
        _errors()
        + f""",
tk AS (SELECT model, {ENTITY}, avg(d) AS mean, max_by(d, frame_id) AS final FROM sq GROUP BY ALL),
tm AS (SELECT model, avg(mean) AS trajectory_ade, avg(final) AS fde FROM tk GROUP BY model),
fm AS (SELECT model, count(*) AS n, sqrt(sum(e) / (2.0 * count(*))) AS coordinate_rmse, avg(d) AS frame_ade,
         quantile_cont(d, 0.95) AS p95_displacement, sum(abs(dx) + abs(dy)) / (2.0 * count(*)) AS coordinate_mae FROM sq GROUP BY model)""",
        "SELECT model, n, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in ("coordinate_rmse", "frame_ade", "trajectory_ade", "fde", "p95_displacement", "coordinate_mae"))
        + " FROM fm JOIN tm USING (model)",
    ),
    "rmse_by_partition": _pooled("partition", join="JOIN part USING (game_id)", extra=",\n" + _PARTITIONS),
    "rmse_by_horizon": _pooled("bucket", join=", LATERAL (SELECT 'frames_' || ((frame_id - 1) // 4 * 4 + 1) || '_' || ((frame_id - 1) // 4 * 4 + 4) AS bucket) b"),
    "holdout_prefix": _with(
        _errors() + ",\n" + _PARTITIONS,
        "SELECT model, count(*) AS n, round(sqrt(sum(e) / (2.0 * count(*))), 6) AS rmse FROM sq JOIN part USING (game_id) "
        "WHERE partition = 'holdout' AND frame_id <= 6 GROUP BY model",
    ),
    "trajectory_diagnostics": _with(
        _errors(("constant_velocity", "ball_arrival")),
        f"SELECT model, {ENTITY}, count(*) AS n, max(frame_id) AS last_frame, {_exact('list_reduce(list_prepend(0.0::DOUBLE, list(e ORDER BY frame_id)), lambda a, b: a + b)')} AS sse, round(sqrt(sum(e) / (2.0 * count(*))), 6) AS rmse, "
        f"round(avg(d), 6) AS ade, round(max_by(d, frame_id), 6) AS fde, round(max(d), 6) AS max_displacement FROM sq GROUP BY model, {ENTITY}",
    ),
    "paired_by_game": _with(
        _PAIRS,
        "SELECT model_a, model_b, game_id, grouping(game_id) = 1 AS is_pooled, CAST(sum(n) AS BIGINT) AS n, "
        "round(sqrt(sum(sb) / (2.0 * sum(n))) - sqrt(sum(sa) / (2.0 * sum(n))), 6) AS rmse_delta, round(sum(sb) - sum(sa), 3) AS sse_delta "
        "FROM pg GROUP BY GROUPING SETS ((model_a, model_b, game_id), (model_a, model_b))",
    ),
    "paired_win_loss": _with(
        _PAIRS,
        "SELECT model_a, model_b, count(*) FILTER (WHERE sb < sa) AS wins, count(*) FILTER (WHERE sb > sa) AS losses, "
        "count(*) FILTER (WHERE sb = sa) AS ties FROM pg GROUP BY ALL",
    ),
    "leave_one_game_out": _with(
        _PAIRS,
        "SELECT model, game_id, CAST(sum(n) OVER w - n AS BIGINT) AS n, round(sqrt((sum(sse) OVER w - sse) / (2.0 * (sum(n) OVER w - n))), 6) AS rmse "
        "FROM gs WINDOW w AS (PARTITION BY model)",
    ),
    "bootstrap_rmse": _with(
        "RECURSIVE " + _errors(("constant_velocity", "last_position"))
        + ",\ngs AS (SELECT model, game_id, count(*) AS n, sum(e) AS sse FROM sq GROUP BY ALL),\n"
        + "gn AS (SELECT game_id, row_number() OVER (ORDER BY game_id) - 1 AS g, count(*) OVER () AS k FROM (SELECT DISTINCT game_id FROM gs)),\n"
        + _DRAWS,
        "SELECT model, rep, round(sqrt(sum(sse) / (2.0 * sum(n))), 6) AS rmse FROM dr JOIN gn USING (g) JOIN gs USING (game_id) GROUP BY model, rep",
    ),
    "error_timeline": _pooled("frame_id"),
    "cumulative_horizon": _with(
        _errors() + ",\nfs AS (SELECT model, frame_id, count(*) AS n, sum(e) AS sse FROM sq GROUP BY ALL)",
        "SELECT model, frame_id AS horizon, CAST(sum(n) OVER w AS BIGINT) AS n, round(sqrt(sum(sse) OVER w / (2.0 * sum(n) OVER w)), 6) AS rmse "
        "FROM fs WINDOW w AS (PARTITION BY model ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
    "track_by_method": _pooled("nfl_id"),
    "alignment_outer": _with(
        _INCOMPLETE,
        "SELECT coalesce(tr.game_id, pr.game_id) AS game_id, CASE WHEN tr.game_id IS NULL THEN 'prediction_only' WHEN pr.game_id IS NULL "
        f"THEN 'truth_only' ELSE 'both' END AS status, count(*) AS n FROM tr FULL JOIN pr USING ({KEYS}) GROUP BY ALL",
    ),
    "request_anti": _with(_INCOMPLETE, f"SELECT {KEYS} FROM tr ANTI JOIN pr USING ({KEYS})"),
    "coverage_cross": _with(
        _INCOMPLETE
        + f""",
need AS (SELECT m AS model, {KEYS} FROM tr, (VALUES ('last_position'), ('constant_velocity')) v(m)),
have AS (SELECT 'last_position' AS model, {KEYS} FROM pr)""",
        f"SELECT model, 'missing' AS status, count(*) AS n FROM need ANTI JOIN have USING (model, {KEYS}) GROUP BY ALL "
        f"UNION ALL SELECT model, 'extra', count(*) FROM have ANTI JOIN need USING (model, {KEYS}) GROUP BY ALL",
    ),
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "contiguity_check": _with(
        TRACKS
        + f""",
pe AS (SELECT {ENTITY}, count(*) AS n, min(frame_id) = 1 AND max(frame_id) = count(*) AND count(DISTINCT frame_id) = count(*) AND count(*) >= 2 AS contiguous
       FROM obs WHERE NOT (nfl_id % 9 = 0 AND frame_id = 3) GROUP BY {ENTITY})""",
        "SELECT contiguous, n, count(*) AS entities FROM pe GROUP BY ALL",
    ),
    "horizon_audit": _with(
        TRACKS
        + f""",
fo AS (SELECT {ENTITY}, min(frame_id) AS first, max(frame_id) AS last, count(*) AS n FROM lab WHERE NOT (frame_id = 12 AND nfl_id % 7 = 0) GROUP BY {ENTITY}),
ex AS (SELECT {ENTITY}, CAST(12 AS BIGINT) AS num_frames_output FROM st WHERE nfl_id % 11 <> 0)""",
        f"SELECT {ENTITY}, first, last, n, num_frames_output FROM fo FULL JOIN ex USING ({ENTITY}) "
        "WHERE NOT coalesce(first = 1 AND last = num_frames_output AND n = num_frames_output, false)",
    ),
    "nonfinite_check": _with(TRACKS, "SELECT game_id, count(*) AS n FROM obs WHERE nfl_id % 13 = 0 OR nfl_id % 17 = 0 OR x IS NULL OR y IS NULL GROUP BY game_id"),
    "rule_counts": _with(
        TRACKS,
        "SELECT 'keys' AS rule, (SELECT count(*) FROM obs WHERE frame_id < 1) AS violations "
        f"UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT {KEYS} FROM obs GROUP BY ALL HAVING count(*) > 1)) "
        "UNION ALL SELECT 'finite', (SELECT count(*) FROM obs WHERE x IS NULL OR y IS NULL) UNION ALL SELECT 'horizon', 0 "
        "UNION ALL SELECT 'ids', (SELECT count(*) FROM lab WHERE game_id <= 0 OR play_id <= 0 OR nfl_id <= 0 OR frame_id <= 0 OR frame_id > 120)",
    ),
    "temporal_split": _with(_SPLIT, "SELECT * FROM sp"),
    "split_counts": _with(_SPLIT, "SELECT split, count(*) AS n FROM sp GROUP BY split"),
    "group_disjoint": _with(_GAMES, "SELECT game_id, count(DISTINCT user_id) AS places FROM gm GROUP BY game_id HAVING count(DISTINCT user_id) > 1"),
    "distinct_plays": _with(
        TRACKS, "SELECT game_id, count(DISTINCT play_id) AS plays, count(*) AS n, max(frame_id) AS last, min(frame_id) AS first FROM obs GROUP BY game_id"
    ),
    "game_list": _with(
        TRACKS,
        "SELECT player_role, string_agg(CAST(game_id AS VARCHAR), ',' ORDER BY game_id) AS games FROM (SELECT DISTINCT player_role, game_id FROM st) GROUP BY player_role",
    ),
    "view_bounds": _with(
        TRACKS
        + f""",
pt AS (SELECT game_id, play_id, x, y FROM obs UNION ALL
       SELECT game_id, play_id, {_model("constant_velocity_frames", "x")}, {_model("constant_velocity_frames", "y")} FROM rq)""",
        "SELECT game_id, play_id, least(greatest(floor(min(x)) - 1, 0), 120.0::DOUBLE) AS x_low, least(greatest(ceil(max(x)) + 1, 0), 120.0::DOUBLE) AS x_high, "
        "least(greatest(floor(min(y)) - 1, 0), 53.333::DOUBLE) AS y_low, least(greatest(ceil(max(y)) + 1, 0), 53.333::DOUBLE) AS y_high FROM pt GROUP BY ALL",
    ),
    "framed_bounds": _with(
        TRACKS
        + f""",
pt AS (SELECT game_id, play_id, x, y FROM obs UNION ALL
       SELECT game_id, play_id, {_model("constant_velocity_frames", "x")}, {_model("constant_velocity_frames", "y")} FROM rq),
en AS (SELECT game_id, play_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY ALL),
sp AS (SELECT *, greatest(15, y1 - y0 + 8, (x1 - x0 + 8) * 402 / 700) AS h FROM en),
lo AS (SELECT *, h * 700 / 402 AS w, greatest(0, least(120 - h * 700 / 402, (x0 + x1) / 2 - h * 700 / 402 / 2)) AS x_low,
         greatest(0, least(53.333::DOUBLE - h, (y0 + y1) / 2 - h / 2)) AS y_low FROM sp)""",
        "SELECT game_id, play_id, round(x_low, 6) AS x_low, round(x_low + w, 6) AS x_high, round(y_low, 6) AS y_low, round(y_low + h, 6) AS y_high FROM lo",
    ),
    "panel_scale": _with(
        TRACKS
        + f""",
pt AS (SELECT {ENTITY}, x, y FROM obs UNION ALL SELECT {ENTITY}, x, y FROM lab UNION ALL
       SELECT {ENTITY}, {_model("constant_velocity_frames", "x")}, {_model("constant_velocity_frames", "y")} FROM rq),
en AS (SELECT {ENTITY}, floor(min(x)) - 1 AS x0, ceil(max(x)) + 1 AS x1, floor(min(y)) - 1 AS y0, ceil(max(y)) + 1 AS y1 FROM pt GROUP BY ALL)""",
        f"SELECT {ENTITY}, round((x0 + x1) / 2, 6) AS center_x, round((y0 + y1) / 2, 6) AS center_y, round(least(280 / (x1 - x0), 235 / (y1 - y0)), 6) AS scale FROM en",
    ),
    "track_labels": _with(
        TRACKS,
        f"SELECT DISTINCT {ENTITY}, chr(CAST(65 + (nfl_id - 1) % 26 AS INTEGER)) AS letter, "
        "'Game ' || game_id || ', play ' || lpad(CAST(play_id AS VARCHAR), 3, '0') AS title FROM obs",
    ),
    "document_sha256": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "secret_scan": " UNION ALL ".join(
        f"SELECT '{k}' AS pattern, count(*) FILTER (WHERE {_hits(p)} > 0) AS documents, CAST(sum({_hits(p)}) AS BIGINT) AS matches FROM documents"
        for k, p in CREDENTIALS.items()
    ),
    "link_extract": _with(
        _LINKS,
        "SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct, "
        f"CAST(len(list_filter(l, lambda x: regexp_matches(x, {_quoted(REMOTE)}))) AS BIGINT) AS n_remote FROM pg",
    ),
    "remote_ref_scan": _with(
        _TAGS,
        f"SELECT page_id, regexp_matches(coalesce(html, ''), {_quoted(ACTIVE)}) AS active, regexp_matches(coalesce(html, ''), {_quoted(NETWORK)}) AS network, "
        f"page_id IN (SELECT page_id FROM fe WHERE regexp_matches(value, {_quoted(REMOTE)})) AS remote FROM pages",
    ),
    "reference_graph": _with(
        _GRAPH,
        """SELECT page_id, kind, reference, target, CASE WHEN reference LIKE '#%' THEN 'fragment' WHEN t_scheme NOT IN ('http', 'https') THEN 'scheme'
  WHEN key IN (FROM kn) THEN 'page' WHEN lower(t_host) <> lower(b_host) THEN 'remote'
  WHEN regexp_matches(regexp_extract(b_path, '^(.*/)?') || path, '^/?\\.\\.(/|$)') THEN 'escapes' ELSE 'missing' END AS status FROM ta""",
    ),
    "site_audit": _with(_SITE, " UNION ALL ".join(_SITE_RULES)),
}
for _name, _m in FORECASTS.items():
    ORACLES[_name] = _with(TRACKS, f"SELECT {KEYS}, {_exact(_model(_m, 'x'))} AS x, {_exact(_model(_m, 'y'))} AS y FROM rq")


def _count(text: str, pattern: str, broken: str = "") -> str:
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, {1 if pattern == CSS_URL else 0})"
    return f"CAST(len({f'list_filter({found}, lambda x: {broken})' if broken else found}) AS BIGINT)"


_DRAWN = f"array_to_string(regexp_extract_all(html, {_quoted(SVG)}), chr(10))"
_ORDERED = """ro AS (SELECT user_id, event_id, row_number() OVER () - 1 AS request_order FROM events),
ko AS (SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS request_order FROM events)"""
_ENDS = "['index.html', 'model.PT', 'a.tar.gz', '.env.local', 'secrets.json', 'notes']"
_SUFFIXES = ", ".join(_quoted(s) for s in BLOCKED_SUFFIXES)
ORACLES |= {
    "asset_scan": f"WITH {_TAGS} SELECT page_id, "
    + ", ".join(
        [f"{_count('html', p)} AS {k}" for k, p in ASSETS.items()]
        + [f"{_count('drawn', p)} AS {k}" for k, p in DRAWN.items()]
        + [f"{_count('html', CSS_URL, f'regexp_matches(x, {_quoted(REMOTE)})')} AS css_remote"]
        + [f"{_count('html', CANONICAL, f'NOT regexp_matches(x, {_quoted(SECURE)})')} AS bad_canonical"]
        + [f"(SELECT count(*) FROM fe WHERE fe.page_id = p.page_id AND regexp_matches(value, {_quoted(REMOTE)})) AS remote_asset"]
    )
    + f" FROM (SELECT page_id, html, {_DRAWN} AS drawn FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)) p",
    "request_order": _with(_ORDERED, "SELECT * FROM ro"),
    "order_mismatch": _with(
        _ORDERED,
        """SELECT request_order, r.event_id AS wanted_event, k.event_id AS given_event FROM ro r LEFT JOIN (FROM ko WHERE user_id % 9 <> 0) k USING (request_order)
  WHERE r.event_id IS DISTINCT FROM k.event_id OR r.user_id IS DISTINCT FROM k.user_id""",
    ),
    "pairing_check": _with(
        _errors()
        + f""",
ke AS (SELECT model, {KEYS} FROM sq WHERE NOT (model = 'ball_arrival' AND nfl_id = 3) AND NOT (model = 'last_position' AND game_id <> 102)),
md AS (SELECT DISTINCT model FROM ke),
al AS (SELECT a.model AS model_a, b.model AS model_b, k.*, EXISTS (FROM ke x WHERE x.model = a.model AND ({", ".join("x." + k for k in KEYS.split(", "))}) = ({", ".join("k." + k for k in KEYS.split(", "))})) AS in_a,
       EXISTS (FROM ke x WHERE x.model = b.model AND ({", ".join("x." + k for k in KEYS.split(", "))}) = ({", ".join("k." + k for k in KEYS.split(", "))})) AS in_b
       FROM md a JOIN md b ON a.model < b.model CROSS JOIN (SELECT DISTINCT {KEYS} FROM ke) k),
pa AS (SELECT model_a, model_b, count(DISTINCT game_id) FILTER (WHERE in_a AND in_b) AS games, count(*) FILTER (WHERE in_a <> in_b) AS unmatched FROM al GROUP BY ALL)""",
        "SELECT *, unmatched = 0 AND games >= 2 AS pairable FROM pa",
    ),
    "slices_all": _with(
        _errors(("constant_velocity", "last_position"))
        + ",\n"
        + _PARTITIONS
        + """,
sl AS (SELECT *, 'frames_' || ((frame_id - 1) // 4 * 4 + 1) || '_' || ((frame_id - 1) // 4 * 4 + 4) AS horizon FROM sq JOIN part USING (game_id))""",
        """SELECT model, partition, CASE WHEN grouping(horizon) = 0 THEN 'horizon' WHEN grouping(game_id) = 0 THEN 'game' ELSE 'total' END AS slice,
  coalesce(horizon, CAST(game_id AS VARCHAR), 'all') AS value, count(*) AS n, round(sqrt(sum(e) / (2.0 * count(*))), 6) AS rmse
  FROM sl GROUP BY GROUPING SETS ((model, partition), (model, partition, horizon), (model, partition, game_id))""",
    ),
    "keyed_read": _with(TRACKS, "SELECT game_id, count(*) AS n, max(frame_id) AS last FROM lab GROUP BY game_id"),
    "keyed_violations": "SELECT 'null key' AS rule, count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL) AS violations FROM lineitem "
    "UNION ALL SELECT 'quantity over 45', count(*) FILTER (l_quantity > 45) FROM lineitem "
    "UNION ALL SELECT 'duplicate key', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) "
    "UNION ALL SELECT 'rows', count(*) FROM lineitem",
    "typed_props": _with(
        "op AS (SELECT " + ODD_PROPS.format(k="regexp_extract(props, '([0-9]+)', 1)") + " AS p FROM events),\n"
        "ty AS (SELECT p, json_type(p, '$.k') AS t, TRY_CAST(json_extract_string(p, '$.k') AS DOUBLE) AS v FROM op),\n"
        "fi AS (SELECT 'small' AS rule, CASE WHEN t IS NULL THEN 'missing' WHEN t NOT IN ('UBIGINT', 'BIGINT') THEN 'type' WHEN NOT v BETWEEN 0 AND 79 THEN 'value' END AS problem FROM ty\n"
        "UNION ALL SELECT 'number', CASE WHEN t IS NULL THEN 'missing' WHEN t NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'type' END FROM ty)",
        "SELECT rule, problem, count(*) AS n FROM fi WHERE problem IS NOT NULL GROUP BY ALL",
    ),
    "content_digest": """WITH h AS (
  SELECT role, sha256(strlen(CAST(conv_id AS VARCHAR)) || ':' || conv_id || coalesce(strlen(text) || ':' || text, '-') || strlen(CAST(turn AS VARCHAR)) || ':' || turn) AS h
  FROM conversations)
SELECT role, count(*) AS n, """
    + ", ".join(f"CAST(sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT) AS VARCHAR) AS s{k + 1}" for k in range(4))
    + " FROM h GROUP BY role",
    "play_selection": _with(TRACKS, f"SELECT {KEYS}, round(x, 6) AS x, round(y, 6) AS y FROM obs WHERE game_id = 103 AND play_id = 1"),
    "historical_row": f"SELECT * FROM ({ORACLES['rmse_by_game']}) WHERE model = 'last_position' AND game_id = 103",
    "blocked_files": f"""SELECT page_id, path FROM (SELECT page_id, {_ENDS}[page_id % 6 + 1] AS name, 'site/' || page_id || '/' || {_ENDS}[page_id % 6 + 1] AS path FROM pages)
WHERE lower(regexp_extract(name, '[^.](\\.[^.]+)$', 1)) IN ({_SUFFIXES}) OR name = 'secrets.json' OR name LIKE '.env%'""",
    "exact_sums": _with(
        TRACKS,
        "SELECT fr.event_type AS player_role, count(*) AS n, round(fsum(o.x), 6) AS x FROM obs o JOIN fr USING (game_id, play_id, nfl_id) WHERE fr.f = 8 GROUP BY ALL",
    ),
}


def _fitted() -> str:
    """CTEs from the basis to `wt`, role and total weights w1..wN: scaled normal equations, eliminated and substituted back."""
    terms = range(1, N + 1)
    train = ", ".join(str(g) for g, p in PARTITION.items() if p == "train")
    sums = [f"sum(fx{i} * fx{j} + fy{i} * fy{j}) AS g{i}{j}" for i, j in UPPER]
    sums += [f"sum(fx{i} * (tx - x) + fy{i} * (ty - y)) AS r{i}" for i in terms]
    scales = [f"sqrt(greatest(g{i}{i} / n, 1e-12)) AS s{i}" for i in terms]
    scaled = [f"g{i}{j} / (s{i} * s{j} * n) + {0.001 if i == j else 0.0}::DOUBLE AS a{i}{j}" for i, j in UPPER]
    scaled += [f"r{i} / (s{i} * n) AS b{i}" for i in terms]
    steps = []
    for k in terms[:-1]:
        later = [f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" for i, j in UPPER if i > k]
        later += [f"b{i} - a{k}{i} * b{k} / a{k}{k} AS b{i}" for i in terms if i > k]
        steps.append(f"e{k} AS (SELECT * REPLACE ({', '.join(later)}) FROM e{k - 1})")
    for k in reversed(terms):
        known = "".join(f" - a{k}{j} * z{j}" for j in range(k + 1, N + 1))
        steps.append(f"u{k} AS (SELECT *, (b{k}{known}) / a{k}{k} AS z{k} FROM {f'u{k + 1}' if k < N else f'e{N - 1}'})")
    return (
        f"""{_BASIS},
sm AS (SELECT player_role, grouping(player_role) = 1 AS is_total, 2 * count(*) AS n, {", ".join(sums)} FROM ba WHERE game_id IN ({train}) GROUP BY ROLLUP (player_role)),
sc AS (SELECT *, {", ".join(scales)} FROM sm),
e0 AS (SELECT *, {", ".join(scaled)} FROM sc),
"""
        + ",\n".join(steps)
        + f",\nwt AS (SELECT player_role, is_total, {', '.join(f'z{i} / s{i} AS w{i}' for i in terms)} FROM u1)"
    )


def _fitted_error(a: str) -> str:
    return f"{a} - t{a}" + "".join(f" + f{a}{k} * coalesce(r.w{k}, g.w{k})" for k in range(1, N + 1))


ORACLES["ridge_fitted"] = _with(
    _fitted()
    + f""",
re AS (SELECT ba.game_id, {_fitted_error("x")} AS dx, {_fitted_error("y")} AS dy
       FROM ba LEFT JOIN wt r ON r.player_role = ba.player_role AND NOT r.is_total JOIN wt g ON g.is_total)""",
    "SELECT 'role_ridge' AS model, game_id, count(*) AS n, round(sqrt(sum(dx * dx + dy * dy) / (2.0 * count(*))), 6) AS rmse FROM re GROUP BY game_id",
)


def _listed(table: str, columns: str, name: str) -> str:
    fields = ", ".join(f"{c.split()[-1]} := {c.split()[0]}" for c in columns.split(", "))
    return f"(SELECT game_id, play_id, list(struct_pack({fields}) ORDER BY nfl_id, frame_id) AS {name} FROM {table} GROUP BY ALL)"


_POINTS = f"{KEYS}, x, y"
ORACLES["selection_export"] = _with(
    TRACKS,
    f"""SELECT game_id, play_id, CAST(to_json(struct_pack(inputs := inputs, requests := requests, predictions := predictions, labels := labels)) AS VARCHAR) AS document
FROM {_listed("obs", _POINTS, "inputs")} JOIN {_listed("lab", KEYS, "requests")} USING (game_id, play_id)
JOIN {_listed("rq", f"'last_position' model, {_POINTS}", "predictions")} USING (game_id, play_id) JOIN {_listed("lab", _POINTS, "labels")} USING (game_id, play_id)""",
)
