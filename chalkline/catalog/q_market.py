"""Market operators (MK) on the derived quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.q_functions import (WEATHER_SQL, phi_sql, pois_cdf_sql, pois_pmf_sql, stacked_sql)
from chalkline.catalog.registry import query
from chalkline.catalog.views import dec, fair, hu, ip
from chalkline.functions import odds as O
from chalkline.functions.scoring import CATEGORY_FIELDS, FIELD_PARTS, GRADING_PARTS, LOW_LINE_PARTS, unpivot_stats
from chalkline.functions.values import half_up
from chalkline.plans import market as M, model as MD, tracker as TR

LOWER = "SELECT player_id, snapshot, player_name, category, team, lower(book) AS book, line, over_odds, under_odds, site_projection, available FROM"
PICKEM = "('prizepicks', 'underdog', 'sleeper')"
TARGETS = "('draftkings', 'caesars')"
ONE_WAY = "('touchdowns', 'first-touchdown-scorer', 'last-touchdown-scorer')"


@query("mk1_arbitrage", f"""WITH q AS ({LOWER} quotes),
    o AS (SELECT *, {ip('over_odds')} AS po, {ip('under_odds')} AS pu, count(*) OVER g AS n,
      row_number() OVER (PARTITION BY snapshot, player_name, category, line ORDER BY {ip('over_odds')}, book) AS ro,
      row_number() OVER (PARTITION BY snapshot, player_name, category, line ORDER BY {ip('under_odds')} NULLS LAST, book) AS ru, min(team) OVER g AS team1 FROM q
      WINDOW g AS (PARTITION BY snapshot, player_name, category, line)),
    c AS (SELECT a.snapshot, a.player_name, a.category, a.team1 AS team, a.line, a.book AS over_book, a.over_odds, b.book AS under_book, b.under_odds, a.po + b.pu AS comb
      FROM o a JOIN o b ON a.snapshot = b.snapshot AND a.player_name = b.player_name AND a.category = b.category AND a.line = b.line
      WHERE a.ro = 1 AND b.ru = 1 AND a.n >= 2 AND a.book <> b.book AND b.pu IS NOT NULL AND a.po + b.pu < 1)
    SELECT snapshot, player_name, category, team, line, over_book, over_odds, under_book, under_odds, {hu('comb', 4)} AS combined_prob, {hu('(1.0E0 - comb) / comb * 100.0E0', 2)} AS profit_pct,
      {hu(f"100.0E0 * (1.0E0 / {dec('over_odds')}) / comb", 2)} AS stake_over, {hu(f"100.0E0 * (1.0E0 / {dec('under_odds')}) / comb", 2)} AS stake_under,
      {hu(f"100.0E0 * (1.0E0 / {dec('over_odds')}) / comb * {dec('over_odds')} - 100.0E0", 2)} AS guaranteed_profit FROM c WHERE (1.0E0 - comb) / comb * 100.0E0 >= 1""")
def _(t):
    return M.find_arbitrage(t.quotes)


def _stakes(o: str, u: str) -> str:
    return f"(100.0E0 / (1.0E0 + {dec(u)} / {dec(o)}))"


_SU = _stakes("low_over_odds", "high_under_odds")
_SO = f"(100.0E0 - {_SU})"
MIDDLES_SQL = f"""mq AS ({LOWER} quotes), mr AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY snapshot, player_name, category ORDER BY line, book) AS lo,
      row_number() OVER (PARTITION BY snapshot, player_name, category ORDER BY line DESC, book) AS hi FROM mq WHERE line IS NOT NULL WINDOW g AS (PARTITION BY snapshot, player_name, category)),
    mm AS (SELECT a.snapshot, a.player_name, a.category, a.team, a.book AS low_book, a.line AS low_line, a.over_odds AS low_over_odds, b.book AS high_book, b.line AS high_line,
      b.under_odds AS high_under_odds, a.n AS books_compared FROM mr a JOIN mr b ON a.snapshot = b.snapshot AND a.player_name = b.player_name AND a.category = b.category AND a.lo = 1 AND b.hi = 1
      WHERE a.n >= 2 AND a.book <> b.book AND b.line - a.line >= 1),
    middles AS (SELECT *, {hu('high_line - low_line', 2)} AS middle_width, {hu(_SO, 2)} AS stake_over, {hu(_SU, 2)} AS stake_under,
      {hu(f"{_SO} * ({dec('low_over_odds')} - 1.0E0) - {_SU}", 2)} AS loss_if_miss,
      {hu(f"{_SO} * ({dec('low_over_odds')} - 1.0E0) + {_SU} * ({dec('high_under_odds')} - 1.0E0)", 2)} AS profit_if_middle_hits FROM mm)"""


@query("mk2_middles", f"WITH {MIDDLES_SQL} SELECT * FROM middles")
def _(t):
    return M.find_middles(t.quotes)


_S3 = _stakes("over_odds", "under_odds")


@query("mk3_balanced_stakes", f"""SELECT player_id, book, {hu(f'100.0E0 - {_S3}', 4)} AS stake_over, {hu(_S3, 4)} AS stake_under,
    {hu(f"(100.0E0 - {_S3}) * ({dec('over_odds')} - 1.0E0) - {_S3}", 4)} AS loss_if_miss,
    {hu(f"(100.0E0 - {_S3}) * ({dec('over_odds')} - 1.0E0) + {_S3} * ({dec('under_odds')} - 1.0E0)", 4)} AS profit_if_middle_hits FROM quotes""")
def _(t):
    q = t.unstaged("quotes").select("player_id", "book", M.balanced_stakes("over_odds", "under_odds").alias("s"))
    return q.select("player_id", "book", *[half_up(f"s.{c}", 4).alias(c) for c in ("stake_over", "stake_under", "loss_if_miss", "profit_if_middle_hits")])


_FIELD = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_FIELDS.items()) + " END"
_KEY = r"trim(regexp_replace(lower(regexp_replace(player_name, '[^A-Za-z0-9 ]', '', 'g')), '\s+(jr|sr|ii|iii|iv|v)$', ''))"


@query("mk4_middle_ev", f"""WITH {MIDDLES_SQL}, mean AS (SELECT snapshot, player_name, category, avg(line) AS mu FROM quotes GROUP BY snapshot, player_name, category),
    st AS ({stacked_sql(FIELD_PARTS, 'name_key', 'stat_field')}), h AS (SELECT name_key, stat_field, count(value) AS g, stddev_samp(value) AS sd FROM st GROUP BY name_key, stat_field),
    r AS (SELECT m.*, mean.mu, {_FIELD.replace('CASE category', 'CASE m.category')} AS stat_field, {_KEY.replace('player_name', 'm.player_name')} AS k FROM middles m JOIN mean USING (snapshot, player_name, category)),
    j AS (SELECT r.*, coalesce(h.g, 0) AS g, CASE WHEN h.g >= 6 THEN h.sd END AS sd FROM r LEFT JOIN h ON h.name_key = r.k AND h.stat_field = r.stat_field),
    z AS (SELECT *, CASE WHEN g >= 6 AND sd > 0 THEN least(greatest((high_line - mu) / sd, -6.5E0), 6.5E0) END AS zh, CASE WHEN g >= 6 AND sd > 0 THEN least(greatest((low_line - mu) / sd, -6.5E0), 6.5E0) END AS zl FROM j),
    p AS (SELECT *, {phi_sql('zh')} - {phi_sql('zl')} AS p FROM z)
    SELECT snapshot, player_name, category, team, low_book, low_line, low_over_odds, high_book, high_line, high_under_odds, books_compared, middle_width, stake_over, stake_under, loss_if_miss, profit_if_middle_hits,
      {hu('mu', 2)} AS market_mean, {hu('sd', 2)} AS history_sd, g AS history_games, {hu('p', 4)} AS p_middle_hits, {hu('p * profit_if_middle_hits + (1.0E0 - p) * loss_if_miss', 2)} AS expected_value,
      CASE WHEN stat_field IS NULL THEN 'no stat field for this category' WHEN g < 6 THEN concat('insufficient history (', g, ' games, need 6+)') WHEN coalesce(sd, 0) <= 0 THEN 'zero or undefined variance'
        WHEN stat_field IN ('pass_td', 'pass_int') THEN 'caution: low-count stat' ELSE '' END AS note FROM p""")
def _(t):
    values = unpivot_stats(t.player_stats, FIELD_PARTS, ["name_key"], name="stat_field")
    from chalkline.operators.aggregates import history_sd

    return M.middle_ev(M.find_middles(t.quotes), t.quotes, history_sd(values, ["name_key", "stat_field"], "value"))


@query("mk5_outliers", f"""WITH q AS ({LOWER} quotes), g AS (SELECT *, count(*) OVER w AS n, sum(line) OVER w AS s FROM q WHERE line IS NOT NULL AND line <> 0 WINDOW w AS (PARTITION BY snapshot, player_name, category)),
    m AS (SELECT *, (s - line) / (n - 1) AS mean FROM g WHERE n >= 3)
    SELECT snapshot, player_name, category, team, book, line, {hu('mean', 2)} AS consensus_mean, n - 1 AS other_books_count, {hu('line - mean', 2)} AS diff, {hu('(line - mean) / mean * 100.0E0', 2)} AS diff_pct,
      CASE WHEN line > mean THEN 'Higher than consensus' ELSE 'Lower than consensus' END AS direction FROM m WHERE mean <> 0 AND abs((line - mean) / mean * 100.0E0) >= 10""")
def _(t):
    return M.find_outliers(t.quotes)


_D6 = hu("(site_projection - line) / line * 100.0E0", 2)


@query("mk6_value", f"""WITH q AS ({LOWER} quotes) SELECT snapshot, player_name, category, team, book, line, site_projection, {hu('site_projection - line', 2)} AS diff, {_D6} AS diff_pct,
    CASE WHEN site_projection > line THEN 'Over' ELSE 'Under' END AS direction FROM q WHERE site_projection IS NOT NULL AND line IS NOT NULL AND line <> 0 AND abs({_D6}) >= 8""")
def _(t):
    return M.find_value(t.quotes)


def _sd_sql(line: str, category: str = "category") -> str:
    return f"(CASE {category} " + " ".join(f"WHEN '{c}' THEN {a}E0 * pow({line}, {b}E0)" for c, (a, b) in O.NORMAL_SPREAD.items()) + " END)"


def _model_sql(category: str = "category") -> str:
    normal = ", ".join(f"'{c}'" for c in O.NORMAL_SPREAD)
    return f"(CASE WHEN {category} IN ({normal}) THEN 'normal' WHEN {category} IN ('receptions', 'passing-tds', 'interceptions') THEN 'poisson' ELSE 'same_line' END)"


def _no_push_over(model: str, mid: str, sd: str, line: str) -> str:
    """No-push P(over) at a trial parameter, for the bisection below."""
    z = lambda shift: f"least(greatest((({line}) {shift} - {mid}) / {sd}, -8.0E0), 8.0E0)"
    whole = f"({line}) = floor({line})"
    k = f"CAST(floor({line}) AS INT)"
    n_over = f"(CASE WHEN {whole} THEN 1.0E0 - {phi_sql(z('+ 0.5E0'))} ELSE 1.0E0 - {phi_sql(z(''))} END)"
    n_under = f"(CASE WHEN {whole} THEN {phi_sql(z('- 0.5E0'))} ELSE {phi_sql(z(''))} END)"
    p_le, p_push = pois_cdf_sql(k, mid), f"(CASE WHEN {whole} THEN {pois_pmf_sql(k, mid)} ELSE 0.0E0 END)"
    poisson = f"((1.0E0 - {p_le}) / (1.0E0 - {p_push}))"
    return f"(CASE WHEN {model} = 'poisson' THEN {poisson} ELSE {n_over} / ({n_over} + {n_under}) END)"


def two_way_sql(source: str, min_refs: int, max_shift: float, prefix: str = "") -> str:
    """CTE list ending in `{prefix}ev`: the two-way finder written with self joins and a bisection."""
    x = prefix
    return f"""{x}q AS (SELECT * FROM {source} WHERE line IS NOT NULL AND over_odds IS NOT NULL AND under_odds IS NOT NULL AND book NOT IN {PICKEM} AND category NOT IN {ONE_WAY}),
    {x}t AS (SELECT *, {_model_sql()} AS model0 FROM {x}q WHERE book IN {TARGETS}),
    {x}a AS (SELECT t.snapshot, t.player_name, t.category, t.book, t.line, median(r.line) AS med FROM {x}t t JOIN {x}q r ON r.snapshot = t.snapshot AND r.player_name = t.player_name AND r.category = t.category AND r.book <> t.book GROUP BY ALL),
    {x}m AS (SELECT t.*, a.med AS all_med, CASE WHEN t.model0 = 'normal' AND a.med < 5 THEN 'same_line' ELSE t.model0 END AS model FROM {x}t t JOIN {x}a a USING (snapshot, player_name, category, book, line)),
    {x}r AS (SELECT m.snapshot, m.player_name, m.category, m.book, m.line, m.model, r.book AS rbook, r.line AS rline, r.over_odds AS ro, r.under_odds AS ru,
      CASE WHEN m.model = 'normal' THEN {_sd_sql('m.all_med', 'm.category')} END AS sd, {ip('r.over_odds')} / ({ip('r.over_odds')} + {ip('r.under_odds')}) AS p
      FROM {x}m m JOIN {x}q r ON r.snapshot = m.snapshot AND r.player_name = m.player_name AND r.category = m.category AND r.book <> m.book AND (m.model <> 'same_line' OR r.line = m.line)),
    {x}d AS (SELECT DISTINCT model, sd, rline, p FROM {x}r WHERE model <> 'same_line'),
    {x}b AS (SELECT model, sd, rline, p, 0 AS i, CASE WHEN model = 'poisson' THEN 1E-6 ELSE rline - 8.0E0 * sd END AS lo, CASE WHEN model = 'poisson' THEN greatest(3.0E0 * rline, 5.0E0) + 10.0E0 ELSE rline + 8.0E0 * sd END AS hi FROM {x}d
      UNION ALL SELECT model, sd, rline, p, i + 1, CASE WHEN over_p < p THEN mid ELSE lo END, CASE WHEN over_p < p THEN hi ELSE mid END
        FROM (SELECT *, {_no_push_over('model', 'mid', 'sd', 'rline')} AS over_p FROM (SELECT *, (lo + hi) / 2.0E0 AS mid FROM {x}b WHERE i < 48) y0) y),
    {x}f AS (SELECT model, sd, rline, p, (lo + hi) / 2.0E0 AS param FROM {x}b WHERE i = 48),
    {x}c AS (SELECT r.snapshot, r.player_name, r.category, r.book, r.line, median(CASE WHEN r.model = 'same_line' THEN r.p ELSE f.param END) AS param, count(*) AS refs, median(r.rline) AS ref_line, min(r.rline) AS ref_lo, max(r.rline) AS ref_hi,
      array_to_string(list_sort(list_distinct(list(regexp_replace(CAST(r.rline AS STRING), '\\.0$', '')))), ',') AS ref_lines, count(*) FILTER (r.rline = r.line) AS same_refs
      FROM {x}r r LEFT JOIN {x}f f ON f.model = r.model AND f.sd IS NOT DISTINCT FROM r.sd AND f.rline = r.rline AND f.p = r.p GROUP BY r.snapshot, r.player_name, r.category, r.book, r.line),
    {x}bo AS (SELECT snapshot, player_name, category, book, line, rbook, ro, row_number() OVER (PARTITION BY snapshot, player_name, category, book, line ORDER BY {ip('ro')}, rbook) AS rn FROM {x}r WHERE rline = line),
    {x}bu AS (SELECT snapshot, player_name, category, book, line, rbook, ru, row_number() OVER (PARTITION BY snapshot, player_name, category, book, line ORDER BY {ip('ru')}, rbook) AS rn FROM {x}r WHERE rline = line),
    {x}g AS (SELECT m.*, c.param, c.refs, c.ref_line, c.ref_lo, c.ref_hi, c.ref_lines, c.same_refs, CASE WHEN m.model = 'normal' THEN {_sd_sql('c.ref_line', 'm.category')} END AS sd2, bo.rbook AS bo_book, bo.ro, bu.rbook AS bu_book, bu.ru,
      CASE WHEN m.line = floor(m.line) THEN 0.5E0 ELSE 0.0E0 END AS half, m.line = floor(m.line) AS whole, CAST(floor(m.line) AS INT) AS k
      FROM {x}m m JOIN {x}c c USING (snapshot, player_name, category, book, line) LEFT JOIN {x}bo bo ON bo.snapshot = m.snapshot AND bo.player_name = m.player_name AND bo.category = m.category AND bo.book = m.book AND bo.line = m.line AND bo.rn = 1
      LEFT JOIN {x}bu bu ON bu.snapshot = m.snapshot AND bu.player_name = m.player_name AND bu.category = m.category AND bu.book = m.book AND bu.line = m.line AND bu.rn = 1 WHERE c.refs >= {min_refs}),
    {x}h AS (SELECT * FROM {x}g WHERE model = 'same_line' OR (model = 'normal' AND abs(line - ref_line) <= {max_shift}E0 * sd2) OR (model = 'poisson' AND abs(line - ref_line) <= 1.5E0)),
    {x}o AS (SELECT *, CASE WHEN model = 'same_line' THEN param WHEN model = 'normal' THEN 1.0E0 - {phi_sql('((line + half - param) / sd2)')} ELSE 1.0E0 - {pois_cdf_sql('k', 'param')} END AS p_over,
      CASE WHEN model = 'same_line' THEN 1.0E0 - param WHEN model = 'normal' THEN {phi_sql('((line - half - param) / sd2)')} WHEN whole THEN {pois_cdf_sql('k - 1', 'param')} ELSE {pois_cdf_sql('k', 'param')} END AS p_under FROM {x}h),
    {x}w AS (SELECT *, CASE WHEN model = 'same_line' OR NOT whole THEN 0.0E0 ELSE 1.0E0 - p_over - p_under END AS p_push FROM {x}o),
    {x}s AS (SELECT *, 'Over' AS side, over_odds AS odds, p_over AS pw, p_under AS pl, bo_book AS bb, ro AS bodds FROM {x}w UNION ALL SELECT *, 'Under', under_odds, p_under, p_over, bu_book, ru FROM {x}w),
    {x}ev AS (SELECT book, snapshot, player_name, category, team, side, line, odds, {hu('pw / (1.0E0 - p_push)', 4)} AS fair_prob, {hu(ip('odds'), 4)} AS implied_prob, {hu(f"(pw * ({dec('odds')} - 1.0E0) - pl) * 100.0E0", 2)} AS ev_pct,
      {hu(f"greatest(0.0E0, (pw * ({dec('odds')} - 1.0E0) - (1.0E0 - pw - p_push)) / ({dec('odds')} - 1.0E0)) * 0.25E0 * 100.0E0", 2)} AS quarter_kelly_pct, {fair('pw / (1.0E0 - p_push)')} AS fair_odds,
      refs AS ref_books, ref_lines, ref_lo, ref_hi, ref_line, same_refs AS same_line_refs, CASE WHEN bb IS NULL THEN '' ELSE concat(bb, ' ', CASE WHEN bodds >= 0 THEN '+' ELSE '' END, CAST(CAST(bodds AS BIGINT) AS STRING)) END AS best_other_same_line,
      model <> 'same_line' AND (ref_lo <> line OR ref_hi <> line) AS line_adjusted, 'two-way' AS market, model FROM {x}s)"""


_EV = f"lq AS ({LOWER} quotes), {two_way_sql('lq', 3, 0.5)}"


@query("mk7_ev_two_way", f"WITH {_EV} SELECT * FROM ev")
def _(t):
    return M.find_ev_two_way(t.quotes)


_HOLD = "(CASE category WHEN 'touchdowns' THEN 0.06E0 ELSE 0.20E0 END)"


@query("mk8_ev_one_way", f"""WITH q AS (SELECT * FROM ({LOWER} quotes) z WHERE category IN {ONE_WAY} AND over_odds IS NOT NULL AND book NOT IN {PICKEM}),
    r AS (SELECT t.snapshot, t.player_name, t.category, t.team, t.book, t.line, t.over_odds AS odds, r.book AS rb, r.over_odds AS ro, {ip('r.over_odds')} AS p FROM q t JOIN q r ON r.snapshot = t.snapshot AND r.player_name = t.player_name AND r.category = t.category AND r.book <> t.book WHERE t.book IN {TARGETS}),
    g AS (SELECT snapshot, player_name, category, team, book, line, odds, median(p) / (1.0E0 + {_HOLD}) AS f, count(*) AS refs, arg_min(concat(rb, ' ', CASE WHEN ro >= 0 THEN '+' ELSE '' END, CAST(CAST(ro AS BIGINT) AS STRING)), struct_pack(p := p, b := rb)) AS best
      FROM r GROUP BY snapshot, player_name, category, team, book, line, odds HAVING count(*) >= 3)
    SELECT book, snapshot, player_name, category, team, 'Yes' AS side, line, odds, {hu('f', 4)} AS fair_prob, {hu(ip('odds'), 4)} AS implied_prob, {hu(f"(f * ({dec('odds')} - 1.0E0) - (1.0E0 - f)) * 100.0E0", 2)} AS ev_pct,
      {hu(f"greatest(0.0E0, (f * ({dec('odds')} - 1.0E0) - (1.0E0 - f)) / ({dec('odds')} - 1.0E0)) * 0.25E0 * 100.0E0", 2)} AS quarter_kelly_pct, {fair('f')} AS fair_odds, refs AS ref_books, '' AS ref_lines,
      CAST(NULL AS DOUBLE) AS ref_lo, CAST(NULL AS DOUBLE) AS ref_hi, CAST(NULL AS DOUBLE) AS ref_line, refs AS same_line_refs, best AS best_other_same_line, false AS line_adjusted, 'one-way' AS market,
      CASE category WHEN 'touchdowns' THEN 'hold=6%' ELSE 'hold=20%' END AS model FROM g""")
def _(t):
    return M.find_ev_one_way(t.quotes)


@query("mk9_overround", f"""WITH g AS (SELECT player_name, team, opponent FROM (SELECT DISTINCT player_name, team, CASE WHEN team < 'hou' THEN 'zzz' ELSE 'aaa' END AS opponent FROM quotes) x),
    s AS (SELECT q.category, lower(q.book) AS book, concat(least(g.team, g.opponent), '-', greatest(g.team, g.opponent)) AS game, sum({ip('q.over_odds')}) AS s, count(*) AS n FROM quotes q JOIN g USING (player_name)
      WHERE q.category = 'first-touchdown-scorer' AND lower(q.book) NOT IN {PICKEM} GROUP BY 1, 2, 3, q.snapshot HAVING count(*) >= 2)
    SELECT category, book, {hu('median(s)', 3)} AS overround, count(*) AS games FROM s GROUP BY category, book""")
def _(t):
    games = t.quotes.select("player_name", "team", F.when(F.col("team") < "hou", F.lit("zzz")).otherwise(F.lit("aaa")).alias("opponent")).distinct()
    return M.overround(t.quotes, games, min_players=2)


_STAT_SD = f"(CASE WHEN {_model_sql()} = 'normal' AND ref_line >= 5 THEN {_sd_sql('ref_line')} WHEN {_model_sql()} = 'poisson' THEN sqrt(greatest(ref_line, 0.5E0)) END)"


@query("mk10_confidence", f"""WITH {_EV}, cc AS (SELECT book, snapshot, player_name, category, side, ev_pct, ref_lines, (ref_hi - ref_lo) / {_STAT_SD} AS spread FROM ev),
    nn AS (SELECT player_name, max(CASE WHEN available = false THEN 'questionable himself' END) AS news FROM quotes GROUP BY player_name)
    SELECT cc.book, cc.snapshot, cc.player_name, cc.category, cc.side, cc.ev_pct, concat_ws('; ', CASE WHEN spread >= 0.75E0 THEN concat('books disagree (', ref_lines, ', ', printf('%.1f', floor(spread * 10.0E0 + 0.5E0) / 10.0E0), ' sd)') END, nn.news) AS check_reason,
      CASE WHEN coalesce(spread >= 0.75E0, false) OR nn.news IS NOT NULL THEN 'check' ELSE 'clean' END AS confidence FROM cc JOIN nn USING (player_name) WHERE ev_pct >= 2 AND ev_pct <= 25""")
def _(t):
    news = t.quotes.groupBy("player_name", "team").agg(F.max(F.when(~F.col("available"), F.lit("questionable himself"))).alias("news"))
    c = M.confidence(M.find_ev_two_way(t.quotes), news, 2.0, 25.0)
    return c.select("snapshot", "book", "player_name", "category", "side", "ev_pct", "check_reason", "confidence")


INJURY_SQL = """inj AS (SELECT name_key, team, status FROM (SELECT name_key, team, lower(status) AS status, row_number() OVER (PARTITION BY name_key, team ORDER BY p DESC, src_pos DESC, lower(status) DESC) AS rn
      FROM (SELECT name_key, team, status, src_pos, 1 AS p FROM injuries_edge UNION ALL SELECT name_key, team, status, src_pos, 2 FROM injuries_depth) x) y WHERE rn = 1)"""


@query("mk11_injury_status", f"WITH {INJURY_SQL} SELECT * FROM inj")
def _(t):
    return M.injury_status(t.injuries_edge, t.injuries_depth)


KEY_SQL = f"""ku AS (SELECT *, carries * 100.0E0 / nullif(sum(carries) OVER (PARTITION BY team, year, week), 0) AS cs, row_number() OVER (PARTITION BY name_key ORDER BY year DESC, week DESC, team DESC) AS age FROM usage WHERE year >= 2000),
    kl AS (SELECT name_key, team AS last_team FROM ku WHERE age = 1),
    kp AS (SELECT name_key, arg_min(name, age) AS name, arg_min(team, age) AS team, arg_min(position, age) AS position, avg(target_share) AS target_share, avg(cs) AS carry_share,
      (list(offense_pct ORDER BY age))[1] AS last_snap FROM ku JOIN kl USING (name_key) WHERE age <= 6 AND team = last_team GROUP BY name_key),
    kk AS (SELECT name_key, name, team, position, target_share, carry_share, last_snap, coalesce(target_share >= 15, false) OR coalesce(carry_share >= 30, false) OR coalesce(position = 'QB' AND last_snap >= 80, false) AS is_key FROM kp)"""


def key_players(t):
    return M.key_players(t.usage.where(F.col("year") >= 2000))


@query("mk12_key_players", f"WITH {KEY_SQL} SELECT name_key, name, team, position, {hu('target_share', 4)} AS target_share, {hu('carry_share', 4)} AS carry_share, last_snap, is_key FROM kk")
def _(t):
    return key_players(t).withColumns({"target_share": half_up("target_share", 4), "carry_share": half_up("carry_share", 4)})


# Rosters are bounded: a team has one in every league of a thousand players.
LEAGUE = "CAST(floor(CAST(split_part(substr({0}, 2), ' ', 1) AS BIGINT) / 1000) AS BIGINT)"
NEWS_SQL = f"""{INJURY_SQL}, {KEY_SQL}, who AS (SELECT DISTINCT name AS player_name, team, name_key, {LEAGUE.format('name_key')} AS league FROM slate),
    mates AS (SELECT k.team, {LEAGUE.format('k.name_key')} AS league, k.name_key AS k, k.name AS n, i.status FROM kk k JOIN inj i ON i.name_key = k.name_key AND i.team = k.team WHERE k.is_key AND i.status IN ('out', 'doubtful', 'ir', 'inactive', 'suspended', 'pup')),
    tm AS (SELECT w.player_name, w.team, string_agg(concat('teammate ', m.n, ' ', m.status), '; ' ORDER BY m.n, m.k, m.status) AS txt FROM who w JOIN mates m ON m.team = w.team AND m.league = w.league AND m.k <> w.name_key GROUP BY w.player_name, w.team),
    news AS (SELECT w.player_name, w.team, nullif(concat_ws('; ', CASE WHEN i.status IN ('out', 'doubtful', 'questionable', 'ir', 'inactive', 'suspended', 'pup') THEN concat(i.status, ' himself') END, tm.txt), '') AS news
      FROM who w LEFT JOIN inj i ON i.name_key = w.name_key AND i.team = w.team LEFT JOIN tm ON tm.player_name = w.player_name AND tm.team = w.team)"""


def news(t):
    league = F.expr(LEAGUE.format("name_key")).alias("league")
    who = t.slate.select(F.col("name").alias("player_name"), "team", league)
    injuries = M.injury_status(t.injuries_edge, t.injuries_depth)
    return M.news_for(who, injuries.select("*", league), key_players(t).select("*", league), ["league"]).drop("league")


@query("mk13_news", f"WITH {NEWS_SQL} SELECT * FROM news")
def _(t):
    return news(t)


_LOW_CATS = ", ".join(f"'{c}'" for c in LOW_LINE_PARTS)


@query("mk14_low_lines", f"""WITH m AS (SELECT *, {_KEY} AS k FROM ({LOWER} quotes) z WHERE category IN ({_LOW_CATS}) AND over_odds IS NOT NULL AND line IS NOT NULL AND book NOT IN {PICKEM} AND (available IS NULL OR available)),
    t AS (SELECT * FROM m WHERE book IN {TARGETS} AND line <= 8),
    ref AS (SELECT t.snapshot, t.k, t.category, t.line, t.book, median({ip('r.over_odds')} / ({ip('r.over_odds')} + {ip('r.under_odds')})) AS p, count(*) AS n FROM t JOIN m r ON r.snapshot = t.snapshot AND r.k = t.k AND r.category = t.category AND r.line = t.line AND r.book <> t.book
      WHERE r.under_odds IS NOT NULL GROUP BY t.snapshot, t.k, t.category, t.line, t.book),
    lg AS (SELECT * FROM player_stats WHERE year >= 1998), pl AS (SELECT DISTINCT name_key, split_part(name_key, ' ', 2) AS ln, team FROM lg),
    fb AS (SELECT ln, team, min(name_key) AS alt FROM pl GROUP BY ln, team HAVING min(name_key) = max(name_key)),
    x AS (SELECT t.*, coalesce(ref.p, {ip('t.over_odds')} / ({ip('t.over_odds')} + {ip('t.under_odds')})) AS mo, CASE WHEN ref.n IS NOT NULL THEN concat(ref.n, ' other book(s)') WHEN t.under_odds IS NOT NULL THEN 'own book' ELSE 'none' END AS market_source,
      CASE WHEN EXISTS (SELECT 1 FROM pl WHERE pl.name_key = t.k) THEN t.k ELSE fb.alt END AS nk FROM t LEFT JOIN ref USING (snapshot, k, category, line, book) LEFT JOIN fb ON fb.ln = split_part(t.k, ' ', 2) AND fb.team = t.team),
    n16 AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY year DESC, week DESC, team DESC) AS age FROM lg),
    base AS (SELECT name_key AS nk, count(*) AS n, {hu('avg(rec_tgt)', 1)} AS avg_targets, {hu('avg(rush_att)', 1)} AS avg_carries, arg_min(team, age) AS team_now, (list(snap_pct ORDER BY age))[1] AS last_snap_pct,
      coalesce(arg_min(team, age) FILTER (year = 1999) <> arg_min(team, age) FILTER (year = 2000), false) AS team_changed FROM n16 WHERE age <= 16 GROUP BY name_key),
    st AS ({stacked_sql(LOW_LINE_PARTS, 'name_key, year, week')}),
    v AS (SELECT s.name_key AS nk, s.category, s.value, n.age FROM st s JOIN n16 n ON n.name_key = s.name_key AND n.year = s.year AND n.week = s.week WHERE n.age <= 16),
    hit AS (SELECT a.nk, a.category, a.line, sum(CASE WHEN v.value > a.line THEN 1.0E0 ELSE 0.0E0 END) AS h, sum(CASE WHEN v.value > a.line AND v.age <= 3 THEN 1.0E0 ELSE 0.0E0 END) AS h3, sum(pow(0.5E0, (v.age - 1) / 4.0E0)) AS w,
      sum(CASE WHEN v.value > a.line THEN pow(0.5E0, (v.age - 1) / 4.0E0) ELSE 0.0E0 END) AS wh FROM (SELECT DISTINCT nk, category, line FROM x WHERE nk IS NOT NULL) a JOIN v ON v.nk = a.nk AND v.category = a.category GROUP BY a.nk, a.category, a.line),
    ctx AS (SELECT team, {hu('avg(pa)', 1)} AS pa, {hu('avg(c)', 1)} AS pc FROM (SELECT team, year, week, sum(pass_att) AS pa, sum(CASE WHEN rec > 0 THEN 1 ELSE 0 END) AS c FROM lg GROUP BY team, year, week) y GROUP BY team),
    r AS (SELECT x.*, base.n, avg_targets, avg_carries, last_snap_pct, team_changed, h, h3, w, wh, CASE WHEN base.n IS NOT NULL THEN team_now ELSE x.team END AS tm FROM x LEFT JOIN base USING (nk) LEFT JOIN hit ON hit.nk = x.nk AND hit.category = x.category AND hit.line = x.line),
    s AS (SELECT *, 'Over' AS side, over_odds AS odds, mo AS mp, wh AS swh, h AS sh, h3 AS sh3 FROM r UNION ALL SELECT *, 'Under', under_odds, 1.0E0 - mo, w - wh, n - h, least(n, 3) - h3 FROM r WHERE under_odds IS NOT NULL),
    f AS (SELECT s.*, CASE WHEN swh IS NOT NULL AND mp IS NOT NULL THEN (swh + 6 * mp) / (w + 6) WHEN swh IS NOT NULL THEN swh / w ELSE mp END AS model FROM s)
    SELECT snapshot, book, player_name, tm AS team, category, line, side, odds, {hu(ip('odds'), 3)} AS implied_prob, {hu('model', 3)} AS model_prob, {hu(f"(model * {dec('odds')} - 1.0E0) * 100.0E0", 1)} AS ev_pct,
      CASE WHEN sh IS NULL THEN '' ELSE concat(CAST(sh AS INT), '/', n) END AS hist_rate, {hu('swh / w', 3)} AS weighted_rate, CASE WHEN sh3 IS NULL THEN '' ELSE concat(CAST(sh3 AS INT), '/', least(n, 3)) END AS last3_rate, {hu('mp', 3)} AS market_prob,
      market_source, avg_targets, avg_carries, last_snap_pct, team_changed, ctx.pa AS team_pass_att_pg, ctx.pc AS players_with_catch_pg FROM f LEFT JOIN ctx ON ctx.team = f.tm""")
def _(t):
    return M.low_lines(t.quotes, t.player_stats, max_line=8.0, since=1998, seasons=(1999, 2000))


def moves_sql() -> str:
    mid = "median(line_b)"
    sd = f"(CASE WHEN {_model_sql()} = 'normal' AND mid >= 5 THEN {_sd_sql('mid')} WHEN {_model_sql()} = 'poisson' THEN sqrt(greatest(mid, 0.5E0)) END)"
    return f"""lb AS ({LOWER} quotes), lc AS ({LOWER} quotes_now), live AS (SELECT * FROM lc WHERE available IS NULL OR available),
    mv0 AS (SELECT b.snapshot, b.player_name, b.category, b.book, b.line AS line_b, b.over_odds AS over_b, b.under_odds AS under_b, c.line AS line_c, c.over_odds AS over_c, c.under_odds AS under_c FROM lb b JOIN live c ON c.snapshot = b.snapshot AND c.player_name = b.player_name AND c.category = b.category AND c.book = b.book
      WHERE (b.available IS NULL OR b.available) AND b.book NOT IN {PICKEM} AND ((b.category = 'touchdowns') OR (b.category NOT IN {ONE_WAY} AND b.under_odds IS NOT NULL AND c.under_odds IS NOT NULL))),
    mv1 AS (SELECT m.*, x.mid FROM mv0 m JOIN (SELECT snapshot, player_name, category, {mid} AS mid FROM mv0 GROUP BY snapshot, player_name, category) x USING (snapshot, player_name, category)),
    mv2 AS (SELECT *, {sd} AS sd, CASE WHEN {_model_sql()} = 'poisson' THEN 'poisson' ELSE 'normal' END AS model FROM mv1),
    mp AS (SELECT DISTINCT model, sd, line, p FROM (SELECT model, sd, line_b AS line, {ip('over_b')} / ({ip('over_b')} + {ip('under_b')}) AS p FROM mv2 WHERE sd IS NOT NULL AND category <> 'touchdowns'
      UNION ALL SELECT model, sd, line_c, {ip('over_c')} / ({ip('over_c')} + {ip('under_c')}) FROM mv2 WHERE sd IS NOT NULL AND category <> 'touchdowns') z),
    mb AS (SELECT model, sd, line, p, 0 AS i, CASE WHEN model = 'poisson' THEN 1E-6 ELSE line - 8.0E0 * sd END AS lo, CASE WHEN model = 'poisson' THEN greatest(3.0E0 * line, 5.0E0) + 10.0E0 ELSE line + 8.0E0 * sd END AS hi FROM mp
      UNION ALL SELECT model, sd, line, p, i + 1, CASE WHEN over_p < p THEN mid ELSE lo END, CASE WHEN over_p < p THEN hi ELSE mid END FROM (SELECT *, {_no_push_over('model', 'mid', 'sd', 'line')} AS over_p FROM (SELECT *, (lo + hi) / 2.0E0 AS mid FROM mb WHERE i < 48) y0) y),
    mf AS (SELECT model, sd, line, p, (lo + hi) / 2.0E0 AS param FROM mb WHERE i = 48),
    mv AS (SELECT v.snapshot, v.player_name, v.category, v.book, line_b, line_c, over_b, over_c, under_c, CASE WHEN category = 'touchdowns' THEN 100.0E0 * ({ip('over_c')} - {ip('over_b')}) ELSE (c.param - b.param) / v.sd END AS move, CASE WHEN category = 'touchdowns' THEN 'pp' ELSE 'sd' END AS unit
      FROM mv2 v LEFT JOIN mf b ON b.model = v.model AND b.sd = v.sd AND b.line = v.line_b AND b.p = {ip('over_b')} / ({ip('over_b')} + {ip('under_b')})
      LEFT JOIN mf c ON c.model = v.model AND c.sd = v.sd AND c.line = v.line_c AND c.p = {ip('over_c')} / ({ip('over_c')} + {ip('under_c')})),
    moves AS (SELECT * FROM mv WHERE move IS NOT NULL),
    cons AS (SELECT o.*, x.team FROM (SELECT snapshot, player_name, category, unit, median(move) AS consensus, count(*) AS others, median({ip('over_c')}) AS oi FROM moves WHERE book NOT IN {TARGETS} GROUP BY snapshot, player_name, category, unit) o
      JOIN (SELECT snapshot, player_name, category, min(team) AS team FROM quotes_now GROUP BY snapshot, player_name, category) x USING (snapshot, player_name, category) WHERE others >= 2 AND abs(consensus) >= CASE WHEN unit = 'pp' THEN 4.0E0 ELSE 0.5E0 END)"""


@query("mk15_line_moves", f"WITH {moves_sql()} SELECT snapshot, player_name, category, book, line_b, line_c, {hu('move', 4)} AS move, unit FROM moves")
def _(t):
    return M.line_moves(t.quotes, t.quotes_now).select("snapshot", "player_name", "category", "book", "line_b", "line_c", half_up("move", 4).alias("move"), "unit")


@query("mk15_stale_lines", f"""WITH {moves_sql()}, {two_way_sql('live', 2, 10.0)},
    lag AS (SELECT m.*, c.consensus, c.oi, c.team, CASE WHEN m.category = 'touchdowns' OR c.consensus > 0 THEN 'Over' ELSE 'Under' END AS side, CASE WHEN m.category = 'touchdowns' THEN 0.5E0 ELSE m.line_c END AS line
      FROM moves m JOIN cons c USING (snapshot, player_name, category) WHERE m.book IN {TARGETS} AND m.move * CASE WHEN c.consensus > 0 THEN 1 ELSE -1 END < 0.34E0 * abs(c.consensus)),
    lg AS (SELECT l.*, e.ev_pct AS ev FROM lag l LEFT JOIN ev e ON e.book = l.book AND e.snapshot = l.snapshot AND e.player_name = l.player_name AND e.category = l.category AND e.side = l.side AND e.line = l.line),
    sh AS (SELECT snapshot, player_name, category, count(*) FILTER (book NOT IN {TARGETS}) AS n, count(*) FILTER (book NOT IN {TARGETS} AND available = false) AS down, min(team) AS tm FROM lc WHERE book NOT IN {PICKEM} GROUP BY snapshot, player_name, category)
    SELECT CASE WHEN category = 'touchdowns' AND consensus <= 0 THEN 'lagging, avoid' ELSE 'lagging' END AS flag, book, snapshot, player_name, category, team, side, line, CASE WHEN side = 'Over' THEN over_c ELSE under_c END AS odds,
      CASE WHEN category <> 'touchdowns' THEN ev WHEN consensus > 0 THEN {hu(f"(oi * {dec('over_c')} - 1.0E0) * 100.0E0", 1)} END AS ev_pct, {hu('consensus', 2)} AS market_move, {hu('move', 2)} AS book_move, unit,
      CASE WHEN category = 'touchdowns' AND consensus > 0 THEN printf('other books %+.1f pts, this book %+.1f; EV vs other books'' vig-included price', {hu('consensus', 1)}, {hu('move', 1)})
        WHEN category = 'touchdowns' THEN printf('other books %.1f pts (role shrank?), this book %+.1f; still priced for the old role', {hu('consensus', 1)}, {hu('move', 1)})
        ELSE printf('other books moved %+.2f sd, this book %+.2f sd (line %g -> %g)', {hu('consensus', 2)}, {hu('move', 2)}, line_b, line_c) END AS note, CAST(NULL AS DOUBLE) AS pulled_share FROM lg
    UNION ALL SELECT 'pulled elsewhere', c.book, c.snapshot, c.player_name, c.category, s.tm, 'Over', c.line, c.over_odds, NULL, NULL, NULL, NULL,
      concat(CAST(CAST({hu('s.down * 100.0E0 / s.n')} AS INT) AS VARCHAR), '% of other books pulled this prop; check news'), {hu('s.down / s.n', 4)} FROM live c JOIN sh s USING (snapshot, player_name, category)
      WHERE c.book IN {TARGETS} AND s.n >= 3 AND s.down >= 0.67E0 * s.n AND EXISTS (SELECT 1 FROM lb WHERE lb.snapshot = c.snapshot AND lb.player_name = c.player_name AND lb.category = c.category AND (lb.available IS NULL OR lb.available) AND lb.book NOT IN {PICKEM})""")
def _(t):
    return M.stale_lines(t.quotes, t.quotes_now)


@query("mk16_news_clusters", f"""WITH {moves_sql()}, r AS (SELECT *, count(*) OVER (PARTITION BY team, snapshot) AS props, row_number() OVER (PARTITION BY team, snapshot ORDER BY abs(consensus) DESC, player_name, category) AS rn FROM cons)
    SELECT team, props, CAST(rn AS INT) AS mover_rank, snapshot, player_name, category, {hu('consensus', 2)} AS move, unit FROM r WHERE props >= 3 AND rn <= 4""")
def _(t):
    return M.news_clusters(M.consensus_moves(M.line_moves(t.quotes, t.quotes_now), t.quotes_now))


@query("mk16_pulled_players", f"""WITH lb AS ({LOWER} quotes), lc AS (SELECT *, player_id % 2 = 0 AND l_down AS down FROM (SELECT *, book NOT IN {TARGETS} AS l_down FROM ({LOWER} quotes_now) z) y WHERE book NOT IN {PICKEM}),
    sh AS (SELECT snapshot, player_name, category, count(*) FILTER (book NOT IN {TARGETS}) AS n, count(*) FILTER (book NOT IN {TARGETS} AND down) AS d, min(team) AS tm FROM lc GROUP BY snapshot, player_name, category),
    fl AS (SELECT c.book, c.snapshot, c.player_name, c.category, s.tm AS team FROM lc c JOIN sh s USING (snapshot, player_name, category) WHERE c.book IN {TARGETS} AND s.n >= 3 AND s.d >= 0.67E0 * s.n
      AND EXISTS (SELECT 1 FROM lb WHERE lb.snapshot = c.snapshot AND lb.player_name = c.player_name AND lb.category = c.category AND (available IS NULL OR available) AND lb.book NOT IN {PICKEM}))
    SELECT snapshot, player_name, team, string_agg(DISTINCT book, ', ' ORDER BY book) AS books, count(DISTINCT category) AS markets, team < 'hou' AS team_news FROM fl GROUP BY snapshot, player_name, team""")
def _(t):
    """Every other book takes half of the players down; targets stay live."""
    mine = F.lower("book").isin("draftkings", "caesars")
    cur = t.quotes_now.withColumn("available", F.when(mine, True).otherwise(F.col("player_id") % 2 != 0))
    flags = M.pulled_elsewhere(t.quotes, cur)
    return M.pulled_players(flags, t.quotes.where(F.col("team") < "hou").select("team"))


def feature_rows(t, halflife):
    pg = MD.player_games(t.usage, t.player_stats)
    return MD.current_features(pg, halflife)


@query("mk18_game_weather", f"""WITH {WEATHER_SQL} SELECT year, week, home_team AS team, home_team, roof, wind AS forecast_wind_mph, temp AS forecast_temp_f, condition, note AS weather_note, bad AS bad_passing_weather FROM w2
    UNION ALL SELECT year, week, away_team, home_team, roof, wind, temp, condition, note, bad FROM w2""")
def _(t):
    return M.game_weather(t.weather)


@query("mk18_annotate", f"""WITH {WEATHER_SQL}, tw AS (SELECT year, week, home_team AS team, note, bad FROM w2 UNION ALL SELECT year, week, away_team, note, bad FROM w2)
    SELECT b.cid, b.year, b.week, b.category, b.side, w.note AS weather_note, CASE WHEN coalesce(w.bad, false) AND ((b.category IN ('passing-yards') AND b.side = 'Over') OR (b.category IN ('rushing-yards', 'rush-attempts') AND b.side = 'Under')) THEN 'against'
      WHEN coalesce(w.bad, false) AND ((b.category IN ('passing-yards') AND b.side = 'Under') OR (b.category IN ('rushing-yards', 'rush-attempts') AND b.side = 'Over')) THEN 'with' ELSE '' END AS weather_lean
    FROM bets b LEFT JOIN tw w ON w.year = b.year AND w.week = b.week AND w.team = b.team""")
def _(t):
    return M.annotate_weather(t.bets, M.game_weather(t.weather), ["year", "week", "team"]).select("cid", "year", "week", "category", "side", "weather_note", "weather_lean")


@query("mk19_to_candidates", f"""SELECT cid, year, week, category, {_FIELD} AS stat_field, CASE WHEN category = 'touchdowns' THEN 0.5E0 WHEN cid % 3 = 0 THEN line + 1.0E0 ELSE line END AS line FROM prop_lines WHERE {_FIELD} IS NOT NULL""")
def _(t):
    p = t.prop_lines.select("cid", "year", "week", "category", F.when(F.col("cid") % 3 != 0, F.col("line")).alias("over_line"), (F.col("line") + 1.0).alias("under_line"))
    return M.to_candidates(p).select("cid", "year", "week", "category", "stat_field", "line")


@query("mk19_skipped", "SELECT category, count(*) AS n_rows, 'no kicker stats' AS reason FROM prop_lines WHERE category = 'kicking-points' GROUP BY category")
def _(t):
    return M.skipped_categories(t.prop_lines)


@query("mk20_log_bets", f"""WITH f AS (SELECT book, player_name, team, category, side, line, odds, ev_pct, row_number() OVER (PARTITION BY book, player_name, category, side, line, odds ORDER BY ev_pct DESC, team) AS rn FROM bets WHERE ev_pct >= 1),
    old AS (SELECT DISTINCT source, book, player_name, category, side, line, odds FROM bets WHERE source = 'ev')
    SELECT 'ev' AS source, book, player_name, category, side, line, odds, 1998 AS year, count(*) AS n FROM old GROUP BY ALL
    UNION ALL SELECT 'ev', book, player_name, category, side, line, odds, 2002, 1 FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.book = f.book AND o.player_name = f.player_name AND o.category = f.category AND o.side = f.side AND o.line = f.line AND o.odds = f.odds)""")
def _(t):
    keep = TR.LOG_COLUMNS
    old = t.bets.where("source = 'ev'").select(*TR.BET_KEY).distinct().withColumns({"year": F.lit(1998), "week": F.lit(1)})
    for c, ty in (("logged_at", "timestamp"), ("team", "string"), ("model_prob", "double"), ("ev_pct", "double"), ("confidence", "string")):
        old = old.withColumn(c, F.lit(None).cast(ty))
    found = t.bets.select("book", "player_name", "team", "category", "side", "line", "odds", "ev_pct")
    out = TR.log_bets(found, old.select(*keep), "ev", 2002, 1, F.to_timestamp(F.lit("2002-01-01")), 1.0)
    return out.groupBy(*TR.BET_KEY, "year").agg(F.count(F.lit(1)).alias("n"))


_BET_VALUE = "CASE b.category " + " ".join(f"WHEN '{c}' THEN CAST({' + '.join('coalesce(s.' + x + ', 0)' for x in cols)} AS DOUBLE)" for c, cols in GRADING_PARTS.items()) + " END"
GRADE_SQL = f"""g0 AS (SELECT b.*, s0.name_key IS NOT NULL AS here, CASE WHEN s0.name_key IS NOT NULL THEN b.name_key ELSE (SELECT min(x.name_key) FROM player_stats x WHERE x.year = b.year AND x.week = b.week AND x.team = b.team
      AND split_part(x.name_key, ' ', 2) = split_part(b.name_key, ' ', 2)) END AS mk FROM bets b LEFT JOIN player_stats s0 ON s0.year = b.year AND s0.week = b.week AND s0.name_key = b.name_key),
    g1 AS (SELECT b.*, s.name_key AS sk, CASE WHEN s.name_key IS NOT NULL THEN {_BET_VALUE} END AS actual, EXISTS (SELECT 1 FROM team_points tp WHERE tp.year = b.year AND tp.week = b.week AND tp.team = b.team) AS fin FROM g0 b LEFT JOIN player_stats s ON s.year = b.year AND s.week = b.week AND s.name_key = b.mk),
    graded AS (SELECT *, CASE WHEN category = 'kicking-points' THEN 'ungradeable' WHEN sk IS NULL AND fin THEN 'void' WHEN sk IS NULL THEN 'pending' WHEN actual = line THEN 'push' WHEN (side = 'Over' AND actual > line) OR (side = 'Under' AND actual < line) THEN 'win' ELSE 'loss' END AS result FROM g1)"""


def graded(t):
    return TR.grade(t.bets.drop("name_key"), t.player_stats, t.team_points)


_PROFIT = f"CASE result WHEN 'win' THEN {hu(dec('odds') + ' - 1.0E0', 4)} WHEN 'loss' THEN -1.0E0 ELSE 0.0E0 END"


@query("mk21_grade", f"WITH {GRADE_SQL} SELECT cid, year, week, category, result, actual, {_PROFIT} AS profit FROM graded")
def _(t):
    return graded(t).select("cid", "year", "week", "category", "result", "actual", "profit")


CLOSE_SQL = f"""snap AS (SELECT a.* FROM archive a JOIN (SELECT s.year, s.week, s.team, max(x.scraped_at) AS last_at FROM schedule s JOIN (SELECT DISTINCT year, week, scraped_at FROM archive) x ON x.year = s.year AND x.week = s.week AND x.scraped_at < s.kickoff GROUP BY s.year, s.week, s.team) m ON m.year = a.year AND m.week = a.week AND m.team = a.team AND a.scraped_at = m.last_at),
    cl AS (SELECT * FROM snap WHERE available <> 'false'),
    cp AS (SELECT b.*, (SELECT min(CASE WHEN b.side = 'Over' THEN c.over_odds ELSE c.under_odds END) FROM cl c WHERE c.year = b.year AND c.week = b.week AND c.name_key = b.name_key AND c.category = b.category AND c.line = b.line AND c.book = b.book) AS close_odds,
      (SELECT CASE WHEN count(*) >= 2 THEN median({ip('c.over_odds')} / ({ip('c.over_odds')} + {ip('c.under_odds')})) END FROM cl c WHERE c.year = b.year AND c.week = b.week AND c.name_key = b.name_key AND c.category = b.category AND c.line = b.line AND c.book NOT IN {PICKEM}) AS po FROM bets b),
    cz AS (SELECT *, CASE WHEN side = 'Over' THEN po ELSE 1.0E0 - po END AS p FROM cp)"""


def closed(t):
    snaps = TR.closing_snapshots(t.archive.drop("kickoff"), t.schedule.select("year", "week", "team", "kickoff"))
    return TR.closing(t.bets.drop("name_key"), snaps.drop("name_key"))


@query("mk22_closing", f"""WITH {CLOSE_SQL} SELECT cid, year, week, close_odds, {hu(f"({dec('odds')} / {dec('close_odds')} - 1.0E0) * 100.0E0", 2)} AS clv_pct, {hu('p', 4)} AS close_fair_prob,
    {hu(f"(p * {dec('odds')} - 1.0E0) * 100.0E0", 2)} AS ev_at_close FROM cz""")
def _(t):
    return closed(t).select("cid", "year", "week", "close_odds", "clv_pct", "close_fair_prob", "ev_at_close")


@query("mk23_grade_summary", f"""WITH {GRADE_SQL}, gp AS (SELECT *, {_PROFIT} AS profit FROM graded WHERE result IN ('win', 'loss', 'push'))
    SELECT source, book, count(*) AS bets, count(*) FILTER (result = 'win') AS wins, {hu('sum(profit)', 2)} AS units, {hu('avg(ev_pct)', 2)} AS avg_claimed_ev, {hu('sum(profit) / count(*) * 100.0E0', 2)} AS roi_pct FROM gp GROUP BY source, book""")
def _(t):
    g = graded(t).withColumns({"clv_pct": F.lit(None).cast("double"), "ev_at_close": F.lit(None).cast("double")})
    return TR.grade_summary(g).drop("avg_clv_pct", "avg_ev_at_close")


@query("mk24_current_week", """SELECT year, week FROM (SELECT year, week, max(CAST(kickoff AS DATE)) AS d FROM schedule GROUP BY year, week) x WHERE d >= DATE '1999-06-08' ORDER BY year, week LIMIT 1""")
def _(t):
    day = F.when(F.col("year") % 2 == 0, F.date_format("kickoff", "yyyy-MM-dd"))
    # Two-digit years belong to 20xx, so the older spelling is only used where it parses to the same day.
    s = t.schedule.select("year", "week", F.coalesce(day, F.date_format("kickoff", "yyyy-M-d")).alias("date"))
    return TR.current_week_from_dates(s, F.to_date(F.lit("1999-06-11")))

