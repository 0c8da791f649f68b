"""DuckDB SQL for every registered query, written from the source columns.

Independent formulations: per-period joins instead of conditional
aggregates, per-chart WHERE bounds instead of the fine-bucket rollup,
``row_number`` windows instead of arg-max aggregates, a plain running window
instead of the range split, and transcript values computed from
the conversation columns instead of scanning JSON text.
"""

from __future__ import annotations

AS_OF = 1706659200
DAY, WEEK = 86400, 604800
TRANSCRIPT_BASE = 1704067200
SYNC_T1 = TRANSCRIPT_BASE + 50 * 3600 + 150


def fam(m: str) -> str:
    return (f"(CASE WHEN coalesce({m}, '') LIKE '%opus%' THEN 'opus' "
            f"WHEN coalesce({m}, '') LIKE '%haiku%' THEN 'haiku' ELSE 'sonnet' END)")


def cents(i: str, o: str, cr: str, cw: str) -> str:
    return f"CAST(({i} * pi + {o} * po + {cr} * pcr + {cw} * pcw) // 1000000 AS BIGINT)"


def dur(d: str) -> str:
    return (f"(CASE WHEN {d} < 60 THEN CAST({d} AS VARCHAR) || 's' "
            f"WHEN {d} < 3600 THEN CAST({d} // 60 AS VARCHAR) || 'm' "
            f"ELSE CAST({d} // 3600 AS VARCHAR) || 'h' || CAST(({d} % 3600) // 60 AS VARCHAR) || 'm' END)")


def human(x: str, decimals: bool = True) -> str:
    mill = (f"CAST({x} // 1000000 AS VARCHAR) || '.' || CAST(({x} // 100000) % 10 AS VARCHAR) || 'M'"
            if decimals else f"CAST({x} // 1000000 AS VARCHAR) || 'M'")
    return (f"(CASE WHEN {x} < 1000 THEN CAST({x} AS VARCHAR) "
            f"WHEN {x} < 1000000 THEN CAST({x} // 1000 AS VARCHAR) || 'k' ELSE {mill} END)")


USAGE = f"""
base_usage AS (
  SELECT event_id AS id,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts,
         's' || CAST(user_id AS VARCHAR) AS session,
         CAST(round(value * 100) AS BIGINT) AS input,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 37 AS output,
         CAST((event_id % 7) * 1000 AS BIGINT) AS cache_read,
         CAST((event_id % 5) * 300 AS BIGINT) AS cache_write,
         CASE event_type WHEN 'purchase' THEN 'm-opus-1' WHEN 'click' THEN 'm-haiku-1'
                         WHEN 'view' THEN 'm-sonnet-1' WHEN 'signup' THEN 'm-other-1' ELSE '' END AS model
  FROM events),
usage AS (
  SELECT id, ts, session, input, output, cache_read, cache_write,
         CAST((input + cache_write + cache_read) * 100 // 200000 AS BIGINT) AS ctx_pct, model
  FROM base_usage),
price(family, pi, pcw, pcr, po) AS (
  VALUES ('opus', 1500, 1875, 150, 7500), ('sonnet', 300, 375, 30, 1500), ('haiku', 80, 100, 8, 400))"""

W = "WITH " + USAGE


def fixture_chats(name: str, where: str) -> str:
    return f"""
{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS rn
                FROM usage WHERE {where}),
{name}_latest AS (SELECT session, model,
                  CASE WHEN model <> '' THEN 'last ' || model ELSE '' END AS title
                  FROM {name}_rows WHERE rn = 1),
{name} AS (
  SELECT r.session, l.title, l.model, CAST(200000 AS BIGINT) AS ctx_size,
         min(r.ts) AS first_ts, max(r.ts) AS last_ts,
         CAST(sum(r.input) AS BIGINT) AS total_input, CAST(sum(r.output) AS BIGINT) AS total_output,
         CAST(sum(coalesce(r.cache_read, 0)) AS BIGINT) AS cache_read,
         CAST(sum(coalesce(r.cache_write, 0)) AS BIGINT) AS cache_write
  FROM {name}_rows r JOIN {name}_latest l USING (session)
  GROUP BY r.session, l.title, l.model)"""


PERIODS = """
periods(period, secs) AS (
  VALUES ('1h', 3600), ('6h', 21600), ('24h', 86400), ('7d', 604800), ('30d', 2592000), ('all', NULL))"""

PERIOD_SUMMARY = W + "," + PERIODS + f""",
pm AS (
  SELECT p.period, u.model, count(*) AS msgs, sum(u.input) AS input, sum(u.output) AS output
  FROM periods p JOIN usage u ON p.secs IS NULL OR u.ts >= {AS_OF} - p.secs
  GROUP BY p.period, u.model),
cm AS (
  SELECT p.period, u.model, sum(u.input) AS input, sum(u.output) AS output,
         sum(coalesce(u.cache_read, 0)) AS cr, sum(coalesce(u.cache_write, 0)) AS cw
  FROM periods p JOIN usage u ON u.ts >= coalesce({AS_OF} - p.secs, 0)
  GROUP BY p.period, u.model),
pc AS (
  SELECT cm.period, CASE WHEN coalesce(cm.model, '') = '' THEN 0 ELSE {cents('input', 'output', 'cr', 'cw')} END AS cents
  FROM cm JOIN price ON price.family = {fam('cm.model')}),
pt AS (SELECT period, sum(msgs) AS msgs, sum(input) AS input, sum(output) AS output FROM pm GROUP BY period),
ct AS (SELECT period, sum(cents) AS cents FROM pc GROUP BY period)
SELECT p.period, CAST(coalesce(pt.msgs, 0) AS BIGINT) AS msgs,
       CAST(coalesce(pt.input, 0) AS BIGINT) AS input, CAST(coalesce(pt.output, 0) AS BIGINT) AS output,
       CAST(coalesce(ct.cents, 0) AS BIGINT) AS cost_cents
FROM periods p LEFT JOIN pt ON pt.period = p.period LEFT JOIN ct ON ct.period = p.period"""

PERIOD_COST = f"SELECT period, cost_cents FROM ({PERIOD_SUMMARY}) t"

MODEL_FAMILY = W + f"\nSELECT id, model, {fam('model')} AS family FROM usage"

USAGE_PRICED = W + f"""
SELECT u.id, u.session, u.model, p.family,
       CAST(p.pi AS BIGINT) AS p_input, CAST(p.pcw AS BIGINT) AS p_cache_write,
       CAST(p.pcr AS BIGINT) AS p_cache_read, CAST(p.po AS BIGINT) AS p_output,
       {cents('u.input', 'u.output', 'u.cache_read', 'u.cache_write')} AS cost_cents,
       CAST((u.input * pi + u.output * po) // 1000000 AS BIGINT) AS cost_cents_ex_cache
FROM usage u JOIN price p ON p.family = {fam('u.model')}"""

HUMANIZE = W + f""",
daily AS (SELECT ts // {DAY} AS day, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
                 CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS total
          FROM usage GROUP BY 1)
SELECT CAST(day AS BIGINT) AS day, input, output, total,
       {human('input')} AS input_h, {human('output')} AS output_h, {human('total')} AS total_h,
       {human('total', False)} AS total_short, {human('input', False)} AS input_short
FROM daily"""

CONTEXT_USAGE = W + """
SELECT id, ctx_pct, filled,
       CAST(least(filled, 15) AS BIGINT) AS green,
       CAST(greatest(least(filled, 22) - 15, 0) AS BIGINT) AS yellow,
       CAST(greatest(filled - 22, 0) AS BIGINT) AS red
FROM (SELECT id, ctx_pct, CAST(least((ctx_pct * 30 + 50) // 100, 30) AS BIGINT) AS filled FROM usage) t"""

COST_BY_FAMILY = W + f""",
bm AS (SELECT model, sum(input) AS input, sum(output) AS output,
              sum(coalesce(cache_read, 0)) AS cr, sum(coalesce(cache_write, 0)) AS cw
       FROM usage GROUP BY model),
fm AS (SELECT price.family, bm.input, bm.output, {cents('bm.input', 'bm.output', 'bm.cr', 'bm.cw')} AS cents
       FROM bm JOIN price ON price.family = {fam('bm.model')} WHERE coalesce(bm.model, '') <> ''),
be AS (SELECT model, sum(input) AS input, sum(output) AS output,
              sum(coalesce(cache_read, 0)) AS cr, sum(coalesce(cache_write, 0)) AS cw
       FROM usage WHERE ts >= 0 GROUP BY model),
fm_epoch AS (SELECT {cents('be.input', 'be.output', 'be.cr', 'be.cw')} AS cents
             FROM be JOIN price ON price.family = {fam('be.model')} WHERE coalesce(be.model, '') <> '')
SELECT family, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
       CAST(sum(cents) AS BIGINT) AS cost_cents
FROM fm GROUP BY family HAVING sum(input) > 0 OR sum(output) > 0
UNION ALL
SELECT 'total', CAST((SELECT coalesce(sum(input), 0) FROM usage) AS BIGINT),
       CAST((SELECT coalesce(sum(output), 0) FROM usage) AS BIGINT),
       CAST((SELECT coalesce(sum(cents), 0) FROM fm_epoch) AS BIGINT)"""

ROLLUP = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS rn FROM usage),
latest AS (SELECT session, model FROM ranked WHERE rn = 1),
sess AS (SELECT session, count(*) AS msgs, min(ts) AS first_ts, max(ts) AS last_ts,
                sum(input) AS total_input, sum(output) AS total_output,
                sum(coalesce(cache_read, 0)) AS cache_read, sum(coalesce(cache_write, 0)) AS cache_write
         FROM usage GROUP BY session)"""

SESSION_ROLLUP = W + ROLLUP + """
SELECT s.session, CAST(msgs AS BIGINT) AS msgs, first_ts, last_ts,
       CAST(total_input AS BIGINT) AS total_input, CAST(total_output AS BIGINT) AS total_output,
       CAST(cache_read AS BIGINT) AS cache_read, CAST(cache_write AS BIGINT) AS cache_write, l.model
FROM sess s JOIN latest l USING (session)"""

TOP_SESSIONS = W + ROLLUP + f""",
top AS (
  SELECT s.session, substring(s.session, 1, 6) AS session_short, CAST(msgs AS BIGINT) AS msgs,
         CAST(total_input AS BIGINT) AS input,
         CAST(total_output AS BIGINT) AS output,
         {cents('total_input', 'total_output', 'cache_read', 'cache_write')} AS cost_cents,
         CAST(last_ts - first_ts AS BIGINT) AS duration_s, {dur('(last_ts - first_ts)')} AS duration,
         last_ts
  FROM sess s JOIN latest l USING (session) JOIN price ON price.family = {fam('l.model')}
  ORDER BY last_ts DESC, s.session LIMIT 3)
SELECT * FROM top WHERE coalesce(session, '') <> ''"""

CHARTS = """
charts(range, w) AS (VALUES ('1h', 120), ('24h', 2880), ('7d', 20160), ('30d', 86400))"""

USAGE_SERIES_BODY = W + "," + CHARTS + f""",
spine AS (SELECT c.range, CAST(s.slot AS BIGINT) AS slot FROM charts c CROSS JOIN range(30) s(slot)),
b AS (SELECT c.range, 29 - ({AS_OF} - u.ts) // c.w AS slot, sum(u.input) AS input, sum(u.output) AS output
      FROM charts c JOIN usage u ON u.ts >= {AS_OF} - 30 * c.w
      GROUP BY c.range, 29 - ({AS_OF} - u.ts) // c.w),
series AS (SELECT spine.range, spine.slot, CAST(coalesce(b.input, 0) AS BIGINT) AS input,
                  CAST(coalesce(b.output, 0) AS BIGINT) AS output
           FROM spine LEFT JOIN b ON b.range = spine.range AND b.slot = spine.slot)"""

USAGE_SERIES = USAGE_SERIES_BODY + "\nSELECT * FROM series"

SERIES_SCALED = USAGE_SERIES_BODY + """,
scaled AS (SELECT *, CAST(greatest(1, max(input + output) OVER (PARTITION BY range)) AS BIGINT) AS mx FROM series)
SELECT range, slot, input, output, mx AS max,
       CAST(CASE WHEN input > 0 THEN least((input * 16 + mx - 1) // mx, 16) ELSE 0 END AS BIGINT) AS dots_in,
       CAST(CASE WHEN output > 0 THEN least((output * 16 + mx - 1) // mx, 16) ELSE 0 END AS BIGINT) AS dots_out
FROM scaled"""

SESSION_RUNNING_COST = W + f""",
r AS (SELECT id, session, ts, model,
             sum(input) OVER w AS ri, sum(output) OVER w AS ro,
             sum(coalesce(cache_read, 0)) OVER w AS rcr, sum(coalesce(cache_write, 0)) OVER w AS rcw
      FROM usage
      WINDOW w AS (PARTITION BY session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, session, ts, model, CAST(ri AS BIGINT) AS run_input, CAST(ro AS BIGINT) AS run_output,
       CAST(rcr AS BIGINT) AS run_cache_read, CAST(rcw AS BIGINT) AS run_cache_write,
       {cents('ri', 'ro', 'rcr', 'rcw')} AS cost_cents
FROM r JOIN price ON price.family = {fam('r.model')}"""

HISTORY = """,
h AS (SELECT ts, id, input, output FROM usage WHERE input > 0 OR output > 0 ORDER BY ts DESC, id DESC LIMIT 50),
hp AS (SELECT CAST(row_number() OVER (ORDER BY ts, id) - 1 AS BIGINT) AS pos, ts, id, input, output FROM h)"""

HISTORY_LAST50 = W + HISTORY + "\nSELECT * FROM hp"

SPARKLINE_LEVELS = W + HISTORY + """,
st AS (SELECT count(*) AS n, greatest(1, max(input)) AS mi, greatest(1, max(output)) AS mo FROM hp),
placed AS (SELECT pos - n + 30 AS slot, least(input * 7 // mi, 7) AS il, least(output * 7 // mo, 7) AS ol
           FROM hp, st)
SELECT CAST(s.slot AS BIGINT) AS slot, CAST(coalesce(p.il, 0) AS BIGINT) AS in_level,
       CAST(coalesce(p.ol, 0) AS BIGINT) AS out_level
FROM range(30) s(slot) LEFT JOIN placed p ON p.slot = s.slot"""

LIVE_EVENT_DECODE = W + """
SELECT id, ts,
       CASE WHEN model = '' THEN '?' WHEN model LIKE '%opus%' THEN 'Opus' WHEN model LIKE '%sonnet%' THEN 'Sonnet'
            WHEN model LIKE '%haiku%' THEN 'Haiku' ELSE 'Other' END AS display_name,
       model, CAST(200000 AS BIGINT) AS ctx_size, input, output, cache_read, cache_write, ctx_pct
FROM usage"""

LIVE_APPEND = W + """
SELECT id, ts, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(ts), '%Y%m%d') AS session,
       input, output, cache_read, cache_write, ctx_pct, model
FROM usage WHERE input > 0 OR output > 0"""

LIVE_STATUS = W + f""",
stored AS (SELECT session, sum(input) AS si, sum(output) AS so, sum(cache_read) AS scr, sum(cache_write) AS scw
           FROM usage WHERE ts < {AS_OF - DAY} GROUP BY session),
run AS (SELECT *, CASE WHEN input > 0 OR output > 0 THEN 1 ELSE 0 END AS k,
               coalesce(sum(CASE WHEN input > 0 OR output > 0 THEN input ELSE 0 END) OVER b, 0) AS ri,
               coalesce(sum(CASE WHEN input > 0 OR output > 0 THEN output ELSE 0 END) OVER b, 0) AS ro,
               coalesce(sum(CASE WHEN input > 0 OR output > 0 THEN cache_read ELSE 0 END) OVER b, 0) AS rcr,
               coalesce(sum(CASE WHEN input > 0 OR output > 0 THEN cache_write ELSE 0 END) OVER b, 0) AS rcw
        FROM usage WHERE ts >= {AS_OF - DAY}
        WINDOW b AS (PARTITION BY session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hist AS (SELECT rn, [least(x * 7 // mi, 7) for x in li] AS il, [least(x * 7 // mo, 7) for x in lo] AS ol FROM (
           SELECT row_number() OVER (ORDER BY ts, id) AS rn,
                  greatest(1, max(input) OVER h) AS mi, greatest(1, max(output) OVER h) AS mo,
                  list(input) OVER w AS li, list(output) OVER w AS lo
           FROM usage WHERE input > 0 OR output > 0
           WINDOW h AS (ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
                  w AS (ORDER BY ts, id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) t),
place AS (SELECT id, sum(CASE WHEN input > 0 OR output > 0 THEN 1 ELSE 0 END)
                       OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS p FROM usage),
ev AS (SELECT e.*, coalesce(s.si, 0) + e.ri + e.input AS ti, coalesce(s.so, 0) + e.ro + e.output AS tout,
              coalesce(s.scr, 0) + e.rcr + e.cache_read AS tcr, coalesce(s.scw, 0) + e.rcw + e.cache_write AS tcw,
              CAST(least((e.ctx_pct * 30 + 50) // 100, 30) AS BIGINT) AS f
       FROM run e LEFT JOIN stored s ON s.session = e.session)
SELECT ev.id, session, model, CAST(ti AS BIGINT) AS session_input, CAST(tout AS BIGINT) AS session_output,
       CAST(tcr AS BIGINT) AS session_cache_read, CAST(tcw AS BIGINT) AS session_cache_write,
       {cents('ti', 'tout', 'tcr', 'tcw')} AS cost_cents, ctx_pct, f AS filled,
       CAST(least(f, 15) AS BIGINT) AS green, CAST(greatest(least(f, 22) - 15, 0) AS BIGINT) AS yellow,
       CAST(greatest(f - 22, 0) AS BIGINT) AS red,
       lpad(coalesce(array_to_string(il, ''), ''), 30, '0') AS in_bar,
       lpad(coalesce(array_to_string(ol, ''), ''), 30, '0') AS out_bar
FROM ev JOIN price ON price.family = {fam('ev.model')} JOIN place ON place.id = ev.id LEFT JOIN hist ON hist.rn = place.p"""

UPSERT_ADDITIVE = W + """,
firsts AS (SELECT session, model, ts FROM (
             SELECT session, model, ts, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS rn FROM usage) t
           WHERE rn = 1),
lastnb AS (SELECT session, model FROM (
             SELECT session, model, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS rn
             FROM usage WHERE model <> '') t WHERE rn = 1),
tot AS (SELECT session, max(ts) AS last_ts, CAST(sum(input) AS BIGINT) AS total_input,
               CAST(sum(output) AS BIGINT) AS total_output, CAST(sum(cache_read) AS BIGINT) AS cache_read,
               CAST(sum(cache_write) AS BIGINT) AS cache_write
        FROM usage GROUP BY session)
SELECT t.session, '' AS title, coalesce(ln.model, f.model) AS model, CAST(200000 AS BIGINT) AS ctx_size,
       f.ts AS first_ts, t.last_ts, t.total_input, t.total_output, t.cache_read, t.cache_write
FROM tot t JOIN firsts f USING (session) LEFT JOIN lastnb ln USING (session)"""

REPLACE_BY_SESSION = W + f""",
rr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS rn
       FROM usage WHERE ts >= {AS_OF - DAY}),
recent AS (SELECT r.session, max(r.ts) AS ts, CAST(sum(r.input) AS BIGINT) AS input,
                  CAST(sum(r.output) AS BIGINT) AS output, CAST(sum(r.cache_read) AS BIGINT) AS cache_read,
                  CAST(sum(r.cache_write) AS BIGINT) AS cache_write, max(l.model) AS model
           FROM rr r JOIN (SELECT session, model FROM rr WHERE rn = 1) l USING (session)
           GROUP BY r.session)
SELECT id, ts, session, input, output, cache_read, cache_write, ctx_pct, model
FROM usage WHERE session NOT IN (SELECT session FROM recent)
UNION ALL
SELECT CAST(NULL AS BIGINT), ts, session, input, output, cache_read, cache_write, CAST(0 AS BIGINT), model
FROM recent"""

UPSERT_IMPORT = W + "," + fixture_chats("oldc", f"ts < {AS_OF - WEEK}") + "," + \
    fixture_chats("newc", f"ts >= {AS_OF - 2 * WEEK}") + """
SELECT coalesce(n.session, o.session) AS session,
       CASE WHEN n.session IS NULL THEN o.title WHEN o.session IS NULL THEN n.title
            WHEN n.title <> '' THEN n.title ELSE o.title END AS title,
       CASE WHEN n.session IS NULL THEN o.model WHEN o.session IS NULL THEN n.model
            WHEN n.model <> '' THEN n.model ELSE o.model END AS model,
       coalesce(o.ctx_size, n.ctx_size) AS ctx_size,
       least(coalesce(o.first_ts, n.first_ts), coalesce(n.first_ts, o.first_ts)) AS first_ts,
       greatest(coalesce(o.last_ts, n.last_ts), coalesce(n.last_ts, o.last_ts)) AS last_ts,
       coalesce(n.total_input, o.total_input) AS total_input,
       coalesce(n.total_output, o.total_output) AS total_output,
       coalesce(n.cache_read, o.cache_read) AS cache_read,
       coalesce(n.cache_write, o.cache_write) AS cache_write
FROM oldc o FULL OUTER JOIN newc n ON o.session = n.session"""


def _gr(c: str) -> str:
    return f"greatest(coalesce(o.{c}, n.{c}), coalesce(n.{c}, o.{c})) AS {c}"


UPSERT_MONOTONE = W + "," + fixture_chats("oldc", f"ts < {AS_OF - WEEK}") + ROLLUP + f""",
newc AS (SELECT s.session, '' AS title, l.model, CAST(200000 AS BIGINT) AS ctx_size, first_ts, last_ts,
                CAST(total_input AS BIGINT) AS total_input, CAST(total_output AS BIGINT) AS total_output,
                CAST(cache_read AS BIGINT) AS cache_read, CAST(cache_write AS BIGINT) AS cache_write
         FROM sess s JOIN latest l USING (session))
SELECT coalesce(n.session, o.session) AS session, coalesce(o.title, n.title) AS title,
       CASE WHEN o.session IS NULL THEN n.model WHEN n.session IS NULL THEN o.model
            ELSE coalesce(nullif(o.model, ''), n.model) END AS model,
       coalesce(o.ctx_size, n.ctx_size) AS ctx_size,
       least(coalesce(o.first_ts, n.first_ts), coalesce(n.first_ts, o.first_ts)) AS first_ts,
       {_gr('last_ts')}, {_gr('total_input')}, {_gr('total_output')}, {_gr('cache_read')}, {_gr('cache_write')}
FROM oldc o FULL OUTER JOIN newc n ON o.session = n.session"""

SCHEMA_EVOLVE = W + "," + fixture_chats("oldc", f"ts < {AS_OF - WEEK}") + "," + \
    fixture_chats("newc", f"ts >= {AS_OF - WEEK}") + """
SELECT session, title, model, ctx_size, first_ts, last_ts, total_input, total_output,
       CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write FROM oldc
UNION ALL
SELECT * FROM newc"""

# ---------------------------------------------------------------- transcripts
LINES = f"""
WITH lines AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) AS session, turn, role, text, CAST(length(text) AS BIGINT) AS L,
         {TRANSCRIPT_BASE} + conv_id * 3600 + turn * 60 AS line_ts,
         role = 'assistant' AS is_a,
         CASE WHEN conv_id % 10 = 9 THEN '' WHEN (conv_id + turn) % 3 = 0 THEN 'm-opus-4'
              WHEN (conv_id + turn) % 3 = 1 THEN 'm-sonnet-4' ELSE 'm-haiku-3' END AS amodel
  FROM conversations)"""


def sessions_cte(name: str, where: str = "TRUE") -> str:
    return f""",
{name} AS (
  SELECT session,
         CAST(sum(CASE WHEN is_a THEN L * 3 + turn ELSE 0 END) AS BIGINT) AS input,
         CAST(sum(CASE WHEN is_a THEN L ELSE 0 END) AS BIGINT) AS output,
         CAST(sum(CASE WHEN is_a AND turn >= 3 THEN L * 40 ELSE 0 END) AS BIGINT) AS cache_read,
         CAST(sum(CASE WHEN is_a AND turn < 3 THEN L * 5 ELSE 0 END) AS BIGINT) AS cache_write,
         coalesce(arg_max(amodel, turn) FILTER (WHERE is_a), '') AS model,
         coalesce(arg_max(replace(text, chr(10), '\\n'), turn) FILTER (WHERE role = 'user' AND turn % 2 = 0), '') AS title,
         CAST(arg_min(line_ts, turn) AS BIGINT) AS first_ts,
         CAST(arg_max(line_ts, turn) AS BIGINT) AS last_ts
  FROM lines WHERE {where} GROUP BY session)"""


def has_tokens(t: str = "") -> str:
    p = f"{t}." if t else ""
    return f"({p}input > 0 OR {p}output > 0 OR {p}cache_read > 0 OR {p}cache_write > 0)"


TS_ALL = LINES + sessions_cte("ts_all")

TRANSCRIPT_TOKENS = TS_ALL + f"\nSELECT session, input, output, cache_read, cache_write FROM ts_all WHERE {has_tokens()}"
TRANSCRIPT_MODEL_TITLE = TS_ALL + "\nSELECT session, model, title FROM ts_all"
TRANSCRIPT_SPAN = TS_ALL + "\nSELECT session, first_ts, last_ts FROM ts_all"

CHATS_SELECT = """SELECT session, title, model, CAST(200000 AS BIGINT) AS ctx_size, first_ts, last_ts,
       input AS total_input, output AS total_output, cache_read, cache_write"""

CHATS = TS_ALL + f""",
chats AS ({CHATS_SELECT} FROM ts_all WHERE {has_tokens()})"""

TRANSCRIPT_FILES = TS_ALL + """
SELECT session, input, output, cache_read, cache_write, model, title, first_ts, last_ts FROM ts_all"""
SESSION_KEY = "SELECT DISTINCT 'c' || conv_id AS session FROM conversations"
BACKFILL_IMPORT = CHATS + "\nSELECT * FROM chats"

IMPORT_PER_LINE = TS_ALL + f"""
SELECT CAST(l.line_ts AS BIGINT) AS ts, l.session,
       CAST(L * 3 + turn AS BIGINT) AS input, L AS output,
       CAST(CASE WHEN turn >= 3 THEN L * 40 ELSE 0 END AS BIGINT) AS cache_read,
       CAST(CASE WHEN turn < 3 THEN L * 5 ELSE 0 END AS BIGINT) AS cache_write,
       CAST(0 AS BIGINT) AS ctx_pct, l.amodel AS model
FROM lines l JOIN ts_all s ON s.session = l.session
WHERE l.is_a AND {has_tokens('s')}"""

INCREMENTAL_SYNC = LINES + sessions_cte("early", f"line_ts <= {SYNC_T1}") + sessions_cte("ts_all") + f"""
{CHATS_SELECT} FROM early WHERE {has_tokens()}
UNION ALL
{CHATS_SELECT} FROM ts_all
WHERE {has_tokens()} AND session NOT IN (SELECT session FROM early WHERE {has_tokens()})"""

PRICE_ONLY = """,
price(family, pi, pcw, pcr, po) AS (
  VALUES ('opus', 1500, 1875, 150, 7500), ('sonnet', 300, 375, 30, 1500), ('haiku', 80, 100, 8, 400))"""

CHAT_LIST = CHATS + PRICE_ONLY + f"""
SELECT * FROM (
  SELECT c.session, substring(c.session, 1, 8) AS session_short, price.family,
         CASE WHEN length(title) > 30 THEN substring(title, 1, 27) || '...' WHEN title = '' THEN '(untitled)'
              ELSE title END AS title,
         total_input AS input, total_output AS output, cache_read + cache_write AS cache_total,
         {cents('total_input', 'total_output', 'cache_read', 'cache_write')} AS cost_cents, last_ts
  FROM chats c JOIN price ON price.family = {fam('c.model')}
  ORDER BY last_ts DESC, c.session LIMIT 100) t
WHERE coalesce(session, '') <> ''"""

CHAT_COUNT = CHATS + "\nSELECT count(*) AS chats FROM chats"

IMPORT_SUMMARY = CHATS + """
SELECT count(*) AS chats, CAST(coalesce(sum(total_input), 0) AS BIGINT) AS input,
       CAST(coalesce(sum(cache_write), 0) AS BIGINT) AS cache_write,
       CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read,
       CAST(coalesce(sum(total_output), 0) AS BIGINT) AS output,
       CAST(coalesce(sum(total_input + total_output + cache_read + cache_write), 0) AS BIGINT) AS total
FROM chats"""

IMPORT_COST_BY_FAMILY = CHATS + PRICE_ONLY + f""",
bm AS (SELECT model, sum(total_input) AS i, sum(total_output) AS o, sum(cache_read) AS cr, sum(cache_write) AS cw
       FROM chats GROUP BY model),
fm AS (SELECT price.family, {cents('i', 'o', 'cr', 'cw')} AS cents
       FROM bm JOIN price ON price.family = {fam('bm.model')} WHERE coalesce(bm.model, '') <> '')
SELECT family, CAST(sum(cents) AS BIGINT) AS cost_cents FROM fm GROUP BY family HAVING sum(cents) > 0
UNION ALL
SELECT 'total' AS family, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cost_cents FROM fm"""

STREAM_SESSION_TOTALS = W + """
SELECT strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(ts), '%Y%m%d') AS session,
       count(*) AS msgs, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
       CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write
FROM usage WHERE input > 0 OR output > 0
GROUP BY 1"""

_SESSION = "'s' || CAST(user_id AS VARCHAR) AS session"
_NONE = "<none>"


def nameless(policy: str, sql: str) -> str:
    """``sql`` over facts of which every fourth user's have no session (a name of its own inside the SQL)."""
    some = sql.replace(_SESSION, f"CASE WHEN user_id % 4 = 0 THEN '{_NONE}' ELSE 's' || CAST(user_id AS VARCHAR) END AS session")
    return f"SELECT '{policy}' AS policy, * REPLACE (nullif(session, '{_NONE}') AS session) FROM ({some}) t"


UPSERT_NAMELESS = " UNION ALL BY NAME ".join(nameless(p, q) for p, q in (
    ("import", UPSERT_IMPORT), ("monotone", UPSERT_MONOTONE), ("additive", UPSERT_ADDITIVE)))

# a live event's session is its day, and only events with tokens are recorded
LIVE_USAGE = W.replace(_SESSION, "strftime(ts, '%Y%m%d') AS session") + ",\nlive AS (SELECT * FROM usage WHERE input > 0 OR output > 0)"
STREAM_ROLLUP = UPSERT_ADDITIVE.replace(W, LIVE_USAGE).replace("FROM usage", "FROM live").replace(
    "live AS (SELECT * FROM live", "live AS (SELECT * FROM usage")

STREAM_SESSION_RINGS = LIVE_USAGE + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS rn FROM live)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY ts, id) - 1 AS BIGINT) AS pos, ts, id, input, output
FROM ranked WHERE rn <= 50"""

ORACLES = {
    "upsert_nameless": UPSERT_NAMELESS,
    "replace_by_day": REPLACE_BY_SESSION,
    "top_sessions_by_day": TOP_SESSIONS,
    "period_from_summary": PERIOD_SUMMARY,
    "import_by_ranges": BACKFILL_IMPORT,
    "stream_rollup": STREAM_ROLLUP,
    "stream_session_rings": STREAM_SESSION_RINGS,
    "model_family": MODEL_FAMILY,
    "usage_priced": USAGE_PRICED,
    "humanize": HUMANIZE,
    "context_usage": CONTEXT_USAGE,
    "period_summary": PERIOD_SUMMARY,
    "period_cost": PERIOD_COST,
    "cost_by_family": COST_BY_FAMILY,
    "top_sessions": TOP_SESSIONS,
    "session_rollup": SESSION_ROLLUP,
    "usage_series": USAGE_SERIES,
    "series_scaled": SERIES_SCALED,
    "session_running_cost": SESSION_RUNNING_COST,
    "history_last50": HISTORY_LAST50,
    "sparkline_levels": SPARKLINE_LEVELS,
    "live_event_decode": LIVE_EVENT_DECODE,
    "live_append": LIVE_APPEND,
    "live_status": LIVE_STATUS,
    "upsert_additive": UPSERT_ADDITIVE,
    "replace_by_session": REPLACE_BY_SESSION,
    "upsert_import": UPSERT_IMPORT,
    "upsert_monotone": UPSERT_MONOTONE,
    "schema_evolve": SCHEMA_EVOLVE,
    "transcript_tokens": TRANSCRIPT_TOKENS,
    "transcript_model_title": TRANSCRIPT_MODEL_TITLE,
    "transcript_span": TRANSCRIPT_SPAN,
    "transcript_files": TRANSCRIPT_FILES,
    "session_key": SESSION_KEY,
    "create_if_missing": BACKFILL_IMPORT,
    "backfill_import": BACKFILL_IMPORT,
    "import_per_line": IMPORT_PER_LINE,
    "incremental_sync": INCREMENTAL_SYNC,
    "chat_list": CHAT_LIST,
    "chat_count": CHAT_COUNT,
    "import_summary": IMPORT_SUMMARY,
    "import_cost_by_family": IMPORT_COST_BY_FAMILY,
    "stream_ingest": LIVE_APPEND,
    "stream_session_totals": STREAM_SESSION_TOTALS,
    "stream_history": HISTORY_LAST50,
    "stream_sync": INCREMENTAL_SYNC,
}
