"""The same questions in DuckDB SQL, written independently of the operators."""

from __future__ import annotations

from usagebook.plans import views as V

_ID = ("session_id", "provider", "raw_model", "auth_mode", "auth_mode_provenance", "service_tier", "inference_geo", "cache_write_data_complete", "input_subset_accounting_consistent")
_COV = "CASE coverage WHEN 'unavailable' THEN 0 WHEN 'partial' THEN 1 WHEN 'complete' THEN 2 ELSE -1 END"

OBS = f"obs AS ({V.duck(V.OBSERVATIONS)})"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY client, event_key ORDER BY " + _COV + " DESC, quality_rank DESC, input_tokens_total DESC, output_tokens_total DESC, source_id DESC, line_number DESC, " + ", ".join(f"coalesce(cast({c} as varchar), '') DESC" for c in _ID) + ") AS place FROM obs)"
FOLDED = f"""folded AS (SELECT client, event_key, min(occurred_at) AS occurred_at, max(input_tokens_total) AS t, max(input_tokens_uncached) AS u, max(input_tokens_cached) AS c,
  max(cache_write_5m_tokens) AS w5, max(cache_write_1h_tokens) AS w1, max(output_tokens_total) AS o, max(reasoning_output_tokens) AS ro, max(web_search_requests) AS ws, max(web_fetch_requests) AS wf,
  greatest(max(cache_write_5m_tokens + cache_write_1h_tokens + cache_write_unknown_tokens), max(cache_write_5m_tokens) + max(cache_write_1h_tokens)) AS w,
  max(quality_rank) AS quality_rank, max({_COV}) AS cov, count(DISTINCT source_id) AS source_count, count(*) AS copies, coalesce(string_agg(DISTINCT warning, ',' ORDER BY warning), '') AS warnings
  FROM obs GROUP BY client, event_key)"""
CANONICAL = f"""canonical AS MATERIALIZED (SELECT f.client, f.event_key, f.occurred_at,
  CASE f.client WHEN 'claude_code' THEN u + c + w ELSE t END AS input_tokens_total, CASE f.client WHEN 'claude_code' THEN u ELSE greatest(t - c - w, 0) END AS input_tokens_uncached,
  c AS input_tokens_cached, w5 AS cache_write_5m_tokens, w1 AS cache_write_1h_tokens, w - w5 - w1 AS cache_write_unknown_tokens, o AS output_tokens_total, ro AS reasoning_output_tokens, ws AS web_search_requests, wf AS web_fetch_requests,
  f.quality_rank, CASE cov WHEN 0 THEN 'unavailable' WHEN 1 THEN 'partial' WHEN 2 THEN 'complete' END AS coverage, CAST(source_count AS BIGINT) AS source_count, CAST(copies AS BIGINT) AS copies, warnings, {", ".join(f"r.{c}" for c in _ID)}
  FROM folded f JOIN ranked r ON f.client = r.client AND f.event_key = r.event_key AND r.place = 1)"""
EVENTS = f"WITH {OBS}, {RANKED}, {FOLDED}, {CANONICAL}"
CAT = f"aliases AS ({V.duck(V.ALIASES)}), rates AS ({V.duck(V.RATES)}), modifiers AS ({V.duck(V.MODIFIERS)}), policies AS ({V.duck(V.POLICIES)}), overrides AS ({V.duck(V.OVERRIDES)})"

RESOLVED = """ev AS MATERIALIZED (SELECT e.*, a.canonical_model, a.id AS alias_id FROM canonical e LEFT JOIN aliases a ON lower(trim(e.provider)) = a.provider AND e.raw_model = a.raw_model AND a.effective_from <= e.occurred_at AND (a.effective_to IS NULL OR e.occurred_at < a.effective_to))"""
_U = "('', 'unknown', 'not_available', 'not-available', 'unavailable', 'n/a', 'null')"


def _kind(kind: str) -> str:
    """CTEs rated_k, scen_k, range_k."""
    usd = kind == "usd"
    q = {"r1": "input_tokens_uncached" if usd else "greatest(input_tokens_total - input_tokens_cached, 0)", "r2": "input_tokens_cached", "r3": "cache_write_unknown_tokens" if usd else "0", "r4": "cache_write_5m_tokens" if usd else "0", "r5": "cache_write_1h_tokens" if usd else "0", "r6": "output_tokens_total"}
    col = {"r1": "input", "r2": "cache_read", "r3": "cache_write", "r4": "cache_write_5m", "r5": "cache_write_1h", "r6": "output"}
    nano = lambda r: f"cast(round({col[r]} * tok * 1000) as bigint)"
    cost = " + ".join([f"coalesce({q[r]} * {nano(r)}, 0)" for r in q] + [f"coalesce({n} * cast(round({r} * tool * 1000000000) as bigint), 0)" for n, r in (("web_search_requests", "web_search"), ("web_fetch_requests", "web_fetch"))])
    gaps = " + ".join([f"CASE WHEN {q[r]} > 0 AND {col[r]} IS NULL THEN 1 ELSE 0 END" for r in q] + [f"CASE WHEN {n} > 0 AND {r} IS NULL THEN 1 ELSE 0 END" for n, r in (("web_search_requests", "web_search"), ("web_fetch_requests", "web_fetch"))])
    done = " + ".join([f"CASE WHEN {q[r]} > 0 AND {col[r]} IS NOT NULL THEN 1 ELSE 0 END" for r in q] + [f"CASE WHEN {n} > 0 AND {r} IS NOT NULL THEN 1 ELSE 0 END" for n, r in (("web_search_requests", "web_search"), ("web_fetch_requests", "web_fetch"))])
    need = "cache_write_observation_required AND NOT coalesce(cache_write_data_complete, false)" if usd else "false"
    return f"""
rated_{kind} AS MATERIALIZED (SELECT e.*, r.id AS rate_id, r.provider AS rp, r.dims, r.cache_write_observation_required, {", ".join("r." + c for c in col.values())}, r.web_search, r.web_fetch, p.allowed_a, p.allowed_b, p.default_value, o.value AS attested,
    CASE r.dims WHEN 'inference_geo' THEN lower(trim(e.inference_geo)) WHEN 'service_tier' THEN lower(trim(e.service_tier)) END AS observed
  FROM ev e JOIN rates r ON r.kind = '{kind}' AND r.provider = lower(trim(e.provider)) AND r.canonical_model = e.canonical_model AND r.effective_from <= e.occurred_at AND (r.effective_to IS NULL OR e.occurred_at < r.effective_to)
    AND e.input_tokens_total >= r.min_input_tokens AND (r.max_input_tokens_exclusive IS NULL OR e.input_tokens_total < r.max_input_tokens_exclusive)
  LEFT JOIN policies p ON p.rate_id = r.id AND p.dimension = r.dims
  LEFT JOIN overrides o ON lower(trim(o.provider)) = r.provider AND o.canonical_model = r.canonical_model AND lower(trim(o.dimension)) = r.dims AND o.effective_from <= e.occurred_at AND (o.effective_to IS NULL OR e.occurred_at < o.effective_to)),
grown_{kind} AS MATERIALIZED (SELECT *, unnest(CASE WHEN dims = 'none' THEN ['-'] WHEN coalesce(attested, CASE WHEN observed NOT IN {_U} THEN observed END) IS NULL THEN [allowed_a, allowed_b]
    WHEN coalesce(attested, observed) IN (allowed_a, allowed_b) THEN [coalesce(attested, observed)] ELSE cast([] as varchar[]) END) AS val FROM rated_{kind}),
product_{kind} AS MATERIALIZED (SELECT g.client, g.event_key, g.val, product(m.multiplier) FILTER (WHERE m.scope IN ('token_rates', 'all')) AS tok, product(m.multiplier) FILTER (WHERE m.scope IN ('tool_rates', 'all')) AS tool
  FROM grown_{kind} g JOIN modifiers m ON m.kind = '{kind}' AND m.provider = g.rp AND m.canonical_model = g.canonical_model AND m.value = g.val AND m.dimension = g.dims AND m.effective_from <= g.occurred_at AND (m.effective_to IS NULL OR g.occurred_at < m.effective_to) GROUP BY ALL),
scen_{kind} AS MATERIALIZED (SELECT client, event_key, val, sub, done, gaps, need, CASE WHEN gaps + need = 0 THEN 'priced' ELSE 'partial' END AS status,
    CASE WHEN gaps + need = 0 THEN sub WHEN {usd} AND gaps = 0 AND lower(trim(provider)) = 'openai' AND coalesce(input_subset_accounting_consistent, true) AND w_rate IS NOT NULL THEN sub - i_cost + least(i_cost, w_cost) WHEN done > 0 AND sub <> 0 THEN sub END AS known,
    CASE WHEN gaps + need = 0 THEN sub WHEN {usd} AND gaps = 0 AND lower(trim(provider)) = 'openai' AND coalesce(input_subset_accounting_consistent, true) AND w_rate IS NOT NULL THEN sub - i_cost + greatest(i_cost, w_cost) END AS upper,
    val = CASE WHEN dims = 'none' THEN '-' ELSE coalesce(attested, observed, default_value) END AS is_default
  FROM (SELECT *, {cost} AS sub, {gaps} AS gaps, {done} AS done, CASE WHEN {need} THEN 1 ELSE 0 END AS need, input_tokens_uncached * {nano("r1")} AS i_cost, input_tokens_uncached * {nano("r3")} AS w_cost, cache_write AS w_rate
    FROM (SELECT g.*, coalesce(p.tok, 1) AS tok, coalesce(p.tool, 1) AS tool FROM grown_{kind} g LEFT JOIN product_{kind} p ON p.client = g.client AND p.event_key = g.event_key AND p.val = g.val) m) n),
range_{kind} AS MATERIALIZED (SELECT client, event_key, count(*) AS n, CASE WHEN count(known) = count(*) AND count(upper) = count(*) THEN CASE WHEN min(known) = max(upper) THEN 'exact' ELSE 'bounded' END ELSE 'partial' END AS status,
    CASE WHEN count(known) = count(*) THEN min(known) END AS lower, CASE WHEN count(known) = count(*) AND count(upper) = count(*) THEN max(upper) END AS upper,
    max(CASE WHEN is_default THEN status END) AS legacy FROM scen_{kind} GROUP BY client, event_key)"""


PRICED = f"""{EVENTS}, {CAT}, {RESOLVED}, {_kind("usd")}, {_kind("credits")},
flags AS (SELECT e.*, a.value IS NULL AND (e.auth_mode IS NULL OR coalesce(e.auth_mode_provenance = 'current_profile_inferred', false)) AS uncertain, coalesce(a.value, e.auth_mode) AS auth
  FROM ev e LEFT JOIN overrides a ON lower(trim(a.provider)) = lower(trim(e.provider)) AND a.canonical_model = e.canonical_model AND a.dimension = 'auth_mode' AND a.effective_from <= e.occurred_at AND (a.effective_to IS NULL OR e.occurred_at < a.effective_to)),
priced AS (SELECT f.*, coalesce(u.status, 'unpriced') AS usd_status, u.lower AS usd_lower, u.upper AS usd_upper, coalesce(u.n, 0) AS scenario_count,
    f.client = 'openai_codex' AND NOT (NOT uncertain AND contains(lower(regexp_replace(coalesce(auth, ''), '[^A-Za-z0-9]', '', 'g')), 'apikey')) AS applies,
    coalesce(k.status, 'unpriced') AS cs, k.lower AS cl, k.upper AS cu, coalesce(u.legacy, 'unpriced') AS lu, coalesce(k.legacy, 'unpriced') AS lc
  FROM flags f LEFT JOIN range_usd u USING (client, event_key) LEFT JOIN range_credits k USING (client, event_key)),
final AS (SELECT *, CASE WHEN NOT applies THEN 'unavailable' WHEN uncertain AND cs IN ('exact', 'bounded') THEN 'bounded' ELSE cs END AS credits_status,
    CASE WHEN applies THEN CASE WHEN uncertain AND cs IN ('exact', 'bounded') THEN 0 ELSE cl END END AS credits_lower, CASE WHEN applies THEN cu END AS credits_upper,
    CASE WHEN applies AND uncertain THEN 'partial' WHEN NOT applies THEN lu WHEN lu = lc THEN lu ELSE 'partial' END AS legacy_status FROM priced)"""


def measure(name: str) -> str:
    s = lambda x: f"count(*) FILTER (WHERE {name}_status = '{x}')"
    n = f"({s('exact')} + {s('bounded')} + {s('partial')} + {s('unpriced')})"
    return f"""CASE WHEN {n} = 0 THEN 'unavailable' WHEN {s("exact")} = {n} AND count({name}_upper) = {n} THEN 'exact' WHEN {s("exact")} + {s("bounded")} = {n} AND count({name}_lower) = {n} AND count({name}_upper) = {n} THEN 'bounded'
    WHEN {s("unpriced")} = {n} THEN 'unpriced' ELSE 'partial' END AS {name}_status, CAST(sum({name}_lower) AS BIGINT) AS {name}_lower, CASE WHEN {n} > 0 AND count({name}_upper) = {n} THEN CAST(sum({name}_upper) AS BIGINT) END AS {name}_upper"""


_C = ("input_tokens_total", "input_tokens_uncached", "input_tokens_cached", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_unknown_tokens", "output_tokens_total", "reasoning_output_tokens", "web_search_requests", "web_fetch_requests")
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _C)
USAGE = f"""count(*) AS requests, count(DISTINCT client || '|' || session_id) AS sessions, {SUMS}, count(*) FILTER (WHERE legacy_status = 'priced') AS priced_events, count(*) FILTER (WHERE legacy_status = 'partial') AS partial_events, count(*) FILTER (WHERE legacy_status = 'unpriced') AS unpriced_events,
  CASE min(quality_rank) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'heuristic' WHEN 2 THEN 'derived' ELSE 'exact' END AS quality, {measure("usd")}, {measure("credits")}"""


def local_day(zone: str, ts: str = "occurred_at") -> str:
    return f"CAST(timezone('{zone}', timezone('UTC', {ts})) AS DATE)"


LOG = f"WITH log AS ({V.duck(V.COUNTER_LOG)})"
BUCKETS = f"{EVENTS}, buckets AS ({V.duck(V.BUCKETS)})"
