"""Plain SQL with the same meaning as each registered query, for DuckDB."""

from ..config import DEFAULTS, micros
from ..functions import text as X, verdicts as V
from .views import with_views

SQL = {}


def oracle(name, views, body, ctes=""):
    """views: view names; ctes: further ', name as (...)' definitions; body: the final select."""
    prefix = with_views(*views) if views else "with recursive dummy as (select 1)"
    SQL[name] = f"{prefix}{',' if ctes else ''}\n{ctes}\n{body}"


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def has_any(col, words):
    return "(" + " or ".join(f"position({lit(w)} in {col}) > 0" for w in words) + ")"


def re(col, pattern):
    return f"regexp_matches({col}, {lit(pattern.replace('(?d)', ''))})"


def flag_conditions(m="m"):
    return {
        "failed_login": has_any(m, X.FAILED_LOGIN),
        "invalid_user": has_any(m, [X.INVALID_USER]),
        "privilege_escalation": f"({has_any(m, ['sudo'])} and {has_any(m, X.SUDO_FAILURES)})",
        "recon_tool": has_any(m, X.RECON_TOOLS),
        "remote_download": re(m, X.REMOTE_DOWNLOAD),
        "suspicious_command": has_any(m, X.SUSPICIOUS_COMMANDS),
        "scan_like_tcp": has_any(m, X.SCAN_LIKE_TCP),
        "high_risk_port": has_any(m, X.HIGH_RISK_PORTS),
        "sql_injection_like": re(m, X.SQL_INJECTION),
    }


def flags_joined(sep, m="m"):
    return f"concat_ws({lit(sep)}, " + ", ".join(
        f"case when {c} then {lit(n)} end" for n, c in flag_conditions(m).items()) + ")"


def severity_sql():
    c = flag_conditions()
    return (f"case when predicted_label = 'malicious' and confidence >= {DEFAULTS.critical_confidence} then 'critical' "
            f"when predicted_label = 'malicious' then 'high' "
            f"when predicted_label = 'suspicious' and ({c['privilege_escalation']} or {c['remote_download']}) then 'high' "
            f"when predicted_label = 'suspicious' then 'medium' else 'low' end")


EXPLAIN = (f"case when allowlisted = 1 then 'Allowlisted activity.' else 'Predicted as ' || predicted_label || "
           f"' with confidence ' || printf('%.2f', confidence) || '. Flags: ' || "
           f"coalesce(nullif({flags_joined(', ')}, ''), 'none') || '.' end")
DET = f"det as (select *, {severity_sql()} as severity from (select *, lower(message) as m from detections))"


def thin(out, src, keys, fires, extra=""):
    """Recursive walk over `src`: a row fires when `fires` (on r.ts_us and w.anchor) holds."""
    on = " and ".join(f"r.{k} = w.{k}" for k in keys)
    part = ", ".join(keys)
    more = f", {extra}" if extra else ""
    rmore = f", r.{extra}" if extra else ""
    rkeys = ", ".join(f"r.{k}" for k in keys)
    return f"""{out}_r as (select *, row_number() over (partition by {part} order by ts_us, event_id) as rn from {src}),
{out}_w as (select {part}, event_id, ts_us, rn, ts_us as anchor, true as fired{more} from {out}_r where rn = 1
  union all select {rkeys}, r.event_id, r.ts_us, r.rn, case when {fires} then r.ts_us else w.anchor end, {fires}{rmore}
  from {out}_w w join {out}_r r on {on} and r.rn = w.rn + 1),
{out} as (select * from {out}_w where fired)"""


oracle("alert_severity_counts", ["detections"],
       "select severity, predicted_label, count(*) as n from det group by all", DET)
oracle("rule_flags", ["log_events"],
       f"select event_id, {flags_joined(',')} as flags from (select *, lower(message) as m from log_events)")
oracle("event_text", ["log_events"],
       f"select event_id, 'service=' || service || ' host=' || hostname || ' ip=' || source_ip || ' message=' || message"
       f" || ' flags=' || {flags_joined(' ')} as text from (select *, lower(message) as m from log_events)")
oracle("extract_fields", ["log_events"], r"""select event_id, nullif(regexp_extract(message, 'dst_port=(\d+)', 1), '') as dst_port,
 nullif(regexp_extract(message, 'dst_ip=(\S+)', 1), '') as dst_host, nullif(regexp_extract(lower(message), 'rpl_parent=(\S+)', 1), '') as rpl_parent,
 cast(nullif(regexp_extract(lower(message), 'fwd_count=(\d+)', 1), '') as bigint) as fwd_count from log_events""")
FAILED, LOGIN = has_any("lower(message)", X.LOGIN_FAILURES), has_any("lower(message)", X.LOGIN_SUCCESSES)
PORT, HOST = r"regexp_matches(message, 'dst_port=\d+')", r"regexp_matches(message, 'dst_ip=\d')"
VOLUME = f"(service in ('tcp', 'udp') and {has_any('lower(message)', X.VOLUME_TOKENS)})"
oracle("pattern_predicates", ["log_events"],
       f"select event_id, {FAILED} as failed_login, {LOGIN} as login, {PORT} as to_port, {HOST} as to_host, {VOLUME} as high_volume from log_events")
oracle("allowlisted", ["detections"], "select event_id, source_ip from detections where allowlisted = 1")


def label_sql(col):
    v = f"lower(trim({col}))"

    def any_of(words):
        return "(" + ", ".join(lit(w) for w in words) + ")"

    return (f"case when {v} in {any_of(V.BENIGN_VALUES)} then 'benign' when {v} in {any_of(V.SUSPICIOUS_VALUES)} then 'suspicious' "
            f"when {v} in {any_of(V.MALICIOUS_VALUES)} then 'malicious' when {has_any(v, V.BENIGN_PARTS)} then 'benign' "
            f"when {has_any(v, V.SUSPICIOUS_PARTS)} then 'suspicious' when {has_any(v, V.MALICIOUS_PARTS)} then 'malicious' end")


oracle("normalize_label", ["raw_labels"], f"select event_id, {label_sql('raw_label')} as label from raw_labels")
oracle("escalated_severity", ["detections"], """select severity, case severity when 'low' then 'medium' when 'medium' then 'high'
 else 'critical' end as escalated, count(*) as n from det group by all""", DET)
oracle("explanations", ["detections"], f"select event_id, {EXPLAIN} as explanation from (select *, lower(message) as m from detections)")

DEDUP = thin("anchors", "(select * from detections where allowlisted = 0)",
             ["source_ip", "hostname", "service", "message"], "r.ts_us - w.anchor > 120000000")
oracle("dedup_anchors", ["detections"], "select event_id, ts_us from anchors", DEDUP)
FULL = DET + ",\n" + DEDUP + f""",
full_det as (select det.*, det.allowlisted = 0 and a.event_id is null as deduplicated, {EXPLAIN.replace('confidence', 'det.confidence')} as explanation,
 {flags_joined(',')} as flags from det left join (select event_id from anchors) a on det.event_id = a.event_id),
alerts as (select *, predicted_label = 'malicious' as honeypot_sent from full_det where predicted_label <> 'benign' and not deduplicated)"""
FULL = FULL.replace("' with det.confidence '", "' with confidence '")
oracle("predict_events", ["detections"],
       "select event_id, predicted_label, severity, flags, deduplicated, explanation from full_det", FULL)
oracle("stored_alerts", ["detections"], "select event_id, severity, honeypot_sent from alerts", FULL)
oracle("alert_stats", ["detections"], """select 'total' as kind, 'all' as name, count(*) as n, cast(coalesce(sum(honeypot_sent::int), 0) as bigint) as forwarded from alerts
 union all select 'label', predicted_label, count(*), cast(sum(honeypot_sent::int) as bigint) from alerts group by predicted_label
 union all select 'severity', severity, count(*), cast(sum(honeypot_sent::int) as bigint) from alerts group by severity""", FULL)
oracle("forwardable", ["detections"],
       "select event_id, source_ip, true as honeypot_sent from detections where predicted_label = 'malicious'")
oracle("alerts_page", ["detections"], """select event_id, source_ip, predicted_label, severity from det where predicted_label <> 'benign'
 order by event_id desc limit 50 offset 10""", DET)
oracle("alerts_page_filtered", ["detections"], """select event_id, source_ip, predicted_label, severity from det
 where predicted_label = 'malicious' and severity = 'critical' order by event_id desc limit 20""", DET)


def frame(seconds):
    return (f"(partition by source_ip order by ts_us range between {micros(seconds)} preceding and current row)")


PORT_VALUE = r"case when regexp_matches(message, 'dst_port=\d+') then regexp_extract(message, 'dst_port=(\d+)', 1) end"
HOST_VALUE = r"case when regexp_matches(message, 'dst_ip=\d') then regexp_extract(message, 'dst_ip=(\S+)', 1) end"
oracle("sliding_counts", ["log_events"], f"""select source_ip, event_id, cast(sum(case when {FAILED} then 1 else 0 end) over {frame(60)} as bigint) as failed_60s,
 count(distinct {PORT_VALUE}) over {frame(10)} as ports_10s, count(distinct {HOST_VALUE}) over {frame(30)} as hosts_30s from log_events""")
oracle("event_rate", ["log_events"],
       f"select event_id, round(count(*) over {frame(5)} / 5.0::double, 6) as rate from log_events")

COOLDOWN = "r.ts_us - w.anchor >= 30000000"
COUNTS = f"""counted as (select source_ip, event_id, ts_us, cast(sum(case when {FAILED} then 1 else 0 end) over {frame(60)} as bigint) as brute_force,
 count(distinct {PORT_VALUE}) over {frame(10)} as port_scan, count(distinct {HOST_VALUE}) over {frame(30)} as lateral_movement,
 cast(sum(case when {VOLUME} then 1 else 0 end) over {frame(5)} as bigint) as data_exfil_burst,
 cast(sum(case when {LOGIN} then 1 else 0 end) over {frame(120)} as bigint) as logins from log_events)"""


def pattern_ctes(name, least):
    return (f"q_{name} as (select source_ip, event_id, ts_us, {name} as matched_count from counted where {name} >= {least}),\n"
            + thin(f"a_{name}", f"q_{name}", ["source_ip"], COOLDOWN, "matched_count"))


SEQUENCE = f"""scans as (select l.source_ip, l.event_id, l.ts_us, max(case when s.event_id is not null then l.ts_us end)
  over (partition by l.source_ip order by l.ts_us range between unbounded preceding and current row) as scan_ts
  from log_events l left join a_port_scan s on l.event_id = s.event_id),
q_login_after_scan as (select c.source_ip, c.event_id, c.ts_us, c.logins as matched_count from counted c join scans s on c.event_id = s.event_id
  where c.logins >= 1 and c.ts_us - s.scan_ts <= 120000000),
""" + thin("a_login_after_scan", "q_login_after_scan", ["source_ip"], COOLDOWN, "matched_count")
LEAST = {"brute_force": 5, "port_scan": 5, "lateral_movement": 4, "data_exfil_burst": 20}
for q, p in (("cep_brute_force", "brute_force"), ("cep_port_scan", "port_scan"), ("cep_lateral", "lateral_movement"),
             ("cep_exfil", "data_exfil_burst")):
    oracle(q, ["log_events"], f"select source_ip, event_id, ts_us, matched_count from a_{p}",
           COUNTS + ",\n" + pattern_ctes(p, LEAST[p]))
oracle("cep_login_after_scan", ["log_events"], "select source_ip, event_id, ts_us, matched_count from a_login_after_scan",
       COUNTS + ",\n" + pattern_ctes("port_scan", 5) + ",\n" + SEQUENCE)
TIERS = {"brute_force": "high", "port_scan": "high", "lateral_movement": "critical", "login_after_scan": "critical",
         "data_exfil_burst": "high"}
oracle("cep_all_patterns", ["log_events"], "\nunion all ".join(
    f"select '{p}' as pattern_name, '{t}' as severity, count(*) as alerts, count(distinct source_ip) as sources, max(matched_count) as largest from a_{p} having count(*) > 0"
    for p, t in TIERS.items()),
       COUNTS + ",\n" + ",\n".join(pattern_ctes(p, n) for p, n in LEAST.items()) + ",\n" + SEQUENCE)
oracle("custom_pattern", ["log_events"], """select source_ip, event_id, matched_count, 'medium' as severity,
 '3+ recon tool messages within 20 seconds' as description from a_recon""",
       f"""c as (select source_ip, event_id, ts_us, cast(sum(case when {has_any('lower(message)', X.RECON_TOOLS)} then 1 else 0 end) over {frame(20)} as bigint) as recon from log_events),
q as (select source_ip, event_id, ts_us, recon as matched_count from c where recon >= 3),
""" + thin("a_recon", "q", ["source_ip"], COOLDOWN, "matched_count"))
oracle("recent_matches", ["log_events"], """select alert_id, count(*) as n, string_agg(event_id::varchar, ',' order by ts_us, event_id) as ids from m where r <= 10 group by alert_id""",
       COUNTS + ",\n" + pattern_ctes("brute_force", 5) + f""",
m as (select a.event_id as alert_id, l.event_id, l.ts_us, row_number() over (partition by a.event_id order by l.ts_us desc, l.event_id desc) as r
 from a_brute_force a join log_events l on l.source_ip = a.source_ip and l.ts_us between a.ts_us - 60000000 and a.ts_us and {FAILED.replace('message', 'l.message')})""")
oracle("pattern_window_stats", ["log_events"], """select e.source_ip, e.n as buffered_events, b.t as brute_force, p.t as port_scan
 from (select source_ip, count(*) as n from log_events group by 1) e
 left join (select source_ip, round(max(ts_us) / 1000000.0::double, 1) as t from a_brute_force group by 1) b on e.source_ip = b.source_ip
 left join (select source_ip, round(max(ts_us) / 1000000.0::double, 1) as t from a_port_scan group by 1) p on e.source_ip = p.source_ip""",
       COUNTS + ",\n" + pattern_ctes("brute_force", 5) + ",\n" + pattern_ctes("port_scan", 5))

# Flood: fires when 8 rows that arrived after the last quiet period lie within 5 s.
oracle("dos_flood", ["log_events"], "select source_ip, event_id, case when fired then 'dos_flood_detected' else 'dos_flood_ongoing' end as flag from fw where fired or ongoing",
       """fr as (select *, row_number() over (partition by source_ip order by ts_us, event_id) as rn from log_events),
fk as (select a.source_ip, a.rn, min(b.rn) as oldest from fr a join fr b on a.source_ip = b.source_ip and b.rn <= a.rn and b.ts_us >= a.ts_us - 5000000 group by 1, 2),
fj as (select fr.source_ip, fr.event_id, fr.ts_us, fr.rn, fk.oldest from fr join fk on fr.source_ip = fk.source_ip and fr.rn = fk.rn),
fw as (select source_ip, event_id, ts_us, rn, case when rn - oldest + 1 >= 8 then ts_us + 30000000 else 0 end as until,
   cast(1 as bigint) as since, rn - oldest + 1 >= 8 as fired, false as ongoing from fj where rn = 1
 union all select f.source_ip, f.event_id, f.ts_us, f.rn,
   case when f.ts_us < w.until then w.until when f.rn - greatest(f.oldest, w.since) + 1 >= 8 then f.ts_us + 30000000 else w.until end,
   case when f.ts_us < w.until then f.rn + 1 else w.since end,
   f.ts_us >= w.until and f.rn - greatest(f.oldest, w.since) + 1 >= 8, f.ts_us < w.until
 from fw w join fj f on f.source_ip = w.source_ip and f.rn = w.rn + 1)""")

# ---- routing, profiling, gateways ----
oracle("label_distribution", ["raw_labels"],
       f"select coalesce({label_sql('raw_label')}, 'unknown') as label, count(*) as n from raw_labels group by 1")
CLAIMS = r"""claims as (select source_ip, lower(source_ip) as child, nullif(regexp_extract(lower(message), 'rpl_parent=(\S+)', 1), '') as parent, event_id, ts_us
 from log_events where position('rpl_parent=' in lower(message)) > 0)"""
oracle("wormhole_pairs", ["log_events"], """select distinct a.source_ip, a.parent, a.event_id from claims a join claims b
 on b.child = a.parent and b.parent = a.child and (b.ts_us, b.event_id) <= (a.ts_us, a.event_id)""", CLAIMS)
oracle("forward_ticks", ["log_events"], """select source_ip, tick, coalesce(max(n) filter (spot = final) + count(*) filter (spot > final), count(*)) as packet_count
 from (select *, max(spot) filter (n is not null) over (partition by source_ip, tick) as final from
  (select source_ip, cast(floor(ts_us / 60000000) as bigint) as tick, struct_pack(ts_us, event_id) as spot,
   cast(nullif(regexp_extract(message, 'fwd_count=([0-9]+)', 1), '') as bigint) as n from log_events)) group by source_ip, tick""")
BASELINE = """base as (select *, count(*) over w as points, avg(packet_count) over w as mean,
 case when count(*) over w >= 2 then stddev_samp(packet_count) over w else 0 end as std from node_ticks
 window w as (partition by node order by tick rows between 60 preceding and 1 preceding))"""
oracle("rolling_baseline", ["node_ticks"],
       "select node, tick, points, round(mean, 6) as mean, round(std, 6) as std from base", BASELINE)
oracle("blackhole", ["node_ticks"], """select node, tick, packet_count, round(mean - std, 6) as threshold from base
 where points >= 5 and std > 0 and packet_count < mean - std""", BASELINE)
SLOPES = """sl as (select *, row_number() over (partition by node order by tick) as i from node_ticks),
sf as (select *, least(i, 60) as points, case when i >= 2 then regr_slope(packet_count, i) over
 (partition by node order by tick rows between 59 preceding and current row) else 0 end as slope from sl),
sd as (select *, abs(case when points >= 6 then slope end - lag(case when points >= 6 then slope end) over (partition by node order by tick)) as fluctuation from sf),
ss as (select *, i - 5 as rn from sd where points >= 6),
sa as (select node, tick, rn, slope, case when 0 >= 0.25 then 0.0::double else 0.0::double end as a, false as bad from ss where rn = 1
 union all select s.node, s.tick, s.rn, s.slope, case when w.a + s.fluctuation >= 0.25 then w.a + s.fluctuation else (w.a + s.fluctuation) * 0.8::double end,
  w.a + s.fluctuation >= 0.25 from sa w join ss s on s.node = w.node and s.rn = w.rn + 1)"""
oracle("amof_slopes", ["node_ticks"],
       "select node, tick, round(slope, 6) + 0.0::double as slope, round(fluctuation, 6) as fluctuation from sd", SLOPES)
oracle("amof", ["node_ticks"], "select node, tick, min(tick) over (partition by node) as first_anomalous_tick from sa where bad", SLOPES)
oracle("amof_state", ["node_ticks"], """select n.node, round(coalesce(s.a, 0), 4) as accumulated_fluctuation, round(coalesce(s.slope, 0), 4) + 0.0::double as last_slope,
 n.c as count_history_len, least(coalesce(s.rn, 0), 10) as slopes
 from (select node, least(count(*), 60) as c from node_ticks group by 1) n
 left join (select * from sa qualify row_number() over (partition by node order by rn desc) = 1) s on n.node = s.node""", SLOPES)
LOW, HIGH = "ln(0.10::double / (1 - 0.05::double))", "ln((1 - 0.10::double) / 0.05::double)"
LLR = "(r.dropped * ln(0.15::double / 0.01::double) + r.forwarded * ln((1 - 0.15::double) / (1 - 0.01::double)))"
MOVED = f"(case when w.s + {LLR} <= {LOW} then 0.0::double else w.s + {LLR} end)"
ALERT = f"({MOVED} >= {HIGH} and r.rn >= 20 and (w.last is null or r.ts_us - w.last > 120000000))"
SPRT = f"""gr as (select *, row_number() over (partition by gateway_id order by ts_us, event_id) as rn,
 cast(sum(forwarded) over (partition by gateway_id order by ts_us, event_id rows unbounded preceding) as bigint) as f,
 cast(sum(dropped) over (partition by gateway_id order by ts_us, event_id rows unbounded preceding) as bigint) as d from gateway_obs),
gw as (select gateway_id, cast(0 as bigint) as rn, cast(null as bigint) as event_id, 0.0::double as s, cast(null as bigint) as last, false as hit, 0.0::double as stat,
  cast(0 as bigint) as f, cast(0 as bigint) as d from gr where rn = 1
 union all select r.gateway_id, r.rn, r.event_id, case when {ALERT} then 0.0::double else {MOVED} end, case when {ALERT} then r.ts_us else w.last end, {ALERT}, {MOVED}, r.f, r.d
 from gw w join gr r on r.gateway_id = w.gateway_id and r.rn = w.rn + 1)"""
oracle("gateway_sprt", ["gateway_obs"], """select gateway_id, event_id, round(stat, 6) as sprt_statistic, round(d::double / (f + d), 6) as estimated_pdp,
 rn as observation_count from gw where hit""", SPRT)
oracle("gateway_status", ["gateway_obs"], f"""select gateway_id, f as total_forwarded, d as total_dropped, case when f + d > 0 then round(d::double / (f + d), 4) else 0 end as estimated_pdp,
 round(s, 4) as sprt_stat, round({HIGH}, 4) as upper_threshold, rn as observation_count
 from gw qualify row_number() over (partition by gateway_id order by rn desc) = 1""", SPRT)

# ---- trust and protocols ----
TRUST = """tr as (select source_ip, event_id, ts_us, case predicted_label when 'malicious' then -250000 when 'suspicious' then -100000 else 20000 end as m,
 row_number() over (partition by source_ip order by ts_us, event_id) as rn from detections),
tw as (select source_ip, event_id, rn, greatest(0, least(1000000, 700000 + m)) as x from tr where rn = 1
 union all select r.source_ip, r.event_id, r.rn, greatest(0, least(1000000, w.x + r.m)) from tw w join tr r on r.source_ip = w.source_ip and r.rn = w.rn + 1),
ts as (select source_ip, x / 1000000.0::double as score from tw qualify row_number() over (partition by source_ip order by rn desc) = 1),
users as (select distinct e.user_id, l.source_ip from events e join log_events l on e.event_id = l.event_id),
pairs as (select a.source_ip as src, b.source_ip as dst from users a join users b on b.user_id = xor(a.user_id, 1) where a.source_ip <> b.source_ip),
edges as (select src, dst from pairs union select dst, src from pairs),
clusters as (select source_ip, 'c' || (min(user_id) % 5)::varchar as cluster_id from users group by 1),
nodes as (select ts.source_ip as ip, ts.score, c.cluster_id from ts join clusters c on ts.source_ip = c.source_ip)"""
oracle("trust_scores", ["detections"], "select source_ip, round(score, 6) as score from ts", TRUST)
oracle("trust_path", ["detections"], "select source_ip, event_id, round(x / 1000000.0::double, 6) as score from tw", TRUST)
oracle("trust_round", ["detections"], """select n.ip, round(case when p.push is null then n.score else greatest(0, n.score - p.push) end, 6) as score from nodes n
 left join (select e.dst, sum((0.7::double - s.score) * 0.3::double) as push from edges e join nodes s on e.src = s.ip where s.score < 0.7::double group by 1) p on p.dst = n.ip""", TRUST)
oracle("trust_cluster_round", ["detections"], """select n.ip, round(case when p.push is null then n.score else greatest(0, n.score - p.push) end, 6) as score from nodes n
 left join (select e.dst, sum((0.7::double - s.score) * case when s.cluster_id = t.cluster_id then 0.4::double else 0.1::double end) as push
  from edges e join nodes s on e.src = s.ip join nodes t on e.dst = t.ip where s.score < 0.7::double group by 1) p on p.dst = n.ip""", TRUST)
oracle("severity_multiplier", ["detections"], """select d.event_id, case when t.score < 0.3::double then 1.5::double when t.score > 0.7::double then 0.8::double else 1.0::double end as multiplier
 from detections d join ts t on d.source_ip = t.source_ip""", TRUST)
oracle("trust_snapshot", ["detections"], """select t.source_ip, round(t.score, 4) as score, c.malicious_count, c.suspicious_count, c.benign_count, c.last_updated_us, k.cluster_id
 from ts t join (select source_ip, count(*) filter (predicted_label = 'malicious') as malicious_count, count(*) filter (predicted_label = 'suspicious') as suspicious_count,
  count(*) filter (predicted_label = 'benign') as benign_count, max(ts_us) as last_updated_us from detections group by 1) c on c.source_ip = t.source_ip
 left join clusters k on k.source_ip = t.source_ip""", TRUST)
oracle("live_trust_records", ["detections"], """select t.source_ip, round(t.score, 4) as score from ts t join (select source_ip, max(ts_us) as m from detections group by 1) l
 on l.source_ip = t.source_ip where 1720000800000000 + 5118500000 - l.m <= 3600000000""", TRUST)
from ..operators.protocol import DEFAULT_TRANSITIONS  # noqa: E402

EDGE_ROWS = ", ".join(f"({lit(p)}, {lit(a)}, {lit(b)})" for p, a, b in DEFAULT_TRANSITIONS)
oracle("protocol_violations", ["protocol_messages"],
       """select source_ip, protocol, event_id, from_state, to_state,
 'Invalid ' || upper(protocol) || ' transition ' || from_state || ' → ' || to_state || ' from ' || source_ip as message from pw where bad""",
       f"""pe(protocol, a, b) as (values {EDGE_ROWS}),
pr as (select source_ip, protocol, event_id, upper(event_state) as cur, upper(next_state) as nxt, row_number() over (partition by source_ip, protocol order by ts_us, event_id) as rn from protocol_messages),
pw as (select source_ip, protocol, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(null as varchar) as state, cast(null as varchar) as from_state, cast(null as varchar) as to_state, false as bad from pr where rn = 1
 union all select r.source_ip, r.protocol, r.rn, r.event_id,
  case when r.nxt is null then r.cur when k.protocol is not null and e.a is null then w.state else r.nxt end,
  coalesce(w.state, r.cur), r.nxt, r.nxt is not null and k.protocol is not null and e.a is null
 from pw w join pr r on r.source_ip = w.source_ip and r.protocol = w.protocol and r.rn = w.rn + 1
 left join (select distinct protocol from pe) k on k.protocol = r.protocol
 left join pe e on e.protocol = r.protocol and e.a = coalesce(w.state, r.cur) and e.b = r.nxt)""")

# ---- votes and fusion ----
VOTES = """kept as (select * from detections where predicted_label <> 'benign' and confidence >= 0.75),
cut as (select max(ts_us) - 300000000 as t from detections),
sv as (select source_ip, sniffer_id, case when max(case when predicted_label = 'malicious' then 1 else 0 end) = 1 then 'malicious' else 'suspicious' end as vote
 from kept where ts_us >= (select t from cut) group by all),
cc as (select source_ip, count(*) filter (vote = 'malicious') as malicious_votes, count(*) filter (vote = 'suspicious') as suspicious_votes, count(*) as total from sv group by 1),
cv as (select *, case when malicious_votes::double / total >= 0.6 then 'malicious' when (malicious_votes + suspicious_votes)::double / total >= 0.6 then 'suspicious' end as verdict from cc)"""
oracle("sniffer_votes", ["detections"], "select * from sv", VOTES)
oracle("sniffer_consensus", ["detections"], "select * from cv", VOTES)
oracle("registered_consensus", ["detections"], """select source_ip, r.k as total, case when malicious_votes::double / r.k >= 0.6 then 'malicious'
 when (malicious_votes + suspicious_votes)::double / r.k >= 0.6 then 'suspicious' end as verdict
 from cc, (select count(distinct sniffer_id) as k from detections) r""", VOTES)
oracle("active_threats", ["detections"], """select v.source_ip, v.verdict, k.sniffer_count, k.cci_count, k.latest_ts_us from cv v join
 (select source_ip, count(distinct sniffer_id) as sniffer_count, count(*) filter (ts_us >= (select t from cut)) as cci_count,
  max(ts_us) filter (ts_us >= (select t from cut)) as latest_ts_us from kept group by 1) k on k.source_ip = v.source_ip where v.verdict is not null""", VOTES)
FUSED = DET + """,
near as (select d.event_id, max(m.ts_us) as motion_ts_us from det d join motion m on m.ts_us between d.ts_us - 30000000 and d.ts_us group by 1),
fu as (select d.*, n.motion_ts_us, n.motion_ts_us is not null and predicted_label <> 'benign' as physical_motion_detected from det d left join near n on d.event_id = n.event_id),
fe as (select *, case when not physical_motion_detected then severity when severity = 'low' then 'medium' when severity = 'medium' then 'high' else 'critical' end as effective_severity from fu),
fz as (select *, effective_severity = 'critical' or predicted_label = 'malicious' as camera_recording_started, effective_severity = 'critical' and motion_ts_us is not null as gsm_alert_sent from fe)"""
oracle("motion_fusion", ["detections", "motion"], """select event_id, motion_ts_us, physical_motion_detected, effective_severity, camera_recording_started, gsm_alert_sent,
 concat_ws(',', case when physical_motion_detected then 'physical_motion_corroborated' end, case when camera_recording_started then 'camera_recording_started' end,
 case when gsm_alert_sent then 'gsm_alert_sent' end) as extra_flags from fz""", FUSED)
oracle("motion_notices", ["detections", "motion"], """select event_id, ts_us, '[IDS CRITICAL] ' || upper(predicted_label) || ' from ' || source_ip || ' on ' || hostname ||
 '. Physical motion also detected. Conf=' || printf('%.2f', confidence) as sms from fz where gsm_alert_sent""", FUSED)
oracle("recording_sessions", ["detections", "motion"], """select min(ts_us) as start_us, max(ts_us) + 120000000 as end_us, count(*) as starts from
 (select ts_us, sum(o) over (order by ts_us, event_id) as s from (select ts_us, event_id, case when ts_us - lag(ts_us) over (order by ts_us, event_id) > 120000000 then 1 else 0 end as o
  from fz where camera_recording_started)) group by s""", FUSED)

# ---- learned signatures ----
GENES = """raw as (select vec_id, label, unnest(range(0, 64)) as bit, unnest(embedding) as x from embeddings),
bits as (select vec_id, label, bit from raw where x > 0),
sizes as (select vec_id, label, count(*) as n from bits group by all),
aff as (select a.vec_id as antigen_id, a.label as antigen_label, g.vec_id, s.label, count(*)::double / any_value(s.n) as affinity
 from bits g join bits a on a.bit = g.bit join sizes s on s.vec_id = g.vec_id where g.label >= 5 group by all)"""
oracle("immune_screen", [], """select antigen_id, vec_id::varchar as detector_id, round(affinity, 6) as affinity from aff
 where antigen_label < 5 and affinity >= 0.65""", GENES)
oracle("negative_selection", [], """select vec_id::varchar as detector_id, label from sizes where label >= 5
 and vec_id not in (select vec_id from aff where antigen_label < 5 and affinity >= 0.75)""", GENES)
MEMORY = GENES + """,
hits as (select *, row_number() over (partition by vec_id order by antigen_id) as r, count(*) over (partition by vec_id) as n from aff where antigen_label >= 5 and affinity >= 0.75),
memory as (select vec_id::varchar as detector_id, label, n as activation_count, antigen_id as promoted_by from hits where r = 3)"""
oracle("immune_promotion", [], "select * from memory", MEMORY)
oracle("immune_stats", [], """select 'self' as kind, 'all' as name, count(*) as n from embeddings where label < 5
 union all select 'candidate', 'all', (select count(*) from embeddings where label >= 5) - (select count(*) from memory)
 union all select 'memory', 'all', count(*) from memory
 union all select 'memory_label', label::varchar, count(*) from memory group by label""", MEMORY)
ANTIGENS = """ag as (select *, regexp_extract_all(lower('service=' || service || ' host=' || hostname || ' ip=' || source_ip || ' message=' || message), '\\b\\w\\w+\\b') as w from detections),
ab as (select event_id, predicted_label, list_sort(list_distinct(list_transform(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
 lambda t: ('0x' || substr(md5(t), 1, 6))::int % 512))) as bits from ag)"""
oracle("antigen_bits", ["detections"], """select event_id, len(bits)::int as set_bits, array_to_string(bits, ',') as bits from ab""", ANTIGENS)
oracle("immune_screen_events", ["detections"], """select event_id as antigen_id, matches, round(best, 6) as best from ab join totals using (bits)""", ANTIGENS + """,
pat as (select bits, row_number() over (order by bits) as a from (select distinct bits from ab)),
gen as (select bits, len(bits) as n, row_number() over (order by bits) as g from (select distinct bits from ab where predicted_label = 'malicious')),
hit as (select a, g, count(*)::double / any_value(n) as affinity from (select a, unnest(bits) as b from pat) x
 join (select g, n, unnest(bits) as b from gen) y using (b) group by a, g having count(*)::double / any_value(n) >= 0.65::double),
totals as (select bits, count(*) as matches, max(affinity) as best from hit join pat using (a) group by bits)""")
GENERATED = GENES + """,
seeds as (select distinct vec_id, label, v as variant, 'w|' || vec_id::varchar || '|' || v::varchar as seed from sizes, (values (1), (2), (3)) t(v) where label >= 5),
noise as (select s.vec_id, s.variant, b.bit from seeds s, (select unnest(range(0, 64)) as bit) b
 where substring(md5(seed || '|0') || md5(seed || '|1'), b.bit::int + 1, 1) < '4'),
gene as (select vec_id, variant, bit from noise union select s.vec_id, s.variant, b.bit from seeds s join bits b on b.vec_id = s.vec_id),
gen as (select vec_id as seed_id, variant, substring(sha256(string_agg(bit::varchar, ',' order by bit)), 1, 16) as detector_id, count(*) as set_bits from gene group by all)"""
oracle("detector_generation", [], "select seed_id, variant::int as variant, detector_id, set_bits from gen", GENERATED)
oracle("learned_detectors", [], """select seed_id, variant::int as variant, detector_id from gen where (seed_id, variant) not in
 (select g.vec_id, g.variant from gene g join bits a on a.bit = g.bit and a.label < 5 join gen n on n.seed_id = g.vec_id and n.variant = g.variant
  group by g.vec_id, g.variant, a.vec_id having count(*)::double / any_value(n.set_bits) >= 0.75)""", GENERATED)

# ---- evaluation ----
EVAL = """cl as (select y_true as c from eval_pairs union select y_pred from eval_pairs),
per as (select c as label, (select count(*) from eval_pairs where y_true = c and y_pred = c) as tp, (select count(*) from eval_pairs where y_pred = c and y_true <> c) as fp,
 (select count(*) from eval_pairs where y_true = c and y_pred <> c) as fn, (select count(*) from eval_pairs) as n from cl),
pr as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as r from per),
sc as (select label, p, r, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1, tp + fn as support, case when n - tp - fn > 0 then fp::double / (n - tp - fn) else 0 end as fpr,
 case when fn + tp > 0 then fn::double / (fn + tp) else 0 end as fnr from pr)"""
oracle("confusion", ["eval_pairs"], """select t.c as y_true, p.c as y_pred, count(e.doc_id) as n from cl t cross join cl p
 left join eval_pairs e on e.y_true = t.c and e.y_pred = p.c group by all""", EVAL)
oracle("class_metrics", ["eval_pairs"], """select label, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, support, round(fpr, 6) as fpr, round(fnr, 6) as fnr from sc""", EVAL)
oracle("overall_metrics", ["eval_pairs"], """select round((select avg((y_true = y_pred)::int) from eval_pairs), 6) as accuracy, round(avg(f1), 6) as macro_f1,
 round(sum(f1 * support) / sum(support), 6) as weighted_f1 from sc""", EVAL)
oracle("latency", [], """select count(value) as count, round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, round(quantile_cont(value, 0.99), 6) as p99_ms,
 round(max(value), 6) as max_ms from events""")
LAYER_ROWS = ", ".join(f"({lit(s)}, {x})" for s, xs in V.LAYERS.items() for x in xs)
oracle("interaction", ["log_events"], """select count(distinct layer) / 4.0::double as interaction_ability_score, string_agg(distinct layer::varchar, ',' order by layer::varchar) as layers
 from log_events join lm on lm.s = lower(service)""", f"lm(s, layer) as (values {LAYER_ROWS})")

# ---- class balance, hybrid model ----
PLACED = """emb as (select vec_id as id, label::bigint as grp, case when label < 5 then 'benign' else 'malicious' end as label, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings),
cen as (select grp as cluster, i, avg(x) as m from emb group by all),
dist as (select e.id, any_value(e.label) as label, c.cluster, sqrt(sum((e.x - c.m) ** 2)) as d from emb e join cen c on c.i = e.i group by e.id, c.cluster),
placed as (select * from dist qualify row_number() over (partition by id order by d, cluster) = 1),
zones as (select cluster, avg((label = 'benign')::int) as benign_fraction, count(*) as members from placed group by 1 having avg((label = 'benign')::int) >= 0.55)"""
oracle("safe_zones", [], "select cluster, round(benign_fraction, 6) as benign_fraction, members from zones", PLACED)
oracle("hybrid_stage1", [], """select id, p.cluster, 'benign' as predicted_label, round(greatest(0.80, least(0.99, 0.99::double - d * 0.02::double)), 6) as confidence
 from placed p join zones z on z.cluster = p.cluster""", PLACED)
SMOTE = """rows as (select vec_id as id, case when label < 6 then 'benign' when label < 9 then 'suspicious' else 'malicious' end as label, embedding::double[] as v from embeddings),
cnt as (select label, count(*) as n from rows group by 1),
agg as (select *, max(n) over () as mx, min(n) over () as mn, count(*) over () as c from cnt),
plan as (select label, n, greatest(n, greatest(mn, cast(floor(mx * 0.5) as bigint))) as target, least(5, mn - 1) as k from agg where c >= 2 and mn >= 10 and n < mx),
nn as (select a.id, a.label, b.id as neighbour_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))) as distance from rows a join rows b on a.label = b.label and a.id <> b.id),
ranked as (select *, row_number() over (partition by id order by distance, neighbour_id) as rank from nn)"""
# Oversampling needs neighbours only in the classes that get copies.
COPIED = SMOTE.replace("a.label = b.label and", "a.label = b.label and a.label in (select label from plan where target > n) and")
oracle("smote_plan", [], "select * from plan", SMOTE)
oracle("nearest_same_class", [], "select id, neighbour_id, rank, round(distance, 6) as distance from ranked where rank <= 3", SMOTE)
oracle("smote_rows", [], """select j.label, j.id as base_id, r.neighbour_id, j.copy, round(u.u, 6) as u, round(a.v[1] + u.u * (b.v[1] - a.v[1]), 6) as first,
 round(list_sum(a.v) + u.u * (list_sum(b.v) - list_sum(a.v)), 5) as total
 from jobs j join ranked r on r.id = j.id and r.rank = j.copy % j.k + 1 join rows a on a.id = j.id join rows b on b.id = r.neighbour_id
 join us u on u.id = j.id and u.neighbour_id = r.neighbour_id and u.copy = j.copy""", COPIED + """,
dealt as (select r.id, r.label, p.n, p.k, p.target - p.n as need, row_number() over (partition by r.label order by r.id) - 1 as rk from rows r join plan p on p.label = r.label where p.target > p.n),
jobs as (select id, label, k, unnest(range(0, need // n + case when rk < need % n then 1 else 0 end)) as copy from dealt),
us as (select j.id, r.neighbour_id, j.copy, ('0x' || substring(md5(j.id::varchar || '|' || r.neighbour_id::varchar || '|' || j.copy::varchar), 1, 6))::bigint / 16777216.0::double as u
 from jobs j join ranked r on r.id = j.id and r.rank = j.copy % j.k + 1)""")

# ---- sources ----
oracle("text_log_events", ["log_events"], """select event_id, 'unknown' as source_ip, 'log_host' as hostname, 'log' as service, trim(message) as message from log_events where trim(message) <> ''""")
oracle("packets_to_events", ["log_events"], r"""select event_id, source_ip, 'pcap_host' as hostname, case when service in ('tcp', 'udp') then service else 'unknown' end as service, m as message from
 (select *, concat_ws(' ', 'dst_ip=' || nullif(regexp_extract(message, 'dst_ip=(\S+)', 1), ''), 'ip_proto=' || nullif(regexp_extract(message, 'ip_proto=(\d+)', 1), ''),
  case when service in ('tcp', 'udp') then 'src_port=' || nullif(regexp_extract(message, 'src_port=(\d+)', 1), '') end,
  case when service in ('tcp', 'udp') then 'dst_port=' || nullif(regexp_extract(message, 'dst_port=(\d+)', 1), '') end,
  case when service = 'tcp' then 'tcp_flags=' || nullif(regexp_extract(message, 'tcp_flags=(\S+)', 1), '') end,
  'payload=' || repeat('filler ', 40) || nullif(regexp_extract(message, 'payload=(.+)', 1), '')) as m from log_events) where m <> ''""")
oracle("ingest_events", ["log_events"], "select event_id, round(timestamp, 6) as timestamp, source_ip, hostname, service, message from log_events")
TRAIN = """tr as (select d.text, e.y_true as label, d.source as source_ip, 'unknown' as hostname, 'unknown' as service, lower(d.text) as m from documents d join eval_pairs e on e.doc_id = d.doc_id)"""
oracle("training_rows", ["eval_pairs"], "select text, label, source_ip, hostname, service from tr", TRAIN)
oracle("row_text", ["eval_pairs"], f"""select label, 'service=' || service || ' host=' || hostname || ' ip=' || source_ip || ' message=' || text || ' flags=' || {flags_joined(' ')} as text from tr""", TRAIN)
oracle("class_distribution", ["eval_pairs"], "select label, count(*) as n, cast(sum(count(*)) over () as bigint) as total from tr group by label", TRAIN)
oracle("dataset_profile", ["eval_pairs"], """select c.source, c.rows, 3::bigint as n_columns, l.labels, least(c.rows, 5) as samples, s.first_text, s.last_n_chars
 from (select source, count(*) as rows from documents group by 1) c
 join (select source, string_agg(label || '=' || n::varchar, ',' order by label) as labels from
  (select d.source, coalesce(e.y_true, 'unknown') as label, count(*) as n from documents d left join eval_pairs e on e.doc_id = d.doc_id group by all) group by 1) l on l.source = c.source
 join (select source, max(case when r = 1 then case when length(text) > 120 then substring(text, 1, 117) || '...' else text end end) as first_text,
  max(case when r = least(m, 5) then n_chars::varchar end) as last_n_chars from
  (select *, row_number() over (partition by source order by doc_id) as r, count(*) over (partition by source) as m from documents) group by 1) s on s.source = c.source""")

oracle("paired_rows", [], "select row_number() over (order by event_id) - 1 as row_idx, event_id, event_type, user_id from events")
oracle("live_sources", ["log_events"], """select source_ip, count(*) as events from log_events group by 1
 having 1720000800000000 + 1520000000 - max(ts_us) <= 1500000""")

# ---- streams: the same answers as their batch twins ----
SQL["stream_dedup"] = SQL["dedup_anchors"]
SQL["stream_brute_force"] = SQL["cep_brute_force"]
SQL["stream_login_after_scan"] = SQL["cep_login_after_scan"]
SQL["stream_flood"] = SQL["dos_flood"]
SQL["stream_gateway_sprt"] = SQL["gateway_sprt"]
SQL["stream_trust_path"] = SQL["trust_path"]
SQL["stream_protocol_violations"] = f"select * exclude (message) from ({SQL['protocol_violations']})"
SQL["stream_motion"] = f"select event_id, motion_ts_us from ({SQL['motion_fusion']})"
for q, twin in (("stream_port_scan", "cep_port_scan"), ("stream_lateral", "cep_lateral"), ("stream_exfil", "cep_exfil"),
                ("stream_sessions", "recording_sessions"), ("stream_alerts", "stored_alerts")):
    SQL[q] = SQL[twin]
oracle("stream_ticks", ["log_events"], """select source_ip, cast(floor(ts_us / 60000000) as bigint) as tick, count(*) as packet_count
 from log_events group by all""")
oracle("stream_blackhole", ["log_events"], """select source_ip, tick, packet_count, round(mean - std, 6) as threshold from base
 where points >= 5 and std > 0 and packet_count < mean - std""",
       """ticks as (select source_ip, cast(floor(ts_us / 60000000) as bigint) as tick, count(*) as packet_count from log_events group by all),
base as (select *, count(*) over w as points, avg(packet_count) over w as mean,
 case when count(*) over w >= 2 then stddev_samp(packet_count) over w else 0 end as std from ticks
 window w as (partition by source_ip order by tick rows between 60 preceding and 1 preceding))""")
oracle("stream_consensus", ["detections"], """select start_us, source_ip, malicious_votes, suspicious_votes,
 case when malicious_votes::double / (malicious_votes + suspicious_votes) >= 0.6 then 'malicious' else 'suspicious' end as verdict
 from (select start_us, source_ip, count(*) filter (bad) as malicious_votes, count(*) filter (not bad) as suspicious_votes from per group by all)""",
       """sent as (select *, unnest(range(0, 10)) as k from detections where predicted_label <> 'benign' and confidence >= 0.75),
per as (select (cast(floor(ts_us / 30000000) as bigint) - k) * 30000000 as start_us, source_ip, sniffer_id, bool_or(predicted_label = 'malicious') as bad from sent group by all)""")

CSV = """said as (select event_id, source_ip, hostname, service, message || chr(10) || '"' || hostname || '", ' || service as message, predicted_label as label from detections),
single as (select message as text, label, source_ip, hostname, service from said),
paired as (select 'number=' || event_id || ' source_ip=' || source_ip || ' note=' || message as text,
 case when label = 'benign' then 'benign' else 'malicious' end as label, source_ip, 'unknown' as hostname, 'unknown' as service from said)"""
oracle("labeled_csv", ["detections"], "select * from single", CSV)
oracle("paired_csv", ["detections"], "select * from paired", CSV)
oracle("training_sources", ["detections"], "select * from single union all select * from paired", CSV)


def _spread(weight):
    """Every event in order, with the scores of its whole component as a list; `weight` of an edge e between n and m."""
    return TRUST + f""",
everyone as (select source_ip as ip from detections union select src from edges),
reach as (select ip as a, ip as b from everyone union select r.a, e.dst from reach r join edges e on e.src = r.b),
node as (select a as ip, min(b) as root from reach group by a),
placed as (select n.*, c.cluster_id, row_number() over (partition by root order by n.ip) as k from node n left join clusters c on c.source_ip = n.ip),
near as (select n.root, n.k, list(case when e.src is null then 0::double else {weight} end order by m.k) as ws
 from placed n join placed m on m.root = n.root left join edges e on e.src = n.ip and e.dst = m.ip group by n.root, n.k),
moves as (select d.event_id, n.root, n.k, n.ip, case predicted_label when 'malicious' then -0.25::double when 'suspicious' then -0.1::double else 0.02::double end as move,
 row_number() over (partition by n.root order by d.ts_us, d.event_id) as rn from detections d join placed n on n.ip = d.source_ip),
walk as (select root, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(null as varchar) as ip, cast(null as double) as x,
  list(0.7::double order by k) as scores from placed group by root
 union all select root, rn, event_id, ip, x, list_transform(range(1, len(scores) + 1), lambda i:
   case when i = k then x else greatest(0::double, scores[i] - greatest(0::double, 0.7::double - x) * ws[i]) end)
 from (select w.root, m.rn, m.event_id, m.ip, m.k, w.scores, n.ws, least(1::double, greatest(0::double, w.scores[m.k] + m.move)) as x
  from walk w join moves m on m.root = w.root and m.rn = w.rn + 1 join near n on n.root = m.root and n.k = m.k))"""


oracle("trust_neighbours", ["detections"], """select p.ip, round(w.scores[p.k], 6) as score from placed p
 join (select root, arg_max(scores, rn) as scores from walk group by root) w on w.root = p.root""", _spread("0.3::double"))
oracle("trust_neighbours_path", ["detections"], "select ip as source_ip, event_id, round(x, 6) as score from walk where event_id is not null",
       _spread("case when n.cluster_id = m.cluster_id then 0.4::double else 0.1::double end"))
oracle("stream_amof", ["log_events"], "select node as source_ip, tick, min(tick) over (partition by node) as first_anomalous_tick from sa where bad",
       """node_ticks as (select source_ip as node, cast(floor(ts_us / 5000000) as bigint) as tick, count(*) as packet_count from log_events group by all),
""" + SLOPES.replace("0.25", "0.2537"))
oracle("stream_late_rows", ["log_events"], """select operator, count(*) as late from log_events, top,
 (values ('patterns', 600000000::bigint), ('ticks', 0::bigint)) as o(operator, delay) where event_id % 50 = 0 and ts_us <= top_us // 1000 * 1000 - delay group by operator""",
       "top as (select max(ts_us) as top_us from log_events where event_id % 50 <> 0)")
oracle("strict_sequence", ["log_events"], "select source_ip, event_id, ts_us, matched_count from a_takeover",
       COUNTS.replace(frame(120), frame(300)) + ",\n" + pattern_ctes("port_scan", 5) + ",\n" + pattern_ctes("lateral_movement", 4) + """,
q_takeover as (select c.source_ip, c.event_id, c.ts_us, c.logins as matched_count from counted c where c.logins >= 1 and exists (
  select 1 from a_port_scan s join a_lateral_movement m on s.source_ip = m.source_ip and s.ts_us < m.ts_us
  where s.source_ip = c.source_ip and m.ts_us < c.ts_us and c.ts_us - s.ts_us <= 300000000)),
""" + thin("a_takeover", "q_takeover", ["source_ip"], COOLDOWN, "matched_count"))
