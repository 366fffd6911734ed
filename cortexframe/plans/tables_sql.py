"""The adapters' tables as SQL, for the queries' oracles."""

SIG_E = """ev as (
  select cast(user_id as varchar) recording_id, event_type, value,
         row_number() over (partition by user_id order by event_id) sample_idx from events),
sig as (select recording_id, sample_idx, (sample_idx - 1) / 64.0 t, cast(value as double) value from ev),
len as (select recording_id, max(sample_idx) n from ev group by 1)"""

STATUS = """st as (
  select recording_id, sample_idx, case event_type when 'click' then 1 when 'purchase' then 2 when 'signup' then 255
         when 'error' then 65539 else 0 end raw from ev)"""

DECODED = (
    SIG_E
    + ", "
    + STATUS
    + """, coded as (
  select recording_id, sample_idx, raw & 65535 code, lag(raw & 65535) over (partition by recording_id order by sample_idx) prev from st),
trg as (
  select recording_id, row_number() over (partition by recording_id order by sample_idx) event_seq, sample_idx onset,
         (sample_idx - 1) / 64.0 onset_time, cast(code as bigint) "type" from coded where code <> 0 and prev is not null and code <> prev)"""
)

#: raw triggers: every sample is an event with its unmasked code
RAW = (
    SIG_E
    + ", "
    + STATUS
    + """, raw_events as (
  select recording_id, sample_idx event_seq, sample_idx onset, (sample_idx - 1) / 64.0 onset_time, raw "type" from st)"""
)

SIG_L = """li as (
  select cast(l_suppkey as varchar) recording_id, l_quantity, l_extendedprice, l_discount, l_tax,
         row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_shipdate, l_linenumber) sample_idx from lineitem),
sig as (
  select recording_id, 1 ch_idx, 'Cz' channel, sample_idx, cast(l_quantity as double) value from li
  union all select recording_id, 2, 'Pz', sample_idx, cast(l_extendedprice as double) from li
  union all select recording_id, 3, 'Oz', sample_idx, cast(l_discount as double) from li
  union all select recording_id, 4, 'EXG1', sample_idx, cast(l_tax as double) from li)"""

EMB = """emb as (
  select vec_id epoch_id, label "type", unnest(range(len(embedding))) rel_idx, cast(unnest(embedding) as double) value from embeddings)"""


def values(rows: list[tuple], name: str, columns: str) -> str:
    """A CTE of literal rows."""

    def one(v) -> str:
        return "null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) if isinstance(v, int) else f"cast('{v!r}' as double)"

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) as (values {body})"
