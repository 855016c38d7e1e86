"""The fixture views as SQL text (FIXTURES.md part B), for oracle queries.

Each block runs unchanged in Spark SQL and DuckDB. Oracles inline them as CTEs
because only the base tables are registered on the oracle side.
"""

INCIDENTS = """incidents as (
select event_id as id,
  concat('HZ', lpad(cast(event_id as string), 6, '0')) as case_number,
  ts as date,
  case event_type when 'error' then 'BATTERY' else 'THEFT' end as primary_type,
  case event_type when 'click' then 'POCKET-PICKING' when 'view' then 'ATTEMPT POCKET-PICKING'
    when 'purchase' then 'PURSE-SNATCHING' when 'signup' then 'FROM BUILDING' else 'SIMPLE' end as description,
  case when value >= 150 then 'true' else 'false' end as arrest,
  case when event_id % 97 = 0 then null else cast(41.6 as double)
    + cast((user_id * 37) % 400 as double) / 1000 + cast(event_id % 10 as double) / 10000 end as latitude,
  case when event_id % 97 = 0 then null else cast(-87.9 as double)
    + cast((user_id * 53) % 400 as double) / 1000 + cast(event_id % 7 as double) / 10000 end as longitude,
  case event_id % 11 when 0 then 'STREET' when 1 then 'CTA PLATFORM' when 2 then 'RESIDENCE' when 3 then 'RESTAURANT'
    when 4 then 'GROCERY' when 5 then 'CTA BUS' when 6 then 'SIDEWALK' when 7 then 'APARTMENT'
    when 8 then 'BAR OR TAVERN' when 9 then 'WAREHOUSE' else null end as location_description,
  cast(1 + user_id % 25 as int) as district,
  cast(1 + user_id % 77 as int) as community_area
from events)"""

INCIDENT_LOG = """incident_log as (
select o_orderkey as id, o_orderpriority as series, cast(o_orderdate as date) as date
from orders)"""

GAPPED_LOG = """gapped_log as (
select * from incident_log
where not (series = '1-URGENT' and month(date) = 7))"""

SCORED = """scored as (
select id, label, score, case when score > cast(0.2 as double) then 1 else 0 end as pred, hour, district
from (select id, case arrest when 'true' then 1 else 0 end as label,
        cast((id * 7919) % 1000 + (case arrest when 'true' then 300 else 0 end) as double) / 1300 as score,
        cast(hour(date) as int) as hour, district
      from incidents) t)"""

FORECASTS = """fc_w as (
  select series, cast(date_trunc('week', date) + interval 6 day as date) as period_end, count(*) as n
  from incident_log group by 1, 2),
fc_p as (
  select series, period_end, cast(n as double) as actual,
    cast(lag(n, 1) over (partition by series order by period_end) as double) as p1,
    cast(lag(n, 4) over (partition by series order by period_end) as double) as p4
  from fc_w),
forecasts as (
select 'lag1' as model, series, period_end, actual, p1 as predicted from fc_p where p1 is not null
union all
select 'lag4' as model, series, period_end, actual, p4 as predicted from fc_p where p4 is not null)"""

_DEPS = {"incidents": [], "incident_log": [], "scored": ["incidents"], "forecasts": ["incident_log"], "gapped_log": ["incident_log"]}
_TEXT = {"incidents": INCIDENTS, "incident_log": INCIDENT_LOG, "scored": SCORED, "forecasts": FORECASTS, "gapped_log": GAPPED_LOG}


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named views (and what they depend on)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(_TEXT[n] for n in order) + "\n"
