"""The arrivals table derived from the driver's ``events`` table.

Every event becomes one payload; some are delivered again unchanged, and some get a
later delivery that fills in the cost.  From the cutoff on, one provider's payloads
carry their cost in a new place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, spread
from ..sources.arrivals import as_arrivals

RECIPE = """
with base as (
 select event_id, ts, user_id,
   case event_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'cursor' end provider,
   40 + user_id*5 tin, 12 + cast(floor(value) as bigint) tout,
   concat('0.', lpad(cast(1000 + cast(round(value*100) as bigint) as {text}), 6, '0')) cost,
   {iso} iso, {epoch} ep
 from {events}),
arr as ({deliveries})
select seq, ts as received_at, provider, case
 when provider='openai' then concat(
   '{{"id":"oa_',cast(event_id as {text}),'","object":"',
   case when event_id % 5 = 0 then 'text.completion' else 'chat.completion' end,
   '","created":',cast(ep as {text}),
   ',"model":',case when event_id % 997 = 0 then '404'
                    else concat('"gpt-',cast(event_id % 2 as {text}),'"') end,
   ',"user":"u_',cast(user_id as {text}),
   '","usage":{{"prompt_tokens":',cast(tin as {text}),',"completion_tokens":',cast(tout as {text}),'}},',
   case when ts >= timestamp '2024-01-28 12:00:00'
          then concat('"pricing":{{"cost":{{"amount_usd":',cost,'}}}}}}')
        when event_id % 47 = 0 and kind < 2 then '"cost":{{"amount_usd":null}}}}'
        else concat('"cost":{{"amount_usd":',cost,'}}}}') end)
 when provider='anthropic' then concat(
   '{{"id":"an_',cast(event_id as {text}),'","type":"message","model":"claude-',cast(event_id % 2 as {text}),
   '","created_at":"',iso,'","usage":{{"input_tokens":',cast(tin as {text}),',"output_tokens":',
   cast(tout as {text}),'}},"metadata":{{"user_id":"u_',cast(user_id as {text}),'"}},"cost_usd":',cost,'}}')
 else concat(
   '{{"request_id":"cu_',cast(event_id as {text}),'","kind":"edit","model":"cursor-',cast(event_id % 2 as {text}),
   '","timestamp":"',iso,'","tokens":{{"in":',cast(tin as {text}),',"out":',cast(tout as {text}),
   '}},"user":{{"id":"u_',cast(user_id as {text}),'"}},"billing":{{"usd":',cost,'}}}}')
 end payload from arr
"""


# One branch per kind of delivery reads the events three times.
DELIVERIES = """
 select *, 0 kind, event_id*10 seq from base
 union all
 select *, 1 kind, event_id*10+5 seq from base where event_id % 31 = 0
 union all
 select *, 2 kind, event_id*10+7 seq from base
  where event_id % 47 = 0 and event_id % 3 = 0 and ts < timestamp '2024-01-28 12:00:00'"""

# The same rows from one read: each event with its kinds of delivery.
DELIVERIES_AT_ONCE = """
 select * except (kinds), event_id*10 + case kind when 1 then 5 when 2 then 7 else 0 end seq
 from (select *, explode(kinds) kind from (select *, case
   when event_id % 31 = 0 and again then array(0, 1, 2) when event_id % 31 = 0 then array(0, 1)
   when again then array(0, 2) else array(0) end kinds
  from (select *, event_id % 47 = 0 and event_id % 3 = 0 and ts < timestamp '2024-01-28 12:00:00' again from base)))"""


def duckdb_recipe() -> str:
    return RECIPE.format(
        text="varchar",
        iso="strftime(ts,'%Y-%m-%dT%H:%M:%S.%gZ')",
        epoch="cast(floor(epoch(ts)) as bigint)",
        events="events",
        deliveries=DELIVERIES,
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the events, dealt as events: these are a sixth of the size of what is made of them."""
    prepare(spark)
    text = RECIPE.format(
        text="string",
        iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
        epoch="unix_timestamp(ts)",
        events="{source}",
        deliveries=DELIVERIES_AT_ONCE,
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    return as_arrivals(spark.sql(_escape(text), source=spread(events, "event_id")))


def _escape(text: str) -> str:
    """Keep the JSON braces of the recipe out of the SQL formatter's way."""
    return text.replace("{", "{{").replace("}", "}}").replace("{{source}}", "{source}")
