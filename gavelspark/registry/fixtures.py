"""Inputs shaped like moderation data, derived from the test tables.

Each is SQL that reads the same in Spark and in the checking database.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gavelspark.sources.readers import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

FIXTURES = {
    "scored": """
select label, threat, insult, obscene,
       ra/(ra+re+rr) as p_allow, re/(ra+re+rr) as p_escalate, rr/(ra+re+rr) as p_reject
from (select case l_returnflag when 'A' then 'ALLOW' when 'R' then 'REJECT' else 'ESCALATE' end as label,
             l_discount >= 0.08 as threat, l_tax >= 0.06 as insult, l_quantity >= 40 as obscene,
             cast(1 + (l_partkey*7)%40 + case when l_returnflag='A' or l_partkey%11=0 then 160 else 0 end as double) as ra,
             cast(1 + (l_suppkey*13+l_orderkey)%45 as double) as re,
             cast(1 + (l_orderkey*17+l_linenumber*5)%50 + case when l_returnflag='R' and l_partkey%11<>0 then 40 else 0 end as double) as rr
      from {lineitem}) r""",
    "scored_comments": """
select d.doc_id, d.text, cast((d.doc_id*7919)%1001 as double)/1000 as toxicity,
       cast((d.doc_id*31)%101 as double)/100 as threat, cast((d.doc_id*57)%101 as double)/100 as insult
from {documents} d""",
    "human_rows": """
select d.doc_id, d.text as user_input,
       case d.doc_id%4 when 0 then 'false' when 1 then ' True ' when 2 then '1' else 'true' end as human_annotation,
       cast(l.toxic as varchar(1)) as toxicity, '' as jailbreaking
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "votes": """
select concat(user_id, '-', cast(ts as date)) as example, event_id,
       event_type in ('view','click','signup') as is_safe,
       event_type as category_1, case when event_id%3=0 then 'extra' end as category_2
from {events}""",
    "dialogue": """
select conv_id, turn, text as prompt, response
from (select conv_id, turn, role, text,
             lead(role) over (partition by conv_id order by turn) as next_role,
             lead(text) over (partition by conv_id order by turn) as response
      from {conversations}) t
where role = 'user' and next_role = 'assistant'""",
    "taxonomy": """
select event_id,
       case event_id%3 when 0 then 'ALLOW' when 1 then 'REJECT' else 'ESCALATE' end as expected_decision,
       case (event_id*7+user_id)%3 when 0 then 'ALLOW' when 1 then 'REJECT' else 'ESCALATE' end as predicted_decision,
       case when event_id%5<>0 then event_type end as category_1,
       case when event_id%10=1 then 'second' end as category_2
from {events}""",
    "annotators": """
select o_orderkey as case_id,
       case o_orderstatus when 'F' then 'ALLOW' when 'O' then 'REJECT' else 'ESCALATE' end as decision_a,
       o_orderpriority as rule_a,
       case when o_orderkey%7=0 then 'ESCALATE' when o_orderstatus='F' then 'ALLOW' when o_orderstatus='O' then 'REJECT' else 'ESCALATE' end as decision_b,
       case when o_orderkey%11=0 then '5-LOW' else o_orderpriority end as rule_b
from {orders}""",
    "drift": """
select case when ts < timestamp '2024-01-16 00:00:00' then 'reference' else 'observed' end as population,
       case when event_type='view' and user_id%2=0 and ts >= timestamp '2024-01-16 00:00:00' then 'click' else event_type end as bin,
       count(*) as n
from {events} group by 1, 2""",
    "request_log": """
select event_id, ts, case when event_type='error' then 503 else 200 end as status, value as latency_ms,
       case event_type when 'purchase' then 'REJECT' when 'click' then 'ESCALATE' else 'ALLOW' end as decision
from {events}""",
    "review_events": """
select event_id as seq, ts, concat('c', user_id, '-', event_id%20) as case_id,
       case when event_type in ('view','click') then 'enqueue' else 'resolve' end as kind,
       case when event_type='purchase' then 'REJECT' when event_type='error' then 'ALLOW' when event_type='signup' then 'ESCALATE' end as reviewer_decision,
       concat('ref-', event_id) as content_reference, concat('m', user_id%3) as model_id,
       case when event_type='click' then 'REJECT' when event_type='view' then 'ESCALATE' end as proposed_decision
from {events}""",
    "slice_cases": """
select concat('D-', doc_id) as case_id, doc_id, source as slice_name, lang as language from {documents}""",
    "doc_rules": """
select * from (values ('en','R1',1,'beer'),('en','R1',1,'bet'),('en','R2',2,'the'),('de','R1',1,'heit'),('de','R2',2,'schein'),
                      ('fr','R1',1,'eau'),('fr','R2',2,'tion'),('es','R1',1,'ando')) as t(version, rule_id, ordinal, term)""",
}


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    used = {t: table(spark, folder, t) for t in set(re.findall(r"{(\w+)}", sql))}
    return spark.sql(sql, **used)


def cte(*names: str) -> str:
    """``with`` clause that defines fixtures for the checking SQL."""
    parts = [f"{n} as ({FIXTURES[n].format(**{t: t for t in TABLES})})" for n in names]
    return "with " + ",\n".join(parts) + "\n"
