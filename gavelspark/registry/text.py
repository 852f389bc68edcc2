"""Text and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.functions import decisions as dc
from gavelspark.functions import text as tx
from gavelspark.operators import labels as lb
from gavelspark.registry import registered
from gavelspark.registry.fixtures import cte, fixture
from gavelspark.sources.readers import table


def sql_string(value: str) -> str:
    """A SQL literal; characters outside printable ASCII by code point."""
    parts = [
        f"'{c}'" if " " < c <= "~" and c != "'" else f"chr({ord(c)})" for c in value
    ]
    return "(" + " || ".join(parts) + ")"


def sql_fold(column: str) -> str:
    for source, target in tx.CASEFOLD_EXPANSIONS.items():
        column = f"replace({column}, {sql_string(source)}, '{target}')"
    return f"lower({column})"


def sql_normal(column: str) -> str:
    return f"regexp_replace({sql_fold(column)}, '[^a-z0-9]+', '', 'g')"


SPACES = sql_string(tx.UNICODE_SPACES)


def sql_strip(column: str) -> str:
    return f"trim({column}, {SPACES})"


@registered(
    "text_normalize",
    f"""
select 'document' as kind, doc_id as id, md5({sql_normal("text || ' Stra' || chr(223) || 'e ' || chr(64257) || 'n ' || chr(7838) || ' Caf' || chr(233)")}) as digest
from documents
union all
select 'page' as kind, page_id as id, md5({sql_normal("html")}) as digest from pages""",
)
def text_normalize(spark, folder):
    marked = F.concat("text", F.lit(" Straße ﬁn ẞ Café")).alias("marked")
    documents = table(spark, folder, "documents").select("doc_id", marked).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.md5(tx.normalize("marked")).alias("digest")
    )
    pages = table(spark, folder, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.md5(tx.normalize("html")).alias("digest")
    )
    return documents.unionByName(pages)


PADDING = ("\t   \x1c", "　\n  ")


@registered(
    "text_strip",
    f"""
select doc_id, md5({sql_strip(f"{sql_string(PADDING[0])} || text || {sql_string(PADDING[1])}")}) as digest
from documents""",
)
def text_strip(spark, folder):
    padded = F.concat(F.lit(PADDING[0]), "text", F.lit(PADDING[1]))
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.strip(padded)).alias("digest"))


@registered(
    "score_decisions",
    cte("scored_comments")
    + """select doc_id, case when toxicity <= 0.1 then 'ALLOW' when toxicity >= 0.5 then 'REJECT' else 'ESCALATE' end as decision,
       case when toxicity <= 0.25 then 'ALLOW' when toxicity >= 0.75 then 'REJECT' else 'ESCALATE' end as wide_decision
from scored_comments""",
)
def score_decisions(spark, folder):
    score = F.col("toxicity")
    return fixture(spark, folder, "scored_comments").select(
        "doc_id",
        dc.score_decision(score).alias("decision"),
        dc.score_decision(score, dc.ScoreCuts(0.25, 0.75)).alias("wide_decision"),
    )


@registered(
    "content_ids",
    "select doc_id, 'doc-' || substr(sha256(text), 1, 16) as long_id, substr(sha256(text), 1, 12) as short_id from documents",
)
def content_ids(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        tx.digest_id(F.col("text"), "doc-").alias("long_id"),
        tx.digest_id(F.col("text"), digits=12).alias("short_id"),
    )


@registered(
    "comment_cases",
    cte("scored_comments")
    + f"""select 'CC-test-' || case when doc_id < 10000000 then lpad(cast(doc_id as varchar), 7, '0') else cast(doc_id as varchar) end
          || '-' || substr(sha256(content), 1, 12) as case_id,
       'civil-comments-v1' as policy_version, 'real_civil_comments' as slice_name, 'en' as language, md5(content) as content,
       decision as expected_decision,
       case when decision <> 'ALLOW' then 'P-TOX' end as expected_rule_id,
       case when decision <> 'ALLOW' then 'Remove or rewrite the toxic content.' end as expected_remediation
from (select doc_id, {sql_strip("text")} as content,
             case when toxicity <= 0.1 then 'ALLOW' when toxicity >= 0.5 then 'REJECT' else 'ESCALATE' end as decision
      from scored_comments) t""",
)
def comment_cases(spark, folder):
    cases = lb.comment_cases(fixture(spark, folder, "scored_comments"), split="test", index="doc_id")
    return cases.withColumn("content", F.md5("content")).drop("label_budget")


@registered(
    "boolean_parse",
    cte("human_rows")
    + """select doc_id, lower(trim(human_annotation)) in ('1', 'true') as human, toxicity = '1' as toxic,
       jailbreaking in ('1', 'true') as jailbreaking from human_rows""",
)
def boolean_parse(spark, folder):
    return fixture(spark, folder, "human_rows").select(
        "doc_id",
        tx.as_boolean(F.col("human_annotation")).alias("human"),
        tx.as_boolean(F.col("toxicity")).alias("toxic"),
        tx.as_boolean(F.col("jailbreaking")).alias("jailbreaking"),
    )


@registered(
    "dialogue_text",
    cte("dialogue")
    + f"""select conv_id, turn, md5('User: ' || {sql_strip("prompt")} || chr(10) || 'Assistant: ' || {sql_strip("response")}) as digest
from dialogue""",
)
def dialogue_text(spark, folder):
    prompt = tx.required(F.col("prompt"), "prompt")
    response = tx.required(F.col("response"), "response")
    return fixture(spark, folder, "dialogue").select(
        "conv_id", "turn", F.md5(tx.dialogue(prompt, response)).alias("digest")
    )


@registered(
    "category_flags",
    cte("votes")
    + """select event_id, coalesce(array_to_string(list_sort([case when not is_safe then category_1 end, category_2,
       case when event_id%2=0 then 'even' end]), '|'), '') as categories from votes""",
)
def category_flags(spark, folder):
    flags = F.create_map(
        "category_1", ~F.col("is_safe"),
        F.lit("extra"), F.col("category_2").isNotNull(),
        F.lit("even"), F.col("event_id") % 2 == 0,
    )
    return fixture(spark, folder, "votes").select(
        "event_id", F.array_join(tx.true_keys(flags), "|").alias("categories")
    )


@registered(
    "binary_labels",
    "select doc_id, case when toxic = 1 then 'REJECT' else 'ALLOW' end as expected_decision from labels",
)
def binary_labels(spark, folder):
    return table(spark, folder, "labels").select(
        "doc_id", dc.label_decision(F.col("toxic") == 1).alias("expected_decision")
    )


FILLER_SQL = f"repeat('{tx.FILLER}', {tx.FILLER_REPEATS})"


def _translated_sql() -> str:
    cases = " ".join(
        f"when '{code}' then {sql_string(head)} || term || {sql_string(tail)}"
        for code, (head, tail) in ((c, p.split("{term}")) for c, p in tx.LANGUAGE_PATTERNS.items())
    )
    return f"case language {cases} end"


@registered(
    "text_variants",
    f"""
with b as (
  select p_partkey, term, ['en','es','fr','hi'][1 + p_partkey % 4] as language,
         'Limited-time ' || term || ' promotion for adults. Reference ' || p_partkey || '.' as base
  from (select p_partkey, lower(split_part(p_name, ' ', 1)) as term from part) p)
select p_partkey, md5({FILLER_SQL} || base || {FILLER_SQL}) as long_context,
       md5({_translated_sql()}) as translated,
       replace(replace(base, term, array_to_string(string_split(term, ''), ' ')), 'promotion', 'pr0m0tion') as adversarial
from b""",
)
def text_variants(spark, folder):
    languages = F.array(*(F.lit(code) for code in tx.LANGUAGE_PATTERNS))
    part = table(spark, folder, "part").select(
        "p_partkey",
        F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term"),
        F.get(languages, (F.col("p_partkey") % 4).cast("int")).alias("language"),
    )
    base = tx.base_text(F.col("term"), F.col("p_partkey"))
    return part.select(
        "p_partkey",
        F.md5(tx.long_context(base)).alias("long_context"),
        F.md5(tx.translated(F.col("term"), F.col("language"))).alias("translated"),
        tx.adversarial(base, F.col("term")).alias("adversarial"),
    )


@registered(
    "request_contract",
    """select d.doc_id, length(d.text) between 1 and 20000 and length(d.source) between 1 and 500 as accepted,
       l.doc_id is not null and case when l.toxic = 1 then 'REJECT' else 'MAYBE' end in ('ALLOW', 'ESCALATE', 'REJECT') as resolution_accepted
from documents d left join labels l on d.doc_id = l.doc_id""",
)
def request_contract(spark, folder):
    documents = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    answer = F.when(F.col("toxic") == 1, "REJECT").when(F.col("toxic") == 0, "MAYBE")
    return documents.select(
        "doc_id",
        dc.request_contract(F.col("text"), F.col("source")).alias("accepted"),
        dc.resolution_contract(answer, F.lit("reviewer")).alias("resolution_accepted"),
    )


@registered(
    "request_split",
    """select case when length(text) between 1 and 20000 and length(source) between 1 and 500 then 'valid' else 'rejected' end as side,
       count(*) as requests, cast(sum(length(text)) as bigint) as characters from documents group by 1""",
)
def request_split(spark, folder):
    from gavelspark.operators.quality import split_by

    documents = table(spark, folder, "documents")
    valid, rejected = split_by(documents, dc.request_contract(F.col("text"), F.col("source")))
    both = valid.withColumn("side", F.lit("valid")).unionByName(rejected.withColumn("side", F.lit("rejected")))
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.length("text")).alias("characters")
    )
