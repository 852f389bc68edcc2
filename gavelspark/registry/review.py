"""Samples, review packs and annotator agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.operators import agreement as ag
from gavelspark.operators import sampling as sp
from gavelspark.registry import registered
from gavelspark.registry.fixtures import cte, fixture
from gavelspark.sources.readers import table
from gavelspark.sources.sinks import write_reviewer_copies
from gavelspark.sources.storage import new_folder


def _seeded(column: str, seed: int = 42) -> str:
    return f"sha256('{seed}:' || {column})"


@registered(
    "sample_exact",
    f"""select case_id, slice_name from (select 'D-' || doc_id as case_id, source as slice_name from documents) d
order by {_seeded('case_id')}, case_id limit 150""",
)
def sample_exact(spark, folder):
    cases = fixture(spark, folder, "slice_cases").select("case_id", "slice_name")
    return sp.sample_exact(cases, 150, key="case_id")


@registered(
    "sample_at_most",
    f"select o_custkey from orders order by {_seeded('cast(o_custkey as varchar)', 7)}, o_custkey limit 2000",
)
def sample_at_most(spark, folder):
    """A key that many rows share: rows are counted, not keys."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sp.sample_at_most(orders, 2000, key="o_custkey", seed=7).select("o_custkey")


@registered(
    "first_rows",
    "select case when doc_id % 7 = 0 then doc_id end as place from documents order by place nulls last limit 100",
)
def first_rows(spark, folder):
    """An order with nulls, which come last."""
    place = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id")).alias("place")
    return sp.first_rows(table(spark, folder, "documents").select(place), 100, order_by="place")


@registered(
    "first_per_slice",
    """select case_id, slice_name from (select 'D-' || doc_id as case_id, source as slice_name, row_number() over (partition by source order by doc_id) as r from documents) t where r <= 20""",
)
def first_per_slice(spark, folder):
    cases = fixture(spark, folder, "slice_cases")
    return sp.first_per_slice(cases, 20, order_by="doc_id").select("case_id", "slice_name")


@registered(
    "hash_per_slice",
    """select case_id, slice_name from (select *, row_number() over (partition by slice_name order by sha256(case_id), case_id) as r
  from (select 'D-' || doc_id as case_id, source as slice_name from documents) d) t where r <= 4""",
)
def hash_per_slice(spark, folder):
    cases = fixture(spark, folder, "slice_cases").select("case_id", "slice_name")
    return sp.hash_per_slice(cases, 4).orderBy("case_id")


REPEATED = "case when doc_id % 2 = 0 then concat('D-', doc_id % 40) end"


@registered(
    "hash_top",
    f"select case_id from (select {REPEATED} as case_id from documents) d order by sha256(case_id) nulls last, case_id limit 150",
)
def hash_top(spark, folder):
    """Keys that repeat and keys that are null."""
    cases = fixture(spark, folder, "slice_cases").select(F.expr(REPEATED).alias("case_id"), "slice_name")
    return sp.hash_top(cases, 150, key="case_id").select("case_id")


@registered(
    "audit_sheet",
    """select case_id, 'project_author' as reviewer_role, cast(null as varchar) as model_decision, cast(null as varchar) as reference_decision,
       cast(null as varchar) as error_category, cast(null as varchar) as error_notes
from (select 'D-' || doc_id as case_id from documents) d order by sha256(case_id), case_id limit 50""",
)
def audit_sheet(spark, folder):
    return sp.audit_sheet(sp.hash_top(fixture(spark, folder, "slice_cases"), 50, key="case_id"))


@registered(
    "blind_pack",
    "select 'D-' || doc_id as case_id, lang as policy_version, source as slice_name, lang as language, md5(text) as content, "
    + ", ".join(
        f"cast(null as {'varchar' if kind == 'string' else kind}) as {name}" for name, kind in sp.ANNOTATION_COLUMNS.items()
    )
    + " from documents",
)
def blind_pack(spark, folder):
    cases = table(spark, folder, "documents").select(
        F.concat(F.lit("D-"), "doc_id").alias("case_id"),
        F.col("lang").alias("policy_version"),
        F.col("source").alias("slice_name"),
        F.col("lang").alias("language"),
        F.md5("text").alias("content"),
        F.lit("ALLOW").alias("expected_decision"),
    )
    return sp.blind(cases)


def _sql_digest(columns: tuple[str, ...], source: str) -> str:
    """The digest of ``content_digest`` over a table or subquery."""
    row = " || '|' || ".join(f"coalesce('=' || cast({c} as varchar), 'null')" for c in columns)
    words = " || ':' || ".join(
        f"coalesce(cast(sum(cast('0x' || substr(h, {8 * i + 1}, 8) as hugeint)) as varchar), '0')" for i in range(sp.DIGEST_WORDS)
    )
    return f"(select sha256(cast(count(*) as varchar) || ':' || {words}) from (select sha256({row}) as h from {source}) d)"


PILOT = """(select case_id, slice_name, language, row_number() over (partition by slice_name order by sha256(case_id)) as r
      from (select 'D-' || doc_id as case_id, source as slice_name, lang as language from documents) c)"""
PILOT_SOURCE = ("case_id", "doc_id", "slice_name", "language")


@registered(
    "pilot_manifest",
    f"""select 'unpaid_volunteer_pilot' as purpose, count(*) as cases, cast(4 as bigint) as cases_per_slice, cast(2 as bigint) as reviewers_required, 'none' as compensation,
       false as human_reviews_completed,
       {_sql_digest(PILOT_SOURCE, "(select 'D-' || doc_id as case_id, doc_id, source as slice_name, lang as language from documents) s")} as source_sha256
from {PILOT} t where r <= 4""",
)
def pilot_manifest(spark, folder):
    cases = fixture(spark, folder, "slice_cases")
    picked = sp.hash_per_slice(cases, 4)
    source = sp.content_digest(cases, PILOT_SOURCE)
    manifest = sp.pilot_manifest(picked, per_slice=4, reviewers=2, source=source)
    return manifest.withColumns({c: F.col(c).cast("long") for c in ("cases_per_slice", "reviewers_required")})


COPY = ("case_id", "slice_name", "language")


@registered(
    "reviewer_copies",
    f"select reviewer, {_sql_digest(COPY, f'(select * from {PILOT} t where r <= 4) p')} as sha256 from (values ('reviewer_a'), ('reviewer_b')) as v(reviewer)",
)
def reviewer_copies(spark, folder):
    """The written copies, read back: equal content for every reviewer."""
    picked = sp.hash_per_slice(fixture(spark, folder, "slice_cases"), 4).select(*COPY)
    path = new_folder(spark, "pilot")
    write_reviewer_copies(picked, path)
    copies = [
        sp.content_digest(spark.read.schema(picked.schema).json(f"{path}/{name}"), COPY).select(
            F.lit(name).alias("reviewer"), "sha256"
        )
        for name in ("reviewer_a", "reviewer_b")
    ]
    return copies[0].unionByName(copies[1])


@registered(
    "seeded_shuffle",
    f"select doc_id, {_seeded('cast(doc_id as varchar)')} as position from documents order by position, doc_id",
)
def seeded_shuffle(spark, folder):
    shuffled = sp.seeded_shuffle(table(spark, folder, "documents").select("doc_id"), key="doc_id")
    return shuffled.select("doc_id", sp.hash_order(F.col("doc_id"), 42).alias("position"))


@registered("distinct_slices", "select distinct source as slice_name from documents")
def distinct_slices(spark, folder):
    return sp.distinct_slices(fixture(spark, folder, "slice_cases"))


# ---- agreement ----------------------------------------------------------------------


def annotations(spark, folder):
    rows = fixture(spark, folder, "annotators")

    def side(suffix):
        return rows.select(
            "case_id",
            F.col(f"decision_{suffix}").alias("annotated_decision"),
            F.col(f"rule_{suffix}").alias("annotated_rule_id"),
        )

    return side("a"), side("b")


SAME = "decision_a = decision_b and rule_a = rule_b"


@registered(
    "agreement_report",
    cte("annotators")
    + f"""select count(*) as case_count, cast(count(*) filter ({SAME}) as double) / count(*) as decision_and_rule_agreement,
       count(*) filter (not ({SAME})) as disagreement_count, count(*) filter (not ({SAME})) > 0 as requires_adjudication from annotators""",
)
def agreement_report(spark, folder):
    return ag.agreement_report(ag.compare_annotations(*annotations(spark, folder)))


@registered("disagreements", cte("annotators") + f"select case_id from annotators where not ({SAME})")
def disagreements(spark, folder):
    return ag.disagreements(ag.compare_annotations(*annotations(spark, folder)))


@registered(
    "unpaired_ids",
    """select o_orderkey as case_id, case when o_custkey % 3 = 0 then 'right' else 'left' end as only_in from orders
where (o_custkey % 3 = 0 and o_orderstatus <> 'F') or (o_custkey % 3 <> 0 and o_orderstatus = 'F')""",
)
def unpaired_ids(spark, folder):
    orders = table(spark, folder, "orders").withColumn("case_id", F.col("o_orderkey"))
    left = orders.filter((F.col("o_custkey") % 3 != 0))
    right = orders.filter(F.col("o_orderstatus") != "F")
    return ag.unpaired_ids(left, right)


MISSING = {
    "annotated_decision": 2, "annotated_rule_id": 3, "supporting_passage": 5, "reason": 7,
    "review_required": 11, "annotation_confidence": 13,
}


@registered(
    "missing_annotation_fields",
    "select case_id, missing from (select o_orderkey as case_id, coalesce(array_to_string(["
    + ", ".join(f"case when o_orderkey % {n} = 0 then '{f}' end" for f, n in sorted(MISSING.items()))
    + "], ', '), '') as missing from orders) t where missing <> ''",
)
def missing_annotation_fields(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        key.alias("case_id"), *(F.when(key % n != 0, F.lit("x")).alias(f) for f, n in MISSING.items())
    )
    return ag.missing_fields(rows).select("case_id", F.array_join("missing", ", ").alias("missing"))
