"""Readers, sinks and manifests, over tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.operators import sampling as sp
from gavelspark.registry import registered
from gavelspark.registry.fixtures import cte, fixture
from gavelspark.schemas import PROMPT_SCHEMA
from gavelspark.sources import readers as rd
from gavelspark.sources import sinks as sk
from gavelspark.sources.readers import table
from gavelspark.sources.storage import new_folder


@registered(
    "comments_scan",
    cte("scored_comments")
    + """select doc_id, length(text) as characters, toxicity, threat, case when toxicity <= 0.1 then 'ALLOW' when toxicity >= 0.5 then 'REJECT' else 'ESCALATE' end as label
from scored_comments where doc_id % 7 <> 0""",
)
def comments_scan(spark, folder):
    path = new_folder(spark, "comments")
    comments = fixture(spark, folder, "scored_comments").withColumn("unused", F.md5("text"))
    comments.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text"))).write.parquet(path)
    rows = rd.read_comments(spark, path, key="doc_id", attributes=("threat", "insult"))
    return rows.select("doc_id", F.length("text").cast("long").alias("characters"), "toxicity", "threat", "label")


@registered(
    "jsonl_round_trip", "select conv_id, turn, role, md5(text) as text from conversations"
)
def jsonl_round_trip(spark, folder):
    conversations = table(spark, folder, "conversations")
    path = new_folder(spark, "jsonl")
    sk.write_jsonl(conversations, path)
    return rd.read_jsonl(spark, path, conversations.schema).withColumn("text", F.md5("text"))


@registered(
    "csv_round_trip",
    cte("human_rows")
    + "select md5(user_input) as user_input, human_annotation, toxicity, jailbreaking, count(*) as n from human_rows group by all",
)
def csv_round_trip(spark, folder):
    path = new_folder(spark, "csv")
    rows = fixture(spark, folder, "human_rows").select(*PROMPT_SCHEMA.fieldNames())
    rows.write.options(
        quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path, header=True)
    return (
        rd.read_csv(spark, path)
        .groupBy(F.md5("user_input").alias("user_input"), "human_annotation", "toxicity", "jailbreaking")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@registered(
    "blind_pack_file",
    "select 'D-' || doc_id as case_id, cast(13 as bigint) as fields, true as nulls_kept from documents",
)
def blind_pack_file(spark, folder):
    """A blind pack as JSON lines: the empty annotation fields are really in the file."""
    cases = table(spark, folder, "documents").select(
        F.concat(F.lit("D-"), "doc_id").alias("case_id"),
        F.col("lang").alias("policy_version"),
        F.col("source").alias("slice_name"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )
    path = new_folder(spark, "blind")
    sk.write_jsonl(sp.blind(cases), path)
    line = F.col("value")
    return spark.read.text(path).select(
        F.get_json_object(line, "$.case_id").alias("case_id"),
        F.size(F.json_object_keys(line)).cast("long").alias("fields"),
        F.contains(line, F.lit('"annotated_decision":null')).alias("nulls_kept"),
    )


@registered("file_manifest")
def file_manifest(spark, folder):
    """Size and SHA-256 of the table files. Rows only: SQL does not see the files."""
    return rd.file_manifest(spark, folder, pattern="*.parquet")


@registered("changed_files")
def changed_files(spark, folder):
    """Files whose recorded hash differs: every fourth record is altered or missing."""
    actual = rd.file_manifest(spark, folder, pattern="*.parquet")
    altered = F.length("path") % 4 == 0
    recorded = actual.withColumn("sha256", F.when(altered, F.reverse("sha256")).otherwise(F.col("sha256")))
    return rd.unpaired_files(recorded, actual.filter(F.length("path") % 4 != 1)).select(
        "path", F.col("actual_sha256").isNull().alias("missing")
    )


def _log_files(spark, folder, altered, kept):
    """The events as text files, one for each group of users and side: equal names lie in
    different folders."""
    group = (F.col("user_id") % 20).alias("users")
    rows = table(spark, folder, "events").select(group, "event_id", "event_type")
    line = F.concat_ws(",", "event_id", F.when(altered, F.reverse("event_type")).otherwise(F.col("event_type")))
    sides = rows.where(kept).withColumn("value", line).withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b"))))
    path = new_folder(spark, "logs")
    ordered = sides.repartition("side", "users").sortWithinPartitions("side", "users", "event_id")
    ordered.select("side", "users", F.concat_ws(":", "side", "value").alias("value")).write.partitionBy("side", "users").text(path)
    manifest = rd.file_manifest(spark, path, pattern="*.txt")
    # the writer's own part name is random; the folders above it name the file
    return manifest.withColumn("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))


LOG_FILES = """files as (select 'side=' || side || '/users=' || (user_id % 20) as path, user_id % 20 as users,
       string_agg(side || ':' || event_id || ',' || event_type || chr(10), '' order by event_id) as content
from events cross join (values ('a'), ('b')) as s(side) group by side, user_id % 20)"""


@registered("written_manifest", f"with {LOG_FILES} select path, strlen(content) as length, sha256(content) as sha256 from files")
def written_manifest(spark, folder):
    return _log_files(spark, folder, F.lit(False), F.lit(True))


@registered(
    "changed_written_files",
    f"with {LOG_FILES} select path, users % 7 = 1 as missing from files where users % 7 = 1 or users % 5 = 0",
)
def changed_written_files(spark, folder):
    """Files that are altered or missing against their recorded manifest."""
    recorded = _log_files(spark, folder, F.lit(False), F.lit(True))
    actual = _log_files(spark, folder, F.col("users") % 5 == 0, F.col("users") % 7 != 1)
    return rd.unpaired_files(recorded, actual).select("path", F.col("actual_sha256").isNull().alias("missing"))


@registered("training_source", "select lang, count(*) as rows from documents group by 1")
def training_source(spark, folder):
    """Counts over a source that passed the check for a test split's name."""
    checked = rd.refuse_test_split(table(spark, folder, "documents"))
    return checked.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
