"""From raw human labels to one labelled example per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions import text as tx
from gavelspark.functions.decisions import ScoreCuts, score_decision, score_in_range
from gavelspark.operators.quality import guarded
from gavelspark.schemas import ALLOW

# Id prefixes and the rule a restricted comment falls under.
PROMPT_ID_PREFIX = "toxicchat-0124-"
VOTE_ID_PREFIX = "beavertails-330k-"
COMMENT_RULE = ("P-TOX", "Remove or rewrite the toxic content.")
COMMENT_POLICY_VERSION = "civil-comments-v1"
COMMENT_SLICE = "real_civil_comments"


def labelled_comments(
    comments: DataFrame, *, text: str = "text", score: str = "toxicity", cuts: ScoreCuts = ScoreCuts()
) -> DataFrame:
    """Drop rows without text or score, then add the three-way ``label``.

    The null tests are written out because, unlike ``dropna``, they reach the scan.
    """
    present = F.col(text).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    return comments.filter(present).withColumn(
        "label", score_decision(F.col(score).cast("double"), cuts)
    )


def split_scored(comments: DataFrame, *, text: str = "text", score: str = "toxicity") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with a ``reason``."""
    reason = (
        F.when(F.coalesce(F.length(tx.strip(F.col(text))), F.lit(0)) == 0, "empty text")
        .when(F.col(score).isNull(), "missing score")
        .when(~score_in_range(F.col(score)), "score outside [0, 1]")
    )
    marked = comments.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def comment_cases(
    comments: DataFrame,
    *,
    split: str,
    index: str,
    text: str = "text",
    score: str = "toxicity",
    cuts: ScoreCuts = ScoreCuts(),
) -> DataFrame:
    """Scored comments as labelled cases; ``index`` is their position in the split."""
    content = tx.required(F.col(text), "comment text")
    body = comments.select(
        F.col(index).cast("long").alias("_i"),
        content.alias("content"),
        score_decision(F.col(score).cast("double"), cuts).alias("expected_decision"),
    )
    restricted = F.col("expected_decision") != ALLOW
    return body.select(
        tx.comment_case_id(split, F.col("_i"), F.col("content")).alias("case_id"),
        F.lit(COMMENT_POLICY_VERSION).alias("policy_version"),
        F.lit(COMMENT_SLICE).alias("slice_name"),
        F.lit("en").alias("language"),
        "content",
        "expected_decision",
        F.when(restricted, F.lit(COMMENT_RULE[0])).alias("expected_rule_id"),
        F.when(restricted, F.lit(COMMENT_RULE[1])).alias("expected_remediation"),
        F.lit(None).cast("int").alias("label_budget"),
    )


def human_reviewed(
    rows: DataFrame,
    *,
    text: str = "user_input",
    human: str = "human_annotation",
    toxic: str = "toxicity",
    jailbreak: str = "jailbreaking",
    require_rows: bool = False,
) -> DataFrame:
    """One example per text of the rows a human annotated; conflicting labels fail.

    The text is the grouping key, so repeated texts merge before the shuffle and the
    hash is taken once per distinct text.
    """

    def flag(name: str, default: str) -> Column:
        return tx.as_boolean(F.coalesce(F.col(name).cast("string"), F.lit(default)))

    reviewed = rows.filter(flag(human, "false"))
    if require_rows and reviewed.isEmpty():
        raise ValueError("no explicitly human-annotated rows found")
    merged = (
        reviewed.select(
            tx.required(F.col(text), "human-annotated text").alias("text"),
            flag(toxic, "0").cast("int").alias("_toxic"),
            flag(jailbreak, "0").cast("int").alias("_jailbreak"),
        )
        .groupBy("text")
        .agg(
            F.min("_toxic").alias("_toxic_low"), F.max("_toxic").alias("_toxic_high"),
            F.min("_jailbreak").alias("_jailbreak_low"), F.max("_jailbreak").alias("_jailbreak_high"),
        )
    )
    agreed = (F.col("_toxic_low") == F.col("_toxic_high")) & (
        F.col("_jailbreak_low") == F.col("_jailbreak_high")
    )
    checked = guarded(merged, agreed, "conflicting human labels for a repeated text")
    return checked.select(
        tx.digest_id(F.col("text"), PROMPT_ID_PREFIX).alias("example_id"),
        "text",
        (F.col("_toxic_low") == 1).alias("toxic"),
        (F.col("_jailbreak_low") == 1).alias("jailbreaking"),
    )


def conflicting_labels(
    rows: DataFrame, *, text: str, flags: list[str]
) -> DataFrame:
    """Texts whose repeated rows carry different labels (what the strict form refuses)."""
    counts = [F.count_if(F.col(f)).alias(f"{f}_true") for f in flags]
    merged = rows.groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("n"), *counts)
    mixed = F.lit(False)
    for f in flags:
        mixed = mixed | ((F.col(f"{f}_true") > 0) & (F.col(f"{f}_true") < F.col("n")))
    return merged.filter(mixed)


def vote_rows(votes: DataFrame) -> DataFrame:
    """Prompt/response votes as (text, is_safe, categories); invalid rows fail."""
    safe = F.when(F.col("is_safe").isNotNull(), F.col("is_safe")).otherwise(
        F.raise_error(F.lit("vote has no is_safe label")).cast("boolean")
    )
    text = tx.dialogue(tx.required(F.col("prompt"), "prompt"), tx.required(F.col("response"), "response"))
    categories = F.coalesce(tx.true_keys(F.col("category")), F.array().cast("array<string>"))
    return votes.select(text.alias("text"), safe.alias("is_safe"), categories.alias("categories"))


def majority_labels(votes: DataFrame, *, require_rows: bool = False) -> DataFrame:
    """Majority label per text, ties dropped, with the categories that more than half of
    all its votes name.

    Input: ``text, is_safe, categories``. Every vote becomes a marker row, which carries
    the text and the safe vote, and one narrow row per distinct category with the text's
    digest only. Both kinds are counted in one aggregation with partial sums, so a text
    that holds a large share of all votes is reduced before the shuffle. What reaches the
    second grouping is one row per text and category.
    """
    counted = (
        votes.select("text", "is_safe", "categories", F.sha2("text", 256).alias("_key"))
        .selectExpr(
            "_key",
            "is_safe",
            "text",
            """explode(array_union(array(cast(null as string)),
                                   coalesce(categories, cast(array() as array<string>)))) as _category""",
        )
        .selectExpr(
            "_key", "_category", "if(_category is null, text, null) as _text", "bigint(is_safe) as _safe"
        )
        .groupBy("_key", "_category", "_text")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_safe").alias("_safe"))
    )
    folded = counted.groupBy("_key").agg(
        F.expr("max(if(_category is null, _n, null)) as n"),
        F.expr("max(if(_category is null, _safe, null)) as safe_votes"),
        F.expr("max(_text) as text"),
        F.expr(
            "collect_list(if(_category is null, null, struct(_category as name, _n as votes))) as _named"
        ),
    )
    decided = folded.filter("2 * safe_votes <> n")
    if require_rows and decided.isEmpty():
        raise ValueError("no example has a majority label")
    return decided.selectExpr(
        f"concat('{VOTE_ID_PREFIX}', substring(_key, 1, 16)) as example_id",
        "text",
        "2 * safe_votes > n as safe",
        "array_sort(transform(filter(_named, c -> 2 * c.votes > n), c -> c.name)) as categories",
        "n as annotation_count",
        "if(2 * safe_votes > n, safe_votes, n - safe_votes) / n as safe_label_agreement",
    )


def vote_summary(examples: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Examples, mean votes per example and mean agreement; with ``votes``, the table the
    examples come from, also its number of rows, ties included."""
    summary = examples.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("annotation_count").alias("mean_annotations_per_example"),
        F.avg("safe_label_agreement").alias("mean_safe_label_agreement"),
    )
    if votes is None:
        return summary
    rows = votes.agg(F.count(F.lit(1)).alias("n"))
    return summary.withColumn("source_annotation_rows", rows.scalar())


def labelled_mix(sources: dict[str, DataFrame]) -> DataFrame:
    """Bag union of (text, label) sets with a ``source`` column."""
    combined = None
    for name, frame in sources.items():
        part = frame.select("text", "label", F.lit(name).alias("source"))
        combined = part if combined is None else combined.unionByName(part)
    if combined is None:
        raise ValueError("at least one source is required")
    return combined


def mix_counts(mix: DataFrame) -> DataFrame:
    return mix.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
