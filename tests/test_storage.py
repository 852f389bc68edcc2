import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import sampling as sp
from gavelspark.schemas import COMMENT_SCHEMA, PROMPT_SCHEMA, VOTE_SCHEMA
from gavelspark.sources import readers as rd
from gavelspark.sources import sinks as sk
from gavelspark.sources import storage as st
from gavelspark.sources.policy_data import policy_cases, policy_rules


def test_comments_are_pruned_labelled_and_sampled(spark, tmp_path):
    rows = [(f"t{i}", i / 20, *[0.1] * 6) for i in range(20)] + [(None, 0.5, *[0.1] * 6), ("x", None, *[0.1] * 6)]
    frame = spark.createDataFrame(rows, COMMENT_SCHEMA).withColumn("unused", F.lit("wide"))
    path = str(tmp_path / "comments.parquet")
    frame.write.parquet(path)
    read = rd.read_comments(spark, path, attributes=("threat",))
    assert read.columns == ["text", "toxicity", "threat", "label"] and read.count() == 20
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "obscene" not in plan and "PushedFilters: [IsNotNull" in plan
    assert rd.read_comments(spark, path, limit=6, seed=7).count() == 6
    assert rd.read_comments(spark, path, limit=6, seed=7).collect() == rd.read_comments(spark, path, limit=6, seed=7).collect()
    assert rd.read_comments(spark, path, limit=100).count() == 20


def test_jsonl_blank_and_malformed_lines(spark, tmp_path):
    path = tmp_path / "votes.jsonl"
    row = {"prompt": "p", "response": "é\n", "is_safe": True, "category": {"a": True}}
    path.write_text(json.dumps(row) + "\n\n   \n" + json.dumps(row) + "\n", encoding="utf-8")
    rows = rd.read_jsonl(spark, str(path), VOTE_SCHEMA).collect()
    assert len(rows) == 2 and rows[0].response == "é\n" and rows[0].category == {"a": True}
    path.write_text('{"prompt": \n', encoding="utf-8")
    with pytest.raises(Exception):
        rd.read_jsonl(spark, str(path), VOTE_SCHEMA).collect()


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "prompts.csv"
    path.write_text(
        'user_input,human_annotation,toxicity,jailbreaking\n"line one\nsaid ""hi"", twice",True,1,0\nplain,,0,\n',
        encoding="utf-8",
    )
    rows = rd.read_csv(spark, str(path), PROMPT_SCHEMA).collect()
    assert [tuple(r) for r in rows] == [
        ('line one\nsaid "hi", twice', "True", "1", "0"), ("plain", "", "0", "")
    ]


def test_jsonl_keeps_nulls_and_unicode(spark, tmp_path):
    cases = policy_cases(spark.range(4).withColumnRenamed("id", "index"), policy_rules(spark))
    sk.write_jsonl(sp.blind(cases), str(tmp_path / "pack"))
    lines = [l for f in (tmp_path / "pack").glob("*.json") for l in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 72 and any("वयस्कों" in l for l in lines)
    assert all(len(json.loads(l)) == 13 and json.loads(l)["annotated_decision"] is None for l in lines)


def test_reviewer_copies_are_equal(spark, tmp_path):
    cases = policy_cases(spark.range(20).withColumnRenamed("id", "index"), policy_rules(spark))
    sk.write_reviewer_copies(sp.hash_per_slice(sp.blind(cases), 4), str(tmp_path))
    copies = [
        "".join(f.read_text() for f in sorted((tmp_path / who).glob("*.json"))) for who in ("reviewer_a", "reviewer_b")
    ]
    assert copies[0] == copies[1] and copies[0].count("\n") == 24


def test_receipt(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("m", "test", "overall", "far", 0.1), ("m", "test", "threat", "far", None), ("m", "validation", "overall", "far", 0.2)],
        "model_id string, split string, slice string, metric string, value double",
    )
    sk.write_receipt(metrics, str(tmp_path / "receipt"))
    (line,) = [l for f in (tmp_path / "receipt").glob("*.json") for l in f.read_text().splitlines()]
    assert json.loads(line) == {
        "model_id": "m",
        "evaluations": {
            "test": {"overall": {"far": 0.1}, "threat": {"far": None}},
            "validation": {"overall": {"far": 0.2}},
        },
        "contains_source_text": False,
    }
    with pytest.raises(ValueError):
        sk.write_receipt(metrics.withColumn("text", F.lit("x")), str(tmp_path / "other"))


def test_manifest(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(os.urandom(1000 + i))
    manifest = rd.file_manifest(spark, str(tmp_path))
    got = {r.path: (r.length, r.sha256) for r in manifest.collect()}
    assert got == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir()}
    recorded = spark.createDataFrame([(p, h) for p, (_, h) in got.items()], "path string, sha256 string")
    assert rd.verify_manifest(recorded, manifest) is recorded
    (tmp_path / "f1.bin").write_bytes(b"changed")
    with pytest.raises(ValueError, match="f1.bin"):
        rd.verify_manifest(recorded, rd.file_manifest(spark, str(tmp_path)))


def test_long_files_are_hashed_in_stretches(spark, tmp_path, monkeypatch):
    """A file was read whole by one task."""
    monkeypatch.setattr(rd, "LONG_FILE", 1000)
    monkeypatch.setattr(rd, "STRETCH", 100_000)
    lines = b"\n".join(os.urandom(40).replace(b"\n", b"") + b"\r" for _ in range(8_000))
    contents = {
        "a b%[1].bin": os.urandom(400_000), "ends.bin": lines + b"\n", "open.bin": lines, "blank.bin": b"\n" * 5_000,
        "mark.txt": b"\xef\xbb\xbfx\n" + lines, "marks.txt": b"\xef\xbb\xbf" * 400 + b"\n", "one.bin": b"x" * 3_000,
        "short.bin": b"x\n", "packed.gz": os.urandom(2_000), "zeros/ends.bin": bytes(300_000),
    }
    (tmp_path / "zeros").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = {r.path: (r.length, r.sha256) for r in rd.file_manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in contents.items()}


def test_training_on_a_test_split_is_refused(spark, tmp_path):
    for name in ("train.jsonl", "official_TEST.jsonl"):
        (tmp_path / name).write_text('{"a": 1}\n')
    assert rd.refuse_test_split(spark.read.json(str(tmp_path / "train.jsonl"))).count() == 1
    with pytest.raises(ValueError):
        rd.refuse_test_split(spark.read.json(str(tmp_path / "official_TEST.jsonl")))
    spark.range(3).write.parquet(str(tmp_path / "test.parquet"))
    with pytest.raises(ValueError):
        rd.refuse_test_split(spark.read.parquet(str(tmp_path / "test.parquet")))


def test_shared_folder_comes_from_the_session(spark):
    assert st.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    staged = st.stage(spark.range(5))
    assert staged.count() == 5 and "parquet" in staged._jdf.queryExecution().executedPlan().toString().lower()
