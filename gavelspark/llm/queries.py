"""One query for each operator of this folder, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm.chat import perspectives
from gavelspark.llm.common import documents
from gavelspark.llm.decontamination import contamination
from gavelspark.llm.html_text import page_texts
from gavelspark.llm.language import identify
from gavelspark.llm.minhash import components as minhash_components
from gavelspark.llm.packing import packed
from gavelspark.llm.quality import assess
from gavelspark.llm.resampling import resampled
from gavelspark.llm.secrets import secret_scan
from gavelspark.llm.simhash import components
from gavelspark.llm.spelling import variants
from gavelspark.llm.token_counts import n_tokens, token_counts
from gavelspark.llm.url_filter import judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), tokenizer_file("byte_bpe_50k.json"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return components(documents(spark, folder)).drop("fp")


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return assess(documents(spark, folder))


@query("op9_language")
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(documents(spark, folder))


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet")


@query(
    "op3_decontamination",
    r"""
    WITH doc_words AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), item_words AS (
        SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ), wins AS (
        SELECT DISTINCT item_id, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win,
            least(len(w), 13) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM item_words WHERE len(w) > 0)
    ), lengths AS (SELECT DISTINCT n FROM wins
    ), doc_wins AS (
        SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc_words, lengths WHERE len(w) >= n)
    ), hits AS (
        SELECT r, s, n, item_id FROM doc_wins JOIN wins USING (win, n)
    ), covered AS (
        SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits))
        GROUP BY r
    ), named AS (
        SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
        coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
    """,
)
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(documents(spark, folder), benchmark(spark, folder)).drop("items")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


@query("op4_html_text")
def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(pages(spark, folder))


#: The rules of the query.
URL_RULES = """
    SELECT * FROM VALUES
        ('org', '/', 'allow'),
        ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'),
        ('com', '/de/', 'block')
    AS rules(host, path, verdict)
"""


@query(
    "op7_url_filter",
    r"""
    WITH urls AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM urls
    ), rules(rule_host, rule_path, rule_verdict) AS (
        VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ), fitting AS (
        SELECT page_id, max({'n': length(rule_host) + length(rule_path), 'rule': rule_host || rule_path,
            'verdict': rule_verdict}) AS won
        FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
            AND starts_with(path, rule_path)
        GROUP BY page_id
    )
    SELECT page_id, host, path, won.rule AS rule, coalesce(won.verdict, 'allow') AS verdict
    FROM parts LEFT JOIN fitting USING (page_id)
    """,
)
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged(pages(spark, folder), spark.sql(URL_RULES))


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return packed(docs, n_tokens(docs["text"], tokenizer_file("byte_bpe_50k.json")))


@query(
    "op10_chat",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
        FROM conversations
    ), views AS (
        SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
    ), rendered AS (
        SELECT t.conv_id, perspective, turn, speaker, text,
            CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                ELSE 'user' END AS role
        FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
    ), segments AS (
        SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
        FROM rendered
    ), placed AS (
        SELECT *, head || text || '<|im_end|>' || chr(10) AS segment,
            row_number() OVER w - 1 AS position,
            coalesce(sum(length(head) + length(text) + 11) OVER (
                PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text), text
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM segments
        WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text), text)
    )
    SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, speaker AS name, segment,
        CAST(start AS BIGINT) AS "start", role = 'assistant' AS trained,
        CAST(start + CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS mask_start,
        CAST(start + CASE WHEN role = 'assistant' THEN length(segment) ELSE 0 END AS BIGINT) AS mask_end
    FROM placed
    """,
)
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op8_secrets")
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan(documents(spark, folder))
    return found.select(
        "doc_id",
        "n_candidates",
        "n_secrets",
        F.transform("secrets", lambda s: s["start"]).alias("starts"),
        F.transform("secrets", lambda s: s["value"]).alias("secrets"),
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


#: CRC-32 in SQL: the table of the polynomial as one row, and the steps over the bytes of a text.
CRC_TABLE = """
    crc_table AS (
        SELECT list(c ORDER BY b) AS t FROM (
            SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM range(256) AS r(b)))
"""


def crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        range(octet_length(encode({text}))),
        lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


@query(
    "op11_resampling",
    rf"""
    WITH {CRC_TABLE.strip()}, doc_words AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), item_words AS (
        SELECT regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ), source AS (SELECT r, unnest(w) AS word FROM doc_words
    ), target AS (SELECT unnest(w) AS word FROM item_words
    ), words AS (
        SELECT word, {crc_sql("word")} % 10000 AS bucket
        FROM (SELECT DISTINCT word FROM (SELECT word FROM source UNION ALL SELECT word FROM target)), crc_table
    ), s AS (SELECT bucket, count(*) AS s FROM source JOIN words USING (word) GROUP BY bucket
    ), t AS (SELECT bucket, count(*) AS t FROM target JOIN words USING (word) GROUP BY bucket
    ), gains AS (
        SELECT bucket, CAST(floor(1000 * ln(
            CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM source) + 10000) AS DOUBLE)
            / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM target) + 10000) AS DOUBLE))) AS BIGINT) AS gain
        FROM s FULL JOIN t USING (bucket)
    ), weights AS (
        SELECT r, sum(gain) AS weight FROM source JOIN words USING (word) JOIN gains USING (bucket) GROUP BY r
    ), scored AS (
        SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
            CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8)
                AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM doc_words LEFT JOIN weights USING (r)
    ), ranked AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
            count(*) OVER () * 10 // 100 AS n_drawn
        FROM scored WHERE n_features >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n_drawn THEN CAST(rank AS BIGINT) END AS rank
    FROM scored LEFT JOIN ranked USING (r)
    """,
)
def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(documents(spark, folder), benchmark(spark, folder))


@query(
    "op12_spelling",
    rf"""
    WITH RECURSIVE {CRC_TABLE.strip()}, runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''),
            '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
    ), hashed AS (
        SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h
        FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL), crc_table
    ), words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                ELSE run END AS word
            FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), shorter AS (
        SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less
        FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
    ), pairs AS (
        SELECT a.word, b.word AS other FROM shorter a JOIN shorter b USING (i, less) WHERE a.word <> b.word
        UNION SELECT word, less FROM shorter SEMI JOIN (SELECT word AS less FROM words) AS w USING (less)
        UNION SELECT less, word FROM shorter SEMI JOIN (SELECT word AS less FROM words) AS w USING (less)
    ), best AS (
        SELECT p.word, count(*) AS n_near, max(o.n) AS top, arg_min(p.other, (-o.n, p.other)) AS other
        FROM pairs p JOIN words o ON p.other = o.word GROUP BY p.word
    ), forms AS (
        SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form,
            CASE WHEN top >= 5 * w.n THEN top END AS form_n
        FROM words w LEFT JOIN best USING (word)
    ), followed AS (
        SELECT word, word AS root, form AS following FROM forms
        UNION ALL
        SELECT f.word, f.following, n.form FROM followed f JOIN forms n ON f.following = n.word
    )
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, root
    FROM forms f JOIN followed ON f.word = followed.word AND following IS NULL
    """,
)
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return variants(documents(spark, folder), damage=199)


@query(
    "op13_minhash",
    r"""
    WITH RECURSIVE doc_words AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT r, array_to_string(w[s:s + 3], ' ') AS shingle
        FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM doc_words WHERE len(w) > 0)
    ), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r
    ), common AS (
        SELECT a.r AS a, b.r AS b, count(*) AS shared
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL
    ), links AS (
        SELECT a, b FROM common JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r
        WHERE 100 * shared >= 80 * (x.n + y.n - shared)
    ), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reached AS (
        SELECT a, b FROM edges
        UNION
        SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a
    ), least AS (SELECT a AS r, min(doc_id) AS least FROM reached JOIN doc_words ON b = r GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
        doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
    FROM doc_words LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
    """,
)
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_components(documents(spark, folder))
