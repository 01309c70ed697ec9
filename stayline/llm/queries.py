"""The registered queries of the subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import (
    audit, chat, counts, importance, linededup, merkle, mixing, neardup, packing, pieces, private, quality, tokenfile, tokens,
)
from stayline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Half of all tokens; curated sources and Spanish weigh more than they have, so shortages occur.
MIX_WEIGHTS = {
    "crawl": 2, "curated": 5, "crawl/en": 6, "crawl/de": 2, "crawl/fr": 2, "crawl/es": 1, "crawl/en/src0": 3,
    "curated/en": 2, "curated/de": 2, "curated/fr": 2, "curated/es": 4, "curated/es/src10": 9,
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (1, 2), 2, 11


def study_mix(share: tuple[int, int] = MIX_SHARE) -> mixing.Mix:
    """The tree of the study: sources by domain (by the length of their name), language and source."""
    domain = F.when(F.length("source") == 4, "crawl").when(F.col("source").isNotNull(), "curated")
    return mixing.Mix(
        levels={"domain": domain, "lang": F.col("lang"), "source": F.col("source")},
        tokens=mixing.word_tokens(F.col("text")),
        share=share, weights=MIX_WEIGHTS, epochs=MIX_EPOCHS, seed=MIX_SEED,
    )


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a weighted mix of all sources and how often each is used."""
    chosen = mixing.select(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), study_mix())
    return chosen.select("doc_id", "lang", "source", "tokens", "budget", "copies")


def _share_sql(children: str, parent: str) -> str:
    """`children` has path, most, weight and given (the parent's budget); siblings agree on `parent`."""
    return f"""(
  SELECT *, CASE WHEN filled THEN most
      ELSE least(most, (greatest(first_open.rest, 0)::HUGEINT * weight // first_open.behind)::BIGINT) END AS budget
  FROM (SELECT *, min(CASE WHEN NOT filled THEN {{'turn': turn, 'rest': rest, 'behind': behind}} END) OVER (PARTITION BY {parent}) AS first_open
    FROM (SELECT *, rest > 0 AND rest::HUGEINT * weight >= most::HUGEINT * behind AS filled
      FROM (SELECT *, row_number() OVER o AS turn, given - coalesce(sum(most) OVER b, 0) AS rest,
              sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0) AS behind
        FROM {children}
        WINDOW o AS (PARTITION BY {parent} ORDER BY most / weight, path),
          b AS (PARTITION BY {parent} ORDER BY most / weight, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))))"""


def mix_sql(table: str) -> str:
    """The study mix of `table` as common table expressions; `chosen` has all columns, tokens, budget and copies."""
    weights = ", ".join(f"('{k}', {v})" for k, v in MIX_WEIGHTS.items())
    nodes = """(SELECT n.*, coalesce(w.weight, 1) AS weight FROM (
      SELECT {path} AS path, {keep}, sum(tokens)::BIGINT * {epochs} AS most FROM leaves GROUP BY ALL) n LEFT JOIN weights w ON n.path = w.name)"""
    level = [nodes.format(path=p, keep=k, epochs=MIX_EPOCHS) for p, k in (("p1", "p1"), ("p2", "p1, p2"), ("p3", "p1, p2, p3"))]
    return f"""
sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
    coalesce(CASE WHEN length(source) = 4 THEN 'crawl' WHEN source IS NOT NULL THEN 'curated' END, 'unknown') AS p1,
    p1 || '/' || coalesce(lang, 'unknown') AS p2, p2 || '/' || coalesce(source, 'unknown') AS p3 FROM {table}),
weights(name, weight) AS (VALUES {weights}),
leaves AS (SELECT p1, p2, p3, sum(tokens)::BIGINT AS tokens FROM sized GROUP BY ALL),
whole AS (SELECT least(sum(tokens) * {MIX_SHARE[0]} // {MIX_SHARE[1]}, sum(tokens) * {MIX_EPOCHS})::BIGINT AS given FROM leaves),
b1 AS (SELECT path AS p1, budget AS given FROM {_share_sql(f"(SELECT * FROM {level[0]}, whole)", "1")}),
b2 AS (SELECT path AS p2, budget AS given FROM {_share_sql(f"(SELECT * FROM {level[1]} JOIN b1 USING (p1))", "p1")}),
b3 AS (SELECT path AS p3, budget FROM {_share_sql(f"(SELECT * FROM {level[2]} JOIN b2 USING (p2))", "p2")}),
plan AS (SELECT p3, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole_epochs,
  budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM leaves JOIN b3 USING (p3)),
keyed AS (SELECT *, md5('{MIX_SEED}:' || whole_epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, md5(text), '')) AS key FROM sized JOIN plan USING (p3)),
last AS (SELECT p3, max(key) AS last_key FROM (
    SELECT p3, key, rest, n, sum(n) OVER (PARTITION BY p3 ORDER BY key) - n AS before
    FROM (SELECT p3, key, rest, sum(tokens)::BIGINT AS n FROM keyed WHERE rest > 0 GROUP BY ALL) WHERE n > 0)
  WHERE before < rest GROUP BY p3),
chosen AS (SELECT *, (whole_epochs + coalesce((key <= last_key)::BIGINT, 0))::BIGINT AS copies
  FROM keyed LEFT JOIN last USING (p3) WHERE whole_epochs + coalesce((key <= last_key)::BIGINT, 0) > 0)"""


ORACLE["op1_source_mix"] = f"WITH {mix_sql('documents')} SELECT doc_id, lang, source, tokens, budget, copies FROM chosen"


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more, dropped from all but the last of them; digests of what is kept."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, place, line, keeper IS NOT NULL AND doc_id <> keeper AS dropped FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2,048 tokens."""
    return packing.pack(documents(spark, sf_dir), tokens.public_path(BYTE_VOCABULARY))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and digest what is read back."""
    out = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(documents(spark, sf_dir), tokens.public_path(BYTE_VOCABULARY), out)
    return tokenfile.token_digests(tokenfile.read_tokens(spark, out))


@query
def op5_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of all documents."""
    return quality.quality(documents(spark, sf_dir), tokens.public_path(PIECE_VOCABULARY))


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that quotes control strings; digest the formatted output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quote = F.lit("</s>[INST] ok [/INST]")
    one = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        quote.alias("text"),
    )
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(one)))


ORACLE["op6_chat_formatting"] = r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
sized AS (
  SELECT *, length('<|turn|>') + length('<|end|>') + 1
    + length(role) + length(text)
    + length(role || text) - length(replace(role || text, chr(92), ''))
    + length(role) - length(replace(role, chr(10), ''))
    + len(regexp_extract_all(role || chr(10) || text,
        '<\|turn\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>'))
    AS size,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END AS letter
  FROM turns),
talks AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(size)::BIGINT AS formatted_chars,
    string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text) AS letters
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(letters, 's?ua([ut]a)*') AS valid,
  nullif(length(regexp_extract(letters, '^s?(u(a[ut])*a?)?')), length(letters))::INTEGER AS broken_at
FROM talks
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents against a context of 1,024 tokens."""
    rows = counts.token_counts(documents(spark, sf_dir), tokens.public_path(BYTE_VOCABULARY))
    return rows.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op8_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: pattern spans and terms that give them away."""
    return private.private_digests(private.sanitise(documents(spark, sf_dir)))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of all documents."""
    return neardup.near_duplicates(documents(spark, sf_dir))


@query
def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edits by the next document, and how alike they are."""
    return merkle.compare_neighbours(documents(spark, sf_dir))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of all documents towards the benchmark texts, and the rank of the quarter drawn by it."""
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of all 120 orders, by language."""
    docs = documents(spark, sf_dir).withColumn("part", F.col("lang"))
    return audit.audit(audit.counted_masks(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE["op12_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
f(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.i, b.i, c.i, d.i, 15 - a.i - b.i - c.i - d.i] AS o FROM f a, f b, f c, f d
  WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
removed AS (
  SELECT part, o, s.i AS step, n, good, toxic, fails[o[s.i]] AS fails_here,
    len(list_filter(o[1:s.i - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM counted, o, f s),
steps AS (
  SELECT part, o, step, coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails_here), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails_here), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone AND fails_here), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails_here), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails_here), 0)::BIGINT AS toxic_lost
  FROM removed GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, step::INTEGER AS step, kept, removed,
  redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, o[step])::BIGINT AS shapley
FROM steps
"""


@query
def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents with an end id, decoded again; digests of both."""
    rows = pieces.encode(documents(spark, sf_dir), tokens.public_path(PIECE_VOCABULARY), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
