"""One query per operator, over its whole table; what they return is what the checks compare."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.llm import bpe, chat, forest, html_text, language, lexical, minhash, mixing, negatives, packing, top_k, toxicity, url_rules
from textscore.llm.common import remainder, sample_per_class, table
from textscore.session import store

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PACKED_FILE = "byte_bpe_50k.json"
#: Labelled documents of each kind that toxicity is learned from, about.
TOXICITY_ROWS = 8000

#: Fixed values of the URL filter.
URL_RULES = [
    url_rules.Rule("block", "net", "/"),
    url_rules.Rule("allow", "example.net", "/en/"),
    url_rules.Rule("block", "example.com", "/de/"),
    url_rules.Rule("allow", "org", "/fr/"),
]


def language_model(docs: DataFrame) -> language.LanguageModel:
    """Learned from the documents whose number's crc32 leaves another rest than 2 by 4."""
    return language.fit(docs.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from a bounded sample of the labelled documents whose number's crc32 is no multiple of 5.

    The sample is drawn from the labels alone, so only its texts are read for good.
    """
    labelled = labels.where(remainder(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("labelled"), "toxic").where("toxic in (0, 1)").distinct()
    sample = sample_per_class(labelled, "toxic", "labelled", TOXICITY_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).drop("labelled")
    return toxicity.fit(store(texts, "labelled"), rows=TOXICITY_ROWS)


def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others, components as floor(64 x)."""
    vectors = table(spark, folder, "embeddings").where(top_k.usable(F.col("embedding")))
    whole = vectors.select(F.col("vec_id").alias("id"), top_k.floored(F.col("embedding"), 64).alias("vector"))
    return top_k.top_k(whole, whole.where("id % 20 = 0"), 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's links of cosine 0.9 or more and its class."""
    return forest.near_vectors(table(spark, folder, "embeddings"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by the learned lexicon."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, folder, "labels")), result="score")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language by decoding its predicted codeword."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    named = language.predict(docs.select("doc_id", "text"), language_model(docs))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return named.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by the rank file, its ids decoded again."""
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(BPE_FILE))


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL judged by the fixed rules, else by the mined ones."""
    return url_rules.judge(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, and read back from the output."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.examples(given.unionByName(control)))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces, packed into sequences."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(PACKED_FILE))


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item's 10 best documents."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's share in a mix of 1.5 times all words, sources weighing 3, 1, 2 in turn."""
    mixed = mixing.mix(table(spark, folder, "documents"), (3.0, 1.0, 2.0), 1.5, 2)
    return mixed.taken().select("doc_id", "size", "source_size", "target", "taken")


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """The hard negatives of every hundredth vector's five positives, components as floor(256 x)."""
    vectors = table(spark, folder, "embeddings").where(top_k.usable(F.col("embedding")) & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), top_k.floored(F.col("embedding"), 256).alias("vector"))
    return negatives.mine(whole, whole.where("id % 100 = 0"), 5, 10, 30, 90)


QUERIES = {
    f.__name__: f
    for f in (op1_top_k, op2_forest, op3_toxicity, op4_bag_minhash, op5_language, op6_html_text, op7_byte_bpe, op8_url_rules, op9_chat_examples, op10_packing, op11_lexical, op12_mixing, op13_negatives)
}
SQL = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op2_forest": """
        WITH RECURSIVE v AS (
            SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reached AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a
        ), classes AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
        ), counted AS (
            SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM classes LEFT JOIN counted USING (vec_id)
    """,
    "op9_chat_examples": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), numbered AS (
            SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
                length(role || text)
                    + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) + 6 AS written
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), summed AS (
            SELECT *, sum(written) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM numbered
        )
        SELECT conv_id,
            count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(so_far) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
        FROM summed GROUP BY conv_id
    """,
    "op11_lexical": r"""
        WITH cut AS (
            SELECT row_number() OVER () AS place, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), total AS (
            SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS documents, CAST(sum(len(terms)) AS BIGINT) AS words FROM cut
        ), asked AS (
            SELECT DISTINCT item_id,
                unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), occurring AS (
            SELECT place, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM cut
        ), counted AS (
            SELECT place, doc_id, n, term, count(*) AS tf FROM occurring WHERE term IN (SELECT term FROM asked) GROUP BY ALL
        ), weighed AS (
            SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, total GROUP BY term, documents
        ), scored AS (
            SELECT item_id, place, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // words)))) AS BIGINT) AS score
            FROM asked JOIN counted USING (term) JOIN weighed USING (term), total GROUP BY ALL
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_mixing": r"""
        WITH cut AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce('=' || source, ''), '|', md5(coalesce(text, ''))) AS given
            FROM documents
        ), named AS (
            SELECT doc_id, source, size, concat(md5(given), '|', row_number() OVER (PARTITION BY source, given)) AS unit FROM cut
        ), totals AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM named GROUP BY source
        ), weighed AS (
            SELECT *, CAST([3, 1, 2][1 + (place - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM totals
        ), filled AS (
            SELECT *,
                (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM weighed WINDOW before AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), chosen AS (
            SELECT min_by(level, (most / weight, place)) AS level FROM filled WHERE weight * level <= most
        ), aimed AS (
            SELECT source, source_size, least(most, weight * chosen.level) AS target, CAST(round(least(most, weight * chosen.level)) AS BIGINT) AS quota FROM weighed, chosen
        ), lines AS (
            SELECT unit, epoch, size, quota,
                epoch * source_size + coalesce(sum(size) OVER (PARTITION BY named.source, epoch ORDER BY md5(concat(unit, '|', epoch)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM named JOIN aimed ON named.source IS NOT DISTINCT FROM aimed.source, (VALUES (0), (1)) AS epochs(epoch)
        ), used AS (
            SELECT unit, CAST(sum(greatest(0, least(start + size, quota) - start)) AS BIGINT) AS taken FROM lines GROUP BY unit
        )
        SELECT doc_id, size, source_size, target, taken
        FROM named JOIN aimed ON named.source IS NOT DISTINCT FROM aimed.source JOIN used USING (unit)
    """,
    "op13_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
            FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM positives JOIN pairs USING (anchor_id)
            WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """,
}
