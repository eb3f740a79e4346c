"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import chat, conversation_repair, decontaminate, exact_dedup, filter_audit, gated_lm, langid, line_dedup, mixing, passages, simhash, token_planes, toxicity
from draftlake.llm.common import Scratch, table

Run = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.grade_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


def op4_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_repeated_lines(table(spark, folder, "documents")))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), f"{Scratch(spark).root}/tokens"
    token_planes.write_tokens(docs, path, vocabulary())
    return token_planes.read_tokens(spark, path, with_ids=False)


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, folder, "conversations"))


def op13_gated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return gated_lm.score(table(spark, folder, "documents"))


QUERIES: dict[str, Run] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_mix_sources,
        op3_chat_format,
        op4_paragraph_dedup,
        op5_exact_dedup,
        op6_simhash,
        op7_language_id,
        op8_line_dedup,
        op9_decontaminate,
        op10_token_planes,
        op11_filter_audit,
        op12_conversation_repair,
        op13_gated_lm,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": r"""
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        placed AS (
            SELECT *, row_number() OVER w AS place,
                   list(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')) OVER w AS said
            FROM turns
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''),
                         (role IS NOT NULL)::int * 2 + (text IS NOT NULL)::int
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        sizes AS (SELECT conv_id, max(place) AS n_turns FROM placed GROUP BY conv_id),
        ends AS (
            SELECT p.said, s.n_turns, min(p.conv_id) AS conv_id, count(*) AS n_copies
            FROM placed p JOIN sizes s ON p.conv_id = s.conv_id AND p.place = s.n_turns GROUP BY p.said, s.n_turns),
        inner_prefixes AS (
            SELECT DISTINCT p.said FROM placed p JOIN sizes s ON p.conv_id = s.conv_id AND p.place < s.n_turns),
        kept AS (SELECT e.* FROM ends e WHERE NOT EXISTS (SELECT 1 FROM inner_prefixes i WHERE i.said = e.said))
        SELECT p.conv_id, k.n_turns, k.n_copies, p.place,
               '<|im_start|>' || coalesce(p.role, '') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10) AS rendered
        FROM placed p JOIN kept k USING (conv_id)""",
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op8_line_dedup": r"""
        WITH parts AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM parts),
        shared AS (
            SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        marked AS (SELECT k.*, coalesce(k.doc_id > s.holder, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op11_filter_audit": r"""
        WITH said AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        read AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        marked AS (
            SELECT r.part, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic,
                   (len(words) < 50)::int AS a,
                   (100 * len(list_distinct(words)) < 65 * len(words))::int AS b,
                   (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body))::int AS c,
                   regexp_matches(body, '[#$%&*|]')::int AS d,
                   coalesce(r.doc_id > min(r.doc_id) OVER (PARTITION BY body), false)::int AS e
            FROM read r LEFT JOIN said s ON r.doc_id = s.doc_id),
        cells AS (
            SELECT part, [a, b, c, d, e] AS bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM marked GROUP BY ALL),
        letters AS (SELECT unnest(range(1, 6)) AS x),
        orders AS (
            SELECT [p.x, q.x, r.x, s.x, t.x] AS axes
            FROM letters p, letters q, letters r, letters s, letters t
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (
            SELECT axes, array_to_string([substr('ABCDE', a::int, 1) for a in axes], '') AS filter_order, k.x AS step, axes[k.x] AS own,
                   axes[:k.x - 1] AS earlier
            FROM orders, letters k),
        laid AS (
            SELECT part, filter_order, step, own, n, good, toxic, bits[own] = 1 AS fails,
                   len([f for f in earlier if bits[f] = 1]) > 0 AS gone, list_sum(bits) = 1 AS alone
            FROM cells, steps),
        counted AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::bigint AS kept,
                   coalesce(sum(n) FILTER (NOT gone AND fails), 0)::bigint AS removed,
                   coalesce(sum(n) FILTER (gone AND fails), 0)::bigint AS redundant,
                   coalesce(sum(n) FILTER (fails AND alone), 0)::bigint AS unique_fails,
                   coalesce(sum(good) FILTER (NOT gone AND fails), 0)::bigint AS good_lost,
                   coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::bigint AS toxic_lost
            FROM laid GROUP BY ALL)
        SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, own)::bigint AS shapley
        FROM counted""",
}
