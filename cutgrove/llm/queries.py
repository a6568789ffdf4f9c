"""The queries that apply each operator to its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anagrams, bpe, chat, decontaminate, hnsw, html, intervals, lang_masks, near_dups, ngram_bloom, pii, quality, url_rules
from .common import table

#: The rules of op10: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
CONTROL = "\\### Assistant: </turn> ok"
RANKS = "byte_bpe_50k.tiktoken"


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_bloom.score_documents(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_trees(chat.linear_messages(rows))
    turns = F.slice(F.split("formatted", "</turn>\n", -1), 1, F.size(F.split("formatted", "</turn>\n", -1)) - 1)
    said = F.transform(turns, lambda s: F.concat(
        chat.unescape(F.substring_index(F.substr(s, F.lit(len(chat.HEAD) + 1)), chat.MID, 1)), F.lit("\n"),
        chat.unescape(F.substr(s, F.instr(s, chat.MID) + len(chat.MID))), F.lit("\n")))
    learnt = F.array_join(F.transform("loss_spans", lambda p: chat.unescape(F.substr(F.col("formatted"), p["start"] + 1, p["len"]))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # items under the operator's least length are reported too, flagged: the pipeline removes no document for those
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), url_rules.RULE_SCHEMA)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anagrams.spelling_groups(anagrams.word_counts(table(spark, sf_dir, "documents"), divisor=199))


def op12_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sale_relations(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clicks"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    may_learn = lang_masks.learned(F.col("doc_id"))
    out = lang_masks.identify(docs, lang_masks.train(docs.filter(may_learn)))
    return out.select("doc_id", (~may_learn).alias("held_out"), "lang_pred", "score")


#: crc32 of the decimal or UTF-8 bytes of a text, as DuckDB has no such function; ``tab`` comes from CRC_TABLE.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text expression of code points up to U+00FF, next to a table with ``tab``."""
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [(192 + (ord(x) >> 6))::BIGINT, 128 + (ord(x) & 63)] END))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {utf8}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


QUERIES = {"op1_html": op1_html, "op2_lm_score": op2_lm_score, "op3_chat": op3_chat, "op4_bpe": op4_bpe, "op5_decontaminate": op5_decontaminate, "op6_hnsw": op6_hnsw, "op7_quality": op7_quality, "op8_near_dups": op8_near_dups, "op9_pii": op9_pii, "op10_url_rules": op10_url_rules, "op11_spelling": op11_spelling, "op12_intervals": op12_intervals, "op13_language": op13_language}

ORACLE = {
    "op3_chat": r"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
          SELECT *, length(text) + len(regexp_extract_all(text, '[\\#<:]')) + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + 14 AS chars FROM rows)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op10_url_rules": """
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1, 's') AS path FROM cut),
        rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        hit AS (SELECT p.*, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
                FROM parts p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE n = 1""",
    "op11_spelling": f"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (SELECT id, run, count(*) AS n FROM (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY id, run),
        hashed AS (SELECT run, n, {crc_sql("(id || ':' || run)")} AS h FROM runs, crc_table),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS near, max(other_n) AS near_n FROM pairs GROUP BY word),
        formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
        steps AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL UNION ALL SELECT steps.word, formed.form FROM steps JOIN formed ON formed.word = steps.root WHERE formed.form IS NOT NULL),
        last AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL)
        SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f LEFT JOIN last l USING (word)""",
    "op12_intervals": f"""
        WITH {CRC_TABLE},
        seen AS (SELECT client_id, epoch_us(ts) AS t, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS buys FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
        marked AS (SELECT *, coalesce(t - lag(t) OVER w > 600000000, true) AS begins FROM seen WINDOW w AS (PARTITION BY client_id ORDER BY t)),
        numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY client_id ORDER BY t) AS nr FROM marked),
        met AS (SELECT client_id, min(t) AS first, max(t) AS last, arg_max(buys, t) = 1 AS open FROM numbered GROUP BY client_id, nr),
        met_slots AS (SELECT client_id, first // 3600000000 AS s, CASE WHEN open THEN 1000000000000 ELSE last // 3600000000 END AS e, {crc_sql("first::VARCHAR")} AS crc FROM met, crc_table),
        shipped AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped, bool_or(shipped_at IS NULL) AS open FROM sale_lines GROUP BY sale_id),
        sold AS (SELECT sale_id, client_id, epoch_us(sold_at) // 3600000000 AS s,
                   CASE WHEN coalesce(open, false) THEN 1000000000000 ELSE greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) // 3600000000 END AS e
                 FROM sales LEFT JOIN shipped USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
        pairs AS (SELECT sale_id, crc, CASE WHEN a.e = 1000000000000 AND b.e = a.e THEN NULL ELSE least(a.e, b.e) - greatest(a.s, b.s) + 1 END AS shared,
                    CASE WHEN a.s < b.s THEN (CASE WHEN a.e < b.e THEN 'overlaps' WHEN a.e = b.e THEN 'finished_by' ELSE 'contains' END)
                         WHEN a.s = b.s THEN (CASE WHEN a.e < b.e THEN 'starts' WHEN a.e = b.e THEN 'equals' ELSE 'started_by' END)
                         ELSE (CASE WHEN a.e < b.e THEN 'during' WHEN a.e = b.e THEN 'finishes' ELSE 'overlapped_by' END) END AS relation
                  FROM sold a JOIN met_slots b ON a.client_id = b.client_id AND a.s <= b.e AND b.s <= a.e)
        SELECT sale_id, relation, count(*)::BIGINT AS n_pairs, sum(shared)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM pairs GROUP BY sale_id, relation""",
}
