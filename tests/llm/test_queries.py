"""Every query over small tables: its columns, one row where one is due, and what the operators' own tests don't see."""

import hashlib
import re
import zlib
from datetime import datetime, timedelta

import pytest

from cutgrove.llm import ngram_bloom, queries

from .test_llm import components_by_force, made

COLUMNS = {
    "op1_html": {"page_id", "url", "text", "n_chars"},
    "op2_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op4_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_decontaminate": {"doc_id", "item_id", "short"},
    "op6_hnsw": {"vec_id", "n_links", "component_id", "kept"},
    "op7_quality": {"doc_id", "held_out", "score", "predicted"},
    "op8_near_dups": {"doc_id", "n_shingles", "component_id", "kept"},
    "op9_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10_url_rules": {"page_id", "host", "path", "rule", "verdict"},
    "op11_spelling": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_intervals": {"sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"},
    "op13_language": {"doc_id", "held_out", "lang_pred", "score"},
}
CHAT = [(1, 0, "user", "Hi: #1"), (1, 1, "assistant", "a<b\\h"), (2, 0, None, None), (None, 0, "assistant", "lost?"), (3, 0, "assistant", ""), (3, 1, "assistant", "x</turn>\n### y")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = made(80, 40, 90)
    texts += [texts[0], texts[1] + " end", None, "", "mail a@b.example pay 4111 1111 1111 1111 from 10.0.0.1", "Before. " + "the benchmark item that some page has copied word by word here" + " after."]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(i, int(i % 2 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    write("embeddings", [(i, [float(i % 5), 1.0, 0.5], 0) for i in range(20)] + [(50, None, 1)], "vec_id long, embedding array<float>, label int")
    write("pages", [(1, "http://a.Example.com/en/7x?q", "<article><h1>T</h1><p>One two three.</p></article><footer>&copy; me</footer>"), (2, None, None), (3, "nothing", "")], "page_id long, url string, html string")
    write("benchmark", [(5, "The benchmark item that some page has copied word by word here"), (6, "ab")], "item_id long, text string")
    at = lambda m: datetime(2024, 2, 28, 22) + timedelta(minutes=m)
    write("clicks", [(i, at(7 * i + (90 if i % 9 > 5 else 0)), i % 4 or None, "purchase" if i % 5 == 0 else "view") for i in range(120)] + [(900, None, 1, "view")], "click_id long, ts timestamp_ntz, client_id long, kind string")
    write("sales", [(i, i % 4 or None, at(23 * i)) for i in range(60)] + [(77, 1, None), (5, 1, at(9))], "sale_id long, client_id long, sold_at timestamp_ntz")
    write("sale_lines", [(i % 50, k, at(23 * i + 400 * k) if (i + k) % 7 else None) for i in range(70) for k in range(2)], "sale_id long, line_no int, shipped_at timestamp_ntz")
    write("conversations", CHAT, "conv_id long, turn long, role string, text string")
    return path, docs


def rows(spark, tables, name):
    df = queries.QUERIES[name](spark, tables[0])
    assert COLUMNS[name] <= set(df.columns)
    return df.collect()


def test_all_queries_are_known():
    assert set(queries.QUERIES) == set(COLUMNS)


def test_html_query(spark, tables):
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows(spark, tables, "op1_html")) == [(1, "T\nOne two three.", 16), (2, "", 0), (3, "", 0)]


def test_lm_query(spark, tables):
    got = rows(spark, tables, "op2_lm_score")
    assert len(got) == len(tables[1]) and all(r.held_out == ngram_bloom.held_out(r.doc_id) and r.score < 0 for r in got)


def test_chat_query_reads_back(spark, tables):
    control = "\\### Assistant: </turn> ok"
    conversations: dict = {}
    for c, t, role, text in [*CHAT, (-7, 0, "user", control), (-7, 1, "assistant", control)]:
        conversations.setdefault(c, []).append((t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in conversations.items():
        loss = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        want[c] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in sorted(turns))), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows(spark, tables, "op3_chat")}
    assert got == want


def test_bpe_query(spark, tables):
    import public_tokenizers

    from cutgrove.llm import bpe

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path(queries.RANKS)), public_tokenizers.PATTERN).bpe  # the library itself
    for r in rows(spark, tables, "op4_bpe"):
        t = tables[1][r.doc_id][1] or ""
        ids = codec.encode_ordinary(t)
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(t.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_leak_query(spark, tables):
    got = rows(spark, tables, "op5_decontaminate")
    assert [(r.doc_id, r.item_id) for r in got if not r.short] == [(85, 5)]
    assert {(r.doc_id, r.item_id) for r in got if r.short} == {(i, 6) for i, t, *_ in tables[1] if t and "ab" in t.lower()}


def test_vector_query(spark, tables):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows(spark, tables, "op6_hnsw")}
    assert got[50] == (0, 50, True) and got[5] == got[10] == (3, 0, False) and len(got) == 21


def test_quality_query(spark, tables):
    got = rows(spark, tables, "op7_quality")
    assert len(got) == len(tables[1]) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_near_dup_query(spark, tables):
    want, sets = components_by_force([(i, t) for i, t, *_ in tables[1]], 85)
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows(spark, tables, "op8_near_dups")} == {i: (want[i], len(sets[i]), want[i] == i) for i in want}


def test_pii_query(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op9_pii")}
    assert len(got) == len(tables[1]) and (got[84].n_email, got[84].n_ip, got[84].n_card, got[84].n_phone) == (1, 1, 1, 0)
    assert got[84].base_sha256 == hashlib.sha256(b"email:5:16,ip:46:54,card:21:40").hexdigest() and got[82].spans == ""


def test_spelling_interval_and_language_queries(spark, tables):
    assert {r.word for r in rows(spark, tables, "op11_spelling")} and all(len(r.word) >= 6 and r.n >= 5 for r in rows(spark, tables, "op11_spelling"))
    assert sum(r.n_pairs for r in rows(spark, tables, "op12_intervals")) > 0
    got = rows(spark, tables, "op13_language")
    assert len(got) == len(tables[1]) and {r.lang_pred for r in got if not tables[1][r.doc_id][1]} == {"und"} and {r.lang_pred for r in got} == {"en", "und"}


def test_native_queries_against_sql(spark, tables):
    import duckdb

    con = duckdb.connect()
    for name in ("conversations", "pages", "documents", "clicks", "sales", "sale_lines"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables[0]}/{name}.parquet/*.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, tables[0])
        cols = sorted(df.columns)
        assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())), name


def test_queries_leave_the_session_as_it_was(spark, tables):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, spark.conf.get(batch))  # a default that is set to its own value counts as unchanged
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    for name in queries.QUERIES:
        queries.QUERIES[name](spark, tables[0])
    assert {k: v for k, v in ((r.key, r.value) for r in spark.sql("SET").collect()) if not re.match("spark.app|spark.checkpoint", k)} == {k: v for k, v in before.items() if not re.match("spark.app|spark.checkpoint", k)}
