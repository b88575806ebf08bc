"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trailforge.llm import bpe, line_dedup, mixing, near_text, near_vectors, quality, queries, sharding, token_files, toxicity, url_filter

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp int, score string, n_lines int, size int, hash int, shard string, _id int, _y int, ids int, kept string, n int"
EXTRA = ("x", 1, "s", 2, 3, 4, "t", 5, 6, 7, "k", 8)
LONG = "word " * 60_000
TEXTS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, LONG, None, "a"), (4, "a b c d e f g h i j k l", "en", "b"), (4, "a b c d e f g h i j k l", "en", "b"),
    (None, "a b c d e f g h i j k l", "en", "b"), (5, " \t\n\n ", "en", "c"), (6, "A b C d e f g h i j k L", "en", None), (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, 7, *EXTRA) for t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 1, 1), (4, 1, 0), (4, None, None), (None, 1, 1), (6, 0, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_near_text(docs, none):
    rows = {(r.doc_id, r.fp): r.component_id for r in near_text.near_duplicates(docs).collect()}
    assert near_text.near_duplicates(docs).count() == len(TEXTS)
    assert rows[1, 0] == rows[2, 0] == rows[5, 0] == 1
    same = near_text.simhash("a b c d e f g h i j k l")
    same -= (same >> 63) << 64
    assert rows[4, same] == rows[6, same] == rows[None, same] == 4
    assert near_text.near_duplicates(none).count() == 0
    kept = near_text.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4]
    assert near_text.keep_one(none).count() == 0


def test_line_dedup(docs, none):
    out = {r.doc_id: r for r in line_dedup.drop_frequent_lines(docs, least_docs=3).collect()}
    assert out[4].kept_text == "" and out[4].n_dropped == 1 and out[6].kept_text == "" and out[3].kept_text == LONG
    assert out[2].n_lines == out[1].n_lines == 1 and out[1].kept_text == "" and out[5].kept_text == " \t\n\n "
    assert out[1].key == "x" and line_dedup.drop_frequent_lines(docs).count() == len(TEXTS)
    assert line_dedup.drop_frequent_lines(none).count() == 0
    everything = {r.doc_id: r for r in line_dedup.drop_frequent_lines(docs, least_docs=1).collect()}
    assert everything[5].n_dropped == 0 and everything[3].kept_text == "" and everything[3].n_dropped == 1


def test_line_keys_keep_other_white_space(spark):
    """Marks that some patterns take for line ends are part of a key; a long list of frequent lines gives the same rows."""
    odd = [f"Same line {c}" for c in "\x85\u2028\u2029\xa0\x1c"] + [f"Same line{c}" for c in "\x85\u2028\u2029\xa0\x1c"]
    texts = [t for t in odd for _ in range(6)] + ["\r\n x \r", "X", "\x0bx\x0c"] * 4 + ["y\n\n\n Y", "y\x85\n z"] * 10 + [None, "", "\n", "\n\n"]
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, n_lines int").repartition(3)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    want = sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.ORACLES['op10_line_dedup']})").fetchall())
    assert sum(r[2] for r in want) == 12 + 40
    for most in (10, -1):
        found = line_dedup.drop_frequent_lines(table, most_shared=most).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
        assert sorted(map(tuple, found.collect())) == want


def test_line_runs(spark):
    """Levels, and batches anti-joined with what any run has settled, level 0 included."""
    runs = line_dedup.LineRuns(spark, 3)
    batch = lambda *rows: spark.createDataFrame([(h, h + 1, n) for h, n in rows], "h1 bigint, h2 bigint, n bigint")
    runs.add(batch((1, 2), (1, 1), (2, 1), (3, 2)))
    assert [len(x) for x in runs.levels] == [1]
    assert [r.h1 for r in runs.unsettled(batch((1, 1), (2, 1)).select("h1", "h2", "n")).collect()] == [2]
    for k in range(2, 6):
        runs.add(batch((1, 9), (2, 1 if k < 3 else 0), (3, 1 if k == 5 else 0)))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    tables = runs.all_runs()
    assert sorted(r.h1 for r in runs.frequent().collect()) == [1, 3]
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_bpe(docs, none):
    rows = bpe.encode_docs(docs, MULTI, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r.doc_id in (1, 2):
            assert r.n_tokens == 0 and r.decoded == b""
        if r.doc_id == 3:
            assert bytes(r.decoded) == LONG.encode()
    assert bpe.encode_docs(none, MULTI, public_tokenizers.PATTERN).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(TEXTS) and {r.slot for r in rows} == {0}
    assert len({r.shard for r in rows}) == len(TEXTS)
    assert {r.size for r in rows if r.doc_id == 1} == {1} and {r.text_crc32 for r in rows if r.doc_id in (1, 2)} == {0}
    assert {r.text_crc32 for r in rows if r.doc_id == 4} == {zlib.crc32(b"a b c d e f g h i j k l")}
    assert sharding.shard_documents(none).count() == 0
    two = sharding.shard_documents(docs, shards=2).collect()
    assert sorted(r.slot for r in two if r.shard == 0) == list(range(5))


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    rows = quality.judge(docs, model).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.base_failed for r in rows if r.doc_id in (1, 2, 3, 5))
    assert all(not r.base_failed for r in rows if r.doc_id in (4, 6))
    assert quality.judge(none, model).count() == 0
    assert quality.judge(docs, quality.train(none, labels)).count() == len(TEXTS)
    assert quality.judge(docs, quality.train(docs, labels.limit(0))).count() == len(TEXTS)


def test_toxicity(docs, none, labels):
    model = toxicity.character_model(docs)
    learned = toxicity.train(docs, labels, model)
    rows = toxicity.score(docs, model, learned).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, toxicity.character_model(none), toxicity.train(none, labels, model)).count() == 0
    assert toxicity.score(docs, model, toxicity.train(docs, labels.limit(0), model)).where("score >= 0.5").count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (None, "http://A.example.NET/en/x?q#f", "h"), (4, "https://example.net", "h"), (5, "https://example.net/en", "h"), (5, "x://b.org/fr/?a", "h"), (6, "no scheme", "h"), (7, "ftp://.net/", "h"), (8, "http://net" + "/a" * 50_000, "h")], "page_id bigint, url string, host string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("", "/", "block"), ("net", "/", "block")], "host string, path string, verdict string")
    rows = [(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()]
    assert len(rows) == 9
    assert (None, "a.example.net", "example.net/en/", "allow") in rows
    assert (4, "example.net", None, "allow") in rows and (5, "example.net", "net/", "block") in rows
    assert (5, "b.org", "org/fr/", "allow") in rows and (1, "", None, "allow") in rows and (7, ".net", "net/", "block") in rows and (8, "net", "net/", "block") in rows
    extra = pages.select("*", F.lit("p").alias("path"), F.lit("r").alias("rule"), F.lit("v").alias("verdict"), F.lit(1).alias("row"), F.lit(2).alias("key"))
    assert sorted([(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge(extra, rules).collect()], key=str) == sorted(rows, key=str)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 9


def test_digests_confirm_strings():
    import numpy as np

    array = url_filter.DigestArray(np.array([5, 5, 9], np.uint64), [b"a", b"b", b"c"])
    assert array.probe(np.array([5, 5, 9, 7], np.uint64), [b"b", b"x", b"c", b"a"]).tolist() == [True, False, True, False]


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(r["size"] * r.copies <= 3 * r["size"] for r in rows)
    assert sum(r["size"] for r in rows) == 60_000 + 12 * 4
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    drawn = {}
    for r in rows:
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + r.copies
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    found = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert found == {k: v for k, v in drawn.items() if v}


def test_token_files(docs, none):
    folder, files = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), docs_per_task=2)
    rows = sorted(token_files.read_token_files(folder, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6]
    at = 0
    for r in rows:
        assert r.start == at and r.ids[-4:] == b"\0\0\0\0" and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    folder, files = token_files.write_token_files(none, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(folder, files).count() == 0


def test_vectors(spark):
    x, nan, inf = [1.0, 0.0, 2.0], float("nan"), float("inf")
    rows = [(1, x, 1), (2, x, 1), (3, [2.0, 0.0, 4.0], 1), (4, x, 2), (5, x, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 0.0, 2.0], 1), (9, [inf, 0.0, 2.0], 1), (10, [1.0, None, 2.0], 1), (11, [1.0, 0.0], 1), (12, [], 1), (None, x, 1), (13, x, 1), (13, x, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(table).collect()]
    assert len(out) == len(rows)
    for row in [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (None, 5, 1, False), (13, 5, 1, False)]:
        assert row in out
    for k in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert (k, 0, k, True) in out
    assert near_vectors.near_duplicates(table.limit(0)).count() == 0
    far = [(1, [1e200, 2e200], 1), (2, [2e200, 4e200], 1), (3, [1e-200, 2e-200], 1), (4, [-0.0, 1.0], 1), (5, [0.0, 1.0], 1)]
    table = spark.createDataFrame([(*r, "x", 7, 8, 9) for r in far], "vec_id bigint, embedding array<double>, label int, same string, n_links int, component_id int, filters int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(table).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_stages_keep_columns(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "byte_bpe":
                assert now.columns == docs.columns, name
        assert "doc_id" in now.columns and now.count() >= 0
    digest = hashlib.sha256(b"").hexdigest()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("text is null"), "").where(F.col("decoded_sha256") == digest).count() == 2


def test_token_files_of_two_row_orders(spark):
    """Rows with null and repeated keys: the files hold the same bytes in whatever order the rows arrive."""
    rows = [(k, f"{w} {w} text {i}") for i, w in enumerate(("b", "a", "d", "c", "z")) for k in (None, 7, i)] + [(None, None), (7, ""), (7, "b b text 0")]

    def files(table):
        folder, listed = token_files.write_token_files(table, public_tokenizers.path("byte_bpe_50k.json"), ids_per_file=20, docs_per_task=6)
        return {r.file: zlib.crc32(open(f"{folder.removeprefix('file://')}/{r.file}", "rb").read()) for r in listed.collect()}

    one, two = (spark.createDataFrame(r, "doc_id bigint, text string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert files(one) == files(two) and len(files(one)) > 4


def test_rows_alike_are_told_apart(spark):
    """Counts below, at and above a block, and of none; then a mix of many equal null rows."""
    counts = {"a": 1, "b": 4, "c": 5, "d": 23, None: 8}
    table = spark.createDataFrame([(k, n) for k, n in counts.items()], "id string, alike bigint")
    got = [(r.id, r.nth) for r in mixing._told_apart(table, block=4).collect()]
    assert sorted(got, key=str) == sorted(((k, i) for k, n in counts.items() for i in range(1, n + 1)), key=str)
    rows = spark.range(300_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b").alias("text"), F.lit(None).cast("string").alias("source"))
    more = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(rows.union(more)).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    assert {r.source: r.n for r in mixed} == {None: 300_000, "s": 100}
    assert all(abs(r.taken - r.target) <= 3 for r in mixed)
