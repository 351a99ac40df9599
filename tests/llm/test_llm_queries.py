"""The queries over whole tables of a small scale, and the pipeline stage by stage."""

import collections
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from conftest import TESTDATA
from winfleet.llm.queries import ORACLES, QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op2_ranked_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_iblt_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5_order_minhash": ["doc_id", "class_id", "kept"],
    "op7_composite_text_density": ["page_id", "url", "text", "n_chars"],
    "op9_hyperdimensional_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_entropy_balancing": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_returns_a_row_for_each_row(spark, name):
    table = "pages" if "page_id" in COLUMNS[name] else "documents"
    got = QUERIES[name](spark, SF_DIR)
    assert got.columns == COLUMNS[name]
    assert got.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    wanted = connection.execute(ORACLES[name]).fetch_df()
    got = QUERIES[name](spark, SF_DIR).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns) and len(got) == len(wanted)

    key = ("page_id" in columns and "page_id") or ("vec_id" in columns and "vec_id") or "doc_id"
    for a, b in zip(got.sort_values(key)[columns].itertuples(index=False), wanted.sort_values(key)[columns].itertuples(index=False)):
        assert [None if pd.isna(v) else v for v in a] == [None if pd.isna(v) else v for v in b]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_hyperdimensional_language"](spark, f"{TESTDATA}/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97


def test_article_text_is_what_the_page_marks(spark):
    for row in QUERIES["op7_composite_text_density"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = row.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        import html

        lines = [" ".join(html.unescape(part).split()) for part in re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inside))]
        assert row.text == "\n".join(line for line in lines if line)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(corpus_pipeline.COLUMNS).union(odd)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), SF_DIR)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert sizes[0] == 200 and sizes[1] < 200 and sizes[1] >= sizes[2]
    mixed = spark.read.parquet(str(tmp_path / "packing"))
    taken = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert docs.agg({"piece_words": "sum"}).first()[0] == taken
    before = spark.read.parquet(str(tmp_path / "mixing")).collect()
    assert len({r.text for r in before}) == len(before)
    windows = collections.Counter(x for w in (WORD.findall(r.text) for r in before) for x in {tuple(w[i : i + 13]) for i in range(len(w) - 12)})
    assert sum(n > 1 for n in windows.values()) <= 0.001 * len(windows)


def test_pipeline_run_gives_the_same_twice(spark):
    rows = lambda: sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "piece_words").collect())
    assert rows() == rows()
