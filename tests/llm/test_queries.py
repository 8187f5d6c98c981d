"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import glob
import hashlib
import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.llm import license_scan, sp_sample
from tallyspark.llm.oracles import ORACLES
from tallyspark.llm.queries import QUERIES, TOKENIZER
from tests.llm.test_license_scan import plain_matches
from tests.llm.test_lm_score import plain_scores
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_span_dedup import plain_spans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns) and has_columns(df, name)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


CONTRACTS = {
    "op1_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
                    "score double",
    "op2_license_scan": "doc_id bigint",
    "op3_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                         "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_sentencepiece": "doc_id bigint",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_span_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


def test_all_are_registered():
    assert set(QUERIES) == set(CONTRACTS)
    assert set(QUERIES) | {"pipeline"} <= entry.queries().keys()


def has_columns(df, name):
    types = dict(df.dtypes)
    return all(types[c.split()[0]] == c.split()[1] for c in CONTRACTS[name].split(", "))


# Queries without SQL, against brute force over the whole table.


@pytest.fixture(scope="module")
def documents(db):
    return db.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def collected(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert has_columns(df, name)
    return df.collect()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_lm_scores(spark, documents):
    want = plain_scores([(i, t, crc(i) % 7 != 2) for i, t, _ in documents], 2)
    got = {r.doc_id: r for r in collected(spark, "op1_lm_score")}
    assert len(got) == len(documents)
    for (i, _, _), (n_tokens, n_known, total, base, score) in zip(documents, want):
        row = got[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (crc(i) % 7 == 2, n_tokens, n_known, total)
        assert row.base_score == pytest.approx(base) and row.score == pytest.approx(score)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_licenses(spark, documents):
    scanner = license_scan.Scanner()
    want = {i: plain_matches(scanner, t) for i, t, _ in documents}
    got = {r.doc_id: [license_scan.Match(*m) for m in r.matches] for r in collected(spark, "op2_license_scan")}
    assert got == want and any(want.values())


def test_languages(spark, documents):
    got = {r.doc_id: r for r in collected(spark, "op5_language_id")}
    assert len(got) == len(documents)
    held = [(got[i], lang) for i, _, lang in documents if crc(i) % 5 == 0]
    assert all(got[i].held_out == (crc(i) % 5 == 0) for i, _, _ in documents)
    right = sum(row.lang_pred == lang for row, lang in held if row.lang_pred != "und")
    assert right >= 0.9 * len(held)
    for i, text, _ in documents:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= got[i].score <= 1


def test_segmentations(spark, documents):
    rows = collected(spark, "op8_sentencepiece")
    ids = {}
    for r in rows:
        assert r.round_trip and r.n_pieces == len(r.ids) and 0 < r.inclusion <= 1
        ids.setdefault(r.doc_id, []).append(tuple(r.ids))
    texts = sp_sample.load_vocabulary(TOKENIZER).texts
    for i, text, _ in documents:
        assert len(set(ids[i])) == len(ids[i]) == (2 if text else 1)
        assert {b"".join(texts[p] for p in path)[1:].decode() for path in ids[i]} == {text or ""}


def test_repeated_spans(spark, documents):
    want = plain_spans([t for _, t, _ in documents], 200)
    got = {r.doc_id: r for r in collected(spark, "op11_span_dedup")}
    assert len(got) == len(documents) and any(want)
    for (i, text, _), spans in zip(documents, want):
        data, row = (text or "").encode(), got[i]
        kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)]))
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(data), len(data) - len(kept), len(spans))
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest() and [tuple(s) for s in row.spans] == spans


def test_near_duplicates(spark, documents):
    prints = [plain_fingerprint(t) for _, t, _ in documents]
    roots = plain_components(prints, 4)
    want = {i: (f"{p:016x}", documents[r][0]) for (i, _, _), p, r in zip(documents, prints, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in collected(spark, "op10_simhash")} == want
