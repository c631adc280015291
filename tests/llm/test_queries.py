"""The registered queries with SQL give DuckDB's rows, the others those of plain versions (op6: in test_operators)."""

import hashlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tokenloom.llm import pii, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same_rows(duck, spark, name, SF)


def same_rows(duck, spark, name, folder):
    df = queries.queries()[name](spark, folder)
    result = duck.execute(queries.oracle_sql()[name])
    theirs, names = [d[0] for d in result.description], sorted(df.columns)
    assert sorted(theirs) == names
    want = sorted(tuple(str(r[theirs.index(n)]) for n in names) for r in result.fetchall())
    got = sorted(tuple(str(r[n]) for n in names) for r in df.collect())
    assert len(got) == len(want) and [x for x in zip(got, want, strict=True) if x[0] != x[1]][:2] == []


#: What sf0.001 has none of: IBANs before and behind other words, context for and against, bounds of every kind.
PERSONAL = [
    None,
    "",
    "IBAN: BE68 5390 0754 7034 BIC: GEBABEBB, ES91 2100 0418 4502 0005 1332 EUR and DE89370400440532013000.",
    "AB12 3456 BE68 5390 0754 7034 BE68 5390 0754 7035 GB82 WEST 1234 5698 7654 32",
    "BE68539007547034 BE68539007547034xBE68539007547034 account",
    "visa 4111 1111 1111 1111, order 4111111111111112, 4111-1111-1111-1111 example; 12345678901234 00000000000000000000",
    "Téléphone +33 1 23 45 67 89 ou +1 (555) 010-9999, isbn +978 3 16 148410 0, +123456789",
    "host 10.0.0.1 version 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4 999999999999999999999.1.1.1",
    "mail a.b@c.d.e. @x.y a@b c@d.e@f.g ü@ä.de contact: %+-@-.- é𝄞 z@y.x",
]


def test_planted_personal_data(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(duck, spark, "op10_pii", str(tmp_path))
    spans = [x for r in queries.op10_pii(spark, str(tmp_path)).collect() for x in r.spans.split(",")]
    assert {k: sum(x.startswith(k) for x in spans) for k in pii.KINDS}["iban"] == 6


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_simhash(spark, documents):
    ids = list(documents)
    prints = [brute.simhash(documents[i]) for i in ids]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, brute.linked(ids, prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()} == want


def test_token_ids(spark, documents):
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for i in sorted(documents):
        ids = brute.ids_of(tokenizer, documents[i])
        want[i] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_ids(spark, SF).collect()} == want


def test_packing(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    brute.check_packing([r.asDict() for r in queries.op9_packing(spark, SF).collect()], {i: brute.ids_of(tokenizer, t) for i, t in documents.items()})


def test_pii(spark, documents):
    rows = {r.doc_id: r for r in queries.op10_pii(spark, SF).collect()}
    assert rows.keys() == documents.keys()
    for i, text in documents.items():
        base = brute.private(text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[i]
        assert tuple(r[f"n_{k}"] for k in pii.KINDS[:4]) == tuple(sum(k == x for x, _, _ in base) for k in pii.KINDS[:4])
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        spans = [x.rsplit(":", 2) for x in r.spans.split(",") if x]
        assert [x for x in spans if x[0] != "iban"] == [[k, str(a), str(b)] for k, a, b in base]
        assert {(int(a), int(b)) for k, a, b in spans if k == "iban"} == set(pii.ibans(text or ""))
        assert r.scores == ",".join(f"{pii.score(text, int(a), int(b), k):.2f}" for k, a, b in spans)
