"""Each operator against its plain version, on texts with nulls, ties, repeats, long words and clashing columns."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm import brute
from tokenloom.llm import common, components, decontaminate, packing, pii, quality, queries, secret_scan, simhash, token_counts, token_ids, tokenizing, url_filters, warc
from tokenloom.llm.common import fresh_path

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
RNG = random.Random(5)
VOCABULARY = ["the", "of", "Straße", "été", "naïve", "re", "and", "data", "x1", "token=", "don't", "I'll", "U.S.", "(so)", "—", "日本", "😀", "ſ", "İ"]


def prose(n, rng=RNG):
    out = []
    for _ in range(n):
        w = "".join(rng.choice(["th", "er", "on", "an", "re", "é", "ß"]) for _ in range(rng.randrange(1, 5))) if rng.random() < 0.7 else rng.choice(VOCABULARY)
        out.append(w + rng.choice(["", "", "", "", ",", ".", ".\n", "!", "\n\n", "  ", "\t"]))
    return " ".join(out)


def odd_texts():
    long = prose(6000)
    base = prose(200)
    return [None, "", " \n\t ", "one", "a b c", base, base, base + " tail", base.upper(), long, "x" * 50000, "a " * 3000, "\x1c\x85 　 x y", "<|endoftext|> in <|startoftext|>", "foo   bar  \n baz \n\n\n end ", " lead", "tail ", "é combining Å", "a\r\nb\rc", *(prose(RNG.randrange(1, 300)) for _ in range(40))]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names operators use inside, and a repeated row."""
    rows = [(i, t, "n", 1, "d", 2.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, fp int, digest string, count double").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


def test_staged_tables_go_when_they_are_taken_in(spark):
    since = len(common.staged_paths())
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    found = components.components(edges)
    assert len(common.staged_paths()) == since + 1 and {r.root for r in found.collect()} == {0}
    common.release(spark)
    assert common.staged_paths() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ"):
        spark.read.parquet(found.inputFiles()[0]).count()


# url filters


def test_url_filters_as_of(spark):
    entries = [("a", "Bad.com", "add", "2024-01-10"), ("a", "bad.com", "remove", "2024-02-10"), ("a", "bad.com", "add", "2024-03-10"), ("b", "x.bad.com", "add", "2024-01-01"), ("b", "x.bad.com", "add", "2024-01-05"), ("c", "tie.org", "add", "2024-01-01"), ("c", "tie.org", "remove", "2024-01-01"), ("c", None, "add", "2024-01-01")]
    rows = [("http://www.bad.com/p", "2024-01-09"), ("https://u:p@x.bad.com:80/q", "2024-01-10"), ("http://BAD.com.", "2024-02-10"), ("http://bad.com", "2024-03-10"), ("http://notbad.com", "2024-01-20"), ("http://tie.org", "2024-01-02"), (None, "2024-01-20"), ("no host", "2024-01-20"), ("http://bad.com", None), ("http://bad.com", None)]
    captures = spark.createDataFrame([(i, u, f, "extra") for i, (u, f) in enumerate(rows)], "page_id long, url string, fetched string, list_name string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    log = spark.createDataFrame(entries, "list_name string, domain string, action string, at string")
    got = {r.page_id: (r.active_lists, r.n_active, r.blocked) for r in url_filters.as_of(captures, log).collect()}
    assert got == {0: ("", 0, False), 1: ("a,b", 2, True), 2: ("", 0, False), 3: ("a", 1, True), **{i: ("", 0, False) for i in range(4, 10)}}
    assert url_filters.as_of(captures.where("page_id > 99"), log).count() == 0
    assert url_filters.as_of(captures, log.where("1 = 0")).where("blocked").count() == 0
    with pytest.raises(ValueError):
        url_filters.as_of(captures.withColumn("Host", F.lit(1)), log)
    with pytest.raises(ValueError, match="block"):
        url_filters.as_of(captures, log.unionByName(spark.createDataFrame([("a", "x.org", "block", "2024-01-01")], log.schema)))


def test_url_entries_are_normalised(spark):
    entries = [("a", " Evil.COM. ", " ADD", "2024-01-10"), ("b", "site.org/private/", "add", "2024-01-01"), ("b", "http://other.org/x", "Add", "2024-01-01 00:00:00+02:00"), ("c", "[2001:DB8::1]", "add", "2024-01-01"), ("c", "user.net", "add", "2024-01-01T12:00:00Z"), ("d", "", "add", "2024-01-01")]
    urls = ["http://evil.com/", "https://a.evil.com.:443/x", "http://site.org/private", "http://www.site.org/private/a?b", "http://site.org/privateer", "http://site.org/", "http://other.org/xy", "http://other.org/x#y", "http://[2001:db8::1]:8080/p", "ftp://me:[x]@user.net/", "http://[broken/"]
    want = ["a", "a", "b", "b", "", "", "", "b", "c", "c", ""]
    captures = spark.createDataFrame([(i, u, 1705320000) for i, u in enumerate(urls)], "page_id long, url string, at long").select("page_id", "url", F.timestamp_seconds("at").alias("fetched"))
    log = spark.createDataFrame(entries, "list_name string, domain string, action string, at string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):  # entries without a zone are UTC whatever the session's
            spark.conf.set("spark.sql.session.timeZone", name)
            got = {r.page_id: r.active_lists for r in url_filters.as_of(captures, log).collect()}
            assert [got[i] for i in range(len(urls))] == want
            near = url_filters.as_of(captures.withColumn("fetched", F.timestamp_seconds(F.lit(1704844800 - 1))), log)  # a second before 2024-01-10 UTC
            assert [r.active_lists for r in near.where("page_id = 0").collect()] == [""]
            hashed = sorted(map(tuple, queries.op1_url_filters(spark, "/root/testdata/sf0.001").collect()), key=str)
            first = hashed if name == "UTC" else first
            assert hashed == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_entries_with_paths_against_brute_force(spark):
    import random
    from datetime import datetime

    rng = random.Random(3)
    hosts, parts = ["a.com", "x.a.com", "b.org"], ["", "p", "q", "P", "é", "p%20"]
    path = lambda most: "".join("/" + rng.choice(parts) for _ in range(rng.randrange(most)))
    entries = sorted({(rng.choice("lm"), rng.choice(hosts) + path(4), rng.choice(["add", "remove"]), f"2024-01-{rng.randrange(1, 9):02}") for _ in range(150)})
    captures = [(i, f"https://{rng.choice(hosts)}{path(7)}{rng.choice(['', '?x=/p', '#/q'])}", f"2024-01-{rng.randrange(1, 10):02}") for i in range(400)]
    captures += [(400, None, "2024-01-05"), (401, "no url", "2024-01-05"), (402, "https://a.com/p", None), (402, "https://a.com/p", None)]
    log: dict = {}
    for name, domain, action, at in entries:
        host, _, rest = domain.partition("/")
        log.setdefault((name, host, ("/" + rest).rstrip("/")), {}).setdefault(at, set()).add(action)
    want = []
    for i, url, at in captures:
        host, _, rest = (url or "").split("#")[0].split("?")[0].removeprefix("https://").partition("/")
        lies = "/" + rest
        active = []
        for (name, domain, prefix), turns in log.items() if at else ():
            past = [t for t in turns if t <= at]
            if past and turns[max(past)] == {"add"} and (host == domain or host.endswith("." + domain)) and (lies == prefix or lies.startswith(prefix + "/") or not prefix):
                active.append(name)
        want.append((i, len(active), ",".join(sorted(set(active)))))
    df = spark.createDataFrame(captures, "page_id long, url string, at string").select("page_id", "url", F.col("at").cast("timestamp").alias("fetched"))
    listed = spark.createDataFrame([(*e[:3], datetime.fromisoformat(e[3])) for e in entries], "list_name string, domain string, action string, at timestamp")
    got = [(r.page_id, r.n_active, r.active_lists) for r in url_filters.as_of(df, listed).collect()]
    assert sorted(got) == sorted(want) and 50 < sum(n > 0 for _, n, _ in got) < 350


# archive


def test_archive(spark):
    payloads = ["same", None, "", "a\r\n\r\nWARC/1.0\r\n\r\nb", "same", "tail\r\n", "\r\n\r\n", "é€" * 50000, "same", ""]
    rows = [(10 - i, f"http://h/{i}\r\nX: y" if i % 3 else None, p, "x") for i, p in enumerate(payloads)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    path = fresh_path(spark, "t-warc")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages, path).collect()}
    assert got == set(brute.archive([(r[0], r[2]) for r in rows]))
    full = {r.page_id: bytes(r.payload).decode() for r in warc.restored(warc.read(spark, path)).collect()}
    assert full == {r[0]: r[2] or "" for r in rows}
    header = {r.page_id: bytes(r.header).decode() for r in warc.read(spark, path).collect()}
    assert header[9].startswith("WARC/1.0\r\nWARC-Type: revisit\r\n") and "http://h/1%0D%0AX: y" in header[9]  # empty, as pages 1 and 8 are
    assert warc.archived(pages.where("page_id < 0"), fresh_path(spark, "t-warc")).count() == 0


def test_archive_ties_and_short_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (1, "u", "ab"), (2, "v", "ab"), (None, None, "ab"), (3, "w", "longer"), (4, "w", "longer")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archived(pages, fresh_path(spark, "t-warc")).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("3", "response", None), ("4", "revisit", 3), ("None", "response", None)]
    least = warc.archived(pages, fresh_path(spark, "t-warc"), least_bytes=3).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.payload_bytes) for r in least] == [(4, 6)]


def test_a_revisit_of_another_payload_is_found(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "c")], "page_id long, url string, html string")
    path = fresh_path(spark, "t-warc")
    warc.write(pages, path)
    records = warc.read(spark, path, payloads=False)
    assert sorted((r.page_id, r.payload_bytes, r.held_by) for r in warc.restored(records).collect()) == [(1, 2, None), (2, 2, 1), (3, 1, None)]
    for wrong in (records.withColumn("sha256", F.when(F.col("page_id") == 2, "0").otherwise(F.col("sha256"))), records.where("page_id <> 1")):
        with pytest.raises(Exception, match="refers to no response"):
            warc.restored(wrong).collect()


def test_a_changed_payload_is_found(spark):
    with pytest.raises(ValueError, match="digest"):
        warc._parsed(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Payload-Digest: sha1:A\r\nWARC-Payload-SHA256: 0", b"HTTP/1.1 200 OK\r\n\r\nx")


# near duplicates


def test_triples_cover_every_four_positions():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_fingerprints_and_components(docs, texts, nothing):
    fps = [brute.simhash(t) for t in texts]
    roots = brute.linked(list(range(len(texts))), fps)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], roots[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(nothing).count() == 0


def near_prints(n, seed=3):
    rng, out = random.Random(seed), []
    while len(out) < n:
        center = rng.getrandbits(64)
        out += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(rng.choice([1, 1, 5, 40, 200]))]
    return list(dict.fromkeys(out))[:n]


@pytest.mark.parametrize("cap", [64, 2048])
def test_links_of_dense_groups(spark, cap):
    """With the small cap lists are split again and again; no component may change."""
    prints = near_prints(900)
    hot = [prints[0] & ~0xFFFFFF | i for i in range(300)]  # one long list
    prints = list(dict.fromkeys(prints + hot))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r.node & (1 << 64) - 1: r.root for r in components.components(simhash.links(df, cap)).collect()}
    want = brute.linked(list(range(len(prints))), prints)
    groups = {}
    for p, w in zip(prints, want, strict=True):
        groups.setdefault(w, []).append(p)
    for members in groups.values():
        assert len({roots.get(p, p) for p in members}) == 1
    assert len({roots[p] for p in prints if p in roots}) == sum(len(m) > 1 for m in groups.values())


def test_the_tally_prunes_before_pairs_are_verified():
    rng = np.random.default_rng(3)
    some = rng.integers(0, 1 << 63, 4000, np.uint64) << np.uint64(1)
    apart = some & ~np.uint64(simhash.MASKS[0])  # what members of one list differ by
    kept, same = simhash.tallied(apart)
    assert 0 < len(kept) < 0.05 * len(apart) and (np.bitwise_count(same) >= 4).all()
    near = np.flatnonzero(np.bitwise_count(apart) <= 4)
    assert set(near) <= set(kept)
    prints = np.array(near_prints(400), np.uint64)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    for i, j in pairs[:3000]:  # each pair counts in one list, the first that both are in
        lists = [k for k, m in enumerate(simhash.MASKS) if int(prints[i]) & m == int(prints[j]) & m]
        hits = [k for k in lists if len(simhash._near(prints[[i]] ^ prints[j], k))]
        assert hits == lists[:1]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, other, "c"), (None, text, "d")]
    kept = simhash.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, count string"))
    assert sorted((str(r.doc_id), r["count"]) for r in kept.collect()) == [("3", "b"), ("9", "c"), ("None", "d")]
    assert [r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(None, "x y")], "doc_id long, text string")).collect()] == [None]


# quality


SENTENCE = "Children who read more do better, as we log in to learn and sign up for nothing. "
PAGES = [
    "Home | About | News | Contact us\nThis is a sentence of prose, and it goes on.\nAnother line of it says something else entirely.",
    "buy### now$$$ this%%% is*** all&&& noise### here$$$ and%%% there*** too&&& yes### no$$$",
    "We value your privacy policy.\nClean text follows here. It has many good words in it, all different.",
    SENTENCE + " ".join(f"word{i}" for i in range(300)) + ".",  # a phrase in a long line fails nothing
    "Home\nAbout us\nContact\nOur products\nNews\nTerms\nHelp\nSite map\nLog out",
    "A heading\n" + "It stands above one paragraph of prose that has words enough to be kept, one heading alone being no menu.\nNote\n\nThe end",
    "Home, About, Contact, Login\nThe text itself is long enough, has ten words or more, and stays where it is.",
    "Copyright © 2024 Acme Inc.\nAlle Rechte vorbehalten.\nTous droits réservés.\nLeer más.\nWhat remains is a sentence with more than ten different words in it, and it is longer than all of the furniture above, which goes.",
    "a\nb\nc\n\nd\ne\n",
    "Wait! What! No! Yes!\n" + "x" * 500 + " , , ",
]


def test_quality_figures_and_cleaning(spark, docs, texts, nothing):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PAGES)], "doc_id long, text string"))
    all_texts = dict(enumerate(texts)) | {1000 + i: t for i, t in enumerate(PAGES)}
    duck = duckdb.connect()
    documents = pa.table({"doc_id": list(all_texts), "text": list(all_texts.values())})  # noqa: F841
    sql = {r[0]: r for r in duck.execute(f"select doc_id, lost_chars, kept from ({queries.oracle_sql()['op4_quality_rules']})").fetchall()}
    for r in quality.figures(df).collect():
        want = brute.figures(all_texts[r.doc_id]) | {"kept": brute.cleaned(all_texts[r.doc_id]) is not None}
        assert {k: r[k] for k in want} == want, all_texts[r.doc_id]
        if not any(c in (all_texts[r.doc_id] or "") for c in "\x1c\x85\r"):
            assert (r.doc_id, r.lost_chars, r.kept) == sql[r.doc_id], all_texts[r.doc_id]
    got = {r.doc_id: r.text for r in quality.cleaned_documents(df).collect()}
    want = {i: c for i, t in all_texts.items() if (c := brute.cleaned(t)) is not None}
    assert sorted(got) == sorted(want) and [i for i in want if got[i] != want[i]] == []
    assert got[1003] == PAGES[3] and 1004 not in got and got[1005] == PAGES[5] and got[1006] == PAGES[6].split("\n")[1] and got[1007] == PAGES[7].split("\n")[-1]
    assert quality.cleaned_documents(docs).columns == docs.columns and quality.figures(nothing).count() == 0
    plan = quality.figures(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Aggregate" not in plan and "Join" not in plan and "Window" not in plan
    with pytest.raises(ValueError):
        quality.assessed(docs)


# token ids


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
@pytest.mark.parametrize("generation", [3, 300_000])
def test_encoder_equals_the_library(path, generation, texts):
    mine, theirs = tokenizing.Encoder(path, generation), Tokenizer.from_file(path)
    more = [*(t or "" for t in texts), "foo's. 's. don't, x.y.z 3,4.5 a...b !? (a) ª. Ω. ŉ. ĸ!", " .", "..", "a\n.b", "ab\ncd ef\n\ngh", "a \nb", "a\n b", "a b", "ÀÉ Ñ", "ẞ STRASSE"]
    for kind in (pa.string(), pa.large_string()):
        for cut, ids, counts in mine.slices(pa.array(["before", *more], kind).slice(1), 7, size=3000):
            for text, got in zip(more[cut], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert got.tolist() == [*theirs.encode(text, add_special_tokens=False).ids, 7], text


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_on_random_texts(path):
    rng = random.Random(12)
    parts = ["a", "The", "é", "ÿ", "×", "÷", "ª", "İ", "ſ", "Ω", "’s", "'s", "'LL", "'", ".", "..", "(", "<", "<|", "|", "7", "42", "²", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\xa0", "—", "日", "😀", "e\u0301", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)]
    mine, theirs = tokenizing.Encoder(path, 50), Tokenizer.from_file(path)
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    ids, counts = mine(pa.array(texts))
    for text, got, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), want, strict=True):
        assert got.tolist() == own, repr(text)
    assert [len(x) for x in mine(pa.array([], pa.string()))] == [0, 0] and mine(pa.array(["", ""]))[1].tolist() == [0, 0]


def test_words_of_simple8b():
    rng = np.random.default_rng(1)
    for high in (1, 2, 1 << 8, 1 << 16, 1 << 32, 1 << 60):
        ids = rng.integers(0, high, 10_000, np.uint64)
        ids[rng.integers(0, 10_000, 20)] = np.uint64((1 << 64) - 1)
        blocks = token_ids.encode_blocks(ids, 4096)
        assert len(blocks) == 3
        back = np.concatenate([token_ids.decode_block(b, n) for b, n in zip(blocks, (4096, 4096, 1808), strict=True)])
        assert (back == ids).all()
    assert token_ids.encode_blocks(np.zeros(0, np.uint64)) == []
    assert len(token_ids.encode_blocks(np.zeros(60, np.uint64))[0]) == 1


def test_segments_keep_the_marker_out():
    mark = np.frombuffer(token_ids.SYNC.encode(), "<u8")
    ids = np.array([int(mark[0])] * 3, np.uint64)
    data = token_ids.encode_segment(4, 9, [None, 7], [ids[:1], ids[1:]])
    assert token_ids.SYNC.encode() not in data
    number, before, names, tokens = token_ids.decode_segment(data)
    assert (number, before, names, [t.tolist() for t in tokens]) == (4, 9, [None, 7], [ids[:1].tolist(), ids[1:].tolist()])
    with pytest.raises(ValueError):
        token_ids.decode_segment(data[:-8])


def test_token_files(spark, docs, texts, nothing):
    tokenizer, at, want = Tokenizer.from_file(BYTE_BPE), 0, {}
    for i, t in enumerate(texts):
        ids = brute.ids_of(tokenizer, t)
        want[i] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    path = fresh_path(spark, "t-ids")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_ids.written(docs, path, BYTE_BPE, 2).collect()}
    assert got == want
    one = token_ids.read(spark, path, ids=True).where("doc_id = 5").first()
    assert zlib.crc32(np.array(one.ids, "<u4").tobytes()) == want[5][2]
    assert token_ids.written(nothing, fresh_path(spark, "t-ids"), BYTE_BPE, 2).count() == 0


def test_token_files_with_ties_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (1, "d e f"), (2, None)], "doc_id long, text string")
    rows = token_ids.written(df, fresh_path(spark, "t-ids"), BYTE_BPE, 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1, 2] and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


# token counts


def test_token_counts(docs, texts, nothing):
    pieces = token_counts.vocabulary(PIECES)
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECES).collect()}
    assert got == {i: len(library.encode(t or "").ids) for i, t in enumerate(texts)}
    assert token_counts.token_counts(nothing, PIECES).count() == 0


def test_ties_keep_the_longest_last_piece():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    count = token_counts.Counter(pieces, generation=2)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aab ") for _ in range(rng.randrange(12)))
        assert count(text) == len(library.encode(text).ids), text


def test_model_counts_are_the_tokenizers_own(spark, docs, texts, nothing):
    library = SentencePieceProcessor(model_file=PIECES).encode
    got = {r.doc_id: r.n_tokens for r in token_counts.model_counts(docs, PIECES).collect()}
    assert got == {i: len(library(t or "")) for i, t in enumerate(texts)}
    assert token_counts.model_counts(nothing, PIECES).count() == 0
    count = token_counts.ModelCounter(PIECES, generation=3)
    assert count.by_unit and count("The children were reading") == len(library("The children were reading")) == 4
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "th", "er", "日", "😀", "\n", "\0", " ", "  ", "▁", "\t", "<s>", "é", "."]) for _ in range(rng.randrange(20)))
        assert count(text) == len(library(text)), text


def test_registered_token_counts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    library = SentencePieceProcessor(model_file=PIECES).encode
    got = {r.doc_id: r.n_tokens for r in queries.op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: len(library(r.text or "")) for r in rows}


# decontamination


def contamination_case():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9, 10, 11, 30])))) for i in range(25)] + [(25, None), (26, "..."), (None, "null item here"), (3, "w1 unusual W2")]
    texts = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        k = rng.randrange(len(items))
        if items[k][1] and rng.random() < 0.6:
            own = items[k][1].upper().split()
            a = rng.randrange(max(1, len(own) - 9))
            t[rng.randrange(len(t) + 1) : 0] = own[a : a + rng.randrange(8, 20)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(t))
    return items, [*texts, None, "", texts[0], "NULL-item, here"]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40, "shard_words": 50}])
def test_contamination(spark, options):
    items, texts = contamination_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in decontaminate.contamination(df, benchmark, **options).collect()}
    for i, (n, hit, names) in enumerate(brute.contaminated(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), sorted(map(str, names)))
        assert {k for s in r.spans for k in range(s.start, s.end)} == hit
        words, best = brute.PLAIN.findall(brute.lower(texts[i] or "")), r.longest
        assert (best > 0) == bool(hit)
        if best:
            part = words[r.longest_at : r.longest_at + best]
            assert any(" ".join(part) in " ".join(brute.PLAIN.findall(brute.lower(t or ""))) for _, t in items)
    clean = {r.doc_id for r in decontaminate.clean_documents(df, benchmark, **options).collect()}
    assert clean == {i for i, r in got.items() if r.n_hit == 0}


def test_suffixes_are_sorted_and_neighbours_give_the_longest_match():
    rng = np.random.default_rng(6)
    for _ in range(30):
        words = np.append(rng.integers(0, 4, 80), 0)
        array = decontaminate.suffix_array(words, 100)
        runs = [words[i : i + int(np.flatnonzero(words[i:] == 0)[0])].tolist() for i in array.tolist()]
        assert sorted(array.tolist()) == np.flatnonzero(words).tolist() and runs == sorted(runs)
        test = np.append(words[array[len(array) // 2] :][:5], 0)
        if test[0] and test[1]:
            places = array[[r[:2] == test[:2].tolist() for r in runs]]
            got = decontaminate.match_lengths(words, places, test, 0, 2)
            stop = np.flatnonzero(test == 0)[0]
            assert got.tolist() == [next((n for n in range(stop) if words[p + n] != test[n]), stop) for p in places.tolist()]


def test_blocks_of_the_benchmark_are_held_one_at_a_time(spark, monkeypatch):
    items = [(i, " ".join(f"b{i}x{k}" for k in range(400))) for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"start {items[i][1]} and {items[(i + 7) % 60][1][:2000]}" for i in range(60)] + ["clean text"] * 5
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, note string")
    alive, most, make = [], [], decontaminate.test_block

    def counted(*args):
        block = make(*args)
        alive.append(block)
        most.append(len(alive))
        destroy, block.destroy = block.destroy, lambda: (alive.remove(block), destroy())
        return block

    monkeypatch.setattr(decontaminate, "test_block", counted)
    several = {r.doc_id: r for r in decontaminate.contamination(df, benchmark, block_bytes=20_000).collect()}
    assert len(most) > 5 and max(most) == 1 and not alive
    one = {r.doc_id: r for r in decontaminate.contamination(df, benchmark).collect()}
    assert several == one and len(one[3].item_ids) == 2 and one[61].n_hit == 0 and one[3].longest == 400
    repeated = benchmark.unionByName(benchmark.where("item_id = 3").crossJoin(spark.range(500)).drop("id"))
    again = {r.doc_id: r for r in decontaminate.contamination(df, repeated, block_bytes=20_000).collect()}
    assert again == one
    blocks, n = decontaminate.dealt(repeated, 20_000)
    sizes = [len(make(blocks, i).value.words) for i in range(n)]
    assert len(sizes) > 5 and max(sizes) < 0.5 * sum(sizes)


def test_contamination_edges(spark, docs, nothing):
    benchmark = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contamination(docs.select("doc_id", "text"), benchmark).where("n_hit > 0").collect()] == [3]
    none = benchmark.where("item_id < 0")
    assert decontaminate.clean_documents(docs, none).count() == docs.count()
    assert decontaminate.clean_documents(docs, none).columns == docs.columns
    assert decontaminate.contamination(nothing.select("doc_id", "text"), benchmark).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, benchmark)


# secrets


SECRETS = ["password = 'hunter22' token:abc", "secret: token: abcdefgh API_KEY==aaaaaa", "AKIA" + "Z" * 16 + " AKIAAKIA" + "Q" * 12 + " AKIA12", "é😀 " + "deadbeef" * 3 + " " + "abc" * 7, "passwd:" + "f" * 30, "x" * 20000 + " token=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "api-key=aaaaaaa apikey=bbbbbb", None, "", "token=" + "a" * 5, "token=abcdef" * 3]


def test_secret_spans_and_ledger(spark, docs, texts):
    rows = [(i, t, "x") for i, t in enumerate([*SECRETS, *SECRETS[:3]])] + [(None, "token=nulled1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    ledger = secret_scan.Ledger(spark, fresh_path(spark, "t-ledger"))
    found = secret_scan.digests(secret_scan.findings(df, ledger)).collect()
    assert len(found) == len(rows)
    texts_by = {i: t for i, t, _ in rows}
    for r in found:
        want = brute.secrets(texts_by[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (texts_by[r.doc_id], r.spans, told)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in secret_scan.BASE)
    assert ledger.add(df)[0] == 0  # nothing unseen
    more = spark.createDataFrame([(99, "token=brandnew", "x"), (100, SECRETS[0], "x")], df.schema)
    assert ledger.add(df.unionByName(more))[0] == 1
    assert ledger.add(df, version="2")[0] == len({t or "" for t in texts_by.values()})
    changed = spark.createDataFrame([(99, "no longer there", "x")], df.schema)
    assert ledger.add(changed)[0] == 1
    old = [r for r in ledger.history(secret_scan.RULES_VERSION).collect() if r.doc_id == 99]
    assert [s.kind for r in old for s in r.spans] == ["assign"]  # what the path held once is kept
    assert secret_scan.findings(df.where("doc_id > 1000")).count() == 0


def test_redaction(spark):
    rows = [(1, "my password = 'hunter22' and more", 7, "z"), (2, "clean text", 10, "z"), (3, None, 0, "z"), (4, "token=" + "ab12" * 8 + " end", 1, "z")]
    out = {r.doc_id: r for r in secret_scan.redacted_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")).collect()}
    assert out[1].text == "my [SECRET]' and more" and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[4].text) == ("clean text", None, "[SECRET] end")


def test_many_secrets_and_long_runs_take_linear_time(spark):
    many = "é token=abcdef1 x " * 60_000
    runs = "eyJ" * 40_000
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    texts = [many, runs, "eyJ-" * 30_000 + " " + jwt, jwt + "." + jwt, "eyJshort.eyJ" + "b" * 12 + "." + "c" * 12, "x " + "eyJ" + "a" * 12 + "." + jwt]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r.text for r in secret_scan.redacted_documents(df).collect()}
    assert time.time() - began < 60
    assert out[0] == "é [SECRET] x " * 60_000 and out[1] == runs and out[2] == "eyJ-" * 30_000 + " [SECRET]"
    assert out[3] == "[SECRET].[SECRET]"
    assert out[4] == texts[4] and out[5].startswith("x [SECRET]")
    plan = secret_scan.redacted_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_whole_private_keys(spark):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(n))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = "\n".join([*(line(64) for _ in range(25)), line(30) + "=="])
    long = "\n".join(line(64 - i % 2) for i in range(8000))  # over 10^4 groups would overflow the stack
    keys = [
        f"{begin}\n{body}\n{end}",
        f"{begin}\r\n" + body.replace("\n", "\r\n") + f"\r\n{end}",
        f"{begin}\\n" + body.replace("\n", "\\n") + f"\\n{end}",
        f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,3F17F5316E2BAC89\n\n{body}\n{end}",
        f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,3F17F5316E2BAC89\n\n{body}",
        f"{begin}\n{body}",
        f"{begin}\n{long}\n{end}",
        f"{begin}\n{long}",
        f"{begin}\n{body}\n{line(50)}",
    ]
    texts = [f"My é😀 key:\n{k}{tail}" for k in keys for tail in ("", "\nAnd the prose goes on, all of it.")]
    texts.append(f"A key starts with {begin} and prose goes on - in many words.")
    texts.append((begin + "\n") * 3000)
    texts.append(f"{keys[0]}\nbetween them, prose.\n{keys[0]}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in secret_scan.redacted_documents(df).collect()}
    for i in range(2 * len(keys)):
        assert out[i] == "My é😀 key:\n[SECRET]" + ("\nAnd the prose goes on, all of it." if i % 2 else ""), (i, out[i][:300])
    assert out[2 * len(keys)] == "A key starts with [SECRET] and prose goes on - in many words."
    assert out[2 * len(keys) + 1] == "[SECRET]\n" * 3000
    assert out[2 * len(keys) + 2] == "[SECRET]\nbetween them, prose.\n[SECRET]"
    duck = duckdb.connect()
    documents = pa.table({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    theirs = {r[0]: r[1] for r in duck.execute(f"select doc_id, spans from ({queries.oracle_sql()['op8_secret_scans']})").fetchall()}
    assert {r.doc_id: r.spans for r in secret_scan.digests(secret_scan.findings(df)).collect()} == theirs


# packing


def test_packing(docs, texts, nothing):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = {i: brute.ids_of(tokenizer, t) for i, t in enumerate(texts)}
    brute.check_packing([r.asDict() for r in packing.packed(docs, WORD_BPE, 2).collect()], want)
    for length, grain in ((256, 8), (100, 64), (50, 80), (3, 1)):
        brute.check_packing([r.asDict() for r in packing.packed(docs, WORD_BPE, 2, length=length, grain=grain).collect()], want, length)
    with pytest.raises(ValueError):
        packing.packed(docs, WORD_BPE, 2, grain=0)
    assert packing.packed(nothing, WORD_BPE, 2).count() == 0


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")], "doc_id long, text string")
    rows = packing.packed(df, WORD_BPE, 2).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3)] * 3 + [("None", 2)]
    assert sorted(r.offset for r in rows) in ([0, 2, 5, 8], [0, 3, 5, 8], [0, 3, 6, 8], [0, 3, 6, 9])


def test_packing_beyond_2_to_the_31_tokens(spark):
    sizes = [2**31 + 5, 100, 4000, 77, 3 * 2**31]
    rows = packing.plan(spark.createDataFrame(list(enumerate(sizes)), "uid long, n long"), buckets=2).collect()
    spans = []  # as token numbers over all sequences
    for r in rows:
        whole, left = divmod(sizes[r.uid], 4096)
        own = [(r.whole_seq * 4096, whole * 4096), ((r.seq or 0) * 4096 + r.offset, r.taken), (r.rest_at, left - r.taken)]
        spans += [(at, size) for at, size in own if size]
    at = 0
    for start, size in sorted(spans):
        assert start == at
        at += size
    assert at == sum(sizes)


def test_least_squares_uses_combinations_that_fill():
    combos = packing.combinations(64)
    assert all(sum(c) == 64 and min(c) >= 1 for c in combos) and len(set(combos)) == len(combos)
    histogram = np.zeros(64, np.int64)
    histogram[[10, 20, 34, 32, 60, 4]] = [1000, 1000, 1000, 500, 70, 70]
    times = packing.repeats(histogram, combos)
    used = np.zeros(64, np.int64)
    for c, n in zip(combos, times, strict=True):
        for k in c:
            used[k] += n
    assert (times >= 0).all() and (used <= histogram).all() and used.sum() >= 0.98 * histogram.sum()


# personal data


PRIVATE = ["mail a.b@c.de, x@y and z@@q.com a@b.c@d.ef", "ip 1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3.99999", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111", "call +49 (30) 123-456 78 or +1 2 or +123456789012345678", "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "@" * 2000 + "a" * 20000 + "@", "9" * 30000, "1." * 5000, "+1" + " " * 5000, None, "", "é😀 a@b.cd", "5" * 14 + "-" + "0" * 5]


def test_personal_data(spark, docs, texts, nothing):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*PRIVATE, *texts])], "doc_id long, text string, spans string")
    by = dict(enumerate([*PRIVATE, *texts]))
    for r in pii.personal_data(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind != "iban"] == brute.private(by[r.doc_id]), by[r.doc_id]
        assert all(s.text == by[r.doc_id][s.start : s.end] and 0 <= s.score <= 1 for s in r.pii)
    ibans = [s.text for s in pii.personal_data(df.where("doc_id = 4")).first().pii if s.kind == "iban"]
    assert ibans == ["DE89 3704 0044 0532 0130 00"]
    assert pii.personal_data(nothing).count() == 0
    with pytest.raises(ValueError):
        pii.personal_data(df.withColumn("PII", F.lit(1)))


def test_ibans_before_words_and_numbers():
    known = ["BE68 5390 0754 7034", "BE68539007547034", "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "NL91ABNA0417164300"]
    for iban in known:
        for tail in ("", " BIC: GEBABEBB", " EUR", " EUR 100", " 12", " 2024 12 31 X", " BIC GEBABEBB EUR 1234 5678", ", ref 7", " AB12 CDEF GHIJ"):
            for head in ("", "IBAN ", "AB12 CDEF GHIJ ", "XY00 1234 5678 9012 "):
                text = head + iban + tail
                assert [text[a:b] for a, b, k in pii.find(text) if k == "iban"] == [iban], text
    text = " ".join(known)
    assert [text[a:b] for a, b, k in pii.find(text) if k == "iban"] == known
    assert pii.ibans("BE69 5390 0754 7034 EUR") == [] and pii.ibans("AB12 CDEF GHIJ " * 20000) == []


def test_context_moves_the_score():
    card = "4111 1111 1111 1111"
    scores = [pii.score(t + card, len(t), len(t) + len(card), "card") for t in ("", "credit card: ", "order serial ")]
    assert scores[1] > scores[0] > scores[2]


def test_random_personal_data():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789..-- ++()@@ab.") for _ in range(rng.randrange(60)))
        assert [(k, a, b) for a, b, k in pii.find(text) if k != "iban"] == brute.private(text), text


