"""run() against its stages' plain versions, one after the other."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tokenloom.llm import secret_scan

SF = "/root/testdata/sf0.001"


def masked(text, mask="[SECRET]"):
    spans = sorted((m.start(), i, m.end()) for i, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, text) if len(m[r.group] or "") >= r.least)
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + mask
        at = max(at, end)
    return out + text[at:]


def test_whole_run(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: c for i, t in docs.items() if (c := brute.cleaned(t)) is not None}
    ids = list(docs)
    roots = brute.linked(ids, [brute.simhash(docs[i]) for i in ids])
    ids = [i for i, root in zip(ids, roots, strict=True) if i == root]
    found = brute.contaminated([docs[i] for i in ids], items)
    ids = [i for i, (_, hit, _) in zip(ids, found, strict=True) if not hit]
    assert 0 < len(ids) < len(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: brute.ids_of(tokenizer, masked(docs[i])) for i in ids}
    brute.check_packing([r.asDict() for r in corpus_pipeline.run(spark, SF).collect()], want)
