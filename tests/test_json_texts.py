"""Tokens, validation, errors and pointer events of whole texts."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.pointers import Group, PointerError, check_pointer, steps
from tokenloom.operators import json_texts as js
from tokenloom.operators.native import token_rows
from tokenloom.plans.diagnosis import diagnose
from tokenloom.sources.json_sources import concatenated, joined_chunks, json_bytes, json_files, json_lines, json_sequences, validated_files


def docs(spark, texts, kind="string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"doc_id long, text {kind}")


def random_value(rng, depth=0):
    pick = rng.randrange(8 if depth < 5 else 5)
    if pick == 0:
        return rng.choice([True, False, None])
    if pick in (1, 2):
        return rng.choice([0, -0.0, rng.randrange(-(10**20), 10**20), rng.random() * 10 ** rng.randrange(-30, 30)])
    if pick in (3, 4):
        return "".join(rng.choice('ab"\\/\b\n\t é€😀\x7f') for _ in range(rng.randrange(8)))
    if pick in (5, 6):
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice("aé~/0") for _ in range(rng.randrange(3))): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def random_texts(n, seed=7):
    rng = random.Random(seed)
    return [json.dumps(random_value(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1, "\t"]), separators=rng.choice([None, (" ,\r\n", ":")])) for _ in range(n)]


def plain_events(text, group):
    """A stack walk over json's own scanner order: (event, pointer) without Nil."""
    out = []

    def walk(value, node):
        name = group.pointer_at[node] if node >= 0 else None
        if isinstance(value, (dict, Pairs, list)):
            if name is not None:
                out.append(("Enter", name))
            items = value.items if isinstance(value, Pairs) else enumerate(value)
            for k, v in items:
                step = -1 if node < 0 else group.children[node].get(k, -1) if isinstance(value, Pairs) else group.element(node, k)
                walk(v, step)
            if name is not None:
                out.append(("Exit", name))
        elif name is not None:
            out.append(("Match", name))

    walk(json.loads(text, object_pairs_hook=Pairs), 0)
    return out


class Pairs:
    def __init__(self, items):
        self.items = items


@pytest.mark.parametrize("binary", [False, True])
def test_valid_texts_are_lossless_and_valid(spark, binary):
    texts = random_texts(120)
    df = docs(spark, [t.encode() for t in texts] if binary else texts, "binary" if binary else "string")
    assert {r.doc_id: (r.is_valid, r.max_level) for r in js.validate(df).collect()}.keys() == set(range(len(texts)))
    assert all(r.is_valid for r in js.validate(df).collect())
    got = {}
    for r in js.parse(df).orderBy("doc_id", "i").collect():
        text = texts[r.doc_id].encode()
        assert text[r.offset : r.offset + len(r.literal.encode())] == r.literal.encode()
        before = text[: r.offset].decode().replace("\r\n", "\n").replace("\r", "\n")
        assert (r.line, r.col) == (before.count("\n") + 1, len(before) - before.rfind("\n"))
        got[r.doc_id] = got.get(r.doc_id, "") + r.literal
    assert [got[i] for i in range(len(texts))] == texts


def test_native_tokens_agree_with_the_batch_ones(spark):
    df = docs(spark, [*random_texts(60, 3), "[01", '{"a":tru', "1 x", '"\\ud800"'])
    a = {(r.doc_id, r.i): (r.kind, r.literal) for r in token_rows(df).collect()}
    b = {(r.doc_id, r.i): (r.kind, r.literal) for r in js.tokenize(df, eof=False).collect()}
    assert a == b


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("", ("syntax", "Value", "Eof", 0)),
        (" ", ("syntax", "Value", "Eof", 1)),
        ('{"a":,]', ("syntax", "Value", "ValueSep", 5)),
        ("[1,]", ("syntax", "Value", "ArrEnd", 3)),
        ("[}", ("syntax", "ArrElementOrEnd", "ObjEnd", 1)),
        ("{1:2}", ("syntax", "ObjNameOrEnd", "Num", 1)),
        ('{"a" 1}', ("syntax", "ObjNameSep", "Num", 5)),
        ('{"a":1,}', ("syntax", "ObjName", "ObjEnd", 7)),
        ('{"a":1]', ("syntax", "ObjValueSepOrEnd", "ArrEnd", 6)),
        ("[1 2]", ("syntax", "ArrElementSepOrEnd", "Num", 3)),
        ("1 2", ("syntax", "Eof", "Num", 2)),
        ("[[1]", ("syntax", "ArrElementSepOrEnd", "Eof", 4)),
        ("-01", ("lexical", "DotExpOrBoundary", "Num", 2)),
        ("1x", ("lexical", "DigitDotExpOrBoundary", "Num", 1)),
        ("0E,", ("lexical", "DigitOrExpSign", "Num", 2)),
        ("1.0D", ("lexical", "DigitExpOrBoundary", "Num", 3)),
        ("1e5e", ("lexical", "DigitOrBoundary", "Num", 3)),
        ("2.e", ("lexical", "Digit", "Num", 2)),
        ("[trux]", ("lexical", "Char(e)", "LitTrue", 4)),
        ("nullx", ("lexical", "Boundary", "LitNull", 4)),
        ('"a\tb"', ("lexical", "StrChar", "Str", 2)),
        ('"\\x"', ("lexical", "EscChar", "Str", 2)),
        ('"\\u12g4"', ("lexical", "UnicodeEscHexDigit", "Str", 5)),
        ("\x1e[]", ("lexical", "TokenStartChar", None, 0)),
    ],
)
def test_first_error(spark, text, error):
    row = js.validate(docs(spark, [text])).first()
    e = row.err
    assert (e["class"], e.expect, e.token, e.err_pos.offset) == error and not row.is_valid


@pytest.mark.parametrize("text", ["tru", "nul", "-", "1.", "1.0E+", '"a', '"\\u12', '"\\ud800', '"\\ud800\\', '"\\ud800\\udc'])
def test_a_text_that_ends_inside_a_token(text):
    assert diagnose(text.encode())["variant"] == "UnexpectedEof"


@pytest.mark.parametrize(
    ("text", "first", "second", "at"),
    [('"\\uDC00"', 0xDC00, None, 3), ('"\\ud800"', 0xD800, None, 3), ('"\\ud800x"', 0xD800, None, 3), ('"\\ud800\\n"', 0xD800, None, 3), ('"\\uD800\\ud800"', 0xD800, 0xD800, 9), ('"\\udbff\\u0000"', 0xDBFF, 0, 9)],
)
def test_bad_surrogates(text, first, second, at):
    e = diagnose(text.encode())
    assert (e["variant"], e["first"], e.get("second"), e["at"]) == ("BadSurrogate", first, second, at)


@pytest.mark.parametrize(("tail", "no"), [(b"\xc2\xc0", 1), (b"\xe0\x80\x80", 1), (b"\xed\xa0\x80", 1), (b"\xe1\x80\x7f", 2), (b"\xf4\x90\x80\x80", 1), (b"\xf1\x80\x80\xc0", 3)])
def test_bad_utf8_in_binary_texts(spark, tail, no):
    row = js.validate(docs(spark, [b'["\xc3\xa9' + tail], "binary")).first()
    assert (row.err.variant, row.err.byte_no, row.err.seq_len) == ("BadUtf8ContByte", no, len(tail))
    assert (row.err.err_pos.offset, row.err.err_pos.col) == (4, 4)


def test_white_space_between_tokens_changes_no_verdict(spark):
    texts = ['{"a":[1,{"b":null}]}', '{"a":,]', "[1 2]", "[[],{}]", '{"a":{}', "[}"]
    spaced = [" \n".join(r.literal for r in js.tokenize(docs(spark, [t]), eof=False).orderBy("i").collect()) for t in texts]
    verdicts = [[(r.is_valid, r.err and (r.err["class"], r.err.expect, r.err.token, r.err.stack)) for r in js.validate(docs(spark, x)).orderBy("doc_id").collect()] for x in (texts, spaced)]
    assert verdicts[0] == verdicts[1]


def test_levels(spark):
    assert js.validate(docs(spark, ["[[1]]"]), max_level=2).first().is_valid
    e = js.validate(docs(spark, ["[[1]]"]), max_level=1).first().err
    assert (e["class"], e.level, e.token, e.token_pos.offset) == ("level", 2, "ArrBegin", 1)
    assert js.validate(docs(spark, ["1"]), max_level=0).first().is_valid
    deep = "[" * 300 + "]" * 300
    assert not js.validate(docs(spark, [deep])).first().is_valid
    assert js.validate(docs(spark, [deep]), max_level=300).first().is_valid
    mixed = '[{"a":' * 100 + "1" + "}]" * 100
    assert js.validate(docs(spark, [mixed]), max_level=200).first().is_valid


CASES = [
    (["/a"], '{"a":1.0}', [("Match", "/a")]),
    (["/0"], '{"a":1,"b":true,"0":null}', [("Match", "/0")]),
    (["/1/1"], '{"1":["zero", 1]}', [("Match", "/1/1")]),
    (["/00"], "[true]", []),
    (["/+5"], "[0,1,2,3,4,5]", []),
    (["/a", "/ab", "/ab/c", "/ab/cd"], '{"ab": {"c": null}}', [("Enter", "/ab"), ("Match", "/ab/c"), ("Exit", "/ab")]),
    (["/foo/bar", "/fool"], '{"foo":{"bar":1},"fool":2}', [("Match", "/foo/bar"), ("Match", "/fool")]),
    (["/foo", "/fool", "/foo/bar"], '{"foo":{"l":1,"bar":2}}', [("Enter", "/foo"), ("Match", "/foo/bar"), ("Exit", "/foo")]),
    (["/é", "/è"], '{"è":1,"é":2}', [("Match", "/è"), ("Match", "/é")]),
    (["/a"], '{"a":1,"a":2}', [("Match", "/a"), ("Match", "/a")]),
    ([""], "[1]", [("Enter", ""), ("Exit", "")]),
    ([], "[1]", []),
    (["/"], '{"":5}', [("Match", "/")]),
    (["/a~1b/~0"], '{"a/b":{"~":[]}}', [("Enter", "/a~1b/~0"), ("Exit", "/a~1b/~0")]),
]


@pytest.mark.parametrize(("pointers", "text", "events"), CASES)
def test_pointer_events(spark, pointers, text, events):
    got = js.pointer_events(docs(spark, [text]), pointers).orderBy("i").collect()
    assert [(r.event, r.pointer) for r in got] == events


def test_pointer_events_equal_a_stack_walk(spark):
    texts = random_texts(150, 11)
    pointers = ["", "/a", "/0", "/a/0", "/a/1", "/0/a", "/é", "/0/0/0", "/1/a", "/2", "/~0", "/~1", "/"]
    got = {}
    for r in js.pointer_events(docs(spark, texts), pointers).orderBy("doc_id", "i").collect():
        got.setdefault(r.doc_id, []).append((r.event, r.pointer))
    assert [got.get(i, []) for i in range(len(texts))] == [plain_events(t, Group(pointers)) for t in texts]


def test_case_folding_and_raw_names(spark):
    text = '{"FRIEDRICHSTRASSE":1,"\\u0061":2}'
    assert [r.pointer for r in js.pointer_events(docs(spark, [text]), ["/friedrichstraße", "/a"], ignore_case=True).orderBy("i").collect()] == ["/friedrichstraße", "/a"]
    assert js.pointer_events(docs(spark, [text]), ["/a"], unescape=False).count() == 0
    assert Group(["/SS", "/ß"], ignore_case=True).pointers == ["/SS"]


def test_pointer_syntax():
    for bad, kind, index in (("a", "no_slash", None), ("/~", "naked_tilde", 1), ("/~0~2", "naked_tilde", 3), ("/é~", "naked_tilde", 3)):
        with pytest.raises(PointerError) as e:
            check_pointer(bad)
        assert (e.value.kind, e.value.index) == (kind, index)
    assert steps("") == [] and steps("/") == [""] and steps("/~0~1/~01") == ["~/", "~1"]


def test_extract_redact_and_skip(spark):
    df = docs(spark, ['{"a": [1, {"b":"x"}],\n "p":"secret","a":{}}'])
    assert [(r.pointer, r.value) for r in js.extract(df, ["/a", "/a/1"]).orderBy("i").collect()] == [("/a", '[1, {"b":"x"}]'), ("/a/1", '{"b":"x"}'), ("/a", "{}")]
    assert js.redact(df, ["/p", "/a/1", "/a/1/b"]).first().redacted == '{"a": [1, "***"],\n "p":"***","a":{}}'
    tokens = js.skip_structure(df, 4).orderBy("i").collect()
    assert [r.literal for r in tokens if r.kind != "White"][:6] == ["{", '"a"', ":", "[", "]", ","]


def test_redaction_at_the_edges_of_texts(spark):
    texts = ["1", "", "[2]", '{"a":[1,2]}', "x", '"é"', " 3 ", '{"a":1,"b":{"a":2}} ']
    got = [r.redacted for r in js.redact(docs(spark, texts).coalesce(1), ["", "/a"], "#").orderBy("doc_id").collect()]
    assert got == ["#", "", "#", "#", "x", "#", " # ", "# "]
    got = [r.redacted for r in js.redact(docs(spark, texts).coalesce(1), ["/a", "/b/a"], "").orderBy("doc_id").collect()]
    assert got == ["1", "", "[2]", '{"a":}', "x", '"é"', " 3 ", '{"a":,"b":{"a":}} ']


def test_events_by_context_and_skipping(spark):
    df = docs(spark, ['{"a": [1, {"b":"x"}], "c":2} ', '[1,}'])
    rows = js.pointer_events(df, ["/a/1/b", "/c", "/a"], nil=True, skip=js.SEPARATORS, columns=["i", "event", "kind", "pointer", "stack", "inside", "line", "col", "err"]).orderBy("doc_id", "i").collect()
    mine = [r for r in rows if r.doc_id == 0]
    assert not {r.kind for r in mine} & set(js.SEPARATORS) and [r.event for r in mine if r.event != "Nil"] == ["Enter", "Match", "Exit", "Match"]
    assert [r.stack for r in mine][:6] == [["Obj"], ["Obj"], ["Obj", "Arr"], ["Obj", "Arr"], ["Obj", "Arr", "Obj"], ["Obj", "Arr", "Obj"]]
    assert (rows[-1].kind, rows[-1].event, rows[-1].err.variant, rows[-1].stack, rows[-1].inside) == ("Err", "Nil", "Syntax", ["Arr"], "Arr")
    for at, want in ((4, [("Enter", "/a"), ("Exit", "/a"), ("Match", "/c")]), (0, []), (50, [("Enter", "/a"), ("Match", "/a/1/b"), ("Exit", "/a"), ("Match", "/c")])):
        got = js.pointer_events(df.where("doc_id = 0"), ["/a/1/b", "/c", "/a"], after=at).orderBy("i").collect()
        assert [(r.event, r.pointer) for r in got] == want, at
    left = [r.literal for r in js.skip_structure(docs(spark, ["[[1,2", "[1]", "1"]), 1).orderBy("doc_id", "i").collect()]
    assert left == ["[", "[", "", "[", "1", "]", "", "1", ""]


def test_texts_with_errors_give_events_up_to_them(spark):
    df = docs(spark, ['{"a":1,"b":[2,}', '{"a":1,"b":tru'])
    assert [(r.doc_id, r.event, r.pointer) for r in js.pointer_events(df, ["/a", "/b", "/b/0"]).orderBy("doc_id", "i").collect()] == [(0, "Match", "/a"), (0, "Enter", "/b"), (0, "Match", "/b/0"), (1, "Match", "/a")]
    last = js.parse(df).where("kind = 'Err'").orderBy("doc_id").collect()
    assert [r.err["class"] for r in last] == ["syntax", "lexical"]


def test_nulls_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "[]", None)], "doc_id long, text string, note string")
    assert [(r.doc_id, r.note, r.is_valid) for r in js.validate(df).collect()] == [(2, None, True)]
    assert js.tokenize(df.where("doc_id > 5")).count() == 0
    with pytest.raises(ValueError):
        js.tokenize(df.withColumnRenamed("note", "kind"))


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n[2]\n')
    (tmp_path / "b.seq").write_text('\x1e{"a":1}\n\x1e[2]\n')
    assert sorted(r.text for r in json_lines(spark, str(tmp_path / "a.jsonl")).collect()) == ["[2]", '{"a":1}']
    seq = json_sequences(spark, str(tmp_path / "b.seq"))
    assert seq.count() == 2 and all(r.is_valid for r in js.validate(seq).collect())
    assert json_files(spark, str(tmp_path / "a.jsonl")).count() == 1 == json_bytes(spark, str(tmp_path / "a.jsonl")).count()
    many = concatenated(docs(spark, ['{"a":1}[2]3 "x"\ntrue', "1 2 x", ""]))
    assert [(r.doc_id, r.text_no, r.value) for r in many.orderBy("doc_id", "text_no").collect()] == [(0, 0, '{"a":1}'), (0, 1, "[2]"), (0, 2, "3"), (0, 3, '"x"'), (0, 4, "true"), (1, 0, "1"), (1, 1, "2")]


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.json").write_text("[1]")
    (tmp_path / "wrong.json").write_text("[1")
    (tmp_path / "cut.json.gz").write_bytes(gzip.compress(b"[1,2,3]" * 500)[:-40])
    rows = {r.path.rsplit("/", 1)[1]: (r.is_valid, r.err and (r.err["class"], r.err.variant)) for r in validated_files(spark, str(tmp_path)).collect()}
    assert rows == {"good.json": (True, None), "wrong.json": (False, ("syntax", "Syntax")), "cut.json.gz": (False, ("read", "Read"))}


def test_chunks_at_every_byte(spark):
    text = '{"é":[1.5e3,"\\ud83d\\ude00€"],\r\n"b":null}'.encode()
    rows = [(f"{k}-{m}", s, text[s * k : (s + 1) * k]) for k in range(1, len(text) + 1) for m in (0,) for s in reversed(range(-(-len(text) // k)))]
    joined = joined_chunks(spark.createDataFrame(rows, "stream_id string, seq long, chunk binary"))
    assert {bytes(r.text) for r in joined.collect()} == {text}
    assert joined.count() == len(text)


def test_pretty(spark):
    assert js.pretty(docs(spark, ['{"a":[1,{}],"b":{"c":[]}}'])).first().pretty == json.dumps({"a": [1, {}], "b": {"c": []}}, indent=2)
    assert js.pretty(docs(spark, ["[1"])).first().pretty is None


def test_values_do_not_depend_on_the_batch(spark):
    """A text's values are the same alone and behind others."""
    texts = random_texts(40, 5)
    together = {}
    for r in js.values(docs(spark, texts).coalesce(1)).orderBy("doc_id", "i").collect():
        together.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i in (0, 7, 19, 39):
        assert together.get(i, []) == [tuple(r)[1:] for r in js.values(docs(spark, texts[i : i + 1])).orderBy("i").collect()]


def test_texts_are_lexed_once_and_nothing_is_shuffled(spark):
    plan = js.pointer_events(docs(spark, ["[]"]), ["/a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan


def test_member_counts(spark):
    texts = ['{"a":1,"b":{"a":[{"a":2,"é":3},{"a":4}]},"a":5}', "[1,{}]", "", '{"c":1,"c":', '{"":{"":0}}', '{"a":1}', '{"a":1,"a":2}', "[", "{", None]
    rows = spark.createDataFrame([(n // 2, t) for n, t in enumerate(texts)], "id int, text string")
    got = js.member_counts(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(0, "a", 1, 2), (0, "b", 1, 1), (0, "a", 2, 1), (0, "a", 4, 2), (0, "é", 4, 1), (1, "c", 1, 1), (2, "", 1, 1), (2, "", 2, 1), (2, "a", 1, 1), (3, "a", 1, 2)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # an error ends a text: a byte that isn't UTF-8, and what leads too deep
    odd = spark.createDataFrame([(1, b'{"\xff":1,"k":2,"k":[]}'), (2, b'{"k":[{"k":"\xc3\xa9"}]}')], "id int, text binary")
    assert sorted(tuple(r) for r in js.member_counts(odd, max_level=2).collect()) == [(2, "k", 1, 1)]


def test_picked(spark):
    texts = ['{"a":1,"b":[true,{"c":"é"}]}', '{"b":[],"a":[1 ,2],"a":3}', "[]", "", '{"a":"x","b":[1,', None]
    got = js.picked(docs(spark, texts), ["/b/0", "/a", "/b/1/c"])
    assert {r.doc_id: r.picked for r in got.collect()} == {0: ["true", "1", '"é"'], 1: [None, "[1 ,2]", None], 2: [None] * 3, 3: [None] * 3, 4: ["1", '"x"', None]}
