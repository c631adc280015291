"""Scalar functions, and the streaming parser at every cut."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import pointers as ptr
from tokenloom.functions import scalars as s
from tokenloom.streaming.chunks import Progress, _advance, parse_chunks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "text", "status", "value"),
    [
        (s.parse_i64, "-0", "ok", 0),
        (s.parse_i64, "-9223372036854775808", "ok", -(1 << 63)),
        (s.parse_i64, "9223372036854775808", "range", None),
        (s.parse_i64, "3.14159", "format", None),
        (s.parse_i64, "0e0", "format", None),
        (s.parse_i64, " 1", "format", None),
        (s.parse_i64, "-", "format", None),
        (s.parse_u64, "18446744073709551615", "ok", (1 << 64) - 1),
        (s.parse_u64, "18446744073709551616", "range", None),
        (s.parse_u64, "-0", "format", None),
        (s.parse_i128, str((1 << 127) - 1), "ok", str((1 << 127) - 1)),
        (s.parse_i128, str(1 << 127), "range", None),
        (s.parse_i128, str(-(1 << 127)), "ok", str(-(1 << 127))),
        (s.parse_f64, "1e309", "range", None),
        (s.parse_f64, "5e-324", "ok", 5e-324),
        (s.parse_f64, "1e-400", "ok", 0.0),
        (s.parse_f64, "inf", "format", None),
        (s.parse_f64, '"1"', "format", None),
    ],
)
def test_numbers(spark, f, text, status, value):
    got = one(spark, text, f)
    assert (got.status, got.value) == (status, value)


@pytest.mark.parametrize(
    ("literal", "text"),
    [('"\\t"', '"\t"'), ('"\\ud800\\uDC00"', '"\U00010000"'), ("a\\u002fb", "a/b"), ('"plain"', '"plain"'), ('"\\"\\\\\\/\\b\\f\\n\\r"', '""\\/\b\f\n\r"'), ('"\\ud800"', None)],
)
def test_unescape(spark, literal, text):
    assert one(spark, literal, s.unescape) == text


def test_compare(spark):
    got = spark.createDataFrame([('"\\u0061"', '"a"'), ('"a"', '"b"'), ("b", "a"), (None, "a")], "a string, b string").select(s.unescaped_compare(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == [0, -1, 1, None]


def test_pointer_columns(spark):
    rows = spark.createDataFrame([(p,) for p in ("", "/", "/a~1b/~0", "a", "/é~", None)], "p string").select(ptr.pointer_status(F.col("p")).alias("s"), ptr.pointer_tilde(F.col("p")).alias("t"), ptr.pointer_steps(F.col("p")).alias("x")).collect()
    assert [r.s for r in rows] == ["ok", "ok", "ok", "no_slash", "naked_tilde", None]
    assert [r.t for r in rows] == [None, None, None, None, 3, None]
    assert [r.x for r in rows] == [[], [""], ["a/b", "~"], None, None, None]


TEXT = ' {"é":[1.5e3,"\\ud83d\\ude00€",true],\r\n"b":null} 12 [] '.encode()


def fed(chunks, many=True):
    p, out = Progress(), []
    for i, c in enumerate(chunks):
        p.tail, p.ended = p.tail + c, i == len(chunks) - 1
        if not p.failed:
            out += _advance(p, many, 128)
    return out


@pytest.mark.parametrize("text", [TEXT, b'{"a":[1,]}', b"[tru]", b'["\xff"]', b"[1,2", b"1 2"])
def test_split_invariance(text):
    whole = fed([text])
    for k in range(1, len(text)):
        assert fed([text[:k], text[k:]]) == whole
    assert fed([bytes([c]) for c in text]) == whole
    assert (whole[-1][2] == "Err") == (text not in (TEXT, b"1 2"))


def test_stream_with_chunks_out_of_order(spark, tmp_path):
    rows = [("a", s_, TEXT[s_ * 5 : s_ * 5 + 5], s_ == (len(TEXT) - 1) // 5) for s_ in range((len(TEXT) - 1) // 5 + 1)]
    schema = "stream_id string, seq long, chunk binary, eof boolean"
    for i, part in enumerate((rows[1::2], rows[::2] + rows[1:2])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = parse_chunks(stream).writeStream.format("memory").queryName("tokens_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.sql("select * from tokens_out order by i").collect()
    assert "".join(r.literal for r in got) == TEXT.decode() and got[-1].kind == "Eof" and got[-1].text_no == 3
    assert not any(r.message for r in got)


def test_streams_share_keys_of_the_state(spark, tmp_path):
    """A state entry and a call for each stream took 5 ms a text; streams of a group stay apart across micro-batches."""
    texts = {f"s{n}": [TEXT, b"[1,2", b'"a' + str(n).encode() + b'"', b'["\xff"]', b""][n % 5] for n in range(300)}
    schema = "stream_id string, seq long, chunk binary, eof boolean"
    rows = [(k, i, t[i * 6 : i * 6 + 6], i == len(t) // 6) for k, t in texts.items() for i in range(len(t) // 6 + 1)]
    behind = [("s2", 1, b" 7", True), ("s4", 1, b"7", True), ("s1", 0, b"[1,2", True)]
    for part in (rows[1::2], rows[::2] + rows[5:50], behind):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parsed = parse_chunks(stream, columns=["i", "kind", "offset"], groups=7)
    run = parsed.writeStream.format("memory").queryName("tokens_of_groups").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    kept = max(p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators)
    run.stop()
    assert kept == 7
    got = {}
    for r in spark.sql("select * from tokens_of_groups order by stream_id, i").collect():
        got.setdefault(r.stream_id, []).append((r.i, r.kind, r.offset))
    assert got == {k: [(r[1], r[2], r[4]) for r in fed([t])] for k, t in texts.items()}
