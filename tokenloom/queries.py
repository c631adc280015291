"""Registered queries over the driver's tables, and the same in DuckDB's SQL where SQL can say it.

The tables' own JSON is `events.props`.  Richer texts are built from integer and string columns, alike in both
engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import pointers as ptr
from tokenloom.functions import scalars, tables
from tokenloom.operators import json_texts as js
from tokenloom.operators.native import literals, token_rows
from tokenloom.plans.grammar import KINDS
from tokenloom.sources.json_sources import RECORD_SEPARATOR, concatenated, joined_chunks, json_bytes, json_files, json_lines, json_sequences, validated_files
from tokenloom.sources.shared import fresh_path, spread

#: name -> (query, SQL or None)
_FOUND: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None = None):
    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text")))


def _text(*parts) -> F.Column:
    """Strings as they are, columns (by expression) as text, one behind the other."""
    return F.concat(*(p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts))


#: An order as a text: nested object, array of two elements, escaped and duplicate names, white space.
_ORDER_SQL = """SELECT o_orderkey AS id, '{"key": ' || o_orderkey || ',"cust":{"id":' || o_custkey || ',"tags":["' || o_orderstatus || '",' || (o_custkey % 7) || ']},' || chr(10) || ' "a\\u002fb":"' || o_orderpriority || '\\n","key":' || (o_orderkey % 10) || '}' AS text FROM orders"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = _text('{"key": ', key, ',"cust":{"id":', cust, ',"tags":["', F.col("o_orderstatus"), '",', cust % 7, ']},\n "a\\u002fb":"', F.col("o_orderpriority"), '\\n","key":', key % 10, "}")
    return o.select(key.alias("id"), text.alias("text"))


#: Tokens of a valid text, for RE2.
_RE2 = r"""'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[{}\[\]:,]|[ \t\n\r]+'"""
_KIND_SQL = "CASE t[1] WHEN '{' THEN 'ObjBegin' WHEN '}' THEN 'ObjEnd' WHEN '[' THEN 'ArrBegin' WHEN ']' THEN 'ArrEnd' WHEN ':' THEN 'NameSep' WHEN ',' THEN 'ValueSep' WHEN '\"' THEN 'Str' WHEN 't' THEN 'LitTrue' WHEN 'f' THEN 'LitFalse' WHEN 'n' THEN 'LitNull' WHEN ' ' THEN 'White' WHEN chr(10) THEN 'White' ELSE 'Num' END"
_TOKENS_SQL = f"WITH docs AS ({_ORDER_SQL}), toks AS (SELECT id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT id, regexp_extract_all(text, {_RE2}) AS l FROM docs))"


@_query(f"SELECT {_KIND_SQL} AS kind, count(*) AS n, sum(strlen(t)) AS n_bytes FROM (SELECT unnest(regexp_extract_all(props, {_RE2})) AS t FROM events) GROUP BY 1")
def token_kind_counts(spark, sf_dir):
    rows = token_rows(_props(spark, sf_dir))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(scalars.literal_len(F.col("literal"))).alias("n_bytes"))


@_query(f"{_TOKENS_SQL} SELECT id, i, {_KIND_SQL} AS kind, t AS literal FROM toks")
def token_relation(spark, sf_dir):
    return token_rows(_orders(spark, sf_dir)).select("id", "i", "kind", "literal")


@_query("SELECT event_id, props AS joined FROM events")
def lossless_roundtrip(spark, sf_dir):
    return _props(spark, sf_dir).select("event_id", F.array_join(literals(F.col("text")), "").alias("joined"))


@_query(f"{_TOKENS_SQL} SELECT id, i, sum(strlen(t)) OVER w - strlen(t) AS \"offset\", 1 + coalesce(sum(CASE WHEN t[1] IN (chr(10), ' ') THEN length(t) - length(replace(t, chr(10), '')) ELSE 0 END) OVER p, 0) AS line FROM toks WINDOW w AS (PARTITION BY id ORDER BY i), p AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def token_positions(spark, sf_dir):
    return js.tokenize(_orders(spark, sf_dir), columns=["i", "offset", "line"], eof=False)


@_query(f"{_TOKENS_SQL} SELECT id, count(*) AS n FROM toks WHERE {_KIND_SQL} NOT IN ('White', 'NameSep', 'ValueSep') GROUP BY id")
def meaningful_tokens(spark, sf_dir):
    return js.meaningful(_orders(spark, sf_dir), columns=["kind"], eof=False).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_TOKENS_SQL}, l AS (SELECT id, sum(CASE WHEN t IN ('{{', '[') THEN 1 WHEN t IN ('}}', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS level FROM toks) SELECT id, max(level) AS max_level FROM l GROUP BY id")
def nesting_level_max(spark, sf_dir):
    return js.validate(_orders(spark, sf_dir), columns=["max_level"])


#: Six ways to write a text, one of them right, by id.
_BAD_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '{\"a\":' || o_custkey || '}' WHEN 1 THEN '{\"a\":' || o_custkey WHEN 2 THEN '[' || o_custkey || ',]' WHEN 3 THEN '[0' || o_custkey || ']' WHEN 4 THEN '[\"' || o_orderstatus || '\" ' || o_custkey || ']' ELSE '[tru]' END AS text FROM orders"


def _mixed(spark, sf_dir) -> DataFrame:
    o = spread(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    forms = [_text('{"a":', cust, "}"), _text('{"a":', cust), _text("[", cust, ",]"), _text("[0", cust, "]"), _text('["', F.col("o_orderstatus"), '" ', cust, "]"), F.lit("[tru]")]
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(key % 6 == i, form).otherwise(text)
    return o.select(key.alias("id"), text.alias("text"))


@_query(f"SELECT id, json_valid(text) AND NOT regexp_matches(text, ',[\\]}}]') AS is_valid FROM ({_BAD_SQL})")
def json_valid(spark, sf_dir):
    """The SQL adds what DuckDB's parser lets pass: a comma before a closing bracket."""
    return js.validate(_mixed(spark, sf_dir), columns=["is_valid"])


@_query(f"""SELECT id, CASE id % 6 WHEN 1 THEN 'syntax' WHEN 2 THEN 'syntax' WHEN 3 THEN 'lexical' WHEN 4 THEN 'syntax' WHEN 5 THEN 'lexical' END AS class,
 CASE id % 6 WHEN 1 THEN 'ObjValueSepOrEnd' WHEN 2 THEN 'Value' WHEN 3 THEN 'DotExpOrBoundary' WHEN 4 THEN 'ArrElementSepOrEnd' WHEN 5 THEN 'Char(e)' END AS expect,
 CASE id % 6 WHEN 1 THEN length(text) WHEN 2 THEN length(text) - 1 WHEN 3 THEN 2 WHEN 4 THEN 5 WHEN 5 THEN 4 END AS err_offset,
 CASE id % 6 WHEN 1 THEN length(text) WHEN 2 THEN length(text) - 1 WHEN 3 THEN 1 WHEN 4 THEN 5 WHEN 5 THEN 1 END AS token_offset FROM ({_BAD_SQL})""")
def first_error(spark, sf_dir):
    err = js.validate(_mixed(spark, sf_dir), columns=["err"])
    return err.select("id", "err.class", "err.expect", F.col("err.err_pos.offset").alias("err_offset"), F.col("err.token_pos.offset").alias("token_offset"))


@_query("SELECT o_orderkey AS id, 'level error: level 2 exceeds the greatest level allowed, on [ at line 1, column ' || (strlen(CAST(o_custkey AS VARCHAR)) + 3) || ' (offset: ' || (strlen(CAST(o_custkey AS VARCHAR)) + 2) || ')' AS message FROM orders")
def level_error(spark, sf_dir):
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _text("[", F.col("o_custkey"), ",[2]]").alias("text"))
    return js.validate(docs, max_level=1, columns=["err"]).select("id", "err.message")


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def pointer_match_int(spark, sf_dir):
    events = js.pointer_events(_props(spark, sf_dir), ["/k"]).where("event = 'Match'")
    return events.select("event_id", scalars.parse_i64(F.col("literal"))["value"].alias("k"))


@_query(f"SELECT id, json_extract_string(text, '/cust/tags/0') AS tag, CAST(json_extract_string(text, '/cust/tags/1') AS BIGINT) AS n FROM ({_ORDER_SQL})")
def pointer_array_index(spark, sf_dir):
    tag, n = (F.col("picked")[i] for i in range(2))
    found = js.picked(_orders(spark, sf_dir), ["/cust/tags/0", "/cust/tags/1"])
    return found.select("id", F.regexp_replace(tag, '^"|"$', "").alias("tag"), n.cast("long").alias("n"))


@_query(f"SELECT id, '/cust/id' AS pointer, json_extract_string(text, '/cust/id') AS value FROM ({_ORDER_SQL}) UNION ALL SELECT id, '/cust/tags', CAST(json_extract(text, '/cust/tags') AS VARCHAR) FROM ({_ORDER_SQL})")
def pointer_group_multi(spark, sf_dir):
    return js.extract(_orders(spark, sf_dir), ["/cust/tags", "/cust/id", "/none", "/cust/id/0"], columns=["pointer", "value"])


@_query("SELECT event_id, props AS value FROM events")
def pointer_root(spark, sf_dir):
    return js.extract(_props(spark, sf_dir), [""]).select("event_id", "value")


@_query("SELECT CAST(count(json_extract(props, '/none')) + count(json_extract(props, '/k/0')) + count(json_extract(props, '/K')) AS INTEGER) AS n FROM events")
def pointer_missing(spark, sf_dir):
    return js.pointer_events(_props(spark, sf_dir), ["/none", "/k/0", "/K"]).agg(F.count(F.lit(1)).cast("int").alias("n"))


@_query("SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS literal FROM orders UNION ALL SELECT o_orderkey, CAST(o_orderkey % 10 AS VARCHAR) FROM orders")
def duplicate_names_all_match(spark, sf_dir):
    return js.pointer_events(_orders(spark, sf_dir), ["/key"], columns=["literal"])


@_query("SELECT o_orderkey AS id, '\"' || o_orderpriority || '\\n\"' AS literal FROM orders")
def pointer_unescaped_name(spark, sf_dir):
    """The name a\\u002fb is a/b once expanded, so /a~1b reaches it."""
    return js.pointer_events(_orders(spark, sf_dir), ["/a~1b"]).select("id", "literal")


@_query("SELECT o_orderkey AS id, '\"' || o_orderpriority || '\\n\"' AS literal FROM orders")
def pointer_raw_name(spark, sf_dir):
    """Names as written."""
    return js.pointer_events(_orders(spark, sf_dir), ["/a\\u002fb", "/a~1b"], unescape=False).select("id", "literal")


@_query("SELECT o_orderkey AS id, '/STRASSE' AS pointer FROM orders")
def pointer_ignore_case(spark, sf_dir):
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _text('{"Straße":', F.col("o_custkey"), "}").alias("text"))
    return js.pointer_events(docs, ["/straße", "/STRASSE", "/x"], ignore_case=True).select("id", "pointer")


#: Events at a value: the ends of an object or array, or a match.
_REACHED_SQL = f"""SELECT json_type(text, p) AS type, count(*) AS n FROM ({_ORDER_SQL}), (VALUES ('/cust'), ('/cust/tags'), ('/cust/tags/1')) t(p) WHERE json_type(text, p) IS NOT NULL GROUP BY 1"""


@_query(f"""{_TOKENS_SQL}, reached AS ({_REACHED_SQL}),
 found AS (SELECT 'Enter' AS event, CASE type WHEN 'OBJECT' THEN 'ObjBegin' ELSE 'ArrBegin' END AS kind, n FROM reached WHERE type IN ('OBJECT', 'ARRAY')
 UNION ALL SELECT 'Exit', CASE type WHEN 'OBJECT' THEN 'ObjEnd' ELSE 'ArrEnd' END, n FROM reached WHERE type IN ('OBJECT', 'ARRAY')
 UNION ALL SELECT 'Match', CASE type WHEN 'VARCHAR' THEN 'Str' ELSE 'Num' END, n FROM reached WHERE type NOT IN ('OBJECT', 'ARRAY')),
 rest AS (SELECT k.kind, k.n - coalesce(f.n, 0) AS n FROM (SELECT {_KIND_SQL} AS kind, count(*) AS n FROM toks GROUP BY 1) k LEFT JOIN (SELECT kind, sum(n) AS n FROM found GROUP BY 1) f USING (kind))
SELECT event, kind, n FROM found UNION ALL SELECT 'Nil', kind, CAST(n AS BIGINT) FROM rest WHERE n > 0""")
def pointer_event_counts(spark, sf_dir):
    return js.pointer_events(_orders(spark, sf_dir), ["/cust", "/cust/tags", "/cust/tags/1"], nil=True, columns=["event", "kind"]).groupBy("event", "kind").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_orderkey AS id, o_orderpriority || chr(10) AS text FROM orders")
def unescape_string(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), scalars.unescape(_text(F.col("o_orderpriority"), "\\n")).alias("text"))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority || '/' < '3' THEN -1 ELSE 1 END AS cmp FROM orders")
def compare_unescaped(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), scalars.unescaped_compare(_text(F.col("o_orderpriority"), "\\u002f"), F.lit("3")).alias("cmp"))


_NUMBERS_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN '-' || o_custkey WHEN 2 THEN o_custkey || '.5' WHEN 3 THEN o_custkey || '00000000000000000000' WHEN 4 THEN o_custkey || 'e400' ELSE '-0' END AS n FROM orders"


def _numbers(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    forms = [_text(cust), _text("-", cust), _text(cust, ".5"), _text(cust, "0" * 20), _text(cust, "e400"), F.lit("-0")]
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(key % 6 == i, form).otherwise(text)
    return o.select(key.alias("id"), text.alias("n"))


def _parsed(spark, sf_dir, parse) -> DataFrame:
    return _numbers(spark, sf_dir).select("id", parse(F.col("n")).alias("p")).select("id", "p.status", "p.value")


@_query(f"SELECT id, CASE WHEN id % 6 IN (2, 4) OR n LIKE '00%' THEN 'format' WHEN id % 6 = 3 THEN 'range' ELSE 'ok' END AS status, CASE WHEN id % 6 IN (0, 1, 5) THEN CAST(n AS BIGINT) END AS value FROM ({_NUMBERS_SQL})")
def parse_i64_status(spark, sf_dir):
    return _parsed(spark, sf_dir, scalars.parse_i64)


@_query(f"SELECT id, CASE WHEN id % 6 = 0 THEN 'ok' WHEN id % 6 = 3 AND n NOT LIKE '00%' THEN 'range' ELSE 'format' END AS status, CASE WHEN id % 6 = 0 THEN CAST(n AS DECIMAL(20,0)) END AS value FROM ({_NUMBERS_SQL})")
def parse_u64_status(spark, sf_dir):
    return _parsed(spark, sf_dir, scalars.parse_u64)


@_query(f"SELECT id, CASE WHEN id % 6 IN (2, 4) OR n LIKE '00%' THEN 'format' ELSE 'ok' END AS status, CASE WHEN n = '-0' THEN '0' WHEN id % 6 IN (0, 1, 3) AND n NOT LIKE '00%' THEN n END AS value FROM ({_NUMBERS_SQL})")
def parse_i128_status(spark, sf_dir):
    return _parsed(spark, sf_dir, scalars.parse_i128)


@_query(f"SELECT id, CASE WHEN n LIKE '00%' THEN 'format' WHEN id % 6 = 4 AND n <> '0e400' THEN 'range' ELSE 'ok' END AS status, CASE WHEN n NOT LIKE '00%' AND (id % 6 <> 4 OR n = '0e400') THEN CAST(n AS DOUBLE) END AS value FROM ({_NUMBERS_SQL})")
def parse_f64_status(spark, sf_dir):
    return _parsed(spark, sf_dir, scalars.parse_f64)


@_query(r"""SELECT event_id, regexp_replace(props, '[0-9]+', '"***"') AS redacted FROM events""")
def redact(spark, sf_dir):
    return js.redact(_props(spark, sf_dir), ["/k"]).select("event_id", "redacted")


@_query(f"SELECT id, regexp_replace(regexp_replace(text, '\\{{\"id\".*\\]\\}}', '#'), '(\"key\":) ?[0-9]+', '\\1#', 'g') AS redacted FROM (SELECT id, replace(text, '\"key\": ', '\"key\":') AS text FROM ({_ORDER_SQL}))")
def redact_nested(spark, sf_dir):
    docs = _orders(spark, sf_dir).withColumn("text", F.replace("text", F.lit('"key": '), F.lit('"key":')))
    return js.redact(docs, ["/cust", "/cust/id", "/key"], "#").select("id", "redacted")


@_query(f"SELECT id, regexp_extract(text, '\"cust\":(\\{{.*\\]\\}})', 1) AS value FROM ({_ORDER_SQL})")
def extract_subdocument(spark, sf_dir):
    return js.extract(_orders(spark, sf_dir), ["/cust"], columns=["value"])


@_query("SELECT event_id, regexp_replace(props, '\\{\"k\": ([0-9]+)\\}', '{' || chr(10) || '  \"k\": \\1' || chr(10) || '}') AS pretty FROM events")
def pretty_print(spark, sf_dir):
    return js.pretty(_props(spark, sf_dir)).select("event_id", "pretty")


@_query(f"""WITH toks AS (SELECT id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT o_orderkey AS id, regexp_extract_all('{{"a":[' || o_custkey || ',[]]}}', {_RE2}) AS l FROM orders)),
 levels AS (SELECT id, i, t, sum(CASE WHEN t IN ('{{', '[') THEN 1 WHEN t IN ('}}', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS level FROM toks),
 ends AS (SELECT l.id, min(l.i) AS e FROM levels l JOIN levels b ON l.id = b.id AND b.i = 3 WHERE l.i > 3 AND l.level < b.level GROUP BY l.id)
SELECT id, CAST(i AS INTEGER) AS i, t AS literal FROM levels JOIN ends USING (id) WHERE i <= 3 OR i >= e UNION ALL SELECT id, CAST(count(*) AS INTEGER), '' FROM toks GROUP BY id""")
def skip_structure(spark, sf_dir):
    """What stands between the array's opening bracket (token 3) and its end is left out."""
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _text('{"a":[', F.col("o_custkey"), ",[]]}").alias("text"))
    return js.skip_structure(docs, 3, columns=["i", "literal"]).select(F.col("doc_id").alias("id"), F.col("i").cast("int").alias("i"), "literal")


@_query(f"SELECT id, name, depth, n FROM (SELECT id, unnest(['key', 'cust', 'id', 'tags', 'a\\u002fb']) AS name, unnest([1, 1, 2, 2, 1]) AS depth, unnest([2, 1, 1, 1, 1]) AS n FROM ({_ORDER_SQL}))")
def member_values(spark, sf_dir):
    rows = js.member_counts(_orders(spark, sf_dir))
    return rows.select("id", "name", F.col("depth").cast("int").alias("depth"), F.col("n").cast("int").alias("n"))


_POINTERS_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/a~1' || o_custkey WHEN 2 THEN 'a' || o_custkey WHEN 3 THEN '/~0~2' ELSE '/' || o_custkey || '//~01' END AS p FROM orders"


def _pointers(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(key % 5 == 0, "").when(key % 5 == 1, _text("/a~1", cust)).when(key % 5 == 2, _text("a", cust)).when(key % 5 == 3, "/~0~2").otherwise(_text("/", cust, "//~01"))
    return o.select(key.alias("id"), text.alias("p"))


@_query(f"SELECT id, CASE WHEN p = '' OR regexp_full_match(p, '/([^~]|~[01])*') THEN 'ok' WHEN p[1] <> '/' THEN 'no_slash' ELSE 'naked_tilde' END AS status, CASE WHEN id % 5 = 3 THEN 3 END AS tilde FROM ({_POINTERS_SQL})")
def pointer_validate(spark, sf_dir):
    return _pointers(spark, sf_dir).select("id", ptr.pointer_status(F.col("p")).alias("status"), ptr.pointer_tilde(F.col("p")).alias("tilde"))


@_query(f"SELECT id, CASE id % 5 WHEN 0 THEN '' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE array_to_string(list_transform(string_split(p, '/')[2:], lambda x: replace(replace(x, '~1', '/'), '~0', '~')), '|') END AS steps FROM ({_POINTERS_SQL})")
def pointer_ref_tokens(spark, sf_dir):
    return _pointers(spark, sf_dir).select("id", F.array_join(ptr.pointer_steps(F.col("p")), "|").alias("steps"))


_LINES_SQL = "SELECT event_id, event_type, props AS value FROM events"


def _lines(spark, sf_dir) -> DataFrame:
    """Events as lines of JSON: id, type and the props as they are."""
    e = _table(spark, sf_dir, "events")
    return e.select(_text('{"id":', F.col("event_id"), ',"type":"', F.col("event_type"), '","props":', F.col("props"), "}").alias("value"))


def _lines_read(texts: DataFrame) -> DataFrame:
    """Id, type and props of each text."""
    key, kind, props = (F.col("picked")[i] for i in range(3))
    found = js.picked(texts, ["/id", "/type", "/props"])
    return found.select(key.cast("long").alias("event_id"), F.replace(kind, F.lit('"'), F.lit("")).alias("event_type"), props.alias("value"))


@_query(_LINES_SQL)
def jsonl_split(spark, sf_dir):
    """Files of many lines in the shared folder, read line by line."""
    path = fresh_path(spark, "lines")
    _lines(spark, sf_dir).write.text(path)
    return _lines_read(json_lines(spark, path).select("text"))


@_query(_LINES_SQL)
def json_sequence_files(spark, sf_dir):
    """Record sequences (RFC 7464) in the shared folder, read record by record."""
    path = fresh_path(spark, "sequences")
    _lines(spark, sf_dir).select(F.concat("value", F.lit("\n")).alias("value")).write.text(path, lineSep=RECORD_SEPARATOR)
    return _lines_read(json_sequences(spark, path).select(F.rtrim(F.col("text"), F.lit("\n")).alias("text")))


@_query(_LINES_SQL)
def whole_files(spark, sf_dir):
    """Files of several texts each, read whole as bytes and taken apart by the parser."""
    path = fresh_path(spark, "files")
    _lines(spark, sf_dir).write.option("maxRecordsPerFile", 1000).text(path)
    return _lines_read(concatenated(json_bytes(spark, path).select("text")).select(F.col("value").alias("text")))


@_query("SELECT count(*) AS n_texts, 0 AS n_failed FROM events")
def validated_whole_files(spark, sf_dir):
    """Files of several texts each: how many texts they hold and how many files fail."""
    path = fresh_path(spark, "files")
    _lines(spark, sf_dir).write.option("maxRecordsPerFile", 1000).text(path)
    texts = concatenated(json_files(spark, path).select("text")).agg(F.count(F.lit(1)).alias("n_texts"))
    failed = validated_files(spark, path, many=True).agg(F.sum((~F.col("is_valid")).cast("int")).alias("n_failed"))
    return texts.join(failed)


@_query("SELECT event_id, 0 AS text_no, props AS value FROM events UNION ALL SELECT event_id, 1, CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 2, '[]' FROM events")
def concatenated_texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "events").select("event_id", F.concat("props", F.col("event_id").cast("string"), F.lit("[]")).alias("text"))
    return concatenated(docs).withColumn("text_no", F.col("text_no").cast("int"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def chunked_texts(spark, sf_dir):
    """Each text cut into chunks of three bytes, joined in the order of their numbers and read."""
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("stream_id"), F.encode("props", "UTF-8").alias("b"))
    chunks = events.select("stream_id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("b") / 3).cast("int"))).alias("seq"), "b")
    chunks = chunks.select("stream_id", "seq", F.substring(F.col("b"), F.col("seq") * 3 + 1, F.lit(3)).alias("chunk"))
    found = js.pointer_events(joined_chunks(chunks), ["/k"])
    return found.select(F.col("stream_id").alias("event_id"), F.col("literal").cast("long").alias("k"))


@_query("SELECT kind, kind IN ('LitFalse', 'LitNull', 'LitTrue') AS literal, kind IN ('LitFalse', 'LitNull', 'LitTrue', 'Num', 'Str') AS primitive, kind IN ('Eof', 'Err', 'White') AS pseudo, kind IN ('NameSep', 'ValueSep') AS punct, kind IN ('ArrBegin', 'ArrEnd', 'ObjBegin', 'ObjEnd') AS struct, kind IN ('Eof', 'Err') AS terminal, kind = 'Eof' AS eof, kind = 'Err' AS err, CASE kind WHEN 'ArrBegin' THEN '[' WHEN 'ArrEnd' THEN ']' WHEN 'Eof' THEN 'EOF' WHEN 'Err' THEN 'error' WHEN 'LitFalse' THEN 'false' WHEN 'LitNull' THEN 'null' WHEN 'LitTrue' THEN 'true' WHEN 'NameSep' THEN ':' WHEN 'Num' THEN 'number' WHEN 'ObjBegin' THEN '{' WHEN 'ObjEnd' THEN '}' WHEN 'Str' THEN 'string' WHEN 'ValueSep' THEN ',' ELSE 'whitespace' END AS display, CASE kind WHEN 'ArrBegin' THEN '[' WHEN 'ArrEnd' THEN ']' WHEN 'LitFalse' THEN 'false' WHEN 'LitNull' THEN 'null' WHEN 'LitTrue' THEN 'true' WHEN 'NameSep' THEN ':' WHEN 'ObjBegin' THEN '{' WHEN 'ObjEnd' THEN '}' WHEN 'ValueSep' THEN ',' END AS content FROM (SELECT unnest(['ArrBegin', 'ArrEnd', 'Eof', 'Err', 'LitFalse', 'LitNull', 'LitTrue', 'NameSep', 'Num', 'ObjBegin', 'ObjEnd', 'Str', 'ValueSep', 'White']) AS kind)")
def token_predicates(spark, sf_dir):
    kind = F.col("kind")
    own = {"literal": scalars.is_literal, "primitive": scalars.is_primitive, "pseudo": scalars.is_pseudo, "punct": scalars.is_punct, "struct": scalars.is_struct, "terminal": scalars.is_terminal, "eof": scalars.is_eof, "err": scalars.is_err, "display": scalars.display, "content": scalars.static_content}
    return spark.createDataFrame([(k,) for k in KINDS], "kind string").select("kind", *(f(kind).alias(n) for n, f in own.items()))


_FLAGSHIP = "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS sum_k FROM events GROUP BY event_type"


@_query(_FLAGSHIP)
def pointer_agg_by_type(spark, sf_dir):
    """Values at /k, matched by a pointer, parsed and summed by event type."""
    events = spread(_table(spark, sf_dir, "events").select("event_type", F.col("props").alias("text")))
    found = js.pointer_events(events, ["/k"], columns=["event", "literal"]).where("event = 'Match'")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(scalars.parse_i64(F.col("literal"))["value"]).alias("sum_k"))


@_query("SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pointer_join_orders(spark, sf_dir):
    """The customer id inside each text joins the customers."""
    found = js.extract(_orders(spark, sf_dir), ["/cust/id"], columns=["value"]).select(F.col("value").cast("long").alias("c_custkey"))
    return found.join(_table(spark, sf_dir, "customer"), "c_custkey").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT CAST(event_id AS VARCHAR) AS stream_id, CAST(len(regexp_extract_all(coalesce(props, ''), {_RE2})) + 1 AS BIGINT) AS n_tokens, CAST(CASE WHEN coalesce(props, '') = '' THEN 1 ELSE 0 END AS BIGINT) AS n_errors, CAST(strlen(coalesce(props, '')) AS BIGINT) AS last_offset FROM events")
def streamed_chunks(spark, sf_dir):
    """Texts in chunks through the streaming parser, available now, one micro-batch at least."""
    from tokenloom.streaming.queries import chunked_events

    return chunked_events(spark, sf_dir)


#: A text of two lines with letters of several bytes; {p} priority, {c} customer, with their lengths in SQL.
_WIDE_SQL = """SELECT o_orderkey AS id, o_orderpriority AS p, CAST(o_custkey AS VARCHAR) AS c FROM orders"""


@_query(f"""SELECT id, unnest(range(11)) AS i, unnest([1, 2, 5, 6, length(p) + 9, length(p) + 10, 1, 4, 5, length(c) + 5, length(c) + 6]) AS col, unnest([1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) AS line,
 unnest([0, 1, 5, 6, length(p) + 11, length(p) + 12, length(p) + 13, length(p) + 17, length(p) + 18, length(p) + 18 + length(c), length(p) + 19 + length(c)]) AS "offset" FROM ({_WIDE_SQL})""")
def token_columns(spark, sf_dir):
    """Lines and columns count characters, offsets bytes; the end has a place too."""
    o = _table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("id"), _text('{"é":"€', F.col("o_orderpriority"), '",\n"ß":', F.col("o_custkey"), "}").alias("text"))
    rows = js.tokenize(docs, columns=["i", "offset", "line", "col"])
    return rows.select("id", *(F.col(c).cast("long").alias(c) for c in ("i", "offset", "line", "col")))


@_query(f"{_TOKENS_SQL} SELECT id, i, contains(t, chr(92)) AS is_escaped, {_KIND_SQL} = 'Str' AS is_string, CASE WHEN {_KIND_SQL} = 'Str' THEN replace(replace(t, '\\u002f', '/'), '\\n', chr(10)) ELSE t END AS content FROM toks")
def token_contents(spark, sf_dir):
    """Escapes told and expanded, by columns of the JVM alone."""
    rows = token_rows(_orders(spark, sf_dir))
    return rows.select("id", "i", scalars.is_escaped(F.col("kind"), F.col("literal")).alias("is_escaped"), (F.col("kind") == "Str").alias("is_string"), scalars.content_unescaped(F.col("kind"), F.col("literal")).alias("content"))


@_query(f"{_TOKENS_SQL} SELECT id, count(*) AS n, sum(CASE WHEN contains(t, chr(92)) THEN 1 ELSE 0 END) AS n_escaped FROM toks WHERE {_KIND_SQL} <> 'White' GROUP BY id")
def non_white_tokens(spark, sf_dir):
    rows = js.non_white(_orders(spark, sf_dir), columns=["is_escaped"], eof=False)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_escaped").cast("int")).alias("n_escaped"))


#: What stands behind `[<custkey>,` by id, what is wrong with it, what was expected, at which byte of it, and in which token.
_FAULTS = [
    ("-]", "UnexpectedByte", "Digit", 1, "Num"),
    ("01]", "UnexpectedByte", "DotExpOrBoundary", 1, "Num"),
    ("1x]", "UnexpectedByte", "DigitDotExpOrBoundary", 1, "Num"),
    ("1.5x]", "UnexpectedByte", "DigitExpOrBoundary", 3, "Num"),
    ("2e5x]", "UnexpectedByte", "DigitOrBoundary", 3, "Num"),
    ("2e]", "UnexpectedByte", "DigitOrExpSign", 2, "Num"),
    ("truth]", "UnexpectedByte", "Char(e)", 3, "LitTrue"),
    ("nulls]", "UnexpectedByte", "Boundary", 4, "LitNull"),
    ('"\\x"]', "UnexpectedByte", "EscChar", 2, "Str"),
    ('"a\tb"]', "UnexpectedByte", "StrChar", 2, "Str"),
    ("?]", "UnexpectedByte", "TokenStartChar", 0, None),
    ('"\\u12g4"]', "UnexpectedByte", "UnicodeEscHexDigit", 5, "Str"),
    ('"\\udc00"]', "BadSurrogate", None, 3, None),
    ('"\\ud800\\u0041"]', "BadSurrogate", None, 9, None),
    ('"\\ud800"]', "BadSurrogate", None, 3, None),
    ('"open', "UnexpectedEof", None, 5, "Str"),
    ("fal", "UnexpectedEof", None, 3, "LitFalse"),
    ("1.", "UnexpectedEof", None, 2, "Num"),
    ("3e+", "UnexpectedEof", None, 3, "Num"),
]


def _sql_text(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"


def _chosen(of: int) -> str:
    return "CASE id " + " ".join(f"WHEN {i} THEN {_sql_text(x[of]) if of != 3 else x[3]}" for i, x in enumerate(_FAULTS)) + " END"


@_query(f"""WITH d AS (SELECT o_orderkey AS oid, o_orderkey % {len(_FAULTS)} AS id, '[' || o_custkey || ',' AS head FROM orders)
SELECT oid AS id, 'lexical' AS class, {_chosen(1)} AS variant, {_chosen(2)} AS expect, {_chosen(4)} AS token, strlen(head) + {_chosen(3)} AS err_offset, strlen(head) AS token_offset, length(head) + 1 AS token_col,
 CAST(2 AS BIGINT) AS n_before_head FROM d""")
def lexical_errors(spark, sf_dir):
    """All twelve expectations, surrogates out of place and texts that end inside a token, each behind a number of any length."""
    o = _table(spark, sf_dir, "orders")
    tails = F.array(*(F.lit(x[0]) for x in _FAULTS))
    docs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(","), F.get(tails, (F.col("o_orderkey") % len(_FAULTS)).cast("int"))).alias("text"))
    e = js.validate(docs, columns=["n_tokens", "err"])
    return e.select("id", "err.class", "err.variant", "err.expect", "err.token", F.col("err.err_pos.offset").alias("err_offset"), F.col("err.token_pos.offset").alias("token_offset"), F.col("err.token_pos.col").alias("token_col"), (F.col("n_tokens") - 1).alias("n_before_head"))


@_query("""WITH d AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, strlen('["' || o_custkey) AS n FROM orders)
SELECT id, k = 0 AS is_valid, CASE WHEN k > 0 THEN 'BadUtf8ContByte' END AS variant, CASE k WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS seq_len, CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 END AS byte_no, CASE WHEN k > 0 THEN n END AS err_offset FROM d""")
def bad_utf8(spark, sf_dir):
    """Bytes that break UTF-8 inside a string of a binary text."""
    o = _table(spark, sf_dir, "orders")
    tails = F.array(*(F.unhex(F.lit(x)) for x in ("C3A9225D", "C228225D", "E08080225D", "F18080C0225D")))
    docs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.encode(F.concat(F.lit('["'), F.col("o_custkey").cast("string")), "UTF-8"), F.get(tails, (F.col("o_orderkey") % 4).cast("int"))).alias("text"))
    e = js.validate(docs, columns=["is_valid", "err"])
    return e.select("id", "is_valid", "err.variant", "err.seq_len", "err.byte_no", F.col("err.err_pos.offset").alias("err_offset"))


@_query("SELECT o_orderkey AS id, 'line 1, column ' || (strlen(CAST(o_custkey AS VARCHAR)) + 2) || ' (offset: ' || (strlen(CAST(o_custkey AS VARCHAR)) + 1) || ')' AS place FROM orders")
def position_texts(spark, sf_dir):
    """Where the comma of a text stands, as text."""
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _text("[", F.col("o_custkey"), ",1]").alias("text"))
    commas = js.tokenize(docs, columns=["kind", "offset", "line", "col"], eof=False).where("kind = 'ValueSep'")
    return commas.select("id", scalars.position_text(F.col("offset"), F.col("line"), F.col("col")).alias("place"))


@_query(f"{_TOKENS_SQL}, l AS (SELECT id, i, t, sum(CASE WHEN t IN ('{{', '[') THEN 1 WHEN t IN ('}}', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS level FROM toks) SELECT id, i, level, CASE level WHEN 0 THEN '' WHEN 1 THEN 'Obj' WHEN 2 THEN 'Obj,Obj' ELSE 'Obj,Obj,Arr' END AS stack FROM l")
def token_stacks(spark, sf_dir):
    rows = js.parse(_orders(spark, sf_dir), columns=["i", "level", "stack"], eof=False)
    return rows.select("id", "i", "level", F.array_join("stack", ",").alias("stack"))


@_query(f"{_TOKENS_SQL}, l AS (SELECT id, i, t, {_KIND_SQL} AS kind FROM toks) SELECT id, i, kind, CASE WHEN i = 16 THEN '/cust/tags/0' WHEN i IN (8, 20) THEN '/cust' END AS pointer, CASE WHEN i = 16 THEN 'Match' WHEN i = 8 THEN 'Enter' WHEN i = 20 THEN 'Exit' ELSE 'Nil' END AS event FROM l WHERE kind NOT IN ('White', 'NameSep', 'ValueSep')")
def events_meaningful(spark, sf_dir):
    """Events without those of white space and separators."""
    return js.pointer_events(_orders(spark, sf_dir), ["/cust", "/cust/tags/0"], nil=True, skip=js.SEPARATORS, columns=["i", "kind", "pointer", "event"])


@_query("SELECT o_orderkey AS id, i, event FROM orders, (VALUES (8, 'Enter'), (20, 'Exit')) t(i, event)")
def events_next_end(spark, sf_dir):
    """What lies in /cust behind its opening bracket (token 8) is left out, its end stays."""
    rows = js.pointer_events(_orders(spark, sf_dir), ["/cust", "/cust/id", "/cust/tags", "/cust/tags/1"], after=8, columns=["i", "event"])
    return rows.select("id", F.col("i").cast("int").alias("i"), "event")


@_query(f"SELECT id, '/cust/tags/1' AS pointer, 'Arr' AS inside, 'Obj,Obj,Arr' AS stack, CAST(strpos(text, ']}}') - 2 AS BIGINT) AS \"offset\", CAST(strpos(text, ']}}') - 1 AS BIGINT) AS col FROM ({_ORDER_SQL})")
def event_context(spark, sf_dir):
    """Where an event's token stands and what is open there."""
    rows = js.pointer_events(_orders(spark, sf_dir), ["/cust/tags/1"], columns=["pointer", "inside", "stack", "offset", "col"])
    return rows.withColumn("stack", F.array_join("stack", ","))


@_query(f"{_TOKENS_SQL} SELECT id, i, {_KIND_SQL} AS kind, t AS literal FROM toks")
def sql_tokens(spark, sf_dir):
    """The table function over texts, in SQL."""
    tables.register(spark)
    _orders(spark, sf_dir).createOrReplaceTempView("tokenloom_orders")
    return spark.sql("SELECT id, i, kind, literal FROM json_tokens(TABLE(SELECT id, text FROM tokenloom_orders)) WHERE kind <> 'Eof'")


@_query(f"SELECT id, '/cust/id' AS pointer, json_extract_string(text, '/cust/id') AS literal FROM ({_ORDER_SQL}) UNION ALL SELECT id, '/cust/tags/1', json_extract_string(text, '/cust/tags/1') FROM ({_ORDER_SQL})")
def sql_pointer_events(spark, sf_dir):
    tables.register(spark)
    _orders(spark, sf_dir).createOrReplaceTempView("tokenloom_orders")
    return spark.sql("SELECT id, pointer, literal FROM json_pointer_events(TABLE(SELECT id, text, array('/cust/tags/1', '/cust/id') AS pointers FROM tokenloom_orders))")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
