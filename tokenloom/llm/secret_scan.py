"""Secret scans with an incremental ledger of blobs.  DataFrame functions only.

A version of a document is a path and a blob; a blob is addressed by the SHA-256 of its bytes.  The ledger
keeps every version that a path has held, which blobs were scanned under which version of the rules, and what
was found.  A scan takes only pairs of blob and rules that the ledger lacks, each once, however many paths hold
it, and joins findings back to every path, in what it holds now or in all that it ever held.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import fresh_path, stage, whole_text

RULES_VERSION = "1.2"


@dataclass(frozen=True)
class Rule:
    """kind, pattern and, if only some matches count, the least length of a group.  A match that fails is used up."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_KEY = r"(?:[A-Z]+ )?PRIVATE KEY-----"
#: A private key from its BEGIN to its END, with up to 16 single hyphens between (as in DEK-Info); where END is missing, to
#: the end of the last base64 line, or of a base64 run of 40 characters.  One class runs over all lines: no group repeats by
#: line, the scan is linear and no engine's stack grows with the key.
PEM = rf"-----BEGIN {_KEY}(?:[^-]*(?:-[^-]+){{0,16}}-----END {_KEY}|(?:[\r\n]+(?:Proc-Type|DEK-Info): [^\r\n]*){{0,2}}[\x20\t]*[A-Za-z0-9+/=\r\n]*(?:[A-Za-z0-9+/=](?:\r|(?m:$))|[A-Za-z0-9+/=]{{40}}))?"
#: The patterns, fixed values; the first three are the base, in order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}(\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})?", 1, 1),  # a run without the rest is used up, not tried again
)
BASE = ("assign", "access", "hex")
#: start and end count code points; first and last bytes, and done the bytes up to which earlier spans reach.
SPAN = "struct<start:long,ord:int,kind:string,end:long,first:long,last:long,done:long>"
#: Words of the bitmap that tells blobs with findings, at most: 64 bits each, 16 MB together.
BITMAP_WORDS = 1 << 20


def _parts(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in order: number, code points and bytes of the gap before each and of itself, and whether it counts.

    What stands between matches (`split`) and the matches themselves are all of the text, so running sums over
    them are the offsets.
    """
    pattern = F.lit(f"({rule.pattern})") if not rule.group else F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    sizes = lambda h, g: (F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("size"), F.octet_length(g).cast("long").alias("gap_bytes"), F.octet_length(h).cast("long").alias("size_bytes"))
    parts = F.zip_with(hits, gaps, lambda h, g: F.struct(*sizes(h, g)))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    names = ("gap", "size", "gap_bytes", "size_bytes")
    parts = F.zip_with(parts, checked, lambda p, c: F.struct(*(p[n].alias(n) for n in names), (F.length(c) >= rule.least).alias("ok")))
    parts = F.transform(parts, lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), x.alias("x")))
    # split has one part more than there are matches, which zip_with gives no match
    return F.when(text.rlike(rule.pattern), F.filter(parts, lambda x: x["x"]["ok"].isNotNull()))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(digest, text) -> (digest, spans) of blobs with findings, sorted by start, then the order of the rules.

    Matches alone are shuffled, not texts; offsets are running sums over a blob's matches, so time is linear in
    their number.  Empty texts and no rows have none; a digest that comes twice counts twice.
    """
    none = F.array().cast("array<struct<ord:int,i:int,x:struct<gap:long,size:long,gap_bytes:long,size_bytes:long,ok:boolean>>>")
    found = blobs.select("digest", F.explode(F.concat(*(F.coalesce(_parts(F.col("text"), r, i), none) for i, r in enumerate(rules)))).alias("m"))
    found = found.select("digest", "m.ord", "m.i", "m.x.*").repartition("digest")
    upto = Window.partitionBy("digest", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumns({"end": F.sum(F.col("gap") + F.col("size")).over(upto), "last": F.sum(F.col("gap_bytes") + F.col("size_bytes")).over(upto)}).where("ok")
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    found = found.select("digest", (F.col("end") - F.col("size")).alias("start"), "ord", F.get(kinds, F.col("ord")).alias("kind"), "end", (F.col("last") - F.col("size_bytes")).alias("first"), "last")
    earlier = Window.partitionBy("digest").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("done", F.coalesce(F.max("last").over(earlier), F.lit(0).cast("long")))
    return found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "first", "last", "done"))).alias("spans"))


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Ledger:
    """Versions of paths, scanned pairs and findings in three Parquet tables below a path that all executors see."""

    TABLES = {"versions": "run string, doc_id {id}, digest string", "scanned": "digest string, rules string", "findings": f"digest string, rules string, spans array<{SPAN}>"}

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {name: schema.format(id=id_type) for name, schema in self.TABLES.items()}
        for name, schema in self.schemas.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def scanned(self, version: str) -> DataFrame:
        return self._table("scanned").where(F.col("rules") == version).select("digest")

    def findings(self, version: str) -> DataFrame:
        """(digest, spans); a digest that a repeated run has written twice counts once."""
        return self._table("findings").where(F.col("rules") == version).dropDuplicates(["digest"]).select("digest", "spans")

    def versions(self, run: str | None = None) -> DataFrame:
        """(doc_id, digest): what each path held in a run, or every version that it ever held."""
        all_ = self._table("versions")
        return all_.where(F.col("run") == run).select("doc_id", "digest") if run else all_.select("doc_id", "digest").distinct()

    def history(self, version: str) -> DataFrame:
        """(doc_id, digest, spans) of every version of every path that has findings, those long replaced too."""
        return self.versions().join(self.findings(version), "digest").select("doc_id", "digest", "spans")

    def add(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> tuple[int, str]:
        """Scan the blobs of (doc_id, text) that have no row under this version; returns how many there were, and the run.

        Each new blob is scanned in one row that holds it: the one with the smallest doc_id.  Findings are
        written before the pairs, so a run that breaks off leaves pairs to scan again and none unscanned.
        """
        run = uuid.uuid4().hex
        held = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", digest_of(F.col("text")))
        held.select(F.lit(run).alias("run"), "doc_id", "digest").write.mode("append").parquet(f"{self.path}/versions")
        holders = self.versions(run).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        fresh = stage(holders.join(self.scanned(version), "digest", "left_anti"), "secrets-fresh")
        n = fresh.count()
        if n:
            one = held.join(fresh.hint("shuffle_hash"), (held.digest == fresh.digest) & held.doc_id.eqNullSafe(fresh.doc_id), "left_semi")
            found = scan(one.select("digest", "text"), rules).withColumn("rules", F.lit(version))
            found.select("digest", "rules", "spans").write.mode("append").parquet(f"{self.path}/findings")
            fresh.select("digest", F.lit(version).alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")
        return n, run


def _ledger(docs: DataFrame, ledger: Ledger | None) -> Ledger:
    return ledger or Ledger(docs.sparkSession, fresh_path(docs.sparkSession, "secret-ledger"), docs.schema["doc_id"].dataType.simpleString())


def findings(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """(doc_id, text) -> (doc_id, digest, spans) of every row, spans empty where nothing was found.

    Without a ledger a new one in the shared folder is used.  Null text is the empty blob; repeated rows and
    null doc_ids keep their rows; other columns are ignored.
    """
    ledger = _ledger(docs, ledger)
    _, run = ledger.add(docs, rules, version)
    joined = ledger.versions(run).join(ledger.findings(version), "digest", "left")
    return joined.select("doc_id", "digest", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def digests(found: DataFrame, kinds: tuple[str, ...] = BASE) -> DataFrame:
    """Adds n_<kind> for each kind, base_sha256 and spans as text to rows with an array of spans."""
    told = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = {f"n_{k}": F.size(F.filter("spans", of_kind(k))).cast("long") for k in kinds}
    return found.withColumns(counts | {"base_sha256": F.sha2(F.array_join(F.transform(base, told), ",").cast("binary"), 256), "spans": F.array_join(F.transform("spans", told), ",")})


def _bit(digest: Column, words: int) -> tuple[Column, Column]:
    """The word of a bitmap of that many words that a digest belongs to, and its bit there."""
    h = F.xxhash64(digest)
    return F.pmod(h, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(64)).cast("int"))


def redacted_documents(docs: DataFrame, mask: str = "[SECRET]", ledger: Ledger | None = None) -> DataFrame:
    """The documents with every found span replaced by mask, in the columns of docs (n_chars follows the text).

    Overlapping spans are masked once.  A bitmap of the digests with findings, of bounded size and so broadcast,
    tells most documents without any where they lie; only the others are shuffled to the findings.  Null
    texts, empty ones and repeated rows stay as they are.
    """
    ledger = _ledger(docs, ledger)
    ledger.add(docs)
    found = stage(ledger.findings(RULES_VERSION), "secrets-found")
    words = min(BITMAP_WORDS, 1 << max(found.count() - 1, 0).bit_length())
    word, bit = _bit(F.col("digest"), words)
    bitmap = stage(found.select(word.alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "secrets-bitmap")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), digest_of(whole_text()).alias("digest"))
    marked = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")  # BITMAP_WORDS rows at most
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    clean = marked.where(~maybe).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
    joined = marked.where(maybe).join(found, "digest", "left").withColumn("_data", F.col("_row")["text"].cast("binary"))
    cut = lambda a, b: F.substring("_data", (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    pieces = F.transform("spans", lambda s: F.when(s["first"] >= s["done"], F.concat(cut(s["done"], s["first"]), F.lit(mask))).otherwise(""))
    upto = F.array_max(F.transform("spans", lambda s: s["last"]))
    masked = F.concat(F.array_join(pieces, ""), cut(upto, F.octet_length("_data")))
    joined = joined.withColumn("_text", F.when(F.coalesce(F.size("spans"), F.lit(0)) > 0, masked).otherwise(F.col("_row")["text"]))
    fresh = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return clean.unionByName(joined.select(*(fresh.get(c, F.col("_row")[c]).alias(c) for c in docs.columns)))
