"""URL filters as of the time of fetch.

A list is a log of dated entries: a host or domain goes on or comes off.  Entries become intervals during which
they hold, and each capture is held against the intervals that its fetch time lies in, so a later
change of a list doesn't rewrite what was right at the time.  DataFrame functions only.

Captures don't meet the list one by one: distinct hosts do, under each of their parent domains, and a
capture then joins its host's few intervals.  A host with a third of all captures is one row there; the
join's large side can be split between tasks.  Entries with a path meet distinct pages of their hosts alone, by
each folder a page lies in, so a host with a million such entries hangs none on captures that lie elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stage

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^\[\]/:?#]+)(?::[0-9]*)?"
HOST = _AUTHORITY + r"(?:[/?#]|$)"
PATH = _AUTHORITY + r"(/[^?#]*)"
ACTIONS = ("add", "remove")
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ZONED = r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without its trailing dot (an IPv6 address in its brackets); null where there is none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment, at least a slash."""
    return F.coalesce(F.nullif(F.regexp_extract(url, PATH, 2), F.lit("")), F.lit("/"))


def normalised(entries: DataFrame) -> DataFrame:
    """(list_name, domain, action, at) -> (list_name, domain, prefix, action, at), one spelling for each entry.

    domain is a host or domain, or one with a path (a scheme before it is ignored); it is compared in lower
    case, without blanks around it and without a trailing dot.  prefix: the path without its last slash, as
    it is written, empty for a whole domain.  action: add or remove in any case; any other is an error, found
    before anything is filtered.  at: a timestamp, or text that is UTC unless it names its zone.  Entries with a null in
    any column, or without a domain, are left out.
    """
    text = dict(entries.dtypes)["at"] == "string"
    spelled = F.trim(F.regexp_replace("domain", "^\\s*[A-Za-z][A-Za-z0-9+.-]*://", ""))
    domain = F.rtrim(F.lower(F.regexp_extract(spelled, r"^(\[[^\]]*\]|[^/:?#]+)", 1)), F.lit("."))
    prefix = F.rtrim(F.regexp_extract(spelled, r"^[^/]*(/[^?#]*)", 1), F.lit("/"))
    told = F.trim("at")
    zoned = F.when(told.rlike(_DAY), F.concat(told, F.lit(" 00:00:00+00:00"))).when(told.rlike(_ZONED), told).otherwise(F.concat(told, F.lit("+00:00")))
    at = F.to_timestamp(zoned) if text else F.col("at").cast("timestamp")
    rows = entries.select("list_name", domain.alias("domain"), prefix.alias("prefix"), F.lower(F.trim("action")).alias("action"), at.alias("at")).dropna().where("domain <> ''")
    if unknown := [r.action for r in rows.select("action").distinct().where(~F.col("action").isin(*ACTIONS)).limit(5).collect()]:
        raise ValueError(f"actions {unknown}: only add and remove are known")
    return rows


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, domain, action, at) -> (list_name, domain, prefix, valid_from, valid_to), valid_to exclusive, null if open.

    At one instant a removal wins over an addition; repeated entries change nothing.  See `normalised`.
    """
    key = ("list_name", "domain", "prefix")
    last = normalised(entries).groupBy(*key, "at").agg(F.max("action").alias("action"))  # remove > add
    by = Window.partitionBy(*key).orderBy("at")
    turns = last.withColumn("was", F.lag("action", 1, "remove").over(by)).where("action <> was")
    spans = turns.withColumn("valid_to", F.lead("at").over(by)).where("action = 'add'")
    return spans.select(*key, F.col("at").alias("valid_from"), "valid_to")


_SPANS = ("list_name", "domain", "prefix", "valid_from", "valid_to")


def _parents(host: str) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_intervals(hosts: DataFrame, spans: DataFrame) -> DataFrame:
    """(host) -> (host, spans): the intervals of the host and its parent domains, hosts without any left out."""
    found = hosts.select("host", F.explode(_parents("host")).alias("domain")).join(spans, "domain")
    return found.groupBy("host").agg(F.collect_list(F.struct(*_SPANS)).alias("spans"))


def page_intervals(pages: DataFrame, spans: DataFrame, depth: int) -> DataFrame:
    """(host, path) -> (host, path, spans): the intervals of entries whose path, of depth parts at most, the page is or lies below.

    pages: any rows; distinct ones of hosts that have such entries are taken.  Pages without any are left out.
    """
    domains = spans.select("domain").distinct()
    hosts = pages.select("host").where("host is not null").distinct()
    hosts = hosts.select("host", F.explode(_parents("host")).alias("domain")).join(domains, "domain")
    hosts = stage(hosts.select("host", "domain"), "url-path-hosts")  # its true size says whether pages are shuffled by host at all
    keyed = pages.select("host", "path").join(hosts, "host").distinct()
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(2), F.least(F.size(parts), F.lit(depth + 1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = keyed.select("host", "path", "domain", F.explode(folders).alias("prefix")).join(spans, ["domain", "prefix"])
    return found.groupBy("host", "path").agg(F.collect_list(F.struct(*_SPANS)).alias("spans"))


def as_of(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Captures with host, n_active, active_lists and blocked, from the entries active at their fetch time.

    active_lists: names in order, comma-joined, empty if none; n_active: intervals that hold.  An entry with a
    path holds for that path and what lies below it.  A URL without a host, a null URL and a null fetch time
    match nothing and are not blocked.  Repeated captures stay, no captures give none, and columns of captures
    named like these are an error.
    """
    taken = {"host", "spans", "n_active", "active_lists", "blocked", "_path", "_below"}
    if clash := taken & {c.lower() for c in captures.columns}:
        raise ValueError(f"columns named {sorted(clash)}: rename them first")
    hosted = captures.withColumns({"host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    spans = stage(intervals(entries), "url-intervals")
    depth = spans.agg(F.max(F.size(F.split("prefix", "/")) - 1)).first()[0]
    table = stage(host_intervals(hosted.select("host").where("host is not null").distinct(), spans.where("prefix = ''")), "url-hosts")
    joined, held = hosted.join(table, "host", "left"), ["spans"]
    if depth:
        pages = page_intervals(hosted.select("host", F.col("_path").alias("path")), spans.where("prefix <> ''"), depth)
        pages = stage(pages.withColumnsRenamed({"path": "_path", "spans": "_below"}), "url-pages")
        joined, held = joined.join(pages, ["host", "_path"], "left"), [*held, "_below"]
    at, none = F.col(fetched), F.array().cast(table.schema["spans"].dataType)
    holds = lambda s: (s["valid_from"] <= at) & (s["valid_to"].isNull() | (at < s["valid_to"]))
    active = F.filter(F.concat(*(F.coalesce(c, none) for c in held)), lambda s: F.coalesce(holds(s), F.lit(False)))
    out = joined.withColumn("spans", active).withColumns({
        "n_active": F.size("spans").cast("long"),
        "active_lists": F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["list_name"]))), ","),
        "blocked": F.size("spans") > 0,
    })
    return out.select(*captures.columns, "host", "n_active", "active_lists", "blocked")
