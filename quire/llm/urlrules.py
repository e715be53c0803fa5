"""URL filters as a sort-merge range join over nested rules.

A rule is a host and a path: it fits the host and its subdomains where the url's path starts
with the rule's. Turned round label by label (`net.example.`), the host of a rule is a prefix of
the hosts it fits, so it is an interval of the sorted hosts; in the same way its path is an interval
of the sorted paths. Intervals of prefixes nest. Each gives two events: at its start it is put
on the stack of what is open, at its end the stack around it is back. Sorted
together with the urls, the last event before a url tells what is open there.

Two such sweeps are made. The first goes over hosts and finds all sites (hosts with rules) that
are open at a url's host; the second goes over the paths at each of these sites and finds the
longest path that is open. The longest rule over all sites of a url wins.

Everything is DataFrame functions: no Python runs on the executors. Groups of a sweep (a last label, a site)
with more than their share of the rows are dealt over salts, as many as their count asks for, and the group's
events are copied to each. The table of such groups is broadcast: it has 65,536 rows at most, as none of them has
less than a 65,536th of the rows.

Cases: a null url or one without `://` has empty host and path and gets no rule but those for the empty host; rules with equal
host and path: the verdict first in order stands; a rule without a path has the empty one and fits every
path; null rules are ignored; only A-Z are lower-cased, in urls as in rules; of equally long rules that with the longer host wins; repeated
rows come back as often; very long urls are urls; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

PARTS = 256  # a group with more than one in so many rows is split
MOST_ROWS = 1 << 20  # and one with more than so many
DEFAULT = "allow"


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What is between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lowered(host), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def turned(host: Column) -> Column:
    """A host's labels in reverse order, each with a dot: www.example.net gives net.example.www. with a dot at its end."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def intervals(rules: DataFrame) -> DataFrame:
    """site, path, rule, verdict and the rule around each (outer): rules is host, path, verdict."""
    clean = (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(turned(F.col("host")).alias("site"), "path", F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"))
    )
    # the rule around a rule is the longest that is a proper prefix of its path at the same site
    cut = clean.select("site", F.col("path").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k")).where(F.col("k") < F.length("inner"))
    around = cut.select("site", "inner", F.expr("substring(inner, 1, k)").alias("prefix")).join(
        clean.select("site", F.col("path").alias("prefix"), F.struct(F.length("path").alias("path_length"), "host_length", "rule", "verdict").alias("outer")), ["site", "prefix"]
    )
    outer = around.groupBy("site", F.col("inner").alias("path")).agg(F.max("outer").alias("outer"))
    own = F.struct(F.length("path").alias("path_length"), "host_length", "rule", "verdict").alias("own")
    return clean.select("site", "path", own).join(outer, ["site", "path"], "left")


def stacks(spans: DataFrame) -> DataFrame:
    """site and stack: the sites that are open from a site on, outermost first."""
    sites = spans.select("site").distinct()
    labels = F.split(F.expr("left(site, length(site) - 1)"), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    chain = sites.select(F.col("site").alias("inner"), F.explode(above).alias("site")).join(sites, "site")
    return chain.groupBy(F.col("inner").alias("site")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.length("site"), "site"))), lambda x: x["site"]).alias("stack"))


def sweep(rows: DataFrame, intervals: DataFrame, count: int, parts: int = PARTS) -> DataFrame:
    """What is open at each of rows (group, at, row): row and top; intervals: group, prefix, inside, outside; inside is open
    where at begins with prefix, unless a longer prefix's is, and outside behind it. count: how many rows there are.
    """
    step = max(count >> 16, min(MOST_ROWS, count // parts), 1)
    heavy = rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > step).select("group", (F.expr(f"n div {step}") + 1).cast("int").alias("salts"))
    heavy = F.broadcast(written(heavy, "heavy"))  # at most 65,536 rows
    salts = F.coalesce("salts", F.lit(1))
    raw = F.encode("prefix", "UTF-8")
    # UTF-8 has no byte 255, so the end is behind all that begins with the prefix
    starts = intervals.select("group", raw.alias("at"), F.lit(0).alias("turn"), F.length("prefix").alias("depth"), F.struct(F.col("inside").alias("open")).alias("now"))
    ends = intervals.select("group", F.concat(raw, F.unhex(F.lit("FF"))).alias("at"), F.lit(2).alias("turn"), (-F.length("prefix")).alias("depth"), F.struct(F.col("outside").alias("open")).alias("now"))
    events = starts.unionByName(ends).join(heavy, "group", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    probes = rows.join(heavy, "group", "left").select(
        "group", F.encode("at", "UTF-8").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("depth"), "row", F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt")
    )
    line = events.unionByName(probes, allowMissingColumns=True)
    order = Window.partitionBy("group", "salt").orderBy("at", "turn", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn("top", F.last("now", ignorenulls=True).over(order)["open"]).where("turn = 1").select("row", "top")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", parts: int = PARTS, default: str = DEFAULT) -> DataFrame:
    """id, host, path, rule and verdict for each row of pages; rules: host, path, verdict."""
    url = F.col(url_column).cast("string")
    row = F.struct(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).alias("row")
    rows = pages.select(row)
    spans = written(intervals(rules), "rules")
    first = lambda site: F.substring_index(site, ".", 1).alias("group")
    open_sites = stacks(spans).select(first(F.col("site")), F.col("site").alias("prefix"), F.col("stack").alias("inside"), F.expr("slice(stack, 1, size(stack) - 1)").alias("outside"))
    turned_host = turned(F.col("row.host"))
    at_hosts = rows.select(first(turned_host), turned_host.alias("at"), "row")
    found = written(sweep(at_hosts, open_sites, pages.count(), parts), "sites")
    paths = found.select(F.explode("top").alias("group"), F.col("row.path").alias("at"), "row")
    rule_paths = spans.select(F.col("site").alias("group"), F.col("path").alias("prefix"), F.col("own").alias("inside"), F.col("outer").alias("outside"))
    n = found.agg(F.sum(F.size("top"))).first()[0] or 0
    hits = sweep(paths, rule_paths, int(n), parts).where(F.col("top").isNotNull())
    top = F.col("top")
    hit = F.struct((top["path_length"] + top["host_length"]).alias("length"), top["host_length"].alias("host_length"), top["rule"].alias("rule"), top["verdict"].alias("verdict"))
    hits = hits.select("row", hit.alias("hit"), F.lit(0).alias("copy"))
    # every row once more with no hit, so that those without a rule stay and repeated ones are counted
    every = found.select("row", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.lit(1).alias("copy"))
    best = hits.unionByName(every).groupBy("row").agg(F.max("hit").alias("hit"), F.sum("copy").cast("int").alias("copies"))
    verdict = F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    one = best.select(F.col("row.id").alias(id_column), "row.host", "row.path", F.col("hit.rule").alias("rule"), verdict, "copies")
    return one.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
