"""URL filters: host and path rules, and a path-template tree judged by labels.

Where no rule fits, a url is judged by its template. Templates are made per
host, level by level: below a branch, segments that few of its urls have become
``*``. Branches whose labelled urls are bad about as often as their siblings'
are merged with them. A template is rejected when its smoothed share of bad
urls is high; the smoothing draws towards the host, and the host towards all.

Everything is DataFrame functions. Statistics are partial sums by (host,
branch, segment); no host passes through one task.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment stays literal if so many urls of its branch have it, however many the branch has.
LEAST_URLS = 5
#: Standard errors by which a branch must differ from its siblings to stay apart.
APART = 2.0
#: Labelled urls that the smoothing weighs as much as.
STRENGTH = 10.0
#: Share of bad urls from which a template is rejected.
REJECT = 0.5


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """(host, path) of a rule like ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of fitting rules of one length the last by name wins. The lookup is by the
    host's suffixes, so it costs no more with many rules.
    """
    by_host: dict[str, list[Column]] = defaultdict(list)
    for rule, verdict in rules:
        name, start = split_rule(rule)
        by_host[name].append(F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(start).alias("start")))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,start:string>")
    table = F.create_map(*[x for name, found in by_host.items() for x in (F.lit(name), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    found = F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(table, s)), lambda s: table[s]))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["start"])))


def _next_level(urls: DataFrame, level: int, least_urls: int) -> DataFrame:
    """Add the segment of ``level``, or ``*``, to the template of each url that has one."""
    segment = F.when(F.size("segments") > level, F.get("segments", F.lit(level)))
    urls = urls.withColumn("segment", segment)
    counts = urls.where("segment is not null").groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where(F.col("n") >= least_urls)
    kept = cut(kept.select("host", "template", "segment", F.lit(True).alias("literal")), "segments")
    step = F.when(F.col("segment").isNull(), "").when(F.col("literal"), F.concat(F.lit("/"), "segment")).otherwise("/*")
    joined = urls.join(kept, ["host", "template", "segment"], "left")
    return joined.withColumn("template", F.concat("template", step)).drop("segment", "literal")


def templates(urls: DataFrame, least_urls: int = LEAST_URLS) -> DataFrame:
    """``urls`` (host, path, ...) with its template.

    Levels go on as long as a url has a further segment and its branch enough
    urls for one to stay literal; below that nothing but ``*`` can follow, so
    the rest is filled in at once and one long path costs no rounds.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    done = urls.withColumn("segments", parts).withColumn("template", F.lit(""))
    levels = 0
    while True:
        more = done.where(F.size("segments") > levels).groupBy("host", "template").count().where(F.col("count") >= least_urls)
        if more.isEmpty():
            break
        done = cut(_next_level(done, levels, least_urls), "urls")
        levels += 1
    rest = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - levels, F.lit(0)))
    return done.withColumn("template", F.concat("template", rest)).drop("segments")


def _apart(n: str, bad: str, all_n: str, all_bad: str, errors: float) -> Column:
    """True where a branch's share of bad urls is more than ``errors`` standard errors from that of its group."""
    share = F.when(F.col(all_n) > 0, F.col(all_bad) / F.col(all_n))
    error = F.sqrt(share * (1 - share) * (1 / F.col(n) + 1 / F.col(all_n)))
    return F.coalesce((F.col(n) > 0) & (F.abs(F.col(bad) / F.col(n) - share) > errors * error), F.lit(False))


def merge_branches(judged: DataFrame, apart: float = APART) -> DataFrame:
    """host, template, merged, n, bad of rows host, template, n, bad (labelled urls, bad ones).

    From the deepest level up, the branches that differ at that level alone are
    held against all of them together: those alike take ``*`` there. The others
    are held against those on their side of the common share: those alike take
    ``*high`` or ``*low``, and what differs from both stays literal. n and bad
    are the merged sums.
    """
    rows = judged.withColumn("merged", F.split(F.regexp_replace("template", "^/", ""), "/"))
    literal = F.transform("merged", lambda s, i: F.when((s != "*") & (s != ""), i + 1).otherwise(0))
    levels = rows.agg(F.max(F.array_max(literal))).first()[0] or 0  # deeper ones are * throughout
    for level in reversed(range(levels)):
        with_mark = lambda mark: F.transform("merged", lambda s, i: F.when(i == level, mark).otherwise(s))  # noqa: B023, E731
        rows = rows.withColumn("starred", with_mark(F.lit("*")))
        own = rows.groupBy("host", "merged", "starred").agg(F.sum("n").alias("own_n"), F.sum("bad").alias("own_bad"))
        every = own.groupBy("host", "starred").agg(F.sum("own_n").alias("all_n"), F.sum("own_bad").alias("all_bad"))
        own = own.join(every, ["host", "starred"]).withColumn("apart", _apart("own_n", "own_bad", "all_n", "all_bad", apart))
        high = F.col("own_bad") * F.col("all_n") > F.col("all_bad") * F.col("own_n")
        own = own.withColumn("side", F.when(~F.col("apart"), "").when(high, "high").otherwise("low"))
        sides = own.groupBy("host", "starred", "side").agg(F.sum("own_n").alias("side_n"), F.sum("own_bad").alias("side_bad"), F.count(F.lit(1)).alias("branches"))
        own = own.join(sides, ["host", "starred", "side"])
        alone = (F.col("side") != "") & ((F.col("branches") == 1) | _apart("own_n", "own_bad", "side_n", "side_bad", apart))
        own = own.withColumn("next", F.when(alone, F.col("merged")).otherwise(with_mark(F.concat(F.lit("*"), "side"))))
        rows = cut(rows.drop("starred").join(own.select("host", "merged", "next"), ["host", "merged"]).drop("merged").withColumnRenamed("next", "merged"), "branches")
    rows = rows.withColumn("merged", F.concat(F.lit("/"), F.array_join("merged", "/")))
    sums = rows.groupBy("host", "merged").agg(F.sum("n").alias("m_n"), F.sum("bad").alias("m_bad"))
    return rows.drop("n", "bad").join(sums, ["host", "merged"]).withColumnsRenamed({"m_n": "n", "m_bad": "bad"})


def smoothed(judged: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """Add ``bad_share``: the template's share of bad urls, drawn towards the host's, itself drawn towards that of all."""
    one = judged.select("host", "merged", "n", "bad").distinct()
    everything = one.agg(F.sum("bad").alias("g_bad"), F.sum("n").alias("g_n")).select(F.coalesce(F.col("g_bad") / F.nullif("g_n", F.lit(0)), F.lit(0.0)).alias("prior"))
    hosts = one.groupBy("host").agg(F.sum("bad").alias("h_bad"), F.sum("n").alias("h_n")).crossJoin(F.broadcast(everything))  # one row
    hosts = hosts.select("host", ((F.col("h_bad") + strength * F.col("prior")) / (F.col("h_n") + strength)).alias("h_share"))
    return judged.join(hosts, "host").withColumn("bad_share", (F.col("bad") + strength * F.col("h_share")) / (F.col("n") + strength)).drop("h_share")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str | None = None,
    least_urls: int = LEAST_URLS,
    apart: float = APART,
    strength: float = STRENGTH,
    reject: float = REJECT,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, bad_share.

    ``rules`` are (host and path, allow or block). ``bad_col`` names a boolean
    label of the url, null where unknown. Null urls and those without :// have
    empty host and path, and share the empty template. Repeated rows are judged
    each for itself; of rules that fit and are equally long the last by name
    wins. Whole urls are read, however long. Other columns of ``pages`` are not
    read. Without labels nothing is rejected but by rules. An empty table gives
    no rows. The other parameters are those that the module's head explains.
    """
    bad = F.col(bad_col).cast("int") if bad_col else F.lit(None).cast("int")
    urls = cut(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), bad.alias("bad")), "pages")
    urls = cut(templates(urls, least_urls), "templates")
    counts = urls.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    table = smoothed(merge_branches(counts, apart), strength).select("host", "template", "merged", "bad_share")
    found = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = urls.drop("bad").join(cut(table, "judged"), ["host", "template"], "left").withColumn("found", found)
    verdict = F.coalesce("found.verdict", F.when(F.col("bad_share") >= reject, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.col("merged").alias("template"), "bad_share")
