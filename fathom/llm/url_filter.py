"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes, confirmed by full digests.

A URL expands into every suffix of its host of two labels or more (the whole host included) times every path prefix: the
root, each directory, the whole path and the path with its query. An expression is ``host + path``; a rule names one.
Expressions meet rules on the first four bytes of their SHA-256; pairs count when all 32 bytes agree. Of the rules that
match, the most specific decides: the longest host suffix, then the longest path, then allow before block, then the
smallest rule id.

Only what some rule could be is expanded: host suffixes of as many labels and directories of as many steps as a rule has,
and nothing longer than the longest rule. That leaves out no match, and makes an URL's cost depend on the rules, not on
the square of its length.

Defined results
- null or unparsable URL (no ``scheme://host``): verdict "none". Repeated rows: each has its own verdict.
- very long URLs: judged whole; expressions longer than every rule aren't built, as none can match.
- IP addresses (four numbers, a bracketed IPv6 address, or any host whose last label is a number) have no suffixes: only the
  whole host counts. An IPv6 host is written with its brackets. Other notations of an address aren't recognised.
- case: schemes and hosts are compared in lower case, paths as written. User, port and fragment don't count. Runs of slashes
  and ``/./`` in a path are one slash; ``..`` and percent signs are compared as written.
- rules with a null id, expression or an action other than allow and block: ignored. No rules: "none" throughout.
- rule id ties (the same rule twice): one counts. Empty table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import c

#: rule id, expression, action, category
RULES = (
    (1, "casino-win.example.com/", "block", "gambling"),
    (2, "free-bets.example.com/", "block", "gambling"),
    (3, "ads-track.example.com/", "block", "advertising"),
    (4, "spam-farm.example.com/", "block", "spam"),
    (5, "cheap-pills.example.com/", "block", "pharma"),
    (6, "adult-x.example.net/", "block", "adult"),
    (7, "casino-win.example.com/en/", "block", "gambling"),
    (8, "m.ads-track.example.com/de/", "allow", "reviewed"),
    (9, "free-bets.example.com/fr/", "allow", "reviewed"),
    (10, "doubleclick.net/", "block", "advertising"),
    (11, "localhost.localdomain/", "block", "private"),
)


def rules_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_id long, expression string, action string, category string")


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"
#: Several slashes, and then slashes with dots between them: each becomes one slash.
SLASHES, DOTS = "//+", r"/(?:\./)+"
ADDRESS = r"^\[|(?:^|\.)[0-9]+$"


class Shapes(NamedTuple):
    """What the rules' expressions look like: how many labels their hosts have, how many steps their directories, and how
    long the longest is. At most 127 labels, and fewer steps than the root of twice all rules' characters."""

    labels: list[int]
    steps: list[int]
    longest: int


def shapes(known: DataFrame) -> Shapes:
    host, path = F.regexp_extract("expression", "^([^/]*)", 1), F.regexp_extract("expression", "^[^/]*([^?]*)", 1)
    labels = F.when(host.rlike(ADDRESS), 0).otherwise(F.size(F.split(host, "\\.")))
    row = known.agg(F.collect_set(labels).alias("labels"), F.collect_set(F.when(path.endswith("/"), F.size(F.split(path, "/")) - 1)).alias("steps"), F.max(F.length("expression")).alias("longest")).first()
    return Shapes(sorted(row["labels"]), sorted(row["steps"]), row["longest"] or 0)


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")


def expressions(url: Column, wanted: Shapes) -> Column:
    """array<struct<e: expression, labels, length>>; null for a URL without host."""
    host = F.btrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    rest = F.regexp_extract(url, REST, 1)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), SLASHES, "/"), DOTS, "/")
    rest = F.concat(path, F.regexp_extract(rest, r"^[^?]*(.*)", 1))
    labels = F.split(host, "\\.")
    # of names the suffixes of two labels or more that a rule has, and the whole
    suffixes = F.transform(F.filter(_ints(wanted.labels), lambda n: (n >= 2) & (n < F.size(labels))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    hosts = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.array_append(suffixes, host))
    short = F.substring(path, 1, wanted.longest)
    steps = F.size(F.split(short, "/")) - 1
    directories = F.transform(F.filter(_ints(wanted.steps), lambda n: n <= steps), lambda n: F.concat(F.call_function("substring_index", short, F.lit("/"), n), F.lit("/")))
    paths = F.array_distinct(F.concat(directories, F.filter(F.array(path, rest), lambda p: F.length(p) <= wanted.longest)))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(F.concat(h, p).alias("e"), F.size(F.split(h, "\\.")).alias("labels"), F.length(p).alias("length")))))
    return F.when(host != "", F.filter(both, lambda x: F.length(x["e"]) <= wanted.longest))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, verdict, rule_id, category, expression) for each row."""
    valid = (
        rules.where("rule_id is not null and expression is not null and action in ('allow', 'block')")
        .select("rule_id", "expression", "action", "category")
    )
    wanted = shapes(valid)
    known = valid.withColumn("digest", F.sha2("expression", 256)).select("rule_id", "action", "category", "digest", F.substring("digest", 1, 8).alias("prefix"))
    # equal URLs are judged once; the join's key for the way back is the URL, so no row needs a number of its own
    urls = pages.select(c(url_col).alias("url")).where("url is not null").distinct()
    expanded = urls.select("url", F.explode(expressions(F.col("url"), wanted)).alias("x")).select("url", "x.*").withColumn("digest", F.sha2("e", 256))
    hits = expanded.withColumn("prefix", F.substring("digest", 1, 8)).join(known.withColumnRenamed("digest", "full"), "prefix").where("digest = full")
    order = F.struct("labels", "length", (F.col("action") == "allow").cast("int").alias("allow"), (-F.col("rule_id")).alias("id"), "action", "category", "e")
    best = hits.groupBy("url").agg(F.max(order).alias("b"))
    judged = best.select(F.col("url").alias("u"), F.col("b.action").alias("verdict"), (-F.col("b.id")).alias("rule_id"), F.col("b.category").alias("category"), F.col("b.e").alias("expression"))
    own = pages.select(c(id_col).alias(id_col), c(url_col).alias(url_col))
    return own.join(judged, c(url_col) == F.col("u"), "left").select(
        c(id_col), c(url_col), F.coalesce("verdict", F.lit("none")).alias("verdict"), "rule_id", "category", "expression"
    )


def sql(rules: tuple = RULES) -> str:
    values = ", ".join(f"({i}, '{e}', '{a}', '{k}')" for i, e, a, k in rules)
    return f"""
with rules(rule_id, expression, action, category) as (values {values}),
p as (select distinct url, trim(lower(regexp_extract(url, '{HOST}', 1)), '.') as host, regexp_extract(url, '{REST}', 1) as r from pages),
q as (select url, host, string_split(host, '.') as labels, case when starts_with(r, '/') then r else '/' || r end as rest from p where host <> ''),
c as (select url, host, labels, regexp_replace(regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '{SLASHES}', '/', 'g'), '{DOTS}', '/', 'g') as path, regexp_extract(rest, '^[^?]*(.*)', 1) as query from q),
h as (
  select url, path, query, len(labels) - i + 1 as n, array_to_string(labels[i:], '.') as host
  from (select *, unnest(range(1, case when regexp_matches(host, '{ADDRESS}') then 2 else greatest(len(labels), 2) end)) as i from c)
), s as (select *, path || query as rest, string_split(path, '/') as parts from h),
e as (
  select url, n, host, unnest(list_distinct(list_concat(list_transform(range(1, greatest(len(parts), 2)), lambda i: array_to_string(parts[1:i], '/') || '/'), [path, rest]))) as path from s
), m as (
  select url, rule_id, action, category, expression,
    row_number() over (partition by url order by n desc, length(path) desc, case when action = 'allow' then 0 else 1 end, rule_id) as rn
  from e join rules on host || path = expression
)
select page_id, pages.url, coalesce(action, 'none') as verdict, rule_id::bigint as rule_id, category, expression
from pages left join (select * from m where rn = 1) b on b.url = pages.url
"""
