"""URL filters by a sort-merge range join (native).

A rule (host, path) fits the URLs of its host and of every subdomain whose path
starts with the rule's path; the longest fitting rule (code points of host +
path; then the longer host) gives the verdict, else the default.

Host labels are reversed, so that host ``example.org`` with path ``/es/`` gets the
canonical key ``org.example./es/`` and the URLs under it are one interval of
keys: from the key itself up to the key followed by byte FF, which no UTF-8 text
holds. Intervals of prefixes nest or are disjoint. Rules (interval starts and
ends) and URLs are merged in key order; the running count of starts less ends
is the height of the stack of active rules, and the last start seen at that
height is its top, the longest active rule. Both are windows over the sorted
order, so the sweep is a sort and two passes, and no URL meets every rule.

A rule's host cuts a URL's host at a label, so the sweep runs once for each
number of labels that occurs in the rules, with the URL's key cut to as many;
the longest of these answers wins. Rows are dealt by a hash of all their columns over the sweep
buckets, each of which gets all rules' ends: no host, however hot, gathers in
one task (only rows equal in every column do), a stage that runs again deals them alike, and rules cost (buckets x rules) small rows. Rows are carried through;
nothing is joined back.

Defined results: null URLs or those without ``://`` have empty host and path and
fit no rule; a URL without a path fits only rules with an empty path; rules with
a null host, path or verdict or an empty host are ignored; of equal rules ``block``
wins; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rfmlens.llm.common import free_name, shuffle_partitions, table

#: Rules of the registered query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join("({}, {}, {})".format(*("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r))
                     for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def _key(labels: Column, n: Column | int, path: Column) -> Column:
    """Bytes of the first ``n`` reversed labels, each ended by a dot, and the path."""
    head = F.slice(labels, 1, n)
    return F.encode(F.concat(F.array_join(head, "."), F.lit("."), path), "utf-8")


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
                buckets: int | None = None) -> DataFrame:
    """``pages`` with columns host, path, rule and verdict (names that clash
    with the table's get underscores). ``rules`` has columns host, path, verdict."""
    spark = pages.sparkSession
    n = buckets or shuffle_partitions(spark)
    rules = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
             .where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
             .groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v"))
             .select("host", "path", F.col("v.verdict").alias("verdict"))
             .withColumn("labels", F.reverse(F.split("host", r"\."))))
    depths = sorted(r[0] for r in rules.select(F.size("labels")).distinct().collect())

    row = F.struct(*[pages[c].alias(f"c{i}") for i, c in enumerate(pages.columns)])
    hashed = [pages[f.name] for f in pages.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    host, path = host_of(pages[url]), path_of(pages[url])
    points = pages.select(
        row.alias("row"), host.alias("host"), path.alias("path"), F.reverse(F.split(host, r"\.")).alias("labels"),
        F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("edge"),
        F.lit(0).alias("step"), F.lit(0).alias("depth"),
        F.lit(None).cast("struct<len:int,host:string,rule:string,verdict:string>").alias("hit"))
    start = _key(F.col("labels"), F.size("labels"), F.col("path"))
    text = F.concat("host", "path")
    hit = F.struct(F.length(text).alias("len"), F.col("host"), text.alias("rule"), F.col("verdict"))
    edges = (rules.select(
        F.lit(None).cast(points.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("host_"),
        F.lit(None).cast("string").alias("path_"), F.lit(None).cast("array<string>").alias("labels_"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"), start.alias("key"),
        F.size("labels").alias("depth"), hit.alias("hit"))
        .withColumn("end", F.explode(F.array(F.lit(False), F.lit(True))))
        .select("row", "host_", "path_", "labels_", "bucket",
                F.when(F.col("end"), F.concat("key", F.unhex(F.lit("FF")))).otherwise(F.col("key")).alias("edge"),
                F.when(F.col("end"), -1).otherwise(1).alias("step"), "depth", "hit"))
    swept = points.unionAll(edges)
    answers = []
    for d in depths:
        # the point's key cut to d labels (null, sorted first, for shorter hosts); only this depth's edges count
        at = (F.when(F.col("step") == 0, F.when(F.size("labels") >= d, _key(F.col("labels"), d, F.col("path"))))
              .when(F.col("depth") == d, F.col("edge")))
        step = F.when(F.col("depth") == d, F.col("step")).otherwise(0)
        # at one key an interval starts before the points on it
        order = [F.col("at"), F.col("on").desc()]
        swept = swept.withColumn("at", at).withColumn("on", step)
        swept = swept.withColumn("height", F.sum("on").over(Window.partitionBy("bucket").orderBy(*order)
                                 .rowsBetween(Window.unboundedPreceding, 0)))
        top = F.last(F.when(F.col("on") == 1, F.col("hit")), ignorenulls=True).over(
            Window.partitionBy("bucket", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        answers.append(f"top{d}")
        swept = swept.withColumn(f"top{d}", F.when(F.col("height") > 0, top)).drop("at", "on", "height")
    none = F.lit(None).cast("struct<len:int,host:string,rule:string,verdict:string>")
    found = [F.col(a) for a in answers]
    best = F.greatest(*found) if len(found) > 1 else found[0] if found else none
    names = []
    for wish in ("host", "path", "rule", "verdict"):
        names.append(free_name(pages.columns + names, wish))
    return (swept.where(F.col("step") == 0).withColumn("best", best)
            .select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(pages.columns)],
                    F.col("host").alias(names[0]), F.col("path").alias(names[1]),
                    F.col("best.rule").alias(names[2]),
                    F.coalesce("best.verdict", F.lit(default)).alias(names[3])))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_rules(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, arg_max(rhost || rpath, (length(rhost || rpath), length(rhost))) AS rule,
         arg_max(verdict, (length(rhost || rpath), length(rhost))) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""
