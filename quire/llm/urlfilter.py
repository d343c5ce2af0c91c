"""URL filters: host-suffix and path-prefix expressions against a rule list, native expressions only.

Each URL is expanded into the expressions that a rule could be written as: the suffixes of its host (whole
labels, as many labels as some rule has) with the prefixes of its path (as long as some rule's). Their
SHA-256 is joined on its first eight hex digits, then the full digests are compared; among the rules that
fit, the longest wins (host and path together; then the longer host). One marker expression per row brings
each page through the same join, so pages are read once and only one small row per page is shuffled.

Rules are a list, or a table (verdict, host, path) of any size. Their table is broadcast while it has at most
`broadcast_rules` rows, and else joined by a shuffle.

Defined cases: a null URL, or one without `://`, has an empty host and path, no rule, and the default
verdict. Very long URLs are read whole. Of rules that are equal the block counts; of equally long ones that fit (host
and path together) that with the longer host. Repeated rows come out as often as they came in. Rows with a null page_id
are judged as well. An empty table gives no rows; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x00"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """From after the first :// up to / ? # or the end, A-Z folded; then up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(quire_url, instr(quire_url, '://') + 3)")).otherwise("")
    bare = F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))
    host = F.substring_index(bare, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substr(bare, F.length(host) + 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def rule_rows(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(host, path, verdict) of each different rule; of equal rules, a block wins."""
    rows = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    path = F.concat(F.lit("/"), F.regexp_replace("path", "^/+", ""))
    return rows.select(F.lower("host").alias("host"), path.alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow


def rule_table(rules: DataFrame) -> DataFrame:
    """The rules as (prefix, digest, rule, verdict, rank), and the marker."""
    whole = F.concat("host", "path")
    rank = F.length(whole).cast("long") * (1 << 20) + F.length("host")
    mark = rules.sparkSession.createDataFrame([(MARK, None, None, -1)], "quire_expr string, quire_rule string, quire_verdict string, quire_rank long")
    rows = rules.select(whole.alias("quire_expr"), whole.alias("quire_rule"), F.col("verdict").alias("quire_verdict"), rank.alias("quire_rank")).unionByName(mark)
    full = digest(F.col("quire_expr"))
    return rows.select(F.substring(full, 1, 8).alias("quire_prefix"), full.alias("quire_full"), "quire_rule", "quire_verdict", "quire_rank")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    spark = pages.sparkSession
    listed = rule_rows(spark, rules)
    # how many labels and characters rules have: a few numbers, however many rules there are
    shape = listed.agg(F.array_sort(F.collect_set(F.size(F.split("host", "[.]", -1)))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.count("*").alias("n")).first()
    labels, lengths = shape["labels"], shape["lengths"]
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("quire_url"))
    host, path = host_and_path(F.col("quire_url"))
    own = own.select("page_id", "quire_url", host.alias("host"), path.alias("path"))
    parts = F.size(F.split("host", "[.]", -1))
    exprs = [F.when((parts >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k in labels for n in lengths]
    exprs = F.array_compact(F.array(F.lit(MARK), *exprs))
    rows = own.select("page_id", "host", "path", F.explode(exprs).alias("quire_expr"))
    rows = rows.withColumn("quire_full_url", digest(F.col("quire_expr"))).withColumn("quire_prefix", F.substring("quire_full_url", 1, 8))
    known = rule_table(listed)
    known = F.broadcast(known) if shape["n"] <= broadcast_rules else known
    found = rows.join(known, (rows.quire_prefix == known.quire_prefix) & (rows.quire_full_url == known.quire_full))
    best = found.groupBy("page_id", "host", "path").agg(
        F.max(F.struct("quire_rank", "quire_rule", "quire_verdict")).alias("best"), F.sum((F.col("quire_rank") < 0).cast("int")).alias("copies")
    )
    out = best.select("page_id", "host", "path", F.col("best.quire_rule").alias("rule"), F.coalesce("best.quire_verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n"))
    return out.drop("n")


def _sql() -> str:
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')", f"{h}/{p}", v, len(h + p)) for v, h, p in RULES]
    fits.sort(key=lambda x: -x[3])
    case = lambda k: " ".join(f"when {f[0]} then '{f[k]}'" for f in fits)
    return f"""
with a as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, regexp_extract(rest, '^([^?#]*)', 1) as bare from a),
c as (select page_id, regexp_extract(bare, '^([^/]*)', 1) as raw, bare from b),
d as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, substr(bare, length(raw) + 1) as path from c)
select page_id, host, path, case {case(1)} end as rule, case {case(2)} else 'allow' end as verdict from d"""


ORACLE = _sql()
