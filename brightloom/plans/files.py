"""Queries of git captures, files, the content store, JSON patches and disclosure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import disclosure, patches
from ..sources import files, git
from ..session import few_at_once, kept
from .registry import query, table


def joined(df: DataFrame, by: str, item, order: str, sep: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("s")))), lambda r: r["s"])
    return df.groupBy(by).agg(F.array_join(parts, sep).alias("content"))


_PATH = "CASE WHEN p_size % 2 = 0 THEN 'src/a b/' ELSE 'docs/' END || p_partkey || '.py'"


def part_paths(spark, sf_dir) -> DataFrame:
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "src/a b/").otherwise("docs/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.sha1("p_name").alias("sha"), path.alias("path"))


@query(f"SELECT p_brand, CASE WHEN p_size = 7 THEN '160000' ELSE '100644' END AS mode, sha1(p_name) AS sha, {_PATH} AS path, p_size = 7 AS is_link, CASE WHEN p_size = 9 THEN 'MODIFIED' ELSE 'CLEAN' END AS state FROM part")
def git_inventory(spark, sf_dir):
    p = part_paths(spark, sf_dir)
    listing = joined(p, "p_brand", F.concat(F.when(F.col("p_size") == 7, "160000 ").otherwise("100644 "), F.upper("sha"), F.lit(" 0\t"), "path"), "p_partkey", "\u0000")
    status = joined(p.where("p_size = 9"), "p_brand", F.concat(F.lit(" M "), "path"), "p_partkey", "\u0000")
    return git.with_state(git.index_entries(listing, "p_brand"), git.changed_paths(status, "p_brand"), "p_brand")


@query("""SELECT o_orderkey, sha1(o_orderpriority || o_orderkey) AS sha, left(sha1(o_orderpriority || o_orderkey), 7) AS short_sha, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS occurred_at,
    o_orderpriority || chr(31) || 'x' AS subject FROM orders WHERE o_orderstatus <> 'P'""")  # fmt: skip
def git_commits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    when = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("no date")
    line = F.when(F.col("o_orderstatus") == "P", "fatal: bad").otherwise(F.concat_ws("\u001f", F.upper(F.sha1(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")))), when, "o_orderpriority", F.lit("x")))
    return git.commits(o.select("o_orderkey", line.alias("value"))).withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))


_KIND = "CASE page_id % 6 WHEN 1 THEN 'PDF' WHEN 2 THEN NULL WHEN 3 THEN 'MARKDOWN' ELSE 'TXT' END"
_ERROR = "CASE page_id % 6 WHEN 1 THEN 'PDF_MAGIC_MISSING' WHEN 2 THEN 'KIND_NOT_ACCEPTED' WHEN 4 THEN 'BINARY' WHEN 5 THEN 'NOT_UTF8' END"


@query(f"SELECT page_id, {_KIND} AS source_type, {_ERROR} AS error, CASE WHEN page_id % 6 IN (0, 3) THEN sha256(regexp_replace(html, '\\r\\n?', chr(10), 'g') || chr(10)) END AS sha256 FROM pages")
def decoded_files(spark, sf_dir):
    k = F.col("page_id") % 6
    path = F.concat(F.lit("a/"), F.col("page_id").cast("string"), F.when(k == 1, ".pdf").when(k == 2, ".exe").when(k == 3, ".MD").otherwise(".txt"))
    tail = F.when(k == 4, F.lit(b"\x00")).when(k == 5, F.lit(b"\xff")).otherwise(F.lit(b"\r\n"))
    content = F.concat(F.when(k == 3, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")), F.col("html").cast("binary"), tail)
    d = files.decoded(table(spark, sf_dir, "pages").select("page_id", path.alias("path"), content.alias("content")))
    return d.select("page_id", "source_type", "error", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, max(CAST(strlen(coalesce(text, '')) AS BIGINT)) AS logical_size, true AS smaller, left(sha256(coalesce(text, '')), 2) || '/' || substring(sha256(coalesce(text, '')), 3, 2) || '/' || sha256(coalesce(text, '')) AS path FROM documents GROUP BY 1, 4")
def content_store(spark, sf_dir):
    """All texts put, moved to the middle tier and read back; hashes and sizes are those of what was read. An overhead of 32 bytes is allowed for short texts.

    Each step has a Python worker of its own in every task, so few texts at a time go through them, and each tier is written before the next step.
    """
    few = few_at_once(spark, 128)
    hot = kept(files.put(table(few, sf_dir, "documents"), "HOT", "text"), "hot")
    moved = kept(files.transition(hot, "WARM"), "warm")
    back = files.read_verified(moved).select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("logical_size"))
    back = back.join(moved.select("sha256", "physical_size"), "sha256")
    return back.select("sha256", "logical_size", (F.col("physical_size") <= F.col("logical_size") + 32).alias("smaller"), files.fan_out_path(F.col("sha256")).alias("path"))


def versions(spark, sf_dir) -> DataFrame:
    """Two versions of an object per event: a nested value changes, a key goes, a key comes, a list stays. Events are dealt anew first: a file of many small rows is few tasks."""
    e = table(spark, sf_dir, "events").select("event_id", "props").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    old = F.to_json(F.struct(F.struct(k.alias("x/y"), F.lit(1).alias("same")).alias("deep"), F.array(F.lit(1), F.lit(2)).alias("list"), F.when(i % 3 == 0, "gone").alias("old")))
    new = F.to_json(F.struct(F.struct(F.when(i % 2 == 0, k + 1).otherwise(k).alias("x/y"), F.lit(1).alias("same")).alias("deep"), F.array(F.lit(1), F.lit(2)).alias("list"), F.when(i % 5 == 0, "come").alias("new~")))
    return e.select("event_id", old.alias("old"), new.alias("new"), k.alias("k"))


_OPS = """[x FOR x IN [CASE WHEN event_id % 3 = 0 THEN '{"op":"remove","path":"/old"}' END, CASE WHEN event_id % 5 = 0 THEN '{"op":"add","path":"/new~0","value":"come"}' END,
    CASE WHEN event_id % 2 = 0 THEN '{"op":"replace","path":"/deep/x~1y","value":' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) || '}' END] IF x IS NOT NULL]"""


@query(f"SELECT event_id, '[' || array_to_string({_OPS}, ',') || ']' AS patch, true AS restored FROM events")
def json_patches(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("p", patches.patch_between(spark, F.col("old"), F.col("new"))["value"])
    v = v.withColumn("r", patches.patched(spark, F.col("old"), F.col("p"))["value"])
    again = patches.patch_between(spark, F.col("r"), F.col("new"))["value"]
    # Keys may come in another order in the patch's JSON: it is sorted, as the values of the other side are written.
    return v.select("event_id", F.col("p").alias("patch"), (again == "[]").alias("restored"))


_LEVEL = "CAST(conv_id % 6 AS INT)"
_KINDS = "CASE CAST(turn % 4 AS INT) WHEN 0 THEN 'excerpt' WHEN 1 THEN 'module' WHEN 2 THEN 'file' ELSE 'inventory' END"


def context_items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("excerpt", "module", "file", "inventory"))), (F.col("turn") % 4 + 1).cast("int"))
    items = c.select(F.col("conv_id").alias("task_id"), kind.alias("kind"), F.col("turn").alias("order"), F.repeat("text", F.lit(9)).alias("text"))
    return items, c.select(F.col("conv_id").alias("task_id"), (F.col("conv_id") % 6).cast("int").alias("level")).distinct()


_BOUND = "CASE kind WHEN 'module' THEN [0, 5, 5, 5, 5, 5] WHEN 'excerpt' THEN [0, 0, 0, 5, 5, 5] WHEN 'file' THEN [0, 0, 0, 0, 2, 2] ELSE [0, 0, 0, 0, 0, 20] END[level + 1]"
_ITEMS = f"i AS (SELECT conv_id AS task_id, {_LEVEL} AS level, {_KINDS} AS kind, turn, repeat(text, 9) AS text FROM conversations)"


@query(f"""WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id, kind ORDER BY turn) AS rank FROM i)
    SELECT task_id, kind, rank, CASE WHEN kind = 'excerpt' THEN left(text, 800) ELSE text END AS text, kind = 'excerpt' AND length(text) > 800 AS cut FROM r WHERE rank <= {_BOUND}""")  # fmt: skip
def disclosed_items(spark, sf_dir):
    return disclosure.disclosed(*context_items(spark, sf_dir))


@query(f"WITH {_ITEMS}, n AS (SELECT task_id, level, kind, count(*) AS n, max(length(text)) AS longest FROM i GROUP BY ALL) SELECT task_id, bool_or({_BOUND} > 0 AND (n > {_BOUND} OR (kind = 'excerpt' AND longest > 800))) AS truncated FROM n GROUP BY 1")
def disclosure_truncation(spark, sf_dir):
    return disclosure.truncated(*context_items(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE CASE WHEN contains(text, 'license') THEN 4 WHEN contains(text, '/') THEN 3 WHEN contains(text, '.') THEN 2 ELSE 0 END END AS start_level, "
    "CASE WHEN doc_id % 7 = 0 THEN CASE WHEN length(text) > 100 THEN 1 WHEN contains(text, '.') THEN 2 ELSE 5 END WHEN contains(text, 'license') OR contains(text, '/') THEN 5 WHEN contains(text, '.') THEN 2 ELSE CASE WHEN length(text) > 100 THEN 1 ELSE 5 END END AS final_level FROM documents WHERE text IS NOT NULL")  # fmt: skip
def disclosure_levels(spark, sf_dir):
    t, no = F.col("text"), F.lit(False)
    has = lambda x: F.contains(t, F.lit(x))
    start = disclosure.starting_level(F.when(F.col("doc_id") % 7 == 0, 1), has("/"), has("."), has("license"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", start.alias("start_level"))
    return d.select("doc_id", "start_level", disclosure.final_level(F.col("start_level"), [no, F.length("text") > 100, has("."), no, no, no]).alias("final_level"))
