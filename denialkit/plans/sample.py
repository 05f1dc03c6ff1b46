"""Inputs made from the driver's star-schema tables: SYN-A, denials over a small policy, and SYN-B,
a large policy whose types are suppliers and parts. The SYN-A text is valid in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.denials import parse_events, render_line
from ..sources.policy import Policy, parse_policy
from ..sources.scratch import spread

POLICY_TEXT = """
# small policy for checks
type media_service;
type sys_prod_file;
type dev_camera_file;
type dev_bbox;
type sa_camera_host;
type sa_media_service;
attribute hap_domain;
attribute app_domain;
typeattribute hap_domain app_domain;
type normal_hap, hap_domain;
type system_basic_hap, hap_domain;
type system_core_hap, hap_domain;
type debug_hap, hap_domain;
allow media_service dev_camera_file:chr_file { open read };
allowxperm media_service dev_camera_file:chr_file ioctl { 0x641f };
debug_only(`
allow media_service sys_prod_file:file { ioctl
    write };   # wrapped over two lines
')
allow app_domain sys_prod_file:file { read };
allow { hap_domain -normal_hap -debug_hap } dev_camera_file:chr_file *;
neverallow normal_hap dev_bbox:chr_file { read };
neverallow { app_domain -system_basic_hap } dev_bbox:chr_file write;
allow * sa_camera_host:samgr_class get;
allow media_service sa_media_service:samgr_class add;
neverallowxperm debug_hap dev_camera_file:chr_file ioctl { 0x6412 };
some_macro(a, b)
"""

#: The same policy for DuckDB, written out by hand.
POLICY_SQL = """
rules(rule_id, kind, src, src_neg, src_star, tgt, tgt_neg, tgt_star, cls, perms, xperms, raw) AS (VALUES
 (1, 'allow', ['media_service'], []::VARCHAR[], false, ['dev_camera_file'], []::VARCHAR[], false, 'chr_file', ['open','read'], []::VARCHAR[], 'allow media_service dev_camera_file:chr_file { open read };'),
 (2, 'allowxperm', ['media_service'], [], false, ['dev_camera_file'], [], false, 'chr_file', [], ['0x641f'], 'allowxperm media_service dev_camera_file:chr_file ioctl { 0x641f };'),
 (3, 'allow', ['media_service'], [], false, ['sys_prod_file'], [], false, 'file', ['ioctl','write'], [], 'allow media_service sys_prod_file:file { ioctl write };'),
 (4, 'allow', ['app_domain'], [], false, ['sys_prod_file'], [], false, 'file', ['read'], [], 'allow app_domain sys_prod_file:file { read };'),
 (5, 'allow', ['hap_domain'], ['normal_hap','debug_hap'], false, ['dev_camera_file'], [], false, 'chr_file', [], [], 'allow { hap_domain -normal_hap -debug_hap } dev_camera_file:chr_file *;'),
 (6, 'neverallow', ['normal_hap'], [], false, ['dev_bbox'], [], false, 'chr_file', ['read'], [], 'neverallow normal_hap dev_bbox:chr_file { read };'),
 (7, 'neverallow', ['app_domain'], ['system_basic_hap'], false, ['dev_bbox'], [], false, 'chr_file', ['write'], [], 'neverallow { app_domain -system_basic_hap } dev_bbox:chr_file write;'),
 (8, 'allow', [], [], true, ['sa_camera_host'], [], false, 'samgr_class', ['get'], [], 'allow * sa_camera_host:samgr_class get;'),
 (9, 'allow', ['media_service'], [], false, ['sa_media_service'], [], false, 'samgr_class', ['add'], [], 'allow media_service sa_media_service:samgr_class add;'),
 (10, 'neverallowxperm', ['debug_hap'], [], false, ['dev_camera_file'], [], false, 'chr_file', [], ['0x6412'], 'neverallowxperm debug_hap dev_camera_file:chr_file ioctl { 0x6412 };')),
types(name) AS (VALUES ('media_service'),('sys_prod_file'),('dev_camera_file'),('dev_bbox'),('sa_camera_host'),('sa_media_service'),('hap_domain'),('normal_hap'),('system_basic_hap'),('system_core_hap'),('debug_hap')),
attributes(name) AS (VALUES ('hap_domain'),('app_domain')),
up(name, token) AS (VALUES ('hap_domain','app_domain'),('normal_hap','hap_domain'),('system_basic_hap','hap_domain'),('system_core_hap','hap_domain'),('debug_hap','hap_domain'),
 ('normal_hap','app_domain'),('system_basic_hap','app_domain'),('system_core_hap','app_domain'),('debug_hap','app_domain'))"""

SYN_A = """
SELECT event_id AS seq,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'media_service' WHEN user_id % 5 = 1 THEN 'normal_hap'
       WHEN user_id % 5 = 2 THEN 'system_basic_hap' WHEN user_id % 5 = 3 THEN 'ghost_domain' ELSE 'debug_hap' END AS src,
  CASE event_type WHEN 'view' THEN 'dev_camera_file' WHEN 'click' THEN 'sys_prod_file' WHEN 'error' THEN 'dev_bbox'
       WHEN 'purchase' THEN 'default_service' ELSE 's0' END AS tgt,
  CASE WHEN event_id % 53 = 0 THEN 'samar_class' WHEN event_type IN ('view', 'error') THEN 'chr_file'
       WHEN event_type = 'purchase' THEN 'samgr_class' ELSE 'file' END AS cls,
  CASE WHEN event_id % 61 = 0 THEN '0x5413' WHEN event_type = 'purchase' THEN (CASE event_id % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'add' WHEN 2 THEN 'get add' ELSE 'find' END)
       ELSE (CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'open read' WHEN 2 THEN 'ioctl' ELSE 'write' END) END AS perms,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS permissive,
  CASE WHEN event_id % 61 <> 0 AND event_type <> 'purchase' AND event_id % 4 = 2 AND event_id % 8 <> 6 THEN (CASE user_id % 2 WHEN 0 THEN '0x641f' ELSE '0x6412' END) END AS ioctl_cmd,
  CASE WHEN event_type = 'purchase' THEN (CASE user_id % 3 WHEN 0 THEN 'camera_host' WHEN 1 THEN '3001' END) END AS service
FROM events"""


def sample_policy(spark: SparkSession) -> Policy:
    return parse_policy(spark.createDataFrame([("sample.te", POLICY_TEXT)], "file string, text string")).cached()


def syn_a_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYN-A as columns, permissions as an array."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(SYN_A).withColumn("perms", F.split("perms", " "))


def syn_a_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line): SYN-A as log lines."""
    return as_lines(syn_a_columns(spark, sf_dir))


def as_lines(columns: DataFrame) -> DataFrame:
    return columns.select("seq", as_line().alias("line"))


def as_line() -> Column:
    return render_line(*map(F.col, ("src", "tgt", "cls", "perms", "permissive", "ioctl_cmd", "service")))


def syn_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYN-A as parsed from its own log lines."""
    return parse_events(as_lines(spread(syn_a_columns(spark, sf_dir))), "line").drop("line")


def syn_b_policy(spark: SparkSession, sf_dir: str) -> Policy:
    """Suppliers below nations below regions, parts below brands; rules from lineitem."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "supplier", "part", "nation", "region")}
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    brand = F.concat(F.lit("brand_"), F.regexp_replace("p_brand", "[^A-Za-z0-9_]", ""))
    edges = t["supplier"].select(name("supp_", "s_suppkey").alias("child"), name("nation_", "s_nationkey").alias("parent")).union(
        t["nation"].select(name("nation_", "n_nationkey"), name("region_", "n_regionkey"))).union(t["part"].select(name("part_", "p_partkey"), brand))
    none = F.array().cast("array<string>")

    def rules(df, kind, src, src_neg, tgt, cls, perms, raw, group, star=False):
        return df.select(F.struct(F.array(F.lit(f"{group}")).alias("path"), F.lit(0).alias("line"), F.lit(0).cast("bigint").alias("sub")).alias("rule_id"), F.lit(kind).alias("kind"), src.alias("src"), src_neg.alias("src_neg"), F.lit(star).alias("src_star"),
                         tgt.alias("tgt"), none.alias("tgt_neg"), F.lit(False).alias("tgt_star"), cls.alias("cls"), perms.alias("perms"), F.lit(None).cast("string").alias("xperm_perm"), none.alias("xperms"), F.lit(False).alias("xperm_invert"), raw.alias("raw"))

    supp, part = name("supp_", "l_suppkey"), name("part_", "l_partkey")
    perms = F.when(F.col("l_returnflag") == "A", F.array(F.lit("read"), F.lit("open"))).when(F.col("l_returnflag") == "N", F.array(F.lit("write"))).otherwise(F.array(F.lit("ioctl")))
    cls = F.when(F.col("l_linestatus") == "O", "file").otherwise("dir")
    line = rules(t["lineitem"].select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus").distinct(), "allow", F.array(supp), none, F.array(part), cls, perms, F.concat(supp, F.lit(" "), part, F.lit(":"), cls, F.lit(" "), F.array_join(perms, " ")), "1")
    brands = t["part"].select("p_brand").distinct()
    wide = t["nation"].where("n_nationkey % 5 = 0").crossJoin(F.broadcast(brands.where("p_brand like '%1'")))  # nations and brands are fixed, small dimensions
    nat = name("nation_", "n_nationkey")
    middle = rules(wide, "allow", F.array(nat), F.array(F.concat(F.lit("supp_"), (F.col("n_nationkey") + 1).cast("string"))), F.array(brand), F.lit("file"), F.array(F.lit("getattr")), F.concat(nat, F.lit(" "), brand), "2")
    every = rules(brands.where("p_brand like '%2'"), "allow", none, none, F.array(brand), F.lit("dir"), none, F.concat(F.lit("* "), brand), "3", star=True)
    reg = name("region_", "r_regionkey")
    stops = rules(t["region"].crossJoin(F.broadcast(brands.where("p_brand like '%3'"))), "neverallow", F.array(reg), none, F.array(brand), F.lit("file"), F.array(F.lit("write")), F.concat(reg, F.lit(" "), brand), "4")
    # rule ids must differ: the text makes them so
    all_rules = line.unionByName(middle).unionByName(every).unionByName(stops).withColumn("rule_id", F.struct(F.concat(F.col("rule_id.path"), F.array("raw")).alias("path"), F.lit(0).alias("line"), F.lit(0).cast("bigint").alias("sub")))
    names = edges.select(F.col("child").alias("name")).distinct()
    return Policy(all_rules, edges, names, edges.select(F.col("parent").alias("name")).distinct(), all_rules.limit(0).select("raw"))


def syn_b_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access a lineitem row: its supplier, a part nearby, what its flags say."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = F.col("l_partkey") - F.col("l_partkey") % 2 * F.col("l_linenumber")
    asked = li.select(F.concat(F.lit("supp_"), "l_suppkey").alias("src"), F.concat(F.lit("part_"), part).alias("tgt"), F.when(F.col("l_linestatus") == "O", "file").otherwise("dir").alias("cls"),
                     F.when(F.col("l_returnflag") == "A", F.array(F.lit("open"), F.lit("read"))).otherwise(F.array(F.lit("getattr"), F.lit("write"))).alias("perms"))
    # dealt by target, so that the distinct rows meet what is known of their targets where they are
    return asked.repartition("tgt").distinct().withColumn("req", F.concat_ws(" ", "src", "tgt", "cls", F.array_join("perms", ","))).withColumn("ioctl_cmd", F.lit(None).cast("string"))
