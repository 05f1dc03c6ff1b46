"""Registered queries on compiled policies, landing, attribution, golden pairs and index exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assertions, attribution, evaluate, golden, landing, macros, report
from .plans import sample
from .plans.access import answers, rule_hits
from .plans.board import board_answers, board_commands
from .plans.closure import ancestors, settle
from .plans.verdict import AUTO, HUMAN, patch_lines
from .queries import ANSWERED, SYN_B_EDGES, SYN_B_SQL, asked, decided, query, words
from .queries import oracle_sql as oracle_sql
from .queries import queries as queries
from .sources import exchange
from .sources.cil import Board, intervals, parse_cil

BOARD_TEXT = """(class file (ioctl open read write))
(class chr_file (open read write))
(classorder (file chr_file))
(class samgr_class (add get))
(common device_common (ioctl))
(classcommon chr_file device_common)
(type media_service)
(type normal_hap)
(type system_basic_hap)
(type debug_hap)
(type sys_prod_file)
(type dev_camera_file)
(type dev_bbox)
(type default_service)
(typeattribute hap_domain)
(typeattribute app_domain)
(typeattributeset hap_domain (normal_hap system_basic_hap debug_hap))
(typeattributeset app_domain (hap_domain))
(typepermissive debug_hap)
(allow app_domain sys_prod_file (file (read)))
(allow hap_domain dev_camera_file (chr_file (read)))
(allow media_service sys_prod_file (file (ioctl)))
(allow media_service sys_prod_file (file (write)))
(allow system_basic_hap dev_bbox (chr_file (open read)))
(allowx media_service dev_camera_file (ioctl chr_file ((0x5413 (range 0x6400 0x6412)))))
(mlsconstrain (process (transition)) (eq h1 h2))
(boolean fast true)"""

#: The same board for DuckDB, written out by hand.
BOARD_SQL = """bcls(cls, perms) AS (VALUES ('file', ['ioctl','open','read','write']), ('chr_file', ['ioctl','open','read','write']), ('samgr_class', ['add','get'])),
bsym(name) AS (VALUES ('media_service'),('normal_hap'),('system_basic_hap'),('debug_hap'),('sys_prod_file'),('dev_camera_file'),('dev_bbox'),('default_service'),('hap_domain'),('app_domain')),
bup(name, token) AS (SELECT name, name FROM bsym UNION VALUES ('normal_hap','hap_domain'),('system_basic_hap','hap_domain'),('debug_hap','hap_domain'),('normal_hap','app_domain'),('system_basic_hap','app_domain'),('debug_hap','app_domain'),('hap_domain','app_domain')),
ballow(src, tgt, cls, perms) AS (VALUES ('app_domain','sys_prod_file','file',['read']),('hap_domain','dev_camera_file','chr_file',['read']),('media_service','sys_prod_file','file',['ioctl','write']),('system_basic_hap','dev_bbox','chr_file',['open','read']))"""


def board(spark: SparkSession) -> Board:
    return parse_cil(spark.createDataFrame([(x,) for x in BOARD_TEXT.split("\n")], "line string"))


def human(spark: SparkSession, sf_dir: str, policy=None) -> DataFrame:
    return decided(spark, sf_dir, policy).where(F.col("category") == HUMAN)


def attributed(spark, sf_dir):
    policy = sample.sample_policy(spark)
    return attribution.attribute(human(spark, sf_dir, policy), policy, board(spark))


HELD = "EXISTS (SELECT 1 FROM ballow b JOIN bup s ON s.token = b.src JOIN bup t ON t.token = b.tgt WHERE s.name = f.src AND t.name = f.tgt AND b.cls = f.cls AND list_has_all(b.perms, {}))"
CAUSES = ANSWERED + f""", {BOARD_SQL},
cover AS (SELECT h.req, arg_min(NOT (list_has_any(h.src, (SELECT list(name) FROM attributes)) OR list_has_any(h.tgt, (SELECT list(name) FROM attributes))), h.rule_id) AS direct FROM hits h JOIN res a USING (req) WHERE h.kind = 'allow' AND list_has_all(h.perms, a.perms) GROUP BY 1),
cause AS (SELECT f.*, CASE WHEN classification = 'POTENTIAL_ESCALATION' THEN 'NEVERALLOW_REDLINE' WHEN src IS NULL THEN 'LOG_MISSING_FIELD' WHEN cls NOT IN (SELECT cls FROM bcls) THEN 'UNKNOWN_OBJECT_CLASS'
  WHEN NOT list_has_all((SELECT b.perms FROM bcls b WHERE b.cls = f.cls), f.perms) THEN 'UNKNOWN_PERMISSION' WHEN tgt = 's0' THEN 'MALFORMED_LOG' WHEN tgt = 'default_service' THEN 'UNRESOLVED_SERVICE_PLACEHOLDER'
  WHEN src = 'debug_hap' THEN 'PERMISSIVE_DOMAIN' WHEN src NOT IN (SELECT name FROM bsym) OR tgt NOT IN (SELECT name FROM bsym) THEN 'BOARD_SYMBOL_ABSENT'
  WHEN {HELD.format('f.perms')} THEN (CASE WHEN c.direct THEN 'ALREADY_GRANTED_DIRECT' ELSE 'ALREADY_GRANTED_VIA_ATTR' END) WHEN c.direct IS NOT NULL THEN 'DEVICE_LAGS_TREE' ELSE 'BOARD_PARTIAL_GAP' END AS root_cause
  FROM fin f LEFT JOIN cover c USING (req) WHERE f.category = 'needs_human')
"""


@query(CAUSES + "SELECT coalesce(src, '~') AS src, tgt, cls, array_to_string(perms, ' ') AS perms, coalesce(ioctl_cmd, '~') AS ioctl_cmd, root_cause FROM cause")
def o79_attribution(spark, sf_dir):
    out = attributed(spark, sf_dir)
    return out.select(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls", words("perms").alias("perms"), F.coalesce("ioctl_cmd", F.lit("~")).alias("ioctl_cmd"), "root_cause")


@query(CAUSES + """SELECT root_cause, CASE root_cause WHEN 'NEVERALLOW_REDLINE' THEN 'HUMAN' WHEN 'BOARD_PARTIAL_GAP' THEN 'DEVICE' WHEN 'LOG_MISSING_FIELD' THEN 'LOG' WHEN 'UNKNOWN_OBJECT_CLASS' THEN 'LOG' WHEN 'UNKNOWN_PERMISSION' THEN 'LOG'
    WHEN 'MALFORMED_LOG' THEN 'LOG' WHEN 'UNRESOLVED_SERVICE_PLACEHOLDER' THEN 'TOOL' WHEN 'BOARD_SYMBOL_ABSENT' THEN 'TOOL' WHEN 'DEVICE_LAGS_TREE' THEN 'TOOL' ELSE 'NONE' END AS owner, count(*) AS cases, sum(n)::BIGINT AS denials FROM cause GROUP BY 1, 2""")
def o80_attribution_report(spark, sf_dir):
    return attribution.report(attributed(spark, sf_dir))


@query(CAUSES + """SELECT f.src, f.cls, count(DISTINCT f.req) AS cases, (SELECT string_agg(DISTINCT t.tgt, ' ' ORDER BY t.tgt) FROM cause t WHERE t.root_cause = 'BOARD_PARTIAL_GAP' AND t.src = f.src AND t.cls = f.cls) AS targets
    FROM cause f WHERE f.root_cause = 'BOARD_PARTIAL_GAP' GROUP BY 1, 2""")
def o59_device_findings(spark, sf_dir):
    found = attribution.device_findings(attributed(spark, sf_dir))
    return found.select("src", "cls", "cases", F.array_join("targets", " ").alias("targets"))


@query("SELECT 1::BIGINT AS booleans, 0::BIGINT AS constrains, 1::BIGINT AS mlsconstrains")
def o81_policy_axes(spark, sf_dir):
    return attribution.policy_axes(spark.createDataFrame([(x,) for x in BOARD_TEXT.split("\n")], "line string"))


def board_at_scale(spark, sf_dir) -> Board:
    """A board from the star schema, through CIL text: suppliers and parts below their attributes."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "nation", "part")}
    members = sample.syn_b_policy(spark, sf_dir).edges.distinct().select(F.concat(F.lit("(typeattributeset "), "parent", F.lit(" ("), "child", F.lit("))")).alias("line"))
    perms = F.when(F.col("l_returnflag") == "A", "read open").when(F.col("l_returnflag") == "N", "write").otherwise("ioctl")
    cls = F.when(F.col("l_linestatus") == "O", "file").otherwise("dir")
    own = t["lineitem"].select("l_suppkey", "l_partkey", cls.alias("cls"), perms.alias("perms")).select(F.concat(F.lit("(allow supp_"), "l_suppkey", F.lit(" part_"), "l_partkey", F.lit(" ("), "cls", F.lit(" ("), "perms", F.lit(")))")).alias("line"))
    brand = t["part"].where("p_brand like '%1'").select(F.concat(F.lit("brand_"), F.regexp_replace("p_brand", "[^A-Za-z0-9_]", "")).alias("b")).distinct()
    wide = t["nation"].where("n_nationkey % 5 = 0").crossJoin(F.broadcast(brand))  # nations and brands are fixed, small dimensions
    return parse_cil(members.union(own).union(wide.select(F.format_string("(allow nation_%d %s (file (getattr write)))", "n_nationkey", "b"))))


@query(f"WITH {SYN_B_EDGES}, up(name, token) AS (SELECT child, parent FROM edges UNION SELECT a.child, b.parent FROM edges a JOIN edges b ON b.child = a.parent) SELECT name, token FROM up")
def o36_board_closure(spark, sf_dir):
    return ancestors(board_at_scale(spark, sf_dir).edges)


@query(SYN_B_SQL + """, keys AS (SELECT src, tgt, cls, flatten(list(perms)) AS perms FROM (SELECT 'supp_' || l_suppkey AS src, 'part_' || l_partkey AS tgt, CASE l_linestatus WHEN 'O' THEN 'file' ELSE 'dir' END AS cls, CASE l_returnflag WHEN 'A' THEN ['read', 'open'] WHEN 'N' THEN ['write'] ELSE ['ioctl'] END AS perms FROM lineitem
    UNION ALL SELECT 'nation_' || n_nationkey, b, 'file', ['getattr', 'write'] FROM nation, brand WHERE n_nationkey % 5 = 0 AND p_brand LIKE '%1') GROUP BY 1, 2, 3),
    found AS (SELECT q.src, q.tgt, q.cls, q.perms AS asked, bool_or(list_has_all(k.perms, q.perms)) AS satisfied, array_to_string(list_sort(list_distinct(flatten(list(k.perms)))), ' ') AS granted
      FROM req q JOIN stok s ON s.src = q.src JOIN ttok t ON t.tgt = q.tgt JOIN keys k ON k.src = s.tok AND k.tgt = t.tok AND k.cls = q.cls GROUP BY 1, 2, 3, 4)
    SELECT q.cls, array_to_string(q.perms, ' ') AS perms, coalesce(f.satisfied, false) AS satisfied, coalesce(f.granted, '') AS granted, count(*) AS requests FROM req q LEFT JOIN found f ON f.src = q.src AND f.tgt = q.tgt AND f.cls = q.cls AND f.asked = q.perms GROUP BY 1, 2, 3, 4""")
def o45_board_access(spark, sf_dir):
    a = board_answers(sample.syn_b_requests(spark, sf_dir).drop("req", "ioctl_cmd"), board_at_scale(spark, sf_dir))
    return a.groupBy("cls", words("perms").alias("perms"), "satisfied", words("board_granted").alias("granted")).agg(F.count("*").alias("requests"))


@query("SELECT event_id, event_id % 40 BETWEEN 3 AND 9 OR event_id % 40 = 20 AS held FROM events")
def o28_command_intervals(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = intervals(F.lit("(0x14 (range 0x3 0x9))"))
    return e.select("event_id", F.exists(i, lambda x: (F.col("event_id") % 40).between(x["lo"], x["hi"])).alias("held"))


@query(ANSWERED + f""", {BOARD_SQL}, line AS (SELECT DISTINCT classification, src, tgt, cls, patch, CASE classification WHEN 'XPERM_GAP' THEN [ioctl_cmd] ELSE string_split(missing, ' ') END AS want FROM fin WHERE category = 'auto_repairable'),
    told AS (SELECT CASE WHEN src NOT IN (SELECT name FROM bsym) OR tgt NOT IN (SELECT name FROM bsym) OR cls NOT IN (SELECT cls FROM bcls) THEN 'symbols' WHEN classification <> 'XPERM_GAP' AND NOT list_has_all((SELECT b.perms FROM bcls b WHERE b.cls = f.cls), want) THEN 'perms'
      WHEN classification <> 'XPERM_GAP' AND {HELD.format('want')} THEN 'idempotent' WHEN classification = 'XPERM_GAP' AND src = 'media_service' AND tgt = 'dev_camera_file' AND want = ['0x6412'] THEN 'idempotent' ELSE '-' END AS gate FROM line f)
    SELECT gate, CASE gate WHEN '-' THEN 'emit' WHEN 'idempotent' THEN 'already_satisfied' ELSE 'rejected' END AS verdict, count(*) AS lines FROM told GROUP BY 1""")
def o88_landing_gates(spark, sf_dir):
    lines = patch_lines(decided(spark, sf_dir)).select(F.col("patch").alias("line"))
    return landing.gates(lines, board(spark)).groupBy(F.coalesce("gate", F.lit("-")).alias("gate"), "verdict").agg(F.count("*").alias("lines"))


@query(ANSWERED + """SELECT DISTINCT CASE classification WHEN 'XPERM_GAP' THEN '(allowx ' || src || ' ' || tgt || ' (ioctl ' || cls || ' (' || ioctl_cmd || ')))' ELSE '(allow ' || src || ' ' || tgt || ' (' || cls || ' (' || missing || ')))' END AS cil FROM fin WHERE category = 'auto_repairable'""")
def o89_render_cil(spark, sf_dir):
    lines = patch_lines(decided(spark, sf_dir)).select(F.col("patch").alias("line"))
    return landing.gates(lines, board(spark)).select(landing.render_cil(*map(F.col, ("kind", "src", "tgt", "cls", "op", "perms"))).alias("cil"))


@query("SELECT * FROM (VALUES ('app_domain', 'sys_prod_file', 'file', 'read', ''), ('media_service', 'dev_camera_file', 'chr_file', '', '25600-25618')) t(src, tgt, cls, perms, gone)")
def o91_lost_access(spark, sf_dir):
    """What a compiled policy lost against the board: one permission, and one of its intervals."""
    text = BOARD_TEXT.replace("(allow app_domain sys_prod_file (file (read)))\n", "").replace("(range 0x6400 0x6412)", "(range 0x6400 0x6405) (range 0x6407 0x6420)")
    after = parse_cil(spark.createDataFrame([(x,) for x in text.split("\n")], "line string"))
    gone = F.array_join(F.transform("intervals", lambda i: F.concat_ws("-", i["lo"].cast("string"), i["hi"].cast("string"))), " ")
    return landing.lost(board(spark), after).select("src", "tgt", "cls", words("perms").alias("perms"), F.coalesce(gone, F.lit("")).alias("gone"))


SUBJECT = """(CASE WHEN len({0}) + len({0}_neg) = 0 AND NOT {0}_star THEN '-' ELSE array_to_string(list_concat(CASE WHEN {0}_star THEN ['*'] ELSE [] END, list_sort(list_transform({0}_neg, lambda n: '-' || n)), list_sort({0})), ',') END)"""


@query(f"""WITH {sample.POLICY_SQL}, known AS (SELECT name FROM types UNION SELECT unnest(src) FROM rules UNION SELECT unnest(tgt) FROM rules), perm AS (SELECT DISTINCT unnest(perms) AS name FROM rules WHERE kind IN ('allow', 'neverallow'))
    SELECT '@class ' || cls || ' ' || count(*) AS line FROM rules GROUP BY cls UNION ALL SELECT '@type ' || t.name || coalesce(' ' || string_agg(u.token, ' ' ORDER BY u.token), '') FROM types t LEFT JOIN up u ON u.name = t.name GROUP BY t.name
    UNION ALL SELECT '@attr ' || name FROM attributes UNION ALL SELECT '@known ' || name FROM known UNION ALL SELECT '@perm ' || name FROM perm UNION ALL SELECT '@rules ' || count(*) FROM rules UNION ALL SELECT 'PLI1' UNION ALL SELECT '@rev 2'
    UNION ALL SELECT '@src sample gen=now exporter=denialkit' UNION ALL SELECT '@meta rules=10 allow=6 neverallow=2 allowxperm=1 neverallowxperm=1 types=11 attrs=2 classes=3 perms=' || (SELECT count(*) FROM perm) || ' known=' || (SELECT count(*) FROM known) || ' skipped=1 hap_entries=0 hap_domains=0 hap_names=0 hap_apls=0 hap_debuggable=0 hap_skipped=0'
    UNION ALL SELECT CASE kind WHEN 'allow' THEN 'a' WHEN 'neverallow' THEN 'n' WHEN 'allowxperm' THEN 'x' ELSE 'z' END || ' ' || cls || ' ' || {SUBJECT.format('src')} || ' ' || {SUBJECT.format('tgt')} || ' ' || CASE WHEN kind LIKE '%xperm' THEN 'ioctl:' || array_to_string(xperms, ',') WHEN len(perms) = 0 THEN '*' ELSE array_to_string(list_sort(perms), ',') END FROM rules""")
def o12_index_export(spark, sf_dir):
    return exchange.export_lines(sample.sample_policy(spark), "sample", "now").select("line")


@query(ANSWERED + "SELECT coalesce(src, '~') AS src, tgt, cls, array_to_string(perms, ' ') AS perms, coalesce(ioctl_cmd, '~') AS ioctl_cmd, allowed, granted, n_neverallow, ioctl_allowed FROM ans")
def o13_index_import(spark, sf_dir):
    """The answers of a policy that was written to lines and read back."""
    policy = exchange.import_policy(settle(exchange.in_order(exchange.export_lines(sample.sample_policy(spark)))))
    a = asked(spark, sf_dir).withColumn("logged_tgt", F.col("tgt")).withColumn("tgt", F.col("query_tgt")).withColumn("req", F.col("fp"))
    return answers(a, policy, policy.closure()).select(
        F.coalesce("src", F.lit("~")).alias("src"), F.col("logged_tgt").alias("tgt"), "cls", words("perms").alias("perms"), F.coalesce("ioctl_cmd", F.lit("~")).alias("ioctl_cmd"), "allowed", words("granted").alias("granted"), F.col("n_neverallow").cast("bigint").alias("n_neverallow"), "ioctl_allowed")


@query("SELECT * FROM (VALUES ('drift', 1::BIGINT), ('sound', 0), ('short', 8)) t(item, n)")
def o14_index_checks(spark, sf_dir):
    """Lines that differ after one rule changed; complaints about a sound file and a cut one."""
    made = settle(exchange.in_order(exchange.export_lines(sample.sample_policy(spark), "sample", "now")))
    later = made.withColumn("line", F.replace(F.replace("line", F.lit("gen=now"), F.lit("gen=later")), F.lit("a samgr_class * sa_camera_host get"), F.lit("a samgr_class * sa_camera_host list")))
    cut = made.where(~F.col("line").startswith("a samgr_class media_service"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return one("drift", exchange.drift(made, later)).union(one("sound", exchange.self_check(made))).union(one("short", exchange.self_check(cut)))


GOLD = f"""gold AS (SELECT *, coalesce(src, 'ghost_domain') AS s FROM ({sample.SYN_A})),
pair AS (SELECT *, seq % 7 AS k, CASE seq % 7 WHEN 1 THEN 'other_domain' WHEN 6 THEN 'app_domain' ELSE s END AS r_src, CASE seq % 7 WHEN 4 THEN 'other_file' ELSE tgt END AS r_tgt,
  CASE seq % 7 WHEN 2 THEN 'other_class' ELSE cls END AS r_cls, CASE seq % 7 WHEN 3 THEN 'lock' WHEN 5 THEN split_part(perms, ' ', 1) ELSE perms END AS r_perms FROM gold)"""


def golden_pairs(spark, sf_dir) -> DataFrame:
    """Golden pairs of rule files made from SYN-A, ten pairs to a file, both layouts in turn."""
    c, k = sample.syn_a_columns(spark, sf_dir), F.col("seq") % 7
    line = F.concat(F.lit("# "), sample.as_line())
    src, tgt = F.when(k == 1, "other_domain").when(k == 6, "app_domain").otherwise(F.coalesce("src", F.lit("ghost_domain"))), F.when(k == 4, "other_file").otherwise(F.col("tgt"))
    perms = F.when(k == 3, "lock").when(k == 5, F.col("perms")[0]).otherwise(F.array_join("perms", " "))
    rule = F.format_string("allow %s %s:%s { %s };", src, tgt, F.when(k == 2, "other_class").otherwise(F.col("cls")), perms)
    both = sample.spread(c.withColumn("file", F.floor(F.col("seq") / 10).cast("string")), "file").select("file", "seq", line.alias("line"), rule.alias("rule"))
    both = both.withColumn("text", F.when(F.col("seq") % 2 == 0, F.concat_ws("\n", "line", "rule")).otherwise(F.concat_ws("\n\n", "rule", "line")))
    files = both.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", F.concat("text", F.lit("\ntype one;\n")).alias("t"))))["t"], "").alias("text"))
    return golden.extract(files)


@query(f"WITH {GOLD} SELECT CASE WHEN seq % 2 = 0 THEN 'comment_first' ELSE 'rule_first' END AS direction, 'allow' AS rule_kind, coalesce(src, '~') AS src, tgt, count(*) AS pairs, sum(len(string_split(perms, ' ')))::BIGINT AS perms FROM pair GROUP BY 1, 2, 3, 4")
def o82_golden_pairs(spark, sf_dir):
    d = golden_pairs(spark, sf_dir).select("direction", "rule_kind", F.explode("denials").alias("d"))
    return d.groupBy("direction", "rule_kind", F.coalesce("d.src", F.lit("~")).alias("src"), F.col("d.tgt").alias("tgt")).agg(F.count("*").alias("pairs"), F.sum(F.size("d.perms")).alias("perms"))


@query(f"""WITH {GOLD}, v AS (SELECT CASE WHEN src IS NULL THEN 'unparseable' WHEN k IN (1, 2, 3) THEN 'mispair' WHEN k = 6 AND src NOT IN ('normal_hap', 'system_basic_hap', 'debug_hap') THEN 'mispair'
    WHEN k = 5 AND contains(perms, ' ') THEN 'partial_fix' WHEN k = 4 AND tgt = 'default_service' AND cls = 'samgr_class' THEN 'service_gap' WHEN k = 4 THEN 'attr_or_name_gap' ELSE 'trusted' END AS pair_kind FROM pair)
    SELECT pair_kind, count(*) AS pairs FROM v GROUP BY 1""")
def o83_trust(spark, sf_dir):
    return golden.trust(golden_pairs(spark, sf_dir), sample.sample_policy(spark)).groupBy("pair_kind").agg(F.count("*").alias("pairs"))


#: Pairs of an allowed access and the only rule text that grants one of its permissions, decided as if that text were gone.
WITHOUT = ANSWERED + """, pr AS (SELECT q.req, q.p, h.raw FROM perm q JOIN ans a ON a.req = q.req AND a.allowed JOIN hits h ON h.req = q.req AND h.kind = 'allow' AND (len(h.perms) = 0 OR list_contains(h.perms, q.p))),
    solo AS (SELECT DISTINCT req, raw FROM (SELECT req, p, min(raw) AS raw FROM pr GROUP BY 1, 2 HAVING count(DISTINCT raw) = 1)),
    left_ AS (SELECT s.req, s.raw, q.p, EXISTS (SELECT 1 FROM hits h WHERE h.req = s.req AND h.kind = 'allow' AND h.raw <> s.raw AND (len(h.perms) = 0 OR list_contains(h.perms, q.p))) AS ok FROM solo s JOIN perm q USING (req)),
    cmd AS (SELECT s.req, s.raw, CASE WHEN a.ioctl_reason IN ('neverallowxperm', 'allowxperm') THEN a.ioctl_reason WHEN a.ioctl_reason IS NOT NULL AND EXISTS (SELECT 1 FROM hits h WHERE h.req = s.req AND h.kind = 'allow' AND h.raw <> s.raw AND list_contains(h.perms, 'ioctl')) THEN 'allow(ioctl)'
        WHEN a.ioctl_reason IS NOT NULL THEN 'no_allow' END AS reason, a.ioctl_allowed FROM solo s JOIN ans a USING (req)),
    gap AS (SELECT l.req, l.raw, list_sort(list(l.p) FILTER (NOT l.ok)) AS missing, any_value(a.src) AS src, any_value(a.tgt) AS tgt, any_value(a.perms) AS perms, any_value(a.n_neverallow) AS stops, any_value(a.ioctl_cmd) AS ioctl_cmd,
        any_value(c.reason) AS reason, any_value(c.ioctl_allowed) AS was FROM left_ l JOIN ans a USING (req) JOIN cmd c ON c.req = l.req AND c.raw = l.raw GROUP BY 1, 2),
    cut AS (SELECT *, CASE WHEN reason = 'allowxperm' AND NOT was THEN [ioctl_cmd] ELSE missing END AS scope,
        CASE WHEN contains(raw, '{') AND NOT contains(split_part(raw, ':', 1), '{') THEN list_filter(string_split(trim(split_part(split_part(raw, '{', 2), '}', 1)), ' '), lambda x: x <> '')
          WHEN contains(raw, '{') THEN list_filter(string_split(trim(split_part(split_part(raw, '{', 2), '}', 1)), ' '), lambda x: x <> '') ELSE [rtrim(string_split(raw, ' ')[-1], ';')] END AS fix FROM gap)"""


@query(WITHOUT + """SELECT count(*) FILTER (stops > 0) AS neverallow_blocked, count(*) FILTER (stops = 0) AS patch_generated, count(*) FILTER (stops = 0 AND list_sort(scope) = missing) AS exact_min,
    count(*) FILTER (stops = 0 AND list_has_all(scope, missing)) AS sufficient, count(*) FILTER (stops = 0 AND list_has_all(scope, missing) AND NOT list_has_all(missing, scope)) AS overbroad,
    count(*) FILTER (stops = 0) AS review_approve, count(*) FILTER (stops = 0 AND src IS NOT NULL) AS final_verified, count(*) FILTER (stops = 0 AND list_has_all(scope, fix) AND list_has_all(fix, scope)) AS patch_matches_rule,
    count(*) FILTER (stops = 0 AND len(fix) > 0 AND list_has_all(fix, missing) AND NOT list_has_all(missing, fix)) AS rule_wider_than_gap FROM cut""")
def o86_evaluation(spark, sf_dir):
    """The nine numbers over all cases that hang on one rule text, each decided without it."""
    return evaluate.informative_metrics(informative(spark, sf_dir))


def informative(spark, sf_dir):
    policy = sample.sample_policy(spark)
    d = decided(spark, sf_dir, policy).withColumn("req", F.col("fp")).withColumn("tgt", F.col("query_tgt"))
    return evaluate.without_own_rule(d, settle(rule_hits(d.select("req", "src", "tgt", "cls"), policy, policy.closure())))


@query(WITHOUT + """, profile(name, more) AS (VALUES ('exact', []::VARCHAR[]), ('moderate', ['open', 'read', 'write']), ('greedy', ['append', 'create', 'getattr', 'ioctl', 'map', 'open', 'read', 'setattr', 'unlink', 'write'])),
    adv AS (SELECT name, list_distinct(list_concat(missing, more)) AS given, missing FROM cut, profile WHERE stops = 0)
    SELECT name AS profile, count(*) AS patch_generated, count(*) FILTER (list_has_all(given, missing) AND list_has_all(missing, given)) AS exact_min, count(*) FILTER (list_has_all(given, missing)) AS sufficient,
      count(*) FILTER (list_has_all(given, missing) AND NOT list_has_all(missing, given)) AS overbroad, sum(len(list_filter(given, lambda x: NOT list_contains(missing, x))))::BIGINT AS extra FROM adv GROUP BY 1""")
def o87_advisers(spark, sf_dir):
    """Three offline advisers, who are told what is missing, over the same cases."""
    cases = settle(informative(spark, sf_dir).where("n_neverallow = 0").withColumn("src", F.coalesce("src", F.lit("None"))).withColumn("perms", F.col("missing")))
    out = None
    for profile in evaluate.PROFILES:
        told = evaluate.compare(evaluate.advise(cases, profile), "advised")
        row = evaluate.metrics(told).select(F.lit(profile).alias("profile"), "patch_generated", "exact_min", "sufficient", "overbroad")
        row = row.crossJoin(told.agg(F.sum(F.size("extra")).alias("extra")))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query(ANSWERED + """, seen AS (SELECT DISTINCT req FROM hits WHERE kind = 'allow'), l AS (SELECT CASE WHEN n_neverallow > 0 THEN 'forbidden' WHEN allowed THEN 'granted' WHEN ioctl_allowed = false AND ioctl_reason = 'allowxperm' THEN 'command'
    WHEN ioctl_allowed = false THEN 'no_command' WHEN req IN (SELECT req FROM seen) THEN 'partly' ELSE 'nothing' END AS look, granted, missing, ioctl_cmd FROM ans)
    SELECT look, CASE look WHEN 'granted' THEN granted WHEN 'command' THEN ioctl_cmd WHEN 'partly' THEN missing END AS detail, count(*) AS cases FROM l GROUP BY 1, 2""")
def o92_first_look(spark, sf_dir):
    policy = sample.sample_policy(spark)
    a = answers(asked(spark, sf_dir).withColumn("tgt", F.col("query_tgt")).withColumn("req", F.col("fp")), policy, policy.closure())
    return evaluate.first_look(a).groupBy("look", F.array_join("look_detail", " ").alias("detail")).agg(F.count("*").alias("cases"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'read write' WHEN 1 THEN 'read' WHEN 2 THEN '' ELSE '0x1' END AS scope, CASE event_id % 3 WHEN 0 THEN 'allow a b:c { d };' WHEN 1 THEN 'allowxperm a b:c ioctl 0x1;' END AS rule FROM events""")
def o25_patch_scope(spark, sf_dir):
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    patch = F.when(i % 4 == 0, "allow a b:file { write read };").when(i % 4 == 1, "allow a b:file read;").when(i % 4 == 2, "").otherwise("allowxperm a b:c ioctl 0x1;")
    text = F.when(i % 3 == 0, "Use this:\n```\nallow a b:c { d };\n```").when(i % 3 == 1, "allowxperm a b:c ioctl 0x1").otherwise("NO allow")
    return e.select("event_id", words(evaluate.scope_of(patch)).alias("scope"), evaluate.rule_in(text).alias("rule"))


@query("SELECT * FROM (VALUES ('all_files', 'blk_file chr_file dir file'), ('device_files', 'blk_file chr_file'), ('loop', 'x')) t(name, tokens)")
def o37_symbol_macros(spark, sf_dir):
    text = "define(`all_files', `{ device_files other_files }')\ndefine(`device_files', `{ blk_file chr_file }')\ndefine(`call', `allow $1 $2:binder call;')\ndefine(`loop', `x loop')\ndefine(`other_files', `dir file')\n"
    out = macros.expand(macros.definitions(spark.createDataFrame([("a.spt", text)], "file string, text string")))
    return out.where("name <> 'other_files'").select("name", F.array_join("tokens", " ").alias("tokens"))


@query(ANSWERED + "SELECT count(*) AS clusters, sum(n)::BIGINT AS denials, count(*) FILTER (category = 'auto_repairable') AS auto_repairable, count(*) FILTER (category = 'needs_human') AS needs_human, count(*) FILTER (category = 'noise_or_already_allowed') AS noise FROM fin")
def o52_report_totals(spark, sf_dir):
    return report.totals(decided(spark, sf_dir)).select("clusters", "denials", "auto_repairable", "needs_human", "noise")


@query(ANSWERED + "SELECT count(DISTINCT patch) AS lines FROM fin WHERE category = 'auto_repairable'")
def o19_report_lines(spark, sf_dir):
    return report.markdown(decided(spark, sf_dir)).where(F.col("section") == "auto").agg((F.count("*") - 1).alias("lines"))


@query(ANSWERED + """SELECT allowed::VARCHAR AS all_allowed, (category = 'auto_repairable')::VARCHAR AS auto_safe, category, classification, (ioctl_reason IS NOT NULL)::VARCHAR AS has_ioctl, coalesce(ioctl_allowed, false)::VARCHAR AS ioctl_allowed, coalesce(ioctl_reason, '') AS ioctl_reason,
    n_neverallow::VARCHAR AS neverallow_hits, (category = 'needs_human')::VARCHAR AS needs_human, patch, (patch <> '')::VARCHAR AS produced_patch, (classification NOT IN ('MISSING_RULE', 'XPERM_GAP'))::VARCHAR AS quick_settled,
    CASE WHEN classification NOT IN ('MISSING_RULE', 'XPERM_GAP') THEN '' WHEN patch = '' THEN 'SKIP' ELSE 'APPROVE' END AS review_status, CASE WHEN classification NOT IN ('MISSING_RULE', 'XPERM_GAP') THEN '' ELSE verify_status END AS verify_status, 24::BIGINT AS keys, count(*) AS cases
    FROM fin GROUP BY ALL""")
def o95_case_answers(spark, sf_dir):
    lines = report.case_lines(decided(spark, sf_dir))
    keys = ("all_allowed", "auto_safe", "category", "classification", "has_ioctl", "ioctl_allowed", "ioctl_reason", "neverallow_hits", "needs_human", "patch", "produced_patch", "quick_settled", "review_status", "verify_status")
    return lines.groupBy(*[F.get_json_object("line", f"$.{k}").alias(k) for k in keys], F.size(F.json_object_keys("line")).cast("bigint").alias("keys")).agg(F.count("*").alias("cases"))


RED_LINES = """neverallow normal_hap dev_bbox:chr_file { read write };
neverallow { app_domain -debug_hap -ghost } ~{ dev_bbox sys_prod_file }:device_files ~{ ioctl };
neverallow * self:samgr_class *;
neverallow ghost dev_bbox:chr_file read;
neverallow debug_hap dev_bbox:nowhere read;
neverallow debug_hap dev_bbox:file send;
neverallow normal_hap dev_bbox:chr_file { write read };
neverallow $1 dev_bbox:file(read);
neverallowxperm debug_hap dev_camera_file:chr_file ioctl ~{ 0x0001 0x100000003 };
neverallowxperm debug_hap dev_camera_file:chr_file ioctl 0x10;"""


@query("""SELECT * FROM (VALUES ('(neverallow normal_hap dev_bbox (chr_file (read write)))', 1::BIGINT), ('(neverallow SET SET (chr_file (open read write)))', 1), ('(neverallow SET self (samgr_class (add get)))', 1),
    ('(neverallowx debug_hap dev_camera_file (ioctl chr_file (((range 0x0000 0x0000) (range 0x0002 0x0002) (range 0x0004 0xffff)))))', 1), ('(neverallowx debug_hap dev_camera_file (ioctl chr_file ((0x0010))))', 1), ('(typeattribute SET)', 3),
    ('(typeattributeset SET (all))', 1), ('(typeattributeset SET (and (app_domain) (not (debug_hap))))', 1), ('(typeattributeset SET (not (or (dev_bbox) (sys_prod_file))))', 1),
    ('skipped: names not on the board', 1), ('skipped: class not on the board', 1), ('skipped: permission not of the class', 1), ('skipped: macro or condition', 1)) t(line, n)""")
def o90_red_lines(spark, sf_dir):
    texts = spark.createDataFrame([("a.te", i, x) for i, x in enumerate(RED_LINES.split("\n"))], "file string, line int, statement string")
    lists = spark.createDataFrame([("device_files", ["chr_file"])], "name string, tokens array<string>")
    lines, skipped = assertions.assertions(texts, board(spark), lists)
    shown = lines.groupBy(F.regexp_replace("line", "red_line_set_[0-9a-f]+", "SET").alias("line")).agg(F.count("*").alias("n"))
    return shown.union(skipped.select(F.concat(F.lit("skipped: "), "reason"), "statements"))
