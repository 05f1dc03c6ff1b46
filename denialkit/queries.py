"""Registered queries on the driver's tables, and the same questions in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import apl_rank, is_mls_level, is_placeholder, is_vacuous
from .operators import crosslayer, evaluate
from .operators import minimize as mini
from .plans import sample
from .plans.access import answers, resolve_targets, rule_hits
from .plans.closure import ancestors, member_counts, settle
from .plans.ranges import held
from .plans.verdict import AUTO, candidates, converge, counts, explain, human_items, patch_lines, quick
from .sources import sehap
from .sources.denials import assemble_lines, clusters, parse_events, read_log_lines, suppressed, with_fingerprint
from .sources.policy import class_histogram, corpus_statistics, file_counts, parse_policy, summary
from .sources.scratch import scratch
from .sources.splits import read_lines, text_lines
from .streaming import follow as stream
from .streaming.accounting import Accounting
from .streaming.sessions import newest, session_report, sessions
from .streaming.state import once_counted

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def words(column):
    return F.array_join(F.sort_array(column), " ")


#: Distinct accesses of SYN-A with the first record of each.
ACCESS = f"""syn AS ({sample.SYN_A}),
acc AS (SELECT coalesce(src, '~') || '|' || tgt || '|' || cls || '|' || array_to_string(list_sort(string_split(perms, ' ')), ' ') || '|' || coalesce(ioctl_cmd, '~') AS req,
  any_value(src) AS src, any_value(tgt) AS tgt, any_value(cls) AS cls, list_sort(string_split(any_value(perms), ' ')) AS perms, any_value(ioctl_cmd) AS ioctl_cmd,
  arg_min(coalesce(service, ''), seq) AS service, arg_min(CASE WHEN permissive THEN 1 ELSE 0 END, seq) = 1 AS permissive, count(*) AS n, min(seq) AS first_seq
  FROM syn GROUP BY 1),
res AS (SELECT a.*, coalesce(CASE WHEN tgt = 'default_service' AND service <> '' AND cls = 'samgr_class' THEN (SELECT min(k.name) FROM (SELECT name FROM types UNION SELECT name FROM attributes) k
  WHERE k.name = CASE WHEN regexp_full_match(service, '[0-9]+') THEN (CASE WHEN perms = ['add'] THEN 'sa_' || src END) ELSE 'sa_' || service END) END, tgt) AS query_tgt FROM acc a)"""


def match(side: str, value: str) -> str:
    return f"""((r.{side}_star OR coalesce(list_contains(r.{side}, {value}), false) OR EXISTS (SELECT 1 FROM up WHERE up.name = {value} AND list_contains(r.{side}, up.token)))
      AND NOT coalesce(list_contains(r.{side}_neg, {value}), false) AND NOT EXISTS (SELECT 1 FROM up WHERE up.name = {value} AND list_contains(r.{side}_neg, up.token)))"""


#: What the rules answer to each access, and what follows from it.
ANSWERED = f"""WITH {sample.POLICY_SQL}, {ACCESS},
hits AS (SELECT a.req, r.* FROM res a JOIN rules r ON r.cls = a.cls AND {match('src', 'a.src')} AND {match('tgt', 'a.query_tgt')}),
perm AS (SELECT req, unnest(perms) AS p FROM res),
ok AS (SELECT q.req, q.p FROM perm q WHERE EXISTS (SELECT 1 FROM hits h WHERE h.req = q.req AND h.kind = 'allow' AND (len(h.perms) = 0 OR list_contains(h.perms, q.p)))),
sums AS (SELECT q.req, count(*) AS asked, count(ok.p) AS had, coalesce(string_agg(ok.p, ' ' ORDER BY ok.p), '') AS granted,
  coalesce(string_agg(CASE WHEN ok.p IS NULL THEN q.p END, ' ' ORDER BY q.p), '') AS missing FROM perm q LEFT JOIN ok ON ok.req = q.req AND ok.p = q.p GROUP BY 1),
stops AS (SELECT h.req, count(*) AS n_neverallow, arg_min(h.raw, h.rule_id) AS neverallow FROM hits h JOIN res a USING (req) WHERE h.kind = 'neverallow' AND (len(h.perms) = 0 OR list_has_any(h.perms, a.perms)) GROUP BY 1),
cmds AS (SELECT a.req, a.ioctl_cmd IS NOT NULL AND list_contains(a.perms, 'ioctl') AS has,
  coalesce(bool_or(h.kind = 'neverallowxperm' AND list_contains(h.xperms, a.ioctl_cmd)), false) AS black, coalesce(bool_or(h.kind = 'allowxperm'), false) AS white,
  coalesce(bool_or(h.kind = 'allowxperm' AND list_contains(h.xperms, a.ioctl_cmd)), false) AS listed, coalesce(bool_or(h.kind = 'allow' AND list_contains(h.perms, 'ioctl')), false) AS plain
  FROM res a LEFT JOIN hits h USING (req) GROUP BY a.req, a.ioctl_cmd, a.perms),
ans AS (SELECT a.*, s.granted, s.missing, s.had = s.asked AS allowed, coalesce(x.n_neverallow, 0) AS n_neverallow, x.neverallow,
  CASE WHEN c.has THEN (CASE WHEN black THEN 'neverallowxperm' WHEN white THEN 'allowxperm' WHEN plain THEN 'allow(ioctl)' ELSE 'no_allow' END) END AS ioctl_reason,
  CASE WHEN c.has THEN (CASE WHEN black THEN false WHEN white THEN listed ELSE plain END) END AS ioctl_allowed
  FROM res a JOIN sums s USING (req) LEFT JOIN stops x USING (req) JOIN cmds c USING (req)),
known AS (SELECT name FROM types UNION SELECT unnest(src) FROM rules UNION SELECT unnest(tgt) FROM rules),
cls AS (SELECT *, CASE WHEN n_neverallow > 0 THEN 'POTENTIAL_ESCALATION' WHEN ioctl_allowed = false AND ioctl_reason = 'allowxperm' THEN 'XPERM_GAP' WHEN ioctl_allowed = false THEN 'MISSING_RULE'
  WHEN allowed AND permissive THEN 'NOISE_OR_ALREADY_FIXED' WHEN allowed THEN 'DOMAIN_OR_LABEL_MISMATCH' ELSE 'MISSING_RULE' END AS classification FROM ans),
pat AS (SELECT *, CASE classification WHEN 'MISSING_RULE' THEN 'allow ' || coalesce(src, 'None') || ' ' || tgt || ':' || cls || ' {{ ' || missing || ' }};'
  WHEN 'XPERM_GAP' THEN 'allowxperm ' || coalesce(src, 'None') || ' ' || tgt || ':' || cls || ' ioctl {{ ' || ioctl_cmd || ' }};' ELSE '' END AS patch FROM cls),
dec AS (SELECT *, CASE WHEN tgt = 's0' THEN 'mls' WHEN tgt = 'default_service' THEN 'placeholder' WHEN src IS NULL OR src NOT IN (SELECT name FROM known) OR tgt NOT IN (SELECT name FROM known) THEN 'unknown'
  WHEN cls NOT IN (SELECT cls FROM rules) THEN 'class' WHEN EXISTS (SELECT 1 FROM perm q WHERE q.req = pat.req AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.kind IN ('allow', 'neverallow') AND list_contains(r.perms, q.p))) THEN 'perm'
  WHEN patch LIKE '%{{  }}%' THEN 'vacuous' END AS guard,
  CASE WHEN patch = '' THEN (CASE WHEN classification = 'NOISE_OR_ALREADY_FIXED' THEN 'VERIFIED_AS_NOISE' ELSE 'HUMAN_REVIEW_REQUIRED' END) WHEN src IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS verify_status FROM pat),
fin AS (SELECT *, CASE WHEN classification IN ('POTENTIAL_ESCALATION', 'DOMAIN_OR_LABEL_MISMATCH') THEN 'needs_human' WHEN classification = 'NOISE_OR_ALREADY_FIXED' THEN 'noise_or_already_allowed'
  WHEN verify_status = 'SUCCESS' AND guard IS NULL THEN 'auto_repairable' ELSE 'needs_human' END AS category FROM dec)
"""


def decided(spark: SparkSession, sf_dir: str, policy=None) -> DataFrame:
    """SYN-A decided; a query that asks the same policy again hands it in, so its closure is made once."""
    return converge(sample.syn_a(spark, sf_dir), policy or sample.sample_policy(spark))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(resolve_targets(clusters(with_fingerprint(sample.syn_a(spark, sf_dir))), sample.sample_policy(spark)))


@query(f"SELECT seq, src, tgt, cls, perms, permissive, ioctl_cmd, service, 'probe' AS comm, 1::BIGINT AS pid FROM ({sample.SYN_A})")
def o02_event_fields(spark, sf_dir):
    return sample.syn_a(spark, sf_dir).select("seq", "src", "tgt", "cls", F.array_join("perms", " ").alias("perms"), "permissive", "ioctl_cmd", "service", "comm", "pid")


@query(f"""SELECT seq, substr(sha1('{{"cls": "' || cls || '", "ioctl": ' || coalesce('"' || ioctl_cmd || '"', 'null') || ', "perms": ["' || array_to_string(list_sort(string_split(perms, ' ')), '", "') || '"], "src": ' || coalesce('"' || src || '"', 'null') || ', "tgt": "' || tgt || '"}}'), 1, 12) AS fp
    FROM ({sample.SYN_A})""")
def o20_fingerprint(spark, sf_dir):
    return with_fingerprint(sample.syn_a(spark, sf_dir)).select("seq", "fp")


@query(f"""SELECT coalesce(src, '~') AS src, tgt, cls, array_to_string(list_sort(string_split(perms, ' ')), ' ') AS perms, coalesce(ioctl_cmd, '~') AS ioctl_cmd, count(*) AS n, count(*) FILTER (permissive) AS n_permissive,
    count(*) FILTER (NOT permissive) AS n_enforcing, count(*) FILTER (permissive IS NULL) AS n_unknown, min(seq) AS first_seq FROM ({sample.SYN_A}) GROUP BY 1, 2, 3, 4, 5""")
def o51_clusters(spark, sf_dir):
    c = clusters(with_fingerprint(sample.syn_a(spark, sf_dir)))
    return c.select(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls", words("perms").alias("perms"), F.coalesce("ioctl_cmd", F.lit("~")).alias("ioctl_cmd"), "n", "n_permissive", "n_enforcing", "n_unknown", "first_seq")


SYN_B_EDGES = """edges(child, parent) AS (SELECT 'supp_' || s_suppkey, 'nation_' || s_nationkey FROM supplier UNION SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation
  UNION SELECT 'part_' || p_partkey, 'brand_' || regexp_replace(p_brand, '[^A-Za-z0-9_]', '', 'g') FROM part)"""


@query(f"WITH RECURSIVE {SYN_B_EDGES}, up(name, token) AS (SELECT child, parent FROM edges UNION SELECT u.name, e.parent FROM up u JOIN edges e ON e.child = u.token) SELECT name, token FROM up WHERE name <> token")
def o35_closure(spark, sf_dir):
    return ancestors(sample.syn_b_policy(spark, sf_dir).edges)


@query(ANSWERED + "SELECT coalesce(src, '~') AS src, tgt, cls, array_to_string(perms, ' ') AS perms, coalesce(ioctl_cmd, '~') AS ioctl_cmd, query_tgt, allowed, granted, n_neverallow, neverallow, ioctl_allowed, ioctl_reason FROM ans")
def o40_answers(spark, sf_dir):
    policy = sample.sample_policy(spark)
    a = asked(spark, sf_dir).withColumn("logged_tgt", F.col("tgt")).withColumn("tgt", F.col("query_tgt")).withColumn("req", F.col("fp"))
    return answers(a, policy, policy.closure()).select(
        F.coalesce("src", F.lit("~")).alias("src"), F.col("logged_tgt").alias("tgt"), "cls", words("perms").alias("perms"), F.coalesce("ioctl_cmd", F.lit("~")).alias("ioctl_cmd"), "query_tgt", "allowed", words("granted").alias("granted"), F.col("n_neverallow").cast("bigint").alias("n_neverallow"), "neverallow", "ioctl_allowed", "ioctl_reason")


@query(f"WITH {sample.POLICY_SQL}, {ACCESS} SELECT query_tgt, count(*) AS cases, sum(n)::BIGINT AS denials FROM res WHERE tgt = 'default_service' GROUP BY 1")
def o44_placeholders(spark, sf_dir):
    return asked(spark, sf_dir).where("tgt = 'default_service'").groupBy("query_tgt").agg(F.count("*").alias("cases"), F.sum("n").alias("denials"))


@query(ANSWERED + "SELECT category, classification, count(*) AS cases, sum(n)::BIGINT AS denials FROM fin GROUP BY 1, 2")
def o75_converge(spark, sf_dir):
    return counts(decided(spark, sf_dir))


@query(ANSWERED + "SELECT coalesce(src, '~') AS src, tgt, cls, array_to_string(perms, ' ') AS perms, coalesce(ioctl_cmd, '~') AS ioctl_cmd, category, classification, patch, verify_status, coalesce(guard, '-') AS guard FROM fin")
def o72_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls", words("perms").alias("perms"), F.coalesce("ioctl_cmd", F.lit("~")).alias("ioctl_cmd"), "category", "classification", "patch", "verify_status", F.coalesce("guard", F.lit("-")).alias("guard"))


@query(ANSWERED + "SELECT patch, count(*) AS cases, sum(n)::BIGINT AS denials FROM fin WHERE category = 'auto_repairable' GROUP BY 1")
def o53_patch_lines(spark, sf_dir):
    return patch_lines(decided(spark, sf_dir))


@query(ANSWERED + "SELECT guard, count(*) AS cases FROM fin WHERE patch <> '' AND verify_status = 'SUCCESS' AND guard IS NOT NULL GROUP BY 1")
def o74_guards(spark, sf_dir):
    return decided(spark, sf_dir).where("bucket = 'auto_repairable' and guard is not null").groupBy("guard").agg(F.count("*").alias("cases"))


@query(ANSWERED + "SELECT coalesce(src, '~') AS src, tgt, cls, array_to_string(perms, ' ') AS perms, n, classification FROM fin WHERE category = 'needs_human'")
def o54_human_items(spark, sf_dir):
    return human_items(decided(spark, sf_dir)).select(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls", words("perms").alias("perms"), "n", "classification")


@query(ANSWERED + """SELECT classification, CASE classification WHEN 'MISSING_RULE' THEN 'A B C' WHEN 'XPERM_GAP' THEN 'B A C' ELSE 'C' END AS ids,
    CASE WHEN classification IN ('MISSING_RULE', 'XPERM_GAP') THEN 'B' WHEN classification = 'NOISE_OR_ALREADY_FIXED' THEN '-' ELSE 'C' END AS recommended, count(*) AS cases FROM fin GROUP BY 1""")
def o69_candidates(spark, sf_dir):
    return candidates(decided(spark, sf_dir)).groupBy("classification", F.array_join("candidates.id", " ").alias("ids"), "recommended").agg(F.count("*").alias("cases"))


def _listed(text: str) -> str:
    """DuckDB text of a JSON list of the words in a text."""
    return f"""CASE WHEN {text} = '' THEN '[]' ELSE '["' || replace({text}, ' ', '","') || '"]' END"""


@query(ANSWERED + f"""SELECT classification, coalesce(src, 'None') AS src, tgt, cls, {_listed("granted")} AS granted, {_listed("missing")} AS missing, {_listed("array_to_string(perms, ' ')")} AS requested, CASE WHEN ioctl_reason IS NOT NULL THEN ioctl_cmd END AS ioctl,
    CASE WHEN classification IN ('POTENTIAL_ESCALATION', 'DOMAIN_OR_LABEL_MISMATCH') THEN 'true' ELSE 'false' END AS needs_human, patch, CASE WHEN patch = '' THEN 'SKIP' ELSE 'APPROVE' END AS review, verify_status AS verify,
    CASE WHEN classification IN ('MISSING_RULE', 'XPERM_GAP') THEN 'B' WHEN classification = 'NOISE_OR_ALREADY_FIXED' THEN '-' ELSE 'C' END AS recommended_id, CASE WHEN guard IS NULL THEN 'false' ELSE 'true' END AS advised, 15::BIGINT AS keys FROM fin""")
def o76_explain(spark, sf_dir):
    from .operators.report import explain_lines

    lines = explain_lines(decided(spark, sf_dir))
    keys = ("classification", "src", "tgt", "cls", "granted", "missing", "requested", "ioctl", "needs_human", "patch", "review", "verify", "recommended.id")
    told = [F.get_json_object("line", f"$.{k}").alias(k.replace(".", "_")) for k in keys]
    return lines.select(*told, (F.get_json_object("line", "$.advisory") != "").cast("string").alias("advised"), F.size(F.json_object_keys("line")).cast("bigint").alias("keys"))


@query(ANSWERED + """SELECT CASE WHEN n_neverallow > 0 THEN 'POTENTIAL_ESCALATION' WHEN allowed AND coalesce(ioctl_allowed, true) THEN (CASE WHEN permissive THEN 'NOISE_OR_ALREADY_FIXED' ELSE 'DOMAIN_OR_LABEL_MISMATCH' END) END AS quick_class,
    CASE WHEN n_neverallow > 0 THEN 'needs_human' WHEN allowed AND coalesce(ioctl_allowed, true) THEN (CASE WHEN permissive THEN 'noise_or_already_allowed' ELSE 'needs_human' END) END AS quick_category, count(*) AS cases FROM ans GROUP BY 1, 2""")
def o67_quick_verdicts(spark, sf_dir):
    policy = sample.sample_policy(spark)
    a = asked(spark, sf_dir).withColumn("tgt", F.col("query_tgt")).withColumn("req", F.col("fp"))
    return quick(answers(a, policy, policy.closure())).groupBy("quick_class", "quick_category").agg(F.count("*").alias("cases"))


MINI = ANSWERED + """, lines AS (SELECT classification, src, tgt, cls, patch, count(*) AS cases, sum(n)::BIGINT AS denials FROM fin WHERE category = 'auto_repairable' GROUP BY 1, 2, 3, 4, 5),
pp AS (SELECT DISTINCT f.classification, f.src, f.tgt, f.cls, unnest(CASE f.classification WHEN 'XPERM_GAP' THEN [f.ioctl_cmd] ELSE string_split(f.missing, ' ') END) AS p FROM fin f WHERE category = 'auto_repairable'),
grp AS (SELECT l.classification, l.src, l.tgt, l.cls, sum(l.cases)::BIGINT AS cases, sum(l.denials)::BIGINT AS denials, count(*) AS lines FROM lines l GROUP BY 1, 2, 3, 4),
rule AS (SELECT g.*, CASE WHEN g.classification = 'XPERM_GAP' THEN 'allowxperm' ELSE 'allow' END AS kind, (SELECT string_agg(p, ' ' ORDER BY p) FROM pp WHERE pp.classification = g.classification AND pp.src = g.src AND pp.tgt = g.tgt AND pp.cls = g.cls) AS perms FROM grp g)
"""


@query(MINI + "SELECT kind, src, tgt, cls, perms, cases, denials, lines FROM rule")
def o60_minimize(spark, sf_dir):
    return mini.collapse(patch_lines(decided(spark, sf_dir))).select("kind", "src", "tgt", "cls", F.array_join("perms", " ").alias("perms"), "cases", "denials", "lines")


@query(MINI + """, reach AS (SELECT r.rule_id, coalesce((SELECT sum(CASE WHEN t.x IN (SELECT name FROM attributes) THEN (SELECT count(*) FROM (VALUES ('hap_domain','app_domain'),('normal_hap','hap_domain'),('system_basic_hap','hap_domain'),('system_core_hap','hap_domain'),('debug_hap','hap_domain')) e(c, p) WHERE e.p = t.x) ELSE 1 END) FROM (SELECT unnest(r.src) AS x) t), 1)::BIGINT AS reach FROM rules r)
    SELECT u.kind, u.src, u.tgt, u.cls, coalesce((SELECT arg_min(r.raw, (h.reach, r.raw)) FROM rules r JOIN reach h USING (rule_id) WHERE u.kind = 'allow' AND r.kind = 'allow' AND r.cls = u.cls AND """ + match("src", "u.src") + " AND " + match("tgt", "u.tgt") + "), '-') AS fold_into FROM rule u")
def o61_fold(spark, sf_dir):
    policy = sample.sample_policy(spark)
    rules = mini.collapse(patch_lines(decided(spark, sf_dir, policy)))
    return mini.fold(rules, policy).select("kind", "src", "tgt", "cls", F.coalesce("fold_into", F.lit("-")).alias("fold_into"))


@query(f"""WITH {SYN_B_EDGES}, n AS (SELECT parent, count(*) AS k FROM edges GROUP BY 1), pairs AS (SELECT DISTINCT 'nation_' || n_nationkey AS src, 'brand_' || regexp_replace(p_brand, '[^A-Za-z0-9_]', '', 'g') AS tgt FROM nation, part)
    SELECT src, tgt, coalesce(a.k, 0) * b.k AS pairs, 2 * coalesce(a.k, 0) * b.k AS grants, CASE WHEN coalesce(a.k, 0) * b.k = 1 THEN 'low' WHEN coalesce(a.k, 0) * b.k <= 16 THEN 'medium' ELSE 'high' END AS level FROM pairs LEFT JOIN n a ON a.parent = src JOIN n b ON b.parent = tgt
    WHERE a.k IS NOT NULL""")
def o63_blast_radius(spark, sf_dir):
    policy = sample.syn_b_policy(spark, sf_dir)
    held = member_counts(policy.edges)
    pairs = held.where("token like 'nation_%'").select(F.col("token").alias("src")).crossJoin(F.broadcast(held.where("token like 'brand_%'").select(F.col("token").alias("tgt"))))  # 25 nations x 25 brands
    out = mini.blast(pairs.withColumn("perms", F.array(F.lit("read"), F.lit("write"))), policy)
    return out.select("src", "tgt", F.col("pairs").cast("bigint").alias("pairs"), F.col("grants").cast("bigint").alias("grants"), "level")


@query(MINI + """SELECT CASE WHEN perms = ['ioctl'] AND ioctl_allowed IS NOT NULL THEN ioctl_allowed ELSE allowed END AS before, perms <> ['ioctl'] OR ioctl_reason IS DISTINCT FROM 'neverallowxperm' AS after,
    CASE WHEN classification = 'XPERM_GAP' THEN coalesce((SELECT string_agg(m, ' ' ORDER BY m) FROM unnest(string_split(missing, ' ')) t(m) WHERE m <> '' AND NOT EXISTS (SELECT 1 FROM pp WHERE pp.classification = 'MISSING_RULE' AND pp.src = fin.src AND pp.tgt = fin.tgt AND pp.cls = fin.cls AND pp.p = m)), '') ELSE '' END || CASE WHEN ioctl_reason = 'neverallowxperm' THEN ' ' || ioctl_cmd ELSE '' END AS residual, count(*) AS cases FROM fin WHERE category = 'auto_repairable' GROUP BY 1, 2, 3""")
def o66_closed_loop(spark, sf_dir):
    """A command that a neverallowxperm forbids stays forbidden whatever a patch allows."""
    policy = sample.sample_policy(spark)
    d = decided(spark, sf_dir, policy)
    loop = mini.closed_loop(d.where(F.col("category") == AUTO), mini.collapse(patch_lines(d)), policy)
    left = F.concat(F.array_join("residual_missing", " "), F.coalesce(F.concat(F.lit(" "), "residual_command"), F.lit("")))
    return loop.groupBy("before", "after", left.alias("residual")).agg(F.count("*").alias("cases"))


@query("SELECT * FROM (VALUES ('allow', 6), ('neverallow', 2), ('allowxperm', 1), ('neverallowxperm', 1), ('rules', 10), ('types', 11), ('attributes', 2), ('skipped_statements', 1)) t(item, n)")
def o56_policy_summary(spark, sf_dir):
    return summary(sample.sample_policy(spark)).select("item", F.col("n").cast("int").alias("n"))


def _denial_texts(spark, sf_dir):
    """SYN-A lines ten to a file, so that record assembly has files to take apart."""
    lines = sample.syn_a_lines(spark, sf_dir)
    files = lines.groupBy(F.floor(F.col("seq") / 10).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: F.concat(F.lit("# note\n"), x["line"], F.lit(" \\\n tail=1\n"))), "").alias("text"))
    return files.select(F.col("file").cast("string").alias("file"), "text")


@query(f"SELECT coalesce(src, '~') AS src, tgt, cls, perms, count(*) AS n FROM ({sample.SYN_A}) GROUP BY 1, 2, 3, 4")
def o01_assembly(spark, sf_dir):
    from .sources.denials import assemble, parse_events

    events = parse_events(assemble(_denial_texts(spark, sf_dir)))
    return events.groupBy(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls", F.array_join("perms", " ").alias("perms")).agg(F.count("*").alias("n"))


@query(r"""SELECT sum(len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS lines, sum(len(regexp_extract_all(text, '(?i)\\bavc\\s*:\\s*denied')))::BIGINT AS events FROM documents""")
def o01_no_denials_in_documents(spark, sf_dir):
    """Every line of every document goes through the assembly."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), "text")
    lines = text_lines(docs)
    return lines.agg(F.count("*").alias("lines")).crossJoin(assemble_lines(lines).agg(F.count("*").alias("events")))  # one row each


@query(f"SELECT coalesce(src, '~') AS src, tgt, cls, perms, count(*) AS n FROM ({sample.SYN_A}) GROUP BY 1, 2, 3, 4")
def o01_log_files(spark, sf_dir):
    """SYN-A as log files with comments and continued lines, read by whatever splits Spark makes."""
    path = scratch(spark, "logs")
    sample.syn_a_lines(spark, sf_dir).select(F.concat(F.lit("# note\n"), "line", F.lit(" \\\n tail=1"))).write.text(path)
    events = parse_events(assemble_lines(read_log_lines(spark, path)))
    return events.groupBy(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls", F.array_join("perms", " ").alias("perms")).agg(F.count("*").alias("n"))


@query("""SELECT 'supp_' || l_suppkey AS src, CASE WHEN l_linenumber % 3 = 2 THEN 'write' WHEN l_linenumber % 3 = 1 THEN 'read write' ELSE 'read' END AS perms, count(DISTINCT l_partkey) AS targets, count(*) AS rules FROM lineitem GROUP BY 1, 2""")
def o04_rule_files(spark, sf_dir):
    """A rule for each lineitem row, wrapped over lines and in wrappers, read by whatever splits Spark makes."""
    li, path, k = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), scratch(spark, "rules"), F.col("l_linenumber") % 3
    head = F.concat(F.lit("allow supp_"), "l_suppkey", F.lit(" part_"), "l_partkey", F.lit(":file"))
    wrapped = F.concat(F.lit("debug_only(`\n"), head, F.lit("\n  { read };  # note\n')"))
    li.select(F.when(k == 0, wrapped).when(k == 1, F.concat(head, F.lit(" { read\n write };\nmacro(x)"))).otherwise(F.concat(head, F.lit(" write;")))).write.text(path)
    rules = parse_policy(read_lines(spark, path)).rules
    return rules.groupBy(F.get("src", F.lit(0)).alias("src"), words("perms").alias("perms")).agg(F.count_distinct("tgt").alias("targets"), F.count("*").alias("rules"))


@query("""WITH r AS (SELECT l_suppkey % 50 AS key, l_partkey * 37 % 5000 AS lo, l_partkey * 37 % 5000 + l_linenumber * l_linenumber * 9 - 12 AS hi FROM lineitem WHERE l_orderkey % 2 = 0),
    c AS (SELECT user_id % 60 AS key, event_id * 13 % 70000 AS n, count(*) AS events FROM events GROUP BY 1, 2)
    SELECT key, count(*) AS commands, sum(events)::BIGINT AS events FROM c WHERE EXISTS (SELECT 1 FROM r WHERE r.key = c.key AND c.n BETWEEN r.lo AND r.hi) GROUP BY 1""")
def o42_command_ranges(spark, sf_dir):
    """The events' commands against many overlapping ranges a key."""
    li, e = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/events.parquet")
    lo = F.col("l_partkey") * 37 % 5000
    r = li.where("l_orderkey % 2 = 0").select((F.col("l_suppkey") % 50).alias("key"), lo.alias("lo"), (lo + F.col("l_linenumber") * F.col("l_linenumber") * 9 - 12).alias("hi"))
    c = e.groupBy((F.col("user_id") % 60).alias("key"), (F.col("event_id") * 13 % 70000).alias("n")).agg(F.count("*").alias("events"))
    return held(c, r, "key").groupBy("key").agg(F.count("*").alias("commands"), F.sum("events").alias("events"))


@query("SELECT user_id % 7 AS k, sum(event_id % 1000)::BIGINT AS lost FROM events GROUP BY 1")
def o17_suppressed(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit("x kauditd_printk_skb: "), (F.col("event_id") % 1000).cast("string"), F.lit(" callbacks suppressed\nnotkauditd_printk_skb: 5 callbacks suppressed"))
    return e.groupBy((F.col("user_id") % 7).alias("k")).agg(F.sum(suppressed(text)).alias("lost"))


@query("""SELECT event_id, regexp_full_match(t, 's[0-9]+(\\.c[0-9]+(-c[0-9]+)?)?') AS mls, t = 'default_service' AS placeholder, event_id % 2 = 0 AS vacuous,
    CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS apl
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 's0' WHEN 1 THEN 's12.c3' WHEN 2 THEN 's1.c2-c9' WHEN 3 THEN 'default_service' ELSE 's0x' END AS t FROM events)""")
def o22_predicates(spark, sf_dir):
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    pick = lambda n, xs: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    t = pick(5, ("s0", "s12.c3", "s1.c2-c9", "default_service", "s0x"))
    return e.select("event_id", is_mls_level(t).alias("mls"), is_placeholder(t).alias("placeholder"), is_vacuous(F.when(i % 2 == 0, "allow a b:c {  };").otherwise("allow a b:c { d };")).alias("vacuous"), apl_rank(pick(4, ("normal", "system_basic", "system_core", "other"))).alias("apl"))


@query("""SELECT 'allow' AS kind, 3::BIGINT AS n UNION ALL SELECT 'blank', 2 UNION ALL SELECT 'comment', 1 UNION ALL SELECT 'denial', 1 UNION ALL SELECT 'other', 1 UNION ALL SELECT 'type', 1""")
def o58_corpus_statistics(spark, sf_dir):
    text = "type a;\n\nallow a b:c d;\nallow a b:c e;\n# note\n#avc:  denied  { d } for\nallow b c:d e;\nmacro(a)\n"
    return corpus_statistics(spark.createDataFrame([("a.te", text)], "file string, text string"))


SYN_B_SQL = f"""WITH {SYN_B_EDGES}, up(name, token) AS (SELECT child, child FROM edges UNION SELECT child, parent FROM edges UNION SELECT a.child, b.parent FROM edges a JOIN edges b ON b.child = a.parent),
brand AS (SELECT DISTINCT p_brand, 'brand_' || regexp_replace(p_brand, '[^A-Za-z0-9_]', '', 'g') AS b FROM part),
req AS (SELECT DISTINCT 'supp_' || l_suppkey AS src, 'part_' || (l_partkey - l_partkey % 2 * l_linenumber) AS tgt, CASE l_linestatus WHEN 'O' THEN 'file' ELSE 'dir' END AS cls, CASE l_returnflag WHEN 'A' THEN ['open', 'read'] ELSE ['getattr', 'write'] END AS perms FROM lineitem),
rule(kind, src, neg, tgt, cls, perms) AS (
  SELECT DISTINCT 'allow', 'supp_' || l_suppkey, '', 'part_' || l_partkey, CASE l_linestatus WHEN 'O' THEN 'file' ELSE 'dir' END, CASE l_returnflag WHEN 'A' THEN ['read', 'open'] WHEN 'N' THEN ['write'] ELSE ['ioctl'] END FROM lineitem
  UNION ALL SELECT 'allow', 'nation_' || n_nationkey, 'supp_' || (n_nationkey + 1), b, 'file', ['getattr'] FROM nation, brand WHERE n_nationkey % 5 = 0 AND p_brand LIKE '%1'
  UNION ALL SELECT 'allow', '*', '', b, 'dir', ['*'] FROM brand WHERE p_brand LIKE '%2'
  UNION ALL SELECT 'neverallow', 'region_' || r_regionkey, '', b, 'file', ['write'] FROM region, brand WHERE p_brand LIKE '%3'),
stok AS (SELECT src, src AS tok FROM (SELECT DISTINCT src FROM req) UNION SELECT r.src, u.token FROM (SELECT DISTINCT src FROM req) r JOIN up u ON u.name = r.src),
ttok AS (SELECT tgt, tgt AS tok FROM (SELECT DISTINCT tgt FROM req) UNION SELECT r.tgt, u.token FROM (SELECT DISTINCT tgt FROM req) r JOIN up u ON u.name = r.tgt),
hits AS (SELECT q.src, q.tgt, q.cls, q.perms AS asked, u.kind, u.perms FROM req q JOIN ttok t ON t.tgt = q.tgt JOIN stok s ON s.src = q.src JOIN rule u ON u.tgt = t.tok AND u.cls = q.cls AND u.src = s.tok WHERE NOT EXISTS (SELECT 1 FROM stok x WHERE x.src = q.src AND x.tok = u.neg)
  UNION ALL SELECT q.src, q.tgt, q.cls, q.perms, u.kind, u.perms FROM req q JOIN ttok t ON t.tgt = q.tgt JOIN rule u ON u.tgt = t.tok AND u.cls = q.cls AND u.src = '*'),
per AS (SELECT src, tgt, cls, asked, bool_or(kind = 'allow' AND (list_contains(perms, '*') OR list_contains(perms, asked[1]))) AND bool_or(kind = 'allow' AND (list_contains(perms, '*') OR list_contains(perms, asked[2]))) AS allowed,
  bool_or(kind = 'neverallow' AND list_has_any(perms, asked)) AS stopped FROM hits GROUP BY 1, 2, 3, 4)"""


@query(SYN_B_SQL + " SELECT q.cls, array_to_string(q.perms, ' ') AS perms, coalesce(p.allowed, false) AS allowed, coalesce(p.stopped, false) AS stopped, count(*) AS requests FROM req q LEFT JOIN per p ON p.src = q.src AND p.tgt = q.tgt AND p.cls = q.cls AND p.asked = q.perms GROUP BY 1, 2, 3, 4")
def o38_access_at_scale(spark, sf_dir):
    policy = sample.syn_b_policy(spark, sf_dir)
    a = answers(sample.syn_b_requests(spark, sf_dir).drop("req"), policy, policy.closure())
    return a.groupBy("cls", words("perms").alias("perms"), "allowed", (F.col("n_neverallow") > 0).alias("stopped")).agg(F.count("*").alias("requests"))


@query(f"WITH {SYN_B_EDGES} SELECT parent AS token, count(*) AS members FROM edges GROUP BY 1")
def o62_fanout(spark, sf_dir):
    return member_counts(sample.syn_b_policy(spark, sf_dir).edges)


SEHAP = """apl=normal domain=normal_hap type=normal_hap_data_file
apl=normal debuggable=true domain=debug_hap type=debug_hap_data_file
apl=system_basic domain=system_basic_hap type=system_basic_hap_data_file
apl=system_core domain=system_core_hap type=system_core_hap_data_file
# apl=normal domain=comment_hap type=x
short line
apl=normal extra=nonsense domain=odd_hap type=odd_hap_data_file
domain=no_level_hap type=no_level_hap_data_file
apl=normal stray domain=stray_hap type=stray_hap_data_file"""


def sehap_lines(spark):
    return spark.createDataFrame([("sehap_contexts", i, x) for i, x in enumerate(SEHAP.split("\n"), 1)], "file string, line_no int, line string")


@query("SELECT 4::BIGINT AS entries, 4::BIGINT AS domains, 3::BIGINT AS apls, 1::BIGINT AS debuggable, 0::BIGINT AS with_extra, 4::BIGINT AS skipped")
def o57_sehap_summary(spark, sf_dir):
    return sehap.sehap_summary(sehap.parse_sehap(sehap_lines(spark)))


@query("SELECT * FROM (VALUES ('normal_hap', 'sibling', 'debug_hap'), ('debug_hap', 'sibling', 'normal_hap'), ('system_basic_hap', 'none', ''), ('system_core_hap', 'none', '')) t(domain, kind, other)")
def o50_debug_pairs(spark, sf_dir):
    return crosslayer.debug_pairs(sehap.entries(sehap.parse_sehap(sehap_lines(spark))))


@query(ANSWERED + f""", hap(domain, rank) AS (VALUES ('normal_hap', 0), ('debug_hap', 0), ('system_basic_hap', 1), ('system_core_hap', 2)),
sib AS (SELECT a.req, h.rank AS own, o.domain AS other, o.rank, q.p, EXISTS (SELECT 1 FROM rules r WHERE r.kind = 'allow' AND r.cls = a.cls AND {match('src', 'o.domain')} AND {match('tgt', 'a.query_tgt')} AND (len(r.perms) = 0 OR list_contains(r.perms, q.p))) AS ok
  FROM ans a JOIN hap h ON h.domain = a.src JOIN hap o ON o.domain <> a.src JOIN perm q ON q.req = a.req),
oth AS (SELECT req, own, other, rank FROM sib GROUP BY 1, 2, 3, 4 HAVING bool_and(ok)),
v AS (SELECT a.src, a.tgt, a.cls, array_to_string(a.perms, ' ') AS perms, coalesce(a.ioctl_cmd, '~') AS ioctl_cmd, CASE WHEN a.allowed THEN 'none' WHEN EXISTS (SELECT 1 FROM oth o WHERE o.req = a.req AND o.rank > o.own) THEN 'app' ELSE 'system' END AS fix_layer,
  coalesce((SELECT string_agg(other, ' ' ORDER BY other) FROM oth o WHERE o.req = a.req), '') AS allowing FROM ans a JOIN hap h ON h.domain = a.src) SELECT * FROM v""")
def o77_cross_layer(spark, sf_dir):
    policy = sample.sample_policy(spark)
    d = decided(spark, sf_dir, policy)
    v = crosslayer.cross_layer(d, policy, sehap.entries(sehap.parse_sehap(sehap_lines(spark))))
    return v.select("src", "tgt", "cls", words("perms").alias("perms"), F.coalesce("ioctl_cmd", F.lit("~")).alias("ioctl_cmd"), "fix_layer", words("allowing").alias("allowing"))


@query(ANSWERED + "SELECT cls, count(*) AS cases, count(*) FILTER (allowed) AS all_allowed, count(*) FILTER (granted <> '') AS any_allowed FROM ans GROUP BY 1")
def o84_replay(spark, sf_dir):
    return evaluate.replay(decided(spark, sf_dir), "cls").select("cls", "cases", "all_allowed", "any_allowed")


@query(ANSWERED + "SELECT q.p AS perm, count(*) AS cases FROM perm q LEFT JOIN ok ON ok.req = q.req AND ok.p = q.p WHERE ok.p IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def o84_missing_permissions(spark, sf_dir):
    return evaluate.missing_permissions(decided(spark, sf_dir))


@query(ANSWERED + """, pr AS (SELECT q.req, q.p, h.raw FROM perm q JOIN ans a ON a.req = q.req AND a.allowed JOIN hits h ON h.req = q.req AND h.kind = 'allow' AND (len(h.perms) = 0 OR list_contains(h.perms, q.p))),
    solo AS (SELECT req, p, min(raw) AS raw FROM pr GROUP BY 1, 2 HAVING count(DISTINCT raw) = 1) SELECT raw, count(DISTINCT req) AS cases FROM solo GROUP BY 1""")
def o85_leave_one_out(spark, sf_dir):
    policy = sample.sample_policy(spark)
    d = decided(spark, sf_dir, policy)
    moved = d.select(F.col("fp").alias("req"), "src", F.col("query_tgt").alias("tgt"), "cls")
    out = evaluate.leave_one_out(d.withColumn("req", F.col("fp")), rule_hits(moved, policy, policy.closure()))
    return out.groupBy("raw").agg(F.count("*").alias("cases"))


@query(ANSWERED + """SELECT coalesce(src, '~') AS src, tgt, '{"allowed":' || allowed || ',"granted":' || """ + _listed("granted") + """ || ',"ioctl_allowed":' || coalesce(ioctl_allowed::VARCHAR, 'null') || ',"ioctl_reason":' || coalesce('"' || ioctl_reason || '"', 'null') || ',"neverallow":' || n_neverallow || '}' AS answer, count(*) AS n FROM ans GROUP BY 1, 2, 3""")
def o94_batch_answers(spark, sf_dir):
    policy = sample.sample_policy(spark)
    a = answers(asked(spark, sf_dir).withColumn("logged_tgt", F.col("tgt")).withColumn("tgt", F.col("query_tgt")).withColumn("req", F.col("fp")), policy, policy.closure())
    told = F.to_json(F.struct("allowed", F.array_sort("granted").alias("granted"), "ioctl_allowed", "ioctl_reason", F.col("n_neverallow").alias("neverallow")), {"ignoreNullFields": "false"})
    return a.groupBy(F.coalesce("src", F.lit("~")).alias("src"), F.col("logged_tgt").alias("tgt"), told.alias("answer")).agg(F.count("*").alias("n"))


@query(f"""SELECT coalesce(src, '~') AS src, tgt, cls, array_to_string(list_sort(string_split(perms, ' ')), ' ') AS perms, coalesce(ioctl_cmd, '~') AS ioctl_cmd, coalesce(src, '') = 'debug_hap' AS tool, count(*) AS n
    FROM ({sample.SYN_A}) GROUP BY 1, 2, 3, 4, 5, 6 ORDER BY tool, n DESC, src, tgt, cls, perms, ioctl_cmd LIMIT 20""")
def o93_snapshot(spark, sf_dir):
    """The debugging domain stands for records that tools of the watcher made themselves."""
    key = [F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls", words("perms").alias("perms"), F.coalesce("ioctl_cmd", F.lit("~")).alias("ioctl_cmd")]
    n = sample.syn_a(spark, sf_dir).groupBy(*key, (F.coalesce("src", F.lit("")) == "debug_hap").alias("tool")).agg(F.count("*").alias("n"))
    return n.orderBy("tool", F.desc("n"), "src", "tgt", "cls", "perms", "ioctl_cmd").limit(20)


@query("""WITH p AS (SELECT CASE event_id % 5 WHEN 0 THEN 'allow a_' || user_id || ' b:c read;' WHEN 1 THEN 'grant ' || event_type WHEN 2 THEN 'allow a b_' || user_id || ':c { read write };' WHEN 3 THEN 'allowxperm a b:c ioctl { 0x' || user_id || ' };' ELSE 'allow a b { read };' END AS patch, event_id % 5 AS k FROM events)
    SELECT patch, count(*) AS n FROM p WHERE k NOT IN (2, 3) GROUP BY 1""")
def o60_unparsed(spark, sf_dir):
    k, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    patch = F.when(k == 0, F.concat(F.lit("allow a_"), user, F.lit(" b:c read;"))).when(k == 1, F.concat(F.lit("grant "), "event_type")).when(k == 2, F.concat(F.lit("allow a b_"), user, F.lit(":c { read write };")))
    patch = patch.when(k == 3, F.concat(F.lit("allowxperm a b:c ioctl { 0x"), user, F.lit(" };"))).otherwise("allow a b { read };")
    return mini.unparsed(spark.read.parquet(f"{sf_dir}/events.parquet").select(patch.alias("patch"))).groupBy("patch").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'open read' WHEN 1 THEN event_type WHEN 2 THEN '' ELSE 'p' || user_id END AS perms FROM events""")
def o26_rule_permissions(spark, sf_dir):
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    rule = F.when(k == 0, F.lit("allow a b:c { open read };")).when(k == 1, F.concat(F.lit("allow a b:c "), "event_type", F.lit(";"))).when(k == 2, F.concat(F.lit("allow a b:c "), user)).otherwise(F.concat(F.lit("allow {a b} {c p"), user, F.lit("}:d x;")))
    rule = F.when(k == 3, F.concat(F.lit("allow a b:c { p"), user, F.lit(" p"), user, F.lit(" };"))).otherwise(rule)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", words(evaluate.rule_permissions(rule)).alias("perms"))


@query(ANSWERED + "SELECT count(*) FILTER (src IN (SELECT domain FROM (VALUES ('normal_hap'), ('system_basic_hap'), ('system_core_hap'), ('debug_hap')) d(domain))) AS app_cases, count(*) AS cases FROM fin")
def o78_app_clusters(spark, sf_dir):
    return crosslayer.app_clusters(decided(spark, sf_dir), sehap.entries(sehap.parse_sehap(sehap_lines(spark))))


def _event_stream(spark, sf_dir):
    """SYN-A as a stream of parsed log lines, with the events' own order."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parq*t")
    lines = sample.as_lines(spark.sql(sample.SYN_A.replace("FROM events", "FROM {events}"), events=events).withColumn("perms", F.split("perms", " ")))
    return stream.denials(lines)


@query(f"SELECT coalesce(src, '~') AS src, tgt, cls, count(DISTINCT array_to_string(list_sort(string_split(perms, ' ')), ' ') || coalesce(ioctl_cmd, '~')) AS accesses FROM ({sample.SYN_A}) GROUP BY 1, 2, 3")
def o97_follow_once(spark, sf_dir):
    """The events table as a stream of log lines, each access once, through a JSON lines sink."""
    where = scratch(spark, "follow")
    stream.follow(stream.once(_event_stream(spark, sf_dir)), f"{where}/out", f"{where}/state", interval=None).awaitTermination()
    out = spark.read.text(f"{where}/out").select(F.from_json("value", "src string, tgt string, cls string, fp string").alias("r")).select("r.*")
    return out.groupBy(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls").agg(F.count("*").alias("accesses"))


@query(f"""WITH a AS (SELECT coalesce(src, '~') AS src, tgt, cls, list_sort(string_split(perms, ' ')) AS perms, ioctl_cmd, count(*) AS n, min(seq) AS first_seq FROM ({sample.SYN_A}) GROUP BY ALL)
    SELECT src, tgt, cls, count(*) AS accesses, sum(n - 1)::BIGINT AS suppressed, sum(first_seq)::BIGINT AS first_seqs FROM a GROUP BY 1, 2, 3""")
def o97_suppressed_repeats(spark, sf_dir):
    """The same stream through counting state: each access's first record, and how many repeats were held back."""
    where = scratch(spark, "repeats")
    told = once_counted(_event_stream(spark, sf_dir))
    told.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("fp string, kind string, record string, n bigint").parquet(f"{where}/out")
    first = out.where("kind = 'first'").select("fp", F.from_json("record", "src string, tgt string, cls string, seq bigint").alias("r")).select("fp", "r.*")
    held = out.where("kind = 'repeats'").groupBy("fp").agg(F.sum("n").alias("n"))
    key = F.coalesce("src", F.lit("~")).alias("src")
    return first.join(held, "fp", "left").groupBy(key, "tgt", "cls").agg(F.count("*").alias("accesses"), F.coalesce(F.sum("n"), F.lit(0)).alias("suppressed"), F.sum("seq").alias("first_seqs"))


@query(f"""SELECT coalesce(src, '~') AS src, tgt, cls, count(*) AS n FROM ({sample.SYN_A}) WHERE seq % 2 = 1 GROUP BY 1, 2, 3""")
def o98_from_now(spark, sf_dir):
    """Half of the events lie in the folder when the follower starts, half come later; the first half is dropped."""
    where, lines = scratch(spark, "now"), sample.syn_a_lines(spark, sf_dir)
    lines.where("seq % 2 = 0").select("line").write.text(f"{where}/log/old")
    follow = lambda: stream.follow_new(spark, f"{where}/log", f"{where}/out", f"{where}/state", interval=None)
    follow().awaitTermination()
    lines.where("seq % 2 = 1").select("line").write.text(f"{where}/log/new")
    follow().awaitTermination()
    out = spark.read.schema("value string").text(f"{where}/out").select(F.from_json("value", "src string, tgt string, cls string").alias("r")).select("r.*")
    return out.groupBy(F.coalesce("src", F.lit("~")).alias("src"), "tgt", "cls").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id AS device, event_id AS seq, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END AS sw, event_type || ' ' || (event_id % 7) AS fp FROM events),
    b AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM r),
    s AS (SELECT *, sum(CASE WHEN sw AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq) AS session FROM b)
    SELECT device, session::BIGINT AS session, count(*) AS records, count(DISTINCT fp) AS accesses, count(*) - count(DISTINCT fp) AS repeats FROM s WHERE sw IS NULL AND was GROUP BY 1, 2""")
def o99_sessions(spark, sf_dir):
    """A device for each user; clicks switch its guard on, errors off, the other events are its records."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    what = F.when(F.col("event_type") == "click", "on").when(F.col("event_type") == "error", "off").otherwise("record")
    rows = e.select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), what.alias("what"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 7).cast("string")).alias("fp"))
    return session_report(sessions(rows, segment=256))


@query("""WITH r AS (SELECT user_id AS device, event_id AS seq, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END AS sw FROM events),
    b AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM r),
    s AS (SELECT *, sum(CASE WHEN sw AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq) AS session FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY device, session ORDER BY seq DESC) AS k FROM s WHERE sw IS NULL AND was)
    SELECT device, session::BIGINT AS session, seq FROM k WHERE k <= 3""")
def o99_snapshots(spark, sf_dir):
    """The newest three records of each session."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    what = F.when(F.col("event_type") == "click", "on").when(F.col("event_type") == "error", "off").otherwise("record")
    return newest(sessions(e.select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), what.alias("what"))), 3).select("device", "session", "seq")


@query(f"SELECT count(*) AS lines, count(*) FILTER (seq % 3 = 0) AS backlog, 0::BIGINT AS overruns, 1 AS ends, 0 AS errors FROM ({sample.SYN_A})")
def o100_accounting(spark, sf_dir):
    """A third of the events is a backlog; the listener adds up what the follower's batches tell."""
    where, lines, account = scratch(spark, "account"), sample.syn_a_lines(spark, sf_dir), Accounting(spark)
    lines.where("seq % 3 = 0").select("line").write.text(f"{where}/log/old")
    try:
        query = stream.follow_new(spark, f"{where}/log", f"{where}/out", f"{where}/state", interval="100 milliseconds")
        try:
            query.processAllAvailable()
            lines.where("seq % 3 > 0").select("line").write.text(f"{where}/log/new")
            query.processAllAvailable()
        finally:
            query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # reports come in their own time
        return account.frame().agg(F.sum("lines").alias("lines"), F.sum("backlog").alias("backlog"), F.sum("overruns").alias("overruns"), F.count_if("ended").cast("int").alias("ends"), F.count("error").cast("int").alias("errors"))
    finally:
        account.close()


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _rule_texts(spark, sf_dir):
    """A rule file for every supplier: its lineitem rows as rules with wrapped comments."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rule = F.concat(F.lit("allow supp part:"), F.when(F.col("l_linestatus") == "O", "file").otherwise("dir"), F.lit(" { read };\n"), F.when(F.col("l_linenumber") == 7, "# avc: denied { read } for tclass=file\n").otherwise("# note\n"))
    keyed = F.struct("l_orderkey", "l_linenumber", rule.alias("rule"))
    files = li.groupBy(F.col("l_suppkey").cast("string").alias("file")).agg(F.array_sort(F.collect_list(keyed)).alias("rules"))
    return files.select("file", F.array_join(F.col("rules.rule"), "").alias("text"))


@query("SELECT CASE WHEN l_linestatus = 'O' THEN 'file' ELSE 'dir' END AS cls, count(*) AS n FROM lineitem GROUP BY 1")
def o58_class_histogram(spark, sf_dir):
    return class_histogram(_rule_texts(spark, sf_dir))


@query("SELECT count(*) AS files, count(*) FILTER (has) AS files_with_denials FROM (SELECT l_suppkey, bool_or(l_linenumber = 7) AS has FROM lineitem GROUP BY 1)")
def o58_file_counts(spark, sf_dir):
    return file_counts(_rule_texts(spark, sf_dir))


@query(ANSWERED + "SELECT patch, src, tgt, cls, n FROM fin WHERE category = 'auto_repairable' AND src IN ('normal_hap', 'system_basic_hap', 'system_core_hap', 'debug_hap')")
def o55_shared_patches(spark, sf_dir):
    policy = sample.sample_policy(spark)
    v = crosslayer.cross_layer(decided(spark, sf_dir, policy), policy, sehap.entries(sehap.parse_sehap(sehap_lines(spark))))
    return crosslayer.shared_patches(v).select("patch", "src", "tgt", "cls", "n")
