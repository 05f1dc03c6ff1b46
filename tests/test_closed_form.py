"""Patches by their closed form against querying the policy that they make."""

from pyspark.sql import functions as F

from denialkit.operators.minimize import closed_loop, collapse
from denialkit.plans import sample
from denialkit.plans.access import answers, with_rules
from denialkit.plans.verdict import AUTO, converge, patch_lines
from denialkit.sources.policy import parse_rules

SMALL = "/root/testdata/sf0.001"


def test_successful_patches_close_their_gap(spark):
    """Each patch that verification calls a success grants what was missing, in the patched policy.
    A placeholder that stands for a known service is answered for the service, its patch names the
    placeholder as logged, and a guard stops it: such cases are left out."""
    policy = sample.sample_policy(spark)
    d = converge(sample.syn_a(spark, SMALL), policy).where("patch <> '' and verify_status = 'SUCCESS' and tgt = query_tgt")
    patched = with_rules(policy, parse_rules(d.select(F.col("patch").alias("statement")).distinct()))
    again = answers(d.select(F.col("fp").alias("req"), "src", "tgt", "cls", "perms", "ioctl_cmd"), patched, policy.closure())
    rows = again.join(d.select(F.col("fp").alias("req"), "classification"), "req").select("classification", "allowed", "ioctl_allowed").collect()
    assert len(rows) > 10
    assert [r for r in rows if not (r.ioctl_allowed if r.classification == "XPERM_GAP" else r.allowed)] == []


def test_rules_from_several_partitions_are_appended(spark):
    """Places of appended rules are 64 bits wide: partition numbers stand in their upper half."""
    policy = sample.sample_policy(spark)
    more = parse_rules(spark.createDataFrame([(f"allow a b{i}:c read;",) for i in range(30)], "statement string").repartition(7))
    ids = [r.rule_id.sub for r in with_rules(policy, more).rules.where("cls = 'c'").select("rule_id").collect()]
    assert len(set(ids)) == 30 and max(ids) > 2**31
    d = converge(sample.syn_a(spark, SMALL), policy).where(F.col("category") == AUTO)
    loop = closed_loop(d, collapse(patch_lines(d)).repartition(5), policy)
    assert loop.where("not after").count() == 0  # the smallest tables hold no forbidden command


def test_a_forbidden_command_stays_forbidden(spark):
    """Its patch is called a success, as it must be, but the loop tells what is left."""
    policy = sample.sample_policy(spark)
    d = converge(sample.syn_a(spark, "/root/testdata/sf0.01"), policy).where(F.col("category") == AUTO)
    open_ = closed_loop(d, collapse(patch_lines(d)), policy).where("not after").join(d, "fp").collect()
    assert [(r.src, r.tgt, r.cls, r.perms, r.ioctl_cmd, r.residual_missing, r.residual_command) for r in open_] == [("debug_hap", "dev_camera_file", "chr_file", ["ioctl"], "0x6412", [], "0x6412")]
