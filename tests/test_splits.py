"""Logs and rule files that Spark splits anywhere, against the same texts read whole."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from denialkit.sources.denials import assemble, assemble_lines, read_log_lines
from denialkit.sources.policy import parse_policy, read_policy, statements

LOG = [
    "noise before\n", "# a comment\n", "avc: denied { read } for pid=1 scontext=u:r:a:s0 \\\n tcontext=u:object_r:b:s0 tclass=file\n", "x AVC :  denied { w } for\n\n  more of it\n",
    "# avc: denied { c } for tclass=dir\n", "line ends in avc\n", " \n : denied { far } for tclass=z\n", "avc \\\n:\\\n denied { joined }\n", "plain\r\n", "tail \\\n", "é\u2028avc: denied { u } # no comment\n", "avc:\n\n denied { two }\n"]
RULES = [
    "type a, b;\n", "debug_only(`\n", "')\n", "'`allow a b:c d;\n", "allow a b:c { d\n", "   e };  # wrapped\n", "allow a b:c\n", "\n", "macro(a)\n", "neverallow { a\n -b } c:d e;\n",
    "'\n", ")\n", "test_only ( `\n", "attribute x;\n", "# note\n", "allow a b:c d; # end;\n", "x\x0ballow q r:s t;\n", "type z;\r\n", "binder_call(a, b)\n"]


def cut(spark, path, text, size):
    path.write_text(text, newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return before


def restore(spark, before):
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [11, 37, 64, 150, 10**6])
def test_records_at_any_cut(spark, tmp_path, size):
    rng = random.Random(size)
    text = "".join(rng.choices(LOG, k=60 if size < 100 else 200))
    before = cut(spark, tmp_path / "log.txt", text, size)
    try:
        lines = read_log_lines(spark, f"file://{tmp_path}/log.txt")
        if size < 1000:
            assert lines.select("block").distinct().count() > 5
        found = assemble_lines(lines).orderBy("event").collect()
    finally:
        restore(spark, before)
    want = assemble(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("event").collect()
    assert [r.block for r in found] == [r.block for r in want] and len(want) > 10


def test_small_batches_make_no_difference(spark, tmp_path):
    text = "".join(random.Random(1).choices(LOG, k=300))
    (tmp_path / "log.txt").write_text(text, newline="")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = assemble_lines(read_log_lines(spark, f"file://{tmp_path}/log.txt")).orderBy("event").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = assemble(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("event").collect()
    assert [r.block for r in found] == [r.block for r in want]


def test_files_without_marks_or_lines(spark, tmp_path):
    for name, text in (("a.txt", ""), ("b.txt", "\n\n"), ("c.txt", "nothing\\"), ("d.txt", "avc: denied { x }")):
        (tmp_path / name).write_text(text)
    rows = assemble_lines(read_log_lines(spark, f"file://{tmp_path}/*.txt")).collect()
    assert [(r.file[-5:], r.block) for r in rows] == [("d.txt", "avc: denied { x }")]


@pytest.mark.parametrize("size", [7, 25, 60, 200, 10**6])
def test_statements_at_any_cut(spark, tmp_path, size):
    rng = random.Random(size + 1)
    text = "".join(rng.choices(RULES, k=60 if size < 50 else 250)) + "allow a\n" + "x\n" * 70 + "y;\n" + "allow lost b:c {"
    before = cut(spark, tmp_path / "p.te", text, size)
    try:
        found = statements(read_policy(spark, f"file://{tmp_path}/p.te")).select("line", "statement").collect()
    finally:
        restore(spark, before)
    want = statements(spark.createDataFrame([("p.te", text)], "file string, text string")).select("line", "statement").collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, want)) and len(want) > 20


def slow(text):
    """Statements line by line."""
    import re

    out, inside, held, since = [], False, None, 0
    for n, line in enumerate(text.splitlines(), 1):
        s = line.strip()
        opens = re.fullmatch(r"(debug_only|developer_only|updater_only|vendor_only|chipset_only|hdf_only|test_only)\s*\(\s*`?", s)
        if (opens and not inside) or (inside and s in ("')", "'", ")")):
            inside = not inside
            continue
        s = (re.sub("^'?`?", "", s) if inside else s).split("#")[0].strip()
        if held is not None:
            held = f"{held} {s}".strip()
            if s.endswith(";"):
                out.append((since, held))
                held = None
            elif n - since >= 64:
                out.append((since, None))
                held = None
        elif re.match(r"(allow|neverallow|allowxperm|neverallowxperm)\b", s) and not s.endswith(";"):
            held, since = s, n
        elif s:
            out.append((n, s))
    return out + ([(since, None)] if held is not None else [])


def test_statements_by_their_definition(spark):
    texts = ["".join(random.Random(k).choices(RULES, k=120)) + "allow q\n" * (k % 3) + "z\n" * 66 for k in range(6)] + ["", "\n", "allow a b:c d"]
    rows = statements(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string").repartition(2)).collect()
    for i, t in enumerate(texts):
        assert sorted((r.line, r.statement or "") for r in rows if r.file == str(i)) == sorted((n, s or "") for n, s in slow(t))


def test_equal_file_names_stay_apart(spark):
    texts = spark.createDataFrame([("p", "allow a b:c { d"), ("p", "e };\nallow q r:s t;")], "file string, text string").coalesce(1)
    assert sorted((r.statement or "") for r in statements(texts).collect()) == ["", "allow q r:s t;", "e };"]


def test_a_policy_read_by_split_is_the_policy(spark, tmp_path):
    from denialkit.plans import sample

    before = cut(spark, tmp_path / "sample.te", sample.POLICY_TEXT, 100)
    try:
        p = parse_policy(read_policy(spark, f"file://{tmp_path}"))
        got = [r.raw for r in p.rules.orderBy("rule_id").collect()]
        bad = p.skipped.agg(F.count("*")).first()[0]
    finally:
        restore(spark, before)
    want = sample.sample_policy(spark)
    assert got == [r.raw for r in want.rules.orderBy("rule_id").collect()] and bad == want.skipped.count()
