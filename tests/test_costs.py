"""Steps that every row goes through: what a plan computes more often than it has to, and on how few cores."""

import pytest
from pyspark.sql import functions as F

from denialkit.functions.text import BLANKS, strip, with_assignments
from denialkit.plans import access, board, sample
from denialkit.sources.cil import parse_cil
from denialkit.sources.denials import parse_events
from denialkit.sources.policy import parse_policy, parse_rules
from denialkit.sources.splits import line_states, read_lines, records, text_lines

SF = "/root/testdata/sf0.001"


def times(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_a_statement_is_cut_into_tokens_once(spark):
    rules = parse_rules(spark.createDataFrame([("allow a b:c d;",), ("allow { a -b } *:c { d };",), ("x y",), (None,)], "statement string"))
    assert times(rules, "regexp_extract_all(") <= 5  # the mentions within one expression, which share it
    assert sorted((r.src, r.src_neg, r.src_star, r.tgt, r.tgt_star) for r in rules.collect()) == [(["a"], [], False, ["b"], False), (["a"], ["b"], False, [], True)]


def test_fields_are_looked_up_without_a_lambda_each(spark):
    events = parse_events(spark.createDataFrame([("avc: denied { read } for pid=1 scontext=u:r:a:s0",)], "block string"))
    assert times(events, "filter(") <= 6


def test_denials_are_parsed_on_all_cores(spark):
    assert sample.syn_a(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_words_that_do_not_begin_with_a_key(spark):
    text = 'a = 1 xpid=2 name==v path="a b" comm= "c, d" pid=comm=3 gid=\u2003uid=7 =x sid="'
    rows = with_assignments(spark.createDataFrame([(text,)], "t string"), "t", "found").collect()
    assert [tuple(p) for p in rows[0].found] == [("pid", "2"), ("name", "=v"), ("path", '"a b"'), ("comm", '"c, d"'), ("pid", "comm=3"), ("gid", "uid=7=x"), ("sid", '"')]


def test_blanks_are_those_of_the_pattern(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    told = every.where((strip(F.col("c")) == "") != F.col("c").rlike(r"(?U)^[\s\x1c-\x1f]\z")).collect()
    assert told == [] and all(c.isspace() for c in BLANKS)


@pytest.mark.parametrize("size", ["1m", "40b"])
def test_states_of_splits_with_other_line_breaks(spark, tmp_path, size):
    (tmp_path / "a.te").write_bytes("allow a b:c d;\rdebug_only(`\x0b\n allow e\n\n f:g h;\x85')\r\nallow i j:k l;\r\n".encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = read_lines(spark, f"{tmp_path}/a.te")
        rules = parse_policy(lines).rules.select("rule_id.line", "raw").collect()
        states = line_states(lines, r"(debug_only)\s*\(\s*`?", ("')",))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, rules)) == [(1, "allow a b:c d;"), (3, "allow e f:g h;"), (7, "allow i j:k l;")]
    assert min(r.lines for r in states) == 0 and not min(states, key=lambda r: r.block).inside


def test_files_without_a_mark_are_not_put_together(spark):
    """Only pieces of files that hold a mark's first word somewhere go to Python by file; a mark may reach over pieces."""
    texts = spark.createDataFrame([("a", "x\ny"), ("b", "AVC:"), ("b", " denied { read }\nz"), ("c", "avc: denied 1\navc: denied 2")], "file string, text string").coalesce(1)
    found = records(text_lines(texts))
    assert "_some" in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r.file, r.text.strip()) for r in found.collect()) == [("b", "AVC:\n denied { read }\nz"), ("c", "avc: denied 1"), ("c", "avc: denied 2")]


def test_requests_do_not_shuffle_by_class(spark, monkeypatch):
    """A class holds a large share of all requests: what a class's rules have comes to them by broadcast, however small tables must be for that."""
    plans = []
    monkeypatch.setattr(access, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    policy = sample.syn_b_policy(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        access.rule_hits(sample.syn_b_requests(spark, SF), policy, policy.edges.selectExpr("child as name", "parent as token"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and all("BroadcastHashJoin [cls" in p for p in plans)


def test_a_board_line_is_cut_into_tokens_once(spark):
    b = parse_cil(spark.createDataFrame([("(allow a b (c (e d)))",), ("( (allow a x (c (d))))",), ("(allow a b (c (e)))",), (None,), ("(typeattributeset q (a b))",)], "line string"))
    assert times(b.allows, "regexp_extract_all(") == 1 and times(b.edges, "regexp_extract_all(") == 1
    assert [(r.src, r.tgt, r.cls, r.perms) for r in b.allows.collect()] == [("a", "b", "c", ["d", "e"])]
    assert sorted(map(tuple, b.edges.collect())) == [("a", "q"), ("b", "q")]


def test_board_answers_from_several_keys(spark):
    """What is granted is the union over keys, what is satisfied is so by one key; requests meet keys by number."""
    lines = ["(typeattributeset q (a))", "(allow a b (c (read)))", "(allow q b (c (write open)))"]
    rows = [("1", "a", "b", "c", ["write", "read"]), ("2", "a", "b", "c", ["open", "write"]), ("3", "z", "b", "c", ["read"]), ("4", None, "b", "c", []), ("5", "a", "b", "c", None)]
    asked = spark.createDataFrame(rows, "req string, src string, tgt string, cls string, perms array<string>")
    told = board.board_answers(asked, parse_cil(spark.createDataFrame([(x,) for x in lines], "line string")))
    assert told.columns == ["req", "src", "tgt", "cls", "perms", "board_granted", "satisfied"]
    every = ["open", "read", "write"]
    assert [(r.req, r.board_granted, bool(r.satisfied)) for r in told.orderBy("req").collect()] == [("1", every, False), ("2", every, True), ("3", [], False), ("4", [], True), ("5", every, False)]
