"""Log, policy and index texts with the awkward cases of each format."""

from denialkit.plans import sample
from denialkit.sources import exchange
from denialkit.sources.denials import assemble, parse_events, suppressed
from denialkit.sources.policy import parse_policy
from pyspark.sql import functions as F


def events(spark, text):
    return parse_events(assemble(spark.createDataFrame([("f", text)], "file string, text string"))).orderBy("event").collect()


def test_assembly(spark):
    text = ("# a comment\n[1] avc:  denied  { read open } for pid=1 \\\n comm=\"a b\" scontext=u:r:x:s0 tcontext=u:object_r:y:s0 tclass=file permissive=1\n# dropped\n"
            "# avc: denied { } for scontext=u:r tclass=dir\nAVC : DENIED { ioctl } for xpid=5 ioctlcmd=0x1 comm=\"c pid=9\" permissive=2\n")
    got = events(spark, text)
    assert [r.perms for r in got] == [["read", "open"], [], ["ioctl"]]
    assert [(r.src, r.tgt, r.cls) for r in got] == [("x", "y", "file"), ("", None, "dir"), (None, None, None)]
    assert [(r.pid, r.comm, r.permissive) for r in got] == [(1, "a b", True), (None, None, None), (5, "c pid=9", None)]


def test_no_events(spark):
    assert events(spark, "nothing here\n# nor here\n") == [] and events(spark, "") == []


def test_first_key_wins_and_two_markers_are_one_record(spark):
    got = events(spark, "avc: denied { a } for tclass=x avc: denied { b } for tclass=y\n")
    assert [(r.perms, r.cls) for r in got] == [(["a"], "x")]


def test_suppressed(spark):
    text = F.lit("kauditd_printk_skb: 7 callbacks suppressed\nxkauditd_printk_skb: 9 callbacks suppressed\nkauditd_printk_skb: 99999999999999999999 callbacks suppressed")
    assert spark.range(1).select(suppressed(text)).first()[0] == 7 + 2**31


def test_policy_statements(spark):
    text = "type a, b;\ntypeattribute a c, d;\nallow a self:file { };\nallow { a -b } *:dir ~{ read };\nallow a b:c\n d;\nallow x-y z:c d;\nbinder_call(a, b)\nallow a b:c { e"
    p = parse_policy(spark.createDataFrame([("p.te", text)], "file string, text string"))
    assert {(r.child, r.parent) for r in p.edges.collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    rules = [(r.kind, r.src, r.src_neg, r.tgt, r.cls, r.perms) for r in p.rules.orderBy("rule_id").collect()]
    assert ("allow", ["a"], [], ["self"], "file", []) in rules and ("allow", ["a"], [], ["b"], "c", ["d"]) in rules
    assert len([r for r in rules if r[4] in ("binder", "fd")]) == 3
    assert p.skipped.count() >= 2


def test_index_is_read_back_as_written(spark, tmp_path):
    lines = exchange.export_lines(sample.sample_policy(spark), "x", "now")
    exchange.write_index(lines, f"{tmp_path}/index")
    again = exchange.read_index(spark, f"{tmp_path}/index/*.txt").where("line <> ''")
    assert exchange.drift(exchange.in_order(lines), again).count() == 0
    assert exchange.self_check(again).count() == 0
    assert exchange.self_check(again.withColumn("line", F.replace("line", F.lit("@rev 2"), F.lit("@rev 9")))).count() == 1


def test_assignments(spark):
    """Quotes, escapes, white space around signs, signs inside values, and words that only end like a key."""
    from denialkit.functions.text import with_assignments

    texts = {
        'pid=1 comm="a b" tclass=file': [("pid", "1"), ("comm", '"a b"'), ("tclass", "file")],
        'comm = "x pid=9",name=\t y': [("comm", '"x pid=9"'), ("name", "y")],
        "path=/a=b/pid=3 dev= next=1": [("path", "/a=b/pid=3"), ("dev", "next=1")],
        'xpid=5 foo=gid=7 other=2 ino=': [("pid", "5"), ("gid", "7")],
        r'name="a\"b" comm="c\\" sid=1': [("name", r'"a\"b"'), ("comm", r'"c\\"'), ("sid", "1")],
        'comm="" uid=2 path="open pid=4': [("comm", '""'), ("uid", "2"), ("path", '"open'), ("pid", "4")],
        'comm="a"pid=3': [("comm", '"a"'), ("pid", "3")],
        "": [], "=": [], "pid": [], "pid=,": [], 'pid="': [("pid", '"')],
    }
    rows = with_assignments(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "found").collect()
    assert {r.t: [tuple(p) for p in r.found] for r in rows} == texts


def test_landing_lines(spark):
    """Lines are read by their tokens."""
    from denialkit.sources.cil import parse_cil
    from denialkit.operators.landing import gates

    board = parse_cil(spark.createDataFrame([(x,) for x in ("(class file (read write ioctl))", "(type a)", "(type b)", "(allow a b (file (read)))", "(allowx a b (ioctl file ((range 0x10 0x20) 0x30)))")], "line string"))
    lines = {"allow a b:file { read };": ("already_satisfied", ["read"]), "  allow  a b:file {  write read } ; ": ("emit", ["read", "write"]), "allow a b : file { write };": ("rejected", None), "allow a b:file read;": ("rejected", None), "allow a b:file { read }": ("rejected", None),
             "allow a c:file { read };": ("rejected", ["read"]), "allow a b:file { fly };": ("rejected", ["fly"]), "allowxperm a b:file ioctl { 0x1 };": ("emit", ["0x1"]), "allowxperm a b:file ioctl { 0x10 0X10 0x1f 0x30 };": ("already_satisfied", ["0X10", "0x10", "0x1f", "0x30"]), "allowxperm a b:file ioctl { 0x10 0x21 };": ("emit", ["0x10", "0x21"]), "neverallow a b:file { read };": ("rejected", None)}
    rows = gates(spark.createDataFrame([(x,) for x in lines], "line string"), board).collect()
    assert {r.line: (r.verdict, r.perms) for r in rows} == lines
