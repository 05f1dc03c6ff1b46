"""Column functions on log text: patterns, white space and JSON-compatible quoting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens a denial, its keys, line breaks.
WS = r"[\s\x1c-\x1f]"
MARKER = rf"(?iU)\bavc{WS}*:{WS}*denied"
KEYS = "pid comm path name dev ino ioctlcmd scontext tcontext tclass permissive parameter service sid uid gid".split()
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
MLS_LEVEL = r"^s[0-9]+(\.c[0-9]+(-c[0-9]+)?)?$"
PLACEHOLDERS = ("default_service", "default_hdf_service")


#: The characters of WS under (?U).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_at(text: Column, pattern: str) -> Column:
    """The pieces between matches; unlike those of ``split``, patterns of ``regexp_replace`` are compiled
    once. A piece holds no blank."""
    return F.split(F.regexp_replace(text, pattern, " "), " ")


def split_words(text: Column) -> Column:
    """Non-empty words between runs of white space."""
    return F.filter(split_at(text, rf"(?U){WS}+"), lambda w: w != "")


def unquote(value: Column) -> Column:
    quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


#: What stands for an escaped backslash and an escaped quote while quotes are looked for; Unicode noncharacters.
HIDDEN = {"\\\\": "\ufdd1", '\\"': "\ufdd2"}


def with_assignments(df: DataFrame, block: str, to: str) -> DataFrame:
    """Adds the (key, value) of a text's assignments to known keys, in order, values as written.

    The text falls into words at white space and commas, where an equals sign takes the white space
    around it away; a quoted text right behind one belongs to its word. A word assigns what follows
    the first equals sign before which a key ends.
    """
    text = F.col(block)
    for sign, stand_in in HIDDEN.items():
        text = F.replace(text, F.lit(sign), F.lit(stand_in))
    # each step is a column, so that lambdas read it instead of computing it again
    tight = F.array_join(F.transform(F.split(text, "="), strip), "=")
    df = df.withColumn("_parts", F.split(tight, '"'))
    n, open_ = F.size("_parts"), F.concat(F.element_at("_parts", -2), F.lit('"'), F.element_at("_parts", -1))
    df = df.withColumn("_parts", F.when(n % 2 == 0, F.concat(F.slice("_parts", F.lit(1), n - 2), F.array(open_))).otherwise(F.col("_parts")))  # a quote that nothing closes is a sign like others
    df = df.withColumn("_loose", F.transform("_parts", lambda x: F.filter(split_at(x, r"(?U)[,\s\x1c-\x1f]+"), lambda w: F.contains(w, F.lit("=")))))
    held = lambda i: (i % 2 == 1) & F.get("_parts", i - 1).endswith("=")
    whole = lambda x, i: F.array(F.concat(F.element_at(F.get("_loose", i - 1), -1), F.lit('"'), F.get("_parts", i), F.lit('"')))
    df = df.withColumn("_words", F.flatten(F.transform("_loose", lambda x, i: F.when(held(i), whole(x, i)).otherwise(x))))
    assigns = f"({'|'.join(KEYS)})=(?s:(.+))"

    def pair(word: Column) -> Column:
        """Most words begin with a key; lambdas compute whatever they name again, so the pattern is for the others."""
        head = F.substring_index(word, "=", 1)
        told = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
        plain = told(head, F.substring(word, F.length(head) + 2, F.length(word)))
        return F.when(head.isin(*KEYS), plain).otherwise(told(F.regexp_extract(word, assigns, 1), F.regexp_extract(word, assigns, 2)))

    def shown(p: Column) -> Column:
        value = p["value"]
        for sign, stand_in in HIDDEN.items():
            value = F.replace(value, F.lit(stand_in), F.lit(sign))
        return F.struct(p["key"].alias("key"), value.alias("value"))

    pairs = F.filter(F.transform("_words", pair), lambda p: (p["key"] != "") & (p["value"] != ""))
    return df.withColumn(to, F.transform(pairs, shown)).drop("_parts", "_loose", "_words")


def denied_permissions(block: Column) -> Column:
    """The words in the first braces that follow ``denied`` at once and are closed again."""
    inside = F.regexp_extract(block, rf"(?iU)\bdenied{WS}*\{{([^}}]*)\}}", 1)
    return F.coalesce(split_words(inside), F.array().cast("array<string>"))


def context_type(context: Column) -> Column:
    """Third part of a security context: null without one, empty if the context is short."""
    return F.when(context != "", F.coalesce(F.get(F.split(context, ":"), F.lit(2)), F.lit("")))


def json_string(value: Column) -> Column:
    """A JSON string literal that keeps non-ASCII text; null as null."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    escaped = reduce(lambda c, i: F.replace(c, F.lit(chr(i)), F.lit(short.get(i, f"\\u{i:04x}"))), range(1, 32), out)
    return F.coalesce(F.concat(F.lit('"'), F.when(out.rlike(r"[\x01-\x1f]"), escaped).otherwise(out), F.lit('"')), F.lit("null"))


def fingerprint(src: Column, tgt: Column, cls: Column, perms: Column, ioctl: Column) -> Column:
    """Twelve hex digits that name a logical access: permission order does not matter, repeated
    permissions do."""
    names = F.array_join(F.transform(F.array_sort(perms), json_string), ", ")
    parts = ['{"cls": ', json_string(cls), ', "ioctl": ', json_string(ioctl), ', "perms": [', names, '], "src": ', json_string(src), ', "tgt": ', json_string(tgt), "}"]
    return F.substring(F.sha1(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary")), 1, 12)


def is_mls_level(token: Column) -> Column:
    return F.coalesce(token.rlike(MLS_LEVEL) & ~token.endswith("\n"), F.lit(False))


def is_placeholder(token: Column) -> Column:
    return F.coalesce(token.isin(*PLACEHOLDERS), F.lit(False))


def is_vacuous(patch: Column) -> Column:
    """Whether a patch's first braces hold no permission."""
    inner = F.regexp_extract(patch, r"\{[^}]*\}", 0)
    return F.coalesce((inner != "") & (F.trim(F.regexp_replace(inner, r"[{}\s]", "")) == ""), F.lit(False))


def apl_rank(apl: Column) -> Column:
    """Privilege ladder of applications; unknown levels rank below all."""
    return F.when(apl == "normal", 0).when(apl == "system_basic", 1).when(apl == "system_core", 2).otherwise(-1)


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / whole, 4))
