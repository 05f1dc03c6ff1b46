"""Which rules answer an access request, and what they say: joins on (kind, class, token, token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_placeholder
from ..sources.policy import Policy
from .closure import settle
from .profiles import NONE, few, kept, profiles, small


def _tokens(requests: DataFrame, side: str, closure: DataFrame) -> DataFrame:
    """(ident, tokens) of the distinct names on one side: the name and its ancestors."""
    names = requests.select(F.col(side).alias("ident")).where("ident is not null").distinct()
    up = names.join(closure.withColumnRenamed("name", "ident"), "ident", "left").groupBy("ident").agg(F.collect_set("token").alias("up"))
    return up.select("ident", F.array_distinct(F.concat(F.array("ident"), "up")).alias(f"{side}_tokens"))


def with_tokens(requests: DataFrame, closure: DataFrame) -> DataFrame:
    """Adds src_tokens and tgt_tokens; empty for a null name, which only stars match."""
    for side in ("src", "tgt"):
        found = _tokens(requests, side, closure)
        requests = requests.join(found, requests[side] == found["ident"], "left").drop("ident")
        requests = requests.withColumn(f"{side}_tokens", F.coalesce(f"{side}_tokens", F.array().cast("array<string>")))
    return requests


STAR, SIDES = "*", ("src", "tgt")


def token_key(cls: Column, src: Column, tgt: Column) -> Column:
    """What a rule's class, subject token and target token are joined by; who meets by it compares the tokens."""
    return F.xxhash64(cls, src, F.lit("\n"), tgt)


def token_keys(cls: Column, src: Column, tgt: Column) -> Column:
    """The keys of all pairs of two lists of tokens."""
    return F.flatten(F.transform(src, lambda s: F.transform(tgt, lambda t: token_key(cls, s, t))))


def attach(rows: DataFrame, rules: DataFrame, closure: DataFrame, single: bool = False) -> DataFrame:
    """Adds to rows (src, tgt, cls, ...) the list ``hits`` of the rules that answer each: ``hit`` of
    rules (cls, r_src, r_tgt, r_src_neg, r_tgt_neg, hit), whose tokens are lists, ['*'] for all names.

    Exclusions beat names and stars and apply to ancestors too. A rule of one name on each side that
    is no ancestor of others (most rules are) answers only rows of just these names, so rows meet it
    by (src, tgt, cls). All other rules see of a name no more than which of their tokens it has: names
    alike in that share a profile, and each distinct (cls, profile, profile) is decided once, by a key
    for each pair of its tokens. So no row is multiplied, and none moves but for its target's profile
    and for the rules of its names. ``single``: no two rules have the same class and tokens.
    """
    one = lambda side: F.get(f"r_{side}", F.lit(0))
    groups = small(closure.select(F.col("token").alias("group")).distinct())
    named = lambda side: (F.size(f"r_{side}") == 1) & (F.size(f"r_{side}_neg") == 0) & (one(side) != STAR)
    plain = named("src") & named("tgt")
    some = rules.where(plain)
    of = lambda side, how: (lambda df: df.join(groups, one(side) == F.col("group"), how))
    broad, rows_of, tokens_of = measured(rules.where(~plain).unionByName(of("src", "left_semi")(some)).unionByName(of("tgt", "left_semi")(of("src", "left_anti")(some))))
    exact = of("tgt", "left_anti")(of("src", "left_anti")(some)).select(one("src").alias("_src"), one("tgt").alias("_tgt"), F.col("cls").alias("_cls"), "hit")
    # stars of a class count only where a rule of the class has them. Classes are few and their rows many: a
    # shuffle by class would put all rows of a class into one task, so the classes are broadcast
    has = lambda side, name: F.bool_or(F.array_contains(f"r_{side}", STAR)).alias(name)
    stars = broad.groupBy("cls").agg(has("src", "src_any"), has("tgt", "tgt_any"))
    asked, lists = rows.join(F.broadcast(stars), "cls", "left"), {}
    for side in SIDES:
        used = broad.select(F.explode(F.concat(f"r_{side}", f"r_{side}_neg")).alias("token")).distinct()
        names, found = profiles(closure, few(used, tokens_of[side]))
        lists[side] = found.withColumnsRenamed({"profile": f"{side}_profile", "tokens": f"{side}_tokens"})
        asked = asked.join(names, F.col(side) == F.col("ident"), "left").withColumn(f"{side}_profile", F.coalesce("profile", F.lit(NONE))).drop("ident", "profile")
    asked = settle(asked)
    pair = ["cls", "src_profile", "tgt_profile"]
    pairs = asked.where("src_any is not null").select(*pair, "src_any", "tgt_any").distinct()
    told = pair_hits(pairs, few(broad, rows_of), lists)
    return with_hits(asked.drop("src_any", "tgt_any"), exact, told, single).select(*rows.columns, "hits")


def measured(rules: DataFrame) -> tuple[DataFrame, int, dict[str, int]]:
    """The rules, computed once, how many they are and how many tokens each side has."""
    rules = kept(rules)
    size = lambda side: F.coalesce(F.sum(F.size(f"r_{side}") + F.size(f"r_{side}_neg")), F.lit(0)).alias(side)
    found = rules.agg(F.count("*").alias("n"), *map(size, SIDES)).first()
    return rules, found["n"], {side: found[side] for side in SIDES}


def pair_hits(pairs: DataFrame, rules: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(cls, src_profile, tgt_profile, hit) of the rules that answer each pair of profiles."""
    tokens = lambda side: F.coalesce(f"{side}_tokens", F.array().cast("array<string>"))
    wide = lambda side: F.when(F.col(f"{side}_any"), F.concat(tokens(side), F.array(F.lit(STAR)))).otherwise(tokens(side))
    listed = lambda df: df.join(lists["src"], "src_profile", "left").join(lists["tgt"], "tgt_profile", "left")
    keys = listed(pairs).select(*pairs.columns, F.explode(token_keys(F.col("cls"), wide("src"), wide("tgt"))).alias("key"))
    met = keys.join(rules.withColumn("key", F.explode(F.array_distinct(token_keys(F.col("cls"), F.col("r_src"), F.col("r_tgt"))))).withColumnRenamed("cls", "r_cls"), "key")
    # a rule that names several tokens of a name counts by the first of them only
    first = lambda side: F.get(F.array_intersect(f"r_{side}", wide(side)), F.lit(0))
    barred = lambda side: F.coalesce(F.arrays_overlap(f"r_{side}_neg", tokens(side)), F.lit(False))
    right = (F.col("r_cls") == F.col("cls")) & (F.col("key") == token_key(F.col("cls"), first("src"), first("tgt"))) & ~barred("src") & ~barred("tgt")
    told = kept(listed(met).where(right).select("cls", "src_profile", "tgt_profile", "hit"))
    return few(told, 5 * told.count())  # rules are wider than names


def with_hits(asked: DataFrame, exact: DataFrame, told: DataFrame, single: bool) -> DataFrame:
    """Adds hits, the rules of a row's own names and those of its profiles."""
    key, pair = ["_src", "_tgt", "_cls"], ["_cls", "_src_profile", "_tgt_profile"]
    if single:
        own = exact.withColumn("_own", F.array("hit")).drop("hit")
    else:  # rules move as they are, not as lists; by windows, since the join needs the same order
        by = Window.partitionBy(*key).orderBy(key[0])
        every = F.collect_list("hit").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        own = exact.select(*key, every.alias("_own"), F.row_number().over(by).alias("_n")).where("_n = 1").drop("_n")
    out = asked.join(own, (F.col("src") == F.col("_src")) & (F.col("tgt") == F.col("_tgt")) & (F.col("cls") == F.col("_cls")), "left").drop(*key)
    shared = told.groupBy("cls", "src_profile", "tgt_profile").agg(F.collect_list("hit").alias("_shared")).withColumnsRenamed({c: f"_{c}" for c in ("cls", "src_profile", "tgt_profile")})
    same = (F.col("cls") == F.col("_cls")) & (F.col("src_profile") == F.col("_src_profile")) & (F.col("tgt_profile") == F.col("_tgt_profile"))
    out = out.join(shared, same, "left").drop(*pair)
    none = F.array().cast(told.select(F.array("hit").alias("x")).schema["x"].dataType)
    return out.withColumn("hits", F.concat(F.coalesce("_own", none), F.coalesce("_shared", none))).drop("_own", "_shared", "src_profile", "tgt_profile")


#: What is told of a rule that answers a request.
SHOWN = ["rule_id", "kind", "perms", "xperm_perm", "xperms", "raw"]


def _with_rules_hit(requests: DataFrame, policy: Policy, closure: DataFrame, *shown: Column | str) -> DataFrame:
    """Adds to requests (src, tgt, cls, ...) the rules that answer each, as a list ``hits``."""
    own = lambda side: F.when(F.col(f"{side}_star"), F.array(F.lit(STAR))).otherwise(F.col(side))
    none = F.array().cast("array<string>")
    barred = [F.coalesce(f"{side}_neg", none).alias(f"r_{side}_neg") for side in SIDES]
    rules = policy.rules.select("cls", own("src").alias("r_src"), own("tgt").alias("r_tgt"), *barred, F.struct(*shown).alias("hit"))
    return attach(requests, rules, closure)


def rule_hits(requests: DataFrame, policy: Policy, closure: DataFrame) -> DataFrame:
    """Every (request, rule) whose class and both subjects match (``attach``). ``requests`` has req,
    src, tgt, cls."""
    return _with_rules_hit(requests.select("req", "src", "tgt", "cls"), policy, closure, *SHOWN).select("req", F.explode("hits").alias("hit")).select("req", "hit.*")


def declared(policy: Policy) -> DataFrame:
    """(name): types and attributes that the policy declares."""
    return policy.types.union(policy.attributes).distinct()


def resolve_targets(requests: DataFrame, policy: Policy) -> DataFrame:
    """Adds query_tgt: the concrete type behind a service-manager placeholder where the record
    names a service whose type is declared, and the target itself otherwise."""
    numeric = F.col("service").rlike(r"^\d+$")
    named = F.concat(F.when(F.col("cls") == "hdf_devmgr_class", "hdf_").otherwise("sa_"), "service")
    own = F.when((F.col("cls") == "samgr_class") & (F.col("src") != "") & (F.size("perms") > 0) & F.forall("perms", lambda p: p == "add"), F.concat(F.lit("sa_"), "src"))
    may = is_placeholder(F.col("tgt")) & (F.col("service") != "") & F.col("cls").isin("samgr_class", "hdf_devmgr_class")
    tried = requests.withColumn("_named", F.when(may, F.when(numeric, own).otherwise(named)))
    names = declared(policy).select(F.col("name").alias("_known"))
    out = tried.join(names, tried["_named"] == names["_known"], "left")
    return out.withColumn("query_tgt", F.coalesce("_known", "tgt")).drop("_named", "_known")


def answers(requests: DataFrame, policy: Policy, closure: DataFrame) -> DataFrame:
    """Adds to requests (src, tgt, cls, perms, ioctl_cmd, ...) what the rules say:

    granted, allowed (every requested permission is), neverallow (text of the first rule that
    granting them would violate), ioctl_allowed and ioctl_reason for requests with a command.
    An empty permission set of a rule is a wildcard; an empty request is allowed.
    """
    # most rules allow; their places and texts are not asked for
    stops = lambda c: F.when(F.col("kind") == "neverallow", F.col(c)).alias(c)
    return judged(_with_rules_hit(requests, policy, closure, stops("rule_id"), "kind", "perms", "xperm_perm", "xperms", stops("raw")))


def hits_without(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits of pairs (req, access, without): those of the access, but of rules with the text
    ``without``. So many policies that each lack a rule are asked without making one of them."""
    own = hits.withColumnRenamed("req", "access")
    return pairs.select("req", "access", "without").join(own, "access").where(~F.col("raw").eqNullSafe(F.col("without"))).drop("access", "without")


def answers_from(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """The same from the rules that each request (req, ...) hits (``rule_hits``)."""
    told = hits.groupBy("req").agg(F.collect_list(F.struct(*SHOWN)).alias("hits"))
    return judged(requests.join(told, "req", "left"))


def judged(requests: DataFrame) -> DataFrame:
    """Requests with their ``hits`` (null: none) to what these rules say."""
    r = requests.withColumn("perms", F.array_distinct("perms"))
    is_ = lambda h, *k: h["kind"].isin(*k)
    some = lambda test: F.coalesce(F.exists("hits", test), F.lit(False))
    ioctl = lambda h: h["xperm_perm"] == "ioctl"
    listed = lambda h: F.array_contains(h["xperms"], F.col("ioctl_cmd"))
    stops = F.filter("hits", lambda h: is_(h, "neverallow") & ((F.size(h["perms"]) == 0) | F.arrays_overlap(h["perms"], F.col("perms"))))
    given = F.flatten(F.transform(F.filter("hits", lambda h: is_(h, "allow")), lambda h: h["perms"]))
    wild = some(lambda h: is_(h, "allow") & (F.size(h["perms"]) == 0))
    granted = F.when(wild, F.col("perms")).otherwise(F.array_intersect("perms", F.coalesce(given, F.array().cast("array<string>"))))
    out = r.withColumns({"granted": granted, "_stops": stops}).withColumn("allowed", F.size(F.array_except("perms", "granted")) == 0)
    has = F.col("ioctl_cmd").isNotNull() & (F.col("ioctl_cmd") != "") & F.array_contains("perms", "ioctl")
    white = some(lambda h: is_(h, "allowxperm") & ioctl(h) & (F.size(h["xperms"]) > 0))
    in_white = some(lambda h: is_(h, "allowxperm") & ioctl(h) & listed(h))
    in_black = some(lambda h: is_(h, "neverallowxperm") & ioctl(h) & listed(h))
    plain = some(lambda h: is_(h, "allow") & F.array_contains(h["perms"], "ioctl"))
    reason = F.when(in_black, "neverallowxperm").when(white, "allowxperm").when(plain, "allow(ioctl)").otherwise("no_allow")
    ok = F.when(in_black, False).when(white, in_white).otherwise(plain)
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("bigint")
    first = F.array_min(F.transform("_stops", lambda h: F.struct(h["rule_id"].alias("rule_id"), h["raw"].alias("raw"))))
    return out.withColumn("ioctl_reason", F.when(has, reason)).withColumn("ioctl_allowed", F.when(has, ok)).withColumn("neverallow", first["raw"]).withColumn(
        "n_neverallow", count(F.col("_stops"))).withColumn("n_rules", count(F.filter("hits", lambda h: is_(h, "allow")))).drop("hits", "_stops")


def with_rules(policy: Policy, more: DataFrame) -> Policy:
    """The policy with rules appended at its end (their own rule_id is replaced)."""
    last = F.struct(F.array(F.lit("\U0010ffff")).alias("path"), F.lit(0).alias("line"), F.monotonically_increasing_id().alias("sub"))
    return Policy(policy.rules.union(more.withColumn("rule_id", last).select(policy.rules.columns)), policy.edges, policy.types, policy.attributes, policy.skipped)


def covering_rule(hits: DataFrame, requests: DataFrame, rank: Column) -> DataFrame:
    """(req, rule_id, raw, perms) of the first allow rule, by ``rank``, that answers each request."""
    best = hits.where("kind = 'allow'").groupBy("req").agg(F.min_by(F.struct("rule_id", "raw", "perms"), rank).alias("best"))
    return requests.select("req").join(best, "req").select("req", "best.*")
