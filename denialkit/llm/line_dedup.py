"""Fuzzy line deduplication with DataFrame functions only: SimHash, pigeonhole blocks, edit similarity.

The words of a line are dealt to classes by their hash, and each class has a block of the line's
SimHash of its own. So one edit changes one or two blocks and leaves all others as they are: lines
whose words differ in fewer places than there are classes always share a whole block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, attach
from .linking import bucket_links

#: Classes of long words (LONG characters or more; all shorter words are one more class), the bits
#: of a SimHash block, and the bits of all blocks in which linked lines may differ.
CLASSES, LONG, BITS, DIFFER = 6, 4, 32, 60
#: Long words from which on lines use all classes, up to which they use classes joined by twos, up
#: to which such a block counts together with the short words', and up to which the short words'
#: block counts alone. The ranges overlap: lines a few words apart have a kind of blocks in common.
MANY, FEW, VERY_FEW, HARDLY = 10, 14, 9, 7
#: Characters for each edit that two lines may be apart, by the longer one.
EACH = 10
#: The shortest normalised line that an edit may link (with one of 10 characters), the longest
#: that is compared without its SimHash, the shortest of those that may be two edits from another,
#: and the shortest that has a SimHash. A line below 20 links with none of more than 21.
SHORTEST, SHORT, TWICE, HASHED = 9, 21, 18, 20
#: The most small rows (keys, places) that are broadcast; beyond that the tables shuffle.
SMALL = 1_000_000


def normal(line: Column) -> Column:
    """The lower-cased runs of letters and digits of a line, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def used(lanes: int) -> list[int]:
    """Shifts under which a hash adds to counters, so many to a long: the lower half of each byte."""
    return [i for i in range(64 // lanes) if i % 8 < BITS // 8]


def lane_mask(lanes: int) -> Column:
    return F.lit(sum(1 << (64 // lanes * k) for k in range(lanes)))


def majority(sums: dict[int, Column], terms: Column, lanes: int) -> Column:
    """The bits that more than half of the terms set. All lanes of a long are compared at once: a
    count above half the terms, raised by what half the terms lack, reaches a lane's second bit
    from the top, and no sum reaches the top."""
    width, out = 64 // lanes, F.lit(0).cast("bigint")
    lane = lane_mask(lanes)
    raised = lane * ((1 << (width - 2)) - 1 - F.floor(terms / 2))
    for i, c in sums.items():
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(c + raised, width - 2).bitwiseAND(lane), i))
    return out


def with_simhash(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, blocks, joined, counts, short, n_short) of lines (keys, norm, n_words): the SimHash
    blocks of the classes and of classes joined by twos, the long words in each, the block of the
    short words and their number.

    The words are summed by one codegen aggregation into counters, many to a long; lanes of 8, 16
    or 32 bits by the number of words (the top bit stays free: sums are signed).
    """
    out = None
    for lanes, fits in ((8, "n_words < 128"), (4, "n_words >= 128 and n_words < 32768"), (2, "n_words >= 32768")):
        words = lines.where(fits).select(*keys, F.explode(F.split("norm", " ")).alias("w")).select(*keys, F.xxhash64("w").alias("h"), (F.length("w") >= LONG).alias("long"))
        words = words.withColumn("c", F.when(F.col("long"), F.pmod(F.xxhash64("h"), F.lit(CLASSES))).otherwise(CLASSES))
        add = lambda c, x: F.sum(F.when(F.col("c") == c, x).otherwise(0))  # noqa: E731, B023
        sums = [add(c, F.shiftrightunsigned("h", i).bitwiseAND(lane_mask(lanes))).alias(f"s{c}_{i}") for c in range(CLASSES + 1) for i in used(lanes)]
        # word counts of two or four classes share a long
        wide = 16 if lanes == 8 else 32
        packed = 64 // wide
        one = lambda p: F.coalesce(*[F.when(F.col("c") == p + j, F.lit(1 << wide * j)) for j in range(packed)], F.lit(0))  # noqa: E731, B023
        held = [F.sum(one(p)).alias(f"n{p}") for p in range(0, CLASSES + 1, packed)]
        found = words.groupBy(*keys).agg(*sums, *held)
        count = [F.shiftrightunsigned(f"n{c // packed * packed}", c % packed * wide).bitwiseAND(F.lit((1 << wide) - 1)) for c in range(CLASSES + 1)]
        found = found.select(*keys, *[F.col(f"s{c}_{i}") for c in range(CLASSES + 1) for i in used(lanes)], *[x.alias(f"k{c}") for c, x in enumerate(count)])
        block = lambda *cs: majority({i: sum((F.col(f"s{c}_{i}") for c in cs[1:]), F.col(f"s{cs[0]}_{i}")) for i in used(lanes)}, sum((F.col(f"k{c}") for c in cs[1:]), F.col(f"k{cs[0]}")), lanes)  # noqa: E731, B023
        part = found.select(*keys, *[block(c).alias(f"b{c}") for c in range(CLASSES + 1)], *[block(2 * q, 2 * q + 1).alias(f"j{q}") for q in range(CLASSES // 2)], *[F.col(f"k{c}").cast("int") for c in range(CLASSES + 1)])
        out = part if out is None else out.union(part)
    return out


def block_keys() -> Column:
    """The keys of a line under which lines that may link meet, null where a kind doesn't apply. A
    block counts by itself only if two words or more made it."""
    k = [F.col(f"k{c}") for c in range(CLASSES)]
    f = sum(k[1:], k[0])
    keys = [F.when((f >= MANY) & (k[q] >= 2), F.xxhash64(F.lit(q), f"b{q}")) for q in range(CLASSES)]
    for q in range(CLASSES // 2):
        own = k[2 * q] + k[2 * q + 1]
        keys.append(F.when((f > HARDLY) & (f <= FEW) & (own >= 2), F.xxhash64(F.lit(10 + q), f"j{q}")))
        keys.append(F.when((f <= VERY_FEW) & (own >= 1), F.xxhash64(F.lit(20 + q), f"j{q}", f"b{CLASSES}")))
    keys.append(F.when((f <= HARDLY) & (F.col(f"k{CLASSES}") >= 4), F.xxhash64(F.lit(30), f"b{CLASSES}")))
    return F.array_compact(F.array(*keys))


def shortened(line: Column) -> Column:
    """What is left of a line when any one character is taken out."""
    return F.transform(F.sequence(F.lit(1), F.length(line)), lambda i: F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, F.length(line))))


def short_keys(line: Column) -> Column:
    """Keys of a short line, of what is left without one character, and from TWICE characters on
    also without two. Lines so many edits apart share one of them."""
    once = shortened(line)
    left = F.concat(F.array(line), once, F.when(F.length(line) >= TWICE, F.flatten(F.transform(once, shortened))).otherwise(F.array().cast("array<string>")))
    return F.transform(F.array_distinct(left), lambda y: F.xxhash64(F.lit(-1), y))


def edits(x: Column, y: Column) -> Column:
    """Edits that lines of x and y characters may be apart."""
    return F.floor(F.greatest(x, y) / EACH).cast("int")


def near(a: Column, b: Column) -> Column:
    """Whether SimHashes (of lines that aren't short) and lengths (which differ by no more than the
    edits) allow a link."""
    apart = F.bit_count(a["b0"].bitwiseXOR(b["b0"]))
    for c in range(1, CLASSES + 1):
        apart = apart + F.bit_count(a[f"b{c}"].bitwiseXOR(b[f"b{c}"]))
    alike = (F.greatest(a["n"], b["n"]) <= SHORT) | (apart <= DIFFER)
    return (F.abs(a["n"] - b["n"]) <= edits(a["n"], b["n"])) & alike


def normal_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), place, norm and its key of each line that isn't blank."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    rows = rows.select("doc_id", "row", "place", normal(F.col("line")).alias("norm")).where("norm <> ''")
    return rows.select("doc_id", "row", "place", "norm", F.xxhash64("norm", F.length("norm")).alias("text_key"))


def line_groups(docs: DataFrame, store: Stored) -> tuple[DataFrame, DataFrame]:
    """(lines, groups): the key of every line that isn't blank, and for every key that is not alone
    its number of lines, and its group's smallest (doc_id, row, place).

    Normal forms are written once; all that follows reads them from there.
    """
    lines = store.put("lines", normal_lines(docs).withColumn("id", F.monotonically_increasing_id()))
    texts = store.put("texts", lines.groupBy("text_key").agg(F.count("*").alias("size"), F.min("id").alias("id"), F.min(F.struct("doc_id", "row", "place")).alias("first")))
    n, words = F.length("norm").alias("n"), (F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1).alias("n_words")
    sized = lines.select("id", "text_key", "norm", n, words)
    hashed = with_simhash(sized.where(F.col("n") >= TWICE), "id", "text_key", "n")
    # equal lines have equal hashes: the largest is any
    names = [c for c in hashed.columns if c not in ("id", "text_key")]
    hashed = store.put("hashed", hashed.groupBy("text_key").agg(*[F.max(c).alias(c) for c in names]))
    brief = sized.where(F.col("n").between(SHORTEST, SHORT)).select(F.col("text_key").alias("node"), "norm", "n").distinct()
    blocks = [f"b{c}" for c in range(CLASSES + 1)]
    zero = [F.lit(0).cast("bigint").alias(c) for c in blocks]
    sigs = hashed.select(F.col("text_key").alias("node"), F.struct("n", *blocks).alias("sig")).union(brief.where(F.col("n") < TWICE).select("node", F.struct("n", *zero).alias("sig")))
    members = hashed.where(F.col("n") >= TWICE).select(F.col("text_key").alias("node"), F.explode(block_keys()).alias("key")).union(brief.select("node", F.explode(short_keys(F.col("norm"))).alias("key")))

    def verify(pairs: DataFrame) -> DataFrame:
        """Fetches the two normal forms of each pair and compares them."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
        wanted = store.put("wanted", texts.join(ends, "text_key").select("id"))
        small = F.broadcast if wanted.count() <= SMALL else (lambda x: x)
        found = store.put("norms", lines.join(small(wanted), "id").select(F.col("text_key").alias("k"), "norm"))
        both = pairs.join(found.select(F.col("k").alias("a"), F.col("norm").alias("x")), "a").join(found.select(F.col("k").alias("b"), F.col("norm").alias("y")), "b")
        both = both.withColumn("may", edits(F.length("x"), F.length("y"))).where(F.abs(F.length("x") - F.length("y")) <= F.col("may"))
        # few edits are told in a narrow band
        return both.where(F.expr("levenshtein(x, y, cast(may div 8 as int)) >= 0 or levenshtein(x, y, cast(may div 3 as int)) >= 0 or levenshtein(x, y, may) >= 0"))

    comp = bucket_links(store, members, sigs, near, verify)
    # keys that stand alone need no more: their one line stays
    linked = comp.select(F.col("node").alias("text_key"), "comp")
    grouped = texts.join(linked, "text_key").select("text_key", "size", "first", "comp").union(texts.join(linked, "text_key", "left_anti").where("size > 1").select("text_key", "size", "first", F.col("text_key").alias("comp")))
    grouped = store.put("grouped", grouped)
    tops = grouped.groupBy("comp").agg(F.min("first").alias("top"))
    groups = store.put("tops", grouped.join(tops, "comp").select("text_key", "size", "top"))
    store.drop("hashed", "texts", "grouped")
    return lines.select("doc_id", "row", "place", "text_key"), groups


def line_dedup(docs: DataFrame, store: Stored | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (the kept lines).

    Lines are split at ``\\n`` and compared in normal form: equal ones belong together, and others
    if their edit similarity is 0.9 or more (10 times the edits are at most the longer one's
    characters) and, where one has more than 21 characters, they share a key of ``block_keys`` and
    their SimHashes differ in at most 60 of 224 bits. Of each connected group the line with the
    smallest (doc_id, text hash, place) stays; blank lines always stay. Null texts count as one
    blank line; very long lines are compared whole; an empty table gives an empty result. Rows that
    repeat a doc_id and text are one document. Other columns are ignored.
    """
    store = store or Stored(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    lines, groups = line_groups(docs, store)
    placed = attach(lines, groups, "text_key", "size", lines.count()).where("top is not null")
    gone = ~F.struct("doc_id", "row", "place").eqNullSafe(F.col("top"))
    drop = store.put("drop", placed.where(gone).groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set("place").alias("places")))
    n = drop.agg(F.sum(F.size("places") + 4)).first()[0] or 0
    drop = F.broadcast(drop) if n <= SMALL else drop
    out = docs.withColumn("row", F.xxhash64("text")).join(drop, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    kept = F.filter(F.col("parts"), lambda part, i: ~F.array_contains(F.col("places"), i.cast("int")))
    out = out.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("parts"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    return out.select("doc_id", F.size("parts").cast("bigint").alias("n_lines"), F.size("places").cast("bigint").alias("n_removed"), F.array_join(kept, "\n").alias("text"))
