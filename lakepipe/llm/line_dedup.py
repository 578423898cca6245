"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its tokens (words at white space). A line is removed if an earlier one (smaller document id, or
earlier in the same document) has a Jaccard similarity of ``threshold`` or more with it, whether or not that one stays.
Lines without tokens always stay.

How: lines with the same text are one class from the start, led by its first place. The tokens of each class are put in
order of rarity, by counts over all lines that are kept in a fixed number of buckets; any order gives the same result,
a good one gives short lists. Let the first token (in that order) that two similar sets share lie at some place in each:
it is among the first few of both (prefix filter), and what is behind it must hold the overlap that the similarity asks for
(length and positional filter in one, as this overlap depends on both lengths). Of each set a 128-bit map goes along, in
which a token flips the bit that it names; maps of similar sets differ in no more bits than the sets differ in tokens
(bitmap filter). A first join asks only whether a class has any candidate, and emits no pair. Among the classes that have
one, all first measure against the earliest holder of one of their eight min-hash tokens, which settles most members of a large
group of near copies by a few comparisons each; only the others meet all earlier holders of a prefix token, and complete
similarities are verified.

The query asks whether an earlier similar line exists; links between classes that this does not need are not returned.

Defined results: a null text has no lines. Rows with the same id and text count as one document, rows of one id with
different texts are documents of their own, ordered by a hash of the text. Rows without an id come after all others, by that
hash; ids that are no integers are ordered as text. Documents without any tokens stay as they are; documents that had some
and lose all lines are dropped by clean(). No rows: no rows. Other columns of whatever name pass through clean(). Lines are
told apart by two 64-bit hashes, the tokens of two lines by 60 bits of one.

Arrays are exploded in the outer form: for the plain one Spark first filters empty arrays, and works them out once more (or
more often) to do so. Arrays that several columns use are columns of a projection below, for the same reason.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import bloom_joins, dropped, free, identified, settings, written

#: Token counts are kept in so many buckets: what the order of rarity costs in memory, whatever the corpus.
BUCKETS = 1 << 17
#: The columns of a token map: all tokens, and (of sets that _wide() says) those whose bit 6 is set.
MAPS = ["m0", "m1"]
#: Numbers that make different min-hash orders; both ends of an order give a token.
SALTS = (0x2545F4914F6CDD1D, 0x61C8864680B583EB, 0x1B873593CC9E2D51, 0x38B34AE5A1E38B93)
#: A line with a token.
SOLID = r"[^\x20\x09-\x0D]"
#: Where a line stands: columns of all tables of classes.
PLACE = ["key", "th", "line_no"]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _plain(line: str) -> Column:
    """With one kind of white space only."""
    plain, other = F.col(line), F.lit(False)
    for c in "\t\x0b\f\r":
        plain, other = F.replace(plain, F.lit(c), F.lit(" ")), other | F.col(line).contains(c)
    return F.when(other, plain).otherwise(F.col(line))


def _tokens(line: str) -> Column:
    """All tokens of a plain line, and empty texts between."""
    return F.split(F.col(line), F.lit(" "))


def _lines(docs: DataFrame) -> DataFrame:
    """key, th, line_no, line of lines with a token."""
    return docs.select("key", "th", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(SOLID))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g")]


def _classes(docs: DataFrame) -> DataFrame:
    """id, h, g, copies, key, th, line_no (of the first place), hashes (of the different tokens); a row for each different line
    with a token. Whatever needs the tokens later reads their hashes: lines are split once."""
    lines = _lines(docs).select(*PLACE, *_hashes(), "line")
    found = lines.groupBy("h", "g").agg(F.min(F.struct(*PLACE, "line")).alias("at"), F.count(F.lit(1)).alias("copies"))
    rest = [F.monotonically_increasing_id().alias("id"), "h", "g", "copies", *[f"at.{c}" for c in PLACE]]
    found = found.select(*rest, _plain("at.line").alias("line"))
    hashed = F.array_distinct(F.transform(_tokens("line"), lambda t: F.xxhash64(t)))
    return found.select("id", "h", "g", "copies", *PLACE, F.array_remove(hashed, F.xxhash64(F.lit(""))).alias("hashes"))


def _bucket(h: Column) -> tuple[Column, Column]:
    """Of a token's hash: the number that its level is in, and how far left that has to go for the level to come first."""
    return h.bitwiseAND(_long(BUCKETS // 16 - 1)).cast("int"), F.shiftrightunsigned(h, 58).bitwiseAND(_long(60)).cast("int")


def _levels(classes: DataFrame) -> Column:
    """How frequent each of BUCKETS buckets of tokens is, in 16 steps around the mean, sixteen to a number; its size is fixed,
    so it travels as a constant. The first bit of a level is turned, so that signed numbers are in the order of levels, and the
    first four bits of the bucket's hashes, so that these give way to the level when both meet."""
    words = classes.select(F.explode_outer("hashes").alias("t"))
    low, left = (BUCKETS // 16 - 1), -(1 << 60)
    counts = words.groupBy(F.col("t").bitwiseAND(_long(low | left)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # as many groups as buckets, so that Spark's fast map (of 2^16 groups by default) holds them all
    with settings(classes.sparkSession, spark__sql__codegen__aggregate__fastHashMap__capacityBit="18"):
        counts = written(counts, "counts")
    mean = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) / BUCKETS or 1.0
    level = F.greatest(F.lit(0), F.least(F.lit(15), F.floor(F.log2(F.col("n") / F.lit(mean))) + 5)).cast("long").bitwiseXOR(_long(8)).bitwiseXOR(F.shiftrightunsigned("b", 60))
    at, shift = _bucket(F.col("b"))
    packed = counts.groupBy(at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", level, F.lit(60) - shift)).alias("v"))
    found = {r["at"]: r["v"] for r in packed.collect()}
    dropped(counts)
    return F.expr(f"array({', '.join(f'{found.get(i, 0)}L' for i in range(BUCKETS // 16))})")


def _ratio(threshold: float) -> tuple[int, int]:
    part = Fraction(str(threshold))
    return part.numerator, part.denominator


def _wide(n: Column, threshold: float) -> Column:
    """Whether sets of ``n`` tokens have the second half of the map: where 64 bits tell little, as similar sets may differ in
    more than 16 tokens."""
    p, q = _ratio(threshold)
    return n * F.lit(q - p) > F.lit(8 * (p + q))


def _with_sets(classes: DataFrame, levels: Column, threshold: float, whole: bool = False) -> DataFrame:
    """Of ``classes`` (with hashes) the other columns, and n, m0, m1 and ``set``: different tokens as numbers, the rarest first;
    4 bits of rarity, then 60 bits of hash, in which the bucket's other levels are mixed. ``whole``: all have both halves of the map."""

    def placed(h: Column) -> Column:
        at, shift = _bucket(h)
        return F.coalesce(F.call_function("shiftleft", F.get(levels, at), shift).bitwiseXOR(h), _long(0))

    def flipped(bit) -> Column:
        return F.coalesce(F.aggregate("set", _long(0), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", bit(t), F.hash(t)))), _long(0))

    rest = [c for c in classes.columns if c != "hashes"]
    rows = classes.select(*rest, F.coalesce(F.size("hashes"), F.lit(0)).alias("n"), F.sort_array(F.transform("hashes", placed)).alias("set"))
    odd = F.when(_wide(F.col("n"), threshold) | F.lit(whole), flipped(lambda t: F.shiftright(t, 6).bitwiseAND(_long(1)))).otherwise(_long(0))
    return rows.withColumns({"m0": flipped(lambda t: _long(1)), "m1": odd})


def _prefixes(sets: DataFrame, threshold: float, *also: str) -> DataFrame:
    """A row for each prefix token: token, pos, id, n, the map and ``also``."""
    p, q = _ratio(threshold)
    length = F.expr(f"n - (n * {p}L + {q - 1}) div {q} + 1").cast("int")
    return sets.select("id", "n", *MAPS, *also, F.posexplode_outer(F.slice("set", F.lit(1), length)).alias("pos", "token")).where("token IS NOT NULL")


def _maps_fit(a: str, b: str, threshold: float, whole: bool = False) -> Column:
    """What the sizes and maps of similar sets fulfil: they differ in (n + m) (1 - threshold) / (1 + threshold) tokens at most.
    The map of all tokens alone turns most pairs down; its halves are looked at after that, if both sets have them."""
    p, q = _ratio(threshold)
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    all_, odd = (F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}")) for x in MAPS)
    fit = lambda bits: bits * F.lit(p + q) <= (n + m) * F.lit(q - p)
    return fit(F.bit_count(all_)) & ((F.lit(not whole) & ~_wide(F.least(n, m), threshold)) | fit(F.bit_count(all_.bitwiseXOR(odd)) + F.bit_count(odd)))


def _possible(a: str, b: str, threshold: float, whole: bool = False) -> Column:
    """What two postings of the first token that similar sets share must fulfil."""
    p, q = _ratio(threshold)
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return _maps_fit(a, b, threshold, whole) & (left * F.lit(p + q) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * F.lit(p))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (id, id2) the id, once, of those whose sets are similar."""
    p, q = _ratio(threshold)
    one = sets.select("id", F.col("set").alias("s1")).hint("shuffle_hash")
    two = sets.select(F.col("id").alias("id2"), F.col("set").alias("s2")).hint("shuffle_hash")
    ok = F.expr(f"size(array_intersect(s1, s2)) * {p + q}L >= (size(s1) + size(s2)) * {p}L")
    return pairs.join(one, "id").join(two, "id2").where(ok).select("id").distinct()


def repeated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs``: key, th and text. Gives h, g, key, th, line_no (of the first place) and late (whether there is an earlier
    similar line) of the classes that are late or have copies; a class may have two rows."""
    classes = written(_classes(docs), "lines")
    levels = _levels(classes)

    # which classes have a candidate at all
    posts = _prefixes(_with_sets(classes.select("id", "hashes"), levels, threshold), threshold)
    a, b = posts.alias("a"), posts.alias("b")
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.id") != F.col("b.id")) & _possible("a", "b", threshold)
    some = written(a.join(b, on, "left_semi").select("id").distinct(), "candidates")
    with bloom_joins(docs.sparkSession):
        chosen = classes.join(some.where("id >= 0").hint("shuffle_hash"), "id", "left_semi")
        sets = written(_with_sets(chosen, levels, threshold, whole=True), "sets")
    dropped(some)

    # a few comparisons each, with the earliest holders of min-hash tokens
    orders = {f"o{i}": F.transform("set", lambda t, s=s: F.xxhash64(t, F.lit(s))) for i, s in enumerate(SALTS)}
    ends = [end(o) for o in orders for end in (F.array_min, F.array_max)]
    whole = [*PLACE, "id", "n", *MAPS]
    place = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in PLACE])
    keyed = written(sets.withColumns(orders).select(*whole, F.explode_outer(F.array(*ends)).alias("token")), "keyed")
    lead = written(keyed.groupBy("token").agg(F.min(F.struct(*whole)).alias("b")), "leaders")
    met = keyed.select("token", F.struct(*whole).alias("a")).join(lead, "token")
    pairs = met.where((F.col("a.id") != F.col("b.id")) & (place("b") < place("a")) & _maps_fit("a", "b", threshold, whole=True))
    settled = written(_similar(pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("id2")).distinct(), sets, threshold), "settled")

    # the others with every earlier holder of a prefix token
    there = _prefixes(sets, threshold, *PLACE)
    asking = _prefixes(sets.join(settled, "id", "left_anti"), threshold, *PLACE)
    a, b = asking.alias("a"), there.alias("b")
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.id") != F.col("b.id")) & _possible("a", "b", threshold, whole=True) & (place("b") < place("a"))
    pairs = a.join(b, on).select(F.col("a.id").alias("id"), F.col("b.id").alias("id2")).distinct()
    late = settled.unionByName(_similar(pairs, sets, threshold))

    out = ["h", "g", *PLACE]
    copied = classes.where("copies > 1").select(*out, F.lit(False).alias("late"))
    found = written(copied.unionByName(sets.join(late.hint("shuffle_hash"), "id", "left_semi").select(*out, F.lit(True).alias("late"))), "repeated")
    dropped(classes, sets, keyed, lead, settled)
    return found


def marked(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with columns of its own, and the name of one of them: numbers of the lines that go, from 0; null for none."""
    keyed, key, th = identified(docs, doc_id, text)
    name = free(keyed, "__gone")[0]
    narrow = keyed.select(F.col(key).alias("key"), F.col(th).alias("th"), F.col(f"`{text}`").alias("text"))
    found = repeated(narrow, threshold)
    first = found.where(F.col("h") >= -(2**63)).select("h", "g", "late", F.struct(*PLACE).alias("first"))
    lines = _lines(narrow).select(F.struct(*PLACE).alias("place"), *_hashes())
    with bloom_joins(docs.sparkSession):
        gone = lines.join(first.hint("shuffle_hash"), ["h", "g"]).where("late OR place != first")
        gone = gone.groupBy(F.col("place.key").alias(key), F.col("place.th").alias(th)).agg(F.collect_set("place.line_no").alias(name))
        gone = written(gone, "gone")
    dropped(found)
    return keyed.join(gone.hint("shuffle_hash"), [key, th], "left"), name


def _cleaned(text: str, gone: str) -> Column:
    lines = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains(gone, i))
    return F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(lines, "\n"))


def report(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_lines, n_removed, text (what is left of it)."""
    rows, gone = marked(docs.select(doc_id, text), threshold, doc_id, text)
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n")))
    return rows.select(F.col(doc_id).alias("doc_id"), count.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), _cleaned(text, gone).alias("text"))


def clean(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that go, and without documents that had tokens and have none left.

    ``n_chars``, where there is such a column, is counted again for texts that changed.
    """
    rows, gone = marked(docs, threshold, doc_id, text)
    left = free(rows, "__text")[0]
    rows = rows.withColumn(left, _cleaned(text, gone)).where(F.col(gone).isNull() | F.col(left).rlike(SOLID))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col(left).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(left)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)
