"""Fuzzy line deduplication by MinHash, in DataFrame functions alone.

Lines are compared in lower case without outer white space; blank lines stay as they are. Equal lines are collapsed
first, under a 128-bit name (two 64-bit hashes of different seeds), so no text is shuffled for it. A line's shingles are
all runs of SHINGLE characters (UTF-16 units); a shorter line is its own shingle.

Signature: the shingles are exploded, hashed and reduced inside one generated loop. A shingle's hash picks one of BINS
bins and a value there; each bin keeps its least value, so a line needs one hash a shingle. Of a line's shingles only
those of small values can be a bin's least one, so lines of many keep KEPT to twice as many of these; the first BACKUP
shingles are kept too, which serves lines of few distinct shingles. An empty bin takes the next one's value. Nine bands
of three bins are the bucket keys: lines of similarity 0.8 share one with a probability of 0.993, of 0.85 with 0.998, by
simulation; tests and README have the measured recall.

Buckets of a few lines are expanded into all pairs, larger ones not at first: each line meets the bucket's least line and its neighbour in the order of
another bin, so the pairs grow with the lines. Candidates are verified by the exact Jaccard similarity of their distinct
shingles, and distributed union-find joins verified pairs to components. Where large buckets have many
pairs, members of buckets that still hold several components go through this again with the components' other lines as
centres, until a round adds few links. What these
rounds leave is settled by all pairs of a bucket's lines of different components, so no two similar lines that share a
bucket stay apart.

No pair is looked at, or leaves a bucket, that its sketches rule out. A sketch is the parity of a line's distinct shingles
in each of 64 * WORDS cells. Two sketches differ in no more cells than the sets in shingles, so a pair with too many
differing cells can't have the similarity: the bound loses nothing. Of a pair that shares several buckets only the first
one's is made.

Each component keeps one line: the first line of its smallest doc_id.

Null and empty texts have no lines to compare and stay as they are, and so do rows without doc_id. A document is told by
doc_id and text: rows that repeat both count as one, rows that repeat a doc_id with another text are documents of their
own. Texts are rebuilt only where lines go; a document that loses all its lines has an empty text. Extra columns are
kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.graph_components import connected_components
from tessera.storage import cut_quick as cut
from tessera.storage import drop, release

SHINGLE = 8
THRESHOLD = 0.8
BINS = 18
#: A band starts at every second bin and takes those this far from there, round the end.
BAND = (0, 1, 5)
#: Shingles that make the signature of a long line (up to twice as many), and the first ones that stand in for them.
KEPT = 48
BACKUP = 24
#: A bucket of more lines is dealt into as many parts as it takes for neighbours; its least line meets all of them.
BUCKET = 10_000
#: All pairs of a bucket of no more lines than this are compared at once.
SMALL = 10
#: Longs of a sketch.
WORDS = 16
#: Rounds of heads go on while they add more than this share of the links.
FEW = 0.1
#: Bits of a sieve and of one of its pages, as powers of two; the most bounds what is broadcast, to 8 MB.
SIEVE, PAGE = 26, 16
#: No rounds are needed if the large buckets have no more pairs than this for each line, and sketches leave less than one.
PAIRS = 64
BLANK = " \t\r\x0b\x0c"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body, pos, norm, k1, k2) for every line that isn't blank; body tells texts of one doc_id apart."""
    some = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("body"),
        F.posexplode(F.split(F.lower(text_col), "\n")).alias("pos", "line"),
    )
    lines = some.select("doc_id", "body", "pos", trimmed("line").alias("norm")).where("norm <> ''")
    return lines.select("*", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"))


def trimmed(line: str) -> F.Column:
    """A line without outer white space; btrim walks the whole line, so only lines that have any are sent there."""
    raw = F.col(line).cast("binary")
    blanks = [F.lit(c.encode()) for c in BLANK]
    outer = F.substring(raw, 1, 1).isin(blanks) | F.substring(raw, -1, 1).isin(blanks)
    return F.when(outer, F.btrim(line, F.lit(BLANK))).otherwise(F.col(line))


def units(norm: F.Column) -> F.Column:
    """Two bytes a character, so that a shingle is a slice that is found at once."""
    return F.encode(norm, "UTF-16BE")


def starts(b: F.Column) -> F.Column:
    """Where the shingles of an encoded line start; one start for a line shorter than a shingle."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (2 * SHINGLE - 1), F.lit(1)), F.lit(2))


def shingle_hash(b: F.Column, start: F.Column) -> F.Column:
    return F.xxhash64(F.substring(b, start, F.lit(2 * SHINGLE)))


def hashes(b: F.Column) -> F.Column:
    """The hashes of all shingles of an encoded line."""
    return F.transform(starts(b), lambda i: shingle_hash(b, i))


def all_hashes(b: str) -> F.Column:
    """hashes() of a column: a lambda's argument is read once, a column anew for each shingle."""
    return F.transform(F.array(b), hashes)[0]


def signatures(lines: DataFrame) -> DataFrame:
    """lines_of() to (k1, k2, keeper, copies, bins): distinct lines with their least doc_id, and signatures."""
    coded = lines.select("doc_id", "k1", "k2", units(F.col("norm")).alias("b"))
    n = F.greatest((F.octet_length("b") / 2).cast("int") - (SHINGLE - 1), F.lit(1))
    level = F.least(F.greatest(F.floor(F.log2(n / KEPT)), F.lit(0)), F.lit(22)).cast("int")
    coded = coded.select("*", F.call_function("shiftright", F.lit((1 << 63) - 1), level).alias("most"))
    each = coded.select("doc_id", "k1", "k2", "most", "b", F.explode(starts(F.col("b"))).alias("i"))
    each = each.select("doc_id", "k1", "k2", "most", "i", shingle_hash(F.col("b"), F.col("i")).alias("h"))
    each = each.where((F.shiftrightunsigned("h", 1) <= F.col("most")) | (F.col("i") < 2 * BACKUP))
    each = each.select(
        "doc_id", "k1", "k2", "i", (F.col("h").bitwiseAND(F.lit(0xFFFFF)).cast("int") % BINS).alias("bin"), F.shiftrightunsigned("h", 33).cast("int").alias("v")
    )
    found = each.groupBy("k1", "k2").agg(
        F.expr("min(doc_id) filter (where i = 1)").alias("keeper"),
        F.expr("count(*) filter (where i = 1)").alias("copies"),
        *[F.expr(f"min(v) filter (where bin = {k})").alias(f"m{k}") for k in range(BINS)],
    )
    dense = found.select(
        "k1", "k2", "keeper", "copies",
        *[F.coalesce(*[F.col(f"m{(k + j) % BINS}") for j in range(6)]).alias(f"d{k}") for k in range(BINS)],
    )
    return dense.select("k1", "k2", "keeper", "copies", F.array(*[f"d{k}" for k in range(BINS)]).alias("bins"))


def band(bins: str, first: int) -> list[F.Column]:
    return [F.get(bins, F.lit((first + j) % BINS)) for j in BAND]


def band_key(bins: str, first: int) -> F.Column:
    own = band(bins, first)
    return F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.lit(first), *own))


def buckets(keys: DataFrame) -> DataFrame:
    """band_keys() to (key, o, k1, first, size) for buckets of several members."""
    own = Window.partitionBy("key")
    return cut(keys.select("*", F.min("k1").over(own).alias("first"), F.count("*").over(own).alias("size")).where("size > 1"), "buckets")


def band_keys(lines: DataFrame) -> DataFrame:
    """signatures() to (key, o, k1): a line's buckets, and another bin, which puts neighbours in order."""
    keys = F.array(*[band_key("bins", first) for first in range(0, BINS, 2)])
    each = lines.select("k1", "bins", F.posexplode(keys).alias("at", "key")).where("key is not null")
    return each.select("key", F.get("bins", (F.col("at") * 2 + 2) % BINS).alias("o"), "k1")


def sieve(names: DataFrame) -> DataFrame:
    """names (k1) to pages (page, words) of a bit array that has the low bits of every k1; some two bits a row, up to 2 ** SIEVE."""
    bits = 1 << min(SIEVE, max(PAGE, (2 * names.count()).bit_length()))
    at = F.col("k1").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    every = names.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    words = names.select(F.shiftright(at, 6).alias("w"), one.alias("x")).union(every).groupBy("w").agg(F.bit_or("x").alias("x"))
    pages = words.groupBy(F.shiftright("w", PAGE - 6).alias("page")).agg(F.sort_array(F.collect_list(F.struct("w", "x"))).alias("all"))
    return pages.select("page", F.col("all.x").alias("words"))


def sifted(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows without most of those whose k1 sieve() wasn't told; none of the others goes."""
    n = F.lit(pages.count() << PAGE)
    at = F.pmod("k1", n)
    bit = F.call_function("getbit", F.get("words", F.shiftright(at, 6).bitwiseAND(F.lit((1 << PAGE - 6) - 1)).cast("int")), at.bitwiseAND(F.lit(63)).cast("int"))
    return rows.join(F.broadcast(pages), (F.shiftright(at, PAGE) == F.col("page")) & (bit == 1)).select(rows.columns)


def texts_of(names: DataFrame, lines: DataFrame, seen: DataFrame) -> DataFrame:
    """(k1, k2, b, bins): the encoded lines that names (k1) tell, read again from the documents that keep them.

    A sieve keeps most other lines out of the shuffles; the joins settle which ones are asked for.
    """
    pages = cut(sieve(names), "line-sieve")
    seen, lines = sifted(seen.select("doc_id", "k1", "k2", "norm"), pages), sifted(lines, pages)
    # names are distinct, so this is a semi-join; one that is called so would be done before the sieve
    asked = lines.join(names.distinct().hint("shuffle_hash"), "k1").select("k1", "k2", F.col("keeper").alias("doc_id"), "bins", "copies")
    asked = cut(asked, "line-names")
    # asked is the smaller side by far: its hash table spares sorting the lines' texts
    found = seen.join(asked.hint("shuffle_hash"), ["doc_id", "k1", "k2"])
    # a line has one keeper, so this is one row a line without another shuffle; only lines that stand twice have to be sorted
    found = found.where("copies = 1").union(found.where("copies > 1").dropDuplicates(["doc_id", "k1", "k2"]))
    out = cut(found.select("k1", "k2", units(F.col("norm")).alias("b"), "bins"), "line-texts")
    drop(pages, asked)
    return out


def sketches(texts: DataFrame) -> DataFrame:
    """texts_of() to (k1, k2, n, x0, x1, ...): the count and the sketch of a line's distinct shingles."""
    # outside the lambda the set is made by compiled code, of longs that aren't boxed
    found = F.array_distinct(all_hashes("b"))
    # made in a step of its own, since a lambda keeps the loop over its result from being compiled
    each = texts.select("k1", "k2", found.alias("own")).select("k1", "k2", F.explode_outer("own").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 5).bitwiseAND(F.lit(63)).cast("int"))
    each = each.select("k1", "k2", F.col("h").bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("w"), bit.alias("x"))
    words = [F.expr(f"bit_xor(x) filter (where w = {k})").alias(f"x{k}") for k in range(WORDS)]
    return cut(each.groupBy("k1", "k2").agg(F.count("*").alias("n"), *words), "sketches")


def side(marks: DataFrame, name: str, *more: F.Column) -> DataFrame:
    """sketches() with the names of one side of a pair; none of its numbers is null, which keeps generated code short."""
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(f"{name}_{c}") for c in ("n", *[f"x{k}" for k in range(WORDS)])]
    return marks.select(F.col("k1").alias(name), *more, *numbers)


def may_reach(threshold: float) -> F.Column:
    """Whether the counts and sketches of sides a and b leave it possible that two sets have the similarity."""
    apart = sum((F.bit_count(F.col(f"a_x{k}").bitwiseXOR(F.col(f"b_x{k}"))) for k in range(WORDS)), F.lit(0))
    # as in similar(): common * (1 + t) >= n * t, and n - 2 * common shingles differ
    most = (F.col("a_n") + F.col("b_n")) * (1 - threshold) / (1 + threshold) + 1e-6
    return (F.abs(F.col("a_n") - F.col("b_n")) <= most) & (apart <= most)


def similar(a: str, b: str, n_a: str, n_b: str, threshold: float) -> F.Column:
    """Whether two encoded lines' distinct shingles, n_a and n_b of them, have the similarity."""
    # their union takes one hash set, their intersection two
    common = F.col(n_a) + F.col(n_b) - F.size(F.array_union(all_hashes(a), all_hashes(b)))
    return common * (1 + threshold) >= (F.col(n_a) + F.col(n_b)) * threshold - 1e-9


def alike(a: str, b: str, threshold: float) -> F.Column:
    """Whether two signatures have no far fewer equal bins than the threshold asks for (five standard deviations)."""
    equal = sum((F.get(a, F.lit(k)).eqNullSafe(F.get(b, F.lit(k))).cast("int") for k in range(BINS)), F.lit(0))
    return equal >= int(BINS * threshold - 5 * (BINS * threshold * (1 - threshold)) ** 0.5)


def verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame, threshold: float, sketched: bool = False) -> DataFrame:
    """pairs (a, b) of first names to links (a, a2, b, b2) whose exact similarity reaches the threshold.

    Pairs whose sketches rule it out are spared the exact look, if that wasn't seen to before (sketched).
    """
    if sketched:
        of = lambda x: marks.select(F.col("k1").alias(x), F.col("k2").alias(f"{x}2"), F.col("n").alias(f"{x}_n"))
        asked = pairs.join(of("a"), "a").join(of("b"), "b")
    else:
        left, right = side(marks, "a", F.col("k2").alias("a2")), side(marks, "b", F.col("k2").alias("b2"))
        asked = pairs.join(left, "a").join(right, "b").where(may_reach(threshold))
    asked = cut(asked.select("a", "a2", "b", "b2", "a_n", "b_n"), "line-asked")
    left = texts.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), F.col("b").alias("ba"))
    right = texts.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("b").alias("bb"))
    both = asked.join(left, ["a", "a2"]).join(right, ["b", "b2"])
    links = cut(both.where(similar("ba", "bb", "a_n", "b_n", threshold)).select("a", "a2", "b", "b2"), "line-links")
    drop(asked)
    return links


def bucket_pairs(met: DataFrame, near: int = 1) -> DataFrame:
    """met (key, o, k1, first, size) to candidate pairs (a, b): each line with its bucket's first, and with its neighbour.

    In buckets of no more than near + 1 lines each line meets the near ones before it: all pairs.
    """
    star = met.select(F.col("first").alias("a"), F.col("k1").alias("b"))
    parts = F.ceil(F.col("size") / BUCKET)
    order = Window.partitionBy("key", F.pmod(F.col("k1"), parts)).orderBy("o", "k1")
    before = [F.lag("k1").over(order)] + [F.when(F.col("size") <= near + 1, F.lag("k1", j).over(order)) for j in range(2, near + 1)]
    chain = met.where("size > 2").select("k1", F.array(*before).alias("p")).select("k1", F.explode("p").alias("p")).where("p is not null")
    chain = chain.select(F.col("p").alias("a"), F.col("k1").alias("b"))
    return star.union(chain).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed_pairs(met: DataFrame, roots: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """Further pairs (a, b) in buckets that hold several components, by roots (k1, root); without those of tried.

    Of a bucket's lines of one component the least and the greatest stand for it and meet the other components'.
    """
    member = met.join(roots, "k1", "left").select("key", "k1", F.coalesce("root", "k1").alias("root"))
    heads = member.groupBy("key", "root").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"))
    spread = heads.groupBy("key").agg(F.count("*").alias("n"), F.max("hi").alias("first"), F.sum(F.when(F.col("lo") < F.col("hi"), 2).otherwise(1)).alias("size"))
    heads = heads.join(spread.where("n > 1").select("key", "first", "size"), "key")
    more = bucket_pairs(heads.select("key", F.col("root").alias("o"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k1"), "first", "size"))
    for known in tried:
        more = more.join(known, ["a", "b"], "left_anti")
    return more


def other_pairs(met: DataFrame, roots: DataFrame, marks: DataFrame, tried: list[DataFrame], threshold: float) -> DataFrame:
    """All pairs (a, b) of a bucket's lines of different components that may be alike, by roots (k1, root) and marks (k1, bins).

    With these, every two lines that share a bucket are compared or stand in one component already. If marks has sketches
    these tell which pairs may be alike, and only the first bucket that a pair shares makes it; else signatures tell.
    """
    member = met.select("key", "k1").join(roots, "k1", "left").select("key", "k1", F.coalesce("root", "k1").alias("root"))
    mixed = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    member = cut(member.join(mixed, "key").join(marks, "k1"), "bucket-members")
    if "x0" in marks.columns:
        at = range(0, BINS, 2)
        # a line without a band's key has its own name there, which no other line has
        of = lambda x: side(member, x, "key", F.col("root").alias(f"r{x}"), *[F.coalesce(band_key("bins", k), "k1").alias(f"{x}_k{k}") for k in at])
        ahead = F.coalesce(*[F.when(F.col(f"a_k{k}") == F.col(f"b_k{k}"), F.col(f"a_k{k}")) for k in at])
        fit = (ahead == F.col("key")) & may_reach(threshold)
    else:
        of = lambda x: member.select("key", F.col("k1").alias(x), F.col("root").alias(f"r{x}"), F.col("bins").alias(f"m{x}"))
        fit = alike("ma", "mb", threshold)
    more = of("a").join(of("b"), "key").where("a < b and ra <> rb").where(fit).select("a", "b").distinct()
    for known in tried:
        more = more.join(known, ["a", "b"], "left_anti")
    more = cut(more, "bucket-others")
    drop(member)
    return more


def rooted(links: DataFrame) -> DataFrame:
    """links to (k1, k2, r1, r2): every linked line and its component's least line."""
    ends = links.select(F.col("a").alias("k1"), F.col("a2").alias("k2")).union(links.select(F.col("b").alias("k1"), F.col("b2").alias("k2")))
    nodes = cut(ends.distinct().select("k1", "k2", F.monotonically_increasing_id().alias("id")), "line-nodes")
    of = lambda x: nodes.select(F.col("k1").alias(x), F.col("k2").alias(f"{x}2"), F.col("id").alias(f"id_{x}"))
    edges = links.join(of("a"), ["a", "a2"]).join(of("b"), ["b", "b2"]).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    found = connected_components(edges)
    named = nodes.join(found, nodes["id"] == found["node"], "left").select("k1", "k2", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("r"))
    out = cut(named.join(least, "root").select("k1", "k2", F.col("r.k1").alias("r1"), F.col("r.k2").alias("r2")), "line-roots")
    drop(nodes, found)
    return out


def extended(roots: DataFrame, found: DataFrame) -> DataFrame:
    """rooted() with further links found; only the components that these join are gone through again."""
    of = lambda x: roots.select(F.col("k1").alias(x), F.col("k2").alias(f"{x}2"), F.col("r1").alias(f"r{x}"), F.col("r2").alias(f"r{x}2"))
    own = lambda x: [F.coalesce(f"r{x}", x).alias(x), F.coalesce(f"r{x}2", f"{x}2").alias(f"{x}2")]
    links = found.join(of("a"), ["a", "a2"], "left").join(of("b"), ["b", "b2"], "left").select(*own("a"), *own("b"))
    joined = rooted(cut(links, "line-links"))
    least = joined.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    known = roots.join(least, ["r1", "r2"], "left").select("k1", "k2", F.coalesce("s1", "r1").alias("r1"), F.coalesce("s2", "r2").alias("r2"))
    out = cut(known.union(joined.join(roots, ["k1", "k2"], "left_anti")), "line-roots")
    drop(links, joined)
    return out


def line_components(lines: DataFrame, seen: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """signatures() to (k1, k2, r1, r2) for lines that have a near copy."""
    met = buckets(band_keys(lines))
    pairs = cut(bucket_pairs(met, SMALL - 1), "line-pairs")
    texts = texts_of(met.select("k1"), lines, seen)
    marks = sketches(texts)
    links = verified(pairs, texts, marks, threshold)
    roots = rooted(links)
    large = cut(met.where(F.col("size") > SMALL), "buckets")
    drop(met)
    release(lines.sparkSession)
    if not large.isEmpty():
        roots = large_buckets(large, texts, marks, pairs, links, roots, threshold)
    drop(large, texts, marks, links, pairs)
    return roots


def large_buckets(met: DataFrame, texts: DataFrame, marks: DataFrame, pairs: DataFrame, links: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """roots with what rounds of heads, where they are needed, then all pairs of different components add in the buckets of met."""
    # most lines stand in small buckets only
    pages = cut(sieve(met.select("k1")), "line-sieve")
    texts, marks = sifted(texts, pages), sifted(marks, pages)
    own = texts.select("k1", "k2", "bins").join(met.select("k1").distinct().hint("shuffle_hash"), "k1")
    shown = marks.join(own.hint("shuffle_hash"), ["k1", "k2"]).drop("k2")
    others = lambda: other_pairs(met, roots.select("k1", F.col("r1").alias("root")), shown, [], threshold)
    n_lines, n_pairs = met.agg(F.count("*"), F.sum("size") / 2).first()
    more = others() if n_pairs <= PAIRS * n_lines else None
    if more is None or more.count() > n_lines:
        roots = head_rounds(met, texts, marks, pairs, links, roots, threshold)
        drop(*([more] if more else []))
        more = others()
    found = verified(more, texts, marks, threshold, sketched=True)
    if not found.isEmpty():
        before = roots
        roots = extended(roots, found)
        drop(before)
    drop(more, found, pages)
    return roots


def head_rounds(met: DataFrame, texts: DataFrame, marks: DataFrame, pairs: DataFrame, links: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """roots with what rounds of heads add in the buckets of met, until a round adds few links."""
    n_links = links.count()
    tried = [pairs]
    while True:
        more = cut(mixed_pairs(met, roots.select("k1", F.col("r1").alias("root")), tried), "line-pairs")
        tried.append(more)
        found = verified(more, texts, marks, threshold)
        n_found = found.count()
        if n_found:
            before = roots
            roots = extended(roots, found)
            drop(before)
        drop(found)
        release(met.sparkSession)
        n_links += n_found
        if n_found <= FEW * n_links:
            break
    drop(*tried[1:])
    return roots


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, body, gone): positions of the lines that go, for every document that loses one."""
    spark = docs.sparkSession
    # read three times, which costs less than splitting the texts anew
    seen = cut(lines_of(docs, id_col, text_col), "line-seen")
    # plain columns are written and read faster than arrays
    table = cut(signatures(seen).select("k1", "k2", "keeper", "copies", *[F.get("bins", F.lit(k)).alias(f"d{k}") for k in range(BINS)]), "lines")
    lines = table.select("k1", "k2", "keeper", "copies", F.array(*[f"d{k}" for k in range(BINS)]).alias("bins"))
    release(spark)
    roots = line_components(lines, seen, threshold)
    facts = lines.select("k1", "k2", "keeper", "copies")
    classed = cut(facts.join(roots, ["k1", "k2"], "left").where("copies > 1 or r1 is not null").select(
        "k1", "k2", "keeper", F.coalesce("r1", "k1").alias("r1"), F.coalesce("r2", "k2").alias("r2")
    ), "line-classes")
    keepers = classed.groupBy("r1", "r2").agg(F.min("keeper").alias("keeper"))
    told = cut(classed.drop("keeper").join(keepers, ["r1", "r2"]), "line-told")
    drop(table, roots, classed)
    hits = seen.select("doc_id", "body", "pos", "k1", "k2").join(told.hint("shuffle_hash"), ["k1", "k2"]).select("doc_id", "body", "pos", "r1", "r2", "keeper")
    hits = cut(hits, "line-hits")
    drop(seen)
    release(spark)
    # which line stays is settled inside the document that keeps it
    here = Window.partitionBy("doc_id", "r1", "r2").orderBy("body", "pos")
    kept_here = hits.where("doc_id = keeper").select("doc_id", "body", "pos", F.rank().over(here).alias("k")).where("k > 1").drop("k")
    goes = hits.where("doc_id <> keeper").select("doc_id", "body", "pos").union(kept_here)
    out = cut(goes.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("gone")), "line-gone")
    drop(told, hits)
    release(spark)
    return out


def _rebuilt(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, list, F.Column, F.Column]:
    """docs beside their removals; their columns with the new texts, and the counts of lines that went and that stay."""
    gone = removals(docs, id_col, text_col, threshold).select(
        F.col("doc_id").alias("gone_id__"), F.col("body").alias("gone_body__"), F.col("gone").alias("gone__")
    )
    joined = docs.join(gone.hint("shuffle_hash"), (docs[id_col] == gone["gone_id__"]) & (F.xxhash64(docs[text_col]) == gone["gone_body__"]), "left")
    where = gone["gone__"]
    # split once, for the texts that change and for the count; no column has so long a name
    lines = "_" * (1 + max(len(c) for c in joined.columns))
    joined = joined.select("*", F.split(docs[text_col], "\n").alias(lines))
    left = F.filter(lines, lambda _, i: ~F.array_contains(where, i))
    text = F.when(where.isNull(), docs[text_col]).otherwise(F.array_join(left, "\n"))
    n_gone = F.when(where.isNull(), 0).otherwise(F.size(where)).cast("long")
    n_lines = F.when(docs[text_col].isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined, [text.alias(c) if c == text_col else docs[c] for c in docs.columns], n_gone, n_lines - n_gone


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with their columns, texts without the lines that went, and lines_gone and lines_left in place of any columns so named."""
    joined, columns, gone, left = _rebuilt(docs, id_col, text_col, threshold)
    own = [c for c, name in zip(columns, docs.columns, strict=True) if name.lower() not in ("lines_gone", "lines_left")]
    return joined.select(*own, gone.alias("lines_gone"), left.alias("lines_left"))


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with their columns and texts without the lines that went; documents that lose all lines go."""
    joined, columns, gone, left = _rebuilt(docs, id_col, text_col, threshold)
    return joined.where(~((gone > 0) & (left <= 0))).select(*columns)


def op8_fuzzy_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "lines_gone", "lines_left", F.md5(F.col("text").cast("binary")).alias("text_md5"))
