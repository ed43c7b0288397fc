"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target number of words, and within it longer documents are somewhat favoured: a document is expected
``rate`` times, rate being in proportion to 1 + EMPHASIS * log2 of its words, no more than the cap, and such that a source's
expected words are its target. floor(rate) whole copies are certain; the rest p is the document's inclusion probability for one
more. Documents of a source are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), u a hash of
the document, and taken in that order until the source's remaining words are used up: a sample of fixed size, counted
in words, with inclusion probabilities that differ from document to document.

No source is sorted whole. Documents of as many words, up to a factor of two, have one p, so how ranks are distributed in a
source is known, and they are dealt to buckets of about ``BUCKET_ROWS`` documents. Sums per bucket tell in which bucket, the
edge, the remaining words end; only that one is ordered, and what still fits is taken from it in rank order. What then is
left over, as a long document may leave much, goes on to the documents behind the edge that fit, in the same way, until none
fits; at last the smallest document left is taken if to go beyond the end by it comes nearer.

Texts are counted once for the plan, which works on one narrow row a document (kept in the shared folder), and once
more where the rows come out; nothing but narrow rows is shuffled. Rows equal in doc_id and text have one rank and are
counted, not listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import repeats as rp
from .scratch import Scratch

#: Documents of a bucket of ranks.
BUCKET_ROWS = 4096
#: Passes over an edge that fill what is left over.
FILLS = 3
#: How much a document twice as long is favoured.
EMPHASIS = 0.125
#: Weights of the sources in order of code points (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Rows of a table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def size_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, n_docs, source_size, target for rows (source, size).

    Targets are weight * x for one x, but no more than ``cap`` times the source's size: what a capped source leaves is
    shared again by weight. With sources in order of cap / weight the capped ones come first, so x follows from
    running sums over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    left = total - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("x", left / rest)
    # the first source that stays below its limit sets x for all from there on; earlier ones are capped
    x = F.min(F.when(F.col("x") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), F.col("x")))).over(all_rows)["x"]
    target = F.least(F.col("limit"), F.coalesce(x * F.col("w"), F.col("limit")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def _small(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """broadcast if df has few enough rows, else nothing."""
    return F.broadcast if df.count() <= BROADCAST_ROWS else lambda x: x


def _on_source(left: DataFrame, right: DataFrame, hint: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
    """Join on source, null with null."""
    return left.join(hint(right.withColumnRenamed("source", "_of")), F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def _fill(edge: DataFrame) -> DataFrame:
    """Edge rows (source, k, th, size, rank, m copies, room, final: no other edge follows) with n, the copies taken, and left, the room that stays."""
    of = Window.partitionBy("source")
    order = of.orderBy("rank", "th", "k")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("n", F.lit(0).cast("long")).withColumn("left", F.col("room"))
    for _ in range(FILLS + 1):
        rest = F.when((F.col("size") > 0) & (F.col("size") <= F.col("left")), F.col("m") - F.col("n")).otherwise(0)
        edge = edge.withColumn("rest", rest)
        before = F.coalesce(F.sum(F.col("rest") * F.col("size")).over(earlier), F.lit(0))
        fits = F.floor((F.col("left") - before) / F.greatest("size", F.lit(1)))
        edge = edge.withColumn("n", F.col("n") + F.greatest(F.lit(0), F.least("rest", fits)))
        edge = edge.withColumn("left", F.col("room") - F.sum(F.col("n") * F.col("size")).over(of))
    edge = edge.withColumn("spare", F.col("final") & (F.col("n") < F.col("m")) & (F.col("size") > 0))
    first = F.row_number().over(Window.partitionBy("source", "spare").orderBy("size", "rank", "th", "k")) == 1
    edge = edge.withColumn("n", F.col("n") + F.when(F.col("spare") & first & (F.col("size") < 2 * F.col("left")), 1).otherwise(0))
    return edge.select("source", "k", "th", "m", "n", "left", "bucket")


def inclusion(sized: DataFrame, per: DataFrame, hint: Callable[[DataFrame], DataFrame], cap: float = 2.0, emphasis: float = EMPHASIS) -> DataFrame:
    """source, length (class), sure (certain copies), p (probability of one more), n (documents), words: of each source's documents of a class.

    Rates are c * (1 + emphasis * length) with one c a source, but no more than the cap. With classes from the most favoured on,
    the capped ones come first, so c follows from running sums over a source's classes, some twenty rows.
    """
    classes = sized.groupBy("source", length_of(F.col("size")).alias("length")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = _on_source(classes, per.select("source", "target"), hint).withColumn("favour", 1 + F.lit(float(emphasis)) * F.col("length"))
    down = Window.partitionBy("source").orderBy(F.desc("length"))
    capped = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(cap))
    rest = F.sum(F.col("words") * F.col("favour")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = F.try_divide(F.col("target") - capped, rest)
    classes = classes.withColumn("c", F.when(c * F.col("favour") <= F.lit(float(cap)), F.struct((-F.col("length")).alias("at"), c.alias("c"))))
    c = F.min("c").over(Window.partitionBy("source"))["c"]
    all_capped = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    rate = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(c * F.col("favour"), all_capped)))
    sure = F.floor(rate).cast("long")
    return classes.select("source", "length", sure.alias("sure"), (rate - sure).alias("p"), "n", "words")


def length_of(size: Column) -> Column:
    """How often the number of words, and one, can be halved."""
    return F.length(F.bin(size + 1)) - 1


def sample(docs: DataFrame, carry: list[str], share: float = 1.5, cap: float = 2.0, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, emphasis: float = EMPHASIS) -> DataFrame:
    """One row per document: row (struct of the ``carry`` columns), size, source_size, target, p, copies, taken (copies * size).

    A source's taken words miss its target by less than the words of the smallest document behind its last edge that was not
    taken. Deterministic: u depends on doc_id and text alone, so reruns and repartitioning agree; rows equal in both tie, and
    any of them are taken. A null or empty text has size 0 and gets the certain copies only. A null source is a source
    of its own, last. An empty table gives an empty result. No document gets more than ceil(cap) copies. A text of any
    length is counted by the JVM in place. Extra columns matter only if carried.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    keys = rp.keys(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select(own, F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), u.alias("u"), *(v.alias(n) for n, v in keys.items()))
    sized = scratch.keep("sized", rows.drop("row"))
    per = scratch.keep("per", source_targets(sized.select("source", "size"), share, cap, weights).select("source", "source_size", "target"))
    hint = _small(per)  # one row a source
    classes = scratch.keep("classes", inclusion(sized, per, hint, cap, emphasis))
    # how ranks are distributed: of each class the share of documents that may be taken, and their odds
    odds = F.col("p") / (1 - F.col("p"))
    may = F.col("p") > 0
    mixture = classes.groupBy("source").agg(F.sum(F.when(may, F.col("n")).otherwise(0)).alias("open"), F.sum(F.col("sure") * F.col("words")).alias("sure_words"), F.collect_list(F.when(may, F.struct(F.col("n").alias("n"), odds.alias("odds")))).alias("mixture"))
    per = scratch.keep("mixture", _on_source(per, mixture, hint).withColumn("room", F.col("target") - F.col("sure_words")))
    known = scratch.keep("known", _on_source(classes.select("source", "length", "sure", "p"), per.select("source", "open", "mixture"), hint))
    hint_class = _small(known)  # some twenty rows a source

    def ranked(rows: DataFrame) -> DataFrame:
        """rows with sure, p, rank and bucket."""
        near = hint_class(known.select(F.col("source").alias("_of"), F.col("length").alias("_length"), "sure", "p", "open", "mixture"))
        rows = rows.join(near, F.col("source").eqNullSafe(F.col("_of")) & (length_of(F.col("size")) == F.col("_length"))).drop("_of", "_length")
        rows = rows.withColumn("rank", F.when(may, F.col("u") / (1 - F.col("u")) / odds))
        # documents expected to rank no higher
        upto = F.aggregate("mixture", F.lit(0.0), lambda total, x: total + x["n"] * F.col("rank") * x["odds"] / (1 + F.col("rank") * x["odds"]))
        return rows.withColumn("bucket", F.floor(upto / BUCKET_ROWS).cast("long")).drop("open", "mixture")

    able = scratch.keep("able", ranked(sized).filter("rank is not null and size > 0").select("source", "k", "th", "size", "rank", "bucket"))
    tops = scratch.keep("tops", able.groupBy("source").agg(F.max("bucket").alias("top")))
    state = per.select("source", "room", F.lit(-1).cast("long").alias("from"))
    plan, taken, r = per.select("source", "source_size", "target"), None, 0
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    while True:
        plan = _on_source(plan, state.select("source", F.col("room").alias(f"room{r}"), F.col("from").alias(f"from{r}")), hint, "left")
        # documents that fit at all, by bucket
        sums = _on_source(able, state, hint).filter("bucket > from and size <= room").groupBy("source", "bucket", "room").agg(F.sum("size").alias("words"))
        after = sums.withColumn("upto", upto).filter("upto > room")
        cut = after.groupBy("source").agg(F.min(F.struct("bucket", (F.col("room") - F.col("upto") + F.col("words")).alias("room"))).alias("x")).select("source", "x.bucket", "x.room")
        cut = scratch.keep(f"cut{r}", _on_source(cut, tops, hint).select("source", F.col("bucket").alias("edge"), "room", (F.col("bucket") == F.col("top")).alias("final")))
        plan = _on_source(plan, cut.select("source", F.col("edge").alias(f"edge{r}")), hint, "left")
        if cut.isEmpty():
            break
        edge = _on_source(able, cut, hint).filter("bucket = edge").groupBy("source", "k", "th", "size", "rank", "bucket", "room", "final").agg(F.count("*").alias("m"))
        edge = scratch.keep(f"edge{r}", _fill(edge))
        state = edge.groupBy("source").agg(F.max("left").alias("room"), F.max("bucket").alias("from")).filter("room > 0")
        took = edge.filter("n > 0").select("source", "k", "th", "m", "n")
        taken, r = took if taken is None else taken.unionByName(took), r + 1
    # nothing behind the last edge fits: the smallest, if it comes nearer than to leave it
    rest = _on_source(able, state, hint).filter("bucket > from and size > room and size < 2 * room").groupBy("source", "size", "rank", "th", "k").agg(F.count("*").alias("m"))
    took = rest.groupBy("source").agg(F.min(F.struct("size", "rank", "th", "k", "m")).alias("x")).select("source", "x.k", "x.th", "x.m", F.lit(1).cast("long").alias("n"))
    plan, taken = scratch.keep("plan", plan), scratch.keep("taken", took if taken is None else taken.unionByName(took))
    scratch.drop("sized", "tops", "able", "per", "classes", "mixture", *(f"{x}{i}" for x in ("cut", "edge") for i in range(r + 1)))
    near = _small(taken)  # documents of the edges
    rows = _on_source(ranked(rows), plan, hint)
    picked = near(taken.select(F.col("source").alias("_of"), F.col("k").alias("_k"), F.col("th").alias("_th"), "m", "n"))
    rows = rows.join(picked, F.col("source").eqNullSafe(F.col("_of")) & (F.col("k") == F.col("_k")) & (F.col("th") == F.col("_th")), "left")
    at_edge, inside = F.lit(False), F.lit(False)
    for i in range(r + 1):
        at_edge = at_edge | F.coalesce(F.col(f"edge{i}") == F.col("bucket"), F.lit(False))
        # between two edges, or all that is left
        reached = (F.col("bucket") > F.col(f"from{i}")) & (F.col("size") <= F.col(f"room{i}")) & (F.col(f"edge{i}").isNull() | (F.col("bucket") < F.col(f"edge{i}")))
        inside = inside | F.coalesce(reached, F.lit(False))
    whole = F.when(F.col("size") == 0, 0).when(F.col("n").isNotNull(), F.when(F.col("n") >= F.col("m"), 1).otherwise(0)).when(at_edge, 0).when(inside, 1).otherwise(0)
    names = ["row", "size", "source_size", "target", "p", "sure", "extra"]
    partly = F.coalesce((F.col("n") > 0) & (F.col("n") < F.col("m")), F.lit(False))
    out = rows.filter(~partly).withColumn("extra", whole).select(*names)
    if not taken.filter("n < m").isEmpty():
        # some of the copies of a row: any of them
        place = F.row_number().over(Window.partitionBy("source", "k", "th").orderBy(F.lit(0)))
        out = out.unionByName(rows.filter(partly).withColumn("place", place).withColumn("extra", F.when(F.col("place") <= F.col("n"), 1).otherwise(0)).select(*names))
    copies = F.col("sure") + F.col("extra")
    return out.select("row", "size", "source_size", "target", "p", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 11, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: each row of docs as often as it was sampled, with the columns of docs."""
    rows = sample(docs, docs.columns, share, cap, seed, weights)
    return rows.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
