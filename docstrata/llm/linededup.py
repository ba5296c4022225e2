"""Line dedup by an exact set-similarity join (operator 7), with DataFrame functions only.

After Xiao et al., "Efficient Similarity Joins for Near-Duplicate Detection" (PPJoin, 2011), and
the bitmap filter of Sandes et al. (2020).  A line's tokens are its shingles of ``width`` words (all
words, if fewer); words are what stands between white space.  Two lines match at Jaccard 0.75 or
more, and the later one, by (doc_id, line number), is removed.

* Prefix filter: two similar sets share a token among their first ``n - ceil(0.75 n) + 1`` in any one
  order of all tokens.  The order is by rarity: tokens that few prefixes hold come first, by their
  hash; those that more than ``HOT`` hold come last, by how many (in quarter octaves).  Which are hot shows only once prefixes
  in hash order are counted, exactly, over all lines; lines with a hot token in their prefix get
  another one then.  A pair whose prefixes share a token that isn't hot meets there; any
  other similar pair shares a hot one, so both of its lines have the second prefix and meet in that.
* Tokens in one prefix only can't join, and lines with no others are settled at once.
* Lines with equal sets form a class, of which the first line stands; only classes are joined.
* Length, positional and bitmap filters prune inside the join; full sets verify.
* Stars first: each line meets a few early lines of each of its tokens, and those that match are
  decided.  Only the others meet every earlier line, so a large group of near-equal lines doesn't
  make all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import documents, dropped, written

WORDS = 5
#: Tokens that more classes than this hold in their prefixes come last in the order.
HOT = 32
#: Lines of a token that all its others meet first: the earliest of each of so many parts.
PIVOTS = 8
#: Buckets of token hashes in which hot tokens are marked; a token beside a hot one comes late, too.
BUCKETS = 1 << 20
#: Tokens with more rows than this in a 64th of the documents skip the window that counts rows.
HEAVY = 512
#: Up to so many bytes of line numbers are broadcast to the texts; beyond, the texts are shuffled.
FEW_BYTES = 64 << 20


def _spaced(text: Column) -> Column:
    """White space other than line ends as blanks."""
    odd = F.lit(False)
    for c in "\t\r\x0b\f":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, "\t\r\x0b\f", "    ")).otherwise(text)


def _lines(docs: DataFrame) -> DataFrame:
    # The outer form, since for the other one the optimizer adds a filter that evaluates the array again.
    lines = F.posexplode_outer(F.split(_spaced(F.col("text")), "\n", -1)).alias("line_no", "line")
    return docs.select("doc_id", lines).filter(F.trim("line") != "")


def _coded(lines: DataFrame, width: int) -> DataFrame:
    """``line`` becomes ``codes``: the sorted hashes of its distinct tokens.

    A token's hash is put together from those of runs of one, two, four ... words, each of which is
    made once for all tokens that have it.
    """
    words = F.transform(F.split("line", " ", -1), lambda w: F.xxhash64(w))
    out = lines.withColumn("words", words).withColumn("words", F.array_remove("words", F.xxhash64(F.lit(""))))
    n = F.size("words")
    enough = n >= width

    def beside(left: str, right: str, shift: int) -> Column:
        """Runs at ``i`` and ``i + shift`` as one; those beyond the line's end are cut off below."""
        return F.zip_with(left, F.slice(right, shift + 1, n), lambda x, y: F.xxhash64(x, y))

    runs, size = {1: "words"}, 1
    while 2 * size <= width:
        runs[2 * size] = f"runs_{2 * size}"
        out = out.withColumn(runs[2 * size], F.when(enough, beside(runs[size], runs[size], size)))
        size *= 2
    made, used = runs[size], list(runs.values())[1:]
    for part in sorted(runs, reverse=True):
        if size + part <= width:
            out = out.withColumn(f"made_{size + part}", F.when(enough, beside(made, runs[part], size)))
            size, made = size + part, f"made_{size + part}"
            used.append(made)
    codes = F.when(enough, F.slice(made, 1, n - width + 1)).otherwise(F.array(F.xxhash64("words", n)))
    return out.withColumn("codes", F.sort_array(F.array_distinct(codes))).drop("words", "line", *used)


def _prefix_size(n: Column) -> Column:
    return n - F.ceil(n * 3 / 4).cast("int") + 1


def _parity(codes: str, word: int) -> Column:
    """64 bits, each the parity of the codes that fall on it; two words of bits in all."""
    own = lambda x: F.when(F.shiftright(x, 6).bitwiseAND(F.lit(1)) == word, F.expr("1L")).otherwise(F.expr("0L"))
    return F.aggregate(codes, F.expr("0L"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", own(x), x.bitwiseAND(F.lit(63)).cast("int"))))


def _least(x: str, y: str) -> Column:
    """The least overlap of ``x`` and ``y`` at Jaccard 3/4."""
    return F.floor((3 * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 6) / 7)


def _fitting(x: str, y: str) -> Column:
    """Length and positional filters for a shared token of rows ``x`` and ``y``."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    place = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) >= _least(x, y)
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & place


def _may_match(x: str, y: str) -> Column:
    """Length, positional and bitmap filters for a shared token of rows ``x`` and ``y``."""
    differ = F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1"))) + F.bit_count(F.col(f"{x}.b2").bitwiseXOR(F.col(f"{y}.b2")))
    return _fitting(x, y) & (differ <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * _least(x, y))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("x.c").alias("late"), F.col("y.c").alias("early")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The late lines of pairs whose full token sets reach the threshold."""
    one, two = (sets.select(F.col("c").alias(side), F.col("codes").alias(f"s_{side}")) for side in ("late", "early"))
    both = pairs.join(one, "late").join(two, "early")
    both = both.withColumn("common", F.size(F.array_intersect("s_late", "s_early")))
    both = both.filter(4 * F.col("common") >= 3 * (F.size("s_late") + F.size("s_early") - F.col("common")))
    return both.select("late").distinct()


def _fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _beside(docs: DataFrame, numbers: DataFrame, column: str, how: str) -> DataFrame:
    """``docs`` joined with one array of line numbers per document; the arrays are broadcast if their size is bounded."""
    size = numbers.agg(F.sum(F.size(column) * 4 + 32).alias("bytes")).first()["bytes"] or 0
    key = _fresh(docs, "key")
    numbers = numbers.withColumnRenamed("doc_id", key)
    return docs.join(F.broadcast(numbers) if size <= FEW_BYTES else numbers, docs["doc_id"].cast("long").eqNullSafe(numbers[key]), how).drop(key)


def _class_sets(docs: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """``(c, codes, n, b1, b2)`` of the classes in ``index``, read from the texts again."""
    wanted = index.select("c").distinct()
    numbers = written(wanted.groupBy("c.doc_id").agg(F.collect_set("c.line_no").alias("wanted")), "wanted-lines")
    split = F.posexplode_outer(F.split(_spaced(F.col("text")), "\n", -1)).alias("line_no", "line")
    own = _beside(docs, numbers, "wanted", "inner").select("doc_id", "wanted", split).filter(F.array_contains("wanted", F.col("line_no"))).drop("wanted")
    sets = _coded(own, width).withColumn("c", F.struct("doc_id", "line_no", F.xxhash64("codes").alias("k1")))
    # A doc_id may have several texts, of which one is meant; without any such, no line comes twice.
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        sets = sets.join(wanted, "c", "left_semi").dropDuplicates(["c"])
    out = written(sets.select("c", "codes", F.size("codes").alias("n"), _parity("codes", 0).alias("b1"), _parity("codes", 1).alias("b2")), "line-sets")
    dropped(numbers)
    return out


def _shared(rows: DataFrame, least: int = 2) -> DataFrame:
    """``rows(token, c, ...)`` whose token has at least two classes, with their number ``held``."""
    held = rows.groupBy("token").agg(F.count("*").alias("held")).filter(F.col("held") >= least)
    return rows.join(held, "token")


def _hot_order(index: DataFrame) -> DataFrame:
    """One row with one array: by bucket of tokens the size class of its hottest one, 0 where none is hot."""
    some = index.filter(F.col("held") > HOT).groupBy(F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"))
    classes = some.agg(F.max(F.floor(4 * F.log2("held")).cast("tinyint")).alias("c"))
    filled = index.sparkSession.range(BUCKETS).select(F.col("id").alias("b")).join(classes, "b", "left")
    ordered = F.sort_array(F.collect_list(F.struct("b", F.coalesce("c", F.lit(0).cast("tinyint")).alias("c"))))
    return filled.agg(F.transform(ordered, lambda x: x["c"]).alias("classes"))


def _prefixes(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, line_no, n, k1, k2, prefix)`` of all lines: set size, digest, least token, and the prefix in hash order."""
    n = F.size("codes")
    return _coded(_lines(docs), width).select("doc_id", "line_no", n.alias("n"), F.xxhash64("codes").alias("k1"), F.get("codes", F.lit(0)).alias("k2"), F.slice("codes", 1, _prefix_size(n)).alias("prefix"))


def _heavy(lines: DataFrame) -> DataFrame:
    """``(token, heavy)``: tokens that fill a window of their own, by a count over one document in 64.

    Their rows are spread and pass the count unseen; which tokens these are changes no result.
    """
    some = lines.filter(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).select(F.explode_outer("prefix").alias("token"))
    held = some.groupBy("token").count().filter(F.col("count") > HEAVY)
    return held.orderBy(F.desc("count"), "token").limit(1 << 16).select("token", F.lit(True).alias("heavy"))


def removed_lines(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``(doc_id, gone)``: the sorted numbers of the lines that match an earlier one, for documents that have any."""
    own = documents(docs)
    lines = written(_prefixes(own, width), "lines")
    heavy = written(_heavy(lines), "heavy")
    # Size and place as one number: these rows are by far the most, and sorted.
    rows = lines.select("k1", F.col("n").cast("long").alias("n"), F.posexplode_outer("prefix").alias("pos", "token"))
    rows = rows.select("k1", "token", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at")).join(F.broadcast(heavy), "token", "left")
    # One number, which sorts faster than two: a heavy token's rows have a key each.  Rows that share a key by chance are kept, no more.
    rows = rows.select("k1", "at", F.when(F.col("heavy"), F.col("token")).alias("hot"), F.when(F.col("heavy"), F.xxhash64("token", "k1")).otherwise(F.col("token")).alias("key"))
    window = Window.partitionBy("key")
    rows = rows.select("*", F.min("k1").over(window).alias("low"), F.max("k1").over(window).alias("high")).filter("hot is not null or low <> high")
    rows = written(rows.select(F.coalesce("hot", "key").alias("token"), "k1", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos")), "prefix-rows")

    # Equal sets have equal digests, sizes and least tokens; the first line stands for its class.
    classes = lines.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "line_no", "k1")).alias("c"), F.count("*").alias("held"))
    classes = written(classes, "line-classes")
    # Equal sets count once.  Rows that fit no other of their token by length and position go.
    index = written(_shared(rows.distinct()), "index")
    x, y = index.filter(F.col("held") <= HOT).alias("x"), index.alias("y")
    cold = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.k1") != F.col("y.k1")) & _fitting("x", "y"), "left_semi")
    fitting = cold.unionByName(index.filter(F.col("held") > HOT)).drop("n")
    met = written(fitting.join(classes.select("k1", "c", "n"), "k1").drop("k1"), "met")
    dropped(rows, index)
    sets = _class_sets(own, met, width)

    order = written(_hot_order(met), "order")
    again = sets.join(met.filter(F.col("held") > HOT).select("c").distinct(), "c").withColumn("order", order.scalar())
    code = lambda t: F.shiftleft(F.get("order", t.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 56).bitwiseOR(t.bitwiseAND(F.lit((1 << 56) - 1)))
    # Apart from the rows it makes: in one step with them, a copy of the whole order would go with every line.
    again = again.select("c", F.slice(F.sort_array(F.transform("codes", code)), 1, _prefix_size(F.col("n"))).alias("prefix"))
    again = again.select("c", F.posexplode_outer("prefix").alias("pos", "token"))
    again = written(again.withColumn("token", F.xxhash64("token", F.lit(1))), "again")
    both = met.filter(F.col("held") <= HOT).select("token", "c", "pos").union(_shared(again).select("token", "c", "pos"))
    both = both.join(sets.select("c", "n", "b1", "b2").hint("merge"), "c").select("token", F.struct("c", "n", "pos", "b1", "b2").alias("x"))
    last, met = met, written(both, "candidates")
    dropped(last, order, again)

    pivots = met.groupBy("token", F.pmod(F.xxhash64("x.c"), F.lit(PIVOTS))).agg(F.min("x").alias("y"))
    later = F.col("x.c") > F.col("y.c")
    stars = written(_pairs(met.join(pivots, "token").filter(later & _may_match("x", "y"))), "stars")
    matched = written(_verified(stars, sets), "matched")
    open_rows = met.withColumn("late", F.col("x.c")).join(matched, "late", "left_anti").select("token", "x")
    rest = _pairs(open_rows.join(met.select("token", F.col("x").alias("y")), "token").filter(later & _may_match("x", "y")))
    rest = written(rest.join(stars, ["late", "early"], "left_anti"), "rest")
    gone = matched.union(_verified(rest, sets)).withColumnRenamed("late", "c").withColumn("matched", F.lit(True))

    ends = classes.join(gone, "c", "left").filter("matched or held > 1").drop("held")
    named = lines.drop("prefix").join(ends, ["k1", "k2", "n"])
    again = ~(named["doc_id"].eqNullSafe(F.col("c.doc_id")) & (named["line_no"] == F.col("c.line_no")))
    out = named.filter(F.coalesce("matched", F.lit(False)) | again)
    out = written(out.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "removed-lines")
    dropped(heavy, lines, classes, sets, met, stars, matched, rest)
    return out


def without(docs: DataFrame, gone: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without the lines that ``gone(doc_id, gone)`` names; ``drop_emptied`` drops rows that lose all their words."""
    numbers, new_text = _fresh(docs, "gone"), _fresh(docs, "new_text")
    joined = _beside(docs, gone.withColumnRenamed("gone", numbers), numbers, "left")
    stays = F.filter(F.split(docs["text"], "\n", -1), lambda line, i: ~F.array_contains(numbers, i))
    lost = F.col(numbers).isNotNull()
    joined = joined.withColumn(new_text, F.when(lost, F.array_join(stays, "\n")))
    if drop_emptied:
        words = lambda text: F.trim(F.translate(_spaced(text), "\n", " ")) != ""
        joined = joined.filter(~lost | docs["text"].isNull() | words(F.col(new_text)) | ~words(docs["text"]))
    text = F.when(lost, F.col(new_text)).otherwise(docs["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, docs[c]).alias(c) for c in docs.columns))


def line_dedup(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``docs`` with all columns, ``text`` without the lines that match an earlier one, and ``n_chars``, if there, new.

    Lines without words stay.  Null text stays null; a text whose lines all go becomes empty.  Rows
    with one doc_id count as one document: repeated rows lose the same lines, by number.  Nulls in
    doc_id count as one document that comes first.
    """
    return without(docs, removed_lines(docs, width))


def line_report(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed_lines)`` for every row; null text has no lines."""
    gone = removed_lines(docs, width)
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    own = documents(docs).select("doc_id", F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"))
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return _beside(own, gone, "gone", "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))
