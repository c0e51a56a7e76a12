"""Document fingerprints by SpotSigs, with SQL functions only.

A signature is the chain of the ``CHAIN`` content words that follow a common word
(an anchor); further anchors in between are skipped. The start of a text counts as
an anchor, and so does every content word that has ``CHAIN`` or more of them between it and the
last anchor: where anchors are far apart (tables, code, lists, other languages) the
gap is covered word by word. With the text's last ``CHAIN`` content words as one more chain
every content word is in a signature, whatever the text; one shorter than a chain has
one signature of all its content words. A
fingerprint is the sorted set of the signatures' hashes, compared by Jaccard likeness.

``near_pairs`` joins fingerprints at a likeness: sets are partitioned by length (a
pair can only link if the smaller has at least ``threshold`` of the larger's
length, so a set is compared within its own and the next partition), indexed by
the prefix of their signatures in hash order, and pruned by length before the exact
likeness is taken. Equal fingerprints are one class first.

Defined results: null text counts as empty; a text without words has an empty
fingerprint; two empty fingerprints are alike (1), an empty and a non-empty one are
not (0); repeated rows are documents of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisesift.llm.common import query, staged, table

CHAIN = 3
ROWS_PER_RANGE = 2000
# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an the of to in is it and that was for on are with as be by at or this from "
    "le la les de des du un une et en que qui est dans pour par sur au il elle "
    "der die das und ein eine ist von zu mit den nicht im auf für sich dem "
    "el los las y una es por con para se del al no su"
).split()


def _spots(text: Column) -> Column:
    """The text as its words, each with a space before it, anchors written as ``~``."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.regexp_replace(plain, f" (?:{'|'.join(sorted(set(ANCHORS), key=len, reverse=True))})(?= )", " ~")


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of a text's signatures."""
    anchored = rf" ~(?=((?:(?: ~)*+ [^ ~]++){{{CHAIN}}}) )"
    # a word after CHAIN content words in a row, with the chain that it starts
    spaced = rf" (?=[^ ~]++(?: [^ ~]++){{{CHAIN - 1}}}( [^ ~]++(?:(?: ~)*+ [^ ~]++){{{CHAIN - 1}}}) )"

    def hashes(spots: Column) -> Column:
        found = F.concat(F.regexp_extract_all(spots, F.lit(anchored), F.lit(1)), F.regexp_extract_all(spots, F.lit(spaced), F.lit(1)), last(F.trim(F.replace(spots, F.lit(" ~"), F.lit("")))))
        return F.transform(F.array_distinct(found), lambda c: F.xxhash64(F.replace(c, F.lit(" ~"), F.lit(""))))

    def last(content: Column) -> Column:
        return F.when(F.length(content) > 0, F.array(F.concat(F.lit(" "), F.substring_index(content, " ", -CHAIN)))).otherwise(F.array().cast("array<string>"))

    once = F.transform(F.array(F.concat(F.lit(" ~"), _spots(text))), hashes)  # the text is marked once, as the argument
    return F.array_sort(F.array_distinct(F.element_at(once, 1)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``doc_id, class_id`` of every document, and ``a, b, likeness`` of linked classes.

    Classes are equal fingerprints, named by their smallest id; empty ones link with nothing.
    """
    prints = staged(docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col)).alias("sigs")), "prints")
    prints = prints.withColumn("k1", F.xxhash64("sigs")).withColumn("k2", F.xxhash64(F.lit(1), "sigs"))
    classes = staged(prints.where("size(sigs) > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "classes")
    members = prints.join(classes.select("k1", "k2", "class_id"), ["k1", "k2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    # partition p holds lengths [threshold**-p, threshold**-(p+1)): a partner lies in the same one or a neighbour
    sized = classes.select("class_id", F.size("sigs").alias("n"), "sigs").withColumn("part", F.floor(F.log(1 / threshold, F.col("n")) + 1e-9).cast("int"))
    prefix = F.slice("sigs", F.lit(1), F.floor(F.col("n") * (1 - threshold) + 1e-9).cast("int") + 1)
    index = sized.select("class_id", "n", "part", F.explode(prefix).alias("sig"))
    left = index.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = index.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    ordered = "(na < nb OR (na = nb AND a < b)) AND na >= nb * %r - 1e-9" % threshold
    met = staged(left.join(right, ["sig", "part"]).where(ordered).select("a", "b").distinct(), "pairs")
    pairs = met.join(classes.select(F.col("class_id").alias("a"), F.col("sigs").alias("x")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("sigs").alias("y")), "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("x"), F.col("y")).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold - 1e-12)


def with_next(docs: DataFrame, order_col: str, carry: list[str], derived: dict[str, tuple[Callable[[Column], Column], str]] | None = None) -> DataFrame:
    """Add ``next_<c>`` of the following row in descending order (after the last row: the first).

    Rows are cut into ranges of the order column by its approximate quantiles, so
    each range is sorted on its own; a range's last row gets the next range's first.
    ``derived`` names values of a carried column (name: function, column): each is computed once a row, after
    the rows were shuffled to their ranges, and added with its ``next_<name>``.
    """
    derived = derived or {}
    rows = docs.count()
    ranges = max(32, min(100_000, rows // ROWS_PER_RANGE))
    cuts = docs.where(F.col(order_col).isNotNull()).approxQuantile(order_col, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) if rows else []
    cuts = sorted(set(cuts))
    keyed = docs.withColumn("_order", F.col(order_col).cast("double"))
    if cuts:
        splits = [-float("inf"), *cuts, float("inf")]
        keyed = Bucketizer(splits=splits, inputCol="_order", outputCol="_range", handleInvalid="keep").transform(keyed)
        keyed = keyed.withColumn("_range", F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(F.col("_range").cast("int")))
    else:
        keyed = keyed.withColumn("_range", F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    tie = F.xxhash64(*[c for c in carry])
    keyed = keyed.withColumn("_tie", tie).drop("_order")
    # the first row of every range, and the range before it that it follows
    firsts = keyed.groupBy("_range").agg(F.max_by(F.struct(*carry), F.struct(order_col, "_tie")).alias("_first"))
    firsts = staged(firsts, "firsts")
    down = Window.orderBy(F.col("_range").desc())  # one row a range
    follows = firsts.select("_range", F.lead("_range").over(down).alias("_lower"), F.max("_range").over(Window.partitionBy()).alias("_top"))
    follows = follows.select("_range", F.coalesce("_lower", "_top").alias("_next_range"))
    first = F.struct(*[F.col(f"_first.{c}").alias(c) for c in carry], *[fn(F.col(f"_first.{c}")).alias(name) for name, (fn, c) in derived.items()])
    after = follows.join(firsts.select(F.col("_range").alias("_next_range"), first.alias("_first")), "_next_range").select("_range", "_first")
    if derived:
        keyed = keyed.repartition("_range").withColumns({name: fn(F.col(c)) for name, (fn, c) in derived.items()})
    in_range = Window.partitionBy("_range").orderBy(F.col(order_col).desc_nulls_last(), F.col("_tie").desc())
    led = keyed.withColumn("_next", F.lead(F.struct(*carry, *derived)).over(in_range)).join(after, "_range")
    following = [F.when(F.col("_next").isNull(), F.col(f"_first.{c}")).otherwise(F.col(f"_next.{c}")).alias(f"next_{c}") for c in [*carry, *derived]]
    return led.select(*docs.columns, *derived, *following)


@query("op8_spotsigs_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(docs, "doc_id", ["text"], {"f": (signatures, "text")})
    n = F.length("text")
    led = led.withColumn("n_chars", n.cast("long")).withColumn("half", F.floor(n / 2).cast("int"))
    led = led.withColumn("edited", F.concat(F.expr("left(text, n_chars - half)"), F.expr("left(next_text, half)")))
    prints = led.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "f", signatures(F.col("edited")).alias("e"), F.col("next_f").alias("x"),
    )
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("x")).alias("near_next"),
    )
