"""Operator 10, document fingerprints by spot signatures. DataFrame functions only.

Common words are anchors. After each run of anchors the next CHAIN content words, whatever anchors
lie between them, are a signature; so is the chain at the start of a text. Where no anchor comes for
LONG content words, or in the whole text, as in languages without listed anchors, in lists and in
logs, each word of that stretch starts a signature. The fingerprint is the sorted set of their hashes. Fingerprints are compared by Jaccard, and only where the lengths of
the sets allow the threshold: sets are partitioned by length, and a pair of lengths that is too
far apart is never formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Content words of a signature.
CHAIN = 2
#: Content words in a row from which each starts a signature.
LONG = 5
#: Anchors: frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or our she so that the their them then there "
    "they this to was we were what when which who will with would you your "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer es für haben hat ich ihr im ist kann man mit "
    "nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et eux il ils je la le les leur lui mais me même mes ne nos nous on ont ou par pas pour qu que qui sa "
    "se ses son sur ta te tu un une vous "
    "al como con del el ella ellos era esta este fue ha hay la las lo los más mi muy no nosotros para pero por que se sin sobre su sus también todo una unos y ya"
).split()
_MARK = "\u0001"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty string stands at a border without one."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of 32-bit spot signatures of a text.

    A text of fewer content words than a chain has one signature, of all its words; one without
    words has one of its characters; an empty or null text has none."""
    text = F.coalesce(text, F.lit(""))
    anchors = sorted(set(ANCHORS))
    marked = F.transform(words(text), lambda w: F.when(w.isin(anchors), _MARK).when(w == "", "").otherwise(F.concat(w, F.lit(" "))))
    content = f"[^{_MARK} ]+ "

    def of_line(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(f"{_MARK}(?=({f'{_MARK}*'.join([content] * chain)}))"), F.lit(1))
        stretches = F.filter(F.split(line, f"{_MARK}+"), lambda s: s != "")
        long = F.filter(stretches, lambda s: F.char_length(s) - F.char_length(F.translate(s, " ", "")) >= LONG)
        every = F.transform(
            F.when(F.size(stretches) == 1, stretches).otherwise(long), lambda s: F.regexp_extract_all(s, F.lit(f"(?=({content * chain})){content}"), F.lit(1))
        )
        hashes = F.transform(F.concat(found, F.flatten(every)), lambda s: F.hash(F.translate(s, _MARK, "")))
        short = F.when(F.rtrim(F.translate(line, _MARK, "")) != "", F.hash(F.translate(line, _MARK, ""))).otherwise(F.hash(text))
        return F.when(text == "", F.array().cast("array<int>")).when(F.size(hashes) == 0, F.array(short)).otherwise(F.array_sort(F.array_distinct(hashes)))

    # The line is bound as an element so that it is made once.
    return F.transform(F.array(F.concat(F.lit(_MARK), F.array_join(marked, ""))), of_line)[0]


def written(signature_set: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(signature_set.cast("array<string>"), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without counting where the lengths alone rule `least` out.
    Two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    full = common / (F.size(a) + F.size(b) - common)
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(large == 0, 1.0).when(small < least * large, 0.0).when(small == 0, 0.0).otherwise(full).cast("double")


def similar_pairs(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id", sigs: str = "signatures") -> tuple[DataFrame, DataFrame]:
    """Class members (key, class) of equal fingerprints, and pairs (a, b, likeness) of classes.

    A class is named by its least key. Sets are partitioned by length so that partners lie in the
    same or the next partition. A set is looked up by its rarest signatures, as many as must hold
    one that the partner also has among its rarest; what is found is compared in full. Empty
    fingerprints form one class without pairs. Null keys are classed but name no class."""
    prints = prints.select(F.col(key).alias("k"), F.col(sigs).alias("s"))
    classes = prints.groupBy("s").agg(F.min("k").alias("class"))
    members = prints.join(classes, "s").select(F.col("k").alias(key), "class")
    sets = classes.where((F.size("s") > 0) & F.col("class").isNotNull()).withColumn("n", F.size("s"))
    rows = sets.select("class", "n", F.explode("s").alias("x"))
    ranked = rows.join(rows.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1), "x")
    # Signatures of one class only need no look-up but count towards the prefix.
    shared = ranked.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("r"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1 - (F.col("n") - F.size("r"))
    step = -math.log(threshold)
    heads = shared.where(prefix > 0).select("class", "n", F.explode(F.slice("r", F.lit(1), prefix.cast("int"))["x"]).alias("x"))
    heads = heads.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)))
    near = heads.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    a = near.select(F.col("class").alias("a"), F.col("n").alias("na"), "x", "part")
    b = heads.select(F.col("class").alias("b"), F.col("n").alias("nb"), "x", "part")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= F.lit(threshold) * F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = a.join(b, ["x", "part"]).where(fits).select("a", "b").distinct()
    left, right = (sets.select(F.col("class").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    compared = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), threshold))
    return members, compared.where(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def with_next(df: DataFrame, key: str, columns: list[str], span: int = 512) -> DataFrame:
    """Each row with `next_<column>` of the row that follows in descending order of an integer key;
    the first follows the last. Rows of one key are ordered by the columns; a null key is last.

    Rows are sorted within ranges of `span` keys; only the last row of each range looks further,
    for the first row of the next range that has rows."""
    df = df.select(key, *columns, F.shiftright(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))), span.bit_length() - 1).alias("_range"))
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last(key), *columns)
    ranked = df.withColumn("_first", F.lag(F.lit(1)).over(order).isNull()).withColumns({f"next_{c}": F.lead(c).over(order) for c in (key, *columns)}).withColumn("_last", F.lead(F.lit(1)).over(order).isNull())
    ranges = df.select("_range").distinct()
    down = Window.orderBy(F.desc("_range"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = ranges.select("_range", F.coalesce(F.lead("_range").over(down), F.first("_range").over(whole)).alias("_follow"))
    firsts = ranked.where("_first").select(F.col("_range").alias("_follow"), *[F.col(c).alias(f"next_{c}") for c in (key, *columns)])
    inner = ranked.where(~F.col("_last")).drop("_range", "_first", "_last")
    outer = ranked.where("_last").drop(*[f"next_{c}" for c in (key, *columns)]).join(follow, "_range").join(firsts, "_follow")
    return inner.unionByName(outer.select(*inner.columns))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("print", signatures(F.col("text")))
    paired = with_next(docs, "doc_id", ["text", "print"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    paired = paired.withColumn("edited", edited).withColumn("edited_print", signatures(F.col("edited")))
    return paired.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.col("next_doc_id").alias("next_id"),
    )


QUERIES = {"op10_fingerprints": op10_fingerprints}
