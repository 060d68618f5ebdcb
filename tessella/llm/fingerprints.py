"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words, weighted by how often each comes. A draw of a term of weight w takes r and c from
Gamma(2, 1) and b from [0, 1), all hashed from the term and the draw; with t = floor(ln w / r + b) it ranks as
ln c - r * (t - b + 1), and the term of least rank is the sample. Two documents agree in a sample with a
probability that equals the generalised Jaccard similarity of their weights. Each of 64 draws is over all terms
of the document, so the share of equal samples estimates that similarity whatever the weights. The least rank names
its term and t, so a sample is kept as 16 bits of its hash.

Words are runs without ASCII white space, as written. A text without words, null included, has the fingerprint
"empty": like every other such text (1), unlike all else (0). A null doc_id sorts as the least long. Rows that
repeat doc_id and text are one document in the order of documents and each get the same row; rows that repeat
only doc_id are ordered by a hash of their texts. A single document is its own next. No rows give no rows. A long
text is sampled whole; only its words move between tasks with it, never a list of them through the driver. Other
columns of docs are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, read, text_or_empty

#: Draws of each document, each over all its terms.
SAMPLES = 64
LEAST_ID = -(2**63)


def uniform(h: Column, bits: int) -> Column:
    """A number in (0, 1) from 20 bits of h."""
    return (F.shiftrightunsigned(h, bits).bitwiseAND(0xFFFFF).cast("double") + 0.5) * (1 / 2**20)


def ranks(term: Column, draw: Column, *logs: Column) -> list[Column]:
    """The term's rank in a draw for each logarithm of a weight (null for no weight); all share r, c and b."""
    h = F.xxhash64(term, draw)
    g = F.xxhash64(h)
    r = -F.log(uniform(h, 0) * uniform(h, 20))
    log_c = F.log(-F.log(uniform(g, 0) * uniform(g, 20)))
    b = uniform(h, 40)
    return [log_c - r * (F.floor(x / r + b).cast("double") - b + 1.0) for x in logs]


def fingerprints(texts: DataFrame, keys: list[str], variants: dict[str, list[int]]) -> DataFrame:
    """keys and a sketch (array<bigint>, four 16-bit samples each; null without words) for each variant.

    texts: keys and parts, an array of arrays of words; a variant is the bag of all words of some parts. If texts
    are partitioned by some of the keys, no row moves.
    """
    words = texts.select(*keys, F.posexplode("parts").alias("part", "words")).select(*keys, "part", F.explode("words").alias("word")).filter("word <> ''")
    weights = {v: F.sum(F.when(F.col("part").isin(parts), 1).otherwise(0)).alias(v) for v, parts in variants.items()}
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*weights.values())
    # the logarithm of 0 is null, and a null rank is never the least
    logs = terms.select(*keys, "term", *[F.log(F.col(v).cast("double")).alias(v) for v in variants])
    # four draws a row, whose samples make one number: the few expressions of a row stay in compiled code
    grouped = logs.withColumn("four", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // 4 - 1))))
    least = [F.min(x).alias(f"{v}{k}") for k in range(4) for v, x in zip(variants, ranks(F.col("term"), F.col("four") * 4 + k, *map(F.col, variants)))]
    drawn = grouped.groupBy(*keys, "four").agg(*least)

    def packed(v: str) -> Column:
        lanes = [F.shiftleft(1 + F.pmod(F.xxhash64(f"{v}{k}"), F.lit(65535)), 16 * k) for k in range(4)]
        return F.when(F.col(f"{v}0").isNotNull(), sum(lanes[1:], lanes[0])).alias(v)

    def sketch(v: str) -> Column:
        return F.when(F.max(v).isNotNull(), F.array(*[F.max(F.when(F.col("four") == k, F.col(v))) for k in range(SAMPLES // 4)])).alias(v)

    return drawn.select(*keys, "four", *map(packed, variants)).groupBy(*keys).agg(*map(sketch, variants))


def as_text(sketch: str) -> Column:
    return F.coalesce(F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit("empty"))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples among those that either has."""

    def lanes(sketch: str) -> Column:
        return F.flatten(F.transform(sketch, lambda x: F.array(*[F.shiftrightunsigned(x, 16 * i).bitwiseAND(0xFFFF) for i in range(4)])))

    kinds = F.zip_with(lanes(a), lanes(b), lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1).otherwise(2))
    same, used = F.size(F.filter(kinds, lambda e: e == 1)), F.size(F.filter(kinds, lambda e: e > 0))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same / used)


def next_keys(ids: DataFrame) -> DataFrame:
    """(id, h, n, next_id, next_h): for each distinct (id, h) the next one in order; after the last the first.

    Ranges of ids are ordered side by side; only the first key of each range meets in one task.
    """
    ranges = cut(ids.select("id", "h", "n").dropDuplicates(["id", "h"]).repartitionByRange("id", "h").withColumn("range", F.spark_partition_id()))
    first = ranges.groupBy("range").agg(F.min(F.struct("id", "h")).alias("first"))
    across = Window.orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = first.select("range", F.coalesce(F.lead("first").over(across), F.first("first").over(whole)).alias("after"))
    inside = F.lead(F.struct("id", "h")).over(Window.partitionBy("range").orderBy("id", "h"))
    found = ranges.withColumn("next", inside).join(F.broadcast(starts), "range")  # one row a range
    following = F.coalesce("next", "after")
    return found.select("id", "h", "n", following["id"].alias("next_id"), following["h"].alias("next_h"))


def compare_with_next(docs: DataFrame, share: int = 16 << 20) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses (see op5).

    A document's text moves once, to where about `share` bytes of other texts are, and the beginning that its
    predecessor takes of it a second time.
    """
    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), F.col("doc_id").isNull().alias("no_id"))
    ids = cut(rows.groupBy("id", "h", "no_id").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n"), F.max(F.octet_length("text")).alias("bytes")))
    most, size = ids.agg(F.max("copies"), F.sum("bytes")).first()
    repeated = (most or 0) > 1
    parts = min(50_000, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // share))
    one = (rows.dropDuplicates(["id", "h"]) if repeated else rows).select("id", "h", "text").repartition(parts, "id", "h")
    order = cut(next_keys(ids))
    before = order.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("prev_id"), F.col("h").alias("prev_h"), F.floor(F.col("n") / 2).cast("int").alias("take"))
    placed = one.join(before, ["id", "h"])
    after = placed.select(F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("take")).alias("end")).repartition(parts, "id", "h")
    n = F.length("text")
    kept = n - F.floor(n / 2).cast("int")
    both = one.join(after, ["id", "h"]).select("id", "h", "text", "end", n.alias("n"), F.substring(F.col("text"), F.lit(1), kept).alias("begin"), F.substring(F.col("text"), kept + 1, n).alias("rest"))
    # parts: words that both texts begin with, then the other words of the text and of the edited one
    split = lambda x: F.split(x, "[\\x20\\x09-\\x0D]+")
    at_edge = F.element_at(split(F.col("begin")), -1)
    common = F.slice(split(F.col("begin")), 1, F.size(split(F.col("begin"))) - 1)
    bags = both.select("id", "h", F.array(common, split(F.concat(at_edge, "rest")), split(F.concat(at_edge, "end"))).alias("parts"))
    sketches = fingerprints(bags, ["id", "h"], {"own": [0, 1], "changed": [0, 2]})
    facts = both.select("id", "h", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode(F.concat("begin", "end"), "UTF-8"), 256).alias("edited_sha256"))
    found = cut(facts.join(sketches, ["id", "h"], "left"))
    following = order.select("id", "h", "next_id", "next_h").join(found.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("own").alias("following")), ["next_id", "next_h"])
    out = found.join(following, ["id", "h"])
    if repeated:
        out = out.join(ids.select("id", "h", "copies"), ["id", "h"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    doc_id = F.when(F.col("id") != LEAST_ID, F.col("id"))
    return out.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its text edited with the next document's, and how near they are."""
    return compare_with_next(read(spark, sf_dir, "documents"))
