"""Personal data by fixed patterns and bootstrapped contexts, in DataFrame functions only.

Seeds are the valid matches of four base patterns (e-mail, IP address, card, phone), leftmost and non-overlapping by
kind, and of a fifth one, secrets assigned to a name like token or key. An occurrence of a seed or of another
identifier-like token (with a digit or an @, of a shape that some kind allows) has up to four lexical patterns: the
word before it, the two words before it, the word after it, and the words on both sides. Patterns and instances form a
graph, on which scores are iterated. A pattern is supported by the different seeds and trusted instances it was met
with, and is as reliable as the share of seeds and trust among its occurrences; an unseen instance is trusted as much
as its supported patterns are reliable on average, and then supports and induces patterns that no seed was met
with. After `ROUNDS` rounds instances trusted by `RELIABLE` or more are discovered. An instance takes the kind, of
those its shape allows, whose seeds its patterns were met with most (the first allowed one if with none of any kind). Base matches always stay; what is discovered
never overlaps one.

Null texts are empty. A null doc_id is kept. Rows that repeat doc_id and text each get the same spans and count
once. Starts and ends count code points. Contexts are the whole words next to an occurrence, however long. All steps
take time in proportion to the text. An empty table has no rows; columns of docs may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, read, text_or_empty

#: The base kinds as they are listed, and all kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The base patterns. Possessive quantifiers and look-behinds change no match: they keep time linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z0-9+/_=-])(?=[a-z0-9+/_=-]{20})(?<=(?:token|key|secret|passw(?:or)?d|pwd)[\"']{0,1}\x20{0,2}[:=]\x20{0,2}[\"']{0,1})(?=[a-z+/_=-]*+[0-9])[a-z0-9+/_=-]++",
}
#: What a text must hold for a pattern to match at all.
CUES = {"email": "@", "ip": "\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){15}", "phone": "\\+[0-9]", "secret": "(?i)token|key|secret|passw|pwd"}
CANDIDATE = r"(?<!\S)(?=\S*[0-9@])\S++(?:\x20[(]?[0-9][0-9().-]*+)*+"
MIN_SUPPORT, RELIABLE, ROUNDS = 3, 0.6, 4
LEAST_ID = -(2**63)
SPAN = "struct<kind:int,start:int,end:int>"


def matches(pattern: str) -> Column:
    """Array of (gap, found, left, right) of the pattern's matches in text.

    gap: the characters since the match before; left and right: the last two words of that gap and the first word of
    the next one, in lower case, of letters, digits (as #), = and : only.
    """
    found, gaps = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)), F.split(F.col("text"), pattern, -1)

    def context(gap: Column) -> Column:
        plain = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(gap), r"[^\p{L}\p{N}=:]++", " "), "[0-9]", "#"))
        return F.struct(F.length(gap).alias("gap"), F.regexp_extract(plain, r"(?<!\S)(?:\S++ )?+\S++$", 0).alias("left"), F.regexp_extract(plain, r"^\S++", 0).alias("right"))

    around = F.transform(gaps, context)
    each = F.zip_with(found, F.slice(around, 1, F.size(found)), lambda m, c: F.struct(m.alias("found"), c.alias("c")))
    return F.zip_with(each, F.slice(around, 2, F.size(found)), lambda m, c: F.struct(m["c"]["gap"].alias("gap"), m["found"].alias("found"), m["c"]["left"].alias("left"), c["right"].alias("right")))


def luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind in ("email", "secret"):
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def allowed(found: Column) -> Column:
    """The kinds whose shape an unseen instance has, as an array of numbers."""
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    shapes = [
        found.rlike(r"^[^\s@]++@[^\s@]++$"),
        found.rlike(r"^[0-9]{1,4}(?:\.[0-9]{1,4}){3}$") | found.rlike(r"^(?i)(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}$"),
        found.rlike(r"^[0-9][0-9\x20-]*+$") & digits.between(12, 19),
        found.rlike(r"^[+(0-9][0-9()\x20./-]*+$") & digits.between(7, 15),
        found.rlike(r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+$"),
    ]
    return F.filter(F.array(*[F.when(s, F.lit(k)) for k, s in enumerate(shapes)]), lambda k: k.isNotNull())


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _id and _h, which tell a row's text."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)), "_h": F.xxhash64(text_or_empty())})


def occurrences(docs: DataFrame) -> DataFrame:
    """One row a seed or identifier-like token: id, h, kind (null: unseen), start, end, found, patterns."""
    none = F.expr("cast(array() as array<struct<gap:int,found:string,left:string,right:string>>)")
    rows = keyed(docs.select("doc_id", text_or_empty().alias("text"))).select(F.col("_id").alias("id"), F.col("_h").alias("h"), "text").filter(F.col("text").rlike("[0-9@]"))
    sets = [F.when(F.col("text").rlike(CUES[kind]), matches(PATTERNS[kind])).otherwise(none) for kind in KINDS]
    each = rows.select("id", "h", F.posexplode(F.array(*sets, matches(CANDIDATE))).alias("k", "m")).select("id", "h", "k", F.posexplode("m").alias("place", "m"))
    # rows that repeat doc_id and text are one; a document's matches meet in one task, never its text
    each = each.select("id", "h", "k", "place", "m.*").dropDuplicates(["id", "h", "k", "place"]).repartition("id", "h")
    end = F.sum(F.col("gap") + F.length("found")).over(Window.partitionBy("id", "h", "k").orderBy("place")).cast("int")
    at = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("found"))

    bare = F.regexp_extract("found", r"(?s)[\p{L}0-9+(@].*", 0)
    core = F.regexp_extract(bare, r"(?s)^.*[\p{L}0-9)]", 0)
    unseen = F.col("k") == len(KINDS)
    shift = F.when(unseen, F.length("found") - F.length(bare)).otherwise(0)
    cut_to = at.select("id", "h", F.when(~unseen, F.col("k")).alias("kind"), (F.col("start") + shift).alias("start"), F.when(unseen, core).otherwise(F.col("found")).alias("found"), "left", "right").withColumn("end", F.col("start") + F.length("found"))
    good = reduce(lambda x, y: x | y, [(F.col("kind") == k) & valid(kind, F.col("found")) for k, kind in enumerate(KINDS)])
    spans = cut_to.filter(F.when(F.col("kind").isNull(), F.size(allowed(F.col("found"))) > 0).otherwise(good))

    # an unseen one that a seed overlaps goes: the furthest end of seeds before it, and the next seed's start after it
    by = Window.partitionBy("id", "h")
    until = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    since = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(by.orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    free = spans.withColumns({"until": until, "since": since}).filter(F.col("kind").isNotNull() | (F.coalesce(F.col("until"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("since"), F.col("end")) >= F.col("end")))

    one = F.regexp_extract("left", r"\S++$", 0)
    before, after, two = one != "", F.col("right") != "", F.col("left").contains(" ")
    patterns = F.array(F.when(two, F.concat(F.lit("LL "), "left")), F.when(before, F.concat(F.lit("L "), one)), F.when(after, F.concat(F.lit("R "), "right")), F.when(before & after, F.concat(F.lit("B "), one, F.lit(" "), "right")))
    return free.select("id", "h", "kind", "start", "end", "found", F.array_compact(patterns).alias("patterns"))


def discoveries(found: DataFrame) -> DataFrame:
    """(id, h, kind, start, end) of the unseen instances that come to be trusted."""
    each = found.select("kind", "found", F.explode("patterns").alias("pattern"))
    edges = cut(each.groupBy("kind", "found", "pattern").agg(F.count(F.lit(1)).alias("n")))
    seed = F.col("kind").isNotNull()
    # what seeds give a pattern doesn't change: occurrences, different seeds, and occurrences of each kind
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(len(KINDS))]
    patterns = cut(edges.groupBy("pattern").agg(F.sum("n").alias("n_all"), F.sum(F.when(seed, F.col("n")).otherwise(0)).alias("n_seed"), F.count(F.when(seed, 1)).alias("seeds"), *by_kind))
    unseen = edges.filter(~seed).select("found", "pattern", "n")
    gains = None
    for _ in range(ROUNDS):
        known = patterns if gains is None else patterns.join(gains, "pattern", "left")
        gain, more = (F.lit(0.0), F.lit(0)) if gains is None else (F.coalesce("gain", F.lit(0.0)), F.coalesce("more", F.lit(0)))
        scores = known.filter(F.col("seeds") + more >= MIN_SUPPORT).select("pattern", ((F.col("n_seed") + gain) / F.col("n_all")).alias("score"))
        trust = cut(unseen.join(scores, "pattern").groupBy("found").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("trust")))
        sums = unseen.join(trust, "found").groupBy("pattern").agg(F.sum(F.col("n") * F.col("trust")).alias("gain"), F.count(F.when(F.col("trust") >= RELIABLE, 1)).alias("more"))
        gains = sums.filter("more > 0 or gain > 0")
    trusted = trust.filter(F.col("trust") >= RELIABLE).select("found")
    masses = unseen.join(trusted, "found", "left_semi").join(patterns, "pattern").groupBy("found").agg(*[F.sum(F.col("n") * F.col(f"k{k}")).alias(f"k{k}") for k in range(len(KINDS))])
    # patterns that no seed was met with leave the kind to the shape
    counts = F.array(*[F.col(f"k{j}") for j in range(len(KINDS))])
    unmet = F.forall(counts, lambda n: n == 0)
    fit = F.filter(F.transform(allowed(F.col("found")), lambda k: F.struct(F.get(counts, k).alias("mass"), (-k).alias("least"))), lambda x: unmet | (x["mass"] > 0))
    taken = cut(masses.select("found", (-F.array_max(fit)["least"]).alias("kind")).filter("kind is not null"))
    return found.filter("kind is null").drop("kind").join(taken, "found").select("id", "h", "kind", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """id, h, base and spans (arrays of kind, start, end by kind and start) of each text of docs (doc_id, text) with any."""
    found = cut(occurrences(docs))
    seeds = found.filter("kind is not null").select("id", "h", "kind", "start", "end")
    span = F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")
    every = seeds.withColumn("seed", F.lit(True)).unionByName(discoveries(found).withColumn("seed", F.lit(False)))
    own = F.col("seed") & (F.col("kind") < len(BASE))
    return every.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.when(own, span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the longest first one counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        taken = s["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], -s["last"]).alias("at"), F.when(taken, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    whole = F.aggregate(by_start, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(F.col(text))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind; other columns as they were.

    Only texts that may hold a span move.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    plain = docs.toDF(*names)
    marked = plain.withColumns({"_id": F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.lit(LEAST_ID)), "_h": F.xxhash64(text_or_empty(text))})
    some = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    found = find(docs.select("doc_id", "text")).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    changed = marked.filter(some).join(found, ["_id", "_h"], "left").withColumn(text, F.when(F.col("_spans").isNotNull(), redacted(text, "_spans")).otherwise(F.col(text)))
    return changed.select(names).union(plain.filter(~some)).toDF(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the base spans of every document, and all spans."""
    docs = keyed(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("_id").alias("id"), F.col("_h").alias("h"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = docs.join(find(read(spark, sf_dir, "documents")), ["id", "h"], "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(as_text("base"), "UTF-8"), 256).alias("base_sha256"), as_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_more")
    )
