"""SimHash fingerprints [native]: weighted term hashes vote on signed bits; permuted block tables find all near fingerprints.

A term is a word with the next word; each occurrence votes, so frequent terms weigh more. Of 128 bits, two 64-bit hashes vote in pairs of
counters: sum((h >>> i) & (1 + 2^32)) counts bit i in its low half and bit i + 32 in its high half, without overflow up to 2^32 terms.
The sums are plain aggregates over exploded terms, grouped by the document within the partition it is in, so they need no shuffle.

The next document in descending order of doc_id comes from range buckets: the id range is cut into 1,024 cells, each cell into parts of
about sqrt(rows) / 4 rows, and within a bucket a window sees the next row. An id that more rows than that have, null above all, is cut
further by a hash of the text, which is also what orders its rows. Each bucket also gets, as a last row, a copy of the first row of the
bucket after it. So one shuffle moves the texts, whatever the number of documents.

Fingerprints within RADIUS bits of each other agree on one of RADIUS + 1 blocks of bits at least, so each is in RADIUS + 1 tables, keyed by
a block. A table's entries of one value are kept in chunks (arrays), and a search looks at a chunk as one row: it reads all fingerprints
that share a block with the sought one, counts those within the radius that no earlier table has shown, and makes no row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readgrain.llm.common import BLANK, documents, materialise

BLANKS = " \t\n\x0b\x0c\r"
CELLS = 1024
#: Bits that near fingerprints may differ in; entries of a table that share a block's value are in chunks of about CHUNK.
RADIUS, CHUNK = 3, 256
#: Searches are for the fingerprints of documents whose id is divisible by this.
SOUGHT = 20
PAIR = 4294967297
LOW = 4294967295


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK}]+"))


def terms(text: Column) -> Column:
    """Hashes of the terms of a text: each word with the next (the last word alone)."""
    w = words(text)
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def votes(h: Column) -> list[Column]:
    """64 sums of vote pairs over hashes h; name v0 ... v63."""
    other = F.xxhash64(h, F.lit(1))
    return [F.sum(F.shiftrightunsigned(x, i).bitwiseAND(F.lit(PAIR))).alias(f"v{32 * k + i}") for k, x in enumerate((h, other)) for i in range(32)]


def bits(k: int, n: Column) -> Column:
    """The 64 signed bits of the k-th half as a long: bit set where more than half of n terms vote for it."""
    out = None
    for i in range(32):
        v = F.coalesce(F.col(f"v{32 * k + i}"), F.lit(0))
        for b, count in ((i, v.bitwiseAND(F.lit(LOW))), (i + 32, F.shiftrightunsigned(v, 32))):
            one = F.when(count * 2 > n, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0))
            out = one if out is None else out.bitwiseOR(one)
    return F.when(n > 0, out).otherwise(0).cast("long")


def buckets(docs: DataFrame) -> Column:
    """An expression from doc_id and h (a hash of the text) to a bucket that ascends in the order of documents (ids descend, nulls last, then h ascends), about sqrt(rows) / 4 rows in each.

    A bucket is (b, s, p): b from the id's cell, s and p only where ids with very many rows are. What reaches the driver is one row per
    cell, CELLS at most, and one per such id, 4 sqrt(rows) at most.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    most = max(64, int(n**0.5 / 4))
    # of ids with more rows than a bucket should have: their rows
    heavy = {r[0]: r[1] for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()}
    share = (F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 1).cast("double")) / F.lit(float(2**63))
    bucket = lambda b, s, p: F.struct(b.cast("long").alias("b"), s.cast("long").alias("s"), p.cast("long").alias("p"))
    nulls = bucket(F.lit(2**62), F.lit(0), F.floor(share * -(-heavy.get(None, 1) // most)))
    if low is None:
        return nulls
    width = -(-(high - low + 1) // CELLS)
    cell = F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)).cast("int") if high - low < 2**52 else F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("int")
    cell = F.least(F.greatest(cell, F.lit(0)), F.lit(CELLS - 1))
    found = {r[0]: r[1:] for r in docs.filter(F.col("doc_id").isNotNull()).groupBy(cell.alias("c")).agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).collect()}
    first, starts, widths, at = 0, [], [], []
    for c in range(CELLS):
        rows, a, b = found.get(c, (0, low, low))
        parts = max(1, -(-rows // most))
        starts.append(a)
        widths.append(-(-(b - a + 1) // parts))
        at.append(first)
        first += parts
    # one literal, folded to an array before anything runs
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    pick = lambda xs: F.element_at(array(xs), cell + 1)
    b, s, p = -(pick(at) + F.floor((F.col("doc_id") - pick(starts)) / pick(widths)).cast("long")), F.lit(0), F.lit(0)
    if many := sorted(k for k in heavy if k is not None):
        own = F.array_position(array(many), F.col("doc_id"))
        s = 2 * F.size(F.filter(array(many), lambda x: x > F.col("doc_id"))) + (own > 0).cast("int")
        p = F.when(own > 0, F.floor(share * F.element_at(array([-(-heavy[k] // most) for k in many]), F.greatest(own, F.lit(1)).cast("int")))).otherwise(0)
    return F.when(F.col("doc_id").isNull(), nulls).otherwise(bucket(b, s, p))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, near_edited, near_next, and the fingerprints as longs: a and b of the text, ea and eb of the edited text; a row per row.

    A null text is empty; the fingerprint of a text without words is 0. Equal texts have equal fingerprints. Rows of one doc_id follow
    each other by a hash of their text. A single document is its own next. Null ids come after all others. Very long texts are read
    whole. An empty table gives no rows. Other columns aren't read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumns({"h": F.xxhash64("text"), "tail": F.lit(0)})
    rows = rows.withColumn("bucket", buckets(rows))
    # the first row of each bucket, as the last row of the bucket before it
    null = F.lit(-(2**63))
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", null).alias("i"), F.bitwise_not("h").alias("h"))).alias("top"))
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(whole)).alias("to"), F.col("top.i").alias("i"), F.bitwise_not("top.h").alias("th"))
    heads = materialise(heads, "simhash-heads")
    # about 4 sqrt(rows) + CELLS heads of 40 bytes; beyond two million the join is left to the planner
    heads = F.broadcast(heads) if heads.count() <= 2_000_000 else heads
    found = rows.join(heads, (F.coalesce("doc_id", null) == F.col("i")) & (F.col("h") == F.col("th"))).dropDuplicates(["to"])
    ends = found.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("to").alias("bucket"), F.lit(0).cast("long").alias("h"), F.lit(1).alias("tail"))
    by = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").desc_nulls_last(), "h")
    n, m = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    near = rows.select(*ends.columns).unionByName(ends).withColumns({"rn": F.row_number().over(by), "next": F.coalesce(F.lead("text").over(by), F.lit(""))})
    near = near.withColumn("edited", F.when(F.col("tail") == 0, F.concat(F.substring("text", F.lit(1), n - m), F.substring("next", F.lit(1), m))).otherwise(F.lit("")))
    near = near.select("bucket", "rn", "tail", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "t"))
    keys = ["bucket", "rn", "tail", "doc_id", "n_chars", "edited_sha256"]
    each = near.select(*keys, "which", F.explode_outer(terms(F.col("t"))).alias("term"))
    sums = each.groupBy(*keys, "which").agg(F.count("term").alias("n"), *votes(F.col("term")))
    prints = sums.select(*keys, "which", bits(0, F.col("n")).alias("a"), bits(1, F.col("n")).alias("b"))
    of = lambda c, k: F.max(F.when(F.col("which") == k, F.col(c)))
    both = prints.groupBy(*keys).agg(of("a", 0).alias("a"), of("b", 0).alias("b"), of("a", 1).alias("ea"), of("b", 1).alias("eb"))
    step = Window.partitionBy("bucket").orderBy("rn")
    both = both.withColumns({"na": F.lead("a").over(step), "nb": F.lead("b").over(step)}).filter("tail = 0")
    return both.select("doc_id", "n_chars", "edited_sha256", likeness("a", "b", "ea", "eb").alias("near_edited"), likeness("a", "b", "na", "nb").alias("near_next"), "a", "b", "ea", "eb")


def as_text(a: str, b: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in (a, b)])


def likeness(a: str, b: str, c: str, d: str) -> Column:
    apart = F.bit_count(F.col(a).bitwiseXOR(F.col(c))) + F.bit_count(F.col(b).bitwiseXOR(F.col(d)))
    return F.lit(1.0) - apart / F.lit(128.0)


def masks(radius: int) -> list[tuple[int, int]]:
    """The 128 bits in radius + 1 blocks: of each the bits in the first and in the second long."""
    cuts = [128 * i // (radius + 1) for i in range(radius + 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        bits = ((1 << high) - 1) ^ ((1 << low) - 1)
        out.append((signed(bits & (2**64 - 1)), signed(bits >> 64)))
    return out


def tables(prints: DataFrame, radius: int) -> DataFrame:
    """The permuted tables of distinct fingerprints (a, b): t (table), x and y (the bits of its block), a and b."""
    block = [F.struct(F.lit(t).alias("t"), F.col("a").bitwiseAND(F.lit(p)).alias("x"), F.col("b").bitwiseAND(F.lit(q)).alias("y")) for t, (p, q) in enumerate(masks(radius))]
    return prints.select("a", "b", F.explode(F.array(*block)).alias("k")).select("k.*", "a", "b")


def count_near(prints: DataFrame, sought: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """sought (distinct fingerprints a, b; none null) with n_near: how many other distinct fingerprints of prints are at most `radius` bits away.

    Exact, whatever the number of fingerprints that share a block: values with more than a chunk of them are dealt to as many chunks by a
    hash, and the searches for such a value to its chunks. An empty table gives no rows.
    """
    every = tables(prints.select("a", "b").distinct(), radius)
    every = materialise(every, "simhash-tables")
    full = every.groupBy("t", "x", "y").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select("t", "x", "y", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("parts"))
    full = materialise(full, "simhash-full")
    on, parts = ["t", "x", "y"], F.coalesce("parts", F.lit(1))
    chunks = every.join(full, on, "left").withColumn("c", F.pmod(F.xxhash64("a", "b"), parts).cast("int"))
    chunks = chunks.groupBy(*on, "c").agg(F.collect_list(F.struct("a", "b")).alias("held"))
    asked = tables(sought, radius).join(full, on, "left").withColumn("c", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = asked.join(chunks, [*on, "c"])

    def shown(t: int) -> Column:
        """How many of a chunk's are within the radius and in none of the tables before the t-th."""

        def fine(e: Column) -> Column:
            p, q = e["a"].bitwiseXOR(F.col("a")), e["b"].bitwiseXOR(F.col("b"))
            near = F.bit_count(p) + F.bit_count(q) <= radius
            for x, y in masks(radius)[:t]:
                near = near & ((p.bitwiseAND(F.lit(x)) != 0) | (q.bitwiseAND(F.lit(y)) != 0))
            return near

        return F.size(F.filter("held", fine))

    n = F.lit(0)
    for t in range(radius + 1):
        n = F.when(F.col("t") == t, shown(t)).otherwise(n)
    # each fingerprint finds itself in the first table, if it is there
    own = sought.join(prints.select("a", "b").distinct().withColumn("own", F.lit(1)), ["a", "b"], "left")
    found = met.groupBy("a", "b").agg(F.sum(n).alias("n"))
    return own.join(found, ["a", "b"], "left").select("a", "b", (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).cast("long").alias("n_near"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: for documents whose id is divisible by SOUGHT, the number of other fingerprints within RADIUS bits among those of all documents (else null)."""
    rows = materialise(fingerprints(documents(spark, sf_dir)), "simhash-prints")
    asked = F.coalesce(F.col("doc_id") % SOUGHT == 0, F.lit(False))
    near = count_near(rows, rows.filter(asked).select("a", "b").distinct())
    near = materialise(near.select(F.col("a").alias("na"), F.col("b").alias("nb"), "n_near"), "simhash-near")
    found = rows.filter(asked).join(near, (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb")))
    out = lambda df, n: df.select("doc_id", "n_chars", "edited_sha256", as_text("a", "b").alias("fingerprint"), as_text("ea", "eb").alias("edited_fingerprint"), "near_edited", "near_next", n.alias("n_near"))
    return out(found, F.col("n_near")).unionByName(out(rows.filter(~asked), F.lit(None).cast("long")))
