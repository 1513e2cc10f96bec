"""Fill-in-the-middle: texts cut at two units and put together in another order.

A unit is a run of letters A-Z or any other single character. Units are rows: every text is matched into blocks of
`BLOCK` units, the blocks' lengths are posexploded, and a window sums the lengths of the blocks before each one. The
two cuts of a document are requests for unit ordinals; each joins the block that holds its unit. The offsets go back
to one row per document, where the units of the two blocks give the rest of the way, and substrings give the parts.
Blocks stand for units in the window and the join, so that these take one row per `BLOCK` units and not one per unit.

Where a text is cut depends on its doc_id alone, by the digest of a seed and the id.

Defined results: a null text counts as empty; an empty text, or one that holds a marker, stays plain. A null doc_id
counts as '' in the digest. Rows that are equal in doc_id and text are worked once and returned as often as they occur.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .rules import let

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Units in a row of the window and the join.
BLOCK = 128
#: Markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of the documents that are cut, and of these that begin with their suffix.
CUT, SUFFIX_FIRST = 90, 20
SEED = 1


def blocks(text: Column) -> Column:
    """The text in stretches of BLOCK units, the last one perhaps shorter."""
    return F.regexp_extract_all(text, F.lit(f"((?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}})"), F.lit(1))


def draws(doc_id: Column, n: int, seed: int) -> list[Column]:
    """The first n groups of eight hexadecimal digits of the digest of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def form(text: Column, doc_id: Column, seed: int = SEED) -> Column:
    """plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    _, _, h3, h4 = draws(doc_id, 4, seed)
    held = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when(held | (h3 % 100 >= CUT), "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: rows of equal id and text share a key, the first 16 bytes of a digest of both."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)
    return own.select(F.unhex(F.substring(digest, 1, 32)).alias("key"), "doc_id", "text")


def offsets(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """key, n, form, low and high of each different row of `keyed` docs.

    low and high name, for the ends of prefix and middle, the characters before a block, the block's characters, and the
    units of it that lie before the cut; null where the cut is at the text's start or the form is plain."""
    parts = docs.select("key", "doc_id", form(F.col("text"), F.col("doc_id"), seed).alias("form"), blocks(F.col("text")).alias("b"))
    n = F.when(F.size("b") > 0, BLOCK * (F.size("b") - 1).cast("long") + F.regexp_count(F.element_at("b", -1), F.lit(UNIT))).otherwise(F.lit(0).cast("long"))
    parts = parts.select("key", F.struct("doc_id", "form", F.transform("b", F.char_length).alias("sizes"), n.alias("n")).alias("own"))
    own = stored(parts.groupBy("key").agg(F.first("own").alias("own")).select("key", "own.*"))

    h1, h2 = (h % (F.col("n") + 1) for h in draws(F.col("doc_id"), 2, seed))
    cuts = F.array(F.struct(F.lit("low").alias("cut"), F.least(h1, h2).alias("units")), F.struct(F.lit("high").alias("cut"), F.greatest(h1, h2).alias("units")))
    requests = own.where("form <> 'plain'").select("key", F.inline(cuts)).where("units > 0")
    requests = requests.select("key", "cut", F.floor((F.col("units") - 1) / BLOCK).cast("int").alias("ordinal"), (F.pmod(F.col("units") - 1, F.lit(BLOCK)) + 1).cast("int").alias("units"))

    before = F.sum("size").over(Window.partitionBy("key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    placed = own.where("form <> 'plain'").select("key", F.posexplode("sizes").alias("ordinal", "size")).select("key", "ordinal", F.coalesce(before, F.lit(0)).cast("int").alias("before"), F.col("size").cast("int"))
    found = requests.join(placed, ["key", "ordinal"]).select("key", "cut", F.struct("before", "size", "units").alias("at"))
    found = found.groupBy("key").agg(*(F.max(F.when(F.col("cut") == c, F.col("at"))).alias(c) for c in ("low", "high")))
    return stored(own.select("key", "n", "form").join(found, "key", "left"))


def place(text: Column, at: Column) -> Column:
    """Characters before a cut (0 for null): those before its block, and those of the block's units before it."""
    units = F.slice(F.regexp_extract_all(F.substring(text, at["before"] + 1, at["size"]), F.lit(f"({UNIT})"), F.lit(1)), F.lit(1), at["units"])
    return F.when(at.isNull(), 0).otherwise(at["before"] + F.aggregate(units, F.lit(0), lambda a, x: a + F.char_length(x)))


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars (null: plain) and output of every row of docs(doc_id, text)."""
    rows = keyed(docs)
    texts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    low, high = place(F.col("text"), F.col("low")), place(F.col("text"), F.col("high"))
    cut = texts.join(offsets(rows, seed), "key").select("times", "doc_id", "text", "n", "form", low.alias("a"), high.alias("b"))
    prefix, middle, suffix = F.substring("text", 1, F.col("a")), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")), F.expr("substring(text, b + 1)")
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    held = F.col("form") != "plain"
    done = cut.select("times", "doc_id", "text", "n", "form", F.when(held, F.col("a").cast("long")).alias("prefix_chars"), F.when(held, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"), output.alias("output"))
    return done.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def restore(output: Column, kind: Column) -> Column:
    """The text, from output and form alone: a text that holds a marker is plain, so the three markers part what is between."""
    back = lambda p: F.when(kind == "psm", F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))).otherwise(F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1))))
    return F.when(kind == "plain", output).otherwise(let(F.split(output, "<[PSM]>"), back))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    done = transform(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
