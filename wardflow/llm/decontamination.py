"""Benchmark items that occur in documents, found by fingerprints of item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardflow.llm.common import once, pick, stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Differing bits at which a window is still compared; one more block than bits guarantees that some block is equal.
RADIUS = 20
BITS = 64
#: Stands for a null id while tables are joined.
NO_ID = -(1 << 63)
WHITE_SPACE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Lower-cased words, separated by ASCII white space; an empty array for a text without any."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE_SPACE), "")


def shingles(text: Column, width: int) -> Column:
    """A struct of ``n``, the words of a text, and ``hashes``, one of each run of ``width`` words; of the whole text if it is shorter."""

    def runs(word_list: Column) -> Column:
        n = F.size(word_list)
        last = F.greatest(n - width, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(width)]))
        return F.struct(n.alias("n"), F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>")).alias("hashes"))

    return once(words(text), runs)


def fingerprint(hashes: Column) -> Column:
    """The 64 bits that are set in over half the hashes of an array, repeats included.

    Two bits, 32 apart, are counted at once in the halves of a long.
    """
    half, both = F.lit((1 << 32) - 1).cast("bigint"), F.lit((1 << 32) + 1).cast("bigint")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def majority(found: Column) -> Column:
        def add(bits: Column, place: Column) -> Column:
            count = F.aggregate(found, zero, lambda c, h: c + F.call_function("shiftright", h, place).bitwiseAND(both))
            set_ = lambda n, at: F.when(2 * n > F.size(found), F.call_function("shiftleft", one, at)).otherwise(zero)
            return once(count, lambda c: bits.bitwiseOR(set_(c.bitwiseAND(half), place)).bitwiseOR(set_(F.shiftrightunsigned(c, 32), place + 32)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), zero, add)

    return once(hashes, majority)


def blocks(print_: Column, radius: int) -> Column:
    """The ``radius + 1`` blocks of a fingerprint: two within the radius have at least one of them in common."""
    n = radius + 1
    out = []
    for i in range(n):
        low, high = BITS * i // n, BITS * (i + 1) // n
        value = F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))
        out.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
    return F.explode(F.array(*out))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs of a document and a benchmark item that one of its windows resembles.

    A window has as many words as the item (or is the whole document, if that
    is shorter); windows and items are compared as multisets of the hashes of
    their word shingles, by the sum of the smaller counts over the sum of the
    larger ones.

    1. Windows: a window that shares no shingle with an item of its size
       cannot resemble it, and moving a window to its first shared shingle
       does not lose any. So windows begin at the places of shared shingles,
       found by an equi join of hashes, or end with the document.
    2. Candidates: windows and items get SimHash fingerprints, cut into
       ``radius + 1`` blocks; an equi join on size, block and its value meets
       every item within the radius.
    3. The candidates' shingles are compared exactly.

    Returns ``doc_id, item_id, similarity, start_word, n_words``, the most
    similar and then first window for each pair at ``similarity`` or more.

    * null and empty texts, and items of fewer words than a shingle has (which
      are one shingle), resemble only what equals them; texts without words
      resemble nothing.
    * rows with a null id are compared and keep their null; repeated rows give
      one pair.
    * an empty table on either side gives an empty result.
    """
    items = (
        pick(benchmark, "item_id", "text")
        .select("item_id", F.xxhash64("item_id", "text").alias("item"), shingles(F.col("text"), width).alias("x"))
        .select("item_id", "item", F.col("x.n").alias("m"), F.col("x.hashes").alias("hashes"))
        .filter("m > 0").dropDuplicates(["item"])
    )
    item_prints = stored(items.select("*", F.size("hashes").alias("item_span"), fingerprint(F.col("hashes")).alias("item_print")))
    item_counts = stored(item_prints.select("item", "m", F.explode("hashes").alias("h")).groupBy("item", "m", "h").agg(F.count("*").alias("wanted")))
    sized = item_counts.select("m", "h").distinct()
    # A document is known by its id and a hash of its text; only hashes of shared shingles are kept of the first reading.
    base = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("doc"), "text")
    split = base.select("id", "doc", F.explode(F.array(shingles(F.col("text"), width))).alias("x"))
    places = split.select("id", "doc", F.col("x.n").alias("n"), F.posexplode("x.hashes").alias("p", "h"))
    shared = stored(places.join(sized.select("h").distinct(), "h").distinct())

    # Windows begin at a shared shingle of an item of their size, or end with the document.
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    span = F.greatest(F.least("n", "m") - F.lit(width - 1), F.lit(1))  # shingles of a window
    windows = shared.join(sized, "h").select("id", "doc", "m", F.least("p", last).alias("s"), span.alias("span")).distinct()

    # The text of those documents is read again for all shingles of a window. The merge join is
    # asked for, as which documents have windows grows with the corpus: what is shuffled then does, too.
    again = base.join(shared.select("id", "doc").distinct().hint("merge"), ["id", "doc"]).dropDuplicates(["id", "doc"])
    arrays = again.select("id", "doc", shingles(F.col("text"), width)["hashes"].alias("hashes"))
    within = windows.join(arrays, ["id", "doc"]).select("id", "doc", "m", "s", "span", F.slice("hashes", F.col("s") + 1, F.col("span")).alias("hashes"))
    content = stored(within.select("*", fingerprint(F.col("hashes")).alias("print")))
    window_prints = content.drop("hashes")
    left = window_prints.select("*", blocks(F.col("print"), radius).alias("b")).select("*", "b.block", "b.value").drop("b")
    right = item_prints.drop("hashes").select("*", blocks(F.col("item_print"), radius).alias("b")).select("*", "b.block", "b.value").drop("b")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius
    candidates = stored(left.join(right, ["m", "block", "value"]).filter(near).select("id", "doc", "m", "s", "span", "item", "item_id", "item_span").distinct())

    counted = (
        candidates.select("id", "doc", "m", "s").distinct().join(content, ["id", "doc", "m", "s"]).select("id", "doc", "m", "s", F.explode("hashes").alias("h"))
        .groupBy("id", "doc", "m", "s", "h").agg(F.count("*").alias("found"))
    )
    common = (
        candidates.join(counted, ["id", "doc", "m", "s"])
        .join(item_counts.select("item", "h", "wanted"), ["item", "h"])
        .groupBy("id", "doc", "item_id", "item", "m", "s", "span", "item_span").agg(F.sum(F.least("found", "wanted")).alias("same"))
    )
    score = F.col("same") / (F.col("span") + F.col("item_span") - F.col("same"))
    alike = common.withColumn("similarity", score).filter(F.col("similarity") >= similarity)
    best = alike.groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"), "m")).alias("x"))
    return best.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("item_id").cast("long").alias("item_id"), F.col("x.similarity").alias("similarity"),
        (-F.col("x.s")).cast("long").alias("start_word"), F.col("x.m").cast("long").alias("n_words"),
    )
