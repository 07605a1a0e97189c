"""Benchmark decontamination: SimHash fingerprints of item-sized windows, looked up by Hamming blocks.

Native: DataFrame functions only. A window of a document has the length in words of a benchmark item.
Windows that share no word shingle with any item can't be similar to one, so only windows in which a
shingle of an item of that length stands where it stands in the item are fingerprinted. That is
found while the text is scanned, by a hash join with blocks of the items' shingles, and moves no
text. The 64-bit fingerprints are then compared as 4 blocks of 16 bits: within radius 15, one block
differs in at most 3 bits, so the items' blocks with up to 3 bits changed meet every window within the
radius. Candidates are verified by the weighted Jaccard similarity of their shingles (weight: number
of occurrences).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.session import materialize

#: Words of a shingle; similarity of a leak.
SHINGLE, THRESHOLD = 5, 0.8
#: Hamming radius, in 4 blocks of 16 bits.
RADIUS, BLOCKS, BITS = 15, 4, 16
#: Longer items are cut into parts of so many words, the last of which reaches back.
PART = 256
#: Rows of items' shingles that are broadcast at once; more are joined in further blocks.
BROADCAST_ROWS = 500_000
#: Up to so many items (of ``PART`` words at most) are broadcast to the verification; more are joined by a shuffle.
BROADCAST_ITEMS = 5_000
_LANES = 0x0001000100010001


def text_words(text: str) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + j) for j in range(k)])


def _shingles(words: str, k: int) -> Column:
    """Hashes of all shingles; the whole sequence is the only one of fewer words."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(words, i, k))


def simhash(words: str) -> Column:
    """64 bits: for each, whether more of the words' hashes have it than not. Up to 32,767 words.

    Four 16-bit counters share a long, so 16 sums over the words count all 64 bits.
    """
    hashes = F.transform(F.col(words), lambda w: F.xxhash64(w))
    half = F.size(words) / 2
    out = F.lit(0).cast("long")

    def sums(j: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)))

    for j in range(BITS):
        counts = sums(j)
        for lane in range(BLOCKS):
            count = F.shiftrightunsigned(counts, BITS * lane).bitwiseAND(F.lit(0xFFFF))
            bit = F.when(count > half, F.shiftleft(F.lit(1).cast("long"), BITS * lane + j)).otherwise(F.lit(0).cast("long"))
            out = out.bitwiseOR(bit)
    return out


def _block(fingerprint: str, b: int) -> Column:
    return F.shiftrightunsigned(F.col(fingerprint), BITS * b).bitwiseAND(F.lit(0xFFFF)).cast("int")


def item_parts(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n_words, k) of items, or of parts of long ones; without those that have no word."""
    words = benchmark.select("item_id", text_words("text").alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - PART, F.lit(0))
    begin = F.explode(F.array_union(F.sequence(F.lit(0), last, F.lit(PART)), F.array(last)))
    parts = words.select("item_id", "all", begin.alias("begin"))
    parts = parts.select("item_id", F.slice("all", F.col("begin") + 1, F.lit(PART)).alias("words")).distinct()
    return parts.withColumn("n_words", F.size("words")).withColumn("k", F.least("n_words", F.lit(SHINGLE)))


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, start, n_words, words) of windows in which an item's shingle stands in its place."""
    texts = docs.select("doc_id", text_words("text").alias("all"))
    sizes = {r["k"]: r["n"] for r in items.groupBy("k").agg(F.sum(F.col("n_words") - F.col("k") + 1).alias("n")).collect()}
    found = []
    for k, total in sorted(sizes.items()):  # at most SHINGLE values
        at = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_words") - k), lambda i: _shingle("words", i, k)))
        seeds = items.where(F.col("k") == k).select("n_words", at.alias("offset", "seed")).distinct()
        places = texts.where(F.size("all") >= k).select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.size("all") - k)).alias("at"))
        places = places.select("doc_id", "all", "at", _shingle("all", F.col("at"), k).alias("seed"))
        blocks = -(-total // BROADCAST_ROWS)
        for b in range(blocks):
            here = F.broadcast(seeds.where(F.pmod("seed", F.lit(blocks)) == b))
            start = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
            hit = places.join(here, "seed").select("doc_id", start.alias("start"), "n_words", "all")
            found.append(hit.select("doc_id", "start", "n_words", F.slice("all", F.col("start") + 1, F.col("n_words")).alias("words")))
    out = found[0] if found else texts.where("false").select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.col("all").alias("words"))
    for other in found[1:]:
        out = out.union(other)
    return out.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) of each document and item that it holds.

    The best window of the item's size (ties: the first) whose weighted shingle similarity is at
    least ``threshold``. Null, empty or wordless texts hold nothing and are held by nothing. Items
    shorter than a shingle match as whole sequences. Repeated rows count once; rows without doc_id
    or item_id are compared like others and give null ids. Other columns are ignored.
    """
    items = item_parts(benchmark.select("item_id", "text")).withColumn("print", simhash("words"))
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    windows = _windows(docs.select("doc_id", "text"), items.drop("print", "item")).withColumn("print", simhash("words"))
    windows = materialize(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    masks = [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS), n)]
    masks = F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")  # 697 values
    each = F.posexplode(F.array(*[_block("print", b) for b in range(BLOCKS)])).alias("block", "value")
    index = items.select("item", "n_words", F.col("print").alias("item_print"), each).select("*", masks)
    index = index.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    looked = windows.select("window", "n_words", "print", each)
    # the planner doesn't see how many rows the masks make, so it must not choose to broadcast them
    pairs = looked.join(index.hint("shuffle_merge"), ["n_words", "block", "value"])
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    close = [F.bit_count(F.shiftrightunsigned(differ, BITS * b).bitwiseAND(F.lit(0xFFFF))) <= RADIUS // BLOCKS for b in range(BLOCKS)]
    # a pair that meets in several blocks is kept in the first of them
    first = F.coalesce(*[F.when(c, F.lit(b)) for b, c in enumerate(close)])
    pairs = pairs.where((F.bit_count(differ) <= RADIUS) & (F.col("block") == first)).select("window", "item")
    pairs = pairs.join(windows.select("window", "doc_id", "start", "n_words", "words"), "window")
    own = items.select("item", "item_id", "k", F.col("words").alias("item_words"))
    pairs = pairs.join(F.broadcast(own) if items.count() <= BROADCAST_ITEMS else own, "item")
    result = []
    for k in range(1, SHINGLE + 1):
        result.append(F.when(F.col("k") == k, F.struct(_shingles("words", k).alias("a"), _shingles("item_words", k).alias("b"))))
    pairs = pairs.select("doc_id", "item_id", "start", "n_words", F.coalesce(*result).alias("s"))
    times = lambda side, x: F.size(F.filter(F.col(f"s.{side}"), lambda y: y == x))
    both = F.aggregate(F.array_intersect("s.a", "s.b"), F.lit(0), lambda n, x: n + F.least(times("a", x), times("b", x)))
    pairs = pairs.select("doc_id", "item_id", "start", "n_words", both.alias("both"), (F.size("s.a") + F.size("s.b")).alias("sum"))
    similarity = (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity")
    good = pairs.select("doc_id", "item_id", "start", "n_words", similarity).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best")
    out = good.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("best.back")).alias("start_word"), "best.n_words", "best.similarity")
