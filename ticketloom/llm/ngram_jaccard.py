"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

Two sets with Jaccard similarity t or more differ in at most H = (|A| + |B|) (1 - t) / (1 + t)
n-grams. So if the n-gram columns are dealt into more than H blocks by hash, the two rows agree
entirely in at least one column block. That bound, with H from a size interval, leaves as candidates
only cells of the product whose rows share an equal non-empty block (small sets: a prefix column).
Columns that a sample shows in sets of very different sizes (lines and passages that many texts
share) are left out of the blocks: leaving columns out can only hide differences, so the bound holds
for any choice of them, and the choice only keeps clusters of unlike sets small.
Candidates fall into clusters; a cluster's rows are multiplied in row blocks, overlap counts are
accumulated cell by cell, and cells below the bound that the two sizes give are discarded. The join
is exact up to equal 64-bit hashes: no list of partners is capped.

Rows with equal sets are one row of the matrix. Only stars leave a task: a block emits for each row
one link to the least row of its local component, so a group of k copies makes about k rows.

What is written grows with the input: a cluster of several blocks is cut by size interval and hash,
each block is written once, and a Cartesian product that reads the written blocks pairs those of the
same or adjacent intervals. The keys of the column blocks, most of what is shuffled, go without the
bits that their bucket tells, and their owners as the last 48 bits of the set's hash. Shortened ones
can only add candidates, and the product judges all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import bitmaps
from ticketloom.llm import text_arrays as ta
from ticketloom.llm.graphs import components
from ticketloom.session import cut_lineage, free_shuffles, materialize

#: Rows of one block of the product.
BLOCK_ROWS = 512
#: Keys that a map task gathers before it passes them on, and of one reducer group.
FLUSH_KEYS, GROUP_KEYS = 1 << 19, 1 << 19
#: Bytes of a key inside its bucket and of a set's name, of the 8 that both have.
KEY_BYTES, NAME_BYTES = 5, 6
#: Bytes of blocks that a task of the product reads from each side, and links it gathers before it reduces them to stars.
PRODUCT_BYTES, FLUSH_LINKS = 8 << 20, 1 << 20
#: Sets smaller than this are compared by prefix columns.
SMALL = 17
#: Sets sampled for common columns, and the most columns that are taken for common.
SAMPLE, COMMON = 8192, 1 << 20
#: Common columns are in so many sampled sets, and in sets so many size intervals apart.
COMMON_SETS, COMMON_SPREAD = 3, 3
_LARGEST = 1 << 40


def size_intervals(t: Fraction) -> list[tuple[int, int, int, int]]:
    """(least, greatest size, column blocks, spare blocks) of each size interval.

    Sets of similarity ``t`` are in the same or in adjacent intervals. ``blocks`` counts, for the
    interval and the one below it, the differences allowed, one more, and the spare blocks, which
    cover blocks that are empty in a row. Blocks are 0 where only equal sets are similar, and -1
    where prefixes are used.
    """
    out, low, below = [], 1, 1
    while low < _LARGEST:
        high = max(low, math.floor(low / t))
        differ = math.floor(2 * high * (1 - t) / (1 + t))
        if differ == 0:
            out.append((low, high, 0, 0))
        elif below < SMALL:
            out.append((low, high, -1, 0))
        else:
            spare = 0
            for _ in range(20):
                empty = (differ + 1 + spare) * math.exp(-below / (differ + 1 + spare))
                spare = math.ceil(empty + 3 * math.sqrt(empty))
            out.append((low, high, differ + 1 + spare, spare))
        below, low = low, high + 1
    return out


def _rows(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, set members, offsets) of groups of rows."""
    data, offsets = ta.column_bytes(batch.column("text"))
    for first, last in ta.row_groups(offsets):
        at = offsets[first : last + 1] - offsets[first]
        value, row, _, _ = ta.words(data[offsets[first] : offsets[last]], at)
        members, owner = ta.shingle_sets(value, row, n, last - first)
        yield first, last, members, ta.starts_of(owner, last - first)


def _set_hash(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    size = np.diff(offsets)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(members ^ np.uint64(0x5BD1E995)))]).astype(np.uint64)
    other = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(members ^ np.uint64(0x1B873593)))]).astype(np.uint64)
    a, b = sums[offsets[1:]] - sums[offsets[:-1]], other[offsets[1:]] - other[offsets[:-1]]
    return ta.mix(ta.mix(a) + b * np.uint64(3) + size.astype(np.uint64))


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set) of each row; set is the hash of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, members, offsets in _rows(batch, n):
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(first, last - first),
                        "n_shingles": np.diff(offsets),
                        "set": _set_hash(members, offsets).view(np.int64),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set long")


def _common_columns(docs: DataFrame, n: int, total: int, intervals: list) -> np.ndarray:
    """Columns of sampled sets that belong to sets of very different sizes, ascending."""
    share = max(1, total // SAMPLE)
    lows = np.array([x[0] for x in intervals], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, members, offsets in _rows(batch, n):
                size = np.diff(offsets)
                name = _set_hash(members, offsets)
                _, once = np.unique(name, return_index=True)
                taken = np.zeros(size.size, bool)
                taken[once] = ta.mix(name[once]) % np.uint64(share) == 0
                place = np.repeat(np.searchsorted(lows, size, "right") - 1, size)
                keep = np.repeat(taken, size)
                yield pa.record_batch({"column": members[keep].view(np.int64), "place": place[keep].astype(np.int32)})

    counted = docs.select("text").mapInArrow(run, "column long, place int").groupBy("column")
    counted = counted.agg(F.count("*").alias("n"), (F.max("place") - F.min("place")).alias("spread"))
    common = counted.where((F.col("n") >= COMMON_SETS) & (F.col("spread") >= COMMON_SPREAD)).orderBy(F.desc("n"), "column").limit(COMMON)
    found = common.select("column").toPandas()["column"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _keys(members, offsets, owner, intervals, t: Fraction, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, owner) of the rows: one key for each column block or prefix column."""
    size = np.diff(offsets)
    at = np.searchsorted(common, members).clip(max=max(common.size - 1, 0))
    is_common = common[at] == members if common.size else np.zeros(members.size, bool)
    lows = np.array([x[0] for x in intervals], np.int64)
    home = np.searchsorted(lows, size, "right") - 1
    keys, owners = [], []
    for step in (0, 1):
        which = home + step
        for k in np.unique(which[size > 0]):
            _, _, blocks, spare = intervals[k]
            rows = np.flatnonzero((which == k) & (size > 0))
            if blocks == 0:
                continue
            counts = size[rows]
            taken = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            local = np.repeat(np.arange(rows.size), counts)
            value = members[taken]
            salt = ta.mix(np.array([k], np.uint64))[0]
            if blocks < 0:
                # the order of columns is: rare ones by hash, then common ones by hash
                order = np.lexsort((value, is_common[taken], local))
                value = value[order]
                rank = np.arange(value.size) - np.repeat(np.cumsum(counts) - counts, counts)
                need = counts - -(-counts * t.numerator // t.denominator) + 1
                front = rank < need[local]
                keys.append(ta.mix(value[front] ^ salt))
                owners.append(owner[rows[local[front]]])
                continue
            rare = ~is_common[taken]
            local, value = local[rare], value[rare]
            cell = local * blocks + (ta.mix(value ^ np.uint64(0xC2B2AE35)) % np.uint64(blocks)).astype(np.int64)
            sums = np.zeros(rows.size * blocks, np.uint64)
            np.add.at(sums, cell, ta.mix(value))
            filled = np.bincount(cell, minlength=sums.size) > 0
            block = np.flatnonzero(filled) % blocks
            keys.append(ta.mix(sums[filled] ^ ta.mix(block.astype(np.uint64) + salt)))
            owners.append(owner[rows[np.flatnonzero(filled) // blocks]])
            # two rows with more empty blocks than spare ones might agree in empty blocks alone
            thin = rows[blocks - filled.reshape(rows.size, blocks).sum(1) > spare]
            keys.append(np.full(thin.size, ta.mix(salt + np.array([1 << 40], np.uint64))[0]))
            owners.append(owner[thin])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _stars(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct links of each owner to the least owner of the same key; and that owner per key."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    head = np.ones(keys.size, bool)
    head[1:] = keys[1:] != keys[:-1]
    least = owners[head][np.cumsum(head) - 1]
    far = owners != least
    a, b = owners[far], least[far]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(a.size, bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh], keys[head], owners[head]


def _shortened(values: np.ndarray, width: int) -> np.ndarray:
    """The last ``width`` bytes of 64-bit values, as rows of bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _read(blobs: pa.ChunkedArray, width: int) -> np.ndarray:
    """What ``_shortened`` left of the values."""
    short = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, width)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :width] = short
    return out.view("<u8").ravel()


def short_name(name: str) -> Column:
    """What names a set in the candidate links. Sets with equal short names are candidates of each other and of the same sets."""
    return F.col(name).bitwiseAND(F.lit((1 << 8 * NAME_BYTES) - 1))


_LINKS = "bucket int, linked boolean, a binary, b binary"


def _links(docs: DataFrame, n: int, t: Fraction, total: int, n_sets: int) -> DataFrame:
    """Candidate links (a, b) between short names of sets: stars over the rows of each key."""
    intervals = size_intervals(t)
    seen = docs.sparkSession.sparkContext.broadcast(_common_columns(docs, n, n_sets, intervals))
    conf = docs.sparkSession.conf
    groups = max(4 * int(conf.get("spark.sql.shuffle.partitions")), total // GROUP_KEYS, 1)
    key_bytes, name_bytes = KEY_BYTES, NAME_BYTES

    def pack(linked, a, b):
        rest, bucket = np.divmod(a.view(np.uint64), np.uint64(groups))
        order = np.argsort(bucket, kind="stable")
        a, b, bucket = (a if linked else rest)[order], b[order], bucket[order].astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        blobs = lambda x, width: pa.array([part.tobytes() for part in np.split(_shortened(x, width), cut)] if x.size else [], pa.binary())
        return pa.record_batch(
            {
                "bucket": pa.array(bucket[np.concatenate([[0], cut])] if a.size else [], pa.int32()),
                "linked": pa.array([linked] * (cut.size + 1 if a.size else 0), pa.bool_()),
                "a": blobs(a, name_bytes if linked else key_bytes),
                "b": blobs(b, name_bytes),
            }
        )

    def flush(keys, owners):
        a, b, key, least = _stars(np.concatenate(keys), np.concatenate(owners))
        yield pack(True, a, b)
        order = np.lexsort((key, least))  # repeated owners lie together and compress
        yield pack(False, key[order].view(np.int64), least[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in batches:
            for _, _, members, offsets in _rows(batch, n):
                key, owner = _keys(members, offsets, _set_hash(members, offsets).view(np.int64), intervals, t, seen.value)
                keys.append(key)
                owners.append(owner)
                held += key.size
                if held > FLUSH_KEYS:
                    yield from flush(keys, owners)
                    keys, owners, held = [], [], 0
        if held:
            yield from flush(keys, owners)

    def meet(group: pa.Table) -> pa.Table:
        known = group.filter(group["linked"])
        rest = group.filter(pa.compute.invert(group["linked"]))
        a, b, _, _ = _stars(_read(rest["a"], key_bytes), _read(rest["b"], name_bytes))
        a, b = np.concatenate([a, _read(known["a"], name_bytes)]), np.concatenate([b, _read(known["b"], name_bytes)])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    packed = docs.select("text").mapInArrow(run, _LINKS)
    return packed.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def overlaps(members: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Overlap counts of all row pairs: the product of the incidence matrix and its transpose."""
    order = np.lexsort((rows, members))
    members, rows = members[order], rows[order]
    counts = np.zeros(n_rows * n_rows, np.int64)
    step = 1
    while True:
        same = np.flatnonzero(members[step:] == members[:-step]) if step < members.size else np.zeros(0, np.int64)
        if not same.size:
            return counts.reshape(n_rows, n_rows)
        counts += np.bincount(rows[same] * n_rows + rows[same + step], minlength=counts.size)
        step += 1


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each row's component over links inside one block."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def _alike(name: np.ndarray, parts: list[np.ndarray], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links of some rows: each with the least one that it reaches among them."""
    name, first = np.unique(name, return_index=True)
    parts = [parts[i] for i in first]
    size = np.array([x.size for x in parts], np.int64)
    members, rows = np.concatenate(parts), np.repeat(np.arange(name.size), size)
    order = np.argsort(members, kind="stable")
    alone = np.ones(members.size, bool)
    equal = members[order][1:] == members[order][:-1]
    alone[order[1:][equal]] = False
    alone[order[:-1][equal]] = False
    shared = overlaps(members[~alone], rows[~alone], name.size)
    a, b = np.nonzero(shared)
    both = shared[a, b]
    keep = both * t.denominator >= (size[a] + size[b] - both) * t.numerator
    root = _local_roots(a[keep], b[keep], name.size)
    far = np.flatnonzero(root != np.arange(name.size))
    return name[far], name[root[far]]


#: A block of a cluster: the names of its sets, their sizes and their members. Rows of links have none.
_BLOCK = {"sets": np.int64, "sizes": np.int64, "members": np.uint64}
_PRODUCTS = "a long, b long, root long, tier int, own int, sets binary, sizes binary, members binary"


def _product(group: pa.Table, t: Fraction) -> pa.Table:
    """Links inside a block of rows, and the block itself where its cluster has others (``tier`` isn't null)."""
    name = group["set"].to_numpy()
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["members"].combine_chunks()]
    a, b = _alike(name, parts, t)
    block = {c: [None] * a.size for c in ("root", "tier", "own", *_BLOCK)}
    a, b = a.tolist(), b.tolist()
    if group["tier"][0].is_valid:
        found = {"sets": name, "sizes": np.array([x.size for x in parts]), "members": np.concatenate(parts)}
        for c in ("root", "tier", "own"):
            block[c].append(group[c][0].as_py())
        for c, kind in _BLOCK.items():
            block[c].append(found[c].astype(kind).tobytes())
        a.append(None)
        b.append(None)
    kinds = {"a": pa.int64(), "b": pa.int64(), "root": pa.int64(), "tier": pa.int32(), "own": pa.int32()}
    return pa.table({c: pa.array(x, kinds.get(c, pa.binary())) for c, x in ({"a": a, "b": b} | block).items()})


def _between(t: Fraction):
    """Arrow function: pairs of blocks (l_, r_) -> links, as stars over what a task finds."""

    def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        name, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _local_roots(place[: a.size], place[a.size :], name.size)
        far = np.flatnonzero(root != np.arange(name.size))
        return name[far], name[root[far]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for i in range(batch.num_rows):
                read = lambda c: np.concatenate([np.frombuffer(batch[f"{s}_{c}"][i].as_buffer(), _BLOCK[c]) for s in "lr"])  # noqa: B023, E731
                found = _alike(read("sets"), np.split(read("members"), np.cumsum(read("sizes"))[:-1]), t)
                a.append(found[0])
                b.append(found[1])
                if sum(x.size for x in a) > FLUSH_LINKS:
                    a, b = ([x] for x in stars(np.concatenate(a), np.concatenate(b)))
                    if a[0].size > FLUSH_LINKS // 2:
                        yield pa.record_batch({"a": a[0], "b": b[0]})
                        a, b = [a[0][:0]], [b[0][:0]]
        found = stars(np.concatenate(a), np.concatenate(b))
        yield pa.record_batch({"a": found[0], "b": found[1]})

    return run


def _block_links(products: DataFrame, t: Fraction) -> DataFrame:
    """Links between the blocks of a cluster whose sets' sizes allow them; no block is shuffled."""
    blocks = products.where("members is not null")
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("members")), F.lit(0))).first()
    links = products.where("members is null").select("a", "b")
    if n < 2:
        return links
    least = math.ceil(math.sqrt(4 * products.sparkSession.sparkContext.defaultParallelism))
    blocks = blocks.coalesce(min(n, max(math.ceil(size / PRODUCT_BYTES), least)))
    left, right = (blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("root", "tier", "own", *_BLOCK)]) for s in "lr")
    met = "l_root = r_root and (l_tier = r_tier and l_own < r_own or l_tier + 1 = r_tier)"
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.expr(met))
    return links.union(pairs.mapInArrow(_between(t), "a long, b long"))


def _member_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(set, members) of the wanted sets; texts that a filter rules out don't leave their task."""
    seen = docs.sparkSession.sparkContext.broadcast(bitmaps.build(wanted, "name", hashed=True))
    last = np.int64((bitmaps.BITS - 1) & ((1 << 8 * NAME_BYTES) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for batch in batches:
            for _, _, members, offsets in _rows(batch, n):
                name = _set_hash(members, offsets).view(np.int64)
                hit = bitmaps.test(bits, name & last) & (np.diff(offsets) > 0)
                _, once = np.unique(name[hit], return_index=True)
                which = np.flatnonzero(hit)[once]
                yield pa.record_batch(
                    {
                        "set": pa.array(name[which], pa.int64()),
                        "members": pa.array([members[offsets[i] : offsets[i + 1]].tobytes() for i in which], pa.binary()),
                    }
                )

    return docs.select("text").mapInArrow(run, "set long, members binary")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: near-duplicate groups by word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. Rows link when the Jaccard similarity
    of their sets of ``n``-word shingles is at least ``threshold``; component_id is the least doc_id
    reachable by links. A row with fewer than ``n`` words has its whole sequence as one shingle; an
    empty or null text has the size 0 and links with nothing (component_id is its doc_id). Repeated
    rows are returned as often as they occur; a row without doc_id links like others, but can't name
    a component, and has a null component_id if it is alone. Other columns are ignored.
    """
    t = Fraction(str(threshold)).limit_denominator(10_000)
    docs = docs.select("doc_id", "text")
    sets = materialize(set_table(docs, n), "shingle-sets")
    total, n_sets = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.approx_count_distinct("set")).first()
    links = materialize(_links(docs, n, t, total, n_sets), "candidate-links")
    lows = F.array(*[F.lit(x[0]).cast("long") for x in size_intervals(t)])
    tier = F.size(F.filter(lows, lambda low: low <= F.col("n_shingles")))
    named = sets.where("n_shingles > 0").select("set", short_name("set").alias("name"), tier.alias("tier")).distinct()
    free_shuffles(docs.sparkSession)
    linked = materialize(components(links).withColumnRenamed("node", "name"), "clusters")
    # no link shows candidates that share a short name
    twins = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.col("name").alias("root"))
    clusters = linked.union(twins.join(linked, "name", "left_anti"))
    clustered = materialize(named.join(clusters, "name").select("set", "root", "tier"), "clustered-sets")
    # a cluster of more rows than a block has is cut into blocks of sets of one size interval
    sizes = clustered.groupBy("root", "tier").agg(F.count("*").alias("k"))
    large = sizes.groupBy("root").agg(F.sum("k").alias("whole")).where(F.col("whole") > BLOCK_ROWS).select("root")
    cut = sizes.join(large, "root").select("root", "tier", F.ceil(F.col("k") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = clustered.join(cut, ["root", "tier"], "left")
    own = F.coalesce(F.pmod(F.hash("set"), "blocks"), F.lit(0))
    placed = placed.select("set", "root", F.when(F.col("blocks").isNotNull(), F.col("tier")).alias("tier"), own.alias("own"))
    # equal sets in several tasks give equal rows; one is enough
    rows = _member_sets(docs, clusters, n).groupBy("set").agg(F.any_value("members").alias("members"))
    blocked = rows.join(placed, "set").groupBy("root", "tier", "own")
    # A checkpoint is read row by row; a row may be a whole block.
    products = cut_lineage(blocked.applyInArrow(lambda group: _product(group, t), _PRODUCTS))
    free_shuffles(docs.sparkSession)
    found = components(_block_links(products, t))
    classes = sets.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    named = classes.join(found.withColumnRenamed("node", "set"), "set", "left")
    named = named.withColumn("root", F.coalesce("root", "set"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(roots, "root").select("set", "component_id")
    out = sets.join(named, "set", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))
