"""Audit of how the sources of a language differ in their words, over a frequent-pattern tree.

Every kept term of a language is one row: the sources that have it, in source order, with their counts.
Rows are inserted into a tree whose nodes are the distinct beginnings of rows; a node's multiplicity is
the number of terms whose row begins so. The divergence of two sources sums a value over all kept terms,
most of which neither has. So every term is first taken as absent from both, terms of one source correct
that by its histogram of counts, and terms of both correct it once for each node and ancestor of the tree,
times the node's multiplicity, however many terms share the path. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.session import materialize

#: Documents of a language that a kept term occurs in, scale of the shares, ranks of terms.
MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Different (group, term) entries that a task holds before it passes them on; bytes of a text counted at a time.
HELD, PIECE = 200_000, 1 << 20
#: Up to so many (language, source) groups are broadcast to the joins that look up their totals.
BROADCAST_GROUPS = 50_000

#: ASCII that is no letter becomes a blank, A-Z become a-z, bytes of other characters stay.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows of a task, in parts; and every group once with a null term."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    groups: set[tuple] = set()

    def flush() -> Iterator[pa.RecordBatch]:
        for key, counts in n.items():
            terms, size = list(counts), len(counts)
            yield pa.record_batch(
                {
                    "lang": pa.array([key[0]] * size, pa.string()),
                    "source": pa.array([key[1]] * size, pa.string()),
                    "term": pa.array(terms, pa.binary()).cast(pa.string()),
                    "n": pa.array(list(counts.values()), pa.int64()),
                    "docs": pa.array([docs[key][t] for t in terms], pa.int64()),
                }
            )
        n.clear()
        docs.clear()

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lang", "source"))
        for lang, source, text in zip(*columns, batch.column("text").cast(pa.binary()), strict=True):
            key, seen = (lang, source), set()
            groups.add(key)
            for terms in _tokens(text.as_py() or b""):
                n.setdefault(key, Counter()).update(terms)
                fresh = set(terms) - seen
                docs.setdefault(key, Counter()).update(fresh)
                seen |= fresh
                if sum(map(len, n.values())) > HELD:
                    yield from flush()
    yield from flush()
    if groups:
        langs, sources = zip(*sorted(groups), strict=True)
        none = [None] * len(groups)
        yield pa.record_batch(
            {
                "lang": pa.array(langs, pa.string()),
                "source": pa.array(sources, pa.string()),
                "term": pa.array(none, pa.string()),
                "n": pa.array([0] * len(groups), pa.int64()),
                "docs": pa.array([0] * len(groups), pa.int64()),
            }
        )


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a row with a
    null term and zeros for each group that occurs."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    parts = docs.select(*names, "text").mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_rows(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, path) of each kept term: path lists (source, n), ordered by source."""
    found = counted.where("term is not null").groupBy("lang", "term")
    path = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("path")
    return found.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), path).where(F.col("docs") >= min_docs).drop("docs")


def tree(rows: DataFrame) -> DataFrame:
    """(lang, prefix, terms): the nodes; the last entry of a prefix is the node's own, the others are its ancestors."""
    paths = rows.groupBy("lang", "path").agg(F.count("*").alias("terms"))
    depth = F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth")
    nodes = paths.select("lang", "path", "terms", depth).select("lang", F.slice("path", F.lit(1), F.col("depth")).alias("prefix"), "terms")
    return nodes.groupBy("lang", "prefix").agg(F.sum("terms").alias("terms"))


def _share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept))."""
    n, total, kept = (F.col(c) if isinstance(c, str) else c for c in (n, total, kept))
    return _div(F.lit(SCALE).cast("long") * (n + 1), total + kept) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _value(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _small(groups: DataFrame) -> DataFrame:
    """``groups`` to be broadcast if they are few; a plain join (split by the adaptive planner) otherwise."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    small = _small(groups)

    def side(name: str) -> DataFrame:
        zero = _share(F.lit(0), "total", "kept").alias(f"{name}0")
        return small.where("kept > 0").select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), F.col("kept").alias(f"{name}_kept"), zero)

    def share(name: str, n: str) -> Column:
        return _share(n, f"{name}_total", f"{name}_kept")

    nodes = tree(rows)
    # one row for each node and ancestor, the node itself included, with the same pair of entries of other paths
    own = F.element_at("prefix", -1)
    both = nodes.select("lang", own.alias("b"), F.explode("prefix").alias("a"), "terms").groupBy("lang", "a", "b").agg(F.sum("terms").alias("terms"))
    flat = both.select("lang", F.col("a.source").alias("g"), F.col("a.n").alias("gn"), F.col("b.source").alias("h"), F.col("b.n").alias("hn"), "terms")
    flat = materialize(flat, "tree-pairs")
    single = flat.where("g = h").select("lang", "g", "gn", "terms")
    pair = flat.where("g <> h").join(side("g"), ["lang", "g"]).join(side("h"), ["lang", "h"])
    p, q, p0, q0 = share("g", "gn"), share("h", "hn"), F.col("g0"), F.col("h0")
    forth = F.col("terms") * (_value(p, q) - _value(p, q0) - _value(p0, q) + _value(p0, q0))
    back = F.col("terms") * (_value(q, p) - _value(q0, p) - _value(q, p0) + _value(q0, p0))
    entry = F.explode(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item"), forth.alias("value")), F.struct(F.col("h").alias("source"), F.col("g").alias("item"), back.alias("value"))))
    parts = [pair.select("lang", entry.alias("e")).select("lang", "e.*")]
    lone = single.join(side("g"), ["lang", "g"]).join(side("h"), "lang").where("g <> h")
    p, p0, q0 = share("g", "gn"), F.col("g0"), F.col("h0")
    forth = F.col("terms") * (_value(p, q0) - _value(p0, q0))
    back = F.col("terms") * (_value(q0, p) - _value(q0, p0))
    entry = F.explode(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item"), forth.alias("value")), F.struct(F.col("h").alias("source"), F.col("g").alias("item"), back.alias("value"))))
    parts.append(lone.select("lang", entry.alias("e")).select("lang", "e.*"))
    absent = F.col("g_kept") * _value(F.col("g0"), F.col("h0"))
    parts.append(side("g").join(side("h"), "lang").where("g <> h").select("lang", F.col("g").alias("source"), F.col("h").alias("item"), absent.alias("value")))
    # languages without a kept term
    none = small.where("kept = 0")
    other = none.select("lang", F.col("source").alias("item"))
    parts.append(none.join(other, "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) over documents (text, lang, source).

    Part ``pair`` has each other source of the language with the divergence from it, part ``term`` the
    ``top`` terms that stand out most against the language. Null text, lang and source are read as the
    empty string. Every row is a document, repeated rows too. A group without terms still diverges from the
    others; a language without a kept term has pairs of value 0 and no terms; a language of one source
    has no pairs; no rows give no rows. Equal values are ordered by the item's UTF-8 bytes. Other
    columns are ignored.
    """
    counted = materialize(count_terms(docs), "term-counts")
    rows = materialize(term_rows(counted, min_docs), "term-rows")
    kept = rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    entries = rows.select("lang", "term", F.col("n").alias("lang_n"), F.explode("path").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = materialize(groups.na.fill(0, ["total", "kept", "lang_total"]), "source-groups")
    p, q = _share("n", "total", "kept"), _share("lang_n", "lang_total", "kept")
    told = entries.join(_small(groups), ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    terms = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(rows, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return terms.withColumn("rank", rank).where(F.col("rank") <= top).union(pairs.withColumn("rank", rank))
