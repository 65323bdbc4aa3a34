"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link if their sets of five-word shingles have 100 * intersection
>= 80 * union. The result is one row per document with its component.

1. Documents with equal sets form a class; its least doc_id stands for it.
2. Prefixes route: in any one order of all shingles, two linked sets share a
   shingle among the first n - ceil(4n/5) + 1 of each. The order puts shingles
   seen in many documents last (any order gives the same links), so a passage
   that many documents share brings few together.
3. Sets are searched in cells. A cell holds the inverted lists of a block of
   sets, of bounded size; queries stream past it, and each is a T-occurrence
   search: of its lists the short ones are heap-merged, the long ones
   binary-probed for the candidates the merge leaves, and those that reach the
   overlap T = ceil(4 (|r| + |s|) / 9) link. Pairs are never rows: a cell keeps
   the components it knows of and puts out only links that join two of them.
4. First cells: each class goes to the cluster of the document that is the least
   one in most of its prefix's buckets, if enough of them are shared for a link.
   A cluster's blocks are searched for links within, and for links with the
   cluster's hubs, which ties the blocks together.
5. Second cells: what is left are pairs of different components that share
   enough of their prefixes. A class is sent to a block if its prefix leaves
   room for a link with a set there, from the lighter group to the heavier, once
   for the whole block and however many sets it may link with. Every pair that
   could link and isn't in one component meets in a cell.

Defined results: null, empty and blank texts have no shingles and link with
nothing; rows with equal doc_id are one node; a row without doc_id takes no
part and has a null component; an empty table gives an empty result; other
columns are ignored. Texts are read whole. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain, groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH, Scratch, documents, partitions, slices, stored, unused
from .components import components, stars
from .shingles import shingle_sets

#: Shingles in at least this share of a batch's documents are ordered last;
#: of them at most MOST_COMMON, the commonest. Results don't depend on either.
COMMON_SHARE, COMMON_LEAST, MOST_COMMON = 1 / 4000, 3, 1 << 19
#: Rows of a common shingle in one group of its bucket.
SALTED = 1 << 12
#: Cost of a block's sets and of the queries one cell answers (a set costs its
#: size, LEAST_COST at least; a larger set is a block by itself), slots of the
#: bitmap of searched documents (a full bitmap costs time, not links),
#: DivideSkip's cost ratio, a cluster's hubs beside its least document, and the
#: ratio of sizes within a block of the second cells.
BLOCK, ASKED, LEAST_COST, SLOTS, MU, HUBS, BAND = 1 << 18, 1 << 20, 256, 1 << 22, 0.01, 3, 1.1


def least_overlap(n, m):
    return -(-4 * (n + m) // 9)


def _may_link(n: str, m: str, shared: str) -> str:
    """SQL: sizes n and m can link, and of the probing prefixes enough shingles
    are shared. All shared shingles up to where the first prefix ends lie in
    both prefixes, and at most ceil(4 max / 5) - 1 lie beyond."""
    return f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) AND {shared} >= {_least_shared(n, m)}"


def _least_shared(n: str, m: str) -> str:
    return f"greatest(1, (4 * ({n} + {m}) + 8) div 9 - (4 * greatest({n}, {m}) + 4) div 5 + 1)"


class Cell:
    """Inverted lists of a block of sets, and which of them are linked so far."""

    def __init__(self, names: list[int], groups: list[int], sets: list[np.ndarray]):
        self.names, self.sets = names, sets
        self.sizes = np.array([len(s) for s in sets], "i8")
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        items = np.concatenate([np.empty(0, "u8"), *sets])
        order = np.argsort(items, kind="stable")
        items, self.owner = items[order], owner[order]
        first = np.append(True, items[1:] != items[:-1]) if len(items) else np.empty(0, bool)
        self.keys, self.begin = items[first], np.flatnonzero(first)
        self.length = np.diff(np.append(self.begin, len(items)))
        # Ascending through all lists, so that one search probes many of them.
        self.probe = np.cumsum(first).astype("i8") * max(len(sets), 1) - max(len(sets), 1) + self.owner
        self.number: dict[int, int] = {}
        self.group = np.array([self.number.setdefault(g, len(self.number)) for g in groups], "i8")

    def divide_skip(self, query: np.ndarray, group: int = -1, own: int = -1) -> list[int]:
        """Places of the sets that link with the query, but for those of group.
        The set at place own is searched for those after it only."""
        n, m = len(query), len(self.sets)
        low, high = -(-4 * n // 5), 5 * n // 4
        if not m or not n or self.sizes.max() < low or self.sizes.min() > high:
            return []
        least = least_overlap(n, max(low, int(self.sizes.min())))
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == query]
        if own >= 0:
            at = at[self.length[at] > 1]
        if len(at) < least:
            return []
        at = at[np.argsort(self.length[at], kind="stable")]
        probed = min(int(least / (MU * log2(int(self.length[at[-1]]) + 1) + 1)), least - 1)
        short, long = at[: len(at) - probed], at[len(at) - probed :]
        lists = [self.owner[b : b + k].tolist() for b, k in zip(self.begin[short].tolist(), self.length[short].tolist(), strict=True)]
        found, count = [], []
        for one, same in groupby(heapq.merge(*lists)):
            met = sum(1 for _ in same)
            if met >= least - probed:
                found.append(one), count.append(met)
        found, count = np.array(found, "i8"), np.array(count, "i8")
        sizes = self.sizes[found]
        need = least_overlap(n, sizes)
        alive = (sizes >= low) & (sizes <= high) & (self.group[found] != group) & (found > own) & (count + probed >= need)
        found, count, need = found[alive], count[alive], need[alive]
        for lo in range(0, probed, 64):  # the shortest of the long lists first
            if not len(found):
                break
            some = long[lo : lo + 64]
            asked = (some[:, None] * m + found[None, :]).ravel()
            place = np.minimum(np.searchsorted(self.probe, asked), len(self.probe) - 1)
            count = count + (self.probe[place] == asked).reshape(len(some), -1).sum(axis=0)
            alive = count + (probed - lo - len(some)) >= need
            found, count, need = found[alive], count[alive], need[alive]
        return found.tolist()

    def links(self, name: int, group: int, query: np.ndarray):
        """(name, other) for each link that joins two components."""
        mine = self.number.setdefault(group, len(self.number))
        yield from self._join(name, mine, self.divide_skip(query, mine))

    def own_links(self):
        """The same among the cell's own sets."""
        for k, (name, s) in enumerate(zip(self.names, self.sets, strict=True)):
            mine = int(self.group[k])
            yield from self._join(name, mine, self.divide_skip(s, mine, k))

    def _join(self, name: int, mine: int, places: list[int]):
        for k in places:
            if (theirs := int(self.group[k])) != mine:
                yield name, self.names[k]
                self.group[self.group == theirs] = mine
                for g in [g for g, number in self.number.items() if number == theirs]:
                    self.number[g] = mine


def _scan(docs: DataFrame) -> DataFrame:
    """Per document its set's size and digest; per BATCH documents their common shingles."""

    def counted(sets):
        every, n = np.unique(np.concatenate([np.empty(0, "u8"), *sets]), return_counts=True)
        common = n >= max(COMMON_LEAST, COMMON_SHARE * len(sets))
        return every[common], n[common]

    def rows(batches):
        sets, last = [], pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["doc_id", "text"])
        for b in chain(slices(batches), [None]):
            if b is not None and len(sets) + b.num_rows > BATCH or b is None:
                every, n = counted(sets)
                sets = []
            else:
                every, n = counted([])
            b = last if b is None else b
            sizes, one, two = [], [], []
            for s in shingle_sets(b.column("text").to_pylist()):
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "i8")
                sizes.append(len(s)), one.append(d[0]), two.append(d[1])
                sets.append(s)
            k, c = len(sizes), len(every)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [k, c]), pa.int32()),
                    pa.concat_arrays([b.column("doc_id").cast(pa.int64()), pa.nulls(c, pa.int64())]),
                    pa.array(np.concatenate([np.array(sizes, "i8"), n.astype("i8")])),
                    pa.array(np.concatenate([np.array(one, "i8"), every.view("i8")])),
                    pa.array(np.concatenate([np.array(two, "i8"), np.zeros(c, "i8")])),
                ],
                ["kind", "doc_id", "n", "d1", "d2"],
            )

    return docs.mapInArrow(rows, "kind int, doc_id long, n long, d1 long, d2 long")


def _prefixes(docs: DataFrame, common: pa.Table) -> DataFrame:
    """shingle, salt, doc_id, n, place for each document's probing prefix. A
    shingle that many documents hold has several salts, by its count; any other
    has salt -1 and is held by a small share of the documents: at most
    COMMON_SHARE of them (or two in each slice), or fewer than each of
    MOST_COMMON others."""
    keys = common.column("d1").to_numpy().view("u8")
    counts = common.column("n").to_numpy()
    order = np.argsort(keys)
    keys, levels, salts = keys[order], 1 + np.log2(counts[order]).astype("u1"), (counts[order] // SALTED).astype("i4")

    def rows(batches):
        for b in slices(batches):
            out = [[], [], [], [], []]
            for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").to_pylist()), strict=True):
                n = len(s)
                if not n or i is None:
                    continue
                size = n - (4 * n + 4) // 5 + 1
                level, groups = np.zeros(n, "u1"), np.zeros(n, "i8")
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    known = keys[at] == s
                    level, groups = np.where(known, levels[at], 0), np.where(known, salts[at], 0)
                first = np.argsort(level, kind="stable")[:size]
                salt = np.where(groups[first] > 0, (i * 0x9E3779B1 >> 8 & (1 << 40) - 1) % (groups[first].astype("i8") + 1), -1)
                for column, v in zip(out, (s[first].view("i8"), salt, np.full(size, i), np.full(size, n), np.arange(size)), strict=True):
                    column.append(v)
            columns = [np.concatenate([np.empty(0, "i8"), *c]).astype(t) for c, t in zip(out, ("i8", "i4", "i8", "i4", "i4"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "salt", "doc_id", "n", "place"])

    return docs.mapInArrow(rows, "shingle long, salt int, doc_id long, n int, place int")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles of (at least) the wanted documents.

    The wanted ids go into a bitmap of fixed size, so only their texts, and a
    few others, are hashed again and shuffled.
    """
    words = wanted.select(F.expr(f"pmod(xxhash64(doc_id), {SLOTS})").alias("slot")).selectExpr(
        "slot div 32 AS word", "shiftleft(1L, cast(slot % 32 AS int)) AS bit"
    )
    bits = np.zeros(SLOTS // 32, "u4")
    # At most SLOTS / 32 rows, by one job (an iterator would run one for each partition).
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype("u4")
    marked = docs.select("doc_id", "text", F.expr(f"pmod(xxhash64(doc_id), {SLOTS})").alias("slot"))

    def rows(batches):
        for b in slices(batches):
            slots = b.column("slot").to_numpy()
            near = (bits[slots // 32] >> (slots % 32).astype("u4")) & 1 == 1
            some = b.filter(pa.array(near))
            sets = [s.tobytes() for s in shingle_sets(some.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return marked.where("doc_id is not null").mapInArrow(rows, "doc_id long, shingles binary")


def _searched(routes: DataFrame, docs: DataFrame, within: bool, stored) -> DataFrame:
    """Pairs (a, b) of components that links of a cell join, as stars: of what a
    cell ties together, each with the least.

    routes: name (a document), n, component, block, asks (0: a set of the block,
    1: a query of it). A block with many queries is held by several cells.
    """
    spark = docs.sparkSession
    cost = F.greatest("n", F.lit(LEAST_COST))
    asked = routes.where("asks = 1").groupBy("block").agg((F.floor(F.sum(cost) / ASKED) + 1).cast("int").alias("cells"))
    dealt = routes.join(asked.hint("merge"), "block", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    cell = F.when(F.col("asks") == 1, F.array(F.expr("cast(pmod(xxhash64(name), cells) AS int)"))).otherwise(F.expr("sequence(0, cells - 1)"))
    dealt = stored(dealt.select(F.col("name").alias("doc_id"), "component", "block", "asks", F.explode(cell).alias("cell")), "cells")
    needed = dealt.join(_sets_of(docs, dealt.select("doc_id").distinct()).hint("merge"), "doc_id")

    def search(batches):
        where, cell, held, own, tied = None, None, ([], [], []), {}, []

        def opened():
            made = Cell(*held)
            own.update(zip(held[0], held[1], strict=True))
            if within:
                tied.extend((own[a], own[b]) for a, b in made.own_links())
            return made

        def closed():
            if within and where and not cell:
                opened()
            return _pairs(stars(tied))

        for b in slices(batches):
            for block, k, asks, name, group, raw in zip(*(b.column(c).to_pylist() for c in ("block", "cell", "asks", "doc_id", "component", "shingles")), strict=True):
                if (block, k) != where:
                    yield closed()
                    where, cell, held, own, tied = (block, k), None, ([], [], []), {}, []
                s = np.frombuffer(raw, "u8")
                if not asks:
                    for column, v in zip(held, (name, group, s), strict=True):
                        column.append(v)
                    continue
                cell = cell or opened()
                tied += ((group, own[other]) for _, other in cell.links(name, group, s))
        yield closed()

    return stored(
        needed.select("block", "cell", "asks", "doc_id", "component", "shingles")
        .repartition(partitions(spark), "block", "cell")
        .sortWithinPartitions("block", "cell", "asks", "doc_id")
        .mapInArrow(search, "a long, b long"),
        "links",
    )


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _blocks(rows: DataFrame, group: str) -> DataFrame:
    """rows (class, n, group) with the block they fall in and its group's cost."""
    cost = F.greatest("n", F.lit(LEAST_COST)).cast("long")
    total = rows.groupBy(group).agg(F.sum(cost).alias("weight"))
    part = F.expr(f"pmod(xxhash64(class), weight div {BLOCK} + 1)")
    return rows.join(total.hint("merge"), group).withColumn("block", F.xxhash64(group, part))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row."""
    with Scratch() as scratch:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return stored(_components_of(docs, scratch), "jaccard-components")


def _components_of(docs: DataFrame, stored) -> DataFrame:
    scanned = stored(_scan(docs), "scan")
    common = (
        scanned.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d1").limit(MOST_COMMON).toArrow()
    )
    sized = scanned.where("kind = 0 AND n > 0 AND doc_id IS NOT NULL")
    classes = stored(sized.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class")), "classes")
    classed = stored(sized.join(classes.hint("merge"), ["d1", "d2", "n"]).select("doc_id", "class").distinct(), "classed")

    # One shuffle makes the buckets; a common shingle's is dealt over groups.
    bucket = Window.partitionBy("shingle", "salt")
    members = (
        _prefixes(docs, common).repartition(partitions(docs.sparkSession), "shingle", "salt")
        .select("*", F.count(F.lit(1)).over(bucket).alias("held"), F.min("doc_id").over(bucket).alias("least"))
        .where("held > 1 OR salt >= 0")
        .join(classes.select(F.col("class").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    )
    members = stored(members.select("shingle", "salt", F.col("doc_id").alias("class"), "n", "place", "least"), "members")

    # First cells: clusters around the least document of most buckets.
    dealt = members.where("salt >= 0")
    tops = dealt.groupBy("shingle").agg(F.min("least").alias("least"))
    whole = members.where("salt < 0").select("class", "n", "least").unionByName(
        dealt.select("shingle", "class", "n").join(tops.hint("merge"), "shingle").select("class", "n", "least")
    )
    shared = whole.groupBy("class", "n", "least").agg(F.count(F.lit(1)).alias("shared"))
    other = F.col("class") != F.col("least")
    best = stored(
        shared.groupBy("class", "n").agg(
            F.min_by(F.when(other, F.struct("least", "shared")), F.struct(~other, -F.col("shared"), F.col("least"))).alias("b")
        ).select("class", "n", F.col("b.least").alias("cluster"), F.col("b.shared").alias("shared")),
        "clusters",
    )
    sizes = classes.groupBy(F.col("class").alias("cluster")).agg(F.max("n").alias("hub_n"))
    near = best.join(sizes.hint("merge"), "cluster").where(_may_link("n", "hub_n", "shared")).select("class", "n", "cluster", "hub_n")
    placed = stored(_blocks(near, "cluster"), "first-blocks")
    first = placed.select(F.col("class").alias("name"), "n", "block", F.lit(0).alias("asks"))
    picked = placed.groupBy("cluster").agg(
        F.array_distinct(F.array("cluster", *(_far(F.min(_far(F.col("class"), k)), k) for k in range(HUBS)))).alias("hubs"), F.max("hub_n").alias("n")
    )
    asks = placed.select("cluster", "block").distinct().join(picked.hint("merge"), "cluster")
    first = first.unionByName(asks.select(F.explode("hubs").alias("name"), "n", "block", F.lit(1).alias("asks")))
    found = _searched(first.withColumn("component", F.col("name")), docs, True, stored)
    same_id = classed.where("doc_id <> class").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    known = components(found.unionByName(same_id.where("a <> b").select("a", "b")))

    # Second cells: buckets that hold two components. A component's classes of
    # like sizes share blocks; single ones are put beside those of their cluster.
    who = best.join(known.withColumnRenamed("node", "class").hint("merge"), "class", "left")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND)))
    alone = F.xxhash64(F.lit(0), F.coalesce("cluster", "class"), band)
    who = who.withColumn("group", F.when(F.col("component").isNull(), alone).otherwise(F.xxhash64(F.lit(1), "component", band)))
    who = _blocks(who.withColumn("component", F.coalesce("component", "class")), "group").select("class", "n", "component", "block", "weight")
    who = stored(who, "second-blocks")
    rest = stored(members.select("shingle", "class", "n", "place").join(who.hint("merge"), ["class", "n"]), "placed-members")
    mixed = rest.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    rest = stored(rest.join(mixed.hint("merge"), "shingle"), "mixed-members")
    held = rest.groupBy("shingle", "block", "weight").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("place")).alias("room"),
        F.min("component").alias("lo"), F.max("component").alias("hi"),
    )
    held = held.select("shingle", F.struct(*(c for c in held.columns if c != "shingle")).alias("h"))
    # Sizes in a block that could link with n lie between these two; of two that
    # link, the first shared shingle leaves T of both sets behind it.
    low, high = "greatest(h.n_lo, (4 * n + 4) div 5)", "least(h.n_hi, 5 * n div 4)"
    met = rest.hint("merge").join(held, "shingle").where(
        "(h.weight > weight OR h.weight = weight AND h.block >= block) AND NOT (h.lo = component AND h.hi = component) "
        "AND 5 * h.n_hi >= 4 * n AND 5 * n >= 4 * h.n_lo"
    )
    routes = met.groupBy("class", "n", "component", F.col("h.block").alias("block")).agg(
        F.count(F.lit(1)).alias("shared"),
        F.min(F.expr(f"least({_least_shared('n', low)}, {_least_shared('n', high)}) - 1")).alias("needed"),
        F.max(F.expr(f"least(n - place, h.room) >= (4 * (n + {low}) + 8) div 9")).alias("early"),
    )
    routes = stored(routes.where("early AND shared >= needed").select(F.col("class").alias("name"), "n", "component", "block", F.lit(1).alias("asks")), "routes")
    second = who.join(rest.select("class", "n").distinct().hint("merge"), ["class", "n"], "left_semi")
    second = second.join(routes.select("block").distinct().hint("merge"), "block", "left_semi")
    second = routes.unionByName(second.select(F.col("class").alias("name"), "n", "component", "block", F.lit(0).alias("asks")))
    more = _searched(second, docs, False, stored)
    # They join components, so only those are put together anew.
    moved = components(more).select(F.col("node").alias("component"), F.col("component").alias("moved"))

    by_id = classed.groupBy("doc_id").agg(F.min("class").alias("class"))
    named = by_id.join(known.withColumnRenamed("node", "class").hint("merge"), "class", "left").select(
        "doc_id", F.coalesce("component", "class").alias("component")
    )
    named = named.join(moved.hint("merge"), "component", "left").select("doc_id", F.coalesce("moved", "component").alias("component"))
    return (
        scanned.where("kind = 0")
        .select("doc_id", F.col("n").alias("n_shingles"))
        .join(stored(named, "named").hint("merge"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def _far(doc_id: Column, k: int) -> Column:
    """An order of ids of its own for each k (its own inverse)."""
    return doc_id.bitwiseXOR(F.lit((k + 1) * 0x5DEECE66D2B7E151 & (1 << 62) - 1))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's least one, with docs'
    own columns. Rows without doc_id stay; of rows repeated with one doc_id all
    stay or none."""
    kept = jaccard_components(docs).where("doc_id = component_id OR doc_id IS NULL")
    name = unused(docs, "id")
    kept = kept.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def op8_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
