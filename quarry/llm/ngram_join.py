"""N-gram Jaccard join by multiple-global-order filtering, and its connected components.

Documents are sets of word shingles. Two sets with a Jaccard similarity of at least num/den must share a
token among the first n - ceil(n * num / den) + 1 of each, whatever order all documents sort their tokens
by. Candidates must do so under three orders. All three put rarer tokens first, by a sketch of token
frequencies over all documents (common passages stand apart from it by far more than
the noise of the rest), and break ties by three different hashes.

1. Sketch: every task counts tokens in bins, about one for 128 tokens of the corpus and 2**24 at most; the
   sums give each bin a level, one byte, and the levels are broadcast.
2. Profile: one row a document with the hash of its set, its prefixes and some keys, each from two minima of
   plain hash orders. Documents with equal sets form a class; the smallest doc_id stands for it from here on.
3. Key groups: documents with an equal key are very likely alike. Only groups of more than KEYED documents, which
   would give too many pairs, are taken out of the filtering: one of at most BLOCK documents is
   compared completely inside one task, and only a spanning forest of its links is sent on. In a larger one all
   members are first compared with CENTRES of them, which is linear and connects near copies; only those that
   this leaves apart from the group's main component are compared with all members, in pairs of blocks. So a
   large group of near copies costs no pair rows; groups with the same members are compared once.
4. Candidates: pairs of representatives that share a prefix token of the first order, have sizes in range
   and share no key of a group of step 3 (those pairs are connected if any links connect them). Sets too small to link with
   any unequal one take no part in steps 3 and 4, as their few tokens could be very common. Under the second order the prefixes are longer by
   n // 8 tokens and must have as many in common as they are longer; under the third they must meet. What
   is left is verified by its sets.
5. Links give components by label passing over tables in the shared folder.

Texts don't shuffle as long as the ids of the documents whose sets are needed fit into a checked broadcast; beyond,
ids and texts meet in a shuffled join, which the optimizer prunes by a Bloom filter. Nothing is capped: any pair that links shares prefix tokens under all orders, so step 3 or step 4 sees it.
Texts are hashed in whole; sets of involved documents only are computed again instead of being stored.

Defined cases: null, empty or all-white texts have no shingles and link with nothing, their component is
their doc_id; fewer words than a shingle count as one shingle; a row with a null doc_id gets the component of
its class (null if the class has no doc_id) but never stands for it; rows that share a doc_id count as one
document in links, so a link of either is a link of both.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import attach, components, map_batches, sized, small_batches, stored
from quarry.llm.shingles import salted, shingle_sets

#: Bins of the frequency sketch: a power of two with about SKETCH_LOAD tokens in a bin, within bounds, sent in rows of SKETCH_ROW.
SKETCH_BITS, SKETCH_LOAD, SKETCH_ROW = (14, 24), 128, 4096
#: Documents of one block, and members of a large key group that all others are compared with.
BLOCK, CENTRES = 256, 8
#: Members of a key group up to which its pairs are left to the prefix filters.
KEYED = 4
#: Bytes of a broadcast row of ids alone, and with a row of keys or places for each of some keys.
ID_BYTES, PLACE_BYTES = 24, 48


def sketch_bits(docs: DataFrame) -> int:
    """So many bins that their noise, against which frequent tokens must stand out, doesn't grow with the input."""
    chars = docs.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0.0
    low, high = SKETCH_BITS
    return min(high, max(low, round(math.log2(max(1.0, chars / 6 / SKETCH_LOAD)))))


def token_levels(docs: DataFrame, k: int, bits: int | None = None) -> np.ndarray:
    """A level from 0 to 255 for each bin of token hashes, higher where more documents hold the bin's tokens."""
    bits = bits or sketch_bits(docs)
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for sets in shingle_sets(batch.column("text"), k):
                np.add.at(bins, (np.concatenate(sets) >> shift).astype(np.intp), np.uint32(1))
        yield rows({i: part for i, part in enumerate(bins.reshape(-1, SKETCH_ROW)) if part.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[i] = total.get(i, np.int64(0)) + counts_of(raw)
        yield rows(total)

    def rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        small = [p.astype(np.uint16) if p.max() < 1 << 16 else p.astype(np.int64) for p in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in small], pa.binary()), pa.array([int(p.sum()) for p in parts.values()], pa.int64())], names=["part", "counts", "total"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.minimum(255, 16 * np.log2(1 + counts_of(raw) / mean)).astype(np.uint8).tobytes() for raw in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(found, pa.binary())], names=["part", "levels"])

    spark = docs.sparkSession
    small_batches(spark)
    schema, parts = "part int, counts binary, total long", (1 << bits) // SKETCH_ROW
    dealt = docs.select("text").mapInArrow(count, schema).repartition(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")
    summed = stored(dealt.mapInArrow(add, schema), "sketch")
    mean = max(1.0, (summed.agg(F.sum("total")).first()[0] or 0) / (1 << bits))
    levels = np.zeros((parts, SKETCH_ROW), np.uint8)
    for r in summed.select("part", "counts").mapInArrow(level, "part int, levels binary").collect():  # one byte a bin
        levels[r.part] = np.frombuffer(r["levels"], np.uint8)
    return levels.ravel()


def counts_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if len(raw) == 8 * SKETCH_ROW else np.uint16)


def prefix_length(n: int, num: int, den: int, more: int = 1) -> int:
    """Two sets that link have their first ``more`` common tokens, in any order, among so many first ones of each."""
    return n - -(-n * num // den) + more


def key_count(num: int, den: int) -> int:
    """Keys a document, so many that a pair 0.1 below the threshold shares one with a probability of about 0.994.

    Pairs that share a key are decided in step 3, so this keeps near misses within a group of copies out of step 4.
    """
    below = max(0.3, num / den - 0.1)
    return max(1, round(math.log(0.006) / math.log(1 - below * below))) if below < 1 else 1


def profiles(docs: DataFrame, k: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, key (hash of the set), stars (keys of step 3), p1, p2, p3 (prefixes) and met; nulls where n is 0.

    ``met``: how many tokens two linked documents have in common in p2, at least, as far as this one is concerned.
    p2 and p3 hold 32 bits of each token; tokens that coincide in them lower ``met``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    shift, keys_each = np.uint64(64 - int(np.log2(len(levels)))), key_count(num, den)

    def profile(sets: list[np.ndarray]) -> dict[str, list]:
        sizes = np.array([len(s) for s in sets])
        out: dict[str, list] = {"n": sizes.tolist(), "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]}
        full = np.flatnonzero(sizes)
        stars: list = [None] * len(sets)
        met = [None] * len(sets)
        prefixes: list[list] = [[None] * len(sets) for _ in range(3)]
        if len(full):
            tokens = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])])
            least = [np.minimum.reduceat(salted(tokens, 1000 + j), starts[:-1]) for j in range(2 * keys_each)]
            keys = np.stack([salted(least[2 * j] + salted(least[2 * j + 1], 40), 2000 + j) for j in range(keys_each)], axis=1).view(np.int64)
            level = shared.value[tokens >> shift].astype(np.uint64) << np.uint64(56)
            orders = [level | salted(tokens, 60 + o) >> np.uint64(8) for o in range(3)]
            for row, i in enumerate(full):
                stars[i] = keys[row]
                n = int(sizes[i])
                for o, order in enumerate(orders):
                    p = min(n, prefix_length(n, num, den, 1 + n // 8 if o == 1 else 1))
                    first = np.partition(order[starts[row] : starts[row + 1]], p - 1)[:p]
                    if o == 0:
                        prefixes[0][i] = first.view(np.int64)
                    else:
                        prefixes[o][i] = short = np.unique((first & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)
                        if o == 1:
                            met[i] = max(1, len(short) - prefix_length(n, num, den, 0))
        return out | {"met": met, "stars": stars, "p1": prefixes[0], "p2": prefixes[1], "p3": prefixes[2]}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, list] = {c: [] for c in ("n", "key", "met", "stars", "p1", "p2", "p3")}
        with np.errstate(over="ignore"):
            for sets in shingle_sets(batch.column("text"), k):
                for c, values in profile(sets).items():
                    found[c] += values
        types = {"n": pa.int64(), "key": pa.binary(), "met": pa.int64(), "stars": pa.list_(pa.int64()), "p1": pa.list_(pa.int64()), "p2": pa.list_(pa.int32()), "p3": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[c], t) for c, t in types.items())], names=["doc_id", *types])

    schema = "doc_id long, n long, key binary, met long, stars array<long>, p1 array<long>, p2 array<int>, p3 array<int>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def sets_of(docs: DataFrame, ids: DataFrame, k: int, row_bytes: int = ID_BYTES) -> DataFrame:
    """Columns of ``ids`` (unique in doc_id, of ``row_bytes`` each) and tokens, for the documents in it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [s.view(np.int64) for sets in shingle_sets(batch.column("text"), k) for s in sets]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(tokens, pa.list_(pa.int64()))], names=[*names, "tokens"])

    names = ids.columns
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(ids, row_bytes), "doc_id").select(*names, "text")
    return map_batches(wanted, run, T.StructType([*ids.schema.fields, T.StructField("tokens", T.ArrayType(T.LongType()))]))


def similar(common: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return common * den >= (a + b - common) * num


def block_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """A spanning forest of the links among the rows (doc_id, tokens) of one block or block pair, each document once."""
    _, once = np.unique(table.column("doc_id").to_numpy(), return_index=True)
    table = table.take(once)
    ids = table.column("doc_id").to_numpy()
    lists = table.column("tokens").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    tokens = lists.flatten().to_numpy()
    _, codes, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(ids)), sizes)
    several = counts > 1
    place = np.cumsum(several) - 1
    keep = several[codes]
    columns, owners = place[codes[keep]], owners[keep]
    order = np.argsort(columns, kind="stable")
    columns, owners = columns[order], owners[order]
    common = np.zeros((len(ids), len(ids)), np.float32)
    step = max(256, 4_000_000 // max(1, len(ids)))
    for at in range(0, int(several.sum()), step):
        a, b = np.searchsorted(columns, (at, at + step))
        held = np.zeros((len(ids), step), np.float32)
        held[owners[a:b], columns[a:b] - at] = 1
        common += held @ held.T
    linked = common * den >= (sizes[:, None] + sizes[None, :] - common) * num
    return forest(ids, *np.nonzero(np.triu(linked, 1)))


def centre_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """A spanning forest of the links between the centres and the other rows (doc_id, centre, tokens) of one block."""
    _, once = np.unique(table.column("doc_id").to_numpy(), return_index=True)
    table = table.take(once)
    ids = table.column("doc_id").to_numpy()
    lists = table.column("tokens").combine_chunks()
    offsets = lists.offsets.to_numpy()
    sizes, tokens = np.diff(offsets), lists.flatten().to_numpy()
    offsets = offsets - offsets[0]
    owners = np.repeat(np.arange(len(ids)), sizes)
    a, b = [], []
    for c in np.flatnonzero(table.column("centre").to_numpy(zero_copy_only=False)):
        common = np.bincount(owners[np.isin(tokens, tokens[offsets[c] : offsets[c + 1]])], minlength=len(ids))
        found = np.flatnonzero(common * den >= (sizes + sizes[c] - common) * num)
        a.append(np.full(len(found), c))
        b.append(found)
    return forest(ids, *(np.concatenate(x) if x else np.empty(0, int) for x in (a, b)))


def forest(ids: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> pa.Table:
    """Of the links between places xs and ys as many as connect all that they connect."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
        if (rx := find(x)) != (ry := find(y)):
            root[rx] = ry
            a.append(int(ids[x]))
            b.append(int(ids[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def placed_sets(docs: DataFrame, members: DataFrame, keys: int, k: int) -> DataFrame:
    """``members`` (doc_id and columns of a place, at most ``keys`` rows a document) with tokens."""
    columns = [c for c in members.columns if c != "doc_id"]
    places = stored(members.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("places")), "places")
    return sets_of(docs, places, k, ID_BYTES + PLACE_BYTES * keys).select(F.explode("places").alias("place"), "doc_id", "tokens").select("doc_id", "place.*", "tokens")


def group_links(docs: DataFrame, members: DataFrame, keys: int, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect whatever links within the key groups ``members`` (star, size, doc_id) connect."""

    def compare(table: pa.Table) -> pa.Table:
        return block_links(table, num, den)

    def to_centres(table: pa.Table) -> pa.Table:
        return centre_links(table, num, den)

    schema = "a long, b long"
    found = placed_sets(docs, members.filter(F.col("size") <= BLOCK).select("doc_id", "star"), keys, k).groupBy("star").applyInArrow(compare, schema)
    large = stored(members.filter(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "large-groups")
    if large.isEmpty():
        return found
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    least = [F.min(F.struct(F.xxhash64("doc_id", F.lit(100 + i)), "doc_id"))["doc_id"] for i in range(CENTRES)]
    centres = stored(large.groupBy("star").agg(F.array_distinct(F.array(*least)).alias("centres")), "centres")
    flagged = large.join(sized(centres, ID_BYTES + 8 * CENTRES), "star").select("doc_id", "star", "blocks", own.alias("block"), F.array_contains("centres", F.col("doc_id")).alias("centre"))
    sets = placed_sets(docs, flagged, keys, k)
    sets = sets.withColumn("block", F.explode(F.when(F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    linked = stored(sets.select("star", "block", "doc_id", "centre", "tokens").groupBy("star", "block").applyInArrow(to_centres, schema), "centre-links")
    named = components(linked, "centre-components")
    parted = large.join(named, F.col("doc_id") == F.col("node"), "left").select("star", "doc_id", "blocks", F.coalesce("component", "doc_id").alias("component"))
    counted = parted.groupBy("star", "component").agg(F.count("*").alias("n"))
    main = stored(counted.groupBy("star").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")), "main-components")
    rest = main.filter("rest > 0").withColumn("rest_blocks", F.ceil(F.col("rest") / BLOCK).cast("int"))
    if not rest.isEmpty():
        apart = F.col("component") != F.col("main")
        mine = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("rest_blocks")).cast("int")
        dealt = parted.join(sized(rest, 2 * PLACE_BYTES), "star").select("doc_id", "star", "blocks", "rest_blocks", own.alias("j"), F.when(apart, mine).alias("i"))
        sets = placed_sets(docs, dealt, keys, k)
        every = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
        against = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
        tasks = F.explode(F.when(F.col("i").isNull(), every).otherwise(F.array_union(every, against)))
        paired = sets.select("star", tasks.alias("task"), "doc_id", "tokens").select("star", "task.i", "task.j", "doc_id", "tokens")
        found = found.unionByName(paired.groupBy("star", "i", "j").applyInArrow(compare, schema))
    return found.unionByName(linked)


def links(docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links between the representatives, enough of them to connect all that any links connect."""
    keys = key_count(num, den)
    reps = reps.filter(F.col("n") * den >= (F.col("n") + 1) * num)  # a smaller set links with equal ones only
    starred = reps.select("doc_id", F.explode("stars").alias("star")).distinct()
    groups = starred.groupBy("star").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("members"), F.sum(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 31))).alias("sum")).filter(F.col("size") > KEYED)
    groups = stored(groups, "key-groups")
    grouped = stored(starred.join(groups.select("star", "size"), "star"), "grouped")
    decided = grouped.groupBy("doc_id").agg(F.collect_set("star").alias("decided"))

    tokens = reps.select("doc_id", "n", "p1").join(sized(stored(decided, "decided"), ID_BYTES + 8 * keys), "doc_id", "left").select("doc_id", "n", "decided", F.explode("p1").alias("token"))
    x, y = (tokens.select(F.col("token").alias(f"t{s}"), F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("decided").alias(f"d{s}")) for s in "ab")
    in_range = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & ~F.coalesce(F.arrays_overlap("da", "db"), F.lit(False))
    pairs = stored(x.join(y, (F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")) & in_range).select("a", "b").distinct(), "first-order")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    others = stored(reps.select("doc_id", "met", "p2", "p3").join(sized(stored(ids, "paired"), ID_BYTES), "doc_id", "left_semi"), "other-orders")
    for s in "ab":
        pairs = pairs.join(others.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}{s}") for c in ("met", "p2", "p3"))), s)
    enough = F.size(F.array_intersect("p2a", "p2b")) >= F.least("meta", "metb")
    pairs = stored(pairs.filter(F.arrays_overlap("p3a", "p3b") & enough).select("a", "b").distinct(), "candidates")

    once = groups.groupBy("size", "members", "sum").agg(F.min("star").alias("star"))
    in_groups = group_links(docs, grouped.join(once.select("star"), "star").select("star", "size", "doc_id"), keys, k, num, den)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = stored(sets_of(docs, stored(ids, "candidate-ids"), k), "sets")
    verified = pairs
    for s in "ab":
        verified = verified.join(sets.select(F.col("doc_id").alias(s), F.col("tokens").alias(f"t{s}")), s)
    common = F.size(F.array_intersect("ta", "tb"))
    return in_groups.unionByName(verified.filter(similar(common, F.size("ta"), F.size("tb"), num, den)).select("a", "b"))


def cluster(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents linked at a Jaccard similarity of num/den or more."""
    profile = stored(profiles(docs, k, num, den, token_levels(docs, k)), "profiles")
    rows = profile.select("doc_id", "n", "key")
    total = rows.count()
    classes = stored(rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    copies = attach(rows.filter("n > 0"), classes.filter("size > 1"), "key", "size", total).filter("doc_id != rep").select("doc_id", "key").distinct()
    reps = profile.filter("n > 0 and doc_id is not null").join(sized(stored(copies, "copies"), 2 * PLACE_BYTES), ["doc_id", "key"], "left_anti")
    linked = components(links(docs, reps, k, num, den), "ngram-links")
    named = classes.join(linked, F.col("rep") == F.col("node"), "left").select("key", "size", F.coalesce("component", "rep").alias("component_id"))
    full = attach(rows.filter("n > 0"), named, "key", "size", total)
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def digest(docs: DataFrame) -> DataFrame:
    return cluster(docs, k=3, num=90, den=100)


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, keep_unnamed: bool = True) -> DataFrame:
    """``docs`` with one document of each component left: the one with the smallest doc_id, all its rows included.

    Rows with a null doc_id stay by default. Without ``keep_unnamed`` those with shingles go where a document with a
    doc_id in their class or component stays, and else one row of each class stays; those without shingles link with nothing and stay.
    """
    found = cluster(docs, k, num, den)
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    named = docs.filter("doc_id is not null").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    unnamed = docs.filter("doc_id is null")
    if keep_unnamed or unnamed.isEmpty():
        return named.unionByName(unnamed)
    return named.unionByName(lonely(docs, unnamed, k, num, den))


def lonely(docs: DataFrame, unnamed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of rows without a doc_id one for each component that has no row with one.

    They get ids of their own, above all others, by which the whole table is clustered again.
    """
    above = (docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0) + 1
    numbered = stored(unnamed.withColumn("__id", F.monotonically_increasing_id() + F.lit(above)), "unnamed")
    every = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(numbered.select(F.col("__id").alias("doc_id"), "text"))
    stay = cluster(stored(every, "all-named"), k, num, den).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id"))
    return numbered.join(stay, "__id", "left_semi").drop("__id")
