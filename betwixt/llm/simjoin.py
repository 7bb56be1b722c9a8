"""Jaccard similarity join of word five-gram sets by chosen paths (Christiani, Pagh and Sivertsen, 2018).

Sets are embedded as ``T`` min-hash values; a token is a position with its value. A run starts with all sets in
one node; a node splits its sets on sampled shared tokens: position i is sampled where a hash of (node, i) is
below 1 / (similarity * T), and sets with the same value there go to the same child. A pair at the threshold
survives a level with an expected one shared child; small nodes are brute-forced, large ones split again. The roots
are shared by all sets, so each samples one position, all of them different; there are as many as bring the recall of
a pair at the threshold, by the branching process's survival probability at the greatest depth, to ``recall``. What is still large after the last level is brute-forced in pairs of blocks.

Brute force in nodes compares one-byte sketches with a margin of four standard deviations and yields a spanning
forest of the node, never all pairs. Connected components of these forests are candidate groups. In each group all
members are then verified exactly, over their whole shingle sets, in blocks of bounded size; a pair lies in one
group only, so each link is counted once, and links between members are found even if the runs missed them.
Groups come out as (class, number of links) for each document; pairs are never emitted.

Equal sets are collapsed first (by a 64-bit hash of the set) and count with their multiplicity. Texts are not shuffled:
a bitmap of fixed size picks the few rows whose set or verdict is wanted, and those are looked up exactly.

Defined results: a null text links to nothing; texts without a word, empty ones included, link to equal ones only;
a text of one to four words is one shingle; class_id is the smallest doc_id of the class, null if all are; repeated
rows are links of each other; an empty table gives an empty result; other columns, whatever their names, are ignored
by ``linked`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import bounded_batches, fresh, key_filter, map_batches, materialize, named, packed, passes
from .graphs import components
from .textnum import U, lowered, mix, shingles, slices, words

T = 128
WIDTH = 5
BLOCK = 128  # members of a node that is not split further
SKETCH_BLOCK = 2048  # members of a block of sketches
SET_BYTES, SET_BLOCK = 8 << 20, (128, 1024)  # of a block of sets: bytes, and least and most members
SALTS = 8
SEED = U(0x51ED270B0D3A1F45)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x)


def shingle_sets(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each row's sorted distinct shingles, and the same concatenated, with the rows' starts."""
    w = words(texts)
    sh, first = shingles(w, WIDTH)
    counts = np.diff(first)
    sets = []
    bare = None
    for i, n in enumerate(counts):
        if n:
            sets.append(np.unique(sh[first[i] : first[i + 1]]))
        else:  # no word: the whole text is the token
            bare = lowered(texts) if bare is None else bare
            x = hash_text(bare[i].as_py())
            sets.append(np.array([x], U))
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return sets, flat, starts


def hash_text(text: str) -> int:
    x = 0x9E3779B97F4A7C15
    for c in text.encode("utf-8", "surrogatepass"):
        x = ((x ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([x], U))[0])


def set_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, whatever its order."""
    m = mix(flat ^ SEED)
    return mix(np.add.reduceat(m, starts[:-1]) ^ mix(np.diff(starts).astype(U)))


def minhashes(flat: np.ndarray, starts: np.ndarray, t: int = T) -> np.ndarray:
    """(sets, t) smallest values under t multiplicative permutations of 32 bits."""
    h = (flat >> U(32)).astype(np.uint32)
    salt = mix(np.arange(1, t + 1, dtype=U) * SEED)
    out = np.empty((len(starts) - 1, t), np.uint32)
    for p in range(t):
        a = np.uint32(int(salt[p]) & 0xFFFFFFFF | 1)
        b = np.uint32(int(salt[p]) >> 32)
        out[:, p] = np.minimum.reduceat(h * a + b, starts[:-1])
    return out


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold is met with probability ``recall`` though ``depth`` levels are needed."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def roots_for(recall: float, depth: int, similarity: float, t: int = T) -> int:
    """Positions of the first level until a pair at the threshold is met with probability ``recall``.

    All sets share the roots, so the positions are fixed and distinct; the pair agrees on each independently, and deeper
    levels survive as in ``runs_for``. Averaged over the share of ``t`` positions on which the pair agrees.
    """
    share = np.arange(t + 1) / t
    log_n = np.array([math.lgamma(t + 1) - math.lgamma(j + 1) - math.lgamma(t - j + 1) for j in range(t + 1)])
    weight = np.exp(log_n + np.arange(t + 1) * math.log(similarity) + np.arange(t, -1, -1) * math.log1p(-similarity)) if similarity < 1 else (share == 1) * 1.0
    q = np.ones(t + 1)
    for _ in range(depth - 1):
        q = 1 - np.exp(-share / similarity * q)
    return next((n for n in range(1, t) if (weight * (1 - share * q) ** n).sum() <= 1 - recall), t)


def root_children(sketch: np.ndarray, roots: int) -> Iterator[np.ndarray]:
    """Every set's child under each root: a root samples one position, no two roots the same."""
    order = np.argsort(mix(np.arange(1, sketch.shape[1] + 1, dtype=U) * U(0xA0761D6478BD642F)))
    for i in order[:roots]:
        yield mix((sketch[:, i].astype(U) + U(1)) * U(0x9E3779B97F4A7C15) ^ mix(np.array([i + 1], U) * U(0xD1342543DE82EF95)))


def children(node: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of every sampled token of each row's node."""
    t = sketch.shape[1]
    salt = mix(np.arange(1, t + 1, dtype=U) * U(0xD1342543DE82EF95))
    limit = U(int(2**64 / (similarity * t)))
    distinct, which = np.unique(node, return_inverse=True)
    rows, out = [], []
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(distinct) + 1))
    chosen = [np.flatnonzero(mix(salt ^ d) < limit) for d in distinct] if len(distinct) < 4096 else None
    for k, d in enumerate(distinct):
        mine = order[cuts[k] : cuts[k + 1]]
        for i in chosen[k] if chosen else np.flatnonzero(mix(salt ^ d) < limit):
            rows.append(mine)
            out.append(mix((sketch[mine, i].astype(U) + U(1)) * U(0x9E3779B97F4A7C15) ^ mix(salt[i : i + 1] + d)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows), np.concatenate(out)


def unpacked(column: pa.Array, dtype: type, t: int = T) -> np.ndarray:
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data.view(dtype).reshape(len(column), t)


def complete_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that are sorted by their first ``keys`` columns: tables of whole groups, and the groups' starts."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    rest: list[pa.RecordBatch | pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        at = starts(t)
        if rest and all(rest[-1].column(k)[-1].as_py() == t.column(k)[0].as_py() for k in range(keys)) and len(at) == 1:
            rest.append(t)  # the group goes on
            continue
        whole = pa.concat_tables([*rest, t]).combine_chunks()
        at = starts(whole)
        last = int(at[-1])
        if last:
            yield whole.slice(0, last), np.append(at[:-1], last)
        rest = [whole.slice(last)]
    if rest:
        whole = pa.concat_tables(rest).combine_chunks()
        yield whole, np.append(starts(whole), whole.num_rows)


def roots(near: np.ndarray) -> np.ndarray:
    """Each member's smallest reachable member, by a symmetric boolean matrix."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] >= 0:
            continue
        front = np.array([i])
        while len(front):
            label[front] = i
            front = np.flatnonzero(near[front].any(0) & (label < 0))
    return label


def in_block_pairs(members: DataFrame, group: str, member: str, block: Column, columns: list[str]) -> DataFrame:
    """Members of each group dealt to pairs of blocks (i <= j) of about ``block`` members, sorted by pair.

    A group of at most ``block`` members (column n) is one pair (0, 0).
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    mine = F.pmod(F.xxhash64(member, F.lit(7)), F.col("__nb")).cast("int")
    dealt = (
        members.withColumn("__nb", blocks)
        .withColumn("__b", mine)
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
        .select(
            group, F.least("__b", "__o").alias("bi"), F.greatest("__b", "__o").alias("bj"), F.col("__b").alias("b"), member, *columns
        )
    )
    return dealt.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", member)


def pairs_allowed(b: np.ndarray, bi: int, bj: int) -> np.ndarray | None:
    """Which pairs a block pair is answerable for: all in a block with itself, else those across."""
    return None if bi == bj else b[:, None] != b[None, :]


def _forest(least_equal: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in complete_groups(batches, 3):
            sketch = unpacked(t.column("sk8").combine_chunks() if isinstance(t.column("sk8"), pa.ChunkedArray) else t.column("sk8"), np.uint8)
            key = t.column("key").to_numpy()
            bi, bj, b = (t.column(c).to_numpy() for c in ("bi", "bj", "b"))
            size = np.diff(at)
            left, right = [], []
            two = at[:-1][size == 2]
            two = two[(bi[two] == bj[two]) | (b[two] != b[two + 1])]
            if len(two):
                same = (sketch[two] == sketch[two + 1]).sum(1) >= least_equal
                left.append(key[two[same]])
                right.append(key[two[same] + 1])
            for g in np.flatnonzero(size > 2):
                lo, hi = at[g], at[g + 1]
                s = sketch[lo:hi]
                near = np.stack([(s == row).sum(1) >= least_equal for row in s])
                allowed = pairs_allowed(b[lo:hi], bi[lo], bj[lo])
                if allowed is not None:
                    near &= allowed
                r = roots(near)
                moved = np.flatnonzero(r != np.arange(hi - lo))
                left.append(key[lo + r[moved]])
                right.append(key[lo + moved])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections."""
    m = len(sets)
    out = np.zeros((m, m))
    if m <= 4:
        for i in range(m):
            for j in range(i):
                a, c = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                pos = np.minimum(np.searchsorted(c, a), len(c) - 1)
                out[i, j] = out[j, i] = (c[pos] == a).sum()
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    token, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n[which] > 1
    column = np.cumsum(n > 1)[which[keep]] - 1
    owner = owner[keep]
    width = int((n > 1).sum())
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = max(256, (1 << 24) // m)
    for lo in range(0, width, step):
        a, c = np.searchsorted(column, [lo, lo + step])
        x = np.zeros((m, min(step, width - lo)), np.float32)
        x[owner[a:c], column[a:c] - lo] = 1
        out += x @ x.T
    return out


def _verified(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in complete_groups(batches, 3):
            key, many = t.column("key").to_numpy(), t.column("copies").to_numpy()
            bi, bj, b = (t.column(c).to_numpy() for c in ("bi", "bj", "b"))
            packed = t.column("set")
            keys, links, root = [], [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                own = np.flatnonzero(np.concatenate([[True], key[lo + 1 : hi] != key[lo : hi - 1]])) + lo  # repeated rows
                if len(own) < 2:
                    continue
                sets = [np.frombuffer(packed[int(i)].as_py(), U) for i in own]
                size = np.array([len(s) for s in sets])
                near = shared_counts(sets) * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9
                np.fill_diagonal(near, False)
                allowed = pairs_allowed(b[own], bi[lo], bj[lo])
                if allowed is not None:
                    near &= allowed
                n = near @ many[own]
                r = roots(near)
                hit = np.flatnonzero(near.any(1))
                keys.append(key[own[hit]])
                links.append(n[hit])
                root.append(key[own[r[hit]]])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, links, root)], ["key", "links", "root"])

    return run


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, shingles, sk32, sk8 of every row; key null for a null text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                text = b.column(1).slice(lo, hi - lo)
                _, flat, starts = shingle_sets(text)
                sk = minhashes(flat, starts)
                null = np.asarray(pc.is_null(text))
                key = set_keys(flat, starts).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(key, mask=null),
                        pa.array(np.diff(starts).astype(np.int32), mask=null),
                        pa.array([x.tobytes() for x in sk], pa.binary()),
                        pa.array([x.tobytes() for x in sk.astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "key", "shingles", "sk32", "sk8"],
                )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, key long, shingles int, sk32 binary, sk8 binary"
    )


def set_table(docs: DataFrame, shipped: Broadcast) -> DataFrame:
    """doc_id, key and packed set of the rows whose id the bitmap passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(passes(shipped.value, b.column(2).to_numpy())))
            for lo, hi in slices(b.column(1)):
                sets, flat, starts = shingle_sets(b.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), _ints(set_keys(flat, starts)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "key", "set"]
                )

    ids = F.col("doc_id").cast("long")
    rows = docs.filter(F.col("text").isNotNull()).select(ids.alias("doc_id"), "text", F.xxhash64(ids).alias("h"))
    return map_batches(rows, run, "doc_id long, key long, set binary")


def candidate_edges(reps: DataFrame, similarity: float, recall: float, depth: int, block: int) -> DataFrame:
    """Spanning forests (a, b) of all nodes of all runs, over reps (key, sk32, sk8); an edge may repeat."""
    starts = min(T, max(runs_for(recall, depth), roots_for(recall, depth, similarity)))
    spread = 4 * math.sqrt(similarity * (1 - similarity) / T)
    least_equal = math.ceil(T * ((similarity - spread) * 255 / 256 + 1 / 256))

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, sketch = b.column(0).to_numpy(), unpacked(b.column(1), np.uint32)
            for child in root_children(sketch, starts):
                yield pa.RecordBatch.from_arrays([_ints(child), pa.array(key)], ["node", "key"])

    def next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, key = b.column(0).to_numpy().view(U), b.column(1).to_numpy()
            row, child = children(node, unpacked(b.column(2), np.uint32), similarity)
            yield pa.RecordBatch.from_arrays([_ints(child), pa.array(key[row])], ["node", "key"])

    schema = "node long, key long"
    rows = materialize(reps.select("key", "sk32").mapInArrow(first_level, schema), "paths")
    found = None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        # a node may hold any share of the rows: they are spread over salts, and the sizes repeated
        sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        shared = rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(sizes, ["node", "salt"]).drop("salt")
        many = rows.count()
        shared = materialize(packed(shared, many, 24), "nodes")
        last = level == depth
        small = shared if last else shared.filter(F.col("n") <= block)
        # joined on the set's key, which is unique in reps: no hot key
        with_sketch = small.join(reps.select("key", "sk8"), "key")
        edges = in_block_pairs(with_sketch, "node", "key", F.lit(max(block, SKETCH_BLOCK)), ["sk8"]).mapInArrow(_forest(least_equal), "a long, b long")
        edges = materialize(packed(edges.distinct(), many, 16), "forest")
        found = edges if found is None else found.unionByName(edges)
        if last:
            break
        large = shared.filter(F.col("n") > block)
        if large.isEmpty():
            break
        # a node's members stay together in few batches, so that its samples are drawn once
        rows = large.join(reps.select("key", "sk32"), "key").select("node", "key", "sk32").mapInArrow(next_level, schema)
        rows = materialize(packed(rows, many, 24), "paths")
    return found


def classes_of(docs: DataFrame, similarity: float, recall: float, depth: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows; and of the sets that are linked or repeated: key, class_id, class_key, copies, links."""
    sketches = materialize(sketch_table(docs), "sketches")
    reps = sketches.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("sk32", "sk8")).alias("sk"), F.min("shingles").alias("shingles")
    )
    many = sketches.count()
    reps = materialize(packed(reps.select("key", "first", "copies", "shingles", "sk.sk32", "sk.sk8"), many, 5 * T), "sets")
    groups = components(candidate_edges(reps, similarity, recall, depth, block))
    members = groups.select(F.col("node").alias("key"), F.col("root").alias("grp")).unionByName(
        groups.select(F.col("root").alias("key"), F.col("root").alias("grp")).distinct()
    )
    members = members.join(reps.select("key", "first", "copies", "shingles"), "key")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("shingles").alias("mean"))
    wanted = materialize(packed(members.drop("shingles").join(sizes, "grp").withColumnRenamed("key", "want"), many, 48), "members")
    shipped = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, F.xxhash64("first")))
    sets = set_table(docs, shipped).join(wanted.hint("merge"), (F.col("key") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("first")))
    per_block = F.least(F.lit(SET_BLOCK[1]), F.greatest(F.lit(min(block, SET_BLOCK[0])), F.floor(F.lit(SET_BYTES) / (8 * F.col("mean"))))) if block == BLOCK else F.lit(block)
    verified = in_block_pairs(sets, "grp", "key", per_block, ["copies", "set"]).mapInArrow(_verified(similarity), "key long, links long, root long")
    verified = materialize(packed(verified, many, 24, costly=True), "links")
    classes = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    # all other documents are classes of their own
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    special = (
        reps.select("key", "first", "copies")
        .join(links, "key", "left")
        .filter(F.col("links").isNotNull() | (F.col("copies") > 1))
        .join(classes.select(F.col("node").alias("key"), "root"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    special = materialize(special, "special")
    heads = special.filter(F.col("first").isNotNull()).groupBy("root").agg(F.min(F.struct("first", "key")).alias("head"))
    named_sets = special.join(heads, "root", "left").select("key", F.col("head.first").alias("class_id"), F.col("head.key").alias("class_key"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return sketches, named_sets


def with_classes(sketches: DataFrame, special: DataFrame, salts: int) -> DataFrame:
    """doc_id, key, shingles of every row, with class_id, class_key, copies and links, null for sets that are alone.

    A set may hold any share of the rows: they are spread over salts, and the sets repeated.
    """
    wide = special.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    light = sketches.select("doc_id", "key", "shingles", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    return light.join(wide, ["key", "salt"], "left").drop("salt")


def linked(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, depth: int = 3, block: int = BLOCK, salts: int = 16) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles of every row: its class of linked documents and its number of links."""
    sketches, special = classes_of(docs, similarity, recall, depth, block)
    return with_classes(sketches, special, salts).select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce(F.col("shingles"), F.lit(0)).alias("n_shingles"),
    )


def deduplicate(docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, depth: int = 3, block: int = BLOCK, salts: int = 16) -> DataFrame:
    """The documents, with all columns, less all but one of each class: the smallest doc_id, of its sets the smallest key.

    Rows with a null doc_id stay. Of rows that repeat both the id and the set that stay, one stays.
    """
    sketches, special = classes_of(docs, similarity, recall, depth, block)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("class_key"))
    rows = with_classes(sketches, special, salts).filter(F.col("copies").isNotNull() & F.col("doc_id").isNotNull())
    verdicts = rows.select("doc_id", "key", stays.alias("stays")).groupBy("doc_id", "key").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    verdicts = verdicts.filter(~F.col("stays") | (F.col("n") > 1)).select("doc_id", "key", "stays")
    verdicts = materialize(packed(verdicts, sketches.count(), 24), "verdicts")
    shipped = docs.sparkSession.sparkContext.broadcast(key_filter(verdicts, F.xxhash64("doc_id")))
    columns = docs.columns
    at, (hashed, key, verdict_id, verdict_key, verdict, turn) = columns.index("text"), fresh(columns, "h", "key", "vid", "vkey", "stays", "turn")
    ids = F.col("doc_id").cast("long")
    tagged = docs.select("*", F.when(ids.isNotNull(), F.xxhash64(ids)).alias(hashed))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = ~passes(shipped.value, b.column(b.num_columns - 1).fill_null(0).to_numpy()) | np.asarray(b.column(b.num_columns - 1).is_null())
            yield b.select(range(b.num_columns - 1)).filter(pa.array(keep))

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(b.num_columns - 1)
            b = b.select(range(b.num_columns - 1)).filter(pa.array(passes(shipped.value, h.fill_null(0).to_numpy()) & np.asarray(h.is_valid())))
            for lo, hi in slices(b.column(at)):
                part = b.slice(lo, hi - lo)
                _, flat, starts = shingle_sets(part.column(at))
                keys = pa.array(set_keys(flat, starts).view(np.int64), mask=np.asarray(part.column(at).is_null()))
                yield pa.RecordBatch.from_arrays([*part.columns, keys], [*columns, key])

    found = verdicts.select(F.col("doc_id").alias(verdict_id), F.col("key").alias(verdict_key), F.col("stays").alias(verdict))
    maybe = map_batches(tagged, looked_at, StructType([*docs.schema.fields]).add(key, LongType()))
    maybe = maybe.join(found.hint("merge"), (ids == F.col(verdict_id)) & (F.col(key) == F.col(verdict_key)), "left")
    order = Window.partitionBy(ids, F.col(key)).orderBy(F.xxhash64(*[named(c) for c in columns]))
    kept = maybe.withColumn(turn, F.when(F.col(verdict), F.row_number().over(order)))
    kept = kept.filter(F.col(verdict).isNull() | (F.col(verdict) & (F.col(turn) == 1)))
    return map_batches(tagged, untouched, docs.schema).unionByName(kept.select(*[named(c) for c in columns]))
