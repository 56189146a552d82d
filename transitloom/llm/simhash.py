"""Near-duplicates by SimHash.

`classes` links texts whose 64-bit fingerprints differ in at most three bits. Six blocks of the fingerprint
are chosen three at a time, and two linked fingerprints agree in all three blocks of some choice, so only
those that share a key of about 32 bits meet. For each fingerprint the Hamming distances to sixteen
references are computed once, as a pivot table. Where two distances to one reference differ by more than
three, so do the fingerprints: pairs are discarded by the largest difference of their coordinates, and only
survivors are compared bit by bit. What a key finds leaves its task as a spanning forest, never as all pairs. Keys
held by very many fingerprints are dealt out as pairs of pieces, so no task holds all of one key.

`near_duplicates` links texts by the Jaccard similarity of their word shingles, for a pipeline. Texts at
a similarity of 0.8 differ in about ten bits, beyond the reach of a whole-text fingerprint. So each text has
several fingerprints, each the SimHash of a small sample of its shingles, drawn alike from equal shingles. Texts of few
shingles have the smallest of their hashes instead, of which two similar ones always share one.
A pivot table holds the distance of each whole set to sixteen references: the set of all hashes nearer than half the bits to
a reference. The distance of two sets is the number of shingles that only one has, a metric, so no two sets are nearer than
their largest difference of coordinates: pairs that it rules out are never compared, and no similar pair is.
Texts that share a fingerprint and pass are compared by their whole sets of shingles: each with a few others first, which
joins nearly all copies, then all holders of a fingerprint that are not yet of one class.

Nulls: a null text has no words, and the fingerprint zero. A null id is ignored by the minimum of a component;
a component of null ids has a null id. Rows that repeat share a fingerprint. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitloom.llm.text import add_columns, as_bytes, free_name, sliced, words

Store = Callable[[DataFrame, str], DataFrame]
SEED = 42
REACH = 3
ROWS = 256
CUTS = [0, 11, 22, 33, 44, 54, 64]
CHOICES = list(combinations(range(6), 3))
PIECE = 4096
REFERENCES = np.random.default_rng(20).integers(0, 2**64, size=16, dtype=np.uint64)


def shingles(text: bytes | None, k: int) -> list[bytes]:
    """The runs of `k` words, repeats included; the whole sequence if there are fewer words."""
    ws = text.lower().split() if text else []
    if len(ws) <= k:
        return [b" ".join(ws)] if ws else []
    return [b" ".join(t) for t in zip(*(ws[i:] for i in range(k)), strict=False)]


def hashes(text: bytes | None, k: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in shingles(text, k)], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none. Long texts are counted piece by piece."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 32768):
        piece = h[i:i + 32768].astype("<u8")
        total += np.unpackbits(piece.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    """Append the fingerprint as a signed 64-bit number."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [fingerprint(hashes(t, k)) for t in as_bytes(batch, text)]
        return [pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

    return add_columns(docs, ROWS, [name], f"`{name}` bigint", work)


def coordinates(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, a row for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :])


def forest(fps: np.ndarray, table: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is within reach in one group, as positions (a spanning forest).

    Rows are visited in order of the first coordinate, so each meets only rows within reach in it. Those of the same
    tree already, and those that any coordinate rules out, are not compared. With `side`, only pairs
    of different sides are.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int16)
    ends = np.searchsorted(table[:, 0], table[:, 0] + REACH, side="right")
    tree = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        span = slice(i + 1, ends[i])
        near = tree[span] != tree[i]
        if side is not None:
            near &= side[order[span]] != side[order[i]]
        at = np.flatnonzero(near) + i + 1
        at = at[np.abs(table[at] - table[i]).max(axis=1, initial=0) <= REACH]
        for j in at[np.bitwise_count(fps[at] ^ fps[i]) <= REACH]:
            if tree[j] != tree[i]:
                out.append((int(order[i]), int(order[j])))
                tree[tree == tree[j]] = tree[i]
    return out


def _keys(fp: Column) -> Column:
    """One key for each choice of blocks: its number above, the bits of its blocks below."""
    made = []
    for n, blocks in enumerate(CHOICES):
        key, width = F.lit(0).cast("long"), 0
        for b in blocks:
            low, size = CUTS[b], CUTS[b + 1] - CUTS[b]
            bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bits, width))
            width += size
        made.append(key.bitwiseOR(F.lit(n << 40).cast("long")))
    return F.array(*made)


def links(distinct: DataFrame, store: Store) -> DataFrame:
    """Links between different fingerprints, enough to connect what three bits connect (src, dst)."""

    def table(batch: pa.RecordBatch) -> list[pa.Array]:
        fps = batch.column(batch.schema.get_field_index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
        return [pa.array([r.tobytes() for r in coordinates(fps).astype(np.uint8)], pa.binary())]

    known = add_columns(distinct.select("fp"), 8192, ["pivots"], "pivots binary", table)
    keyed = store(known, "simhash-pivots").select("fp", "pivots", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1")
    pieces = F.ceil(F.col("count") / PIECE).cast("int")
    # the planner sizes the twenty rows of a fingerprint as the stored one, and would send them all through the driver
    met = keyed.hint("merge").join(shared, "key").withColumns({"pieces": pieces, "piece": F.pmod(F.xxhash64("fp"), pieces).cast("int")})
    # a key in p pieces becomes the p (p + 1) / 2 pairs of its pieces; nearly all keys have one
    lower = F.transform(F.sequence(F.lit(0), F.col("piece")), lambda o: F.struct(o.alias("a"), F.col("piece").alias("b")))
    upper = F.transform(F.sequence(F.col("piece"), F.col("pieces") - 1), lambda o: F.struct(F.col("piece").alias("a"), o.alias("b")))
    dealt = met.select("fp", "pivots", "key", "piece", F.explode(F.array_distinct(F.concat(lower, upper))).alias("pair")).select(
        "key", "pair.a", "pair.b", "piece", "fp", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, a, b, piece, fps, table = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            src, dst = [], []
            for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True):
                if hi - lo > 1:
                    side = piece[lo:hi] if a[lo] != b[lo] else None
                    for i, j in forest(fps[lo:hi], table[lo:hi], side):
                        src.append(fps[lo + i])
                        dst.append(fps[lo + j])
            pair = [np.array(x, dtype=np.uint64).view(np.int64) for x in (src, dst)]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(*pair)), pa.array(np.maximum(*pair))], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            key, a, b, piece, fps = (cols[n].to_numpy(zero_copy_only=False) for n in ("key", "a", "b", "piece", "fp"))
            table = np.frombuffer(b"".join(cols["pivots"].to_pylist()), dtype=np.uint8).reshape(-1, len(REFERENCES))
            # the last group may go on in the next batch
            last = np.flatnonzero((key != key[-1]) | (a != a[-1]) | (b != b[-1]))
            start = int(last[-1]) + 1 if len(last) else 0
            full = (key, a, b, piece, fps.view(np.uint64), table)
            if start:
                yield flush([*held, tuple(x[:start] for x in full)])
                held = []
            elif held and (held[0][0][0], held[0][1][0], held[0][2][0]) != (key[0], a[0], b[0]):
                yield flush(held)
                held = []
            held.append(tuple(x[start:] for x in full))
        if held:
            yield flush(held)

    grouped = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return grouped.mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """The smallest node connected with each node of an edge list (node, root).

    Large-star and small-star rounds: each node links its larger, then its smaller neighbours to its smallest.
    They end in stars. Every round is written to the shared folder; only whether it changed anything
    comes back.
    """
    now = store(edges.where("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct(), "links")
    seen = None
    while not now.isEmpty():
        # large star: every neighbour above the node hangs on the smallest of its neighbours and itself
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(now.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("m", "node"))
        large = both.where("other > node").join(least, "node").select(F.col("m").alias("lo"), F.col("other").alias("hi")).distinct()
        # small star: every neighbour below the node, and the node, hang on the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        small = small.union(low.select(F.col("m").alias("lo"), "hi")).where("lo <> hi").distinct()
        now = store(small, "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def classes(docs: DataFrame, store: Store, k: int = 3) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (hex) and component_id, the smallest id reachable."""
    made = store(fingerprints(docs.select("doc_id", "text"), k).select("doc_id", "fp"), "simhash-fps")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = store(components(links(distinct, store), store), "simhash-roots")
    # fingerprints without a link are their own component
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select(F.col("fp").alias("own"), "component_id")
    # equal fingerprints take next to no room where they are stored, so that size tells little of the rows
    return made.hint("merge").join(of, F.col("fp") == F.col("own")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicates by similarity -------------------------------------------------------------------
VIEWS = 16
SAMPLE = 4
# Texts of fewer different shingles meet by an exact key.
FEW = 64
# Bounds of a piece of the holders of one fingerprint whose sets meet in one task.
PIECE_SETS = 512
PIECE_GRAMS = 2**18
MIX = np.random.default_rng(21).integers(0, 2**63, size=VIEWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def views(h: np.ndarray) -> np.ndarray:
    """For each view the SimHash of the few shingles that come first in its order: equal for equal samples."""
    first = np.empty((VIEWS, min(SAMPLE, len(h))), dtype=np.uint64)
    for v, m in enumerate(MIX):
        order = h * m
        order ^= order >> np.uint64(29)
        order *= np.uint64(0x9E3779B97F4A7C15)
        first[v] = h[np.argpartition(order, first.shape[1] - 1)[:SAMPLE]]
    # a view's sample is told from the same shingles drawn in another view
    first ^= MIX[:, None]
    bits = np.unpackbits(np.ascontiguousarray(first).astype("<u8").view(np.uint8).reshape(VIEWS, -1, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1) > first.shape[1], axis=1, bitorder="little").view("<u8").reshape(-1)


def signs(h: np.ndarray, similarity: float) -> np.ndarray:
    """What a text of the sorted hashes `h` shares with similar texts.

    Two similar sets share one of the smallest hashes of each, as many as the larger side may lack and one more. Texts
    of FEW shingles have those instead of views; texts that can be similar to them have both.
    """
    n = len(h)
    fewest = ceil(similarity * n - 1e-9)
    exact = h[:n - fewest + 1] if n and fewest < FEW else h[:0]
    return np.concatenate([exact, views(h)]) if n >= FEW else exact


def candidates(signed: DataFrame) -> DataFrame:
    """Pairs of keys to compare first (src, dst), from rows of a key and its fingerprints by view.

    The holders of a fingerprint are each paired with the smallest of them and with the one before them in two other
    orders, so candidates follow the holders and not their pairs. Orders are formed in slices of a large group,
    so none is sorted in one task.
    """
    held = signed.select("key", F.explode("signs").alias("sign"), F.element_at("signs", -1).alias("one"), F.try_element_at("signs", F.lit(-2)).alias("two"))
    crowd = held.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).where("n > 1")
    met = held.join(crowd, "sign").withColumn("slice", F.pmod(F.xxhash64("one"), F.ceil(F.col("n") / PIECE)))
    group = W.partitionBy("sign", "slice")
    beside = F.array("first", F.lag("key").over(group.orderBy("one", "key")), F.lag("key").over(group.orderBy("two", "key")))
    return met.select("key", beside.alias("beside")).select("key", F.explode(F.array_distinct("beside")).alias("other")).where("other IS NOT NULL AND other <> key").select(
        F.least("key", "other").alias("src"), F.greatest("key", "other").alias("dst")).distinct()


def pivots(h: np.ndarray) -> np.ndarray:
    """Distances of a set of hashes to the references, less the size of the reference: `len(h)` less twice what both hold."""
    held = np.zeros(len(REFERENCES), dtype=np.int64)
    for i in range(0, len(h), 32768):
        held += np.count_nonzero(coordinates(h[i:i + 32768]) < 32, axis=0)
    return len(h) - 2 * held


def farthest(a: np.ndarray, b: np.ndarray | int, similarity: float) -> np.ndarray:
    """The most shingles that only one of two sets of these sizes has, where the sets are that similar."""
    return (a + b) * (1 - similarity) / (1 + similarity) + 1e-9 * (a + b)


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """The sorted hashes of the different shingles of each text, as bytes, and their pivot table (key, grams, pivots)."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [np.unique(hashes(t, k)) for t in as_bytes(batch, "text")]
        return [pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([pivots(s) for s in sets], pa.list_(pa.int64()))]

    return add_columns(texts.select("key", "text"), ROWS, ["grams", "pivots"], "grams binary, pivots array<bigint>", work).drop("text")


def reachable(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs that no coordinate rules out, before any whole set is moved."""
    held = sets.select("key", "pivots", F.expr("octet_length(grams) DIV 8").alias("size"))
    met = pairs.join(held.select(F.col("key").alias("src"), F.col("pivots").alias("a"), F.col("size").alias("m")), "src").join(
        held.select(F.col("key").alias("dst"), F.col("pivots").alias("b"), F.col("size").alias("n")), "dst")
    apart = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return met.where(apart <= farthest(F.col("m"), F.col("n"), similarity)).select("src", "dst")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets are that similar. `sets` has one for each key of the pairs."""

    def compare(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for a, b in zip(as_bytes(batch, "a"), as_bytes(batch, "b"), strict=True):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        return [pa.array(out, pa.float64())]

    full = reachable(pairs, sets, similarity).join(sets.select(F.col("key").alias("src"), F.col("grams").alias("a")), "src").join(
        sets.select(F.col("key").alias("dst"), F.col("grams").alias("b")), "dst").select("src", "dst", "a", "b")
    return add_columns(full, ROWS, ["jaccard"], "jaccard double", compare).where(F.col("jaccard") >= similarity).select("src", "dst")


def set_forest(sets: list[np.ndarray], tree: np.ndarray, similarity: float, side: np.ndarray | None = None,
               table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is similar in one group, as positions. `tree` tells what is connected before.

    Sets are visited in order of size, so each meets only those that are not too large to be similar. With `side`,
    only pairs of different sides are compared; with the pivot `table` of the sets, only those that no coordinate rules out.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    tree = tree[order]
    held = np.zeros(len(names), dtype=bool)
    out = []
    for i in range(len(order) - 1):
        end = i + 1 + np.count_nonzero(sizes[i] / sizes[i + 1:] >= similarity)
        near = tree[i + 1:end] != tree[i]
        if side is not None:
            near &= side[order[i + 1:end]] != side[order[i]]
        if table is not None:
            at = np.flatnonzero(near)
            apart = np.abs(table[order[i + 1 + at]] - table[order[i]]).max(axis=1, initial=0)
            near[at] = apart <= farthest(sizes[i + 1 + at], sizes[i], similarity)
        if not near.any():
            continue
        mine = flat[starts[i]:starts[i + 1]]
        held[mine] = True
        both = np.add.reduceat(held[flat[starts[i + 1]:starts[end]]], starts[i + 1:end] - starts[i + 1], dtype=np.int64)
        held[mine] = False
        for j in np.flatnonzero(near & (both / (sizes[i] + sizes[i + 1:end] - both) >= similarity)) + i + 1:
            if tree[j] != tree[i]:
                out.append((int(order[i]), int(order[j])))
                tree[tree == tree[j]] = tree[i]
    return out


def remaining(distinct: DataFrame, sets: DataFrame, roots: DataFrame, store: Store, similarity: float) -> DataFrame:
    """Links between the classes found so far, by all holders of each fingerprint that joins several (src, dst).

    The holders are dealt out as pairs of pieces of bounded size, so no task holds all of a large group. Two holders
    have been compared already.
    """
    sized = sets.select("key", F.expr("octet_length(grams) DIV 8").alias("size")).join(distinct.select("key", "signs"), "key")
    placed = store(sized.join(roots, F.col("key") == F.col("node"), "left").select("key", "size", "signs", F.coalesce("root", "key").alias("root")), "near-placed")
    held = placed.select("key", "size", "root", F.explode("signs").alias("sign"))
    crowd = held.groupBy("sign").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams_held"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 AND low <> high")
    pieces = F.greatest(F.ceil(F.col("n") / PIECE_SETS), F.ceil(F.col("grams_held") / PIECE_GRAMS)).cast("int")
    met = held.join(crowd.select("sign", pieces.alias("pieces")), "sign").withColumn("piece", F.pmod(F.xxhash64("key"), "pieces").cast("int"))
    lower = F.transform(F.sequence(F.lit(0), F.col("piece")), lambda o: F.struct(o.alias("a"), F.col("piece").alias("b")))
    upper = F.transform(F.sequence(F.col("piece"), F.col("pieces") - 1), lambda o: F.struct(F.col("piece").alias("a"), o.alias("b")))
    dealt = met.select("sign", "key", "root", "piece", F.array_distinct(F.concat(lower, upper)).alias("pairs")).join(sets, "key").select(
        "sign", "root", "piece", "grams", "pivots", F.explode("pairs").alias("pair")).select("sign", "pair.a", "pair.b", "piece", "root", "grams", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in sliced(batches, ROWS) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, a, b), group in groupby(rows, key=lambda r: r[:3]):
            piece, root, grams, table = zip(*(r[3:] for r in group), strict=True)
            tree = np.unique(np.array(root, dtype=object), return_inverse=True)[1]
            found = set_forest([np.frombuffer(g, "<u8") for g in grams], tree, similarity, np.array(piece) if a != b else None, np.array(table))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f(root[i], root[j]) for i, j in found], pa.binary()) for f in (min, max)], names=["src", "dst"])

    return dealt.repartition("sign", "a", "b").sortWithinPartitions("sign", "a", "b").mapInArrow(run, "src binary, dst binary").distinct()


def near_duplicates(docs: DataFrame, store: Store, k: int = 5, similarity: float = 0.8) -> tuple[DataFrame, str, str]:
    """`docs` with two more columns, whose names are returned too: the smallest doc_id of the row's class of near
    copies, and a key of the class.

    Texts of equal words are one text from the start, so a group of copies, however large, is one row.
    Texts without words are a class of their own.
    """
    least, kind = free_name(docs.columns, "class_id"), free_name(docs.columns, "class_key")
    fold, mine = free_name(docs.columns, "fold"), free_name(docs.columns, "fold_")
    keyed = docs.withColumn(fold, F.unhex(F.md5(F.array_join(words(F.col("text")), " ").cast("binary"))))

    def sign(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [np.unique(hashes(t, k)) for t in as_bytes(batch, "text")]
        return [pa.array([signs(s, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))]

    signed = add_columns(keyed.select(F.col(fold).alias("key"), "doc_id", "text"), ROWS, ["signs"], "signs array<bigint>", sign)
    distinct = store(store(signed.drop("text"), "near-signs").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("signs").alias("signs")), "near-texts")
    pairs = store(candidates(distinct), "near-pairs")
    wanted = pairs.select(F.col("src").alias("key")).union(pairs.select(F.col("dst").alias("key"))).distinct().join(distinct.select("key", "least"), "key")
    # one row for each wanted text, that with its smallest id
    texts = keyed.select(F.col(fold).alias("own"), F.col("doc_id").alias("id"), "text").join(
        wanted, (F.col("own") == F.col("key")) & F.col("id").eqNullSafe(F.col("least"))).select("key", "text").dropDuplicates(["key"])
    sets = store(shingle_sets(texts, k), "near-grams")
    roots = components(verified(pairs, sets, similarity), store)
    rooted = distinct.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    more = store(remaining(distinct, sets, roots, store, similarity), "near-more")
    if not more.isEmpty():
        joined = components(more, store).select("node", F.col("root").alias("joined"))
        rooted = rooted.join(joined, F.col("root") == F.col("node"), "left").select("key", "least", F.coalesce("joined", "root").alias("root"))
    rooted = store(rooted, "near-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    of = rooted.join(named, "root").select(F.col("key").alias(mine), F.col("smallest").alias(least), F.hex("root").alias(kind))
    return keyed.join(of, F.col(fold) == F.col(mine)).select(*docs.columns, least, kind), least, kind


def one_of_each(docs: DataFrame, store: Store, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of near copies, that with the smallest id, with the columns of `docs`."""
    classed, least, kind = near_duplicates(docs, store, k, similarity)
    return classed.where(F.col("doc_id").eqNullSafe(F.col(least))).dropDuplicates([kind]).select(*docs.columns)
