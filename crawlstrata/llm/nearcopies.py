"""Near copies by exact Jaccard similarity of five-word shingles, found by multi-index SimHash search and, where that does not reach, MinHash bands.

A text is the set of its lower-cased word shingles (a text of fewer words is one shingle). Texts of equal sets are one node.

First op10's search (``simhash``) runs over op10's fingerprints: each fingerprint meets the nearest smaller one at most ``RADIUS`` bits away, by balls
around ``SEGMENTS`` segments; nodes of one fingerprint meet the smallest of them. Those whose sets are similar are linked. That ties many near copies with one
comparison a node, but not all: fingerprints of similar texts can differ by 18 bits and more, and balls of that radius around segments would meet most of a large table.

So MinHash bands follow, for what is not tied together by then. Two texts of similarity s agree in one of ``BANDS`` bands of ``ROWS`` MinHash values
with probability 1 - (1 - s^ROWS)^BANDS: all but 7 in a million pairs of similarity 0.8.
Of the nodes that share a band value, every two that are not tied together already are compared,
exactly, so no link of the components is lost. First the nodes of each band value are dealt at random into groups of about four and compared within
them: pairs in proportion to the nodes, no key in one task. That ties nearly all of a crowd of near copies together. Band values in which nodes are still
apart are compared by their rarest shingles: two sets of similarity s share one of the first n - s * n + 1 of their shingles, in any order; with the rarest
in front, sets that only have common passages do not meet. There only nodes outside the
largest component of a shingle meet the others: of a shingle with few nodes in a join, of a larger one in blocks of bounded size, in which the sets themselves
are compared. A block gives links only, and of them only those that tie together what was apart in it: fewer than it has nodes. The comparisons inside
blocks grow with (nodes outside) x (nodes) of a shingle.
Elsewhere pairs that cannot be similar are not compared: a bitmap of each set (a bit for each value of the low bits of its hashes) shows how
many members at least the other set lacks, so no similar pair is lost. Each set is hashed once, however often it is compared.

Defined results: texts without words (or null) are copies of each other; of each component the row of the smallest id stays
(null ids last), and of repeated rows one; texts are read whole, a long one takes memory in proportion to its length; an empty table gives none. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from crawlstrata.llm.common import drop, free_names, map_arrow, merged, stash, utf8
from crawlstrata.llm.simhash import components, fingerprint, nearest
from crawlstrata.shipping import ship

BANDS, ROWS = 30, 5
#: Bits that fingerprints in op10's search differ by at most, and segments of a fingerprint there.
RADIUS, SEGMENTS = 5, 3
#: Shingles hashed by all functions at once: bounds memory, and fits the cache.
CHUNK = 256
_draw = np.random.default_rng(11)
MASKS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
#: Words of 64 bits in the bitmap of a set.
WORDS = 16
#: Nodes of a random group of a band value, nodes of a shingle that meet in a join, nodes and their shingles on each side of a block of a larger one, and counters of shingles.
GROUP, FEW, BLOCK, BLOCK_SHINGLES = 4, 16, 1024, 1 << 20
SLOTS = 1 << 18
FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends, strict=True)], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A name for the values of each band; equal names in one band, equal values."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(found), CHUNK):
        np.minimum(least, ((found[k : k + CHUNK, None] ^ MASKS) * FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    name = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for k in range(ROWS):
        name = (name ^ rows[:, k] ^ rows[:, k] >> np.uint64(32)) * MIX
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bits set at the low bits of the hashes."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[found % np.uint64(64 * WORDS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def may_be_similar(least: float, n_a: str, bits_a: str, n_b: str, bits_b: str) -> Column:
    """Whether sets of these sizes and bitmaps can be similar: a set bit that the other lacks is a member that the other lacks."""

    def shared(n: str, bits: str, others: str) -> Column:
        return F.col(n) - sum(F.bit_count(F.get(bits, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(others, F.lit(k))))) for k in range(WORDS))

    most = F.least(shared(n_a, bits_a, bits_b), shared(n_b, bits_b, bits_a))
    return most * (1 + least) >= least * (F.col(n_a) + F.col(n_b)) - 1e-6


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def undecided(places: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Columns key, node, root, top, nodes, outside: the nodes at keys that several components share, with their component, the largest one of the key, and how many nodes the key has, and has outside that one."""
    placed = places.withColumn("root", F.col("node")) if roots is None else places.join(merged(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("nodes"), F.count("*").alias("roots")).where("roots > 1")
    tops = tops.select("key", F.col("top.root").alias("top"), "nodes", (F.col("nodes") - F.col("top.size")).alias("outside"))
    return placed.join(merged(tops), "key").select("key", "node", "root", "top", "nodes", "outside")


def grouped(rows: DataFrame, size: int = GROUP) -> DataFrame:
    """Columns a < b: pairs of different components that fall into one random group of about ``size`` nodes of a key (other groups at each key)."""
    group = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("nodes") / size))
    dealt = rows.select("key", group.alias("group"), "node", "root")
    others = dealt.select("key", "group", F.col("node").alias("other"), F.col("root").alias("other_root"))
    return dealt.join(merged(others), ["key", "group"]).where("node < other and root <> other_root").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def across(rows: DataFrame) -> DataFrame:
    """Columns a < b: pairs, of different components, of a node outside the largest component of its key and any other node there."""
    ahead = rows.where("root <> top").select("key", F.col("node").alias("other"), F.col("root").alias("other_root"))
    return rows.join(merged(ahead), "key").where("root <> other_root").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def spanning(ours: list[np.ndarray], theirs: list[np.ndarray], component: np.ndarray, other: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (place in ours, place in theirs) of similar sets of different components, as many as tie together all that such pairs tie. component and other: those of ours and theirs."""
    ends = np.cumsum([len(s) for s in theirs])
    sizes = np.diff(ends, prepend=0)
    values, at = np.unique(np.concatenate(theirs), return_inverse=True)
    _, label = np.unique(np.concatenate((component, other)), return_inverse=True)
    label, of = label[: len(ours)], label[len(ours) :]
    # The label of each component, and of those that it was tied to.
    tied = np.arange(len(ours) + len(theirs))
    found, member = [], np.zeros(len(values), bool)
    for i, s in enumerate(ours):
        if (tied[of] == tied[label[i]]).all():
            continue
        places = np.minimum(np.searchsorted(values, s), len(values) - 1)
        places = places[values[places] == s]
        member[places] = True
        both = np.add.reduceat(member[at], ends - sizes, dtype=np.int64)
        member[places] = False
        near = np.flatnonzero(both >= least * (len(s) + sizes - both) - 1e-9)
        while len(near := near[tied[of[near]] != tied[label[i]]]):
            found.append((i, int(near[0])))
            tied[tied == tied[of[near[0]]]] = tied[label[i]]
    return found


def across_blocks(rows: DataFrame, facts: DataFrame, least: float, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Of the pairs of ``across``, similar ones that tie together all that similar ones tie. A key is dealt into blocks of about ``block`` nodes and ``block_shingles`` shingles a side, whatever its size. facts: node, n, bits, set.

    Without the column set, all those pairs that can be similar by their bitmaps.
    """
    kind = rows.schema["node"].dataType.simpleString()
    exact = "set" in facts.columns
    content = "set" if exact else "bits"
    out = F.col("root") != F.col("top")
    sized = rows.join(merged(facts.select("node", "n")), "node")
    shares = sized.groupBy("key").agg(F.sum("n").alias("all_n"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("out_n"))
    known = rows.join(merged(shares), "key").join(merged(facts.select("node", "n", content)), "node").withColumn("h", F.xxhash64("node")).withColumn("component", F.xxhash64("root"))
    parts = lambda nodes, n: F.greatest(F.ceil(F.col(nodes) / block), F.ceil(F.col(n) / block_shingles)).cast("int")
    known = known.select("key", "node", "n", content, "h", "component", parts("outside", "out_n").alias("n_i"), parts("nodes", "all_n").alias("n_j"), out.alias("out"))
    dealt = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    facts_of = ["key", "node", "n", content, "component"]
    sides = lambda left, right: [left.alias("left"), F.lit(right).alias("right")]
    # Where a key is one block, a node is sent once for both sides.
    single = known.where("n_i = 1 and n_j = 1").select(*facts_of, *sides(F.col("out"), True), F.lit(0).alias("i"), F.lit(0).alias("j"))
    several = known.where("n_i > 1 or n_j > 1")
    left = several.where("out").select(*facts_of, *sides(F.lit(True), False), dealt("n_i").alias("i"), every("n_j").alias("j"))
    right = several.select(*facts_of, *sides(F.lit(False), True), dealt("n_j").alias("j"), every("n_i").alias("i"))

    def meet(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)).combine_chunks()
        n, component = found["n"].to_numpy(), found["component"].to_numpy()
        ours, theirs = (np.flatnonzero(found[k].to_numpy()) for k in ("left", "right"))
        nodes = found["node"].combine_chunks()
        made = lambda a, b: pa.RecordBatch.from_arrays([nodes.take(pa.array(a, pa.int64())), nodes.take(pa.array(b, pa.int64()))], ["a", "b"])
        if not len(ours) or not len(theirs):
            return
        if exact:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in found["set"]]
            pairs = spanning([sets[k] for k in ours], [sets[k] for k in theirs], component[ours], component[theirs], least)
            yield made(ours[[i for i, _ in pairs]], theirs[[j for _, j in pairs]])
            return
        bits = found["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        for k in range(0, len(ours), 64):
            a = ours[k : k + 64]
            x, y = bits[a][:, None], bits[theirs][None]
            both = np.minimum(n[a][:, None] - np.bitwise_count(x & ~y).sum(axis=2, dtype=np.int64), n[theirs][None] - np.bitwise_count(y & ~x).sum(axis=2, dtype=np.int64))
            near = (both * (1 + least) >= least * (n[a][:, None] + n[theirs][None]) - 1e-6) & (component[a][:, None] != component[theirs][None])
            i, j = np.nonzero(near)
            yield made(a[i], theirs[j])

    ship(rows.sparkSession)
    pairs = single.unionByName(left).unionByName(right).groupBy("key", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rare_shingles(sets: DataFrame, least: float) -> DataFrame:
    """Columns key, node: the rarest shingles of each set, so many that similar sets share one. sets: node, set.

    Rare by counts of hashes modulo SLOTS, an array of fixed size; that two shingles may share a count does no harm, as the order is the same for all sets.
    """
    kind = sets.schema["node"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(SLOTS, np.int64)
            for x in batch.column(0):
                np.add.at(n, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
            slots = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n[slots])], ["slot", "n"])

    counts = map_arrow(sets.select("set"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = [np.zeros(0, np.uint64)], []
            for x in batch.column(1):
                found = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((found, often[(found % np.uint64(SLOTS)).astype(np.int64)]))
                keys.append(found[order[: len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1]])
                n.append(len(keys[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))], ["key", "node"])

    return map_arrow(sets.select("node", "set"), first, f"key long, node {kind}")


def close(nodes: DataFrame) -> DataFrame:
    """Columns a, b: nodes whose fingerprints are near, at most two rows a node: a node with the smallest of its fingerprint, and that one with the one of the nearest smaller fingerprint. nodes: node, fp."""
    named = stash(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.select("node", "fp").join(merged(named), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda name: named.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_node"))
    other = nearest(named, radius=RADIUS, segments=SEGMENTS).join(merged(of("a")), "a").join(merged(of("b")), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    found = stash(equal.unionByName(other))
    drop(named)
    return found


def links(nodes: DataFrame, texts: DataFrame, least: float, size: int, met: DataFrame | None = None) -> DataFrame | None:
    """Columns a, b: near nodes, enough of them for the components of the near ones of ``met`` (columns a, b) and of all near nodes that share a band value. nodes: node, n (size of its set), bits (its bitmap), bands (its names); texts: node, text (binary)."""
    node = texts.schema["node"].dataType
    kind = f"a {node.simpleString()}, b {node.simpleString()}"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(of_bytes(x), of_bytes(y), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    def of_bytes(x: pa.Scalar) -> np.ndarray:
        return np.frombuffer(x.as_buffer(), np.uint64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), size).tobytes() for x in batch.column(1)], pa.binary())], ["node", "set"])

    places = nodes.select(F.explode("bands").alias("key"), "node")
    several = places.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key")
    open_ = stash(places.join(merged(several), "key", "left_semi"))
    asked = open_.select("node")
    if met is not None:
        asked = asked.unionByName(met.select(F.explode(F.array("a", "b")).alias("node")))
    sets = stash(map_arrow(texts.join(merged(asked.distinct()), "node", "left_semi"), hashed, f"node {node.simpleString()}, set binary"))
    facts = nodes.select("node", "n", "bits")
    side = lambda df, name, **columns: df.select(F.col("node").alias(name), *[F.col(c).alias(k) for k, c in columns.items()])

    def near(pairs: DataFrame) -> DataFrame:
        known = pairs.join(merged(side(facts, "a", n_a="n", bits_a="bits")), "a").join(merged(side(facts, "b", n_b="n", bits_b="bits")), "b")
        known = known.where(may_be_similar(least, "n_a", "bits_a", "n_b", "bits_b")).select("a", "b")
        both = known.join(merged(side(sets, "a", x="set")), "a").join(merged(side(sets, "b", y="set")), "b")
        return stash(map_arrow(both.select("a", "b", "x", "y"), compare, kind))

    first, roots = None, None
    if met is not None:
        first = near(met)
        roots = stash(components(first))
    rows = stash(undecided(open_, roots))
    drop(open_, roots)
    if rows.isEmpty():
        drop(rows, sets)
        return first
    edges = near(grouped(rows))
    if first is not None:
        edges = first.unionByName(edges)
    roots = stash(components(edges))
    # A key that was one group is done.
    apart = stash(undecided(rows.where(F.col("nodes") > GROUP).select("key", "node"), roots))
    drop(rows)
    if not apart.isEmpty():
        crowd = apart.select("node").distinct()
        asked = stash(undecided(rare_shingles(sets.join(merged(crowd), "node", "left_semi"), least), roots))
        tied = stash(across_blocks(asked.where(F.col("nodes") > FEW), facts.join(merged(sets), "node"), least))
        edges = edges.unionByName(near(across(asked.where(F.col("nodes") <= FEW)))).unionByName(tied)
        drop(asked)
    drop(sets, roots, apart)
    return edges


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of docs, with all columns, that stay: one of each component of texts whose similarity is ``least`` or more.

    Rows get a number that is written down, so the choice of a row does not depend on how Spark deals the input.
    """
    number, names, digest, n, bits, fp = free_names(docs.columns, "row", "bands", "set", "n", "bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            found = [shingles(x.as_py() or b"", size) for x in texts]
            batch = batch.append_column(fp, pa.array([fingerprint(x.as_py() or b"") for x in texts], pa.int64()))
            batch = batch.append_column(n, pa.array([len(f) for f in found], pa.int64()))
            batch = batch.append_column(bits, pa.array([bitmap(f) for f in found], pa.list_(pa.int64())))
            batch = batch.append_column(names, pa.array([bands(f) for f in found], pa.list_(pa.int64())))
            yield batch.append_column(digest, pa.array([hashlib.blake2b(f.tobytes(), digest_size=16).digest() for f in found], pa.binary()))

    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    helpers = [StructField(fp, LongType()), StructField(n, LongType()), StructField(bits, ArrayType(LongType())), StructField(names, ArrayType(LongType())), StructField(digest, BinaryType())]
    marked = stash(map_arrow(numbered, run, StructType([*numbered.schema.fields, *helpers])))
    best = F.min(F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col(number).alias("row"))).alias("node")
    nodes = stash(marked.groupBy(digest).agg(best, F.first(n).alias("n"), F.first(bits).alias("bits"), F.first(names).alias("bands"), F.min(fp).alias("fp")).select("node", "n", "bits", "bands", "fp"))
    texts = marked.select(F.col(number).alias("row"), utf8(text_col).alias("text")).join(merged(nodes.select("node", F.col("node.row").alias("row"))), "row").select("node", "text")
    met = close(nodes)
    edges = links(nodes, texts, least, size, met)
    drop(met)
    chosen = nodes.select("node")
    if edges is not None:
        chosen = chosen.join(merged(components(edges).where("node <> root").select("node")), "node", "left_anti")
    return marked.join(merged(chosen.select(F.col("node.row").alias(number))), number, "left_semi").select(*docs.columns)
