"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into segments. By the pigeonhole principle, two fingerprints within ``radius`` bits
agree in some segment up to a small Hamming ball; so each fingerprint enumerates the balls around its segments,
fetches the table rows with such a segment, and compares complete distances (Norouzi, Punjani and Fleet, 2012).
Links make connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Equal fingerprints are one node: a group of copies of any size is aggregated before the search and is never paired.

Defined results: a null or empty text has fingerprint 0, linked like any other; rows with a null id get the smallest
id that their component holds (null if it holds none); repeated rows repeat in the result; a text of any length is read whole, in memory in
proportion to its length; a bit set in exactly half of the shingles is 0; an empty table gives none; extra columns are kept or left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from crawlstrata.llm.common import drop, free_names, map_arrow, merged, stash, table, utf8

#: Shingles counted at once, so a very long text takes bounded memory.
BLOCK = 1 << 16
#: Up to so many edges Spark may broadcast a side of the joins of components.
FEW_EDGES = 100_000


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of a text's lower-cased word shingles, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[-n:].tolist()
    starts = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Columns: id, fp (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), size) for x in batch.column(1)], pa.int64())], ["id", "fp"])

    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` of the low ``bits`` bits."""
    return [sum(1 << k for k in which) for r in range(radius + 1) for which in combinations(range(bits), r)]


def meetings(nodes: DataFrame, fp: str, radius: int, segments: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Columns a, segment, value: the segments of each fingerprint; and b, segment, value: the balls around them. Fingerprints within ``radius`` bits meet in both.

    With radius = m * q + r for m segments, of two near fingerprints one of the first r + 1 segments is within q bits,
    or one of the others is within q - 1.
    """
    q, r = divmod(radius, segments)
    cuts = [bits * k // segments for k in range(segments + 1)]
    keys, probes = [], []
    for k in range(segments):
        near = q if k <= r else q - 1
        if near < 0:
            continue
        width = cuts[k + 1] - cuts[k]
        value = F.shiftrightunsigned(F.col(fp), cuts[k]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        keys.append(F.struct(F.lit(k).alias("segment"), value.alias("value")))
        probes.append(F.array(*[F.struct(F.lit(k).alias("segment"), value.bitwiseXOR(F.lit(m).cast("long")).alias("value")) for m in ball(width, near)]))
    index = nodes.select(F.col(fp).alias("a"), F.explode(F.array(*keys)).alias("at")).select("a", "at.segment", "at.value")
    asked = nodes.select(F.col(fp).alias("b"), F.explode(F.concat(*probes)).alias("at")).select("b", "at.segment", "at.value")
    return index, asked


def links(nodes: DataFrame, fp: str = "fp", radius: int = 2, segments: int = 2, bits: int = 64, crowded: int = 4000) -> DataFrame:
    """Columns a < b: distinct fingerprints at most ``radius`` bits apart. ``nodes`` holds each fingerprint once.

    Comparing all that meet at a segment value would grow with the square of a crowd of near copies; so fingerprints at a
    value that more than ``crowded`` share enumerate their whole ball instead, whose size does not depend on the crowd.
    """
    index, asked = meetings(nodes, fp, radius, segments, bits)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowds = stash(index.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("segment", "value"))
    if crowds.isEmpty():
        return index.join(merged(asked), ["segment", "value"]).where(near).select("a", "b").distinct()
    found = index.join(crowds, ["segment", "value"], "left_anti").join(merged(asked), ["segment", "value"]).where(near).select("a", "b")
    inside = index.join(crowds, ["segment", "value"], "left_semi").select("a").distinct()
    masks = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in ball(bits, radius)[1:]])
    reached = inside.select("a", F.explode(masks).alias("mask")).select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("b"))
    more = reached.join(merged(nodes.select(F.col(fp).alias("b"))), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(more).distinct()


def nearest(nodes: DataFrame, fp: str = "fp", radius: int = 2, segments: int = 2, bits: int = 64, crowd: int = 256) -> DataFrame:
    """Columns a < b: each fingerprint with the nearest smaller one at most ``radius`` bits away (of equally near ones the smallest), if there is one.

    For callers that have another way for the links left out: one row a fingerprint, whatever the crowds, and a segment value that more than
    ``crowd`` fingerprints share is dealt at random into parts of about that size, which do not meet there.
    """
    index, asked = meetings(nodes, fp, radius, segments, bits)
    at = ["segment", "value"]
    crowds = stash(index.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*at, F.ceil(F.col("n") / crowd).alias("parts")))
    if crowds.isEmpty():
        drop(crowds)
    else:
        dealt = lambda df, name: df.join(crowds, at, "left").select(name, *at, F.coalesce(F.pmod(F.xxhash64(name), F.col("parts")), F.lit(0)).alias("part"))
        index, asked, at = dealt(index, "a"), dealt(asked, "b"), [*at, "part"]
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = index.join(merged(asked), at).where((F.col("a") < F.col("b")) & (differ <= radius))
    return found.groupBy("b").agg(F.min(F.struct(differ.alias("bits"), "a")).alias("least")).select("least.a", "b")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Columns node, root: every node of the edges (a, b) with the smallest node of its component."""
    edges = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # Large star: every larger neighbour of u is linked to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        side = merged if seen[0] > FEW_EDGES else lambda df: df
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of u, and u itself, are linked to the least of them.
        large = stash(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, stash(small.where("u <> v").distinct())
        drop(before, large)
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """Columns: id, fp, component_id (smallest id reachable by links)."""
    marked = stash(fingerprints(docs, id_col, text_col, size))
    nodes = stash(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(nodes, radius=radius, segments=segments)).withColumnRenamed("node", "fp")
    placed = nodes.join(merged(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(merged(least), "root").select("fp", "component_id")
    return marked.join(merged(named), "fp").select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """The rows of docs, with all columns, that stay: of each component the one of the smallest id (null ids last), and of repeated rows one.

    Rows get a number that is written down, so the choice of a row does not depend on how Spark deals the input.
    """
    number, fp = free_names(docs.columns, "row", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            yield batch.append_column(fp, pa.array([fingerprint(x.as_py() or b"", size) for x in texts], pa.int64()))

    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    marked = stash(map_arrow(numbered, run, StructType([*numbered.schema.fields, StructField(fp, LongType())])))
    best = F.min(F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col(number).alias("row"))).alias("best")
    nodes = stash(marked.groupBy(F.col(fp).alias("fp")).agg(best))
    roots = components(links(nodes, radius=radius, segments=segments)).withColumnRenamed("node", "fp")
    chosen = nodes.join(merged(roots), "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(number))
    return marked.join(merged(chosen), number, "left_semi").select(*docs.columns)


def op10_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_multi_index_simhash": op10_multi_index_simhash}
