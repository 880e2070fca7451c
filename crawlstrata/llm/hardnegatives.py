"""Hard negatives for contrastive training: rows of another label that score nearly as high as a positive.

Scores are exact integer inner products by the method of the Four Russians. Of an anchor, every eight components form a
group with a table of the sums of all 256 subsets; a candidate's components are bit planes in two's complement, eight bits
of a plane packed into a byte. A byte of plane and group is the index of the subset whose sum it adds; planes are added from
the highest (which counts negative) down, doubling in between. A table row holds the sums of all anchors of a block.

Anchors are dealt into blocks of about ``block`` rows; each block meets all rows, in the tasks that read them, and a task
sends the best few rows of each anchor on, which Spark puts in order. Nothing else is sent: memory follows the block and the
chunk, and rows sent follow anchors times tasks. First the positives are found, then the negatives in the window of scores of
each. The tables of a block are the only data broadcast, and bounded by ``block``.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of
different lengths are compared as if the shorter ended in zeros; scaled components beyond +-2^24 are held there, so that
every score fits a long. Rows of equal score stand in the order of their ids; repeated rows each count, also as anchors.
An anchor without another row of its label, and a positive without a negative in its window, give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlstrata.llm.common import map_arrow, stash, table

#: Scaled components are held to +-LIMIT.
LIMIT = 1 << 24
#: Candidates scored at once against all anchors of a block.
CHUNK = 1024


def scaled(vectors: pa.Array | pa.ChunkedArray, scale: int) -> tuple[np.ndarray, int]:
    """floor(scale * x) of list vectors as a matrix, padded with zeros, and its width."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(flat.offsets.to_numpy()) if len(flat) else np.zeros(0, int)
    values = np.clip(np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out, width


def wide(x: np.ndarray, width: int) -> np.ndarray:
    """A matrix padded with zero columns to a width."""
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Array (groups, 256, anchors): of each group of eight components the sums of all subsets, built by adding one component to the half known."""
    n, width = anchors.shape
    groups = -(-width // 8)
    cut = wide(anchors, 8 * groups).T.reshape(groups, 8, n)
    sums = np.zeros((groups, 256, n), np.int64)
    for k in range(8):
        sums[:, 1 << k : 2 << k] = sums[:, : 1 << k] + cut[:, k, None]
    return sums


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """Array (planes, groups, rows) of bytes: bits of two's complement, lowest plane first, the last one the sign."""
    planes = int(max(int(rows.max(initial=0)).bit_length(), int(-1 - rows.min(initial=0)).bit_length() if rows.size and rows.min() < 0 else 0)) + 1
    return np.stack([np.packbits((rows >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes)])


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Matrix (rows, anchors) of inner products."""
    out = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    for p in range(len(planes) - 1, -1, -1):
        out += out
        for g in range(planes.shape[1]):
            if p == len(planes) - 1:
                out -= sums[g][planes[p, g]]
            else:
                out += sums[g][planes[p, g]]
    return out


class Block:
    """Anchors with their tables, as workers use them."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.labels, self.vectors = rows, labels, vectors

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Matrix (rows, anchors). Sums are added in 32 bits where no score can leave them."""
        width = max(self.vectors.shape[1], rows.shape[1])
        if not width:
            return np.zeros((len(rows), len(self.rows)), np.int64)
        if not hasattr(self, "sums") or self.width != width:
            self.width, self.sums = width, subset_sums(wide(self.vectors, width))
        largest = np.abs(self.vectors).sum(axis=1).max(initial=0) * (int(np.abs(rows).max(initial=0)) + 1) * 2
        return scores(self.sums.astype(np.int32) if largest < 1 << 31 else self.sums, bit_planes(wide(rows, width)))


def best_of(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each group, by descending score, then id, then row."""
    order = np.lexsort((row, vec_id, -score, group))
    sorted_ = group[order]
    start = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate((start, [len(order)]))))
    return order[place < k]


class Best:
    """The first k candidates of each of n lists so far; a floor below which nothing can enter any more."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor = k, np.full(n, np.iinfo(np.int64).min)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, found: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(found):
            return
        both = [np.concatenate(pair) for pair in zip(self.held, (found, score, vec_id, row), strict=True)]
        kept = best_of(*both, self.k)
        self.held = [x[kept] for x in both]
        lists, n = np.unique(self.held[0], return_counts=True)
        last = np.cumsum(n) - 1
        self.floor[lists[n == self.k]] = self.held[1][last[n == self.k]]


def usable(rows: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str, relabel: Column | None) -> DataFrame:
    """Columns vec_id, vector, label, a row number and whether it is an anchor, of the rows that take part."""
    label = F.col(label_col) if relabel is None else relabel
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), label.cast("long").alias("label"), F.monotonically_increasing_id().alias("row"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def _scan(rows: DataFrame, block: Block, limits: tuple[np.ndarray, np.ndarray, np.ndarray] | None, k: int, scale: int, chunk: int) -> DataFrame:
    """Columns list, score, vec_id, row: the first k rows in each task for each list of a block.

    Without limits the lists are the anchors, and rows of the same label other than itself count. With limits (anchor,
    least and greatest score of each list) rows of another label in the window count.
    """
    shared = rows.sparkSession.sparkContext.broadcast((block, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, bounds = shared.value
        best = Best(len(anchors.rows) if bounds is None else len(bounds[0]), k)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                vec_id, label, row = (piece.column(c).to_numpy() for c in (0, 2, 3))
                score = anchors.score(scaled(piece.column(1), scale)[0])
                if bounds is None:
                    here = (label[:, None] == anchors.labels) & (row[:, None] != anchors.rows) & (score >= best.floor)
                    c, found = np.nonzero(here)
                    best.add(found, score[c, found].astype(np.int64), vec_id[c], row[c])
                else:
                    # All lists of an anchor stand side by side; slot s holds the s-th list of each.
                    of, low, high = bounds
                    other = label[:, None] != anchors.labels
                    slot = np.arange(len(of)) - np.searchsorted(of, of)
                    for s in range(int(slot.max(initial=-1)) + 1):
                        lists = np.flatnonzero(slot == s)
                        mine = score[:, of[lists]]
                        here = other[:, of[lists]] & (mine <= high[lists]) & (mine >= np.maximum(low[lists], best.floor[lists]))
                        c, found = np.nonzero(here)
                        best.add(lists[found], mine[c, found].astype(np.int64), vec_id[c], row[c])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.held], ["list", "score", "vec_id", "row"])

    return map_arrow(rows.select("vec_id", "vector", "label", "row"), run, "list long, score long, vec_id long, row long")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each list, with their rank from 1. A list has k rows from each task at most."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: Column | None = None, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5), scale: int = 256, block: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on the input's rows; ``relabel`` replaces labels (a column over the input). A negative's score lies between
    ``share`` (a fraction) of the positive's score and that score.
    """
    own = stash(usable(rows, anchor, id_col, vector_col, label_col, relabel))
    asking = own.where("anchor")
    n_blocks = max(1, -(-asking.count() // block))
    number = F.pmod(F.xxhash64("row"), F.lit(n_blocks))
    out = None
    for b in range(n_blocks):
        held = asking.where(number == b).orderBy("row").toArrow()
        ids, at = held["vec_id"].to_numpy(), held["row"].to_numpy()
        those = Block(at, held["label"].to_numpy(), scaled(held["vector"], scale)[0])
        near = first_of(_scan(own, those, None, positives, scale, chunk), positives).toArrow()
        order = np.lexsort((near["rank"].to_numpy(), near["list"].to_numpy()))
        of, score, positive = (near[c].to_numpy()[order] for c in ("list", "score", "vec_id"))
        low = -(-share[0] * score // share[1])
        found = first_of(_scan(own, those, (of, low, score), negatives, scale, chunk), negatives)
        lists = pa.table({"list": np.arange(len(of)), "anchor_id": ids[of].astype(np.int64), "positive_id": positive.astype(np.int64), "positive_score": score.astype(np.int64)})
        named = rows.sparkSession.createDataFrame(lists)
        part = found.join(F.broadcast(named), "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return out


def op13_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row, against all rows."""
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=relabel)


SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as "rank"
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, "rank", negative_id, positive_score, negative_score from n where "rank" <= 5"""

QUERIES = {"op13_four_russians_negatives": op13_four_russians_negatives}
ORACLE_SQL = {"op13_four_russians_negatives": SQL}
