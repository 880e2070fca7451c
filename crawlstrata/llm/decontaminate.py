"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Spans of hit words are reported (``contamination``), cut out beyond limits of length and coverage (``strip_contaminated``), or
take their document with them (``drop_contaminated``). A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The
automaton of all items is built once from the (bounded) item table. Documents stream through it word by word; at
each word the length of the longest match that ends there says which windows end there.

Defined results: a null text has no words; repeated items and repeated documents count each on their own; an empty
item table contaminates nothing; items without words never occur. Item ids are compared as text. Documents are
processed whole at any length, one at a time, in the order they come; an empty table of documents gives none.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.llm.common import free_names, map_arrow, stash, table, utf8

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space; bytes from 0x80 on stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Text of the items in one automaton. It takes about 140 times as much memory, on the driver and in each Python worker.
BLOCK_BYTES = 2 << 20


def words(text: bytes) -> list[bytes]:
    """The normalised words of a text's bytes."""
    return text.translate(FOLD).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        own: list[set[int]] = [set()]
        short: dict[int, tuple[int, list[int]]] = {}
        for k, (_, sequence) in enumerate(items):
            last = 0
            for w in sequence:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), own)
                own[last].add(k)
            if 0 < len(sequence) < window:
                short.setdefault(last, (len(sequence), []))[1].append(k)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        # An item belongs to a state if any of its positions does: sets flow up the suffix links of long states.
        for s in order:
            if self.length[self.link[s]] >= window:
                own[self.link[s]] |= own[s]
        self.items = [frozenset(x) if self.length[s] >= window else frozenset() for s, x in enumerate(own)]
        #: For each state, short items that end there: (length, items) for it and for its shorter suffixes.
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.next)
        for s in reversed(order):
            mine = ((short[s][0], tuple(short[s][1])),) if s in short else ()
            self.short[s] = mine + self.short[self.link[s]]
        self.least = min([window, *(n for n, _ in short.values())])

    def _new(self, length: int, link: int, moves: dict[int, int], own: list[set[int]]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        own.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, w: int, own: list[set[int]]) -> int:
        """Add word w after the sequence that ends in state ``last``."""
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, own)
        new, p = self._new(self.length[last] + 1, 0, {}, own), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, own)
        return new

    def _split(self, p: int, w: int, q: int, own: list[set[int]]) -> int:
        half = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), own)
        own[half] = set(own[q])
        self.link[q] = half
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs [start, end) of hit words, and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in sequence), np.int64, len(sequence))
        # Only stretches of known words at least as long as the shortest window can hold one.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(*(x[ends - starts >= self.least].tolist() for x in (starts, ends)), strict=True):
            self._walk(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _walk(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        state, n, moves, link, length, window = 0, 0, self.next, self.link, self.length, self.window
        for i, w in enumerate(ids, at + 1):
            while state and w not in moves[state]:
                state = link[state]
                n = length[state]
            if w in moves[state]:
                state, n = moves[state][w], n + 1
            longest = 0
            if n >= window:
                top = state
                while length[link[top]] >= window:
                    top = link[top]
                found |= self.items[top]
                longest = window
            for size, which in self.short[state]:
                if size <= n:
                    found.update(which)
                    longest = max(longest, size)
            if longest:
                start = i - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """Parts of the items, each of about block_bytes at most, dealt by a hash of the id."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == k) for k in range(n)]


def _shared(block: DataFrame, item_id: str, text: str, window: int) -> Broadcast:
    """The automaton of a block of items, pickled, on all executors, and its name."""
    pairs = block.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), utf8(text)).collect()
    made = pickle.dumps(ItemAutomaton([(a, words(bytes(b))) for a, b in pairs], window))
    return block.sparkSession.sparkContext.broadcast((hashlib.blake2b(made).hexdigest(), made))


_LOADED: dict[str, ItemAutomaton] = {}


def _loaded(model: Broadcast) -> ItemAutomaton:
    """The automaton of a broadcast; a worker keeps the last one from one task to the next."""
    name, made = model.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = pickle.loads(made)
    return _LOADED[name]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns: id, n_words, spans (array of [start, end) in words), items (sorted array of item ids as text).

    The automaton goes to the executors as a broadcast of a size proven beforehand: items beyond ``block_bytes`` of
    text are split into blocks, each with an automaton of its own that all documents pass; spans and items are united.
    """
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _row long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    blocks = _blocks(items, item_id, item_text, block_bytes)
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), utf8(text_col).alias("_text"))
    if len(blocks) > 1:
        rows = stash(rows)
    parts = []
    for block in blocks:
        model = _shared(block, item_id, item_text, window)

        def scan(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            automaton = _loaded(model)
            for batch in batches:
                n_words, spans, names = [], [], []
                for text in batch.column(2):
                    sequence = words(text.as_py())
                    runs, found = automaton.scan(sequence)
                    n_words.append(len(sequence))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    names.append(sorted({automaton.names[k] for k in found}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string()))], ["_id", "_row", "n_words", "spans", "items"])

        parts.append(map_arrow(rows, scan, schema))
    out = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.withColumn("spans", _united("spans"))
    return out.select(F.col("_id").alias(id_col), "n_words", "spans", "items")


def _united(spans: str):
    """Overlapping and touching spans made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        touching = (F.size(done) > 0) & (last["end"] >= span["start"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(touching, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), none, add)


def hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Add n_hit and contaminated: at least one word is hit, and one in ``share`` or more."""
    hit = found.withColumn("n_hit", hit_words())
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all columns, whose share of hit words stays below the limit.

    With one automaton a task drops rows as it reads them. With several, rows get a number, by which the spans of all
    automata are united first. Both keep the same rows.
    """
    blocks = _blocks(items, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        model = _shared(items, item_id, item_text, window)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _loaded(model)
            for batch in batches:
                keep = []
                for x in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()):
                    sequence = words(x.as_py() or b"")
                    hit = sum(end - start for start, end in automaton.scan(sequence)[0])
                    keep.append(hit == 0 or hit * share < len(sequence))
                yield batch.filter(pa.array(keep, pa.bool_()))

        return map_arrow(docs, clean, docs.schema)
    (number,) = free_names(docs.columns, "row")
    numbered = stash(docs.withColumn(number, F.monotonically_increasing_id()))
    bad = verdict(contamination(numbered, items, number, text_col, item_id, item_text, window, block_bytes), share).where("contaminated").select(number)
    return numbered.join(bad, number, "left_anti").select(*docs.columns)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without these spans of its words; what stands between words stays."""
    # Folding keeps the place of every byte.
    places = [m.span() for m in re.finditer(rb"[^\x20]+", text.translate(FOLD))]
    left, at = [], 0
    for a, b in spans:
        left.append(text[at : places[a][0]])
        at = places[b - 1][1]
    left.append(text[at:])
    return b"".join(left)


def exceeding(spans: list[tuple[int, int]], n_words: int, longest: int, share: int) -> list[tuple[int, int]]:
    """Spans that are to be cut: all where one in ``share`` words or more is hit, else those of more than ``longest`` words."""
    hit = sum(b - a for a, b in spans)
    return spans if hit and hit * share >= n_words else [(a, b) for a, b in spans if b - a > longest]


def strip_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, longest: int = 50, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all columns, without the spans that exceed the limits of length and coverage; rows without a word left go.

    Spans are cut if they are longer than ``longest`` words, and all of a document of whose words one in ``share`` is hit. A column n_chars, where there
    is one, is counted anew for changed texts. A text without hits, or without words, stays as it is.
    """
    at = docs.columns.index(text_col)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batch: pa.RecordBatch, found: Iterator[list[tuple[int, int]]]) -> pa.RecordBatch:
        """The batch (columns of docs) with cut texts, from all spans of each row."""
        columns = batch.columns[: len(docs_fields)]
        texts, sizes, keep = columns[at].to_pylist(), columns[counted].to_pylist() if counted is not None else [], []
        for k, spans in enumerate(found):
            gone = exceeding(spans, len(words((texts[k] or "").encode())), longest, share) if spans else []
            if gone:
                body = cut_words(texts[k].encode(), gone)
                texts[k] = body.decode()
                if sizes:
                    sizes[k] = len(texts[k])
            keep.append(not gone or bool(words(texts[k].encode())))
        columns[at] = pa.array(texts, columns[at].type)
        if counted is not None:
            columns[counted] = pa.array(sizes, columns[counted].type)
        return pa.RecordBatch.from_arrays(columns, docs_fields).filter(pa.array(keep, pa.bool_()))

    docs_fields = docs.columns
    blocks = _blocks(items, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        model = _shared(items, item_id, item_text, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _loaded(model)
            for batch in batches:
                texts = batch.column(at).cast(pa.binary())
                yield cut(batch, (automaton.scan(words(x.as_py() or b""))[0] for x in texts))

        return map_arrow(docs, run, docs.schema)
    number, spans_col = free_names(docs.columns, "row", "spans")
    numbered = stash(docs.withColumn(number, F.monotonically_increasing_id()))
    spans = contamination(numbered, items, number, text_col, item_id, item_text, window, block_bytes).where(F.size("spans") > 0).select(number, F.col("spans").alias(spans_col))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(docs_fields)).to_pylist()
            yield cut(batch, ([(s["start"], s["end"]) for s in r or []] for r in rows))

    return map_arrow(numbered.join(spans, number, "left").select(*docs.columns, spans_col), apply, docs.schema)


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document; contaminated if a twentieth of its words or more is hit."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = verdict(found)
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {"op8_suffix_automaton": op8_suffix_automaton}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op8_suffix_automaton": f"""with d as (select doc_id, row_number() over () as r, {_WORDS} as ws from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark),
iw as (select distinct item, least(13, len(ws)) as m, list_slice(ws, k, k + least(13, len(ws)) - 1) as win
 from (select item, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as k from i where len(ws) > 0)),
sizes as (select distinct m from iw),
dw as (select r, m, k, list_slice(ws, k, k + m - 1) as win from (select r, ws, m, unnest(range(1, len(ws) - m + 2)) as k from d cross join sizes)),
hits as (select dw.r, dw.k, dw.m, iw.item from dw join iw on dw.m = iw.m and dw.win = iw.win),
hit as (select r, count(*) as n from (select distinct r, unnest(range(k, k + m)) as p from hits) group by r),
items as (select r, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct r, item from hits) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(items.s, '')) as items_sha256,
 coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(ws) as contaminated
from d left join hit on hit.r = d.r left join items on items.r = d.r""",
}
