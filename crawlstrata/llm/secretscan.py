"""Secrets in texts: rules for known forms, and a character convolutional network over every other candidate.

Rules give base findings of three kinds (``KINDS``). A candidate is a maximal run of 12 or more characters of which
keys and tokens are made; it is seen in pieces of 64 characters with 24 characters of context on either side. The network
(numpy) embeds characters, those of the candidate apart from those around it, and takes maximum and mean of two
convolutions. It learns from labelled findings: candidates that a rule found against those that none found. A third of the
examples lose part of their context, a third take part of that of another one, and half of the findings are spelled anew with random characters
of a usual alphabet, so that neither key words nor known tokens are learned by heart. Scores are calibrated on other candidates, varied likewise, and the threshold of each
class of characters is the greatest that still finds ``recall`` of them. Candidates at or above it that overlap no base finding are added as ``learned``.

Training reads the candidates of all texts, each distinct window (of a long candidate the first piece) once: a fourth, by a hash, calibrates, the others
are learned from. They are dealt by a hash into groups of about ``group``. The first group learns from nothing; then two rounds follow, of half of the other groups
each, which learn side by side from where the last round ended, and their weights are averaged. Calibration and thresholds come from a tally of the scores of
all held windows. So no step reads a sample, and no task more than a group; every candidate of every text is scored.

Defined results: a null or empty text has no findings; equal texts give equal findings; a candidate of any length is seen
whole, its score is that of its best piece; characters that are not ASCII are all alike to the network; offsets count code
points (bytes that are not UTF-8 count as one each); without findings to learn from nothing is added; an empty table gives none; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.llm.common import drop, map_arrow, stash, table, utf8
from crawlstrata.llm.quality import fit_curve
from crawlstrata.shipping import ship

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
#: The forms of base findings, and the least length of a value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: Without one of these in lower case, no key word is in a text.
KEY_PARTS = ("passw", "secret", "token", "api")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
#: Every match of ACCESS and HEX of the asked length lies in a candidate.
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{12,}")
CONTEXT, PIECE = 24, 64
WINDOW = PIECE + 2 * CONTEXT
#: Codes: 0 nothing, 1 to 95 printable ASCII, 96 other; the same again for characters of the candidate.
CODES = 97
_CODE = np.full(256, 96, np.uint8)
_CODE[0] = 0
_CODE[32:127] = np.arange(1, 96)
#: The character of each code.
_CHARACTER = [*range(1), *range(32, 127), 0]
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = [_CODE[list(a.encode())] for a in (*_ALPHABETS, _LETTERS, _LETTERS + "+/", _LETTERS + "-_")]
CLASSES = 3
#: Windows with and without a finding in a step, and findings that each group has at least (or all); steps of a logit in the tally of scores, and its range.
WITH, WITHOUT, FEW = 32, 96, 128
FINE, FAR = 256, 32
#: Weights are added up as whole numbers, so that the sum does not depend on the order.
SCALE = 1 << 20
#: Share by which a step makes weights smaller, so that few findings among many windows are not learned by heart.
DECAY = 1e-3


def base_findings(text: str, candidates: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind), in order."""
    found = []
    low = text.lower()
    if any(part in low for part in KEY_PARTS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    for a, b in candidates:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_LENGTH]
        found += [(*m.span(), 2) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(found, key=lambda x: (x[0], x[2]))


def overlapping(spans: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each span shares a character with a finding. Both are in order of their starts."""
    out, k, reach = [], 0, -1
    for a, b in spans:
        while k < len(found) and found[k][0] < b:
            reach = max(reach, found[k][1])
            k += 1
        out.append(reach > a)
    return out


def character_class(value: str) -> int:
    """0: hexadecimal digits of one case, 1: capitals and digits, 2: others."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        return 0
    return 1 if re.fullmatch("[A-Z0-9]+", value) else 2


def window_class(codes: np.ndarray) -> int:
    """The class of the candidate's characters in a window."""
    return character_class(bytes(_CHARACTER[c - CODES] for c in codes if c >= CODES).decode())


def windows(text: str, span: tuple[int, int]) -> bytes:
    """Codes of the pieces of a candidate, WINDOW bytes each."""
    parts = []
    for a in range(span[0], span[1], PIECE):
        b = min(a + PIECE, span[1])
        before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
        raw = (before.rjust(CONTEXT, "\0") + text[a:b] + after).ljust(WINDOW, "\0").encode("ascii", "replace")
        code = _CODE[np.frombuffer(raw, np.uint8)]
        code[CONTEXT : CONTEXT + b - a] += CODES
        parts.append(code.tobytes())
    return b"".join(parts)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, row (a number), base findings (starts, ends, kinds) and candidates (starts, ends, whether a finding overlaps, class, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            base, seen = [], []
            for t in batch.column(1):
                text = t.as_py().decode("utf-8", "replace")
                spans = [m.span() for m in CANDIDATE.finditer(text)]
                found = base_findings(text, spans)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                seen.append([{"start": a, "end": b, "found": f, "class": character_class(text[a:b]), "windows": windows(text, (a, b))} for (a, b), f in zip(spans, overlapping(spans, found), strict=True)])
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(base, BASE), pa.array(seen, SEEN)], ["id", "row", "base", "candidates"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, row long, base array<struct<start:int,end:int,kind:int>>, candidates array<struct<start:int,end:int,found:boolean,class:int,windows:binary>>"
    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, schema)


BASE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
SEEN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("found", pa.bool_()), ("class", pa.int32()), ("windows", pa.binary())]))


class Network:
    """Embedding, two convolutions with maximum and mean over the window, one hidden layer, one output."""

    EMBEDDED, FILTERS, WIDTHS, HIDDEN = 8, 16, (3, 7), 16

    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        features = 2 * self.FILTERS * len(self.WIDTHS)
        self.weights = {"embed": normal(2 * CODES, self.EMBEDDED, scale=0.5), "hidden": normal(features, self.HIDDEN, scale=features**-0.5), "hidden0": np.zeros(self.HIDDEN, np.float32), "out": normal(self.HIDDEN, scale=self.HIDDEN**-0.5), "out0": np.zeros(1, np.float32)}
        for w in self.WIDTHS:
            self.weights[f"conv{w}"] = normal(w * self.EMBEDDED, self.FILTERS, scale=(w * self.EMBEDDED) ** -0.5)
            self.weights[f"bias{w}"] = np.zeros(self.FILTERS, np.float32)

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows (rows, WINDOW), and what the gradient needs."""
        p, n = self.weights, len(codes)
        x = p["embed"][codes]
        pooled, kept = [], {"codes": codes}
        for w in self.WIDTHS:
            places = WINDOW - w + 1
            columns = np.concatenate([x[:, k : k + places] for k in range(w)], axis=2).reshape(n * places, -1)
            y = np.maximum(columns @ p[f"conv{w}"] + p[f"bias{w}"], 0).reshape(n, places, -1)
            pooled += [y.max(axis=1), y.mean(axis=1)]
            kept[w] = (columns, y)
        features = np.concatenate(pooled, axis=1)
        hidden = np.maximum(features @ p["hidden"] + p["hidden0"], 0)
        kept |= {"features": features, "hidden": hidden}
        return hidden @ p["out"] + p["out0"], kept

    def gradient(self, slope: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        """Gradient of the weights, from the slope of the loss by each logit."""
        p, n, f = self.weights, len(slope), self.FILTERS
        back = slope[:, None] * p["out"] * (kept["hidden"] > 0)
        grad = {"out": kept["hidden"].T @ slope, "out0": slope.sum(keepdims=True), "hidden": kept["features"].T @ back, "hidden0": back.sum(axis=0)}
        pooled = back @ p["hidden"].T
        dx = np.zeros((n, WINDOW, self.EMBEDDED), np.float32)
        for k, w in enumerate(self.WIDTHS):
            columns, y = kept[w]
            places = y.shape[1]
            most, mean = pooled[:, 2 * k * f : (2 * k + 1) * f], pooled[:, (2 * k + 1) * f : (2 * k + 2) * f]
            dy = np.repeat(mean[:, None] / places, places, axis=1)
            np.put_along_axis(dy, y.argmax(axis=1)[:, None], np.take_along_axis(dy, y.argmax(axis=1)[:, None], axis=1) + most[:, None], axis=1)
            dy = (dy * (y > 0)).reshape(n * places, f)
            grad[f"conv{w}"], grad[f"bias{w}"] = columns.T @ dy, dy.sum(axis=0)
            dc = (dy @ p[f"conv{w}"].T).reshape(n, places, w, self.EMBEDDED)
            for j in range(w):
                dx[:, j : j + places] += dc[:, :, j]
        flat, dx = kept["codes"].ravel(), dx.reshape(-1, self.EMBEDDED)
        grad["embed"] = np.stack([np.bincount(flat, dx[:, d], 2 * CODES) for d in range(self.EMBEDDED)], axis=1)
        return grad

    def logits(self, codes: np.ndarray, rows: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(codes[k : k + rows])[0] for k in range(0, len(codes), rows)] or [np.zeros(0, np.float32)])


def varied(codes: np.ndarray, finding: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """A third of the windows as they are, a third with part of their context and a third in part of that of another window; half of the findings spelled anew."""
    out, inside = codes.copy(), codes >= CODES
    ends = CONTEXT + inside.sum(axis=1)
    turn, other, anew = draw.integers(0, 3, len(out)), draw.permutation(len(out)), finding & (draw.random(len(out)) < 0.5)
    out[(turn > 0)[:, None] & ~inside] = 0
    for k in np.flatnonzero(turn > 0):
        j = other[k] if turn[k] == 2 else k
        before, after = draw.integers(0, CONTEXT + 1, 2)
        out[k, CONTEXT - before : CONTEXT] = codes[j, CONTEXT - before : CONTEXT]
        out[k, ends[k] : ends[k] + after] = codes[j, ends[j] : ends[j] + after]
    for k in np.flatnonzero(anew):
        at = slice(CONTEXT, ends[k])
        out[k, at] = draw.choice(ALPHABETS[draw.integers(len(ALPHABETS))], ends[k] - CONTEXT) + CODES
    return out


@dataclass
class SecretModel:
    """A network, the slope and offset of its calibration, and a threshold for each class of characters."""

    network: Network
    slope: float
    offset: float
    thresholds: list[float]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.logits(codes) + self.offset, -40, 40)))


def threshold(probabilities: np.ndarray, recall: float, counts: np.ndarray | None = None) -> float:
    """The greatest threshold that at least a share ``recall`` of the findings reach. counts: how often each occurs."""
    order = np.argsort(probabilities)[::-1]
    reach = np.cumsum(np.ones(len(order), np.int64) if counts is None else counts[order])
    return float(probabilities[order[np.searchsorted(reach, np.ceil(recall * reach[-1]))]])


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the windows of a group and whether a finding overlaps, in an order of their own."""
    got = pa.Table.from_batches(list(batches)).select(["window", "found"]).sort_by([("window", "ascending"), ("found", "ascending")])
    codes = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return codes, got["found"].to_numpy().astype(bool)


def _learn(network: Network, codes: np.ndarray, finding: np.ndarray, draw: np.random.Generator, rate: float, steps: int) -> None:
    """Steps of Adam, at least ``steps`` of them and as many as show every window once; kinds weigh the same."""
    pools = [np.flatnonzero(finding), np.flatnonzero(~finding)]
    if not all(map(len, pools)):
        return
    sizes = (WITH, WITHOUT)
    steps = max(steps, *(-(-len(pool) // n) for pool, n in zip(pools, sizes, strict=True)))
    shown = [np.concatenate([draw.permutation(pool) for _ in range(-(-steps * n // len(pool)))])[: steps * n].reshape(steps, n) for pool, n in zip(pools, sizes, strict=True)]
    share = np.repeat([0.5 / n for n in sizes], sizes)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.weights.items()}
    for t in range(1, steps + 1):
        rows = np.concatenate([x[t - 1] for x in shown])
        truth = finding[rows]
        logit, kept = network.forward(varied(codes[rows].astype(np.int64), truth, draw))
        slope = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - truth) * share).astype(np.float32)
        now = rate * min(1.0, 2 * (steps - t + 1) / steps)
        for k, g in network.gradient(slope, kept).items():
            g = g + DECAY * network.weights[k]
            m, v = moments[k] = (0.9 * moments[k][0] + 0.1 * g, 0.99 * moments[k][1] + 0.01 * g * g)
            network.weights[k] = (network.weights[k] - now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def _round(dealt: DataFrame, network: Network, rate: float, steps: int, seed: int) -> None:
    """Each group of ``dealt`` learns from the network's weights on; the network gets their mean, by windows."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, finding = _read(batches)
        own = Network(seed)
        own.weights = dict(network.weights)
        _learn(own, codes, finding, np.random.default_rng([seed, key[0].as_py()]), rate, steps)
        flat = np.concatenate([own.weights[k].ravel() for k in sorted(own.weights)]).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.rint(flat * SCALE).astype(np.int64) * len(codes)), pa.array(np.full(len(flat), len(codes)))], ["place", "w", "n"])

    ship(dealt.sparkSession)
    parts = dealt.groupBy("group").applyInArrow(run, "place long, w long, n long").groupBy("place").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    got = parts.toArrow()
    if not got.num_rows:
        return
    flat = np.zeros(got.num_rows, np.float32)
    flat[got["place"].to_numpy()] = got["w"].to_numpy() / got["n"].to_numpy() / SCALE
    at = 0
    for k in sorted(network.weights):
        size = network.weights[k].size
        network.weights[k] = flat[at : at + size].reshape(network.weights[k].shape)
        at += size


def _tally(held: DataFrame, network: Network, variants: int, seed: int) -> pa.Table:
    """Columns found, class, logit (a whole number of 1 / FINE, rounded down), n: scores of all held windows, each in several spellings."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, finding = _read(batches)
        draw, parts = np.random.default_rng([seed, key[0].as_py()]), []
        for k in range(0, len(codes), 2048):
            truth = np.repeat(finding[k : k + 2048], variants)
            shown = varied(np.repeat(codes[k : k + 2048], variants, axis=0).astype(np.int64), truth, draw)
            logit = np.floor(np.clip(network.logits(shown), -FAR, FAR) * FINE).astype(np.int64)
            parts.append(np.stack([truth.astype(np.int64), np.array([window_class(w) for w in shown]), logit], axis=1))
        rows, n = np.unique(np.concatenate(parts), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0] > 0), *(pa.array(rows[:, k]) for k in (1, 2)), pa.array(n)], ["found", "class", "logit", "n"])

    ship(held.sparkSession)
    return held.groupBy("group").applyInArrow(run, "found boolean, class long, logit long, n long").groupBy("found", "class", "logit").agg(F.sum("n").alias("n")).orderBy("found", "class", "logit").toArrow()


def train(scanned: DataFrame, group: int = 40_000, recall: float = 0.98, steps: int = 400, least: int = 20, variants: int = 4, seed: int = 5) -> SecretModel | None:
    """Fit on all candidates (first piece of each); a fourth of them, by a hash, calibrates. None without both kinds in either part.

    A class with fewer than ``least`` findings to calibrate by takes the threshold of all.
    """
    each = scanned.select(F.explode(F.transform("candidates", lambda c: F.struct(c["found"].alias("found"), F.substring(c["windows"], 1, WINDOW).alias("window")))).alias("c")).select("c.*")
    windows_ = stash(each.distinct().withColumn("held", F.crc32("window") % 4 == 3))
    sizes = {(r["held"], r["found"]): r["n"] for r in windows_.groupBy("held", "found").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 4:
        drop(windows_)
        return None
    place = F.xxhash64("window")
    groups = -(-(sizes[False, True] + sizes[False, False]) // group)
    # Each group has findings: where they are few, one is in several groups.
    copies = min(groups, -(-FEW * groups // sizes[False, True]))
    turns = F.explode(F.sequence(F.lit(0), F.when(F.col("found"), copies - 1).otherwise(0))).alias("turn")
    learned = windows_.where("not held").select("found", "window", turns)
    dealt = learned.select("found", "window", F.pmod(place + F.col("turn"), F.lit(groups)).cast("int").alias("group"))
    network = Network(seed)
    _round(dealt.where("group = 0"), network, 4e-3, steps, seed)
    for k in (1, 2) if groups > 1 else ():
        _round(dealt.where((F.col("group") > 0) & (F.col("group") % 2 == k % 2)), network, 1e-3, 0, seed)
    # Held-out candidates in several spellings, so that the threshold is one for findings of other forms too.
    parts = -(-variants * (sizes[True, True] + sizes[True, False]) // group)
    got = _tally(windows_.where("held").select("found", "window", F.pmod(place, F.lit(parts)).cast("int").alias("group")), network, variants, seed)
    drop(windows_)
    truth, kind, logit, n = (got[c].to_numpy() for c in ("found", "class", "logit", "n"))
    truth, x = truth.astype(bool), logit / FINE
    model = SecretModel(network, *fit_curve(x, truth.astype(float), 1e-2, n), [])
    p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -40, 40)))
    whole = threshold(p[truth], recall, n[truth])
    model.thresholds = [threshold(p[own], recall, n[own]) if n[own := truth & (kind == c)].sum() >= least else whole for c in range(CLASSES)]
    return model


def findings(scanned: DataFrame, model: SecretModel | None, id_col: str = "doc_id") -> DataFrame:
    """Columns: id, spans: array of (start, end, kind, probability) in order; probability is 1 for base findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            asked = [(k, c) for k, cs in enumerate(seen) for c in cs if not c["found"]] if model else []
            spans = [[(s["start"], s["end"], s["kind"], 1.0) for s in b] for b in base]
            if asked:
                pieces = np.array([len(c["windows"]) // WINDOW for _, c in asked])
                p = model.probability(np.frombuffer(b"".join(c["windows"] for _, c in asked), np.uint8).reshape(-1, WINDOW))
                best = np.maximum.reduceat(p, np.cumsum(pieces) - pieces)
                limit = np.array(model.thresholds)[[c["class"] for _, c in asked]]
                for at in np.flatnonzero(best >= limit):
                    k, c = asked[at]
                    spans[k].append((c["start"], c["end"], len(KINDS), float(best[at])))
            names = (*KINDS, LEARNED)
            out = [[{"start": a, "end": b, "kind": names[k], "probability": p} for a, b, k, p in sorted(s, key=lambda x: (x[0], x[2]))] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, FOUND)], ["id", "spans"])

    return map_arrow(scanned.select(id_col, "base", "candidates"), run, f"{id_col} {scanned.schema[id_col].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string,probability:double>>")


FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())]))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base findings, the digest of their list, and the list of all: ``kind:start:end`` joined by commas."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != LEARNED)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: rules, and what the network adds."""
    scanned = stash(scan(table(spark, sf_dir, "documents")))
    return digests(findings(scanned, train(scanned)))


QUERIES = {"op11_secret_network": op11_secret_network}
