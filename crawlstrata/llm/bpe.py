"""BPE encoding and decoding with a given tokenizer file; nothing is trained here.

Encoding a pre-token walks it from the left. An Aho-Corasick automaton lists all tokens that occur in it; the
longest that starts at a place is tried first, and a table says whether two neighbouring tokens may stand side by
side, that is, whether the merge rules would have left their border alone. Where no token fits, the walk goes back
one token. Each place is given up at most once, so the time is linear, and the result is exactly that of applying
the merges in order. Decoding gathers token strings from one buffer with an offset table.

Defined results: a null or empty text has no tokens and decodes to the empty text; equal texts give equal ids; bytes
that are not UTF-8 are read as U+FFFD. Repeated rows are encoded each, an empty table gives none, and extra columns are left out. Texts are encoded
whole; long ones take memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.llm.common import map_arrow, table, utf8

#: Stands for the end-of-word suffix; no token holds a line feed, as byte-level alphabets write it as another character.
END = "\n"
#: Distinct pre-tokens that a worker remembers before it forgets all and starts again.
REMEMBERED = 1 << 18


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file (BPE over bytes with an end-of-word suffix)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = next(regex.compile(x["pattern"]["Regex"]) for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        inner = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
        self.rank = {self.vocab[a + b]: k for k, (a, b) in enumerate(model["merges"])}
        #: pair of tokens -> token that they merge into, and token -> its pair.
        self.merged = {(self.vocab[a], self.vocab[b]): self.vocab[a + b] for a, b in model["merges"]}
        self.parts = {c: pair for pair, c in self.merged.items()}
        self.strings = {t: inner(s) for s, t in self.vocab.items()}
        self.finder = ahocorasick.Automaton()
        for t, s in self.strings.items():
            self.finder.add_word(s, (len(s), t))
        self.finder.make_automaton()
        #: token -> the longest token that is a proper prefix of it.
        self.shorter: dict[int, int] = {}
        ids = {s: t for t, s in self.strings.items()}
        for t, s in self.strings.items():
            self.shorter[t] = next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), -1)
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        texts = {**self.vocab, **self.special}
        table_bytes = [b""] * (max(texts.values()) + 1)
        for s, t in texts.items():
            table_bytes[t] = s.encode() + b" "
        self.buffer = np.frombuffer(b"".join(table_bytes), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in table_bytes])))

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined string leaves a border between them."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._compatible(left, right)
            if len(self.fits) > 1 << 20:
                self.fits.clear()
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the border, the latest first; a merge across it that would have come earlier than one undone breaks the pair."""
        rank = lambda t: self.rank.get(t, -1)
        limit = len(self.rank)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and rank(joined) < limit:
                return False
            a, b = rank(left), rank(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:  # of equal merges, the left one comes first
                limit, right = b + 1, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Tokens of a pre-token, given in the byte alphabet and closed by END."""
        n = len(word)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, (size, token) in self.finder.iter(word):
            if size > longest[end - size + 1][0]:
                longest[end - size + 1] = (size, token)
        free = bytearray(b"\1") * (n + 1)
        done: list[int] = []
        at, token = 0, longest[0][1]
        while at < n:
            while token >= 0:
                end = at + len(self.strings[token])
                if free[end] and (not done or self.compatible(done[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                done.append(token)
                at = end
                token = longest[at][1] if at < n else -1
            else:
                free[at] = 0
                token = done.pop()
                at -= len(self.strings[token])
        return done

    def _piece(self, piece: str) -> bytes:
        ids = self.encode_word("".join([self.alphabet[b] for b in piece.encode()]) + END)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        out = self.known[piece] = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_split is None:
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else self._plain(x) for k, x in enumerate(self.special_split.split(text)))

    def _plain(self, text: str) -> bytes:
        # Lower-casing goes character by character, so a final sigma is no exception. White space splits as the pattern says.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        known, fresh = self.known.get, self._piece
        return b"".join([known(p) or fresh(p) for p in self.split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        """Token strings joined by spaces, as UTF-8: what a tokenizer file without a decoder gives."""
        token = np.frombuffer(ids, "<u4")
        if not len(token):
            return b""
        starts = self.offsets[token]
        sizes = self.offsets[token + 1] - starts
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.buffer[index[:-1]].tobytes()


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The tokenizer of a file, kept by the worker from one task to the next."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Columns: id, n_tokens; ids (binary, little-endian unsigned 32-bit) if asked; sha256 of ids and of the decoded text if asked."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long"
    schema += ", ids binary" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, coded, sums, back = [], [], [], []
            for text in batch.column(1):
                code = bpe.encode(text.as_py().decode("utf-8", "replace"))
                n.append(len(code) // 4)
                if ids:
                    coded.append(code)
                if digests:
                    sums.append(hashlib.sha256(code).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(code)).hexdigest())
            out = [batch.column(0), pa.array(n, pa.int64())] + [pa.array(coded, pa.binary())] * ids + [pa.array(sums, pa.string()), pa.array(back, pa.string())] * digests
            yield pa.RecordBatch.from_arrays(out, [f"c{k}" for k in range(len(out))])

    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns: id, decoded."""
    schema = f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or b"").decode() for x in batch.column(1)], pa.string())], ["id", "decoded"])

    return map_arrow(encoded.select(id_col, ids_col), run, schema)


def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of both."""
    return encode(table(spark, sf_dir, "documents"), default_vocabulary(), ids=False, digests=True)


QUERIES = {"op9_backtracking_bpe": op9_backtracking_bpe}
