import hashlib
import random
import re

from crawlstrata.llm import decontaminate
from tests_llm_data import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    words, hit, names = split(text), set(), set()
    for name, t in items:
        seq = split(t)
        size = min(window, len(seq))
        for a in range(len(seq) - size + 1 if size else 0):
            w = seq[a : a + size]
            for k in range(len(words) - size + 1):
                if words[k] == w[0] and words[k : k + size] == w:
                    hit.update(range(k, k + size))
                    names.add(str(name))
    ids = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_query(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"]: brute(r["text"], items) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.op8_suffix_automaton(spark, SF).collect()}
    assert got == want
    assert any(w[4] for w in want.values())


ITEMS = [("1", "a b c d e"), ("2", "b c"), ("3", None), ("4", ""), ("5", "c d e f g h"), ("6", "b c"), ("7", "q"), ("8", "a a a a a a a")]
TEXTS = ["x A b, C d e f y", "b c b c", "a a a a a a a a", "q", None, "", "h g f e d c b a", "c d e f g h", "a b c d", "Q q q"]


def test_small_windows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = {k: brute(t, ITEMS, 4) for k, t in enumerate(TEXTS)}
    for block_bytes in (1 << 20, 12):
        found = decontaminate.verdict(decontaminate.contamination(docs, items, window=4, block_bytes=block_bytes)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in found} == {k: w[:3] for k, w in want.items()}
        assert {r["doc_id"]: hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in found} == {k: w[3] for k, w in want.items()}


def test_dropped_rows(spark):
    """One automaton and several drop the same rows, null ids, repeated rows and clashing names included."""
    rows = [(None if k == 2 else k, t, 1, "x") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id int, text string, row_ int, __row__ string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = sorted((r for r in rows + rows[:2] if not brute(r[1], ITEMS, 4)[4]), key=str)
    for block_bytes in (1 << 20, 12):
        kept = decontaminate.drop_contaminated(docs, items, window=4, block_bytes=block_bytes)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=str) == want


def test_odd(spark, odd):
    items = spark.createDataFrame([("1", "word word"), ("2", None)], "item_id string, text string")
    found = decontaminate.verdict(decontaminate.contamination(odd, items)).collect()
    assert len(found) == 10 and sum(r["contaminated"] for r in found) == 2
    assert decontaminate.contamination(odd.limit(0), items).count() == 0
    assert all(not r["items"] for r in decontaminate.contamination(odd, items.limit(0)).collect())
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns
    assert decontaminate.drop_contaminated(odd, items).count() == 8


def planted(seed=3):
    """Items, and documents with spans of 5 to 90 words of them between words of their own."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    items = [(f"i{k}", " ".join(word() for _ in range(100))) for k in range(6)] + [("short", "three short words")]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            parts.append(", ".join(word() for _ in range(draw.choice((5, 40, 900)))))
            n, at = draw.choice((0, 5, 13, 30, 60, 90)), draw.randrange(10)
            parts.append(" - ".join(draw.choice(items)[1].upper().split()[at : at + n]))
        docs.append((k, "\n".join(parts) + " \u00fc", 7, "r", 1))
    return items, [*docs, (100, None, 0, "r", 1), (101, "", 0, "r", 1), (102, "Three, short words!", 0, "r", 1), (103, "?!", 0, "r", 1)]


def test_spans_are_cut_beyond_the_limits(spark):
    """Against windows looked up one by one, with one automaton and with several; helper names and n_chars."""
    items, docs = planted()
    tokens = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    windows = set()
    for _, t in items:
        w = tokens.findall(low(t))
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want, cut = {}, 0
    for i, text, n_chars, *_ in docs:
        found = list(tokens.finditer(low(text or "")))
        w = [m[0] for m in found]
        hit = [False] * len(w)
        for n in (3, 13):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        runs, k = [], 0
        while k < len(w):
            end = k
            while end < len(w) and hit[end]:
                end += 1
            runs += [(k, end)] if end > k else []
            k = max(end, k + 1)
        gone = runs if sum(hit) and sum(hit) * 20 >= len(w) else [r for r in runs if r[1] - r[0] > 50]
        left = text
        for a, b in reversed(gone):
            left = left[: found[a].start()] + left[found[b - 1].end() :]
        cut += bool(gone) and len(gone) < len(runs)
        if not gone or tokens.findall(low(left)):
            want[i] = (left, len(left) if gone else n_chars)
    assert cut and 102 not in want and want[100] == (None, 0) and want[103] == ("?!", 0)
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars int, _row string, _spans int").repartition(3)
    table = spark.createDataFrame(items, "item_id string, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 900):
        out = decontaminate.strip_contaminated(df, table, block_bytes=block_bytes)
        assert out.schema.names == df.schema.names
        assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == want
    assert decontaminate.strip_contaminated(df, table.limit(0)).count() == len(docs) and decontaminate.strip_contaminated(df.limit(0), table).collect() == []
