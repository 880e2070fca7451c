import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from crawlstrata.llm import linecrf as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def world(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    common = L.common_lines(docs)
    return docs, labels, common, L.train(docs, labels, common=common, learn=F.col("doc_id") % 2 == 0)


def best_states(model, found):
    """The best of all sequences of states, ties to content at the end; by plain dynamic programming where there are too many."""
    emit = [[sum(float(model.emission[s, f]) for f in line) for s in (0, 1)] for line in found]
    move, start = model.transition, model.start
    if len(found) <= 10:
        score = lambda p: start[p[0]] + sum(e[s] for e, s in zip(emit, p, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(p))
        return max(itertools.product((0, 1), repeat=len(found)), key=score)
    best = [(start[s] + emit[0][s], (s,)) for s in (0, 1)]
    for e in emit[1:]:
        best = [max(((v + move[a, b] + e[b], (*p, b)) for a, (v, p) in enumerate(best)), key=lambda x: x[0]) for b in (0, 1)]
    return max(best, key=lambda x: x[0])[1]


def test_verdict_against_all_sequences(spark, world):
    docs, _, common, model = world
    rows = {r["doc_id"]: r for r in L.judge(docs, model, common=common).collect()}
    space = re.compile(rb"[ \t\n\r\x0b\x0c]+")
    checked = 0
    for r in docs.collect():
        text = (r["text"] or "").encode()
        if len(text) > 4000:
            continue
        sizes, found, _ = L.lines_of(text, common)
        states = best_states(model, found) if found else ()
        n_words = len([w for w in space.split(text) if w])
        content = sum(n for n, s in zip(sizes, states, strict=True) if s == 0)
        got = rows[r["doc_id"]]
        share = content / n_words if n_words else 0.0
        assert abs(got["content_share"] - share) < 1e-9, r["doc_id"]
        assert got["kept"] == (not got["base_failed"] and share >= 0.5)
        checked += 1
    assert checked > 500


def test_held_out_labels(world):
    """Learned from even ids, measured on odd ones."""
    docs, labels, common, model = world
    kept = {r["doc_id"]: r["kept"] for r in L.judge(docs, model, common=common).where("not base_failed").collect()}
    held = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect() if r["doc_id"] % 2 and r["doc_id"] in kept}
    good, bad = ([kept[i] for i, q in held.items() if q == y] for y in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.25 * len(bad) and len(bad) >= 15


def test_lines_are_told_apart_without_the_list(world):
    """Many documents have both kinds of lines even if the field is not told which lines are common."""
    docs, _, common, model = world
    mixed = agree = seen = 0
    for r in docs.collect():
        text = (r["text"] or "").encode()
        blind = L.lines_of(text)[1]
        if not blind:
            continue
        states = model.viterbi(blind)
        mixed += len(set(states)) > 1
        told = L.lines_of(text, common)[1]
        seen += sum(L.COMMON in x for x in told)
        agree += sum(s for s, x in zip(states, told, strict=True) if L.COMMON in x)
    assert mixed >= 100 and agree >= 0.25 * seen


def test_prose_of_near_copies_is_no_boilerplate(spark):
    """Thirty copies of one text, each with another last line, share their prose; a licence line stands in texts that share nothing else."""
    r = random.Random(7)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(9)) + "."
    prose, licence = [line() for _ in range(8)], "All rights reserved. Do not copy."
    copies = ["\n".join([*prose, line()]) for _ in range(30)]
    others = ["\n".join([line(), line(), licence, line()]) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(copies + others + others[:1] + [None, ""])), "doc_id long, text string")
    assert L.common_lines(df) == {L.line_hash(licence.encode())}
    assert L.common_lines(df.limit(0)) == frozenset()
