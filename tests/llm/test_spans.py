import hashlib
import random

import pytest

from symbolmill.llm import spans
from symbolmill.llm.spans import SharedSpans, winnow

SCHEMA = "doc_id long, text string, pos string, phrase string"


def truth(docs, span):
    """Pairs with a run in common, and shared characters per text, by all substrings."""
    grams = {}
    for d, t in docs.items():
        for i in range(len(t) - span + 1):
            grams.setdefault(t[i : i + span], {}).setdefault(d, []).append(i)
    pairs, cover = set(), {d: set() for d in docs}
    for where in grams.values():
        if len(where) > 1:
            ids = sorted(where)
            pairs |= {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}
            for d, starts in where.items():
                for s in starts:
                    cover[d].update(range(s, s + span))
    return pairs, {d: len(c) for d, c in cover.items()}


def check(spark, docs, span, phrase):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs.items()], SCHEMA).repartition(3)
    shared = SharedSpans(df, span, phrase)
    pairs, cover = truth({d: t for d, t in docs.items() if t}, span)
    assert {tuple(r) for r in shared.pairs().collect()} == pairs
    got = {r.doc_id: r.shared_chars for r in shared.shares().collect()}
    assert got == {d: cover.get(d, 0) for d in docs}
    return shared


def made(seed, n=40, alphabet="abc ü数👍"):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    passages = [word(rnd.randrange(20, 70)) for _ in range(6)]
    docs = {}
    for i in range(n):
        parts = [word(rnd.randrange(0, 40)) for _ in range(rnd.randrange(1, 4))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 8)
            parts.insert(rnd.randrange(len(parts) + 1), p[a : len(p) - rnd.randrange(0, 8)])
        docs[i] = "".join(parts)
    docs |= {n: "-" * 90, n + 1: "-" * 75 + "x", n + 2: docs[0], n + 3: docs[0], n + 4: None, n + 5: "", n + 6: "ab" * 40, n + 7: "ab" * 30}
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_substrings(spark, seed):
    check(spark, made(seed), 30, 12)


def test_large_groups_take_keys(spark, monkeypatch):
    monkeypatch.setattr(spans, "CLASSES", 3)
    monkeypatch.setattr(spans, "BLOCK", 2)
    monkeypatch.setattr(spans, "SHARD_TEXTS", 5)
    check(spark, made(3), 30, 12)


def test_boilerplate_shorter_than_the_span(spark):
    rnd = random.Random(9)
    docs = {i: "".join(rnd.choice("abcdef") for _ in range(60)) + "B" * 5 + "same boilerplate in all" + "".join(rnd.choice("abcdef") for _ in range(40)) for i in range(100)}
    shared = check(spark, docs, 40, 15)
    assert shared.pairs().count() == 0


def test_passages_repeats_and_empty(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(260))
    df = spark.createDataFrame([(1, text, "", ""), (1, text, "", ""), (2, "x" + text + "y", "", ""), (None, text, "", ""), (3, text[:199], "", "")], SCHEMA)
    shared = SharedSpans(df)
    assert [tuple(r) for r in shared.pairs().collect()] == [(1, 2)]
    rows = {(r.doc_id, r.span_start, r.span_end) for r in shared.passages().collect()}
    assert rows == {(1, 0, 260), (2, 1, 261)} and shared.passages().select("passage_id").distinct().count() == 1
    assert SharedSpans(df.limit(0)).pairs().count() == 0


def passages_by_windows(docs, span):
    """(text, doc, start, end) of the longest rows of windows with the same texts, by all substrings."""
    have = lambda s: {d for d, t in docs.items() if s in t}
    out = set()
    for d, t in docs.items():
        sets = [have(t[i : i + span]) for i in range(len(t) - span + 1)]
        start = 0
        for i in range(len(sets)):
            if i + 1 == len(sets) or not sets[i] == sets[i + 1] == have(t[i : i + span + 1]):
                if len(sets[i]) > 1:
                    out.add((hashlib.sha256(t[start : i + span].encode()).hexdigest(), d, start, i + span))
                start = i + 1
    return out


@pytest.mark.parametrize(("seed", "classes"), [(1, 64), (2, 64), (3, 3)])
def test_passages_against_all_substrings(spark, monkeypatch, seed, classes):
    monkeypatch.setattr(spans, "CLASSES", classes)
    docs = made(seed)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs.items()], SCHEMA).repartition(3)
    got = SharedSpans(df, 30, 12, 1).passages().collect()
    assert {tuple(r) for r in got} == passages_by_windows({d: t for d, t in docs.items() if t}, 30)
    assert len(got) == len(set(got))


def test_passages_of_partial_overlap(spark):
    rnd = random.Random(6)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnop") for _ in range(k))
    whole, y, z = word(900), word(250), word(250)
    docs = {1: whole, 2: "<" + whole + ">", 3: "#" * 40 + whole[200:500] + "#" * 40, 4: y + z, 5: y + "!", 6: "?" + z}
    df = spark.createDataFrame([(d, t, "", "") for d, t in docs.items()], SCHEMA)
    sharers = {}
    for r in SharedSpans(df).passages().collect():
        sharers.setdefault(docs[r.doc_id][r.span_start : r.span_end], set()).add((r.passage_id, r.doc_id))
    texts = {t: sorted(d for _, d in s) for t, s in sharers.items()}
    assert texts == {whole[:399]: [1, 2], whole[200:500]: [1, 2, 3], whole[301:]: [1, 2], y: [4, 5], z: [4, 6]}
    assert all(len({i for i, _ in s}) == 1 for s in sharers.values())


def test_winnow_guarantee():
    rnd = random.Random(4)
    base = "".join(rnd.choice("ab") for _ in range(50))
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(2))
        texts = [a + base + b, b + base + a]
        which, pos, h = winnow(texts, 50, 20)
        taken = [{(p - o, v) for w, p, v in zip(which, pos, h, strict=True) if w == k and 0 <= p - o <= 30} for k, o in ((0, len(a)), (1, len(b)))]
        assert taken[0] & taken[1]
