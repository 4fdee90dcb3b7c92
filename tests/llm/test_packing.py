import math
import random
from collections import defaultdict

import pytest

from symbolmill.llm.packing import Plan, fill_containers, fill_report

DOCS = "doc_id long, text string, n_tokens string, size_name string"
SIZES = "size_name string, capacity_tokens int, doc_id string"


def planned(capacity, counts):
    p = Plan(capacity, counts)
    p.reduce()
    p.best_fit()
    seen, room = defaultdict(int), defaultdict(list)
    for size, a, b, container, offset in p.rows:
        assert seen[size] == a
        seen[size] = b
        for c in range(container, container + b - a):
            room[c].append((offset, size))
    assert dict(seen) == {s: n for s, n in counts.items() if n}
    for items in room.values():
        end = 0
        for offset, size in sorted(items):
            assert offset == end
            end += size
        assert end <= capacity
    assert set(room) == set(range(p.containers))
    return p.containers


def best_fit(capacity, items):
    rooms = []
    for s in items:
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_plans_are_sound_and_tight():
    rnd = random.Random(3)
    for _ in range(300):
        capacity = rnd.choice([7, 10, 50, 100])
        counts = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 15))}
        n = planned(capacity, counts)
        least = math.ceil(sum(s * c for s, c in counts.items()) / capacity)
        assert least <= n <= best_fit(capacity, sorted((s for s, c in counts.items() for _ in range(c)), reverse=True)) + 1


def test_dominance():
    p = Plan(10, {9: 2, 7: 1, 3: 3, 6: 1, 5: 3})
    p.reduce()
    fixed = defaultdict(list)
    for size, a, b, c, _ in p.rows:
        for k in range(b - a):
            fixed[c + k].append(size)
    sets = sorted(map(sorted, fixed.values()))
    assert sets == [[3, 5], [3, 6], [3, 7], [5, 5], [9], [9]]


def optimum(capacity, items):
    """Least number of containers, by trying all (sets of items as bits)."""
    best = {0: (0, capacity)}
    for bits in range(1, 1 << len(items)):
        options = []
        for i, s in enumerate(items):
            if bits >> i & 1:
                n, used = best[bits ^ 1 << i]
                options.append((n, used + s) if used + s <= capacity else (n + 1, s))
        best[bits] = min(options)
    return best[(1 << len(items)) - 1][0]


def test_reduction_keeps_an_optimum():
    rnd = random.Random(11)
    triples = 0
    for _ in range(400):
        capacity = rnd.choice([10, 17, 30, 100])
        items = [rnd.randrange(max(1, capacity // 5), capacity * 2 // 3) for _ in range(rnd.randrange(1, 10))]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        p = Plan(capacity, dict(counts))
        p.reduce()
        rest = [s for s, n in p.left.items() for _ in range(n)]
        assert p.containers + optimum(capacity, rest) == optimum(capacity, items)
        room = defaultdict(int)
        for _, a, b, c, _ in p.rows:
            for k in range(b - a):
                room[c + k] += 1
        triples += sum(n == 3 for n in room.values())
    assert triples > 50


def test_too_many_capacities_are_an_error(spark):
    sizes = [(f"s{i}", i + 1, "x") for i in range(1001)]
    with pytest.raises(ValueError):
        filled(spark, [(1, "a", "x", "y")], sizes)
    assert filled(spark, [(1, "a", "x", "y")], [("a", None, "x"), (None, 5, "x"), ("b", 0, "x")]).count() == 1


def filled(spark, docs, sizes):
    return fill_containers(spark.createDataFrame(docs, DOCS), spark.createDataFrame(sizes, SIZES))


def test_every_text_has_its_place(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join("word" for _ in range(rnd.randrange(1, 60))), "x", "y") for i in range(300)]
    docs += [(900, None, "x", "y"), (901, "", "x", "y"), (902, "a b " * 700, "x", "y"), (903, "tok", "x", "y"), (903, "tok", "x", "y"), (None, "tok", "x", "y")]
    rows = filled(spark, docs, [("s", 64, "q"), ("s", 64, "q"), ("l", 500, "q"), ("bad", None, "q"), ("none", 0, "q")]).collect()
    for name, capacity in (("s", 64), ("l", 500)):
        mine = [r for r in rows if r.size_name == name]
        by_container, by_doc = defaultdict(list), defaultdict(list)
        for r in mine:
            by_doc[r.doc_id].append(r)
            if r.n_tokens:
                by_container[r.container_id].append(r)
        assert set(by_doc) == {d[0] for d in docs}
        for items in by_container.values():
            end = 0
            for r in sorted(items, key=lambda r: r.token_offset):
                assert r.token_offset == end
                end += r.n_tokens
            assert end <= capacity
        assert sum(r.n_tokens for r in by_doc[902]) == 1401 and len(by_doc[902]) == math.ceil(1401 / capacity)
        assert all(len(v) == 1 for k, v in by_doc.items() if k not in (902, 903))
        assert len(by_doc[903]) == 2
        total = sum(r.n_tokens for r in mine)
        items = sorted((r.n_tokens for r in mine if r.n_tokens), reverse=True)
        assert math.ceil(total / capacity) <= len(by_container) <= best_fit(capacity, items)
    assert {r.size_name for r in rows} == {"s", "l"}


def test_empty_tables(spark):
    assert filled(spark, [], [("s", 64, "q")]).count() == 0
    empty = filled(spark, [(1, "a", "x", "y")], [])
    assert empty.count() == 0 and fill_report(empty).count() == 0
