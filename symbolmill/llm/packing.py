"""Filling containers of a fixed capacity with texts (problem 8).

Only sizes matter for the plan, and sizes are whole numbers up to the capacity, so the
instance is its histogram: at most ``capacity`` rows whatever the corpus. A task plans
each capacity on its histogram, in multiplicities: first the dominance reduction of
Martello and Toth fixes sets that dominate every other set with their largest item
(an item nothing fits beside; a pair that fills the container exactly; an item beside
which only one more fits, with the largest that does; an item beside which two more fit,
with the largest one, or with the two that fill it best, where these dominate), again
until nothing changes;
then the rest goes best-fit in decreasing order, whole groups of equal containers at a
time. The plan says which ranks of a size go to which containers, and every text gets
its place by its rank among texts of its size. Ranks are counted in salted buckets
whose number grows with the corpus, so a size that a third of all texts have is
nowhere numbered in one task.

Edge cases: a text above the capacity is cut into full pieces and one remainder, no
other text is cut; texts without tokens (null or empty) take no room and are listed in
container 0 with no tokens; repeated rows are placed each; a null or non-positive
capacity has no containers; repeated capacities count once, a capacity with several names
(null among them) is planned once and listed under each; more than ``MOST_CAPACITIES``
of them are an error; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symbolmill.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens
from symbolmill.session import checkpointed

#: Capacities are a parameter of the job, not data: every text is placed once for each of them.
MOST_CAPACITIES = 1_000
#: Texts of one size that are numbered in one task, about.
BUCKET_ROWS = 200_000
#: Ranks of one size that meet the plan together.
PLAN_BLOCK = 256

_PLAN = "capacity int, size long, rank_from long, rank_to long, container_from long, token_offset long"


class Plan:
    """Containers planned on a histogram ``size -> count``."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
        self.used: dict[int, int] = {}
        self.containers = 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def put(self, size: int, n: int, container: int, offset: int) -> None:
        """The next ``n`` texts of ``size`` go to containers from ``container`` on, one each, at ``offset``."""
        start = self.used.get(size, 0)
        self.used[size] = start + n
        self.rows.append((size, start, start + n, container, offset))

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: list[int], n: int) -> None:
        """``n`` closed containers that hold ``sizes`` each."""
        offset = 0
        for s in sizes:
            self.put(s, n, self.containers, offset)
            self.take(s, n)
            offset += s
        self.containers += n

    def reduce(self) -> None:
        """Fix dominating sets until there are none."""
        changed = True
        while changed and self.left:
            changed = False
            ordered = sorted(self.left)
            for s in reversed(ordered):
                while s in self.left and (others := self._partners(ordered, s)) is not None:
                    changed = True
                    each = {x: [s, *others].count(x) for x in (s, *others)}
                    self.fix([s, *others], min(self.left[x] // n for x, n in each.items()))

    def _partners(self, ordered: list[int], s: int) -> list[int] | None:
        """The sizes that, with s, dominate all sets with s; null if none are known to."""
        has = lambda x: self.left.get(x, 0) - (x == s)
        rest = self.capacity - s
        if rest == 0:
            return []
        if has(rest) > 0:
            return [rest]
        small: list[int] = []
        for x in ordered:
            small += [x] * min(3, max(0, has(x)))
            if len(small) >= 3:
                break
        if not small or small[0] > rest:
            return []
        best = next(x for i in range(bisect_left(ordered, rest + 1) - 1, -1, -1) if has(x := ordered[i]) > 0)
        if len(small) < 2 or small[0] + small[1] > rest:
            return [best]
        if len(small) > 2 and sum(small[:3]) <= rest:
            return None
        a, b = self._best_pair(ordered, has, rest)
        if best >= a + b:
            return [best]
        if best != a:
            return None
        # pairs of items between the two would have to be ruled out: the two smallest above b, a itself left out
        between: list[int] = []
        for x in ordered[bisect_left(ordered, b + 1) : bisect_left(ordered, a + 1)]:
            between += [x] * min(2, max(0, has(x) - (x == a)))
            if len(between) >= 2:
                break
        return [a, b] if len(between) < 2 or sum(between[:2]) > rest else None

    def _best_pair(self, ordered: list[int], has: Callable[[int], int], rest: int) -> tuple[int, int]:
        """The two items (greater first) that fill ``rest`` best; of equal sums the one with the greatest item."""
        low, high, found = 0, bisect_left(ordered, rest + 1) - 1, (0, 0)
        while low <= high:
            x, y = ordered[low], ordered[high]
            if has(y) < 1 or (low == high and has(y) < 2):
                high -= 1
            elif has(x) < 1:
                low += 1
            elif x + y > rest:
                high -= 1
            else:
                found = max(found, (y, x), key=lambda p: (p[0] + p[1], p[0]))
                low += 1
        return found

    def best_fit(self) -> None:
        """Best-fit decreasing of what is left, on groups of containers with equal room."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, container: int, n: int) -> None:
            if room and n:
                if room not in groups:
                    insort(rooms, room)
                    groups[room] = []
                groups[room].append((container, n))

        for s in sorted(self.left, reverse=True):
            n = self.left[s]
            while n:
                i = bisect_left(rooms, s)
                if i < len(rooms):
                    room = rooms[i]
                    container, m = groups[room].pop()
                    k = min(n, m)
                    if k < m:
                        groups[room].append((container + k, m - k))
                    elif not groups[room]:
                        del groups[room]
                        rooms.pop(i)
                    self.put(s, k, container, self.capacity - room)
                    add(room - s, container, k)
                    n -= k
                    continue
                each = min(n, self.capacity // s)
                m = n // each
                for j in range(each):
                    self.put(s, m, self.containers, j * s)
                add(self.capacity - each * s, self.containers, m)
                self.containers += m
                n -= each * m
        self.left = {}


def plan_containers(histogram: DataFrame) -> DataFrame:
    """Plan of (capacity, size, n): which ranks of a size go where."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = Plan(int(pdf.capacity.iloc[0]), dict(zip(pdf["size"].tolist(), pdf.n.tolist(), strict=True)))
        plan.reduce()
        plan.best_fit()
        out = pd.DataFrame(plan.rows, columns=["size", "rank_from", "rank_to", "container_from", "token_offset"])
        return out.assign(capacity=pdf.capacity.iloc[0])[["capacity", "size", "rank_from", "rank_to", "container_from", "token_offset"]]

    return histogram.groupBy("capacity").applyInPandas(run, _PLAN)


def fill_containers(
    documents: DataFrame, container_sizes: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(size_name, capacity, container_id, token_offset, doc_id, piece_no, first_token, n_tokens).

    A piece is tokens [first_token, first_token + n_tokens) of its text, placed at
    ``token_offset`` of its container.
    """
    sizes = checkpointed(count_tokens(documents, folder, vocabulary))
    capacities = container_sizes.select("size_name", F.col("capacity_tokens").alias("capacity")).filter("capacity > 0").distinct().limit(MOST_CAPACITIES + 1).collect()
    if len(capacities) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    names: dict[int, list[str | None]] = {}
    for c in sorted(capacities, key=str):
        names.setdefault(int(c.capacity), []).append(c.size_name)
    wanted = sizes.select("*", F.explode(F.lit(list(names)).cast("array<int>")).alias("capacity"))
    empty = wanted.filter("n_tokens = 0").select(
        "capacity", F.lit(0).cast("long").alias("container_id"), F.lit(0).cast("long").alias("token_offset"), "doc_id",
        F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"),
    )
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")
    pieces = (
        wanted.filter("n_tokens > 0")
        .select("capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
        .withColumn("first_token", F.col("piece_no").cast("long") * F.col("capacity"))
        .withColumn("size", F.least(F.col("capacity").cast("long"), F.col("n_tokens") - F.col("first_token")))
    )
    buckets = 16 + sizes.count() // BUCKET_ROWS
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    key = ["capacity", "size"]
    filled = pieces.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    filled = checkpointed(filled)
    starts = filled.withColumn("start", F.sum("n").over(W.partitionBy(*key).orderBy("bucket")) - F.col("n")).drop("n")
    plan = checkpointed(plan_containers(filled.groupBy(*key).agg(F.sum("n").alias("n"))))
    place = W.partitionBy(*key, "bucket").orderBy("doc_id", "piece_no")
    ranked = (
        pieces.withColumn("row", F.row_number().over(place) - 1)
        .join(starts, [*key, "bucket"])
        .withColumn("rank", F.col("start") + F.col("row"))
    )
    # ranks meet the plan in blocks, so a common size compares with the few plan rows of its block only
    block = lambda c: F.floor(c / PLAN_BLOCK)
    plan = plan.withColumn("block", F.explode(F.sequence(block(F.col("rank_from")), block(F.col("rank_to") - 1))))
    placed = (
        ranked.withColumn("block", block(F.col("rank")))
        .join(plan, [*key, "block"])
        .filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    )
    rows = placed.select(
        "capacity", (F.col("container_from") + F.col("rank") - F.col("rank_from")).alias("container_id"), "token_offset",
        "doc_id", "piece_no", "first_token", F.col("size").alias("n_tokens"),
    ).unionByName(empty)
    named = F.element_at(F.from_json(F.lit(json.dumps(names)), F.lit("map<string,array<string>>")), F.col("capacity").cast("string"))
    return rows.select(F.explode(named).alias("size_name"), *rows.columns)


def fill_report(filled: DataFrame) -> DataFrame:
    """Containers, tokens and share of unused space per capacity."""
    g = ["size_name", "capacity"]
    used = filled.filter("n_tokens > 0").groupBy(*g, "container_id").agg(F.sum("n_tokens").alias("n"))
    return used.groupBy(*g).agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")).withColumn(
        "unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    )
