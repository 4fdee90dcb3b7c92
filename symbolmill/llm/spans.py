"""Long exact spans shared between texts (problem 9).

Repeated-phrase automata in three steps.

*Confirm.* Of every text a winnowed set of phrases of ``PHRASE`` characters is taken
(of each run of ``SPAN`` characters the phrase with the least hash, so two texts with a
run in common take a phrase in common, whatever surrounds it). Phrases that more than
one text takes, compared by their characters, are the recurring ones.

*Compile and stream.* Texts without a recurring phrase can share nothing. The others
stream through Aho-Corasick automata, sharded so that one holds ``SHARD_PHRASES`` at
most about: the recurring phrases of a text fall into runs, a run is named by its least
hash, and the name decides the shard - so a text visits one shard per passage, not all
of them. A shard with many texts is copied, its texts are divided among the copies. In
a task the phrases come first and become the automaton, then texts pass one by one.

*Check.* An occurrence carries the characters around it that a run of ``SPAN`` could
reach. Occurrences of a phrase with equal surroundings form a class; whether two classes
share a run is decided once per pair of classes, in groups of up to ``CLASSES``; larger
groups emit one key per way a run can lie around the phrase instead (an exact equi-join
on its characters, linear in the number of classes). Classes with the same set of texts,
by count and a 128-bit sum, are expanded into pairs once; members are expanded in blocks.

Edge cases: null, empty and short texts share nothing and have a share of 0; null ids
are left out of pairs; repeated rows of one id are one text; texts that repeat a span
only within themselves share nothing; positions and lengths are in code points, line
ends are characters; very long texts are read whole; empty tables give an empty result;
other columns are ignored. A text that has the windows of a passage, but nowhere in one
piece (since it repeats some of them), has its own pieces under ids of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symbolmill.session import checkpointed

#: Least length of a shared span and length of the phrases that lead to it, in code points.
SPAN, PHRASE = 200, 80
#: Phrases of one automaton and texts that pass one copy of it, about; classes compared pair by pair.
SHARD_PHRASES, SHARD_TEXTS, CLASSES = 20_000, 5_000, 64
#: Members of a class that are expanded in one block.
BLOCK = 1_000
#: Characters that are hashed at a time, about.
_BLOCK_CHARS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)


def _sliding(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    size, out = 1, a
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def winnow(texts: list[str], span: int = SPAN, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the phrases taken from texts of at least ``span`` characters."""
    wide = span - phrase + 1
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    flat = np.concatenate(codes).astype(np.uint64)
    n = len(flat)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * _powers(_BASE, n), dtype=np.uint64)])
    h = (sums[phrase:] - sums[:-phrase]) * _powers(_INVERSE, n)[: n - phrase + 1]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    least = _sliding(h, wide, np.minimum)
    # a window counts if it lies inside one text; the others are 0 and so never a maximum of minima
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.zeros(n + 1, dtype=np.int64)
    inside[starts] += 1
    inside[starts + sizes - span + 1] -= 1
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint64(0))
    edge = np.zeros(wide - 1, np.uint64)
    taken = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), wide, np.maximum) == h)
    which = np.searchsorted(starts, taken, side="right") - 1
    return which, taken - starts[which], h[taken].astype(np.int64)


def phrases_taken(documents: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """(hash, doc_id, pos): each phrase a text takes, at its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
            which, pos, h = winnow(texts, span, phrase)
            df = pd.DataFrame({"h": h, "w": which, "p": pos}).drop_duplicates(["w", "h"])
            return pa.RecordBatch.from_arrays(
                [pa.array(df.h.to_numpy()), pa.array([ids[i] for i in df.w], pa.int64()), pa.array(df.p.to_numpy().astype(np.int32))], ["hash", "doc_id", "pos"]
            )

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if i is None or t is None or len(t) < span:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > _BLOCK_CHARS:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield emit(ids, texts)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hash long, doc_id long, pos int")


def _routed(texts: DataFrame, shards: int, span: int, phrase: int) -> DataFrame:
    """Rows (shard, doc_id, phrase, null) and (shard, doc_id, null, text) of texts with their recurring phrases."""
    schema = "shard long, doc_id long, phrase string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, str | None, str | None]] = []
            for doc, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "found")), strict=True):
                runs: list[list[dict]] = []
                for f in sorted(found, key=lambda f: f["pos"]):
                    if not runs or f["pos"] - runs[-1][-1]["pos"] > span - phrase + 1:
                        runs.append([])
                    runs[-1].append(f)
                visited = set()
                for r in runs:
                    shard = min(f["hash"] for f in r) % shards
                    visited.add(shard)
                    out += [(shard, doc, text[f["pos"] : f["pos"] + phrase], None) for f in r]
                out += [(shard, doc, None, text) for shard in sorted(visited)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], schema_names)

    schema_names = ["shard", "doc_id", "phrase", "text"]
    return texts.select("doc_id", "text", "found").mapInArrow(run, schema)


def _streamed(rows: DataFrame, reach: int, phrase: int) -> DataFrame:
    """Occurrences (phrase, doc_id, pos, before, after) of every phrase of a shard in every text of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, automaton = None, None
        for b in batches:
            out: list[tuple[str, int, int, str, str]] = []
            for shard, copy, doc, p, text in zip(*(b.column(c).to_pylist() for c in ("shard", "copy", "doc_id", "phrase", "text")), strict=True):
                if (shard, copy) != current:
                    current, automaton = (shard, copy), ahocorasick.Automaton()
                if p is not None:
                    automaton.add_word(p, p)
                elif len(automaton):
                    if automaton.kind != ahocorasick.AHOCORASICK:
                        automaton.make_automaton()
                    for end, p in automaton.iter(text):
                        at = end + 1 - phrase
                        out.append((p, doc, at, text[max(0, at - reach) : at], text[end + 1 : end + 1 + reach]))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["phrase", "doc_id", "pos", "before", "after"])

    return rows.mapInArrow(run, "phrase string, doc_id long, pos int, before string, after string")


def occurrences(documents: DataFrame, span: int = SPAN, phrase: int = PHRASE, beyond: int = 0) -> DataFrame:
    """All occurrences of the recurring phrases, with what stands around them and ``beyond`` characters more."""
    taken = phrases_taken(documents, span, phrase)
    recurring = checkpointed(taken.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("hash"))
    shards = 1 + recurring.count() // SHARD_PHRASES
    found = taken.join(recurring, "hash", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "hash")).alias("found"))  # bounded by a text's length
    texts = documents.select(F.col("doc_id").cast("long"), "text").filter(F.length("text") >= span).join(found, "doc_id").dropDuplicates(["doc_id"])
    routed = checkpointed(_routed(texts, shards, span, phrase))
    confirmed = (
        routed.filter("phrase is not null")
        .groupBy("phrase")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.collect_set("shard").alias("shards"))
        .filter("a < b")
        .select(F.explode("shards").alias("shard"), "phrase")
    )
    copies = routed.filter("text is not null").groupBy("shard").agg((1 + F.floor(F.count("*") / SHARD_TEXTS)).cast("int").alias("copies"))
    none = F.lit(None)
    machine = confirmed.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("tag"), none.cast("long").alias("doc_id"), "phrase", none.cast("string").alias("text"))
    stream = routed.filter("text is not null").join(copies, "shard").select("shard", F.pmod(F.hash("doc_id"), F.col("copies")).alias("copy"), F.lit(1).alias("tag"), "doc_id", none.cast("string").alias("phrase"), "text")
    rows = machine.unionByName(stream).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "tag")
    return _streamed(rows, span - phrase + beyond, phrase)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def class_links(classes: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """Pairs of classes (phrase, before, after) that share a run: (phrase, class_a, class_b, reach_before, reach_after).

    The reaches say how far the shared run extends around the phrase.
    """
    need = span - phrase
    out = "phrase string, class_a string, class_b string, reach_before int, reach_after int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[str, str, str, int, int]] = []
            for p, items in zip(b.column("phrase").to_pylist(), b.column("items").to_pylist(), strict=True):
                rows = [(x["class"], x["before"][::-1], x["after"]) for x in items]
                for i, (a, ab, af) in enumerate(rows):
                    for other, bb, bf in rows[i + 1 :]:
                        left, right = _common(ab, bb), _common(af, bf)
                        if left + right >= need:
                            found.append((p, a, other, left, right))
            if found:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [f.split()[0] for f in out.split(", ")])

    sizes = classes.groupBy("phrase").agg(F.count("*").alias("m")).filter(F.col("m").between(2, CLASSES))
    several = classes.join(sizes, "phrase").groupBy("phrase").agg(F.collect_list(F.struct("class", "before", "after")).alias("items"))
    return several.mapInArrow(run, out)


def class_keys(classes: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """For phrases with more than ``CLASSES`` classes: (key, phrase, class, reach_before, reach_after), a row per way a run can lie."""
    need = span - phrase
    sizes = classes.groupBy("phrase").agg(F.count("*").alias("m")).filter(F.col("m") > CLASSES)
    ways = classes.join(sizes, "phrase").select("phrase", "class", "before", "after", F.explode(F.sequence(F.lit(0), F.lit(need))).alias("left"))
    ways = ways.filter((F.length("before") >= F.col("left")) & (F.length("after") >= need - F.col("left")))
    run = F.concat(F.expr("right(before, left)"), F.col("phrase"), F.expr(f"left(after, {need} - left)"))
    return ways.select(F.sha2(run, 256).alias("key"), "phrase", "class", F.col("left").alias("reach_before"), (need - F.col("left")).alias("reach_after"))


def _with_classes(found: DataFrame) -> DataFrame:
    name = F.sha2(F.concat_ws("\x00", F.length("before").cast("string"), "before", "phrase", "after"), 256)
    return found.withColumn("class", name)


class SharedSpans:
    """Spans of at least ``span`` characters that texts of ``documents`` have in common.

    With ``beyond=1`` the surroundings hold the character before and after any run, which ``passages`` needs.
    """

    def __init__(self, documents: DataFrame, span: int = SPAN, phrase: int = PHRASE, beyond: int = 0):
        self.documents, self.span, self.phrase, self.beyond = documents, span, phrase, beyond
        self.found = checkpointed(_with_classes(occurrences(documents, span, phrase, beyond)))
        g = ["phrase", "class"]
        classes = self.found.groupBy(*g).agg(F.first("before").alias("before"), F.first("after").alias("after"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        self.classes = classes = checkpointed(classes)
        whole = classes.filter((F.col("a") < F.col("b")) & (F.length("before") + F.length("after") >= span - phrase)).select(
            "phrase", F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.length("before").alias("reach_before"), F.length("after").alias("reach_after")
        )
        self.links = checkpointed(whole.unionByName(class_links(classes, span, phrase)))
        self.keys = checkpointed(class_keys(classes, span, phrase))

    def groups(self) -> DataFrame:
        """(class, doc_id): the texts of each class, and of each key of a large group."""
        members = self.found.select("class", "doc_id").distinct()
        keyed = self.keys.select("key", "class").join(members, "class").select(F.col("key").alias("class"), "doc_id").distinct()
        return members.unionByName(keyed)

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: texts that share a span."""
        members = checkpointed(self.groups())
        mark = [F.bit_xor(F.xxhash64("doc_id", F.lit(s))).alias(f"x{s}") for s in (1, 2)]
        sets = members.groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *mark)
        links = self.links.select("class_a", "class_b").unionByName(self.keys.select(F.col("key").alias("class_a"), F.col("key").alias("class_b")).distinct())
        a = sets.select(F.col("class").alias("class_a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "lo", "hi", "x1", "x2")])
        b = sets.select(F.col("class").alias("class_b"), *[F.col(c).alias(f"b_{c}") for c in ("n", "lo", "hi", "x1", "x2")])
        sides = [f"{s}_{c}" for s in "ab" for c in ("n", "lo", "hi", "x1", "x2")]
        kept = links.join(a, "class_a").join(b, "class_b").groupBy(*sides).agg(F.min(F.struct("class_a", "class_b")).alias("c"))
        kept = kept.filter(~((F.col("a_lo") == F.col("a_hi")) & (F.col("b_lo") == F.col("b_hi")) & (F.col("a_lo") == F.col("b_lo"))))
        blocks = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / BLOCK).cast("int"))
        plan = kept.select("c.class_a", "c.class_b", F.explode(blocks("a_n")).alias("block_a"), "b_n").select("class_a", "class_b", "block_a", F.explode(blocks("b_n")).alias("block_b"))
        count = F.floor((F.col("n") - 1) / BLOCK).cast("int") + 1
        placed = members.join(sets.select("class", "n"), "class").select("class", "doc_id", F.pmod(F.hash("doc_id"), count).alias("block"))
        left = placed.select(F.col("class").alias("class_a"), F.col("block").alias("block_a"), F.col("doc_id").alias("x"))
        right = placed.select(F.col("class").alias("class_b"), F.col("block").alias("block_b"), F.col("doc_id").alias("y"))
        both = plan.join(left, ["class_a", "block_a"]).join(right, ["class_b", "block_b"]).filter("x <> y")
        return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def spans(self) -> DataFrame:
        """(doc_id, span_start, span_end): maximal parts of each text that are shared elsewhere, end exclusive."""
        parts = self._parts()
        before = F.max("e").over(W.partitionBy("doc_id").orderBy("s").rowsBetween(W.unboundedPreceding, -1))
        runs = parts.withColumn("before", before)
        runs = runs.withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("s") > F.col("before")), 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("s")))
        return runs.groupBy("doc_id", "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("island")

    def _parts(self) -> DataFrame:
        """(doc_id, s, e): runs of each text that another one has, the longest of each beginning."""
        reaches = self._linked_elsewhere()
        parts = self.found.select("class", "phrase", "doc_id", "pos").join(reaches, ["phrase", "class", "doc_id"]).select(
            "doc_id", (F.col("pos") - F.col("reach_before")).alias("s"), (F.col("pos") + self.phrase + F.col("reach_after")).alias("e")
        )
        return parts.groupBy("doc_id", "s").agg(F.max("e").alias("e"))

    def _linked_elsewhere(self) -> DataFrame:
        """(phrase, class, doc_id, reach_before, reach_after): as far as *another* text shares the run."""
        members = self.found.select("phrase", "class", "doc_id").distinct()
        ends = members.groupBy("class").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        both = self.links.select("phrase", F.col("class_a").alias("class"), F.col("class_b").alias("other"), "reach_before", "reach_after").unionByName(
            self.links.select("phrase", F.col("class_b").alias("class"), F.col("class_a").alias("other"), "reach_before", "reach_after")
        )
        linked = both.join(ends.withColumnRenamed("class", "other"), "other").select("phrase", "class", "lo", "hi", "reach_before", "reach_after")
        owners = self.keys.select("key", "class").join(ends, "class").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        keyed = self.keys.join(owners, "key").select("phrase", "class", "lo", "hi", "reach_before", "reach_after")
        reach = linked.unionByName(keyed).groupBy("phrase", "class", "reach_before", "reach_after").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return members.join(reach, ["phrase", "class"]).filter((F.col("lo") != F.col("doc_id")) | (F.col("hi") != F.col("doc_id"))).drop("lo", "hi")

    def shares(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, shared_share) of every text."""
        n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
        sizes = self.documents.select(F.col("doc_id").cast("long"), n.alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
        shared = self.spans().groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).cast("long").alias("shared_chars"))
        out = sizes.join(shared, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
        share = F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0)
        return out.withColumn("shared_share", share)

    def _cuts(self) -> DataFrame:
        """(doc_id, at): windows of ``span`` characters that other texts share than the window before them.

        Windows with unequal neighbours somewhere are those at the end of what two classes share. A window ends
        a passage where fewer texts have it with its neighbour than have it at all.
        """
        need = self.span - self.phrase
        sides = []
        for own in ("class_a", "class_b"):
            link = self.links.select("phrase", F.col(own).alias("class"), "reach_before", "reach_after")
            sides.append(link.filter(F.col("reach_before") <= need).select("phrase", "class", (-F.col("reach_before")).alias("off"), F.lit(0).alias("side")))
            sides.append(link.filter(F.col("reach_after") <= need).select("phrase", "class", (F.col("reach_after") - need).alias("off"), F.lit(1).alias("side")))
        for side in (0, 1):
            sides.append(self.keys.select("phrase", "class", (-F.col("reach_before")).alias("off"), F.lit(side).alias("side")))
        windows = sides[0]
        for s in sides[1:]:
            windows = windows.unionByName(s)
        text, first = F.concat("before", "phrase", "after"), F.length("before") + F.col("off") + 1
        around = windows.distinct().join(self.classes.select("phrase", "class", "before", "after"), ["phrase", "class"]).withColumns({"t": text, "first": first})
        window = F.sha2(F.expr(f"substring(t, first, {self.span})"), 256)
        beside = F.expr(f"case when side = 1 then substring(t, first + {self.span}, 1) when first > 1 then substring(t, first - 1, 1) else '' end")
        around = around.select("class", "off", "side", window.alias("window"), beside.alias("beside"))
        several = around.groupBy("window", "side").agg(F.min("beside").alias("lo"), F.max("beside").alias("hi")).filter("lo <> hi").select("window", "side")
        around = checkpointed(around.join(several, ["window", "side"]))
        texts = around.select("class", "window", "side", "beside").join(self.found.select("class", "doc_id").distinct(), "class").select("window", "side", "beside", "doc_id").distinct()
        n = texts.groupBy("window", "side", "beside").agg(F.count("*").alias("n_beside"))
        fewer = n.join(texts.groupBy("window", "side").agg(F.countDistinct("doc_id").alias("n")), ["window", "side"]).filter("n_beside < n").select("window", "side", "beside")
        cuts = around.join(fewer, ["window", "side", "beside"]).select("class", (F.col("off") + F.col("side")).alias("off")).distinct()
        return self.found.select("class", "doc_id", "pos").join(cuts, "class").select("doc_id", (F.col("pos") + F.col("off")).alias("at")).distinct()

    def passages(self) -> DataFrame:
        """(passage_id, doc_id, span_start, span_end): parts shared by the same texts from end to end, equal ones under one id.

        A passage is a longest row of windows of ``span`` characters that the same texts have, each also with its
        neighbour; where the set of texts changes the next passage begins, so passages overlap by less than ``span``.
        """
        if not self.beyond:
            return SharedSpans(self.documents, self.span, self.phrase, 1).passages()
        span = self.span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple[int, int, int]] = []
                for doc, parts, cuts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "parts", "cuts")), strict=True):
                    rows: list[list[int]] = []  # windows by their first character, end exclusive
                    for p in sorted(parts, key=lambda p: p["s"]):
                        if rows and p["s"] <= rows[-1][1]:
                            rows[-1][1] = max(rows[-1][1], p["e"] - span + 1)
                        else:
                            rows.append([p["s"], p["e"] - span + 1])
                    at = sorted(cuts or ())
                    for s, e in rows:
                        ends = [s, *at[bisect_right(at, s) : bisect_left(at, e)], e]
                        out += [(doc, a, z - 1 + span) for a, z in pairwise(ends)]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "span_start", "span_end"])

        parts = self._parts().groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("parts"))  # bounded by a text's length
        cuts = self._cuts().groupBy("doc_id").agg(F.collect_list("at").alias("cuts"))
        found = parts.join(cuts, "doc_id", "left").select("doc_id", "parts", "cuts").mapInArrow(run, "doc_id long, span_start int, span_end int")
        cut = found.join(self.documents.select(F.col("doc_id").cast("long"), "text").dropDuplicates(["doc_id"]), "doc_id")
        part = F.expr("substring(text, span_start + 1, span_end - span_start)")
        return cut.select(F.sha2(part, 256).alias("passage_id"), "doc_id", "span_start", "span_end")
