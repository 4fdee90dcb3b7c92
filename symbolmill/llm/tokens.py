"""Encoding of the corpus with a public byte-level BPE tokenizer (problem 7).

Corpus-level merge replay. Documents fall into slices; of every slice the distinct words
go to the partition of their word, so a word of the corpus is met in one place only. There
the words of a partition are laid end to end as symbols, with an inverted index from token
pair to the word positions where it stands. Merges are applied in rank order over all of
these words at once; a merge visits only the positions in its posting list and adds the
pairs with the touched neighbours to the index. The encoded words return to their slices,
whose documents become rows of ids.

No document is split into words as a whole. No word reaches from other text into a blank,
so texts are cut before runs of blanks, on their bytes; of the pieces between the cuts each
distinct one of a slice is split into words once, and its ids are copied to all its places.

Shapes at scale: texts are shuffled once (both readers of the slices share that exchange),
words once for each slice that holds them. A word of every text is one row per slice, and
rows of words stream through their task: an index takes in ``INDEX_ROWS`` of them and is
then replaced, so no hot word and no large partition fills a worker.

Edge cases: null, empty texts: an empty list of ids. Blank texts, unusual characters
and the strings of special tokens are ordinary text. A very long word (a blob without
blanks) is one entry of the index and costs in proportion to its length. Repeated rows
are encoded each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie unless a caller names another folder.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same splits for texts without rarer characters, where two plain classes tell letters and blanks:
#: everything up to U+024F but for the odd blanks and the signs that are neither, and a few marks of print.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_BLANKS = " \t\n\r\f\v"
_PLAIN = re.compile(
    f" ?[{_LETTERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_BLANKS}{_LETTERS}0-9]+|[{_BLANKS}]+"
)
_RARE = re.compile("[^\x00-\x1b\x20-\x7f\u00a1-\u00a9\u00aa-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2013\u2014\u2018-\u201e\u2022\u2026]")
_IS_RARE = np.array([bool(_RARE.match(chr(c))) for c in range(0x2030)])  # the last stands for all beyond it
#: Documents of one slice, about; rows of words, and their bytes, that one inverted index takes in.
SLICE_DOCUMENTS, INDEX_ROWS, INDEX_BYTES = 1_000, 400_000, 1 << 25
#: Bytes that are blanks wherever they stand; bytes that some blank of more than one byte has before its last.
_BLANK, _ODD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK[list(_BLANKS.encode())] = True
_ODD[[0xC2, 0x80, 0x81, 0x9A]] = True


def words_of(text: str) -> list[str]:
    """The pieces inside which merges happen."""
    if not _RARE.search(text):
        return _PLAIN.findall(text)
    return _PATTERN.findall(text)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of the texts in them)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where texts can be cut without cutting a word: before blanks that follow what is surely none (a mark of a possible blank has it go on)."""
    blank = _BLANK[raw]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    last = raw[at - 1]
    may = np.zeros(len(raw) + 1, dtype=bool)
    may[at[np.where(last < 0x80, (last < 0x1C) | (last > 0x1F), ~_ODD[raw[at - 2]])]] = True
    return may


def pieces_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(pieces of all texts, bounds): those of text i are ``bounds[i]`` to ``bounds[i + 1]``; its words are those of its pieces."""
    raw, offsets = bytes_of(texts)
    begins = cuts(raw)
    begins[offsets] = True
    starts = np.flatnonzero(begins[:-1])
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw))
    return pieces.dictionary_encode(), np.searchsorted(starts, offsets)


def words_of_pieces(pieces: pa.Array) -> tuple[list[str], np.ndarray]:
    """(words of all pieces, bounds): those of piece i are ``bounds[i]`` to ``bounds[i + 1]``.

    Pieces are split together as they lie end to end, but for one that could not follow the other in a text and
    between plain and rare ones, as the split of rare characters is slow.
    """
    raw, offsets = bytes_of(pieces)
    text, apart = raw.tobytes().decode("utf-8"), ~cuts(raw)[offsets]
    if len(text) < len(raw):
        offsets = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])[offsets]
    marks = np.flatnonzero(_IS_RARE[np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), len(_IS_RARE) - 1)])
    rare = np.diff(np.searchsorted(marks, offsets)) > 0
    apart[1:-1] |= rare[1:] != rare[:-1]
    ends = offsets[apart].tolist()
    words = list(chain.from_iterable(words_of(text[a:b]) for a, b in zip(ends, ends[1:], strict=False)))
    over = np.zeros(len(text) + 1, dtype=bool)
    over[np.cumsum(lengths(words))] = True
    return words, np.cumsum(over, dtype=np.int32)[offsets]


def lengths(items: list[str] | list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, items), dtype=np.int64, count=len(items))


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_merges(path: str) -> tuple[list[int], dict[int, int], int]:
    """(id of each byte, merged id by ``left * size + right``, size). Merged ids grow with the rank."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, size = model["vocab"], 1 << 17
    pairs: dict[int, int] = {}
    for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        pairs.setdefault(vocab[left] * size + vocab[right], vocab[left + right])
    return [vocab[c] for _, c in sorted(byte_characters().items())], pairs, size


class MergeReplay:
    """Encodes sets of distinct words by replaying the merges over all of them at once."""

    def __init__(self, byte_ids: list[int], pairs: dict[int, int], size: int):
        self.byte_ids, self.pairs, self.size = byte_ids, pairs, size

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of every word."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        ids, bounds = self.encode_bytes(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(lengths(data)))
        packed, bounds = ids.tolist(), bounds.tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_bytes(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of words that lie end to end; those of word i are ``bounds[i]`` to ``bounds[i + 1]``."""
        flat = np.array(self.byte_ids, dtype=np.int64)[raw]
        n = len(flat)
        if not n:
            return np.zeros(0, dtype=np.int32), np.zeros(len(ends) + 1, dtype=np.int64)
        last = np.zeros(n, dtype=bool)
        last[ends[ends > 0] - 1] = True
        # the inverted index: pair -> positions of its left symbol, for pairs that merge at all
        keys = flat[:-1] * self.size + flat[1:]
        open_ = np.flatnonzero(~last[:-1])
        postings: dict[int, list[int]] = {}
        if len(open_):
            order = open_[np.argsort(keys[open_], kind="stable")]
            distinct, starts = np.unique(keys[order], return_index=True)
            for key, part in zip(distinct.tolist(), np.split(order, starts[1:]), strict=True):
                if key in self.pairs:
                    postings[key] = part.tolist()
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)  # next and previous symbol of the word, -1 at its end and start
        right[last] = -1
        left[1:][last[:-1]] = -1
        token = flat.tolist()
        self._replay(token, left.tolist(), right.tolist(), postings)
        ids = np.array(token, dtype=np.int32)
        kept = ids >= 0
        return ids[kept], np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]

    def _replay(self, token: list[int], left: list[int], right: list[int], postings: dict[int, list[int]]) -> None:
        pairs, size = self.pairs, self.size
        heap = [(pairs[key], key) for key in postings]
        heapq.heapify(heap)
        while heap:
            merged, key = heapq.heappop(heap)
            a, b = divmod(key, size)
            places = postings.pop(key)
            places.sort()
            for p in places:
                if token[p] != a:
                    continue
                q = right[p]
                if q < 0 or token[q] != b:
                    continue
                token[p], token[q] = merged, -1
                r = right[p] = right[q]
                if r >= 0:
                    left[r] = p
                    new = merged * size + token[r]
                    rank = pairs.get(new)
                    if rank is not None:
                        found = postings.get(new)
                        if found is None:
                            postings[new] = [p]
                            heapq.heappush(heap, (rank, new))
                        else:
                            found.append(p)
                o = left[p]
                if o >= 0:
                    new = token[o] * size + merged
                    rank = pairs.get(new)
                    if rank is not None:
                        found = postings.get(new)
                        if found is None:
                            postings[new] = [o]
                            heapq.heappush(heap, (rank, new))
                        else:
                            found.append(o)


_REPLAYS: dict[str, MergeReplay] = {}


def merge_replay(path: str) -> MergeReplay:
    """One replay per worker process and vocabulary."""
    if path not in _REPLAYS:
        _REPLAYS[path] = MergeReplay(*load_merges(path))
    return _REPLAYS[path]


def sliced(documents: DataFrame) -> DataFrame:
    """(doc_id, text, slice): documents dealt out to slices by a hash of the row, never by a value that many share."""
    n = 1 + documents.count() // SLICE_DOCUMENTS  # a count over Parquet footers
    return documents.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("slice")).repartition("slice")


def slice_words(slices: DataFrame) -> DataFrame:
    """(slice, word): the distinct words of every slice (a word may come twice where a slice has very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for s, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), s)), pa.array(list(words), pa.string())], ["slice", "word"])
            seen.clear()

        for b in batches:
            slices, texts = b.column("slice").to_numpy(), b.column("text")
            order = np.argsort(slices, kind="stable")
            distinct, starts = np.unique(slices[order], return_index=True)
            for s, rows in zip(distinct.tolist(), np.split(order, starts[1:]), strict=True):
                pieces, _ = pieces_of(texts.take(pa.array(rows)))
                seen.setdefault(s, set()).update(words_of_pieces(pieces.dictionary)[0])
            if sum(map(len, seen.values())) > INDEX_ROWS:
                yield from emit()
        yield from emit()

    return slices.mapInArrow(run, "slice long, word string")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(slice, word, ids) of (slice, word): an inverted index over the words of each partition of words; ids as 32-bit numbers end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, parts, rows, size = merge_replay(path), [], 0, 0

        def emit() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            coded = table.column("word").combine_chunks().dictionary_encode()
            raw, offsets = bytes_of(coded.dictionary)
            ids, bounds = replay.encode_bytes(raw, offsets[1:])
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids)])
            out = pa.Table.from_arrays([table.column("slice"), table.column("word"), packed.take(coded.indices).cast(pa.binary())], ["slice", "word", "ids"])
            yield from out.combine_chunks().to_batches()

        for b in batches:
            parts.append(b)
            rows, size = rows + len(b), size + b.nbytes
            if rows >= INDEX_ROWS or size >= INDEX_BYTES:
                yield from emit()
                parts, rows, size = [], 0, 0
        if parts:
            yield from emit()

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "slice long, word string, ids binary")


def _documents_of(documents: DataFrame, folder: str, vocabulary: str, field: str, make: Callable[[pa.Array, pa.Array, np.ndarray], pa.Array]) -> DataFrame:
    """(doc_id, field): ``make`` turns (ids of distinct pieces, which of these follow each other, token bounds of the documents) into the field."""
    name, kind = field.split(" ")[0], documents.schema["doc_id"].dataType.simpleString()
    slices = sliced(documents)
    words = encoded_words(slice_words(slices), f"{folder}/{vocabulary}")

    def run(texts: pa.Table, coded: pa.Table) -> pa.Table:
        get = dict(zip(coded.column("word").to_pylist(), coded.column("ids").to_pylist(), strict=True)).__getitem__

        def made(chunk: pa.Array) -> pa.Array:
            pieces, bounds = pieces_of(chunk)
            words, firsts = words_of_pieces(pieces.dictionary)
            ids = list(map(get, words))
            places = np.concatenate([[0], np.cumsum(lengths(ids))])[firsts]
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(firsts) - 1, [None, pa.py_buffer(places), pa.py_buffer(b"".join(ids))])
            sizes = np.diff(places)[pieces.indices.to_numpy()] // 4
            return make(packed, pieces.indices, np.concatenate([[0], np.cumsum(sizes)])[bounds])

        return pa.Table.from_arrays([texts.column("doc_id"), pa.chunked_array(map(made, texts.column("text").chunks))], ["doc_id", name])

    return slices.groupBy("slice").cogroup(words.groupBy("slice")).applyInArrow(run, f"doc_id {kind}, {field}")


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""

    def lists(ids: pa.Array, order: pa.Array, bounds: np.ndarray) -> pa.Array:
        flat = pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, ids.take(order).buffers()[2] or pa.py_buffer(b"")])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)

    return _documents_of(documents, folder, vocabulary, "ids array<int>", lists)


def count_tokens(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document; 0 for null and empty texts."""
    return _documents_of(documents, folder, vocabulary, "n_tokens long", lambda ids, order, bounds: pa.array(np.diff(bounds), pa.int64()))
