"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the lower-cased words of a text and its end. The root's distribution is the smoothed unigram
distribution that also gives base_score. A context is the last one, two, ... up to DEPTH words before a
symbol. It is a candidate if its suffix is kept and it occurs MIN_CONTEXT times in the training texts, and it is
kept if what follows it diverges from what its suffix predicts: the Kullback-Leibler divergence of the next word,
times the count, estimated with each occurrence left out of its own prediction, so that chance alone gives
none, must reach DIVERGENCE, and LEAST_DIVERGENCE for each occurrence. A kept context's distribution is its
counts, smoothed with its suffix's distribution; the pairs of context and word that it is kept with occur
MIN_PAIR_COUNT times, and the mass of rarer ones goes to the suffix as well. These numbers are the same for every
size of the corpus, so the tree grows with it. Every token is scored in the longest kept suffix of the words
before it.

1. Tasks split texts into words once and write, a row for each block of texts, the 64-bit hashes of the
   block's distinct words, their training counts, and the texts as positions in that list.
2. The lists are cut by hash into slices and meet slice by slice, which gives each word's count over all
   blocks, and each block gets the counts of its words back as arrays. The number of slices grows with the
   lists, so a slice has a bounded size.
3. For each length, a pass over the blocks asks once for every pair of candidate context and next word, with its
   training count and its probability by the tree so far, packed and cut into slices by context; contexts of
   very frequent words are cut by next word as well. The slices sum the counts and the parts of the divergence,
   a join over contexts tests it, and each block gets back what was kept of what it asked for.
4. A last pass meets the blocks with their parts of the tree and scores them.

The word table, the counts and the tree grow with the corpus and stay distributed: no task and not the driver
holds more of the tree than a slice, or what the tokens of one block ask for.

Defined results: a null text counts as empty, which is one token, the end; a null doc_id has the checksum of
the empty text; repeated rows are learnt from and scored as often as they stand; with no training text at
all N and V are 0 and every token scores log10(1/1); an empty table gives no rows; further columns of the
input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DEPTH = 3
#: Least number of training tokens for a context and for a pair of context and word.
MIN_CONTEXT, MIN_PAIR_COUNT = 10, 2
#: Divergence of a context from its suffix, over all its occurrences and for each, in nats, from which it is kept;
#: weight of the suffix's distribution.
DIVERGENCE, LEAST_DIVERGENCE, SMOOTHING = 8.0, 0.1, 2.0
#: A block of texts ends at so many tokens; entries of word lists in a slice; tokens for each slice of the tree.
BLOCK_TOKENS, SLICE, TREE_SLICE = 2_000_000, 500_000, 1_000_000
END = b"\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, hashes binary, trained binary, n_trained long, n_listed long, doc_ids array<long>, no_id array<boolean>, held_out array<boolean>, lengths array<long>, codes binary"


def _pack(codes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers packed byte by byte of their places, which compresses those that are small."""
    numbers = np.ascontiguousarray(numbers)
    width = numbers.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes())


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(width, -1).T).view(kind).ravel()


def tokenized(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """A row for each block of texts: BLOCKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = count(TaskContext.get().partitionId() << 24)

        def fresh():
            return defaultdict(count().__next__), [], [], [], 0

        index, ids, lengths, codes, total = fresh()

        def block() -> pa.RecordBatch:
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")  # small numbers for frequent words
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            flat = place[flat]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index)).view(np.int64)[order]
            texts = ["" if i is None else str(i) for i in ids]
            held = [zlib.crc32(t.encode()) % folds == fold for t in texts]
            trained = np.bincount(flat[np.repeat(~np.array(held), lengths)], minlength=len(index))
            row = {
                "block": next(blocks),
                "hashes": hashes.tobytes(),
                "trained": trained.astype(np.int64).tobytes(),
                "n_trained": int(trained.sum()),
                "n_listed": len(order),
                "doc_ids": [i or 0 for i in ids],
                "no_id": [i is None for i in ids],
                "held_out": held,
                "lengths": lengths,
                "codes": _pack(flat),
            }
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").translate(_LOWER).split()  # bytes split at \\x20 and \\x09-\\x0D
                words.append(END)
                codes.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                ids.append(doc_id)
                lengths.append(len(words))
                total += len(words)
                if total >= BLOCK_TOKENS:
                    yield block()
                    index, ids, lengths, codes, total = fresh()
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


COUNTED = "block long, doc_ids array<long>, no_id array<boolean>, held_out array<boolean>, lengths array<long>, codes binary, hashes binary, counts binary, n_words long"


def counted_blocks(blocks: DataFrame, slices: int) -> DataFrame:
    """Blocks with the training count of each word over all blocks; n_words: how many different training
    words the slices have that were answered with this block first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, trained = np.frombuffer(row["hashes"], np.int64), np.frombuffer(row["trained"], np.int64)
            of = (hashes.view(np.uint64) % np.uint64(slices)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(slices + 1))
            parts = [order[i:j] for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(slices)),
                    pa.array(np.full(slices, row["block"])),
                    pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
                    pa.array([trained[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
                ],
                ["slice", "block", "hashes", "trained"],
            )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        hashes = [np.frombuffer(h, np.int64) for h in rows["hashes"]]
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(at, np.concatenate([np.frombuffer(t, np.int32) for t in rows["trained"]])).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])
        answers = [a.tobytes() for a in np.split(sums[at], ends[:-1])]
        n_words = np.zeros(len(rows), np.int64)
        n_words[0] = (sums > 0).sum()
        return pd.DataFrame({"block": rows["block"], "slice": rows["slice"], "counts": answers, "n_words": n_words})

    lists = blocks.select("block", "hashes", "trained").mapInArrow(cut, "slice long, block long, hashes binary, trained binary")
    answers = lists.groupBy("slice").applyInPandas(meet, "block long, slice long, counts binary, n_words long")
    texts = blocks.select(F.col("block").alias("of"), "doc_ids", "no_id", "held_out", "lengths", "codes", "hashes")

    def fill(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        of = np.frombuffer(texts["hashes"].iloc[0], np.uint64) % np.uint64(slices)
        counts = np.zeros(len(of), np.int64)
        # In the order of slices, and of the list within each.
        counts[np.argsort(of, kind="stable")] = np.frombuffer(b"".join(answers.sort_values("slice")["counts"]), np.int64)
        return texts.rename(columns={"of": "block"}).assign(counts=[counts.tobytes()], n_words=int(answers["n_words"].sum()))

    return texts.groupBy("of").cogroup(answers.groupBy("block")).applyInPandas(fill, COUNTED)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand, and whether they do."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each key stands, in the order of keys; and each key's place in that order."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=-1) != 0
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _pairs(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of pairs of context and next word."""
    return (_mix(contexts.astype(np.uint64) * _ODD + words) >> np.uint64(1)).astype(np.int64)


@dataclass
class Level:
    """A block's kept contexts of one length: sorted keys, counts, counts of kept pairs; sorted pairs and counts."""

    contexts: np.ndarray
    totals: np.ndarray
    paired: np.ndarray | None = None
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def smoothed(self, p: np.ndarray, at: np.ndarray, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probabilities of words in contexts of the tree that stand at at; p: those in their suffixes."""
        spot, paired = _find(self.pairs, _pairs(contexts, words))
        n = np.where(paired, self.counts[spot] if len(self.pairs) else 0, 0)
        total, kept = self.totals[at], self.paired[at]
        return (n + (total - kept + SMOOTHING) * p) / (total + SMOOTHING)


def _first_contexts(hashes: np.ndarray) -> np.ndarray:
    """Keys of contexts of one word."""
    return (_mix(hashes + _ODD) >> np.uint64(7)).astype(np.int64)


class Block:
    """The tokens of a block: hashes, training counts, place in their text, whether they are trained on."""

    def __init__(self, row: dict):
        codes = _unpack(row["codes"])
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.place = np.arange(len(codes)) - np.repeat(self.starts, self.lengths)
        self.trained = ~np.repeat(np.asarray(row["held_out"], bool), self.lengths)
        self.codes, self.listed = codes, np.frombuffer(row["hashes"], np.uint64)
        self.hashes = self.listed[codes]
        self.counts = np.frombuffer(row["counts"], np.int64)[codes]

    def contexts(self, length: int, shorter: np.ndarray | None = None) -> np.ndarray:
        """Keys of 57 bits of the length words before each token, from those of one word less."""
        if length == 1:
            return np.concatenate([_first_contexts(np.zeros(min(1, len(self.codes)), np.uint64)), _first_contexts(self.listed)[self.codes[:-1]]])
        before = np.zeros(len(self.hashes), np.uint64)
        before[length:] = self.hashes[:-length]
        return (_mix(before + shorter.astype(np.uint64) * _ODD) >> np.uint64(7)).astype(np.int64)

    @property
    def words(self) -> np.ndarray:
        """32 bits of each word, which tell apart what follows one context."""
        return (self.hashes >> np.uint64(32)).astype(np.uint32)

    def walk(self, levels: list[Level]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: the keys, where they stand among the kept contexts, and whether they do."""
        inside, keys = np.ones(len(self.hashes), bool), None
        for length, level in enumerate(levels, 1):
            keys = self.contexts(length, keys)
            some = np.flatnonzero(inside & (self.place >= length))
            if length == 1:  # once for each word of the list
                last = self.codes[some - 1]
                where, found = (x[last] for x in _find(level.contexts, _first_contexts(self.listed)))
            else:
                where, found = _find(level.contexts, keys[some])
            at, inside = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            at[some], inside[some] = where, found
            yield length, keys, at, inside


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(**types: str) -> tuple[str, pa.Schema]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return ", ".join(f"{n} {t}" for n, t in types.items()), pa.schema([(n, kinds[t]) for n, t in types.items()])


#: What a block asks a slice: contexts (sorted; differences), how many words follow each (twice, and 1 if the context
#: is cut by next word), the words, their training counts and log probabilities by the tree so far.
ASKED, ASKED_ARROW = _schema(slice="long", block="long", contexts="binary", sizes="binary", words="binary", n="binary", logs="binary")
#: What a slice says: for each block the contexts and pairs that can be kept; under no block its sums by context.
MET, MET_ARROW = _schema(slice="long", block="long", contexts="binary", sizes="binary", words="binary", n="binary", parts="binary", mass="binary")
#: What a block gets: kept contexts with counts and counts of kept pairs, and these pairs.
FOUND, FOUND_ARROW = _schema(length="int", block="long", contexts="binary", totals="binary", mass="binary", sizes="binary", words="binary", n="binary")


def levels_of(found: pa.Table, depth: int) -> list[Level]:
    """The part of the tree that a block was answered with."""
    held = defaultdict(list)
    for row in found.to_pylist():
        contexts, sizes = _numbers(row["contexts"], np.int64), _numbers(row["sizes"], np.uint32)
        pairs = _pairs(np.repeat(contexts, sizes), np.frombuffer(row["words"], np.uint32))
        held[row["length"]].append((contexts, _numbers(row["totals"], np.int64), _numbers(row["mass"], np.int64), pairs, _numbers(row["n"], np.int64)))
    levels = []
    for length in range(1, depth + 1):
        contexts, totals, mass, pairs, n = (np.concatenate(c) for c in zip(*held.get(length, [(np.zeros(0, np.int64),) * 5]), strict=True))
        contexts, first = np.unique(contexts, return_index=True)  # one that is cut by next word comes from several slices
        order = np.argsort(pairs)
        levels.append(Level(contexts, totals[first], mass[first], pairs[order], n[order]))
    return levels


def asked(blocks: DataFrame, found: DataFrame | None, depth: int, slices: int, root: float) -> DataFrame:
    """ASKED for contexts one word longer than the depth levels found. Texts held out ask as well, with a count of
    0 for what only they have. root: what the root's counts plus 1 are divided by."""

    def ask(row: dict, levels: list[Level]) -> pa.Table:
        block = Block(row)
        length, keys, inside = depth + 1, None, np.ones(len(block.hashes), bool)
        walked = list(block.walk(levels))
        if walked:
            _, keys, _, inside = walked[-1]
        before = np.zeros(len(inside), np.int64)
        before[length:] = block.counts[:-length]
        some = inside & (before >= MIN_CONTEXT) & (block.place >= length)
        some = np.flatnonzero(some)
        contexts, words = block.contexts(length, keys)[some], block.words[some]
        first, at = _distinct(_pairs(contexts, words))
        n = np.bincount(at, block.trained[some], len(first)).astype(np.uint32)
        # What follows is the same wherever a pair stands.
        contexts, words, some = contexts[first], words[first], some[first]
        p = (block.counts[some] + 1) / root
        for (_, suffix, at, _), level in zip(walked, levels, strict=True):
            p = level.smoothed(p, at[some], suffix[some], words)
        logs = np.log(p).astype(np.float16)
        # A context occurs no more often than its words do.
        nearest = np.zeros(len(inside), np.int64)
        nearest[1:] = block.counts[:-1]
        cuts = -(-np.minimum(before[some], nearest[some]) // TREE_SLICE)
        of = (_mix(contexts.astype(np.uint64) + _ODD * (words % np.maximum(cuts, 1)).astype(np.uint64)) % np.uint64(slices)).astype(np.int64)
        # By slice, context and word: sorting three times by one number is quicker than once by three.
        order = np.argsort(_distinct(contexts)[1] << 32 | words)
        order = order[np.argsort(of[order].astype(np.uint16 if slices <= 1 << 16 else np.int64), kind="stable")]
        ends = np.searchsorted(of[order], np.arange(slices + 1))
        rows = []
        for i in np.flatnonzero(np.diff(ends)):
            part = order[ends[i] : ends[i + 1]]
            starts = np.flatnonzero(np.diff(contexts[part], prepend=-1))
            sizes = 2 * np.diff(np.append(starts, len(part))) + (cuts[part][starts] > 1)
            rows.append((int(i), row["block"], _planes(np.diff(contexts[part][starts], prepend=0)), _planes(sizes.astype(np.uint32)), words[part].tobytes(), _planes(n[part]), _planes(logs[part])))
        return _table(rows, ASKED_ARROW)

    texts = blocks.select("block", "held_out", "lengths", "codes", "hashes", "counts")
    if found is None:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                yield from ask(row, []).to_batches()

        return texts.mapInArrow(each, ASKED)
    meet = lambda text, found: ask(text.to_pylist()[0], levels_of(found, depth))
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(meet, ASKED)


def met(rows: pa.Table) -> pa.Table:
    """MET of a slice. A context's part of the divergence: over its occurrences, the log of what its other ones give the
    word, together with the suffix, less what the suffix gives it; the count is divided out at the end."""
    slice_, read = rows.column("slice")[0].as_py(), []
    for row in rows.to_pylist():
        sizes = _numbers(row["sizes"], np.uint32)
        contexts = np.repeat(np.cumsum(_numbers(row["contexts"], np.int64)), sizes >> 1)
        read.append((row["block"], contexts, np.repeat(sizes & 1, sizes >> 1), np.frombuffer(row["words"], np.uint32), _numbers(row["n"], np.uint32), _numbers(row["logs"], np.float16)))
    blocks, *columns = zip(*read, strict=True)
    ends = np.cumsum([len(c) for c in columns[0]])[:-1]
    contexts, cut, words, n, logs = (np.concatenate(c) for c in columns)
    _, first, at = np.unique(_pairs(contexts, words), return_index=True, return_inverse=True)
    total = np.bincount(at, n).astype(np.int64)
    own, of = np.unique(contexts[first], return_inverse=True)
    occurrences = np.bincount(of, total).astype(np.int64)
    seen, log = total > 0, logs[first].astype(np.float64)
    parts = np.bincount(of[seen], total[seen] * (np.log(total[seen] - 1 + SMOOTHING * np.exp(log[seen])) - log[seen]), len(own))
    paired = total >= MIN_PAIR_COUNT
    mass = np.bincount(of[paired], total[paired], len(own)).astype(np.int64)
    whole = np.ones(len(own), bool)
    whole[of] = cut[first] == 0
    often = (occurrences >= MIN_CONTEXT) | ~whole
    out = [(slice_, None, own[often].tobytes(), b"", b"", occurrences[often].tobytes(), parts[often].tobytes(), mass[often].tobytes())]
    for block, c, w, pair in zip(blocks, np.split(contexts, ends), np.split(words, ends), np.split(at, ends), strict=True):
        some = often[of[pair]]
        c, w, pair = c[some], w[some], pair[some]
        starts = np.flatnonzero(np.diff(c, prepend=-1))
        keep = paired[pair]
        sizes = np.add.reduceat(keep, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        out.append((slice_, block, _planes(c[starts]), _planes(sizes.astype(np.uint32)), w[keep].tobytes(), _planes(total[pair][keep]), None, None))
    return _table(out, MET_ARROW)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slice, context, n, part, mass: a slice's sums, a row a context."""
    for row in _rows(batches):
        contexts = np.frombuffer(row["contexts"], np.int64)
        columns = [np.full(len(contexts), row["slice"]), contexts, np.frombuffer(row["n"], np.int64), np.frombuffer(row["parts"]), np.frombuffer(row["mass"], np.int64)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["slice", "context", "n", "part", "mass"])


def answer(length: int, rows: pa.Table, known: pa.Table) -> pa.Table:
    """FOUND: for each block those of a slice's contexts that are kept."""
    kept, n, mass = (known.column(c).to_numpy() for c in ("context", "n", "mass"))
    order = np.argsort(kept)
    kept, n, mass, out = kept[order], n[order], mass[order], []
    for row in rows.to_pylist():
        contexts, sizes = _numbers(row["contexts"], np.int64), _numbers(row["sizes"], np.uint32)
        at, some = _find(kept, contexts)
        if some.any():
            pairs, at = np.repeat(some, sizes), at[some]
            words, counts = np.frombuffer(row["words"], np.uint32)[pairs], _numbers(row["n"], np.int64)[pairs]
            out.append((length, row["block"], _planes(contexts[some]), _planes(n[at]), _planes(mass[at]), _planes(sizes[some]), words.tobytes(), _planes(counts)))
    return _table(out, FOUND_ARROW)


def grow(blocks: DataFrame, slices: int, root: float, scratch: Scratch) -> tuple[DataFrame | None, int]:
    """The tree as FOUND, each block's part of it, and its depth."""
    found = None
    for length in range(1, DEPTH + 1):
        slice_rows = scratch(asked(blocks, found, length - 1, slices, root).groupBy("slice").applyInArrow(met, MET), "met")
        sums = slice_rows.filter("block IS NULL").mapInArrow(_sums, "slice long, context long, n long, part double, mass long")
        n = F.col("n")
        gain = F.col("part") - n * F.log(n - 1 + F.lit(SMOOTHING))
        kept = sums.groupBy("context").agg(F.sum("n").alias("n"), F.sum("part").alias("part"), F.sum("mass").alias("mass"))
        kept = kept.filter((n >= MIN_CONTEXT) & (gain >= DIVERGENCE) & (gain >= LEAST_DIVERGENCE * n)).select("context", "n", "mass")
        kept = scratch(kept.join(sums.select("slice", "context"), "context"), "kept")
        if kept.isEmpty():
            scratch.drop(slice_rows, kept)
            return found, length - 1
        own = slice_rows.filter("block IS NOT NULL").groupBy("slice").cogroup(kept.groupBy("slice")).applyInArrow(partial(answer, length), FOUND)
        own = scratch(own, "found")
        found = own if found is None else found.unionByName(own)
        scratch.drop(slice_rows, kept)
    return found, DEPTH


def probabilities(block: Block, levels: list[Level], root: np.ndarray) -> np.ndarray:
    """Of each token in the longest kept suffix of the words before it."""
    p, words = root.copy(), block.words
    for (_, keys, at, inside), level in zip(block.walk(levels), levels, strict=True):
        some = np.flatnonzero(inside)
        if not len(some):
            break
        p[some] = level.smoothed(p[some], at[some], keys[some], words[some])
    return p


def lm_scores(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; see the module. Texts whose
    id's CRC-32 leaves the remainder fold of folds are scored but not learnt from."""
    scratch = Scratch(docs.sparkSession, tidy=True)
    blocks = scratch(tokenized(docs, folds, fold), "blocks")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n_train, listed, n_tokens = blocks.agg(total("n_trained"), total("n_listed"), total(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)"))).first()
    counted = scratch(counted_blocks(blocks, max(1, -(-listed // SLICE))), "counted")
    scratch.drop(blocks)
    distinct = counted.agg(F.sum("n_words")).first()[0] or 0
    everything = float(n_train + 1 * (distinct + 1))
    found, depth = grow(counted, max(1, -(-n_tokens // TREE_SLICE)), everything, scratch)

    def score(row: dict, levels: list[Level]) -> pa.Table:
        block = Block(row)
        root = (block.counts + 1) / everything
        add = lambda x, starts=block.starts: pa.array(np.add.reduceat(x, starts))
        ids = pa.array(row["doc_ids"], pa.int64(), mask=np.asarray(row["no_id"], bool))
        known, base, score = add((block.counts > 0).astype(np.int64)), add(np.log10(root)), add(np.log10(probabilities(block, levels, root)))
        n = pa.array(np.full(len(block.lengths), n_train, np.int64))
        return pa.Table.from_arrays(
            [ids, pa.array(row["held_out"]), pa.array(block.lengths), known, n, base, score], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from score(row, []).to_batches()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if found is None:
        return counted.mapInArrow(each, schema)
    meet = lambda text, found: score(text.to_pylist()[0], levels_of(found, depth))
    return counted.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(meet, schema)
