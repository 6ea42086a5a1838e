"""Exact Jaccard join of documents on sets of word n-grams, by partitions of the token universe.

Two sets whose similarity reaches the threshold differ in a bounded number of tokens, U. Sizes fall into
bands of a ratio that lets linked sets lie in one band or in neighbouring ones. For every band the universe
is dealt by hash into segments, and each segment i gets an allocation t_i: 0, its subsets must agree, or 1,
they may differ by one token. With sum(t_i + 1) = U + 1 + slack, segments of linked sets that keep within
their allocation weigh more than slack (pigeonhole). A set is indexed by the hash of each segment's subset
and, where t_i is 1, by those of its one-deletion neighbourhood. Signatures of nothing at all select badly;
the slack lets a set leave them out, unless it has more of them than the slack weighs; and a set that is
smaller than its band allows for leaves out its greatest signatures, as many as it can spare. How many segments
get which allocation is chosen for each band at the least expected cost: of the signatures, which have to be
shuffled, and of a set that meets another by chance, which follows from the share of tokens that several sets
hold. That share is measured on a hash sample of the universe over all documents.

Equal sets are one vertex from the start. Sets that share a signature are candidates:

1. A token that no other candidate holds counts towards the difference from any partner. Sets with too many of
   them, alone or with the best partner of their bucket, have no link and leave.
2. In a bucket of equal signatures each set is compared with one pivot, exactly, on the sets themselves. Only
   sets that are then in different components still have to be compared.
3. Such buckets are assigned to the heaviest component among their members, and all sets of its buckets are
   described by their change against its central member, which for near copies is short. The others meet
   the component's members in blocks, and each other bucket by bucket; blocks are compared by counting all
   intersections at once, and hand over only links that connect components.

So no pairs within a large group are listed, and the components are those of all links. Blocks of a component
and of sets that stay outside of it are the one thing that grows with the product of both.

Defined results: null and empty texts, or texts without a word, have n_shingles 0 and link with nothing;
a text of fewer words than n is one shingle; repeated rows are linked as equal sets; rows of one doc_id with
other texts are documents of their own; a null doc_id has no number and is only a component's id if no
member has one; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize
from .components import connected_components

#: Rows of signatures that a task hands over at once; hashes of words that it keeps; sets it remembers.
CHUNK, MAX_HASHES, MAX_SEEN = 1_000_000, 500_000, 300_000
#: Sets of a bucket up to which pairs are compared one by one, and sets of a block beyond that.
SMALL, BLOCK = 16, 1024
#: Bits for each id of the filter that picks the documents to shingle again, its least and most bits (32 MB: beyond
#: that it lets more documents through, which costs time only), and places of an id in it.
FILTER_SHARE, LEAST_BITS, MOST_BITS, FILTER_PROBES = 16, 1 << 20, 1 << 28, 3
#: Columns of a table of tokens that is multiplied at once.
COLUMNS = 4096
#: Cost, in signatures, of a set that meets another by chance; one in so many tokens is in the universe's sample.
CANDIDATE_COST, SAMPLED = 300.0, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of n-gram hashes of texts (lower-cased A-Z, words between white space)."""

    def __init__(self, n: int):
        self.n, self.hashes = n, {}
        self.odd = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        words = (text or b"").translate(_LOWER).split()  # bytes split at \\x20 and \\x09-\\x0D
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > MAX_HASHES:
            self.hashes = {}
        known = self.hashes
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        k = min(self.n, len(h))
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total += h[i : len(h) - k + 1 + i] * self.odd[i]
        return np.unique(_mix(total))


class Bands:
    """Size bands of a threshold num / den, and the most tokens in which linked sets of a band differ."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def edges(self, largest: int) -> list[tuple[int, int]]:
        found, low = [], 1
        while low <= largest:
            found.append((low, max(low, low * self.den // self.num)))
            low = found[-1][1] + 1
        return found

    def difference(self, high: int) -> int:
        """For a smaller set of at most high tokens: num * union <= den * intersection bounds both sizes' sum."""
        return (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)


def allocate(low: int, high: int, shared: float, difference: int) -> tuple[int, int, int]:
    """(segments with t = 0, segments with t = 1, slack) of a band, at the least expected cost of a set.
    shared: the chance that a token is held by several sets."""
    best = None
    most = (difference + 1) // 2
    for ones in sorted({round(most * i / 16) for i in range(17)}):
        slack = 0
        for _ in range(50):
            zeros = max(0, difference + 1 + slack - 2 * ones)
            mean = low / (zeros + ones)
            nothing = math.exp(-mean)
            skipped = zeros * nothing + 2 * ones * nothing * (1 + mean)
            wanted = math.ceil(skipped + 3 * math.sqrt(skipped)) if skipped > 1e-4 else 0
            if wanted <= slack:
                break
            slack = wanted
        else:
            slack = 0
        if slack > difference + 1:  # sets too small for it: they give all their signatures
            slack = 0
        zeros = max(0, difference + 1 + slack - 2 * ones)
        mean = low / (zeros + ones)
        nothing = math.exp(-mean)
        signatures = zeros + ones * (1 + mean)
        alone = zeros * mean * nothing + ones * nothing * (mean + mean * mean)
        cost = signatures + CANDIDATE_COST * (1 - math.exp(-shared * alone))
        if best is None or cost < best[0]:
            best = (cost, zeros, ones, slack)
    return best[1:]


class Signer:
    """Signatures of sets by the bands' allocations. schemes: (low, high, zeros, ones, slack) by band."""

    def __init__(self, schemes: list[tuple[int, int, int, int, int]], num: int, den: int):
        self.schemes, self.num, self.den = schemes, num, den
        self.highs = np.array([s[1] for s in schemes])

    def _of_band(self, tokens: np.ndarray, values: np.ndarray, band: int) -> np.ndarray:
        low, high, zeros, ones, _ = self.schemes[band]
        m = zeros + ones
        segment = (tokens % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, segment, values)
        sizes = np.bincount(segment, minlength=m)
        place = _mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))
        # What this set and any partner in the band differ by at most, and so what segments it can do without.
        n = len(tokens)
        partner = n * self.den // self.num if n <= high else high
        spare = zeros + 2 * ones - 1 - (n + partner) * (self.den - self.num) // (self.den + self.num)
        skipped = int((sizes[:zeros] == 0).sum() + 2 * (sizes[zeros:] <= 1).sum())
        exact = _mix(sums ^ place)
        if skipped > spare:  # it has more of nothing than it can leave out
            late = segment >= zeros
            given = exact
        else:
            late = (segment >= zeros) & (sizes[segment] > 1)
            given = exact[sizes > 0]
            if not ones:
                # Both sets of a link leave out the greatest of what they can, so the least they share stays.
                given = np.sort(given)[: len(given) - (spare - skipped)]
        if not ones:
            return given
        at = segment[late]
        return np.concatenate([given, _mix((sums[at] - values[late]) ^ place[at])])

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        band = int(np.searchsorted(self.highs, n))
        values = _mix(tokens + np.uint64(0x9E3779B97F4A7C15))
        found = [self._of_band(tokens, values, band)]
        if band and -(-n * self.num // self.den) <= self.schemes[band - 1][1]:
            found.append(self._of_band(tokens, values, band - 1))
        return np.unique(np.concatenate(found) >> np.uint64(16))  # 48 bits: chance collisions are verified away


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id, 128 bits of the set (null: no shingles), and sample, those of its
    tokens that are in the universe's sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            sets = [shingles(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_hash": batch.column("text_hash"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_id": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "sample": pa.array([s[s % np.uint64(SAMPLED) == 0].view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, sample array<long>")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def shared_share(members: DataFrame) -> float:
    """The share of tokens that several sets hold, from the sample of the universe."""
    held = members.select("set_id", F.explode("sample").alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))
    some, every = held.agg(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.sum("n")).first()
    return (some or 0) / (every or 1)


SIGNED = "key long, set_id binary, signature long, kind int"
#: Kinds of rows of signatures: the first of its signature among a task's sets; one with others; the others.
ALONE, FIRST, OTHER = range(3)


def signatures(docs: DataFrame, n: int, schemes: list, num: int, den: int) -> DataFrame:
    """SIGNED. A task gives the signatures of a set that it has just seen only once, and of the sets of a chunk
    that share one only the first goes by it (key is the signature): the others go by keys of their own, so that
    a signature that very many sets have costs one row a chunk where it is met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign, seen = Shingler(n), Signer(schemes, num, den), set()
        held, ids, rows = [], [], 0

        def batch_of() -> pa.RecordBatch:
            own, flat = np.repeat(np.arange(len(ids)), [len(h) for h in held]), np.concatenate(held)
            _, first, at, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            kind = np.where(first[at] != np.arange(len(flat)), OTHER, np.where(count[at] > 1, FIRST, ALONE)).astype(np.int32)
            key = np.where(kind == OTHER, _mix(flat + _mix(own.astype(np.uint64) + np.uint64(1))), flat).view(np.int64)
            signature = pa.array(flat.view(np.int64), mask=kind != OTHER)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids, pa.binary()).take(pa.array(own)), signature, pa.array(kind)], ["key", "set_id", "signature", "kind"])

        for batch in batches:
            for text in _texts(batch):
                tokens = shingles(text)
                key = xxhash.xxh3_128_digest(tokens.tobytes())
                if not len(tokens) or key in seen:
                    continue
                if len(seen) > MAX_SEEN:
                    seen.clear()
                seen.add(key)
                held.append(sign(tokens))
                ids.append(key)
                rows += len(held[-1])
                if rows >= CHUNK:
                    yield batch_of()
                    held, ids, rows = [], [], 0
        if held:
            yield batch_of()

    return docs.select("text").mapInArrow(run, SIGNED)


def buckets(signed: DataFrame) -> DataFrame:
    """signature, set_id of the signatures that several sets have."""
    met = Window.partitionBy("key")
    rows = signed.withColumns({"_least": F.min("set_id").over(met), "_most": F.max("set_id").over(met)})
    return rows.filter((F.col("kind") > ALONE) | (F.col("_least") < F.col("_most"))).select(F.coalesce("signature", "key").alias("signature"), "set_id").distinct()


def _probes(doc_id: Column, bits: int) -> Column:
    """Places of an id in a filter of so many bits."""
    return F.array(*(F.pmod(F.xxhash64(doc_id, F.lit(i)), F.lit(bits)).cast("int") for i in range(FILTER_PROBES)))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter over the ids (doc_id), built by Spark word by word: its bits in words of 32. Its size follows
    the number of ids, up to MOST_BITS."""
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * FILTER_SHARE).bit_length()))
    at = ids.select(F.explode(_probes(F.col("doc_id"), bits)).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("bits")).toPandas()  # at most MOST_BITS / 32 rows
    found = np.zeros(bits // 32, np.uint32)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return found


def _wanted(docs: DataFrame, n: int, ids: DataFrame, give, schema: str) -> DataFrame:
    """give(sets, their 128-bit ids) for batches of the documents whose ids pass a filter (a few others may).
    Texts stay where they are read: only what is asked of their sets moves."""
    bits = id_filter(ids)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bits = Shingler(n), held.value
        for batch in batches:
            probes = batch.column("probes").flatten().to_numpy().reshape(-1, FILTER_PROBES)
            passed = ((bits[probes >> 5] >> (probes & 31).astype(np.uint32)) & 1).all(axis=1)
            sets = [s for s in map(shingles, _texts(batch.filter(pa.array(passed)))) if len(s)]
            if sets:
                yield give(sets, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets])

    return docs.select("text", _probes(F.col("doc_id"), len(bits) * 32).alias("probes")).mapInArrow(run, schema)


def _owner(set_id: Column) -> Column:
    """The first 64 bits of a set's id as a number."""
    return F.conv(F.hex(F.substring(set_id, 1, 8)), 16, -10).cast("long")


def unique_tokens(docs: DataFrame, n: int, ids: DataFrame, total: int) -> DataFrame:
    """owner, unique: how many tokens of a set no other set has, among the documents of ids (and a few others).
    Tokens, about total, go by so many bits that one in some hundreds is taken for another; such are counted as
    shared, so nothing is lost."""
    shift = np.uint64(max(0, 64 - total.bit_length() - 8))

    def give(sets: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        owners = np.array([int.from_bytes(x[:8], "big", signed=True) for x in names], np.int64)
        tokens = (np.concatenate(sets) >> shift).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(owners, [len(s) for s in sets]))], ["token", "owner"])

    held = _wanted(docs, n, ids, give, "token long, owner long").groupBy("token").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    return held.filter("owner = other").groupBy("owner").agg(F.count("*").alias("unique"))


def token_sets(docs: DataFrame, n: int, ids: DataFrame) -> DataFrame:
    """set_id and tokens, array<long>, of the documents of ids (and a few others)."""

    def give(sets: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["set_id", "tokens"])

    return _wanted(docs, n, ids, give, "set_id binary, tokens array<long>")


def schemes_for(members: DataFrame, num: int, den: int) -> list[tuple[int, int, int, int, int]]:
    """The bands' allocations, from the sizes and the shared tokens of all documents."""
    bands, shared = Bands(num, den), shared_share(members)
    largest = members.agg(F.max("n_shingles")).first()[0] or 1
    return [(low, high, *allocate(low, high, shared, bands.difference(high))) for low, high in bands.edges(largest)]


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (u, v) of set ids whose sets reach the threshold."""
    a = sets.select(F.col("set_id").alias("u"), F.col("tokens").alias("a"))
    b = sets.select(F.col("set_id").alias("v"), F.col("tokens").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    na, nb = F.size("a"), F.size("b")
    could = den * F.least(na, nb) >= num * F.greatest(na, nb)
    shared = F.when(could, F.size(F.array_intersect("a", "b")))
    return both.select("u", "v", na.alias("na"), nb.alias("nb"), shared.alias("n")).filter(den * F.col("n") >= num * (F.col("na") + F.col("nb") - F.col("n"))).select("u", "v")


def _excess(unique: Column, size: Column, num: int, den: int) -> Column:
    """By how much a set's own tokens exceed its part of the most that linked sets can differ in; the parts of
    two linked sets add up to 0 or less."""
    return (den + num) * unique - (den - num) * size


def prune(rows: DataFrame, held: DataFrame, unique: DataFrame, num: int, den: int) -> DataFrame:
    """Those rows (signature, set_id) whose sets can have a link in their bucket, with the set's size."""
    counted = held.join(unique, "owner", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    able = counted.filter(den * (F.col("size") - F.col("unique")) >= num * F.col("size")).select("set_id", "size", _excess(F.col("unique"), F.col("size"), num, den).alias("excess"))
    some = rows.join(able, "set_id")
    least = some.groupBy("signature").agg(F.min("excess").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return some.join(least, "signature").filter("excess + least <= 0").select("signature", "set_id", "size")


def pivot_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: the least set of each bucket and each other one whose size allows a link."""
    pivots = rows.groupBy("signature").agg(F.min(F.struct("set_id", "size")).alias("p"))
    sizes = F.least("size", "p.size"), F.greatest("size", "p.size")
    return rows.join(pivots, "signature").filter((F.col("set_id") != F.col("p.set_id")) & (den * sizes[0] >= num * sizes[1])).select(F.col("p.set_id").alias("u"), F.col("set_id").alias("v")).distinct()


def links(docs: DataFrame, members: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame | None:
    """vertex, component over set ids with at least one link; None if there is none."""
    rows = scratch(buckets(signatures(docs, n, schemes_for(members, num, den), num, den)), "buckets")
    one = members.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"))
    held = scratch(one.join(rows.select("set_id").distinct(), "set_id").withColumn("owner", _owner(F.col("set_id"))), "candidates")
    if held.isEmpty():
        return None
    total = held.agg(F.sum("size")).first()[0]
    able = scratch(prune(rows, held, unique_tokens(docs, n, held.select("doc_id"), total), num, den), "able")
    scratch.drop(rows)
    chosen = held.join(able.select("set_id").distinct(), "set_id", "left_semi")
    # Rows of one doc_id can hold several texts, and a set several rows.
    found = token_sets(docs, n, chosen.select("doc_id")).groupBy("set_id").agg(F.any_value("tokens").alias("tokens"))
    sets = scratch(found.join(chosen, "set_id", "left_semi"), "sets")
    scratch.drop(held)
    edges = scratch(verify(pivot_pairs(able, num, den), sets, num, den), "links")
    labels = _labels(edges, scratch)
    unsettled = scratch(open_buckets(able, labels), "open")
    scratch.drop(able)
    if not unsettled.isEmpty():
        placed = scratch(assigned(unsettled), "placed")
        described = scratch(describe(placed.select("centre", "set_id").distinct(), sets), "described")
        near = described.filter(_reaches(F.col("shared"), F.col("size"), F.col("centre_size"), num, den) & (F.col("centre") != F.col("set_id"))).select("centre", "set_id")
        edges = scratch(edges.union(near), "links")
        scratch.drop(labels)
        labels = _labels(edges, scratch)
        outside = scratch(relabelled(placed, labels), "outside")
        more = block_links(outside, described, num, den).union(small_links(outside, described, num, den))
        edges = scratch(edges.union(more), "links")
        scratch.drop(labels)
        labels = _labels(edges, scratch)
    return labels


def _labels(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    return None if edges.isEmpty() else scratch(connected_components(edges), "labels")


def _reaches(n, a, b, num: int, den: int):
    return den * n >= num * (a + b - n)


def _component(rows: DataFrame, labels: DataFrame | None, of: str, name: str) -> DataFrame:
    """rows with the component of a set: its label, or itself."""
    if labels is None:
        return rows.withColumn(name, F.col(of))
    named = labels.select(F.col("vertex").alias(of), F.col("component").alias("_component"))
    return rows.join(named, of, "left").withColumn(name, F.coalesce("_component", of)).drop("_component")


def open_buckets(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """signature, set_id, component of buckets that hold more than one component; of buckets with the same
    sets one."""
    labelled = _component(rows.select("signature", "set_id"), labels, "set_id", "component")
    same = labelled.groupBy("signature").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"),
        F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("h"), F.sum(F.hash("set_id").cast("long")).alias("g"),
    )
    kept = same.filter("a <> b").groupBy("n", "h", "g").agg(F.min("signature").alias("signature")).select("signature")
    return labelled.join(kept, "signature")


def assigned(rows: DataFrame) -> DataFrame:
    """signature, set_id, centre: of the component with most rows among a bucket's, the set with most of them."""
    weights = rows.groupBy("component", "set_id").agg(F.count("*").alias("w"))
    centres = weights.groupBy("component").agg(F.sum("w").alias("weight"), F.max_by("set_id", F.struct("w", "set_id")).alias("centre"))
    of_bucket = rows.select("signature", "component").distinct().join(centres, "component").groupBy("signature").agg(F.max(F.struct("weight", "centre")).alias("m"))
    return rows.join(of_bucket, "signature").select("signature", "set_id", F.col("m.centre").alias("centre"))


def describe(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """centre, set_id, size, centre_size, shared and change, the tokens that only one of both has."""
    own = sets.select("set_id", F.col("tokens").alias("own"))
    of_centre = sets.select(F.col("set_id").alias("centre"), F.col("tokens").alias("of_centre"))
    both = pairs.join(of_centre, "centre").join(own, "set_id").withColumn("shared", F.size(F.array_intersect("own", "of_centre")))
    change = F.concat(F.array_except("own", "of_centre"), F.array_except("of_centre", "own"))
    return both.select("centre", "set_id", F.size("own").alias("size"), F.size("of_centre").alias("centre_size"), "shared", change.alias("change"))


def relabelled(placed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """placed with the set's component, and whether it lies outside of its centre's."""
    both = _component(_component(placed, labels, "set_id", "component"), labels, "centre", "home")
    return both.withColumn("out", F.col("component") != F.col("home")).drop("home")


def small_links(outside: DataFrame, described: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between the outside sets of buckets that have few of them."""
    outs = outside.filter("out")
    few = outs.groupBy("signature").agg(F.count("*").alias("n")).filter(f"n BETWEEN 2 AND {SMALL}").select("signature")
    some = outs.join(few, "signature").select("signature", "centre", "set_id", "component")
    other = some.select("signature", F.col("set_id").alias("v"), F.col("component").alias("_c"))
    pairs = some.join(other, "signature").filter("set_id < v AND component <> _c").groupBy(F.col("set_id").alias("u"), "v").agg(F.min("centre").alias("centre"))
    side = lambda of, p: described.select("centre", F.col("set_id").alias(of), *(F.col(c).alias(f"{p}_{c}") for c in ("size", "shared", "change")), *(["centre_size"] if p == "a" else []))
    both = pairs.join(side("u", "a"), ["centre", "u"]).join(side("v", "b"), ["centre", "v"])
    n = F.col("a_shared") + F.col("b_shared") - F.col("centre_size") + F.size(F.array_intersect("a_change", "b_change"))
    return both.filter(_reaches(n, F.col("a_size"), F.col("b_size"), num, den)).select("u", "v")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b: tables of ones, multiplied a few columns at a time."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    columns = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    placed = []
    for sets, flat in ((a, flat_a), (b, flat_b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(columns, flat), max(len(columns) - 1, 0))
        there = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
        placed.append((row[there], at[there], len(sets)))
    for start in range(0, len(columns), COLUMNS):
        tables = []
        for row, at, n in placed:
            here = (at >= start) & (at < start + COLUMNS)
            table = np.zeros((n, min(COLUMNS, len(columns) - start)), np.float32)
            table[row[here], at[here] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def block_links(outside: DataFrame, described: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between components, enough of them to connect what all links connect: of the sets outside
    of a centre's component with those inside, and with each other in buckets that have many of them.

    With C the centre, x and y two sets and D the changes against C, |x and y| = |C and x| + |C and y| - |C|
    + |Dx and Dy|. Both sides of a task are blocks of sets.
    """
    per_centre = outside.select("centre", "set_id", "component", "out").distinct().filter("out OR set_id <> centre")
    counts = per_centre.groupBy("centre").agg(F.count_if("out").alias("a"), F.count_if(~F.col("out")).alias("b")).filter("a > 0 AND b > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int")
    every = lambda first, last: F.explode(F.sequence(first, last))
    columns = ["set_id", "component", "size", "centre_size", "shared", "change"]
    nothing = F.lit(None).cast("long").alias("signature")
    met = per_centre.join(counts.select("centre", blocks("a").alias("m"), blocks("b").alias("k")), "centre").join(described, ["centre", "set_id"])
    left = met.filter("out").select("centre", nothing, *columns, block("m").alias("i"), every(F.lit(0), F.col("k") - 1).alias("j"))
    right = met.filter("NOT out").select("centre", nothing, *columns, every(F.lit(0), F.col("m") - 1).alias("i"), block("k").alias("j"))
    outs = outside.filter("out")
    many = outs.groupBy("signature").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).filter(f"n > {SMALL} AND a <> b")
    wide = outs.join(many.select("signature", blocks("n").alias("m")), "signature").join(described, ["centre", "set_id"])
    left = left.unionByName(wide.withColumn("i", block("m")).select("centre", "signature", *columns, "i", every(F.col("i"), F.col("m") - 1).alias("j")))
    right = right.unionByName(wide.withColumn("j", block("m")).select("centre", "signature", *columns, every(F.lit(0), F.col("j")).alias("i"), "j"))
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            changes = [[np.asarray(c, np.int64) for c in side] for side in (left["change"], right["r_change"])]
            n = _common(*changes) + left["shared"].to_numpy()[:, None] + right["r_shared"].to_numpy()[None, :] - int(left["centre_size"].iloc[0])
            union = left["size"].to_numpy()[:, None] + right["r_size"].to_numpy()[None, :] - n
            names, codes = np.unique(np.concatenate([left["component"], right["r_component"]]), return_inverse=True)
            a, b = codes[: len(left)], codes[len(left) :]
            linked = (den * n >= num * union) & (a[:, None] != b[None, :])
            parent = list(range(len(names)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i in np.flatnonzero(linked.any(axis=1)):
                hits = np.flatnonzero(linked[i])
                for c, first in zip(*np.unique(b[hits], return_index=True), strict=True):
                    if root(a[i]) != root(c):
                        parent[root(a[i])] = root(c)
                        out.append((left["set_id"].iloc[i], right["r_set_id"].iloc[hits[first]]))
        return pd.DataFrame(out, columns=["u", "v"])

    return left.groupBy("centre", "signature", "i", "j").cogroup(right.groupBy("r_centre", "r_signature", "r_i", "r_j")).applyInPandas(compare, "u binary, v binary")


def set_components(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and set_id, component for every set."""
    members = scratch(fingerprints(docs, n), "members")
    labels = links(docs, members, n, num, den, scratch)
    return members, _component(members.filter("set_id IS NOT NULL").select("set_id").distinct(), labels, "set_id", "component")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text, ...): documents link when
    den * intersection >= num * union of their sets of n-word shingles."""
    scratch = Scratch(docs.sparkSession)
    members, components = set_components(docs, n, num, den, scratch)
    firsts = members.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    firsts = scratch(firsts.join(components, "set_id"), "firsts")
    ids = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = firsts.join(ids, "component").select(F.col("set_id").alias("_set"), "component_id")
    joined = members.join(ids, F.col("set_id") == F.col("_set"), "left")
    found = joined.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    found = materialize(found, "components")
    scratch.clear()
    return found


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: the one with the least doc_id (null last), of texts under one id
    that with the least hash. Rows that repeat its doc_id and text go as well; documents without words stay, each
    being a component of its own. Further columns stay."""
    scratch = Scratch(docs.sparkSession)
    members, components = set_components(docs, n, num, den, scratch)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # Every distinct row once, with how often it stands.
    rows = members.groupBy("doc_id", "text_hash", "set_id").agg(F.count("*").alias("n"))
    best = rows.join(components, "set_id").groupBy("component").agg(F.min(F.struct(row.alias("row"), "n")).alias("best"))
    survivors = best.select("best.row.doc_id", "best.row.text_hash", "best.n").union(rows.filter("set_id IS NULL").select("doc_id", "text_hash", "n"))
    survivors = materialize(survivors.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n"), "survivors")
    scratch.clear()
    packed = docs.select(F.col("doc_id").alias("key"), text_hash().alias("h"), F.struct(*docs.columns).alias("row"))
    same = F.col("key").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    once = packed.join(survivors.filter("n = 1"), same, "left_semi").select("row.*")
    repeated = packed.join(survivors.filter("n > 1"), same, "left_semi").dropDuplicates(["key", "h"]).select("row.*")
    return once.union(repeated)
