"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document is the set of its distinct 5-word shingles (tokens). Two documents link when their intersection has
SHARE hundredths of their union at least. Then neither lacks more than n - ceil(0.8 n) of its own tokens, which
bounds how many of a prefix can be missing: the prefix holds one token more than that.

1. Summaries. One pass gives each document's number of tokens and a 128-bit digest of its set. Equal sets are one
   class, represented by the smallest doc_id; all that follows looks at representatives only.
2. Classes of tokens. Document frequencies of all tokens are counted: tasks exchange sorted runs of tokens, packed
   by ranges. Tokens of FREQUENT documents or more are frequent. Executors get them as a bitmap, whose width follows their
   number up to 2^WIDEST bits; where they fill more than a sixteenth of that, the bound doubles until they do not.
3. Prefixes. Tokens are ordered rare ones first, then by hash. If a document's rare tokens fill the prefix, each of
   them is indexed alone. If not, the prefix is extended into its frequent tokens, which are indexed by pairs: a
   pair is of one group of tokens (by hash; the number of groups follows the size), and as long as the groups
   hold the tokens that may be missing and one more each, two linked documents share a rare token or a pair.
4. Candidates. A rare token's candidates are formed where its run is sorted, neighbours in size first, PAIRS at a time, and
   stay if what they share of the prefixes allows a link. Without a shared rare token, only frequent ones can be shared.
   A pair's documents meet with one of them first; only what is not yet in one component then meets.
5. Verification. Each candidate pair's whole token sets are intersected. First every document is held against its
   likeliest candidate; after components are formed, candidates across components are verified; so within a group
   of near copies not all pairs are formed, and no link between different components is lost.

Components: large-star and small-star steps over the verified links, written to the shared folder each round.

Defined results: null, empty and blank texts have empty sets and link with nothing; rows without doc_id have a
null component and link with nothing; rows that share a doc_id are one vertex with the links of all its texts, and have one
component; other columns are never read.

jaccard_components verifies links as far as components need them. jaccard_links verifies every candidate and gives all links between
unlike sets, as pairs of class representatives with the membership; link_counts gives each document's number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITMAP, batches_of, bitmap, discard, has_bit, position_of, release, slices, stash, table, text_bytes

N = 5
SHARE = 80
#: A token of so many documents is frequent, if the bitmap allows.
FREQUENT = 32
#: Tokens or postings that a task sorts at a time; that a part of the exchange, and a task that reads parts, hold about.
RUN, PART, READ = 1 << 19, 1 << 17, 1 << 19
#: Pairs of documents that a task holds at a time, and those of one step over its postings at most.
PAIRS = 1 << 20
#: Words of 64 parity bits of a set.
PARITY = 8
#: Sizes of one band differ by this factor at most.
BAND = 1.05
#: Texts that a worker gets at a time.
BATCH = 500
#: Copies of a set, at most, for the pairs that it is in: a set with very many partners meets them in so many tasks.
SALTS = 1024
#: Frequent tokens of one group in a document of the band's least size.
GROUP = 8
#: Documents of one pair of frequent tokens that a task holds against all others of it, where all links are asked for.
SLICE = 1000

_U = np.uint64
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_LETTER = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_BASE = _U(0xD6E8FEB86659FD93)
_PLACE = _mix(np.arange(1, N + 2, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        for k, b in enumerate((_BASE, _U(inverse))):
            _powers[k] = np.concatenate((np.ones(1, _U), np.cumprod(np.full(n - 1, b, _U))))
    return _powers[0], _powers[1]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text, as sorted distinct 64-bit hashes."""
    raw, starts = text_bytes(column)
    for i, j in slices(starts, 1 << 18):
        part, at = raw[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        if not len(part):
            yield from (np.zeros(0, _U) for _ in range(j - i))
            continue
        word = ~_SPACE[part]
        before, after = np.concatenate(([False], word[:-1])), np.concatenate((word[1:], [False]))
        before[at[:-1][at[:-1] < len(part)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        first, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = _powers_to(len(part))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(_LETTER[part] * up[: len(part)])))
        words = _mix((sums[end] - sums[first]) * down[first] + (end - first).astype(_U))
        bounds = np.searchsorted(first, at)
        if len(words) >= N:
            m = len(words) - N + 1
            grams = _mix(reduce(np.add, (words[k : k + m] * _PLACE[k] for k in range(N))))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= N:
                own = np.sort(grams[a : b - N + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                yield _mix((words[a:b] * _PLACE[: b - a]).sum(dtype=_U, keepdims=True) + np.array([b - a], _U) * _PLACE[N])
            else:
                yield np.zeros(0, _U)


def summary(text: Column) -> Column:
    """struct(n, a, b): number of tokens, and two independent 64-bit sums over the set."""

    @F.arrow_udf("struct<n: long, a: long, b: long>")
    def of_text(column: pa.Array) -> pa.Array:
        n, a, b = [], [], []
        for own in shingle_sets(column):
            n.append(len(own))
            a.append(own.sum(dtype=_U))
            b.append(_mix(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *(pa.array(np.array(x, _U).view(np.int64)) for x in (a, b))], ["n", "a", "b"])

    return of_text(text)


class Wanted:
    """Texts whose doc_id is one of ids (doc_id), and a few others: told by a bitmap of fixed size, inside the function that reads them."""

    def __init__(self, docs: DataFrame, ids: DataFrame):
        bits = bitmap(ids, position_of(F.col("doc_id")))
        self.bits = docs.sparkSession.sparkContext.broadcast(np.frombuffer(bits, np.uint8))
        self.docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", position_of(F.col("doc_id")).alias("p"))

    def map(self, f: Callable[[Iterator[tuple[int, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """f of the (doc_id, set) of each task's texts."""
        shared = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def sets() -> Iterator[tuple[int, np.ndarray]]:
                for batch in batches:
                    batch = batch.filter(pa.array(has_bit(shared.value, batch.column(2).to_numpy())))
                    yield from zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True)

            return f(sets())

        return self.docs.mapInArrow(run, schema)


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: differences, byte by byte, compressed."""
    steps = np.diff(values, prepend=_U(0))
    return len(values).to_bytes(8, "little") + zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(zstandard.decompress(raw[8:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


def _cuts(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2^bits equal ranges of 64-bit numbers begins in sorted values."""
    edges = np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(0, _U)
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def _part_bits(n: int) -> int:
    return max(4, int(-(-n // PART) - 1).bit_length())


def _readers(n: int) -> int:
    return max(16, -(-n // READ))


#: Bits of a token that do not count for its class: the differences in a sorted run become short.
_DROPPED = _U(12)
#: log2 of the bits of the largest bitmap of frequent tokens (32 MB); few tokens get one of 2^BITMAP bits.
WIDEST = 28


def frequent_tokens(docs: Wanted, n_tokens: int) -> DataFrame:
    """position, n: places in the bitmap of tokens of FREQUENT documents or more, and the number of documents."""
    bits = _part_bits(n_tokens)

    def runs(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            cuts = _cuts(values, bits)
            some = np.flatnonzero(np.diff(cuts))
            packed = [_pack(values[cuts[k] : cuts[k + 1]] >> _DROPPED) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["part", "run"])

        for _, own in sets:
            held.append(own)
            n += len(own)
            if n >= RUN:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if held:
            values = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            n = np.diff(np.append(first, len(values)))
            many = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array((values[first[many]] >> (_U(64 - WIDEST) - _DROPPED)).astype(np.int64)), pa.array(n[many], pa.int64())], ["position", "n"])

    return docs.map(runs, "part int, run binary").repartition(_readers(n_tokens), "part").mapInArrow(count, "position long, n long")


def class_bitmap(frequent: DataFrame) -> bytes:
    """The bitmap of frequent tokens, as wide as leaves fifteen sixteenths of it empty; beyond the widest one, with the least bound that does."""
    sizes = {r.k: r.m for r in frequent.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}
    level, left = FREQUENT.bit_length() - 1, sum(sizes.values())
    width = min(WIDEST, max(BITMAP, (16 * left - 1).bit_length()))
    while left > 1 << (width - 4):
        left -= sizes.get(level, 0)
        level += 1
    return bitmap(frequent.where(F.col("n") >= 1 << level), F.shiftright("position", WIDEST - width), width)


def _width(bits: np.ndarray) -> int:
    """log2 of the bits of a bitmap."""
    return (8 * len(bits)).bit_length() - 1


def _bands(n: int) -> set[int]:
    return {n.bit_length(), (n * 100 // SHARE).bit_length()}


def prefix(own: np.ndarray, is_frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a set is indexed by: rare tokens alone, and numbers of pairs of frequent ones."""
    n = len(own)
    need = n - -(-SHARE * n // 100) + 1
    rare = own[~is_frequent][:need]
    if len(rare) == need:
        return rare, np.zeros(0, _U)
    rest, need = own[is_frequent], need - len(rare)
    out = []
    for band in _bands(n):
        groups = max(1, (1 << (band - 1)) // GROUP)
        group = (_mix(rest) % _U(groups)).astype(np.int64)
        # The prefix ends where the groups hold the tokens that may be missing, and one more each.
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=groups)
        place = np.empty(len(rest), np.int64)
        place[order] = np.arange(len(rest)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = int(np.searchsorted(np.cumsum(place > 0), need)) + 1
        order = order[order < stop]
        token, key, place = rest[order], group[order], place[order]
        for back in range(1, int(place.max(initial=0)) + 1):
            later = np.flatnonzero(place >= back)
            a, b = token[later - back], token[later]
            out.append(_mix(_mix(a + _U(band)) * _PLACE[1] + _mix(b) * _PLACE[2] + key[later].astype(_U)))
    return rare, np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def parities(own: np.ndarray) -> list[int]:
    """A bit for each of 64 PARITY ranges of tokens: whether their number is odd. Sets differ by as many tokens as bits at least."""
    odd = np.bincount((own & _U(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def index(docs: Wanted, classes: bytes, n_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Runs of rare postings by part, and rows (sig, doc, n, nf: of them frequent, q: parities) of pairs of frequent tokens; of sets that can have a link to another set."""
    bits = _part_bits(n_tokens // N)
    shared = docs.docs.sparkSession.sparkContext.broadcast(np.frombuffer(classes, np.uint8))

    def postings(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        tokens, ids, sizes, n = [], [], [], 0

        def rows(part, run, sig, doc, size, common, parity) -> pa.RecordBatch:
            kinds = pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((part, run, sig, doc, size, common, parity), kinds, strict=True)], ["part", "run", "sig", "doc", "n", "nf", "q"])

        def flush() -> pa.RecordBatch:
            values = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(t) for t in tokens])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            cuts = _cuts(values, bits)
            some, packed = np.flatnonzero(np.diff(cuts)), []
            for k in some:
                here = slice(cuts[k], cuts[k + 1])
                used, local = np.unique(owner[here], return_inverse=True)
                head = np.array(ids, np.int64)[used].tobytes() + np.array(sizes, np.int64)[used].tobytes()
                body = _pack(values[here])
                local = zstandard.compress(np.ascontiguousarray(local.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
                packed.append(b"".join(x for y in (head, body, local) for x in (len(y).to_bytes(8, "little"), y)))
            none = [None] * len(some)
            return rows(some, packed, none, none, none, none, none)

        for doc, own in sets:
            if len(own) < 4:  # of sets this small, only equal ones reach the share
                continue
            rare, pairs = prefix(own, has_bit(frequent, (own >> _U(64 - _width(frequent))).astype(np.int64)))
            if len(rare):
                tokens.append(rare)
                ids.append(doc)
                sizes.append(len(own) << 32 | len(rare))
                n += len(rare)
            if len(pairs):
                m = len(pairs)
                yield rows([None] * m, [None] * m, pairs.view(np.int64), [doc] * m, [len(own)] * m, [len(own) - len(rare)] * m, [parities(own)] * m)
            if n >= RUN:
                yield flush()
                tokens, ids, sizes, n = [], [], [], 0
        if n:
            yield flush()

    out = stash(docs.map(postings, "part int, run binary, sig long, doc long, n long, nf long, q array<long>"), "postings")
    return out.where("part is not null").select("part", "run"), out.where("part is null").select("sig", "doc", "n", "nf", "q")


def rare_candidates(runs: DataFrame, n_postings: int) -> DataFrame:
    """a < b, sa, sb, c: documents that share c rare tokens of their prefixes (as one task saw it), of sizes that can link.

    sa and sb are the sizes, shifted left by 32, and the rare tokens in the prefixes."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, docs, sizes = [], [], []
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                fields, at = [], 0
                while at < len(raw):
                    size = int.from_bytes(raw[at : at + 8], "little")
                    fields.append(raw[at + 8 : at + 8 + size])
                    at += 8 + size
                ids, n = np.frombuffer(fields[0], np.int64).reshape(2, -1)
                own = _unpack(fields[1])
                local = np.ascontiguousarray(np.frombuffer(zstandard.decompress(fields[2]), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                tokens.append(own)
                docs.append(ids[local])
                sizes.append(n[local])
        if not tokens:
            return
        token, doc, size = map(np.concatenate, (tokens, docs, sizes))
        tokens, docs, sizes = [], [], []
        n = size >> 32
        order = np.lexsort((doc, n, token))
        token, doc, size, n = token[order], doc[order], size[order], n[order]

        def counted() -> Iterator[pa.RecordBatch]:
            a, b = np.concatenate(left), np.concatenate(right)
            a, b = np.where(doc[a] < doc[b], a, b), np.where(doc[a] < doc[b], b, a)
            columns = doc[a], doc[b], size[a], size[b]
            order = np.lexsort(columns[::-1])
            columns = [x[order] for x in columns]
            head = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in columns], axis=0))))
            c = np.diff(np.append(head, len(order)))
            for k in range(0, len(head), 1 << 14):
                here = head[k : k + (1 << 14)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[here]) for x in columns), pa.array(c[k : k + (1 << 14)], pa.int64())], ["a", "b", "sa", "sb", "c"])

        # Each posting meets the next one of its token, then the one after that; sizes ascend, so after one that is too large all are.
        left, right, held, step = [], [], 0, 0
        alive = np.arange(len(token))
        while len(alive):
            step += 1
            alive = alive[: np.searchsorted(alive, len(token) - step)]
            other = alive + step
            alive = alive[(token[other] == token[alive]) & (100 * n[alive] >= SHARE * n[other])]
            unlike = alive[doc[alive] != doc[alive + step]]
            if len(unlike):
                left.append(unlike)
                right.append(unlike + step)
                held += len(unlike)
            if held >= PAIRS:
                yield from counted()
                left, right, held = [], [], 0
        if held:
            yield from counted()

    return runs.repartition(_readers(n_postings), "part").mapInArrow(meet, "a long, b long, sa long, sb long, c long")


def _overlap(a: Column, b: Column) -> Column:
    """Tokens that sets of these sizes share at least if they link."""
    return F.ceil(F.lit(SHARE) * (a + b) / F.lit(100 + SHARE))


def _near(n: str, m: str, nf: str, mf: str, q: str, r: str) -> Column:
    """Whether sets without a common rare token may link: by their frequent tokens, and by the tokens that they differ in at least."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(q)[k].bitwiseXOR(F.col(r)[k])) for k in range(PARITY)))
    overlap = _overlap(F.col(n), F.col(m))
    return (F.least(nf, mf) >= overlap) & (F.col(n) + F.col(m) - apart >= 2 * overlap)


def may_link(candidates: DataFrame) -> DataFrame:
    """a, b, c of the rare candidates (a, b, sa, sb, c) that share enough of their prefixes.

    Up to where the first of both prefixes ends, all that is shared is counted in c. After it, a side whose prefix is all rare
    has one token less than the share of its own size; if both have frequent tokens in theirs, only frequent ones are left."""
    whole = candidates.groupBy("a", "b", "sa", "sb").agg(F.sum("c").alias("c"))
    na, nb, ra, rb = F.shiftright("sa", 32), F.shiftright("sb", 32), F.col("sa").bitwiseAND(0xFFFFFFFF), F.col("sb").bitwiseAND(0xFFFFFFFF)
    least = lambda n: F.ceil(F.lit(SHARE) * n / F.lit(100))
    mixed = lambda n, r: r < n - least(n) + 1
    after = (
        F.when(mixed(na, ra) & mixed(nb, rb), F.least(na - ra, nb - rb)).when(mixed(na, ra), least(nb) - 1).when(mixed(nb, rb), least(na) - 1).otherwise(least(F.greatest(na, nb)) - 1)
    )
    return whole.where(F.col("c") + after >= _overlap(na, nb)).select("a", "b", "c")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))

    def rows(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, held)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(docs_held, pa.int64()), lists], ["id", "s"])

        docs_held, held, n = [], [], 0
        for doc, own in sets:
            docs_held.append(doc)
            held.append(own)
            n += len(own)
            if n >= RUN // 4:
                yield batch()
                docs_held, held, n = [], [], 0
        if held:
            yield batch()

    sets = stash(Wanted(docs, ids).map(rows, "id long, s array<long>"), "sets")

    def with_set(rows: DataFrame, side: str, other: str, name: str) -> DataFrame:
        salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
        wanted = pairs.select(F.col(side).alias("w"), salt.alias("t")).distinct()
        own = sets.join(wanted, F.col("id") == F.col("w")).select(F.col("id").alias(f"i{name}"), F.col("t").alias(f"t{name}"), F.col("s").alias(f"s{name}"))
        return rows.join(own, (F.col(side) == F.col(f"i{name}")) & (salt == F.col(f"t{name}"))).drop(f"i{name}", f"t{name}")

    whole = with_set(with_set(pairs, "b", "a", "b"), "a", "b", "a")
    same = F.size(F.array_intersect("sa", "sb"))
    linked = whole.select("a", "b", same.alias("same"), (F.size("sa") + F.size("sb")).alias("both")).where(F.lit(100) * F.col("same") >= F.lit(SHARE) * (F.col("both") - F.col("same")))
    out = stash(linked.select("a", "b").distinct(), "links")
    discard(sets)
    release(docs.sparkSession)
    return out


def components(links: DataFrame) -> DataFrame:
    """id, component: each vertex of links (a, b) with the smallest vertex that it reaches."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = stash(edges, "edges"), None
    while True:
        # Large star: a vertex's larger neighbours go to the smallest it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a vertex and its smaller neighbours go to the smallest of them.
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        after = stash(small.where("u <> v").distinct(), "edges")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(edges)
        edges = after
        if state == before:
            release(spark)
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    with batches_of(spark, BATCH):
        return _components_of(docs.select("doc_id", "text"))


def _summaries(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """n, a, b of every doc_id's text; and of every class of equal sets, with the first doc_id."""
    own = stash(docs.select("doc_id", summary(F.col("text")).alias("s")).select("doc_id", "s.n", "s.a", "s.b"), "summaries")
    classes = own.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("first"))
    return own, stash(classes, "classes")


def _indexed(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The index of the classes' first documents: runs of rare postings, pairs of frequent tokens; and the number of tokens."""
    n_tokens = classes.agg(F.sum("n")).first()[0] or 0
    firsts = Wanted(docs, classes.where("n > 3").select(F.col("first").alias("doc_id")))
    frequent = stash(frequent_tokens(firsts, n_tokens), "frequent")
    classes_of_tokens = class_bitmap(frequent)
    release(docs.sparkSession)
    return *index(firsts, classes_of_tokens, n_tokens), n_tokens


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a < b: the first doc_ids of all pairs of unlike sets that link; and doc_id, n_shingles, representative of every row of docs.

    A row links with the rows of its own representative, and with those of the representatives that its own one links with. Rows without
    doc_id, and those with empty sets, have no representative. A doc_id with several texts has a row and a representative for each; as a
    representative itself it has the links of all its texts. The time is in proportion to the pairs whose prefixes meet: among near copies
    that are all unlike, the square of their number, as are the links."""
    with batches_of(docs.sparkSession, BATCH):
        docs = docs.select("doc_id", "text")
        own, classes = _summaries(docs)
        runs, paired, n_tokens = _indexed(docs, classes)
        # All documents of a pair of frequent tokens meet; those of a hot pair in many tasks, a slice of them against all.
        slices_of = paired.groupBy(F.col("sig").alias("sig2")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SLICE))).alias("k"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        met = paired.join(slices_of, F.col("sig") == F.col("sig2")).drop("sig2")
        one = met.withColumn("t", F.pmod(F.xxhash64("doc"), F.col("k")))
        other = met.select(*(F.col(c).alias(f"{c}2") for c in ("sig", "doc", "n", "nf", "q")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("t2"))
        common = one.join(other, (F.col("sig") == F.col("sig2")) & (F.col("t") == F.col("t2")) & (F.col("doc") < F.col("doc2")) & _near("n", "n2", "nf", "nf2", "q", "q2"))
        pairs = may_link(rare_candidates(runs, n_tokens // N)).select("a", "b").unionByName(common.select(F.col("doc").alias("a"), F.col("doc2").alias("b")))
        links = verified(stash(pairs.distinct(), "candidates"), docs)
        of_class = classes.select(F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("first").alias("representative"))
        members = own.join(of_class, (F.col("n") == F.col("n2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & F.col("doc_id").isNotNull(), "left")
        return links, members.select("doc_id", F.col("n").alias("n_shingles"), "representative")


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, n_shingles, representative, n_links of every row of members: the other rows whose sets equal or link with its own."""
    sizes = stash(members.where("representative is not null").groupBy(F.col("representative").alias("r")).agg(F.count(F.lit(1)).alias("m")), "sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    unlike = both.join(sizes, F.col("b") == F.col("r")).groupBy("a").agg(F.sum("m").alias("u"))
    counts = sizes.join(unlike, F.col("r") == F.col("a"), "left").select("r", (F.col("m") - 1 + F.coalesce("u", F.lit(0))).alias("n_links"))
    return members.join(counts, F.col("representative") == F.col("r"), "left").select("doc_id", "n_shingles", "representative", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _components_of(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    own, classes = _summaries(docs)
    # A doc_id with several texts is one vertex: it ties the classes of them.
    several = own.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "a", "b")).alias("x"), F.max(F.struct("n", "a", "b")).alias("y")).where("x <> y").select(F.col("doc_id").alias("vertex"))
    of_class = classes.select(F.col("n").alias("n3"), F.col("a").alias("a3"), F.col("b").alias("b3"), "first")
    tied = own.join(several, F.col("doc_id") == F.col("vertex")).join(of_class, (F.col("n") == F.col("n3")) & (F.col("a") == F.col("a3")) & (F.col("b") == F.col("b3")))
    tied = stash(tied.select(F.least("doc_id", "first").alias("a"), F.greatest("doc_id", "first").alias("b"), "vertex").distinct(), "tied")
    ties = tied.where("a <> b").select("a", "b")
    runs, paired, n_tokens = _indexed(docs, classes)

    # Candidates: of rare tokens, all; of pairs of frequent tokens, each document with the pair's smallest.
    # Of a pair's documents of about one size, the first is the one that lacks least of what is frequent: of a group of near
    # copies, the one most like all. Documents meet the first of their own size and of the next larger one.
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    first = F.min(F.struct((F.col("n") - F.col("nf")).alias("lack"), F.col("doc"), F.col("n"), F.col("nf"), F.col("q")))
    head = paired.groupBy(F.col("sig").alias("sig2"), size.alias("size")).agg(first.alias("h")).select("sig2", "h", F.explode(F.array("size", F.col("size") - 1)).alias("size2"))
    starred = paired.join(head, (F.col("sig") == F.col("sig2")) & (size == F.col("size2")) & (F.col("doc") != F.col("h.doc")) & _near("n", "h.n", "nf", "h.nf", "q", "h.q"))
    starred = starred.select(F.least("doc", "h.doc").alias("a"), F.greatest("doc", "h.doc").alias("b"))
    candidates = stash(may_link(rare_candidates(runs, n_tokens // N)).unionByName(starred.withColumn("c", F.lit(1).cast("long"))).groupBy("a", "b").agg(F.sum("c").alias("c")), "candidates")
    release(spark)
    both = candidates.unionByName(candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    likeliest = both.groupBy("b").agg(F.max_by("a", F.struct(F.col("c"), -F.col("a"))).alias("a"))
    likeliest = stash(likeliest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "likeliest")
    links = verified(likeliest, docs).unionByName(ties)
    joined = stash(components(links), "components")

    # What is left: candidates across components; of pairs of frequent tokens, also documents that are not their smallest.
    label = lambda df, c: df.join(joined.select(F.col("id").alias(f"i{c}"), F.col("component").alias(f"p{c}")), F.col(c) == F.col(f"i{c}"), "left").withColumn(f"k{c}", F.coalesce(f"p{c}", c)).drop(f"i{c}", f"p{c}")
    left = label(label(candidates, "a"), "b").where("ka <> kb").select("a", "b")
    split = label(paired, "doc")
    mixed = split.groupBy(F.col("sig").alias("sig2")).agg(F.min("kdoc").alias("lo"), F.max("kdoc").alias("hi")).where("lo <> hi").select("sig2")
    split = stash(split.join(mixed, F.col("sig") == F.col("sig2")).select("sig", "doc", "n", "nf", "q", "kdoc"), "split")
    other = split.select(F.col("sig").alias("sig3"), F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("nf").alias("nf2"), F.col("q").alias("q2"), F.col("kdoc").alias("kdoc2"))
    # Documents that share a rare token are among the candidates; others share frequent tokens only.
    across = split.join(other, (F.col("sig") == F.col("sig3")) & (F.col("kdoc") < F.col("kdoc2")) & _near("n", "n2", "nf", "nf2", "q", "q2")).select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b"))
    rest = left.unionByName(across).distinct().join(likeliest.select(F.col("a").alias("a2"), F.col("b").alias("b2")), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left_anti")
    rest = stash(rest, "rest")
    if not rest.isEmpty():
        more = verified(rest, docs)
        joined = stash(components(links.unionByName(more)), "components")
    # A class's component is its first document's; a document without links is its class's first.
    named = classes.join(joined, F.col("first") == F.col("id"), "left").select(F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.coalesce("component", "first").alias("component"))
    out = own.join(named, (F.col("n") == F.col("n2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & F.col("doc_id").isNotNull(), "left")
    of_vertex = tied.select("vertex").distinct().join(joined.select(F.col("id").alias("i4"), F.col("component").alias("c4")), F.col("vertex") == F.col("i4")).select("vertex", "c4")
    out = out.join(of_vertex, F.col("doc_id") == F.col("vertex"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c4", "component", "doc_id").alias("component_id"))


def join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest doc_id; rows without doc_id stay.

    Where doc_ids repeat, rows are the vertices: of each component of rows that with the smallest doc_id stays, then that with the
    smallest digest of its text, so unlike texts of one doc_id stay both."""
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        return _first_of_each(docs, "doc_id")
    whole = stash(docs.select(F.struct(*docs.columns).alias("row")), "rows")
    whole = stash(whole.select("row", F.monotonically_increasing_id().alias("place")), "rows")
    known = whole.where("row.doc_id is not null")
    found = stash(jaccard_components(known.select(F.col("place").alias("doc_id"), "row.text")), "components")
    keys = known.select("place", F.struct("row.doc_id", F.sha2(F.col("row.text").cast("binary"), 256).alias("text"), F.xxhash64("row").alias("all"), "place").alias("key"))
    first = found.join(keys, F.col("doc_id") == F.col("place")).groupBy("component_id").agg(F.min("key").alias("key")).select(F.col("key.place").alias("first"))
    kept = whole.join(first, F.col("place") == F.col("first"), "left_semi").unionByName(whole.where("row.doc_id is null"))
    return kept.select("row.*")


def _first_of_each(docs: DataFrame, key: str) -> DataFrame:
    """Rows whose key is their component's, or null.

    A bitmap of fixed size says which documents may be among those that go; only these meet the list of them, so most texts
    are not shuffled."""
    spark = docs.sparkSession
    found = stash(jaccard_components(docs.select(F.col(key).alias("doc_id"), "text")), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    bits = spark.sparkContext.broadcast(np.frombuffer(bitmap(gone, position_of(F.col("gone"))), np.uint8))

    @F.arrow_udf("boolean")
    def among(position: pa.Array) -> pa.Array:
        return pa.array(has_bit(bits.value, position.to_numpy(zero_copy_only=False)))

    marked = docs.select(F.struct(*docs.columns).alias("row"), among(position_of(F.col(key))).alias("may"))
    own = F.col("row")[key]
    stays = marked.where(~F.col("may") | own.isNull())
    judged = marked.where(F.col("may") & own.isNotNull()).join(gone, own == F.col("gone"), "left_anti")
    return stays.unionByName(judged).select("row.*")
