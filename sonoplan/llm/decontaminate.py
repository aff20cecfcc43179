"""Benchmark decontamination: an FM-index of each shard of training texts, searched backwards.

A task cuts its documents into shards of about SHARD_WORDS words. Of a shard it builds the Burrows-Wheeler
transform over word numbers, a wavelet tree of bit planes that answers ranks, and a sample of suffix
positions. All phrases (10 consecutive words of a benchmark item; a shorter item is one phrase) are searched
at once, last word first, two ranks a step; the rows found are located by stepping back to a sampled
position; the spans are merged to the words to remove. Words that no phrase has cannot be in an occurrence:
they cut the text, and stretches shorter than the shortest phrase are not indexed.

The benchmark is read in blocks of at most about BLOCK_ITEMS items and BLOCK_BYTES of text, one at a time, so what the driver
holds and the executors get is bounded; each block makes one pass over the documents (of removal: in each round), which adds its
spans and items to those of the blocks before, and what comes out is the same for any number of blocks. Nothing is shuffled; between
passes the documents are written to the shared folder.

Defined results: null and empty texts have no words and are clean; items with null text or no words have no
phrase; items with a null id take no part, the empty id is one like any other; items that share an id are one item; repeated
documents are each searched, with or without a key; other columns, whatever their names, stay as they are (removal) or are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash, table, text_bytes

#: Words of a phrase.
WINDOW = 10
#: Words after which a shard's index is built; bounds a worker's memory (about 100 bytes a word).
SHARD_WORDS = 1 << 19
#: Most benchmark items, and bytes of their texts, of which the phrases are sent to the executors at once (one longer item aside).
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Every so many-th suffix position is kept.
SAMPLE = 16

#: Bytes of words stay (A-Z lower-cased), all others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Phrases:
    """Word numbers from 1 on, and the phrases as rows of them, aligned to the right, with their items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.owners = [sorted(x) for x in owners.values()]
        self.length = np.array([len(p) for p in owners], np.int64)
        self.shortest = int(self.length.min()) if len(owners) else 0
        width = int(self.length.max()) if len(owners) else 0
        self.rows = np.zeros((len(owners), width), np.int64)
        for k, p in enumerate(owners):
            self.rows[k, width - len(p) :] = p


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling; only suffixes that are still tied are sorted again.

    symbols: positive, but for the separators, which are 0 and differ from each other by place."""
    n = len(symbols)
    rank = np.where(symbols > 0, symbols + n, np.cumsum(symbols == 0) - 1).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    head = np.empty(n, bool)
    head[0] = True
    key = rank[order]
    head[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    step = 1
    while True:
        last = np.append(head[1:], True)
        open_rows = np.flatnonzero(~(head & last))
        if not len(open_rows):
            return order
        at = order[open_rows]
        # A separator ends each stretch and is alone in its group, so at + step stays inside.
        group, follow = rank[at], rank[np.minimum(at + step, n - 1)]
        again = np.lexsort((follow, group))
        at, group, follow = at[again], group[again], follow[again]
        order[open_rows] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        head[open_rows] = new
        start = np.flatnonzero(new)
        rank[at] = np.repeat(open_rows[start], np.diff(np.append(start, len(at))))
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, by one plane of bits for each bit of a symbol, the highest first."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        current = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        first = np.zeros_like(end)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][first].astype(np.int64), self.ones[k][end].astype(np.int64)
            first, end = np.where(one, self.zeros[k] + a, first - a), np.where(one, self.zeros[k] + b, end - b)
        return end - first


class Index:
    """FM-index of a shard: stretches of word numbers, each ended by a separator 0."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = SAMPLE):
        n = len(symbols)
        order = suffix_order(symbols)
        self.before = symbols[order - 1]  # of the first position: the last symbol, a separator
        self.tree = WaveletTree(self.before, largest)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=largest + 1))))
        # Stepping back ends at a stretch's first position, as separators are not in the order of what follows them.
        kept = (order % sample == 0) | (self.before == 0)
        self.kept = kept
        self.place = np.cumsum(kept) - 1
        self.positions = order[kept]
        self.n = n

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Rows (phrase, suffix row) of all occurrences."""
        low, high = np.zeros(len(phrases.rows), np.int64), np.full(len(phrases.rows), self.n, np.int64)
        live = np.arange(len(phrases.rows))
        for column in range(phrases.rows.shape[1] - 1, -1, -1):
            symbol = phrases.rows[live, column]
            going = symbol > 0
            some, symbol = live[going], symbol[going]
            low[some] = self.smaller[symbol] + self.tree.rank(symbol, low[some])
            high[some] = self.smaller[symbol] + self.tree.rank(symbol, high[some])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        n_rows = high[live] - low[live]
        which = np.repeat(live, n_rows)
        return which, np.repeat(low[live] - np.cumsum(n_rows) + n_rows, n_rows) + np.arange(n_rows.sum())

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: steps back to a sampled one, plus the steps."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.kept[rows]
            out[todo[done]] = self.positions[self.place[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.before[rows]
            rows = self.smaller[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out


def occurrences(texts: list[list[int]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, phrase) of all occurrences in texts of word numbers (0: of no phrase)."""
    empty = np.zeros(0, np.int64)
    if not len(phrases.rows):
        return empty, empty, empty
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.zeros(int(lengths.sum() + len(texts)), np.int64)  # each text and a separator
    begin = np.cumsum(lengths + 1) - lengths - 1
    for b, t in zip(begin, texts, strict=True):
        flat[b : b + len(t)] = t
    edge = np.flatnonzero(flat == 0)
    run = np.diff(np.concatenate(([-1], edge))) - 1  # known words before each separator
    kept = run >= phrases.shortest
    if not kept.any():
        return empty, empty, empty
    sizes = run[kept] + 1
    source = np.repeat(edge[kept] - run[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    index = Index(flat[source], int(phrases.rows.max()))
    which, rows = index.search(phrases)
    at = source[index.locate(rows)]
    text = np.searchsorted(begin, at, side="right") - 1
    return text, at - begin[text], which


def _merged(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Spans [first, end) of words, in order, joined where they touch."""
    spans: list[list[int]] = []
    for a, b in sorted(pairs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


def _by_text(shard: list[list[int]], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], np.ndarray]]:
    """(text, its spans, the phrases that occur in it) of the texts of a shard that have an occurrence."""
    text, at, which = occurrences(shard, phrases)
    order = np.argsort(text, kind="stable")
    text, at, which = text[order], at[order], which[order]
    for k in np.unique(text):
        own = slice(*np.searchsorted(text, [k, k + 1]))
        yield int(k), list(zip(at[own].tolist(), (at[own] + phrases.length[which[own]]).tolist(), strict=True)), np.unique(which[own])


def scan(text: Column, spans: Column, names: Column, items: list[tuple[str, bytes]], shard_words: int = SHARD_WORDS) -> Column:
    """struct(n_words, spans, items) of each whole text: spans and names are those of the blocks before, to which this one's are added."""

    @F.arrow_udf("struct<n_words: long, spans: array<array<long>>, items: array<string>>")
    def of_text(column: pa.Array, earlier: pa.Array, named: pa.Array) -> pa.Array:
        phrases = _phrases(items)
        raw, starts = text_bytes(column)
        n = len(starts) - 1
        n_words = np.zeros(n, np.int64)
        found, listed = earlier.to_pylist(), named.to_pylist()
        shard, first, held = [], 0, 0
        for k in range(n):
            words = words_of(raw[starts[k] : starts[k + 1]].tobytes())
            n_words[k] = len(words)
            shard.append(list(map(phrases.number.get, words, repeat(0))))
            held += len(words) + 1
            if held >= shard_words or k == n - 1:
                for j, own, which in _by_text(shard, phrases):
                    found[first + j] = _merged([*map(tuple, found[first + j]), *own])
                    listed[first + j] = sorted({*listed[first + j], *(item for w in which for item in phrases.owners[w])})
                shard, first, held = [], k + 1, 0
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(found, pa.list_(pa.list_(pa.int64()))), pa.array(listed, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return of_text(text, spans, names)


_last: list = [None, None]


def _phrases(items: list[tuple[str, bytes]]) -> Phrases:
    """Built once in a worker for a block."""
    if _last[0] is not items and _last[0] != items:
        _last[:] = [items, Phrases(items)]
    return _last[1]


class ItemBlocks:
    """The benchmark's items in blocks of bounded size, each read when it is asked for; items of one id stay together."""

    def __init__(self, benchmark: DataFrame, block_items: int):
        self.rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
        n, size = self.rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
        self.parts = max(1, -(-n // block_items), -(-(size or 0) // BLOCK_BYTES))

    def __len__(self) -> int:
        return self.parts

    def __iter__(self) -> Iterator[list[tuple[str, bytes]]]:
        part = F.pmod(F.xxhash64("item"), F.lit(self.parts))
        for k in range(self.parts):
            yield [(r.item, r.text.encode()) for r in self.rows.where(part == k).sort("item", "text").toLocalIterator()]


def item_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> ItemBlocks:
    return ItemBlocks(benchmark, block_items)


def _found(docs: DataFrame, blocks: ItemBlocks, keep: list[str]) -> DataFrame:
    """keep (columns of docs) and s: struct(n_words, spans, items) of the whole benchmark in docs' text."""
    found = docs.select("text", *keep, F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<bigint>>").alias("spans"), F.array().cast("array<string>").alias("items")).alias("s"))
    before = None
    for k, block in enumerate(blocks):
        found = found.withColumn("s", scan(F.col("text"), F.col("s.spans"), F.col("s.items"), block))
        if k < len(blocks) - 1:
            found = stash(found, "found")
            if before is not None:
                discard(before)
            before = found
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, spans (of words, merged), items of each document."""
    return _found(docs.select(F.col(key).alias("key"), "text"), item_blocks(benchmark), ["key"]).select(F.col("key").alias(key), "s.n_words", "s.spans", "s.items")


def contamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def without_spans(raw: bytes, spans: list[list[int]]) -> bytes:
    """The text less its words in spans; what stood around a span is parted by a line break."""
    place = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], place.view(np.int8), [0]))))
    first, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : first[a]])
        at = int(end[b - 1])
    out.append(raw[at:])
    return b"\n".join(out)


def removal_udf(items: list[tuple[str, bytes]]):
    """struct(text, n_words): the text without any occurrence, also of such as removals bring together, and its words; text is null where nothing goes."""

    @F.arrow_udf("struct<text: string, n_words: long>")
    def of_text(column: pa.Array) -> pa.Array:
        phrases = _phrases(items)
        raw, starts = text_bytes(column)
        n = len(starts) - 1
        new: dict[int, bytes] = {}
        n_words = np.zeros(n, np.int64)
        todo = range(n)
        while len(todo):
            again, batch, held = [], [], 0
            for place, k in enumerate(todo):
                words = words_of(new[k] if k in new else raw[starts[k] : starts[k + 1]].tobytes())
                n_words[k] = len(words)
                batch.append((k, list(map(phrases.number.get, words, repeat(0)))))
                held += len(words) + 1
                if held >= SHARD_WORDS or place == len(todo) - 1:
                    for j, own, _ in _by_text([b for _, b in batch], phrases):
                        i = batch[j][0]
                        before = new[i] if i in new else raw[starts[i] : starts[i + 1]].tobytes()
                        new[i] = without_spans(before, _merged(own))
                        again.append(i)
                    batch, held = [], 0
            todo = again
        texts = [new[k].decode() if k in new else None for k in range(n)]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(n_words, pa.int64())], ["text", "n_words"])

    return of_text.asNondeterministic()  # so that the filter on its result does not run it a second time


def cut_udf():
    """struct(text, n_words): the text without its words in spans."""

    @F.arrow_udf("struct<text: string, n_words: long>")
    def of_text(column: pa.Array, spans: pa.Array) -> pa.Array:
        raw, starts = text_bytes(column)
        new = [without_spans(raw[starts[k] : starts[k + 1]].tobytes(), own) for k, own in enumerate(spans.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([t.decode() for t in new], pa.string()), pa.array([len(words_of(t)) for t in new], pa.int64())], ["text", "n_words"])

    return of_text.asNondeterministic()


def _put(found: DataFrame, docs: DataFrame) -> DataFrame:
    """row of found, with the text (and n_chars) of new where new has one; a document of which no word is left goes."""
    same, text = F.col("new.text").isNull(), F.col("new.text")
    kept = found.where(same | (F.col("new.n_words") > 0))
    row = lambda c: F.col("row")[c]
    changed = {"text": F.when(same, row("text")).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, row("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(changed.get(c, row(c)).alias(c) for c in docs.columns))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without benchmark passages; one that is nothing but such passages goes; clean ones stay as they are.

    Of several blocks, all blocks' spans are found on one and the same text, merged and cut at once, again until none is found: what
    comes out does not depend on how items are dealt to blocks. Each round takes words away, so the rounds end. Of one block, the
    function that searches does these rounds itself."""
    blocks = item_blocks(table(spark, sf_dir, "benchmark"))
    if len(blocks) == 1:
        return _put(docs.select(F.struct(*docs.columns).alias("row"), removal_udf(*blocks)("text").alias("new")), docs)
    clean, todo = None, docs
    while True:
        found = stash(_found(todo.select("text", F.struct(*docs.columns).alias("row")), blocks, ["row"]), "spans")
        untouched = found.where(F.size("s.spans") == 0).select("row.*")
        clean = untouched if clean is None else clean.unionByName(untouched)
        todo = stash(_put(found.where(F.size("s.spans") > 0).select("row", cut_udf()("text", "s.spans").alias("new")), docs), "cut")
        if todo.isEmpty():
            return clean
