"""Token counts by prefix dynamic programming.

A byte-level BPE vocabulary with its merge ranks determines, for every prefix of a piece (what the
pre-tokenizer's pattern cuts out), the last token of that prefix's encoding: it is the one token t, ending
there, that stays apart from the last token of the prefix before it. So one pass over a piece's bytes gives
the exact number of tokens at every prefix, and a text's table is the running sum over its pieces. From the
table come the whole count, the count of any prefix (``count_at``) and the longest prefix within a budget
(``longest_within``) without encoding anything again.

Defined results: null and empty texts have 0 tokens; the special string counts as the vocabulary file says
(one token wherever it stands); prefixes end between code points; a piece costs time in
proportion to its length, and its total alone no memory beyond a block; what a worker keeps is bounded in number and length; rows that repeat are counted each; other columns are never read.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A document of more tokens than this is over the limit.
LIMIT = 1024
#: Pieces whose counts a worker keeps, and their code points at most; the store is emptied when it is full.
KEPT, KEPT_CHARS = 800_000, 64
#: Pairs of tokens that a worker keeps.
KEPT_PAIRS = 1_600_000
#: Bytes of a piece that are counted at a time where only its total is asked for.
BLOCK = 1 << 16
#: Fixed value: the pattern by which this family of vocabularies cuts texts into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself, or the next free one from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = {}, 256
    for b in range(256):
        if b in kept:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


class PrefixCounter:
    """Exact token counts at every prefix for one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {t: t for t in (*(a + b for a, b in self.rank), *(bytes([b]) for b in range(256)))}
        self.longest = max(map(len, self.tokens))
        special = [t["content"] for t in spec["added_tokens"]]
        self.marks = frozenset(special)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.runs = regex.compile(r"\p{White_Space}{2,}")
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.totals = Totals(self)
        self.totals.update(dict.fromkeys(self.marks, 1))

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain merging in rank order; used on single tokens and pairs of them only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: bytes, right: bytes) -> bool:
        """Merging the bytes of both gives both again; with nothing on the left: merging the right one's bytes gives it."""
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) >= KEPT_PAIRS:
                self.apart.clear()
            found = self.apart[left, right] = self.encode(left + right) == ([left, right] if left else [right])
        return found

    def _grow(self, piece: bytes, last: list[bytes], counts: list[int], begun: int) -> int:
        """Go on from the prefixes that last and counts know to the piece's end; where the last token begins, before and after."""
        tokens, apart = self.tokens, self.apart
        for end in range(len(last), len(piece) + 1):
            # Exactly one start fits; the last token grown by a byte comes first, as it fits most often.
            t = tokens.get(piece[begun:end])
            if t is None or not (self.stays_apart(last[begun], t) if (fits := apart.get((last[begun], t))) is None else fits):
                for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                    t = tokens.get(piece[start:end])
                    if t is not None and (self.stays_apart(last[start], t) if (fits := apart.get((last[start], t))) is None else fits):
                        begun = start
                        break
            last.append(t)
            counts.append(counts[begun] + 1)
        return begun

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for each i from 1 on."""
        last, counts = [b""], [0]
        self._grow(piece, last, counts, 0)
        return counts[1:]

    def piece_total(self, piece: bytes) -> int:
        """Tokens of the whole piece; of a long one, only the prefixes within a token's length are held."""
        last, counts, begun, at = [b""], [0], 0, 0
        for stop in range(BLOCK, len(piece) + BLOCK, BLOCK):
            begun = self._grow(piece[at:stop], last, counts, begun)
            known = max(0, len(last) - 1 - self.longest)
            del last[:known], counts[:known]
            at, begun = at + known, begun - known
        return counts[-1]

    def heads(self, piece: str) -> np.ndarray:
        """Tokens of piece[:k] for each k from 1 on, in code points."""
        raw = piece.encode()
        counts = self.piece_counts(raw)
        out = [c for i, c in enumerate(counts, 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        if piece[0] == "'":  # what is cut from a contraction is a mark and letters
            out = [out[k - 1] if len(cut := self.pattern.findall(piece[:k])) == 1 else sum(self.piece_counts(x.encode())[-1] for x in cut) for k in range(1, len(piece) + 1)]
        return np.array(out, np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pattern.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def table(self, text: str | None) -> np.ndarray:
        """Tokens of text[:i] for each i from 0 to the length."""
        text = text or ""
        out = np.zeros(len(text) + 1, np.int64)
        at = base = 0
        before = ""
        for piece in self.pieces(text):
            if piece in self.marks:  # a cut special string is ordinary text, which goes on from the piece before it
                start = base - (self.totals[before] if before else 0)
                out[at + 1 : at + len(piece)] = [start + self.ordinary(before + piece[:k]) for k in range(1, len(piece))]
                out[at + len(piece)] = base + 1
                before = ""
            else:
                out[at + 1 : at + len(piece) + 1] = base + self.heads(piece)
                before = piece
            base += self.totals[piece]
            at += len(piece)
        for m in self.runs.finditer(text):  # at the end of a prefix, a run of spaces is one piece
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + self.heads(m.group())
        return out

    def ordinary(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.pattern.findall(text)))

    def summary(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and the code points of its longest prefix of at most budget tokens."""
        text = text or ""
        pieces = self.pieces(text)
        totals = list(map(self.totals.__getitem__, pieces))
        n = sum(totals)
        if n <= budget:
            return n, len(text)
        ends = list(accumulate(totals))
        stop = min(len(pieces), bisect_right(ends, budget + 2) + 2)
        first = max(0, bisect_right(ends, budget - 8))
        while first and (pieces[first][0].isspace() or pieces[first - 1] in self.marks or pieces[first] in self.marks):
            first -= 1
        start, base = sum(map(len, pieces[:first])), ends[first - 1] if first else 0
        part = text[start : start + sum(map(len, pieces[first:stop]))]
        return n, start + longest_within(self.table(part) + base, budget)


class Totals(dict):
    """Tokens of whole pieces, filled from the last entry of each piece's prefix counts; emptied when full. Long pieces are not kept."""

    def __init__(self, of: PrefixCounter):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str) -> int:
        if len(piece) > KEPT_CHARS:
            return self.of.piece_total(piece.encode())
        if len(self) >= KEPT:
            self.clear()
            self.update(dict.fromkeys(self.of.marks, 1))
        found = self[piece] = self.of.piece_total(piece.encode())
        return found


def count_at(prefix_table: np.ndarray, n_chars: int) -> int:
    return int(prefix_table[min(max(n_chars, 0), len(prefix_table) - 1)])


def longest_within(prefix_table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens."""
    fits = np.flatnonzero(prefix_table <= budget)
    return int(fits[-1]) if len(fits) else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One for each worker process and vocabulary file."""
    return PrefixCounter(path)


def token_summary(text: Column, path: str, budget: int = LIMIT) -> Column:
    """struct(n_tokens, cut_chars) of each whole text, for the vocabulary file at path (there on every executor)."""

    @F.arrow_udf("struct<n_tokens: long, cut_chars: long>")
    def of_text(column: pa.Array) -> pa.Array:
        own = counter(path)
        found = [own.summary(t, budget) for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["n_tokens", "cut_chars"])

    return of_text(text)


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and prefix_tokens: the exact token count at every prefix of the text, in code points, from 0 on."""

    @F.arrow_udf("array<int>")
    def of_text(column: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([own.table(t) for t in column.to_pylist()], pa.list_(pa.int32()))

    return docs.select("doc_id", of_text("text").alias("prefix_tokens"))


def tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; cut_chars is where a text of LIMIT tokens at most ends."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_summary(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("t"))
    return out.select("doc_id", "n_bytes", "t.n_tokens", (F.col("t.n_tokens") > LIMIT).alias("over_limit"), "t.cut_chars")
