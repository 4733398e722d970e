"""Exact token count at every prefix of a text, by dynamic programming over the last token.

In byte-level BPE a sequence of tokens is the encoding of its text exactly if every neighbouring
pair is the encoding of its own text. So each prefix of a piece has one last token ``t`` whose pair
with the last token before it is such, and ``count(prefix) = count(prefix without t) + 1``. Prefixes
that pieces share are computed once per worker; no prefix is encoded.

``prefix_counts`` keeps, per character, by how much the count changes (packed little-endian 16-bit
integers). Running sums answer any question about truncation or budgets later.

Defined cases: null text counts as empty; special strings in a text are single tokens, as the
library treats them by default, and their unfinished prefixes are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
from itertools import accumulate
from operator import sub
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.bpe import PATTERN, to_characters
from barloom.llm.common import in_slices, per_worker, small_batches, text_of

#: Pieces, pairs of tokens and prefixes that a worker remembers; beyond that it starts anew.
REMEMBERED = 500_000
PREFIXES = 800_000
#: Pieces up to this many bytes share prefixes with others.
SHARED = 48
#: Contractions whose middle prefix the split pattern cuts in two (fixed values).
CONTRACTIONS = ("'re", "'ve", "'ll")


class Counter:
    """Prefix counts by one model; lives in a Python worker."""

    def __init__(self, model: str):
        spec = json.loads(model)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        lengths: dict[str, set[int]] = {}
        for t in self.vocab:
            if len(t) > 2:
                lengths.setdefault(t[-3:], {1, 2}).add(len(t))
        #: Lengths of the tokens with these last three characters, longest first.
        self.lengths = {e: tuple(sorted(s, reverse=True)) for e, s in lengths.items()}
        self.rank: dict[int, int] = {}  # when the merge that makes a token is applied
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if made in self.parts:
                raise ValueError("a token with two merges is not handled")
            self.rank[made], self.parts[made], self.merged[a, b] = r, (a, b), r
        self.blank_byte = to_characters(b" ")
        self.split = regex.compile(PATTERN)
        self.blank = regex.compile(r"\s\s")
        self.space = regex.compile(r"\s+")
        added = spec.get("added_tokens") or []
        for a in added:
            if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]:
                raise ValueError(f"added token {a['content']!r} has options that are not handled")
        words = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, words))) if words else None
        self.fits: dict[int, bool] = {}
        self.prefixes: dict[str, tuple[int, int]] = {}
        self.known: dict[str, bytes] = {}

    def pair(self, a: int, b: int) -> bool:
        """Do two tokens stay as they are when their text is encoded?

        Undo the merges of both, latest first: the parts that touch at a moment must have no merge
        that comes before those which use them up.
        """
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            found = self.fits[key] = self._stays(a, b)
        return found

    def _stays(self, a: int, b: int) -> bool:
        rank, parts, merged = self.rank.get, self.parts, self.merged.get
        never = len(self.merged)
        uses_a = uses_b = never  # rank of the merge that uses up the part at either side
        while True:
            joined = merged((a, b), never)
            # Of equal merges the leftmost is applied first.
            if joined < uses_a and joined <= uses_b and joined < never:
                return False
            left, right = rank(a, -1), rank(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                uses_a, a = left, parts[a][1]
            else:
                uses_b, b = right, parts[b][0]

    def byte_counts(self, text: str) -> list[int]:
        """Counts after each byte of a piece, given in characters that stand for bytes."""
        share = len(text) <= SHARED
        if len(self.prefixes) > PREFIXES:
            self.prefixes = {}
        prefixes = self.prefixes
        vocab, lengths, fits = self.vocab.get, self.lengths.get, self.fits.get
        row = [(0, -1)]
        for end in range(1, len(text) + 1):
            found = prefixes.get(text[:end]) if share else None
            if found is None:
                for size in lengths(text[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    if size > end:
                        continue
                    token = vocab(text[end - size : end])
                    if token is None:
                        continue
                    if size == end:
                        found = (1, token)
                        break
                    count, before = row[end - size]
                    fit = fits((before, token))
                    if self.pair(before, token) if fit is None else fit:
                        found = (count + 1, token)
                        break
                if found is None:
                    raise ValueError("the vocabulary lacks a byte")
                if share:
                    prefixes[text[:end]] = found
            row.append(found)
        return [c for c, _ in row[1:]]

    def counts(self, piece: str) -> list[int]:
        """Counts after each character of a piece."""
        if piece.isascii() and piece.isprintable():  # of these bytes only the space is renamed
            by_byte = self.byte_counts(piece.replace(" ", self.blank_byte))
        else:
            by_byte = self.byte_counts(to_characters(piece.encode()))
            if not piece.isascii():
                widths = [1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in piece]
                by_byte = [by_byte[e - 1] for e in accumulate(widths)]
        if piece in CONTRACTIONS:
            by_byte[1] = by_byte[0] + self.counts(piece[1])[0]
        return by_byte

    def steps(self, pieces: list[str]) -> list[bytes]:
        """Changes of the count along each piece, packed."""
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set(pieces)
        for piece in new:
            c = self.counts(piece)
            self.known[piece] = pack("<%dh" % len(c), *map(sub, c, [0, *c]))
        return list(map(self.known.__getitem__, pieces))

    def plain(self, text: str) -> bytes:
        """Steps of a text without special strings."""
        pieces = self.split.findall(text)
        parts = self.steps(pieces)
        if not self.blank.search(text):
            return b"".join(parts)
        # While a run of white space is the end of the prefix it is one piece; the next character
        # cuts its last one off.
        for i in range(len(pieces) - 1):
            a, b = pieces[i], pieces[i + 1]
            if self.space.fullmatch(a) and self.space.match(b[0]):
                run, alone = self.counts(a + b[0])[-1], self.counts(a)[-1]
                step = np.frombuffer(parts[i + 1], dtype="<i2").astype(np.int64)
                first = run - alone
                if len(step) > 1:
                    step[1] += step[0] - first
                elif i + 2 < len(pieces):
                    nxt = np.frombuffer(parts[i + 2], dtype="<i2").astype(np.int64)
                    nxt[0] += step[0] - first
                    parts[i + 2] = nxt.astype("<i2").tobytes()
                step[0] = first
                parts[i + 1] = step.astype("<i2").tobytes()
        return b"".join(parts)

    def text(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at, n = [], 0, 0
        for m in self.special.finditer(text):
            before = np.frombuffer(self.plain(text[at : m.start()]), dtype="<i2")
            whole = np.frombuffer(self.plain(text[at : m.end() - 1]), dtype="<i2").copy()
            if at and len(whole):
                whole[0] -= n  # what the unfinished special string counted is taken back
            n = 0
            total = int(np.sum(before, dtype=np.int64))
            partial = int(np.sum(np.frombuffer(self.plain(text[at : m.end() - 1]), dtype="<i2"), dtype=np.int64))
            out += [whole.tobytes(), np.array([total + 1 - partial], dtype="<i2").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


def prefix_counts(
    df: DataFrame, path: str, text: str = "text", into: str = "prefix"
) -> DataFrame:
    """Add a struct column ``into``: ``steps`` (change of the token count at each character,
    packed) and ``n`` (tokens of the whole text). The model file is broadcast. Other columns stay."""
    small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read().encode())
    ident = hashlib.sha256(shared.value).hexdigest()

    def run(texts: pa.Array) -> pa.Array:
        counter = per_worker(("prefix", ident), lambda: Counter(shared.value.decode()))
        steps = [counter.text(t) for t in texts.to_pylist()]
        n = [int(np.frombuffer(s, dtype="<i2").sum(dtype=np.int64)) for s in steps]
        return pa.StructArray.from_arrays(
            [pa.array(steps, pa.binary()), pa.array(n, pa.int64())], names=["steps", "n"]
        )

    return df.withColumn(
        into, F.arrow_udf(in_slices(run), "struct<steps: binary, n: bigint>")(text_of(text))
    )


def tokens_at(steps: Column, characters: Column) -> Column:
    """Token count of the first ``characters`` characters (of all, where there are fewer)."""

    def run(packed: pa.Array, ends: pa.Array) -> pa.Array:
        out = [
            None if p is None or e is None
            else int(np.frombuffer(p, dtype="<i2")[: max(e, 0)].sum(dtype=np.int64))
            for p, e in zip(packed.to_pylist(), ends.to_pylist())
        ]
        return pa.array(out, pa.int64())

    return F.arrow_udf(in_slices(run), "bigint")(steps, characters.cast("bigint"))


def longest_within(steps: Column, budget: Column) -> Column:
    """Characters of the longest prefix that takes at most ``budget`` tokens."""

    def run(packed: pa.Array, most: pa.Array) -> pa.Array:
        out = []
        for p, b in zip(packed.to_pylist(), most.to_pylist()):
            if p is None or b is None:
                out.append(None)
                continue
            counts = np.cumsum(np.frombuffer(p, dtype="<i2"), dtype=np.int64)
            fit = np.flatnonzero(counts <= b)
            out.append(int(fit[-1]) + 1 if len(fit) else 0)
        return pa.array(out, pa.int64())

    return F.arrow_udf(in_slices(run), "bigint")(steps, budget.cast("bigint"))
