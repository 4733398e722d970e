"""Byte-level BPE: texts to token ids with character offsets, and ids back to bytes or text.

The merges are applied by the ``tokenizers`` library to Arrow batches. A rank file holds tokens as
byte strings; the library works on characters, so bytes are renamed by the byte-to-character table
of byte-level models, and decoding reverses it. Each match of the split pattern is encoded alone,
and equal matches are encoded once per worker.

Defined cases: a null text counts as empty (no ids); special strings are ordinary text; an id that
is not in the table fails the decoding, as losing bytes silently would be worse.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.common import in_slices, per_worker, small_batches, text_of, trim

#: Split pattern of byte-level models (fixed value).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 250_000
#: Matches taken from a text at once, so that a very long text is not held as one list.
CHUNK = 50_000
#: Pieces encoded in one call; the library's results are some hundred bytes a piece.
CALL = 4096
#: Bytes of one Arrow batch to encode: ids and decoded bytes of all its texts are held beside it.
BATCH = 2 << 20


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others
    shifted behind the first 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(256, 512))
    return [chr(b if b in plain else next(shifted)) for b in range(256)]


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_table())


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


@lru_cache(maxsize=1)
def character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def to_bytes(characters: str) -> bytes:
    back = character_bytes()
    return bytes(back[c] for c in characters)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if len(p) == 2}


@lru_cache(maxsize=4)
def library_model(path: str) -> str:
    """The rank file as a model of the library: every way to build a token from two others is a
    merge, ordered by the rank of what it makes."""
    ranks = read_ranks(path)
    merges = [
        (rank, cut, to_characters(token[:cut]), to_characters(token[cut:]))
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    merges.sort()
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "pre_tokenizer": {
                "type": "ByteLevel",
                "add_prefix_space": False,
                "trim_offsets": False,
                "use_regex": False,
            },
            "model": {
                "type": "BPE",
                "vocab": {to_characters(t): r for t, r in ranks.items()},
                "merges": [[a, b] for _, _, a, b in merges],
            },
        }
    )


class Encoder:
    """Encodes texts by one model; lives in a Python worker."""

    def __init__(self, model: str, pattern: str):
        # One thread: Spark spreads the work, and every thread of the library keeps memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(model)
        self.split = regex.compile(pattern)
        vocab = self.library.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}

    def token_bytes(self) -> dict[int, bytes]:
        return {i: to_bytes(t) for t, i in self.library.get_vocab().items()}

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not seen yet, some thousand in one call of the library."""
        new = list(pieces.difference(self.known))
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(pieces)
        for i in range(0, len(new), CALL):
            part = new[i : i + CALL]
            for piece, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                ids = e.ids
                self.known[piece] = pack("<%dI" % len(ids), *ids)

    def pack(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) <= CHUNK:
                waiting.append(self.split.findall(text))
                size += len(waiting[-1])
                if size > CHUNK:
                    out += self._join(waiting)
                    waiting, size = [], 0
                continue
            out += self._join(waiting)
            waiting, size = [], 0
            matches = (m.group() for m in self.split.finditer(text))
            parts = []
            while chunk := list(islice(matches, CHUNK)):
                parts += self._join([chunk])
            out.append(b"".join(parts))
        return out + self._join(waiting)

    def _join(self, lists: list[list[str]]) -> list[bytes]:
        self.learn(set().union(*lists))
        ids = self.known.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in lists]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """First and last-plus-one character of each token, and how many tokens begin or end
        inside a character; such a token reports the whole character."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.cumsum(self.width[ids])
        starts = ends - self.width[ids]
        if len(raw) == len(text):
            return starts, ends, 0
        first = (raw & 0xC0) != 0x80
        character = np.cumsum(first) - 1
        opens = first[starts]
        closes = np.concatenate((first, [True]))[ends]
        return character[starts], character[ends - 1] + 1, int(np.sum(~(opens & closes)))


def encode(
    df: DataFrame,
    path: str,
    text: str = "text",
    pattern: str = PATTERN,
    into: str = "tokens",
    offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """Add a struct column ``into``: ``ids`` (packed little-endian unsigned 32-bit integers),
    ``n`` (tokens), ``n_split`` (tokens that begin or end inside a character) and, on request,
    ``starts`` and ``ends`` (characters, packed the same way) and ``decoded`` (the bytes that the ids
    give back, by the same worker). Other columns stay.

    The model (a few MB, bounded by the vocabulary) is broadcast; the path is read on the driver.
    """
    small_batches(df.sparkSession, BATCH)
    model = library_model(path)
    shared = df.sparkSession.sparkContext.broadcast(model.encode())
    ident = hashlib.sha256(shared.value + pattern.encode()).hexdigest()
    fields = "ids binary, n bigint, n_split bigint"
    if offsets:
        fields += ", starts binary, ends binary"
    if decoded:
        fields += ", decoded binary"

    def run(texts: pa.Array) -> pa.Array:
        enc = per_worker(("encoder", ident), lambda: Encoder(shared.value.decode(), pattern))
        rows = texts.to_pylist()
        packed = enc.pack(rows)
        split, starts, ends = [], [], []
        for row, ids in zip(rows, packed):
            if not offsets and row.isascii():
                split.append(0)
                continue
            a, b, n = enc.offsets(row, np.frombuffer(ids, dtype="<u4"))
            split.append(n)
            if offsets:
                starts.append(a.astype("<u4").tobytes())
                ends.append(b.astype("<u4").tobytes())
        columns = {
            "ids": pa.array(packed, pa.binary()),
            "n": pa.array([len(p) // 4 for p in packed], pa.int64()),
            "n_split": pa.array(split, pa.int64()),
        }
        if offsets:
            columns |= {"starts": pa.array(starts, pa.binary()), "ends": pa.array(ends, pa.binary())}
        if decoded:
            words = per_worker(("decoder", ident), enc.token_bytes)
            columns["decoded"] = pa.array([join_tokens(words, ids) for ids in packed], pa.binary())
        return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    # Encoding frees many small objects; the allocator would keep their memory.
    udf = F.arrow_udf(in_slices(run, after=trim), f"struct<{_ddl(fields)}>")
    return df.withColumn(into, udf(text_of(text)))


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ") for f in fields.split(","))


def decode(df: DataFrame, path: str, ids: str = "tokens.ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for. Null ids give empty bytes."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    ident = hashlib.sha256(shared.value).hexdigest()

    def run(packed: pa.Array) -> pa.Array:
        words = per_worker(("decoder", ident), lambda: token_bytes(shared.value))
        return pa.array([join_tokens(words, p) for p in packed.to_pylist()], pa.binary())

    packed = F.coalesce(F.col(ids), F.lit(b"").cast("binary"))
    return df.withColumn(into, F.arrow_udf(in_slices(run), "binary")(packed))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> bytes:
    """The tokens of a rank file in characters that stand for bytes, as JSON."""
    return json.dumps({to_characters(t): r for t, r in read_ranks(path).items()}).encode()


def join_tokens(words: dict[int, bytes], packed: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(words.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def token_bytes(tokens: bytes) -> dict[int, bytes]:
    return {i: to_bytes(t) for t, i in json.loads(tokens).items()}


def pieces_of_text(words: dict[int, bytes], ids) -> list[str]:
    """What each token adds to the text: a token that ends inside a character adds nothing of it,
    and the token that finishes it adds it whole. What never becomes a character is replaced."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    out = [reader.decode(words[i]) for i in ids]
    tail = reader.decode(b"", True)
    if out and tail:
        out[-1] += tail
    return out


def decode_pieces(
    df: DataFrame, path: str, ids: str = "tokens.ids", into: str = "pieces"
) -> DataFrame:
    """Add the text as one string per token (see ``pieces_of_text``)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    ident = hashlib.sha256(shared.value).hexdigest()

    def run(packed: pa.Array) -> pa.Array:
        words = per_worker(("decoder", ident), lambda: token_bytes(shared.value))
        rows = (np.frombuffer(p, dtype="<u4").tolist() for p in packed.to_pylist())
        return pa.array([pieces_of_text(words, r) for r in rows], pa.list_(pa.string()))

    packed = F.coalesce(F.col(ids), F.lit(b"").cast("binary"))
    return df.withColumn(into, F.arrow_udf(in_slices(run), "array<string>")(packed))
