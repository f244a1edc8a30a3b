"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each match of the splitting pattern is a word.  The distinct words of a chunk of the
corpus (at most ``CHUNK`` bytes of text, or one longer document) are encoded together by
``bpe.replay``; documents are then put together from their words.  There is no shuffle:
the vocabulary (its size is fixed by the file) is read once on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.bpe import rank_table, replay
from webloom.llm.common import map_batches, read, slices, texts_of

CHUNK = 12 << 20
KINDS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 of a token's bytes, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    """Encodes texts by a vocabulary of ranks, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.table = ranks, regex.compile(pattern).findall, rank_table(ranks)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.start = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def words(self, texts: list[str]) -> tuple[list[list[str]], dict[str, list[int]]]:
        """The words of each text, and the ids of each distinct word."""
        split = [self.find(t) for t in texts]
        known: dict[str, list[int]] = {}
        for found in split:
            known.update(dict.fromkeys(found))
        names = list(known)
        raw = [w.encode() for w in names]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, counts = replay(self.start[np.frombuffer(b"".join(raw), np.uint8)], lengths, self.table)
        flat, ends = ids.tolist(), np.cumsum(counts).tolist()
        lo, whole = 0, self.ranks.get
        for w, b, hi in zip(names, raw, ends, strict=True):
            # a word that is itself a token is that token, whether or not merges lead there
            known[w] = flat[lo:hi] if hi - lo == 1 or (r := whole(b)) is None else [r]
            lo = hi
        return split, known

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, *, key: str = "doc_id", text: str = "text", emit: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per row of ``df``: ``key`` and the columns named in ``emit``.

    ``ids`` array<int>; ``n_tokens``; ``ids_sha256`` of the decimal ids joined by commas;
    ``decoded`` the bytes that the ids decode to; ``decoded_sha256`` of those bytes.
    A null or empty text has no ids (digests of the empty string); a null key stays null;
    repeated rows each give a row; other columns of ``df`` are not read.
    """
    packed = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def make():
        codec = Codec(*packed.value)

        def handle(batch: pa.RecordBatch):
            texts = batch.column(1).fill_null("")
            _, offsets = texts_of(batch, text)
            for lo, hi in slices(offsets, CHUNK):
                split, known = codec.words(texts.slice(lo, hi - lo).to_pylist())
                out: dict[str, object] = {key: batch.column(0).slice(lo, hi - lo)}
                if "ids" in emit:
                    out["ids"] = [[i for w in words for i in known[w]] for words in split]
                if "n_tokens" in emit:
                    size = {w: len(v) for w, v in known.items()}
                    out["n_tokens"] = [sum(map(size.__getitem__, words)) for words in split]
                if "ids_sha256" in emit:
                    said = {w: ",".join(map(str, v)) for w, v in known.items()}
                    out["ids_sha256"] = [hashlib.sha256(",".join(map(said.__getitem__, words)).encode()).hexdigest() for words in split]
                    del said
                if "decoded" in emit or "decoded_sha256" in emit:
                    back = {w: codec.decode(v) for w, v in known.items()}
                    whole = (b"".join(map(back.__getitem__, words)) for words in split)
                    if "decoded" in emit:
                        out["decoded"] = whole = list(whole)
                    if "decoded_sha256" in emit:
                        out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in whole]
                yield out

        return handle

    kind = dict(df.dtypes)[key]
    ddl = f"{key} {kind}, " + ", ".join(f"{c} {KINDS[c]}" for c in emit)
    return map_batches(df.select(key, text), make, ddl)


def decode(df: DataFrame, ranks: dict[bytes, int], *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded``, the bytes of each row's ids; null ids decode to no bytes.
    An id that the vocabulary lacks raises KeyError."""
    packed = df.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    def make():
        get = packed.value.__getitem__

        def handle(batch: pa.RecordBatch):
            yield {key: batch.column(0), "decoded": [b"".join(map(get, x or ())) for x in batch.column(1).to_pylist()]}

        return handle

    return map_batches(df.select(key, ids), make, f"{key} {dict(df.dtypes)[key]}, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, emit=("n_tokens", "ids_sha256", "decoded_sha256"))
