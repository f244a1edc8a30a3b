"""Cost-balanced packing of tokenised documents into training sequences.

A task packs its own documents in windows of at most ``WINDOW`` tokens (or one longer
document), so nothing is shuffled and memory stays bounded.  A window of T tokens gets
T // 2048 sequences of 2048 tokens and, for the rest, sequences whose lengths are powers
of two, which need no padding.  Documents are taken from the longest to the shortest;
each goes to the sequence of lowest estimated cost (linear plus quadratic in the length
of its pieces) that still has room, and goes on in the next such sequence where that one
is full.  The rest of a window is thus at most one document long anywhere, and no token
is dropped.
"""

from __future__ import annotations

import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from webloom.llm.bpe import MergeTable, replay
from webloom.llm.flat import distinct, latin_pieces, spans
from webloom.llm.common import map_batches, read, slices, texts_of

LENGTH = 2048
#: Tokens of a window, and bytes of text that are tokenised together.
WINDOW = 2_000_000
CHUNK = 2 << 20
#: Cost of a piece of n tokens: n * LINEAR + n * n * QUADRATIC.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END = 1


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Sequence lengths that hold exactly ``total`` tokens and need no padding."""
    rest = total % length
    return [length] * (total // length) + [1 << i for i in range(length.bit_length() - 1, -1, -1) if rest >> i & 1]


def assign(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these sizes.

    Ties go to the earlier document and the earlier sequence; empty documents give no
    piece.
    """
    room = capacities(sum(sizes), length)
    used = [0] * len(room)
    heap = [(0.0, s) for s in range(len(room))]
    pieces = []
    for d in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start, left = 0, sizes[d]
        while left:
            cost, s = heap[0]
            take = min(left, room[s] - used[s])
            pieces.append((d, start, take, s, used[s]))
            used[s] += take
            start += take
            left -= take
            if used[s] == room[s]:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (cost + take * LINEAR + take * take * QUADRATIC, s))
    return pieces


class Words:
    """Ids of texts by a tokenizer file.

    Texts of Latin-1 characters (on which NFC does nothing and lower-casing is by
    character) are cut into the pieces of the file's pattern as whole arrays; the
    distinct pieces of a chunk are merged together by ``bpe.replay`` with the file's own
    merges and gathered back.  Texts with any other character, or with what may be a
    special token, and files of another form go through the tokenizers library.
    """

    #: The pattern that ``flat.latin_pieces`` implements.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        form = json.loads(definition)
        self.table = None
        model, normal = form["model"], form.get("normalizer") or {}
        split = [x["pattern"].get("Regex") for x in (form.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and split == [self.PATTERN] and model.get("end_of_word_suffix") and not model.get("ignore_merges"):
            vocab, end = model["vocab"], model["end_of_word_suffix"]
            pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
            made = np.array([vocab[a + b] for a, b in pairs])
            self.table = MergeTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), np.arange(len(pairs)), made)
            self.inner = np.array([vocab[c] for c in byte_letters()], np.int32)
            self.final = np.array([vocab[c + end] for c in byte_letters()], np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        n = len(offsets) - 1
        ids, counts, odd = np.zeros(0, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
        if self.table is not None:
            low, starts, lengths, odd = latin_pieces(data, offsets)
            if (found := distinct(low, starts, lengths)) is None:
                odd = np.ones(n, bool)
            elif len(starts):
                first, which = found
                size = lengths[first]
                flat = low[spans(starts[first], size)]
                symbols = self.inner[flat]
                ends = np.cumsum(size) - 1
                symbols[ends] = self.final[flat[ends]]
                made, number = replay(symbols, size, self.table)
                each = number[which]
                ids = made[spans((np.cumsum(number) - number)[which], each)].astype(np.uint32)
                counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, weights=each, minlength=n).astype(np.int64)
        rest = np.flatnonzero(odd)
        if not len(rest):
            return ids, counts
        raw = data.tobytes()
        texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in rest]
        by = {int(i): np.array(e.ids, np.uint32) for i, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        parts, ends = [], np.cumsum(counts)
        for i in range(n):
            parts.append(by[i] if i in by else ids[ends[i] - counts[i] : ends[i]])
        counts[rest] = [len(by[int(i)]) for i in rest]
        return np.concatenate(parts), counts


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: Latin-1
    printable characters stand for themselves, the others follow from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD):
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def tokenised(data: np.ndarray, offsets: np.ndarray, words: Words, end: int = END) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, with the end token."""
    ids, counts = words.encode(data, offsets)
    blob, ends, mark = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist(), np.array([end], "<u4").tobytes()
    return [blob[lo:hi] + mark for lo, hi in zip([0, *ends], ends, strict=False)]


DDL = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(df: DataFrame, definition: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id and
    offset, and with ``ids`` the piece's token ids.

    ``definition`` is the content of a tokenizer file.  A null or empty text is the end
    token alone; a null key stays null; repeated rows are packed each on its own; other
    columns are not read; an empty table gives no rows.  ``sequence_id`` is the task's
    number in the upper bits and a count in the lower 33, so it is the same when a lost
    task runs again.
    """
    packed = df.sparkSession.sparkContext.broadcast(definition)

    def make():
        words, part = Words(packed.value), TaskContext.get().partitionId() << 33
        state = {"next": part}

        def flush(keys: list, blobs: list[bytes]) -> dict:
            sizes = [len(b) // 4 for b in blobs]
            pieces = assign(sizes, length)
            got = [blobs[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            out = {key: [keys[p[0]] for p in pieces], "start": [p[1] for p in pieces], "length": [p[2] for p in pieces], "ids_crc32": list(map(zlib.crc32, got))}
            out |= {"doc_tokens": [sizes[p[0]] for p in pieces], "sequence_id": [state["next"] + p[3] for p in pieces], "offset": [p[4] for p in pieces]}
            if ids:
                out["ids"] = [np.frombuffer(x, "<i4") for x in got]
            state["next"] += max((p[3] for p in pieces), default=-1) + 1
            return out

        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            all_keys = batch.column(0).to_pylist()
            keys, blobs, held = [], [], 0
            for lo, hi in slices(offsets, CHUNK):
                part = tokenised(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, end)
                for k, blob in zip(all_keys[lo:hi], part, strict=True):
                    if held and held + len(blob) // 4 > window:
                        yield flush(keys, blobs)
                        keys, blobs, held = [], [], 0
                    keys.append(k)
                    blobs.append(blob)
                    held += len(blob) // 4
            if keys:
                yield flush(keys, blobs)

        return handle

    return map_batches(df.select(key, text), make, f"{key} {dict(df.dtypes)[key]}, {DDL}" + ", ids array<int>" * ids)


def definition() -> str:
    """The tokenizer file of the production parameters."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), definition())
