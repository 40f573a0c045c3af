"""Sum-of-squares online packing of tokenized documents into fixed windows.

Every partition packs its own documents as they come. A document is cut only into full windows; what
is left over goes to the fill level at which the sum of the squared counts of partly filled windows
ends up smallest, and a level array tracks those counts. At most `open_windows` windows are open at a
time: beyond that, and at the end of the partition, the open windows are closed by cutting their
pieces into full windows, and the last tokens of the partition become sequences whose lengths are
powers of two, which need no padding. Nothing is shuffled, and a lost task packs its partition again
in the same way.

Token ids are those that the tokenizer file's library gives without adding special tokens (a special token's
string inside a text is that token, as there); each document ends with one separator id.

Defined cases: null and empty texts are one separator id; repeated rows and repeated or null ids are
packed each by itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, table, text_or_empty

SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingParams:
    window: int = 1024
    separator: int = 0
    open_windows: int = 4096


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids of a byte-level BPE file, as little-endian 32-bit bytes.

    Merges are in the order of ids in such a file, so a rank-based encoder of the same vocabulary gives the same ids
    several times faster. It takes texts of characters on which the two libraries' regular expressions
    agree for certain; the file's own library takes the others.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Load

        self.full = Load.from_file(path)
        added = json.loads(self.full.to_str())["added_tokens"]
        letters, special = byte_alphabet(), {t["id"] for t in added}
        self.added = [t["content"] for t in added]
        ranks = {bytes(letters[c] for c in token): i for token, i in self.full.get_vocab(with_added_tokens=True).items() if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ſ‐-‧‰-›€]").search

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self.other(t) or any(a in t for a in self.added)]
        slow = set(whole)
        out = [b"" if i in slow else self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for i, t in enumerate(texts)]
        for i, e in zip(whole, self.full.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


class Packer:
    """The open windows of one partition. Pieces are (doc, start, ids); a window is a list of pieces."""

    def __init__(self, params: PackingParams, first_id: int):
        self.window, self.most, self.next_id = params.window, params.open_windows, first_id
        self.count = np.zeros(self.window + 1, np.int64)  # open windows of each level
        self.open: list[list[list[tuple]]] = [[] for _ in range(self.window + 1)]
        self.n_open = 0

    def level(self, n: int) -> int:
        """The level, 0 for a new window, that a piece of n ids goes to."""
        levels = np.flatnonzero(self.count[: self.window - n + 1])
        if not len(levels):
            return 0
        filled = levels + n
        change = 1 - 2 * self.count[levels] + np.where(filled < self.window, 2 * self.count[filled] + 1, 0)
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
        return int(levels[best]) if change[best] < 2 * self.count[n] + 1 else 0

    def place(self, doc: tuple, ids: bytes) -> Iterator[list[tuple]]:
        full = len(ids) // 4 // self.window * self.window
        for a in range(0, full, self.window):
            yield [(doc, a, ids[4 * a : 4 * (a + self.window)])]
        n = len(ids) // 4 - full
        if not n:
            return
        h = self.level(n)
        pieces = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        pieces.append((doc, full, ids[4 * full :]))
        self.n_open += not h
        if h + n == self.window:
            self.n_open -= 1
            yield pieces
            return
        self.open[h + n].append(pieces)
        self.count[h + n] += 1
        if self.n_open > self.most:
            yield from self.close(last=False)

    def close(self, last: bool = True) -> Iterator[list[tuple]]:
        """Cut the pieces of all open windows into full windows; the rest stays open or, at last, becomes powers of two."""
        pieces = [p for level in reversed(self.open) for w in level for p in w]
        self.__dict__.update(open=[[] for _ in range(self.window + 1)], n_open=0)
        self.count[:] = 0
        left = sum(len(ids) for _, _, ids in pieces) // 4
        now: list[tuple] = []
        room = size = self._size(left, last)
        for doc, start, ids in pieces:
            while ids:
                n = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * n]))
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    if size == self.window or last:
                        yield now
                    now, room = [], self._size(left, last)
                    size = room
        if now:
            n = sum(len(ids) for _, _, ids in now) // 4
            self.open[n].append(now)
            self.count[n], self.n_open = 1, 1

    def _size(self, left: int, last: bool) -> int:
        if left >= self.window or not last:
            return self.window
        return 1 << (left.bit_length() - 1) if left else self.window


def _rows(windows: Iterator[list[tuple]], packer: Packer) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    for pieces in windows:
        offset = 0
        for (doc, tokens), start, ids in pieces:
            n = len(ids) // 4
            for k, v in zip(out, (doc, start, n, zlib.crc32(ids), tokens, packer.next_id, offset)):
                out[k].append(v)
            offset += n
        packer.next_id += 1
    return out


def _pack(path: str, pattern: str, params: PackingParams):
    schema = pa.schema([(k, pa.int64()) for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches):
        from pyspark import TaskContext

        tokenizer, end = Tokenizer(path, pattern), np.array([params.separator], "<u4").tobytes()
        packer = Packer(params, TaskContext.get().partitionId() << 40)
        for cols, texts in chunks(batches, "text", 1 << 20):
            encoded = tokenizer.encode([t.decode("utf-8", "replace") for t in texts])
            windows = (w for i, ids in zip(cols["id"], encoded) for w in packer.place((i, len(ids) // 4 + 1), ids + end))
            yield pa.RecordBatch.from_pydict(_rows(windows, packer), schema)
        yield pa.RecordBatch.from_pydict(_rows(packer.close(), packer), schema)

    return run


def pack_documents(docs: DataFrame, path: str, pattern: str, *, id: str = "doc_id", text: str = "text", params: PackingParams = PackingParams()) -> DataFrame:
    """One row a piece of a document. path and pattern: the tokenizer's file and its pre-token pattern."""
    return docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(_pack(path, pattern, params), SCHEMA).withColumnRenamed("id", id)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
