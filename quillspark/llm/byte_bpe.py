"""Byte-level BPE encoding and decoding by a merge transducer."""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.memo import Memo, slices, texts, tool
from quillspark.llm.pretokenize import splitter
from quillspark.llm.transducer import MergeTransducer

MEMO = 400_000  #: pieces in each generation of a worker's memo
MEMO_CHARS = 64  #: longer pieces are not kept
AT_ONCE = 512  #: tokens that the query's decoder takes at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern.

    Each piece of the pattern is encoded on its own. The way through the
    transducer from its start state is kept for a bounded number of pieces.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        as_text = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.machine = MergeTransducer(as_text, as_text)
        self.token = {r: t for t, r in ranks.items()}
        self.split = splitter(pattern)
        self._memo = Memo(MEMO, self._piece)

    def _piece(self, piece: str) -> tuple:
        return self.machine.whole(piece.encode("utf-8", "surrogatepass").decode("latin-1"))

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``; special tokens are ordinary text."""
        get, make = self._memo.young.get, self._miss
        return list(chain.from_iterable([get(p) or make(p) for p in self.split(text)]))

    def _miss(self, piece: str) -> tuple:
        return self._memo.miss(piece) if len(piece) <= MEMO_CHARS else self._piece(piece)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of ``ids``; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.token.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], errors: str = "replace", at_once: int = 1) -> Iterator[str]:
        """Text as soon as its bytes are complete: the state holds at most three bytes back.

        ``at_once`` tokens are taken at a time.
        """
        state = codecs.getincrementaldecoder("utf-8")(errors)
        ids = iter(ids)
        while some := list(islice(ids, at_once)):
            if out := state.decode(b"".join(map(self.token.__getitem__, some))):
                yield out
        if out := state.decode(b"", final=True):
            yield out


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec a worker process."""
    return tool(("bytes", path, pattern), lambda: ByteBPE(path, pattern))


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text.

    The ids are decoded as a stream, whose text is hashed as it comes. Null
    texts are empty ones (no ids); bytes that are no UTF-8 count as U+FFFD. Rows are independent: repeated rows and
    null ids come out as they went in, other columns are not read, and an empty
    table gives none. The rank file must be at ``path`` on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        names = {i: str(i) for i in bpe.token}
        for b in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for text in texts(b.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded = hashlib.sha256()
                for part in bpe.decode_stream(ids, at_once=AT_ONCE):
                    decoded.update(part.encode())
                text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return two.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
