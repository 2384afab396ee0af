"""Packing of token sequences by order-preserving dynamic programming.

Documents are encoded whole (the tree encoder of ``bpe``) and end with one id of their own; in the order of the
table they are one stream for each partition. The stream is cut into sequences of at most ``LENGTH`` tokens. A cut
may lie at a document's end (free), at a sentence's end (``SENTENCE``: the price of a document that is truncated
there, in tokens), and inside sentences of more than ``LONG`` tokens every ``STEP`` of them (``INSIDE``). A sentence
ends with a line, or after a ``.``, ``!`` or ``?`` that white space follows. A sequence costs its padding up to
``LENGTH`` (none for a length that is a power of two), its cut's price and ``EACH`` for itself, and

    best(i) = price(i) + EACH + min( min over j in the window of best(j) + at(j),  plus LENGTH - at(i);
                                     best(j) for the places j a power of two before i )

The first minimum is over places at most ``LENGTH`` tokens back: a monotone queue on best(j) + at(j) gives
it in constant time a place. The second looks up at most 13 places, found for all i at once by binary search.

The programme runs over chunks of whole documents of at least ``CHUNK`` tokens, so a task holds one chunk (or one
document, if that is longer) however large its partition is; a chunk's end is a cut like any other document's end.
No shuffle takes place and nothing is shared between tasks: a task that is run again gives the same rows.

Null and empty texts are documents of the closing id alone. Repeated rows and null ids are documents of their
own; extra columns are not read. An empty table gives no rows. Sequences do not cross partitions of the input;
their ids are the partition's number times 2^40 plus a count.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _L, _N, _S, TreeEncoder, tokenizer_path
from .common import table

#: Tokens of a sequence, id that ends a document, prices of the cuts and of a sequence, longest sentence without cuts and their distance in longer ones, tokens of a chunk.
LENGTH, END, SENTENCE, INSIDE, EACH, LONG, STEP, CHUNK = 4096, 2, 8, 64, 128, 256, 64, 1 << 20
#: Words whose ids an encoder keeps at most; a worker keeps its encoder from task to task.
MEMO = 1 << 19

#: The bit that marks the last id of a sentence in the encoder's output.
_MARK = 1 << 31
#: As the encoder's pattern for Latin-1 text, with what follows a word if it is a line's end, and what follows punctuation if it is white space.
_WITH_ENDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+\n?|[{_N}]\n?|[^{_S}{_L}{_N}]+[{_S}]?"
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_STOP = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")


class SentenceEncoder(TreeEncoder):
    """Encodes whole texts to 32-bit ids, the last id of each sentence marked."""

    def __init__(self, path: str):
        super().__init__(path)
        self._latin = re.compile(_WITH_ENDS)

    def _known(self, part: str, latin: bool) -> bytes:
        if latin:
            bare = part.rstrip(_WHITE)
            plain = bare.isascii() and bare.isprintable()  # these bytes are their own code points
            ids = self.encode_word(bare if plain else "".join([self._bytes[b] for b in bare.encode()]))
            ends = part.endswith("\n") or (bare != part and _STOP.search(bare))
        else:
            ids, ends = self.encode_unit(part), _STOP.search(part)
        if ends and ids:
            ids[-1] |= _MARK
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            memo = self.memo[latin]
            if len(memo) >= MEMO:
                memo.clear()
            memo[part] = found
        return found

    def marked(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, with ``_MARK`` added where a sentence ends."""
        return np.frombuffer(b"".join(self._coded(text)), "<u4")


@cache
def encoder(path: str) -> SentenceEncoder:
    """One encoder for all tasks of a worker process: loading the file and meeting the common words takes longer than many a task."""
    return SentenceEncoder(path)


def places(lengths: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, price) of the cuts that may be made in documents of ``lengths`` tokens; ``ends``: places (tokens before) at which sentences end."""
    of_docs = np.cumsum(lengths)
    at = np.union1d(np.concatenate([[0], of_docs]), ends)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > min(LONG, length))
    step = min(STEP, length)
    inner = [np.arange(at[i] + step, at[i + 1], step) for i in wide]
    everywhere = np.sort(np.concatenate([at, *inner])) if inner else at
    price = np.full(len(everywhere), INSIDE, np.int64)
    price[np.searchsorted(everywhere, at)] = SENTENCE
    price[np.searchsorted(everywhere, of_docs)] = 0
    return everywhere, price


def cuts(at: np.ndarray, price: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The places among ``at`` (from 0 to the end, at most ``length`` apart) at which the cheapest sequences begin and end."""
    n = len(at)
    if n < 2:
        return at
    pairs = []
    for k in range(length.bit_length()):
        if 1 << k <= length:
            j = np.searchsorted(at, at - (1 << k))
            hit = np.flatnonzero(at[j] == at - (1 << k))
            pairs.append(np.stack([hit, j[hit]]))
    to, back = np.concatenate(pairs, axis=1)
    order = np.argsort(to, kind="stable")
    back, begins = back[order].tolist(), np.searchsorted(to[order], np.arange(n + 1)).tolist()
    where, fee = at.tolist(), (price + EACH).tolist()
    best, came = [0] * n, [0] * n
    window = deque([(0, 0)])  # (best + at, place number), least first, all but dominated ones
    for i in range(1, n):
        here = where[i]
        while where[window[0][1]] < here - length:
            window.popleft()
        least, source = window[0]
        least += length - here
        for p in range(begins[i], begins[i + 1]):
            j = back[p]
            if best[j] < least:
                least, source = best[j], j
        least += fee[i]
        best[i], came[i] = least, source
        key = least + here
        while window and window[-1][0] >= key:
            window.pop()
        window.append((key, i))
    out = [n - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return at[out[::-1]]


def pieces(marked: list[np.ndarray], length: int = LENGTH, end: int = END) -> dict[str, np.ndarray]:
    """The pieces of a chunk of documents (ids with marks): document number, start, length, crc32 of the ids, tokens of the document, sequence number, offset."""
    last = np.array([end], "<u4")
    stream = np.concatenate([x for ids in marked for x in (ids, last)])
    lengths = np.array([len(ids) + 1 for ids in marked], np.int64)
    found = cuts(*places(lengths, np.flatnonzero(stream & _MARK) + 1, length), length)
    stream &= _MARK - 1
    first = np.cumsum(lengths) - lengths
    start = np.union1d(found[:-1], first)
    stop = np.append(start[1:], len(stream))
    doc, sequence = np.searchsorted(first, start, "right") - 1, np.searchsorted(found, start, "right") - 1
    data = memoryview(stream.astype("<u4").tobytes())
    crc = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
    return {"doc": doc, "start": start - first[doc], "length": stop - start, "ids_crc32": crc, "doc_tokens": lengths[doc], "sequence": sequence, "offset": start - found[sequence]}


def pack(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end: int = END, chunk: int = CHUNK) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or tokenizer_path())
        ids: list = []
        held: list[np.ndarray] = []
        n, made = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal n, made, ids, held
            got = pieces(held, length, end)
            sequence = got["sequence"] + made
            made = int(sequence[-1]) + 1
            names = pa.array(ids, id_type).take(pa.array(got["doc"]))
            out = [names, *(pa.array(x, pa.int64()) for x in (got["start"], got["length"], got["ids_crc32"], got["doc_tokens"], sequence, got["offset"]))]
            ids, held, n = [], [], 0
            return pa.RecordBatch.from_arrays(out, names=["doc_id", *fields])

        for b in batches:
            id_type = b.column("doc_id").type
            for i, of, t in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True):
                made = of << 40 if made is None else made
                ids.append(i)
                held.append(coder.marked(t))
                n += len(held[-1]) + 1
                if n >= chunk:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`{f}` bigint" for f in fields))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
