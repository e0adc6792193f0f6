"""Order-preserving packing of documents into fixed-length sequences by dynamic programming.

The token stream of a partition is cut into windows of at most ``size`` tokens. Windows end at
the end of a document, at the end of a sentence, or, at a higher price, ``size`` tokens after
one of these; where none follows for longer, also at multiples of that. The cuts minimise padding (``size`` less the
window's tokens; none if it ends with a document and their number is a power of two) plus a price per window and per truncated document or
sentence. As padding is linear in a window's start, the best start is a sliding-window minimum, kept in a monotone
queue; the few starts a power of two back are looked up beside it.

The rows keep the order in which the input's partitions hold them, so nothing is shuffled: hand
over a stored table, whose partitions are the same at every retry. Windows are put out once all
cuts that are still open share them, so the result doesn't hang on the size of Spark's batches.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SIZE = 2048
END_ID = 1
#: Prices in tokens: of any window, and of a cut after a sentence or inside one.
WINDOW_PRICE, SENTENCE_PRICE, HARD_PRICE = 2, 3, 8
#: Tokens between two looks for windows to put out, and those held back at most: beyond, the cuts that lead to the last document's end are settled.
SEGMENT, MOST_OPEN = 1 << 16, 1 << 20
DOC, SENTENCE, HARD = 0, 1, 2
PRICES = (WINDOW_PRICE, WINDOW_PRICE + SENTENCE_PRICE, WINDOW_PRICE + HARD_PRICE)


class Cutter:
    """The least-cost cuts of a stream of tokens, document by document. Positions are numbers of tokens before them."""

    def __init__(self, size: int = SIZE, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.powers = [1 << b for b in range(size.bit_length()) if 1 << b <= size]
        # Points where a window may end: position, least cost up to it, and the number of the point where its last window starts; the first is number ``gone``.
        self.where, self.best, self.back, self.gone = [0], [0], [0], 0
        self.queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, number), rising in the first
        self.index = {0: 0}  # numbers of points by position
        self.full: deque[int] = deque([size])  # positions of full windows to come
        self.soft = 0  # the last end of a document or sentence
        self.end = 0

    def feed(self, sentences: list[int], end: int) -> None:
        """The next document, which ends at ``end``, with the positions where sentences end before that."""
        full, size, soft, chained = self.full, self.size, self.soft, None
        for p, kind in [*((p, SENTENCE) for p in sentences), (end, DOC)]:
            while full and full[0] < p:
                f = full.popleft()
                self._point(f, HARD)
                if (f - soft) % size == 0:
                    full.append(chained := f + size)
            if full and full[-1] == chained:  # beyond an end, or there
                full.pop()
            if full and full[0] == p:
                full.popleft()
            self._point(p, kind)
            soft = p
            full.append(p + size)
        self.soft, self.end = soft, end

    def _point(self, p: int, kind: int) -> None:
        queue, low = self.queue, p - self.size
        while queue[0][1] < low:
            queue.popleft()
        cost, _, start = queue[0]
        cost += self.size - p
        if kind == DOC:
            for w in self.powers:
                j = self.index.get(p - w)
                if j is not None and self.best[j - self.gone] < cost:
                    cost, start = self.best[j - self.gone], j
        cost += PRICES[kind]
        i = self.gone + len(self.where)
        self.where.append(p)
        self.best.append(cost)
        self.back.append(start)
        self.index[p] = i
        cost += p
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, p, i))

    def settled(self, last: bool = False) -> list[int]:
        """Ends of the windows that all cuts still open share, but for those given before; at the last, of all."""
        gone, where, back = self.gone, self.where, self.back
        newest = gone + len(where) - 1
        if last:
            top = newest
        else:
            # Any later window starts at one of the points that a window from the end still reaches.
            first = gone + bisect.bisect_left(where, self.end - self.size)
            open_ = {i for i in range(first, newest + 1) if back[i - gone] is not None}
            steps = sorted(open_)
            while len(open_) > 1:
                i = steps.pop()
                open_.discard(i)
                if (j := back[i - gone]) not in open_:
                    open_.add(j)
                    bisect.insort(steps, j)
            top = open_.pop()
            if self.end - where[top - gone] > self.most_open:
                top = newest
                while top >= first:
                    top = back[top - gone]
                self._only_after(top, first)
        ends = []
        i = top
        while i > gone:
            ends.append(where[i - gone])
            i = back[i - gone]
        self.index = {where[i - gone]: i for i in self.index.values() if i >= top and where[i - gone] >= self.end - self.size}
        self.where, self.best, self.back, self.gone = where[top - gone :], self.best[top - gone :], back[top - gone :], top
        return ends[::-1]

    def _only_after(self, top: int, first: int) -> None:
        """Give up the open points that are not reached through ``top``."""
        follows, self.queue, self.index = {top}, deque(), {}
        for i in range(top + 1, self.gone + len(self.where)):
            if self.back[i - self.gone] in follows:
                follows.add(i)
                if i >= first:
                    p = self.where[i - self.gone]
                    cost = self.best[i - self.gone] + p
                    while self.queue and self.queue[-1][0] >= cost:
                        self.queue.pop()
                    self.queue.append((cost, p, i))
                    self.index[p] = i
            else:
                self.back[i - self.gone] = None


class Encoder:
    """Token ids of texts, as the tokenizers file at ``path`` gives them without added special tokens.

    ranks: the same vocabulary as a rank file, by which texts are encoded several times as fast;
    those that hold the string of a special token go through the tokenizers file.
    """

    #: Words with their space, contractions, numbers, signs, and white space: fixed by the vocabulary.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                by_rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(ranks, pat_str=self.PATTERN, mergeable_ranks=by_rank, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    @functools.cached_property
    def ends_sentence(self) -> np.ndarray:
        """By id: its text ends with a full stop, a question or exclamation mark, or has a line break."""
        by_id = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        texts = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        return np.array([t.endswith((".", "!", "?")) or "Ċ" in t for t in texts])  # U+010A stands for the line break


@functools.cache
def encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, text: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece of a document: the other columns of docs in a struct ``row``, then COLUMNS, and the ids if asked for.

    A document's ids are those of its text (null: none) and ``end_id``. Pieces of a sequence have
    the same sequence_id and lie without gaps from offset 0. Repeated rows are packed as often
    as they occur. tokenizer and ranks: paths on every executor, as for Encoder.
    """
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))
    fields = [rows.schema["row"], *[T.StructField(c, T.LongType()) for c in COLUMNS]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        open_ = Open(size, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, with_ids)
        for batch in slices(batches):
            row = batch.column("row")
            for i, x in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*(encode(x) if x else ()), end_id], dtype=np.uint32)
                open_.add(row, i, ids, encode.ends_sentence)
                if open_.due():
                    yield from open_.emit()
            open_.keep()
        yield from open_.emit(last=True)

    return rows.mapInArrow(run, T.StructType(fields))


class Open:
    """Documents of a partition that are not yet put out, as (batch's rows, place, ids, ids put out before)."""

    def __init__(self, size: int, first_id: int, with_ids: bool):
        self.cutter, self.sequence, self.with_ids = Cutter(size), first_id, with_ids
        self.docs: deque[tuple[pa.Array, int, np.ndarray, int]] = deque()
        self.begin = self.looked = 0

    def add(self, row: pa.Array, i: int, ids: np.ndarray, ends_sentence: np.ndarray) -> None:
        start = self.cutter.end
        end = start + len(ids)
        ends = (np.flatnonzero(ends_sentence[ids[:-1]]) + (start + 1)).tolist()
        self.docs.append((row, i, ids, 0))
        self.cutter.feed([p for p in ends if p < end], end)

    def due(self) -> bool:
        return self.cutter.end - self.looked >= SEGMENT

    def keep(self) -> None:
        """Rows that stay beyond their batch are copied, lest they hold all of it."""
        self.docs = deque((pa.concat_arrays([r.slice(j, 1)]) if len(r) > 1 else r, 0 if len(r) > 1 else j, x, d) for r, j, x, d in self.docs)

    def emit(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The pieces of all windows that are settled."""
        if not self.docs:
            return
        self.looked = self.cutter.end
        rows, piece, ids_of, begin = [], [], [], self.begin
        for end in self.cutter.settled(last):
            offset = 0
            while begin < end:
                row, i, ids, done = self.docs.popleft()
                n = min(end - begin, len(ids) - done)
                part = ids[done : done + n]
                rows.append((row, i))
                piece.append((done, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.sequence, offset))
                if self.with_ids:
                    ids_of.append(part)
                done, begin, offset = done + n, begin + n, offset + n
                if done < len(ids):
                    self.docs.appendleft((row, i, ids, done))
            self.sequence += 1
        self.begin = begin
        if not rows:
            return
        arrays, at = [], 0
        while at < len(rows):  # runs of rows from the same batch
            to = at
            while to < len(rows) and rows[to][0] is rows[at][0]:
                to += 1
            arrays.append(rows[at][0].take(pa.array([x[1] for x in rows[at:to]])))
            at = to
        table = np.array(piece, dtype=np.int64)
        columns = [pa.concat_arrays(arrays), *[pa.array(table[:, c]) for c in range(len(COLUMNS))]]
        names = ["row", *COLUMNS]
        if self.with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in ids_of], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).select("row.doc_id", *COLUMNS)
