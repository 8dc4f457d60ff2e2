"""Packing token sequences.

Harmonic packing: class k holds pieces of about 1/k of the capacity, and a bin of
class k takes k of them, whatever they are.  So each worker fills the bins of its
classes as its documents pass, without a search and without knowing of others.
Documents are cut into pieces that fill their class: whole sequences first; a
rest is one piece if k of its length leave at most 1/64 of the capacity, or else
gives up the largest k-th that is shorter, and so on.

What a worker's open bins hold in the end, less than one sequence for each of
some 90 classes, goes on with its token ids to a next round of fewer workers.
The last open bins of all are laid end to end and cut at the capacity, and what
is left at powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stage

CAPACITY = 2048
END = 1
#: A piece is left whole if its class's bin stays this near to full.
SLACK = 64
#: So many workers of a round hand their open bins to one of the next.
MERGE = 32
#: New words that a worker gathers before it forgets those it has not met since
#: it last did; longer words than WORD_BYTES are not remembered.
REMEMBERED, WORD_BYTES = 1 << 20, 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, worker long, ids binary"
_PIECE = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in PIECE.split(", ")])
_WIDTH = 4  # bytes of an id, little-endian


class Tokens:
    """Ids of texts as bytes.  The tokenizer drops white space and no token
    spans it, so a text's ids are those of its words, which are remembered.  If
    the tokenizer takes ASCII letters of either case for the same, words are
    remembered in lower case; a special token's name is not made by that."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        normal = self.tokenizer.normalizer
        self.caseless = normal is not None and all(normal.normalize_str(c) == c.lower() for c in ascii_uppercase)
        # a word of ASCII letters that nothing changes or splits goes to the model itself
        letters = "".join(a + b for a in ascii_lowercase for b in ascii_lowercase)
        split = self.tokenizer.pre_tokenizer
        self.whole_words = self.caseless and split is not None and normal.normalize_str(letters) == letters and [p for p, _ in split.pre_tokenize_str(letters)] == [letters]
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, words: Iterable[bytes]) -> None:
        older, fresh, known, tokenize = self.older, [], self.known, self.tokenizer.model.tokenize
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
            elif self.whole_words and w.isalpha() and w.islower():  # of ASCII letters, as bytes are
                known[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            else:
                fresh.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(fresh, found, strict=True))

    def ids(self, text: bytes | None) -> bytes:
        text, known = text or b"", self.known
        if self.caseless:
            low = text.lower()  # ASCII letters only
            text = text if any(s in low for s in self.special) else low
        words = text.split()  # at ASCII white space
        new = set(words).difference(known)  # by the smaller of both
        self.learn(new)
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > WORD_BYTES:
                del known[w]
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return out


@lru_cache(1)
def _tokens(path: str) -> Tokens:
    """Those of a worker process, which goes from task to task."""
    return Tokens(path)


def piece_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces that `total` tokens are cut into."""
    whole, rest = divmod(total, capacity)
    out = [capacity] * whole
    while rest:
        k = capacity // rest
        length = rest if k * rest >= capacity - capacity // SLACK else capacity // (k + 1)
        out.append(length)
        rest -= length
    return out


class Bins:
    """The open bins of one worker."""

    def __init__(self, first_id: int, capacity: int):
        self.next_id, self.capacity, self.open = first_id, capacity, {}

    def close(self, pieces: list[tuple], with_ids: bool = False) -> Iterator[tuple]:
        """Rows of a sequence of pieces (doc_id, start, ids, doc_tokens)."""
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // _WIDTH
            yield doc_id, start, length, zlib.crc32(ids), doc_tokens, None if with_ids else self.next_id, offset, ids if with_ids else None
            offset += length
        self.next_id += not with_ids

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // (len(piece[2]) // _WIDTH)
        mine = self.open.setdefault(k, [])
        mine.append(piece)
        if len(mine) == k:
            del self.open[k]
            yield from self.close(mine)

    def left(self) -> Iterator[tuple]:
        """Rows of the open bins, with ids and without a sequence."""
        for k in sorted(self.open):
            yield from self.close(self.open[k], True)

    def level(self) -> Iterator[tuple]:
        """The open bins end to end, cut at the capacity and then at powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        rest, at = sum(len(p[2]) for p in pieces) // _WIDTH, 0
        lengths = [self.capacity] * (rest // self.capacity)
        rest %= self.capacity
        lengths += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        for length in lengths:
            sequence = []
            while length:
                doc_id, start, ids, doc_tokens = pieces[at]
                took = ids[: length * _WIDTH]
                sequence.append((doc_id, start, took, doc_tokens))
                length -= len(took) // _WIDTH
                if len(took) < len(ids):
                    pieces[at] = doc_id, start + len(took) // _WIDTH, ids[len(took) :], doc_tokens
                else:
                    at += 1
            yield from self.close(sequence)


def _tables(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of bins as Arrow batches, the worker's number put in."""
    worker, rest = TaskContext.get().partitionId(), []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rest, strict=True)) or [()] * 8
        columns.insert(7, (worker,) * len(rest))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)

    for row in rows:
        rest.append(row)
        if len(rest) == size:
            yield batch()
            rest = []
    yield batch()


def _first_id(round_: int) -> int:
    return round_ << 58 | TaskContext.get().partitionId() << 32


def _pack_texts(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins, last = _tokens(path), Bins(_first_id(0), capacity), end.to_bytes(_WIDTH, "little")

        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):  # one text at a time
                    ids, at = tokens.ids(text.as_py()) + last, 0
                    n = len(ids) // _WIDTH
                    for length in piece_lengths(n, capacity):
                        yield from bins.add((doc_id.as_py(), at, ids[at * _WIDTH : (at + length) * _WIDTH], n))
                        at += length
            yield from bins.left()

        yield from _tables(rows())

    return run


def _pack_pieces(round_: int, capacity: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(_first_id(round_), capacity)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for piece in zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True):
                    yield from bins.add(piece)
            yield from bins.level() if final else bins.left()

        yield from _tables(rows())

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for
    each piece of each document.

    A document's ids are the tokenizer's with `end` after them; a null text
    counts as empty and is the one id `end`.  Every id lies in one piece, pieces of
    a sequence follow each other from offset 0 without gaps, and a sequence holds
    capacity tokens at most.  Rows that repeat, or have no id, are documents each
    for itself.  Texts are taken whole, one at a time.  An empty table gives an
    empty result.  `tokenizer` is a file's path that every worker can open.
    """
    d = only(docs, doc_id="long", text="string")
    done, round_ = [], 0
    packed = stage(d.mapInArrow(_pack_texts(tokenizer, capacity, end), PIECE), "packed")
    workers = 1 + (packed.agg(F.max("worker")).first()[0] or 0)
    while True:
        done.append(packed.where("sequence_id is not null"))
        if round_ and workers == 1:
            break
        round_, workers = round_ + 1, -(-workers // MERGE)
        # sorted, so that a task which runs again closes the same bins
        rest = packed.where("sequence_id is null").drop("worker").repartition(workers).sortWithinPartitions("doc_id", "start", "ids_crc32", "ids")
        packed = stage(rest.mapInArrow(_pack_pieces(round_, capacity, workers == 1), PIECE), "packed")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
