"""Byte-level BPE of a public tokenizer as a streaming transducer, and its use over a whole corpus.

A text is read in chunks. The tokenizer's pattern cuts it into pieces, which merges never cross; a piece is final once the
text behind it can no longer change it, and one that outgrows a chunk is passed on in parts. Every piece goes through the
same transducer (:class:`PieceStream`): only a window of it is merged at a time, and a token leaves the window once no text
to its right can change it. How far to the right that can depend is a property of the merge list alone
(:meth:`Bpe.lookahead`), so the memory stays constant however long the text or the piece is. Pieces repeat: what came out
for one is remembered, within a bound of bytes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.session import ship

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces remembered by a worker, characters of a text read at a time, and how many characters behind a piece the pattern
#: looks at most (two, for the longest contraction) and one more.
REMEMBERED, CHUNK, BEHIND = 64 << 20, 32_768, 3


class Bpe:
    """The tokenizer of a rank file. Tokens are ids; ``pieces[id]`` are their bytes."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN, lookahead: int | None = None):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pieces = {i: p for p, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        # What goes on when a piece outgrows a chunk: the class of its last character.
        self.runs = [regex.compile(c).match for c in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")]
        self._known: dict[str, tuple[int, ...]] = {}
        self._room = REMEMBERED
        self._pairs: OrderedDict[tuple[int, int], bool] = OrderedDict()
        self._lookahead = lookahead

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece: while any neighbours form a token, the leftmost of lowest rank is merged. The candidates
        wait in a heap and the parts in a linked list, so a piece of n bytes takes n log n steps."""
        n, ranks = len(piece), self.ranks
        if n <= 1 or piece in ranks:
            return [ranks[piece]] if n else []
        end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], 0
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def parts(self, piece: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes the token ``piece``: what its bytes become under the ranks below its own."""
        own, at = self.ranks[piece], [piece[i : i + 1] for i in range(len(piece))]
        while len(at) > 2:
            best = min(range(len(at) - 1), key=lambda i: min(self.ranks.get(at[i] + at[i + 1], own), own))
            if self.ranks.get(at[best] + at[best + 1], own) >= own:
                break
            at[best : best + 2] = [at[best] + at[best + 1]]
        return at[0], b"".join(at[1:])

    def lookahead(self) -> int:
        """Bytes to the right of a token that suffice to know it.

        A merge of rank r over (u, v) is prevented by text on the right only if a merge of lower rank takes the end of v
        away, that is, has as its left part a token on the right edge of v's own merge tree; that merge may in turn be
        prevented by one of still lower rank. Walking the list in the order of ranks, the reach of a merge is the length
        of v plus the farthest reach of the merges that may prevent it. Chains descend in rank, so the walk ends."""
        if self._lookahead is None:
            right_edge: dict[bytes, tuple[bytes, ...]] = {}
            farthest: dict[bytes, int] = {}
            most = 0
            for i in sorted(self.pieces):
                p = self.pieces[i]
                if len(p) == 1:
                    right_edge[p] = (p,)
                    continue
                u, v = self.parts(p)
                reach = len(v) + max((farthest.get(e, 0) for e in right_edge.get(v, (v,))), default=0)
                right_edge[p] = (p, *right_edge.get(v, (v,)))
                farthest[u] = max(farthest.get(u, 0), reach)
                most = max(most, reach)
            self._lookahead = most + max(map(len, self.ranks))
        return self._lookahead

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether two tokens may stand side by side: merging their bytes gives just them again."""
        if (known := self._pairs.get((a, b))) is None:
            known = self._pairs[a, b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
            if len(self._pairs) > 100_000:
                self._pairs.popitem(last=False)
        return known

    def stream(self, chunks: Iterable[bytes], window: int | None = None) -> Iterator[int]:
        """The ids of one piece that arrives in chunks, each emitted as soon as it is stable."""
        piece = PieceStream(self, window)
        for chunk in chunks:
            yield from piece.push(chunk)
        yield from piece.finish()

    def _piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        piece = PieceStream(self)
        ids = (*piece.push(raw), *piece.finish())
        self._room -= len(raw) + 64
        if self._room < 0:
            self._known.clear()
            self._room = REMEMBERED
        self._known[text] = ids
        return ids

    def _emit(self, pieces: list[str], out: array) -> None:
        known, mark = self._known, len(out)
        try:
            out.extend(chain.from_iterable(map(known.__getitem__, pieces)))
        except KeyError:
            # A failed extend keeps what it consumed: take it back and meet the unknown pieces one by one.
            del out[mark:]
            for p in pieces:
                out.extend(known.get(p) or self._piece(p))

    def encode_into(self, text: str, out: array) -> None:
        """Append the ids of a text, without special tokens: their strings are text like any other."""
        rest, run = "", None
        for i in range(0, len(text), CHUNK):
            rest, run = self._advance(rest + text[i : i + CHUNK], i + CHUNK >= len(text), run, out)

    def _advance(self, text: str, last: bool, run: tuple[int, PieceStream] | None, out: array) -> tuple[str, tuple[int, PieceStream] | None]:
        """Append the ids that are settled by ``text``, what is held of the chunks so far; ``last`` if no more follows. Returns
        what to hold, and the class and the stream of a piece that outgrew its chunk and is still open."""
        if run:
            kind, piece = run
            end = self.runs[kind](text).end()
            open_ = end == len(text) and not last
            # The last white space before a word belongs to the word.
            if kind == 2 and (open_ or end < len(text)):
                end -= 1
            out.extend(piece.push(text[:end].encode("utf-8", "surrogatepass")))
            if open_:
                return text[end:], run
            out.extend(piece.finish())
            text = text[end:]
        pieces, held = self.split(text), 0
        while not last and pieces and held < BEHIND:
            held += len(pieces[-1])
            if held >= CHUNK // 2 and held == len(pieces[-1]):
                self._emit(pieces[:-1], out)
                kind = next(k for k, c in enumerate(self.runs) if c(pieces[-1][-1]).end())
                end = len(text) - (kind == 2)
                piece = PieceStream(self)
                out.extend(piece.push(text[len(text) - held : end].encode("utf-8", "surrogatepass")))
                return text[end:], (kind, piece)
            pieces.pop()
        self._emit(pieces, out)
        return text[len(text) - held :], None

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[array, array]:
        """Offsets and ids of many texts; null and empty texts have no ids."""
        offsets, out = array("i", [0]), array("i")
        for t in texts:
            if t:
                self.encode_into(t, out)
            offsets.append(len(out))
        return offsets, out

    def decode_stream(self, ids: Iterable[int], step: int = 1) -> Iterator[str]:
        """The text of ids as it becomes known, ``step`` ids at a time: an incremental UTF-8 machine keeps the bytes of a character that is not
        whole yet; bytes that are no UTF-8 become U+FFFD."""
        machine, ids = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while block := b"".join(map(self.pieces.__getitem__, islice(ids, step))):
            if s := machine.decode(block):
                yield s
        if s := machine.decode(b"", True):
            yield s

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids, 1024))


class PieceStream:
    """One piece on its way through the transducer: bytes are pushed, stable ids come out, :meth:`finish` gives the rest.

    It holds a window of at most ``size + ahead`` bytes beside the bytes just pushed. What lies within the lookahead of the
    window's end is held back, so what is emitted is what merging the whole piece would give there. Each seam is
    tested all the same (two tokens may be neighbours if merging their bytes gives them again); should a lookahead be too
    short for a merge list, the window grows by steps up to 16 lookaheads, and beyond that the piece is refused."""

    def __init__(self, bpe: Bpe, window: int | None = None):
        self.bpe, self.ahead = bpe, bpe.lookahead()
        self.size = max(window or 0, 4 * self.ahead)
        self.rest, self.last = b"", None

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        self.rest += data
        while len(self.rest) > self.size:
            out += self._stable()
        return out

    def _joined(self, ids: list[int]) -> list[int]:
        if self.last is not None and ids and not self.bpe._neighbours(self.last, ids[0]):
            raise ValueError("a token was emitted before it was stable")
        return ids

    def _stable(self) -> list[int]:
        bpe, need = self.bpe, self.size
        while True:
            seen = self.rest[:need]
            ids = self._joined(bpe.merge(seen))
            cut = kept = 0
            for t in ids:
                if kept + len(bpe.pieces[t]) > len(seen) - self.ahead:
                    break
                kept, cut = kept + len(bpe.pieces[t]), cut + 1
            if cut and bpe._neighbours(ids[cut - 1], bpe.merge(self.rest[kept : kept + self.size])[0]):
                break
            if need >= min(len(self.rest), 16 * self.ahead + self.size):
                raise ValueError("the window does not settle")
            need += self.ahead
        self.rest, self.last = self.rest[kept:], ids[cut - 1]
        return ids[:cut]

    def finish(self) -> list[int]:
        ids = self._joined(self.bpe.merge(self.rest))
        self.rest = b""
        return ids


_BUILT: dict[str, Bpe] = {}


def tokenizer(rank_file: bytes, lookahead: int | None = None) -> Bpe:
    """The tokenizer of a rank file, built once in each Python process."""
    digest = hashlib.sha1(rank_file).hexdigest()
    if digest not in _BUILT:
        _BUILT[digest] = Bpe(rank_file, lookahead=lookahead)
    return _BUILT[digest]


def _shipped(spark: SparkSession, path: str):
    """The rank file and its lookahead, read and worked out by the driver and broadcast (0.8 MB, whatever the corpus' size)."""
    ship(spark)
    with open(path, "rb") as f:
        file = f.read()
    return spark.sparkContext.broadcast((file, tokenizer(file).lookahead()))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, ids: str = "ids") -> DataFrame:
    """``key, ids`` for every row: the ids of the text by the tokenizer of the rank file, without special tokens.

    A null text and an empty text have the empty list; a blank text has the ids of its white space. A null key is kept.
    Texts of any length are read whole. Rows are neither joined nor shuffled: equal rows stay equal rows."""
    file = _shipped(documents.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(*file.value)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                offsets, out = bpe.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()) if not len(offsets) else pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), len(out), [None, pa.py_buffer(out)]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, ids])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key, *keep, n_tokens``: as :func:`encode`, with the number of ids alone."""
    file = _shipped(documents.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(*file.value)
        for b in batches:
            counts = []
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                offsets, _ = bpe.encode_batch(part.column(0).to_pylist())
                counts += [offsets[i + 1] - offsets[i] for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64())], [key, *keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return documents.select(F.col(text), F.col(key), *keep).mapInArrow(run, schema + ", n_tokens bigint")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = DEFAULT_RANKS, text: str = "text") -> DataFrame:
    """``key, text`` of ids: null ids give a null text, no ids the empty text; an id the tokenizer lacks is an error."""
    file = _shipped(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(*file.value)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                texts = [None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, text])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, `{text}` string")
