"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread

MODEL = "piece_bpe_32k.model"
#: How strongly likely pieces are preferred: 0 draws every segmentation alike, a large value the likeliest.
THETA = 1.0
#: Letters of text that are encoded together; distinct chunks whose lattices a worker remembers, and edges of these.
TOGETHER, REMEMBERED, EDGES = 500_000, 120_000, 8_000_000
SPACE, BYTE = 0x2581, 0x200000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: 64 bits that look random for each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a model, ready to find them in texts. A text is cut into chunks that no piece crosses:
    spaces with the word after them, and line ends.

    A lattice node is a place in a chunk; an edge is a piece that ends there. For every chunk once,
    the forward pass sums over all segmentations and leaves each node's edges with the probability
    that a sampled segmentation which reaches the node came along it. Every occurrence then walks
    backward from the chunk's end, drawing edges by a hash of the row's seed, the chunk's place in
    the text and the step, so that results depend on nothing else.
    """

    def __init__(self, model: bytes, theta: float = THETA):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.content: list[bytes] = [b""] * n
        self.bytes_at = np.full(256, -1, np.int64)
        pieces: dict[int, list[tuple[str, int, float]]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.content[i] = bytes([int(piece[3:5], 16)])
                self.bytes_at[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.content[i] = piece.replace("▁", " ").encode()
                pieces.setdefault(len(piece), []).append((piece, i, sp.get_score(i)))
        if (self.bytes_at < 0).any():
            raise ValueError("the model has no pieces for single bytes")
        if any("\n" in p or re.search("[^▁]▁", p) for own in pieces.values() for p, _, _ in own):
            raise ValueError("a piece of the model crosses words")
        # BPE models score pieces by rank; by Zipf's law a piece's log-probability falls with the rank's logarithm.
        by_rank = all(s <= 0 and s == int(s) for own in pieces.values() for _, _, s in own)
        value = (lambda s: -theta * np.log(10 - s)) if by_rank else (lambda s: theta * s)
        self.longest = max(pieces)
        self.single = np.zeros(BYTE + 256, bool)
        self.single[[ord(p) for p, _, _ in pieces[1]]] = True
        starts: dict[int, set[int]] = {k: set() for k in range(1, self.longest + 1)}
        self.tables = {}
        for k, own in pieces.items():
            hashes = np.array([self._hash(p) for p, _, _ in own], np.uint64)
            order = np.argsort(hashes)
            if len(set(hashes.tolist())) < len(own):
                raise ValueError("two pieces have the same hash")
            self.tables[k] = hashes[order], np.array([i for _, i, _ in own])[order], np.array([value(s) for _, _, s in own])[order]
            for p, _, _ in own:
                for j in range(1, k + 1):
                    starts[j].add(self._hash(p[:j]))
        self.starts = {k: np.array(sorted(s), np.uint64) for k, s in starts.items()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ends = np.zeros(0, np.int64)  # by chunk: its last node
        self.first, self.last = np.zeros(0, np.int32), np.zeros(0, np.int32)  # by node: its edges
        self.before, self.piece, self.upto = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)  # by edge

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _units(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all chunks, spaces as the model writes them, other letters than the model's as bytes; each chunk's length."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        strange = ~self.single[np.where(codes == 32, SPACE, codes)] | (codes == SPACE)
        codes = np.where(codes == 32, SPACE, codes)
        if strange.any():
            at = np.flatnonzero(strange)
            as_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at].tolist()]
            times = np.ones(len(codes), np.int64)
            times[at] = [len(b) for b in as_bytes]
            codes, own, strange = np.repeat(codes, times), np.repeat(own, times), np.repeat(strange, times)
            codes[strange] = BYTE + np.frombuffer(b"".join(as_bytes), np.uint8).astype(np.int64)
        return codes, np.bincount(own, minlength=len(chunks))

    def _edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, length, piece and log-weight of every piece found; room: units up to the chunk's end."""
        units = np.flatnonzero(codes >= BYTE)
        out = [(units, np.ones(len(units), np.int64), self.bytes_at[codes[units] - BYTE], np.full(len(units), -10.0))]
        at, h = np.flatnonzero(codes < BYTE), np.zeros(np.count_nonzero(codes < BYTE), np.uint64)
        for k in range(1, self.longest + 1):
            fits = room[at] >= k
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = h * np.uint64(0x100000001B3) + codes[at + k - 1].astype(np.uint64) + np.uint64(1)
            begun = self.starts[k]
            on = begun[np.minimum(np.searchsorted(begun, h), len(begun) - 1)] == h
            at, h = at[on], h[on]
            if k in self.tables:
                hashes, ids, weights = self.tables[k]
                i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[i] == h
                out.append((at[hit], np.full(np.count_nonzero(hit), k), ids[i[hit]], weights[i[hit]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _learn(self, chunks: list[str]) -> None:
        """Forward filtering for new chunks, all at once: node by node from each chunk's start."""
        codes, sizes = self._units(chunks)
        chunk_end = np.cumsum(sizes)
        own = np.repeat(np.arange(len(chunks)), sizes)
        start, length, piece, weight = self._edges(codes, chunk_end[own] - np.arange(len(codes)))
        base = np.concatenate(([0], chunk_end[:-1])) + np.arange(len(chunks))  # each chunk has a node more than units
        src = start + own[start]
        dst = src + length
        # Edges by the node they end at, then by length: so ranks within a node don't depend on other chunks.
        order = np.lexsort((length, dst))
        src, dst, piece, weight = src[order], dst[order], piece[order], weight[order]
        nodes = int(chunk_end[-1]) + len(chunks)
        count = np.bincount(dst, minlength=nodes)
        first = np.cumsum(count) - count
        place = np.arange(nodes) - np.repeat(base, sizes + 1)
        alpha = np.zeros(nodes)
        p = np.zeros(len(src))
        by_place = np.argsort(place, kind="stable")
        marks = np.searchsorted(place[by_place], np.arange(1, int(sizes.max()) + 2))
        for k in range(len(marks) - 1):
            at = by_place[marks[k] : marks[k + 1]]
            e, n = first[at], count[at]
            total = alpha[src[e]] + weight[e]
            for r in range(1, int(n.max())):
                more = np.flatnonzero(n > r)
                x = e[more] + r
                total[more] = np.logaddexp(total[more], alpha[src[x]] + weight[x])
            alpha[at] = total
        p = np.exp(alpha[src] + weight - alpha[dst])
        upto, rank = p.copy(), np.arange(len(src)) - first[dst]
        for r in range(1, int(rank.max(initial=0)) + 1):
            x = np.flatnonzero(rank == r)
            upto[x] += upto[x - 1]
        shift, edges = len(self.first), len(self.piece)
        for i, c in enumerate(chunks, len(self.known)):
            self.known[c] = i
        self.ends = np.concatenate((self.ends, shift + base + sizes))
        self.first = np.concatenate((self.first, (edges + first).astype(np.int32)))
        self.last = np.concatenate((self.last, (edges + first + count - 1).astype(np.int32)))
        self.before = np.concatenate((self.before, (shift + src).astype(np.int32)))
        self.piece = np.concatenate((self.piece, piece.astype(np.int32)))
        self.upto = np.concatenate((self.upto, np.minimum(upto * 4294967296.0, 4294967295.0).astype(np.uint32)))

    def encode(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """The sampled pieces' ids for each text; seeds: a 64-bit number for each."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= TOGETHER):
                size += len(texts[j])
                j += 1
            out += self._encode(texts[i:j], seeds[i:j])
            i = j
        return out

    def _encode(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED or len(self.piece) > EDGES:
            self._forget()
        found = [CHUNK.findall(" " + t) if t else [] for t in texts]
        if new := list(dict.fromkeys(c for own in found for c in own if c not in self.known)):
            self._learn(new)
        known = self.known
        counts = np.array([len(own) for own in found])
        chunk = np.fromiter((known[c] for own in found for c in own), np.int64, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(texts)), counts)
        key = mixed(seeds[row] + (np.arange(len(chunk)) - starts[row]).astype(np.uint64) * GOLDEN)
        node, at = self.ends[chunk], np.arange(len(chunk))
        drawn, steps = [], np.zeros(len(chunk), np.int64)
        step = 0
        while len(at):
            u = (mixed(key[at] + np.uint64(step * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.uint32)
            e, last = self.first[node], self.last[node]
            on = np.flatnonzero((self.upto[e] <= u) & (e < last))
            while len(on):
                e[on] += 1
                on = on[(self.upto[e[on]] <= u[on]) & (e[on] < last[on])]
            drawn.append((at, self.piece[e]))
            steps[at] += 1
            node = self.before[e]
            more = self.first[node] <= self.last[node]  # no edge ends at a chunk's first node
            node, at, step = node[more], at[more], step + 1
        stop = np.cumsum(steps)
        ids = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        for s, (at, piece) in enumerate(drawn):
            ids[stop[at] - 1 - s] = piece
        cuts = np.concatenate(([0], stop))
        return [ids[cuts[a] : cuts[a + n]] for a, n in zip(starts.tolist(), counts.tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of any segmentation: pieces' contents end to end, without the space put first."""
        whole = b"".join(map(self.content.__getitem__, ids.tolist()))
        return whole[1:].decode("utf-8", "surrogatepass")


CHUNK = re.compile(r" *[^ \n]+|\n| +")
_loaded: dict[int, Pieces] = {}


def pieces_of(model: bytes, theta: float) -> Pieces:
    """The worker's own copy, which it keeps for its next tasks."""
    if (key := hash((model, theta))) not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model, theta)
    return _loaded[key]


def seeds_of(keys: list[int | None], seed: int) -> np.ndarray:
    numbers = np.array([(0 if k is None else k + 1) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
    return mixed(numbers * GOLDEN + np.uint64(seed))


def _model(docs: DataFrame, path: str | None):
    with open(path or public_tokenizers.path(MODEL), "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = 0) -> DataFrame:
    """doc_id, ids (array of int) for every row of docs (doc_id, text): one sampled segmentation of the whole text.

    The same row key, text, model, theta and seed give the same ids wherever the row lies. A null
    text counts as empty and has no ids; a null doc_id has a seed of its own; repeated rows are
    segmented alike.
    """
    model = _model(docs, path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model.value, theta)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                keys = b.column(0).to_pylist()
                ids = own.encode([t or "" for t in b.column(1).to_pylist()], seeds_of(keys, seed))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None, theta: float = THETA) -> DataFrame:
    """doc_id, text for every row of rows (doc_id, ids); null ids give a null text."""
    model = _model(rows, path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model.value, theta)
        for b in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decoded, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 (ids as little-endian 32 bits), decoded_sha256, lossless: encode, then decode, in one pass; with ids (array of int) if asked for.

    Rows, nulls and seeds as in encode. An empty table gives an empty result; other columns play no part.
    """
    model = _model(docs, path)
    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "lossless", *["ids"] * with_ids]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model.value, theta)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids = own.encode(texts, seeds_of(b.column(0).to_pylist(), seed))
                back = [own.decode(x) for x in ids]
                cols = [
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                    pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                    pa.array([t == x for t, x in zip(texts, back)], pa.bool_()),
                ]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    kinds = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(both, kinds)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
