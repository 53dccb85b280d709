"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Chunks and words whose counts a worker remembers, beyond which it starts anew, and letters that they have at most.
REMEMBERED, LONG = 400_000, 64


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


ASCII_SPACES, CONTROL = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[\x1c-\x1f]")


class Merges:
    """The merge table of a byte-level BPE vocabulary with word ends, and counts of its tokens."""

    def __init__(self, definition: str):
        whole = json.loads(definition)
        model = whole["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        pattern = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        special = [t["content"] for t in whole["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.chunks: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def word(self, word: bytes) -> int:
        """Initial symbols less merges. The heap holds adjacent pairs by rank, then place; links skip merged symbols."""
        n, ranks = len(word), self.ranks
        symbols = [self.first[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        heap = []
        for i in range(n - 1):
            if found := ranks.get(symbols[i] << 32 | symbols[i + 1]):
                heap.append((found[0], i, found[1], symbols[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            rank, i, made, right = pop(heap)
            j = after[i]
            # A pair is stale when either symbol has been merged since; its rank then no longer fits.
            if j >= n or symbols[j] != right or (now := ranks.get(symbols[i] << 32 | right)) is None or now[0] != rank:
                continue
            merges += 1
            symbols[i], symbols[j] = made, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if found := ranks.get(made << 32 | symbols[j]):
                    push(heap, (found[0], i, found[1], symbols[j]))
            if (h := before[i]) >= 0:
                if found := ranks.get(symbols[h] << 32 | made):
                    push(heap, (found[0], h, found[1], made))
        return n - merges

    def _plain(self, text: str) -> int:
        """Tokens of a chunk that has no special string."""
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: of a whole word, Python lower-cases a last sigma in another way.
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        total, known = 0, self.known
        for w in self.words(text):
            n = known.get(w)
            if n is None:
                n = self.word(w.encode())
                if len(w) <= LONG:
                    known[w] = n
            total += n
        return total

    def chunk(self, chunk: str) -> int:
        if "<|" not in chunk:
            return self._plain(chunk)
        parts = self.special.split(chunk)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def count(self, text: str) -> int:
        """Tokens of a whole text. No token spans white space, so chunks between it are counted alone and remembered."""
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        total, chunks = 0, self.chunks
        # Python splits at four control characters that patterns don't count as white space.
        for c in ASCII_SPACES.split(text) if CONTROL.search(text) else text.split():
            n = chunks.get(c)
            if n is None:
                n = self.chunk(c)
                if len(c) <= LONG:
                    chunks[c] = n
            total += n
        return total


_loaded: dict[int, Merges] = {}


def merges_of(definition: str) -> Merges:
    """The worker's own copy, which it keeps for its next tasks."""
    key = hash(definition)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Merges(definition)
    return _loaded[key]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    `path` is a tokenizer definition, read by the driver alone. Counts are those of the tokenizers
    library without added begin or end tokens; special strings in a text are one token each.
    A null text counts as empty, with 0 bytes and 0 tokens. Null ids and repeated rows are kept. An empty
    table gives an empty result; other columns play no part.
    """
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(definition.value)
        for b in batches:
            texts = b.column(1)
            n = pa.array([merges.count(t.as_py() or "") for t in texts], pa.int64())
            size = pa.array([len(t.as_py() or b"") for t in texts.cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], ["doc_id", "n_bytes", "n_tokens"])

    out = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
