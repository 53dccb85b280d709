"""Token ids in files: canonical length-limited Huffman codes from global counts, in independent blocks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import partitions, read_table, scratch, spread, written
from .huffman import Decoder, code_lengths, codes_of, pack

VOCABULARY, END = "byte_bpe_50k.json", 0
#: A block is closed once it has so many ids; it holds whole documents.
BLOCK = 1 << 16
#: Bytes of chunks, with their ids, that a worker remembers; beyond, only those of its last texts stay.
REMEMBERED = 48_000_000
#: Bytes of text encoded at a time.
TEXT = 24_000_000
#: What stands between words that the library gets as one text, and how many it gets so.
BETWEEN, TOGETHER = "\n\n", 400
#: How a text's first chunk is marked, and its end.
BEGIN, LAST = "\x01\n", "\x02\n"
#: White space of any kind: a chunk with some inside is of no use.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Marks that end a word, where a letter or digit stands before them.
MARKS = ".,;:!?\"')"
MARKED = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{391}-\x{3A1}\x{3B1}-\x{3C9}\x{400}-\x{481}][.,;:!?\"')]+$"
KIND = "shard int, block int, before long, doc_ids array<long>, sizes array<int>, n_ids long, payload binary, checkpoints binary, crc long"


def can_cut(definition: dict) -> bool:
    """Whether texts of this vocabulary can be cut at single spaces and line ends: byte-level BPE, words
    found by the library's own pattern, no normaliser, nothing added around, added tokens without white space."""
    pre = definition.get("pre_tokenizer") or {}
    plain = definition.get("normalizer") is None and definition["model"].get("type") == "BPE" and not definition["model"].get("dropout")
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = definition.get("added_tokens") or []
    return bool(plain and level and all(t["content"].startswith("<|") and not t["content"].split()[1:] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added))


class Known:
    """Strings with the ids of each, in Arrow: looked up and copied many at a time, never one by one."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.keys = pa.array([], pa.string())
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.keys)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.starts.nbytes + self.ids.nbytes

    def find(self, keys: pa.Array) -> np.ndarray:
        """Each key's place, -1 if it isn't known."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys.cast(pa.string())])
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids))

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids of all these places, end to end."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.starts), pa.array(self.ids))
        return lists.take(pa.array(at)).flatten().to_numpy()

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.starts[at + 1] - self.starts[at]

    def only(self, at: np.ndarray) -> "Known":
        out = Known(self.kind)
        out.add(self.keys.take(pa.array(at)), self.sizes(at), self.take(at))
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees every distinct word once.

    Byte-level vocabularies whose words are found by the usual pattern begin a token at every space or
    line end that stands alone between other characters, and at marks after a letter; a space goes
    with what follows it. So there, texts can be cut; any other vocabulary gets whole texts. A text
    with other white space, or with white space at an end, is given to the library whole too.

    Chunks are written as their text; with a line end before those that follow one; with BEGIN before
    a text's first; and LAST stands for a text's end. No chunk of a text has a line end inside, so neither is mistaken.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cuts = can_cut(json.loads(definition))
        if self.cuts:
            self.between = self._library([BETWEEN])[0].tolist()
            self.cuts = len(self.between) == 1
        self._forget()

    def _forget(self) -> None:
        #: Ids of chunks; how many of the first are of no use, as white space is in them; ids of what the library was given.
        self.chunks, self.pieces = Known(self.kind), Known(self.kind)
        self.useless = np.zeros(1, bool)
        self.chunks.add(pa.array([LAST]), np.array([1]), np.array([END], self.kind))
        self._teach(pa.array(["", "\n"]))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _teach(self, keys: pa.Array) -> None:
        """Add these distinct pieces. Those that begin with a space go to the library many as one text,
        with line ends between them that are a token of their own."""
        spaced = pc.starts_with(keys, " ")
        for some, together in ((keys.filter(pc.invert(spaced)), 1), (keys.filter(spaced), TOGETHER)):
            words = some.to_numpy(zero_copy_only=False).tolist()
            for i in range(0, len(words), together * 256):
                own = [words[j : j + together] for j in range(i, min(i + together * 256, len(words)), together)]
                sizes, ids = [], []
                for group, found in zip(own, self._library([BETWEEN.join(g) for g in own])):
                    if together > 1:
                        at = np.flatnonzero(found == self.between[0])
                        if len(at) + 1 != len(group):
                            each = self._library(group)
                            sizes.append([len(x) for x in each])
                            ids += each
                            continue
                        sizes.append(np.diff(np.concatenate(([-1], at, [len(found)]))) - 1)
                        found = np.delete(found, at)
                    else:
                        sizes.append([len(found)])
                    ids.append(found)
                self.pieces.add(some.slice(i, together * 256), np.concatenate(sizes), np.concatenate(ids))

    def _learn(self, chunks: pa.Array) -> None:
        """Add these distinct chunks: each is a line end or nothing, a word, and the marks after it or none."""
        lined, begun = pc.starts_with(chunks, "\n"), pc.starts_with(chunks, BEGIN)
        cut = pc.or_(lined, begun)
        word = pc.replace_substring_regex(chunks, "^\x01?\n", "")
        useless = pc.or_(pc.equal(word, ""), pc.match_substring_regex(word, BLANK))
        word = pc.if_else(useless, "", word)
        marked = pc.and_not(pc.match_substring_regex(word, MARKED), pc.match_substring(word, "<|"))
        bare = pc.if_else(marked, pc.utf8_rtrim(word, MARKS), word)
        marks = pc.if_else(marked, pc.replace_substring_regex(word, r"^.*?([.,;:!?\"')]*)$", r"\1"), "")
        plain = pc.and_not(pc.invert(cut), useless)
        bare = pc.if_else(plain, pc.binary_join_element_wise(" ", bare, ""), bare)
        needed = pc.unique(pa.concat_arrays([bare, marks]))
        self._teach(needed.filter(pa.array(self.pieces.find(needed) < 0)))
        line = np.where(pc.and_not(lined, useless).to_numpy(zero_copy_only=False), 1, 0)
        at = np.stack((line, self.pieces.find(bare), self.pieces.find(marks)), axis=1)
        self.chunks.add(chunks, self.pieces.sizes(at).sum(axis=1), self.pieces.take(at.ravel()))
        self.useless = np.concatenate((self.useless, useless.to_numpy(zero_copy_only=False)))

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as bytes, END after them. Words are cut, and distinct ones found, by Arrow."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return pa.array([np.append(x, np.array(END, self.kind)).tobytes() for x in self._library(texts.to_pylist())], pa.binary())
        lines = pc.replace_substring(texts, "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise(BEGIN, lines, " " + LAST, ""), " ")
        coded = pc.dictionary_encode(cut.flatten())
        words = coded.dictionary
        at = self.chunks.find(words)
        if (new := at < 0).any():
            known = len(self.chunks)
            self._learn(words.filter(pa.array(new)))
            at[new] = known + np.arange(np.count_nonzero(new))
        index = coded.indices.to_numpy()
        place = at[index]
        data = self.chunks.take(place)
        offsets = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        ends = np.concatenate(([0], np.cumsum(self.chunks.sizes(at)[index])))[offsets] * self.kind.itemsize
        out = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
        bad = self.useless[at]
        if bad.any():
            # Texts with a chunk that can't be used go to the library whole.
            whole = np.unique(np.searchsorted(offsets, np.flatnonzero(bad[index]), side="right") - 1)
            found = dict(zip(whole.tolist(), self._library([texts[i].as_py() for i in whole.tolist()])))
            out = pa.array([np.append(found[i], np.array(END, self.kind)).tobytes() if i in found else x for i, x in enumerate(out.to_pylist())], pa.binary())
        if self.chunks.nbytes + self.pieces.nbytes > REMEMBERED:
            self._shrink(at)
        return out

    def _shrink(self, at: np.ndarray) -> None:
        """Forget all but the chunks at these places; if even they are too many, everything."""
        kept, useless = self.chunks.only(at), self.useless[at]
        self._forget()
        if kept.nbytes <= REMEMBERED // 2:
            self.chunks, self.useless = kept, useless


_loaded: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The worker's own copy, which it keeps for its next tasks."""
    if (key := hash(definition)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(definition)
    return _loaded[key]


def _encoded(docs: DataFrame, definition: str, size: int) -> DataFrame:
    """doc_id, ids, counts: a row for each document, and last of each task one with how often it met every id."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_of(shared.value)
        total = np.zeros(size, np.int64)
        for whole in batches:
            # The more text at a time, the fewer words are looked up again.
            rows = max(1, int(TEXT * whole.num_rows / max(1, whole.column(1).nbytes)))
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                ids = own.encode(b.column(1))
                if ids.buffers()[2] is not None:
                    total += np.bincount(np.frombuffer(ids.buffers()[2], own.kind), minlength=size)
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.nulls(len(b), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"counts": total.tobytes()}], schema)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (bytes: two a number if the vocabulary allows, else four) for every row of docs (doc_id, text), END last."""
    definition, size = _definition(path)
    return _encoded(docs, definition, size).where("ids IS NOT NULL").drop("counts")


def _definition(path: str | None) -> tuple[str, int]:
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        definition = file.read()
    return definition, Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: tasks' counts are summed by id; a row for each id of the vocabulary reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    found = rows.where("counts IS NOT NULL").select("counts").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def write_ids(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Write the ids of docs (doc_id, text), with END after each document, in ascending order of doc_id.

    Two tables of Parquet files. `codebook`: one row, the length of every id's canonical code.
    `blocks`: a row for each block, whose payload stands alone; shards (files of a range of doc_ids)
    and blocks in them are numbered in order. A block has its documents' ids and sizes, the number of ids
    before it in its shard, bit offsets of every 128th id, and a checksum. Spark's writer commits
    whole tasks, so a lost executor leaves no partial files.

    Null texts count as empty. Null doc_ids come first. Rows that share one are in order of a hash of
    their ids and, if that is equal too, in order of reading, so that they need not lie in one task.
    Other columns play no part. An empty table gives a codebook of zeros and no blocks.
    """
    spark = docs.sparkSession
    definition, size = _definition(path)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = written(_encoded(docs, definition, size), "ids")
    lengths = code_lengths(id_counts(rows, size))
    rows = rows.where("ids IS NOT NULL").select("doc_id", "ids")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{out}/codebook")
    table = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes, width = table.value, codes_of(table.value), np.dtype(kind).itemsize
        shard, block, before, held, waiting, keys, sizes = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(waiting), kind)
            payload, marks = pack(ids, lengths, codes)
            row = {"shard": [shard], "block": [block], "before": [before], "doc_ids": [list(keys)], "sizes": [list(sizes)], "n_ids": [len(ids)], "payload": [payload], "checkpoints": [marks.astype("<u4").tobytes()], "crc": [crc32(payload)]}
            return pa.RecordBatch.from_pydict(row, SCHEMA)

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                waiting.append(ids)
                keys.append(key)
                sizes.append(len(ids) // width)
                held += sizes[-1]
                if held >= BLOCK:
                    yield close()
                    before, block, held = before + held, block + 1, 0
                    waiting, keys, sizes = [], [], []
        if keys:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), "mark", "place"]
    ranged = rows.withColumn("mark", F.xxhash64("ids")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "ids").mapInArrow(blocks, KIND).write.parquet(f"{out}/blocks")


SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.binary()), ("crc", pa.int64())])


def read_blocks(spark: SparkSession, out: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks, with `base`, the number of ids in all shards before; the code lengths."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{out}/codebook").first()[0]), np.uint8)
    found = spark.read.schema(KIND).parquet(f"{out}/blocks")
    # A row for each shard, of which there are as many as partitions: few, however large the data.
    totals = sorted((r.shard, r.n) for r in found.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, sums = 0, []
    for shard, n in totals:
        sums.append((shard, base))
        base += n
    bases = spark.createDataFrame(sums, "shard int, base long")
    return found.join(F.broadcast(bases), "shard"), lengths


def read_ids(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int), from the files that write_ids wrote."""
    found, lengths = read_blocks(spark, out)
    table = spark.sparkContext.broadcast(lengths)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 8):
                rows = whole.slice(i, 8).to_pylist()
                if any(crc32(r["payload"]) != r["crc"] for r in rows):
                    raise ValueError("a block is damaged")
                ids = decoder.unpack([(r["payload"], np.frombuffer(r["checkpoints"], "<u4"), r["n_ids"]) for r in rows])
                for r, x in zip(rows, ids):
                    ends = np.cumsum(r["sizes"])
                    starts = ends - r["sizes"]
                    raw = x.astype("<u4").tobytes()
                    crc = [crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["before"] + starts, pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(x.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return found.select("base", *SCHEMA.names).mapInArrow(decoded, kind)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-files")
    write_ids(read_table(spark, sf_dir, "documents"), out)
    return read_ids(spark, out, with_ids=False)
