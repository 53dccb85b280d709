from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import huffman, pieces, token_counts, token_files
from tessera.llm.common import scratch

ODD = st.text(alphabet=st.sampled_from("aAbé'sSΣσſßİ .,!?\n\t \x1c\x85_-12³日🎉\x01\x02▁<|>endoftx"), max_size=40)


@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    return Tokenizer.from_file(path), token_counts.Merges(open(path, encoding="utf-8").read())


@pytest.fixture(scope="module")
def byte_bpe():
    path = public_tokenizers.path(token_files.VOCABULARY)
    return Tokenizer.from_file(path), token_files.Encoder(open(path, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_counts_are_the_librarys(word_bpe, text):
    assert word_bpe[1].count(text) == len(word_bpe[0].encode(text, add_special_tokens=False).ids)


def test_counts(hard, hard_list, empty, word_bpe):
    want = [(d, len((t or "").encode()), n := len(word_bpe[0].encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, _ in hard_list]
    assert sorted(map(tuple, token_counts.count_tokens(hard).collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD, max_size=4))
def test_ids_are_the_librarys(byte_bpe, texts):
    got = byte_bpe[1].encode(pa.array(texts, pa.string())).to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [byte_bpe[0].encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_token_files(spark, hard, hard_list, empty, byte_bpe):
    out = scratch(spark, "t")
    token_files.write_ids(hard, out)
    rows = token_files.read_ids(spark, out).orderBy("start").collect()
    ids = [(d, byte_bpe[0].encode(t or "", add_special_tokens=False).ids + [0]) for d, t, _ in hard_list]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == sorted(ids, key=repr)
    assert [r.doc_id is not None for r in rows] == sorted(r.doc_id is not None for r in rows)
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(d for d, _ in ids if d is not None)
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    none = scratch(spark, "t")
    token_files.write_ids(empty, none)
    assert token_files.read_ids(spark, none).count() == 0


def test_a_worker_forgets_chunks_but_not_ids(byte_bpe, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 20_000)
    own = token_files.Encoder(open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8").read())
    for i in range(12):
        texts = [f"word{i}x{j} again, {j}.\nnew  line" if j % 9 == 0 else f"word{i}x{j} again, {j}.\nline" for j in range(300)]
        got = own.encode(pa.array(texts)).to_pylist()
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [byte_bpe[0].encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert own.chunks.nbytes + own.pieces.nbytes <= 60_000


def test_other_vocabularies_get_whole_texts():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library, own = Tokenizer.from_file(path), token_files.Encoder(open(path, encoding="utf-8").read())
    texts = ["Words, words\nand more", "", "a b", "one two"]
    assert not own.cuts
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(pa.array(texts)).to_pylist()] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_files_of_one_repeated_id(spark):
    """All of its rows share an id, and most a text: they are dealt out over the shards all the same."""
    rows = spark.range(0, 20_000, 1, 6).selectExpr("5L AS doc_id", "if(id % 3 = 0, concat('text ', id % 50), 'the same') AS text")
    out = scratch(spark, "t")
    token_files.write_ids(rows, out)
    found, _ = token_files.read_blocks(spark, out)
    assert found.select("shard").distinct().count() == 4
    assert token_files.read_ids(spark, out, with_ids=False).selectExpr("count(*)", "count(DISTINCT start)", "sum(n_tokens)").first()[:2] == (20_000, 20_000)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=600), st.integers(6, 12))
def test_huffman_round_trip(ids, longest):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=61) ** 3
    lengths = huffman.code_lengths(counts, longest)
    codes = huffman.codes_of(lengths)
    assert lengths.max(initial=0) <= longest and (not len(ids) or sum(2.0 ** -int(n) for n in lengths if n) <= 1)
    payload, marks = huffman.pack(ids, lengths, codes)
    decoder = huffman.Decoder(lengths, longest)
    assert [x.tolist() for x in decoder.unpack([(payload, marks, len(ids)), (b"", np.zeros(0, np.uint32), 0)])] == [ids.tolist(), []]


def test_huffman_is_least():
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 0, 8])).tolist() == [4, 4, 3, 2, 0, 1]
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 0, 8]), 3).tolist() == [3, 3, 3, 3, 0, 1]
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1]


@pytest.fixture(scope="module")
def model():
    path = public_tokenizers.path(pieces.MODEL)
    return sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(open(path, "rb").read())


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(ODD, max_size=4))
def test_pieces_are_lossless(model, texts):
    seeds = pieces.seeds_of(list(range(len(texts))), 3)
    ids = model[1].encode(texts, seeds)
    assert [model[1].decode(x) for x in ids] == texts
    assert [x.tolist() for x in model[1].encode(texts[::-1], seeds[::-1])] == [x.tolist() for x in ids[::-1]]
    assert [model[0].decode(x.tolist()) for x in ids] == [t.replace("▁", "▁") for t in texts]


def test_pieces_follow_their_distribution(model):
    sp, own = model
    word = "hello"

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            i = sp.piece_to_id(rest[:k])
            if sp.id_to_piece(i) == rest[:k]:
                for more in ways(rest[k:]):
                    yield (i, *more)

    weight = {w: float(np.prod([1 / (10 - sp.get_score(i)) for i in w])) for w in ways("▁" + word)}
    n = 20_000
    drawn = own.encode([word] * n, pieces.seeds_of(list(range(n)), 0))
    found = {w: 0 for w in weight}
    for x in drawn:
        found[tuple(x.tolist())] += 1
    for w, p in weight.items():
        p /= sum(weight.values())
        assert abs(found[w] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_pieces_table(spark, hard, hard_list, empty):
    rows = pieces.round_trip(hard).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(hard_list)
    back = pieces.decode(pieces.encode(hard))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((d, t or "") for d, t, _ in hard_list), key=repr)
    again = {(r.doc_id, r.ids_crc32, r.n_bytes) for r in pieces.round_trip(hard.repartition(2)).collect()}
    assert again == {(r.doc_id, r.ids_crc32, r.n_bytes) for r in rows}
    assert pieces.round_trip(empty).count() == 0


def test_very_long_texts(spark, word_bpe, byte_bpe):
    """Megabytes with and without spaces in one row, through all operators that read whole texts."""
    import hashlib

    from tessera.llm import exact_dedup, mixing, simhash, suffixes

    words = " ".join(f"w{i * i % 9973}" for i in range(250_000))
    solid = "".join(chr(97 + i * i % 23) for i in range(300_000))
    rows = [(1, words, "a"), (2, solid, "a"), (3, words + " end", "b"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {d: t or "" for d, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == {d: len(word_bpe[0].encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r.doc_id: r.lossless for r in pieces.round_trip(df).collect()} == dict.fromkeys(texts, True)
    out = scratch(spark, "t")
    token_files.write_ids(df, out)
    assert {r.doc_id: r.n_tokens for r in token_files.read_ids(spark, out, with_ids=False).collect()} == {d: len(byte_bpe[0].encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    assert {r.doc_id: r.text_sha256 for r in exact_dedup.exact_classes(df).collect()} == {d: hashlib.sha256(t.replace(" ", "").encode()).hexdigest() for d, t in texts.items()}
    assert {r.doc_id: r["size"] for r in mixing.mix(df).collect()} == {d: len(t.split()) for d, t in texts.items()}
    assert len({r.component_id for r in simhash.near_classes(df).collect()}) == 3
    # The long copies share all but what is at the second one's end; the space there follows the same words earlier,
    # as they recur every 9973. The solid text recurs every 23 letters.
    removed = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(df).collect()}
    assert removed == {1: len(words), 2: len(solid), 3: len(words) + 1, 4: 0}
