"""Operators 4, 7, 8 and 9 against the libraries, and their files and packings against what they must hold."""

import base64
import hashlib
import io
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe_codec, packing, token_counts, token_files
from quillspark.llm.common import shared_dir, table
from quillspark.llm.library_ids import library_ids

from .helpers import empty, odd, odd_rows

ODD = ["a  b\n\n c\t\td \x1c x\x1fy \x85 z　w  ", "", "   ", "\n", "x" * 300, "é" * 50 + "   日本語 தமில 🎉🎉 ½²", "it's we'll 'S don't<|endoftext|> x", "a​b  c  d", " " * 500 + "a", "0123456789" * 20, "a \n b\n  c \nd ", " lead", "trail ", "ΑΣ ΑΣ. İ", "<|startoftext|>y <|endoftext|>", "é ẛ̣ ŉ"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=150):
    r = random.Random(4)
    return ["".join(r.choice("aábB9 .\n'-ßΣ日🎉\t") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_codec_equals_the_library_and_round_trips(reference):
    codec = bpe_codec.codec()
    for text in [*ODD, *random_texts()]:
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_prefix_table_appends_and_edits_exactly(reference):
    ranks, r = bpe_codec.codec().ranks, random.Random(1)
    for _ in range(60):
        word = "".join(r.choice("abcdethinos") for _ in range(r.randint(2, 25))).encode()
        cut = r.randint(0, len(word))
        table = bpe_codec.PrefixTable(ranks, word[:cut])
        table.append(word[cut:])
        assert table.last == bpe_codec.PrefixTable(ranks, word).last
        a, z = sorted((r.randint(0, len(word)), r.randint(0, len(word))))
        table.replace(a, z, b"xyz")
        assert table.last == bpe_codec.PrefixTable(ranks, word[:a] + b"xyz" + word[z:]).last
        assert table.tokens() == reference.encode_ordinary(table.data.decode())


def test_codec_query_on_odd_rows(spark, reference):
    got = Counter(map(tuple, bpe_codec.codec_digests(odd(spark)).collect()))
    want = Counter()
    for row in odd_rows():
        text = row[1] or ""
        ids = reference.encode_ordinary(text)
        want[row[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert bpe_codec.codec_digests(empty(spark)).count() == 0


def test_encode_then_decode_tables(spark):
    back = bpe_codec.decode(bpe_codec.encode(odd(spark)))
    assert sorted(bytes(r.data).decode() for r in back.collect()) == sorted(r[1] or "" for r in odd_rows())


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    counter = token_counts.counter()
    texts = [*ODD, *random_texts(), "a" * 2000, "aaa aaaa aaaaa"]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = Counter(map(tuple, token_counts.token_counts(odd(spark)).collect()))
    want = Counter()
    for row in odd_rows():
        n = len(library.encode(row[1] or "", add_special_tokens=False).ids)
        want[row[0], len((row[1] or "").encode()), n, n > 2048] += 1
    assert got == want and any(r[3] for r in got)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_library_ids_equal_whole_texts():
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for text in [*ODD, *random_texts()]:
        ids = library_ids()(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids


def test_seekable_file_reads_only_what_it_needs_and_checks_it():
    out, data = io.BytesIO(), random.Random(2).randbytes(10_000)
    writer = token_files.SeekWriter(out, frame_bytes=1024)
    for i in range(0, len(data), 700):
        writer.append(data[i : i + 700])
    writer.finish()
    raw = out.getvalue()
    reader = token_files.SeekReader(io.BytesIO(raw), len(raw))
    for a, n in ((0, 10_000), (0, 0), (5, 10), (1020, 8), (3000, 5000), (9_999, 1)):
        assert reader.read(a, n) == data[a : a + n]
    with pytest.raises(ValueError):
        reader.read(9_999, 2)
    wrong = bytearray(raw)
    wrong[-9 - 12 * 3 + 8] ^= 1  # a checksum of the table
    reader = token_files.SeekReader(io.BytesIO(bytes(wrong)), len(raw))
    with pytest.raises(ValueError):
        reader.read(0, 10_000)
    assert reader.read(0, 100) == data[:100]


def test_token_files_hold_every_document_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got, start = {r.doc_id: r for r in token_files.file_digests(docs).collect()}, 0
    for doc_id, text in sorted(map(tuple, docs.select("doc_id", "text").collect())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got
    rows = token_files.file_digests(odd(spark)).collect()
    assert len(rows) == len(odd_rows()) and sorted(r.start for r in rows)[0] == 0
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert token_files.file_digests(empty(spark)).count() == 0


def test_single_documents_are_read_from_the_index(spark):
    folder = shared_dir(spark)
    index = token_files.write_files(odd(spark), folder)
    [row] = token_files.read_ids(index.where("doc_id = 7"), folder).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(odd_rows()[8][1], add_special_tokens=False).ids, 0]


def test_sum_of_squares_takes_the_least_by_brute_force():
    r = random.Random(5)
    lengths = [r.randint(1, 32) for _ in range(300)]
    sequence, offset = packing.sum_of_squares(np.array(lengths), 32)
    rooms: dict[int, int] = {}
    for size, at, begin in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):
        count = Counter(v for v in rooms.values() if v)

        def cost(room, count=count, size=size):
            c = Counter(count)
            if room != 32:
                c[room] -= 1
            if room - size:
                c[room - size] += 1
            return sum(v * v for v in c.values())

        open_rooms = {v for v in rooms.values() if v >= size} | {32}
        used = rooms.get(at, 32)
        assert used == 32 - begin and cost(used) == min(map(cost, open_rooms))
        rooms[at] = used - size


@pytest.mark.parametrize("group", [100_000, 20])
def test_packing_is_gapless_whole_and_tight(spark, sf_dir, group):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text").where("doc_id > 3 and doc_id <> 5"))
    docs = docs.dropDuplicates(["doc_id"])
    rows = packing.packed(docs, group=group).toPandas()
    text = dict(map(tuple, docs.collect()))
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in text.items()}
    for d, own in rows.sort_values("piece").groupby("doc_id"):
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids[d]) and (own.length.iloc[1:] == 1024).all()
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    assert set(rows.doc_id) == set(text)
    if group == 100_000:
        assert rows.sequence_id.nunique() <= 1.05 * rows.length.sum() / 1024 + 2


def test_packing_odd_rows(spark):
    rows = packing.packed(odd(spark)).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_rows())
    assert packing.packed(empty(spark)).count() == 0
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(5) == [(0, 5)]


def test_pieces_of_one_id_are_dealt_out(spark):
    df = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some words").alias("text")).unionByName(spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("other words").alias("text")))
    rows = packing.packed(df, group=100).collect()
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 800 and len(sizes) == 8 and max(sizes.values()) < 200
