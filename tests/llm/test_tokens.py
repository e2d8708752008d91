import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from siftworks.llm import bpe, packing, token_counts, token_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return t


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(struct.pack("<I", i) for i in ids))


def test_encoder_equals_the_library(lib):
    odd = ["", "a  b\n\n c", "x²½ ok", "don't I'll  ", "日本 12", "a\x1cb", "  \t\n x", "ſK İ é_1_a", "<|endoftext|> hi", "a b c", "😀 ok"]
    assert bpe.Encoder(bpe.default_path()).encode_many(odd) == [np.array(ids_of(lib, t), dtype="<u4").tobytes() for t in odd]


def test_encoder_equals_the_library_on_any_white_space(lib):
    rng = random.Random(4)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "\u200b", "'s", "'re", "é", "12", ".", "!?", "_", "日本", "½", "😀", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    enc = bpe.Encoder(bpe.default_path(), keep=3000)
    got = [x for i in range(0, len(texts), 1000) for x in enc.encode_many(texts[i : i + 1000])]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_encoder_drops_what_it_holds_and_goes_on(lib):
    enc = bpe.Encoder(bpe.default_path(), keep=5)
    texts = ["one two three four", "five six seven eight nine ten", "one two"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many(texts)] == [ids_of(lib, t) for t in texts]


def test_token_files_round_trip(spark, lib, odd_docs, no_docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(odd_docs, path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect())
    rows = [r for r in odd_docs.collect()]
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(i := [*ids_of(lib, r.text), 0]), crc(i)) for r in rows)
    assert sorted((a, b, n, c) for a, b, _, n, c in got) == want
    at = 0
    for *_, start, n, _ in sorted(got, key=lambda x: x[2]):
        assert start == at
        at += n
    assert [x[:2] for x in sorted(got, key=lambda x: x[2])] == [x[:2] for x in got]  # in ascending order of ids
    assert {r.doc_id: r.ids[:-1] for r in token_files.find(spark, path, [4, 6]).collect()} == {4: ids_of(lib, "Two WORDS"), 6: ids_of(lib, "Ünï ÇÖDE日本 ſK")}
    assert token_files.read_token_files(spark, path).count() == len(rows)
    token_files.write_token_files(no_docs, str(tmp_path / "none"))
    assert token_files.digests(spark, str(tmp_path / "none")).count() == 0


def test_files_have_indexes_and_bloom_filters_and_prune(spark, tmp_path):
    """Every file has the writer's row index and a Bloom filter on doc_id in each stripe, and a read of a few ids is pushed down."""
    path = str(tmp_path / "ids")
    docs = spark.range(0, 30_000).selectExpr("id * 2 AS doc_id", "concat('word ', id) AS text").repartition(4)
    token_files.write_token_files(docs, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [f.split("file:")[-1] for f in spark.read.orc(path).inputFiles()]
    ranges = []
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 10_000 and str(reader.getCompressionKind()) == "ZSTD"
        column = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
        wanted = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
        wanted[column] = True
        rows = reader.rows()
        for stripe in range(reader.getStripes().size()):
            assert rows.readRowIndex(stripe, wanted, wanted).getBloomFilterIndex()[column].getBloomFilterCount() > 0
        rows.close()
        stats = reader.getStatistics()[column]
        ranges.append((stats.getMinimum(), stats.getMaximum()))
    ranges.sort()
    assert ranges[0][0] == 0 and ranges[-1][1] == 59_998 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # files do not overlap
    few = token_files.find(spark, path, [10, 11, 59_998])
    assert sorted(r.doc_id for r in few.collect()) == [10, 59_998]
    assert "In(doc_id, [10,11,59998])" in few._jdf.queryExecution().toString()


def packed(rows, limits):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    waste = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(s) <= limits.segments
        waste += 0 if at & (at - 1) == 0 else limits.tokens - at
    return docs, waste


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 50)])
def test_packing_places_each_id_once(spark, lib, odd_docs, limits):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(docs, limits).collect()
    by_doc, waste = packed(rows, limits)
    for r in docs.collect():
        ids, at = [*ids_of(lib, r.text), 1], 0
        for p in sorted(by_doc.pop(r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert not by_doc
    if limits.segments > 100:
        assert waste == 0


def test_packing_takes_nulls_repeats_and_empty_tables(spark, lib, odd_docs, no_docs):
    """Rows without an id and rows that repeat one are packed each for itself: each row's ids are there as often as the row."""
    want, got = defaultdict(int), defaultdict(int)
    for r in odd_docs.collect():
        want[r.doc_id] += len(ids_of(lib, r.text)) + 1
    rows = packing.pack_documents(odd_docs).collect()
    packed(rows, packing.Limits())
    for p in rows:
        got[p.doc_id] += p.length
    assert got == want
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_of_documents_with_prompts(spark, lib):
    """The third limit binds where prompts bear no loss: no sequence has more loss-bearing tokens than it allows."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    texts = [(i, words(rng.randrange(2, 60)), rng.randrange(0, 100)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, min(c, len(t))) for i, t, c in texts], "doc_id long, text string, prompt int")
    limits = packing.Limits(128, 8, 40)
    rows = packing.pack_documents(docs, limits, prompt_chars="prompt").collect()
    by_doc, _ = packed(rows, limits)
    loss_from = {i: len(ids_of(lib, t[: min(c, len(t))])) for i, t, c in texts}
    loss, most = defaultdict(int), defaultdict(int)
    for p in rows:
        loss[p.sequence_id] += max(0, p.start + p.length - max(p.start, loss_from[p.doc_id]))
        most[p.sequence_id] += p.length
    assert max(loss.values()) <= 40 < max(most.values())
    for i, t, _ in texts:
        assert sum(p.length for p in by_doc[i]) == len(ids_of(lib, t)) + 1


def test_packing_keeps_all_three_limits_with_prompts():
    rng = random.Random(1)
    limits = packing.Limits(100, 5, 60)
    p, items = packing.Packer(limits, pool=32, low=8), {}
    for k in range(400):
        n = rng.choice([1, 5, 30, 80, 300])
        items[k] = (n, rng.randrange(n + 1))
        p.add(k, *items[k])
    p.drain()
    seqs, got = defaultdict(list), defaultdict(list)
    for key, start, length, seq, offset in p.out:
        seqs[seq].append((offset, length, max(0, start + length - max(start, items[key][1]))))
        got[key].append((start, length))
    for s in seqs.values():
        s.sort()
        assert [o for o, *_ in s] == [sum(x[1] for x in s[:i]) for i in range(len(s))]
        assert sum(x[1] for x in s) <= 100 and len(s) <= 5 and sum(x[2] for x in s) <= 60
    for k, (n, _) in items.items():
        at = 0
        for start, length in sorted(got[k]):
            assert start == at
            at += length
        assert at == n


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        j = len(word)
        while j > i and word[i:j] not in pieces:
            j -= 1
        if j == i:
            return 1
        n, i = n + 1, j
    return n


def test_longest_match_equals_greedy_search():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {bytes(rng.choices(b"abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        m = token_counts.LongestMatch(pieces)
        for _ in range(60):
            w = bytes(rng.choices(b"abc", k=rng.randrange(0, 14)))
            assert m.count(w) == greedy(w, pieces)


def test_longest_match_with_a_continuation_prefix():
    rng = random.Random(3)
    for _ in range(60):
        first = {bytes(rng.choices(b"ab", k=rng.randrange(1, 5))) for _ in range(8)}
        later = {bytes(rng.choices(b"ab", k=rng.randrange(1, 5))) for _ in range(8)}
        m = token_counts.LongestMatch([*first, *(b"##" + x for x in later)], b"##")
        for _ in range(60):
            w = bytes(rng.choices(b"ab", k=rng.randrange(1, 12)))
            i = n = 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if w[i:j] in (later if i else first)), None)
                if j is None:
                    n = 1
                    break
                i, n = j, n + 1
            assert m.count(w) == n


def test_token_counts_of_whole_texts(spark, odd_docs, no_docs):
    pieces = set(token_counts.byte_pieces(bpe.default_path()))
    got = token_counts.token_counts(odd_docs).collect()
    want = [(r.doc_id, len(w := bpe.WORDS.findall(r.text or "")), sum(greedy(x.encode(), pieces) for x in w)) for r in odd_docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(no_docs).count() == 0
