"""Operators 1, 4, 5, 8 and 9 against brute force, with the cases their docstrings define."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, linededup, packing, sharding, warc

DOCS = "doc_id long, text string, lang string, row string, score double, key string"
ODD = [
    (1, None, None, "a", None, None),
    (2, "", "en", None, 0.5, "k"),
    (3, "word " * 30_000, "en", "b", 0.1, "k"),
    (4, "same line of text here\nshort\n  SAME LINE of text here\t", "de", "c", 0.2, "k"),
    (5, "same line of text here\nanother line that is long", "de", "d", 0.3, "k"),
    (5, "same line of text here\nanother line that is long", "de", "d", 0.3, "k"),
    (6, "another line that is long\n\x0bsame line of TEXT here \r\nÄnother line that is long", "de", "d", 0.3, "k"),
    (None, "same line of text here", "fr", "e", 0.4, "k"),
    (7, "ünï—codé 🙂 text\x00with\x85odd spacé <|endoftext|>", "xx", "f", 0.4, "k"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_shares_differ_by_one_slot_and_few_keys_move():
    names = sharding.shard_names(7)
    table = np.array(sharding.lookup_table(names, 1009))
    counts = np.bincount(table, minlength=7)
    assert counts.max() - counts.min() <= 1
    fewer = np.array(sharding.lookup_table(names[:-1], 1009))
    stayed = (fewer == table)[table != 6]
    assert stayed.mean() > 0.75
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 1, 1)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_turns_claim_by_preference():
    names, size = ["x", "y", "z"], 13
    orders = {n: [(o + t * s) % size for t in range(size)] for n in names for o, s in [sharding.preference(n, size)]}
    table: dict[int, int] = {}
    while len(table) < size:
        for k, n in enumerate(names):
            if len(table) < size:
                table[next(slot for slot in orders[n] if slot not in table)] = k
    assert sharding.lookup_table(names, size) == [table[i] for i in range(size)]


def test_assign(docs, empty):
    found = sharding.assign_shards(docs.withColumnRenamed("key", "slot").withColumnRenamed("row", "shard"), "doc_id")
    rows = found.collect()
    table, names = sharding.lookup_table(sharding.shard_names()), sharding.shard_names()
    assert len(rows) == len(ODD)
    for r in rows:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.assign_shards(empty, "doc_id").count() == 0


# 4


def test_archives(spark):
    big = "<p>" + "x" * 200_000
    rows = [(3, "http://a/ b\r\nX: y", big), (1, None, big), (2, "http://c", None), (4, "http://d", "tiny"), (5, "http://d", "tiny"), (None, "http://e", big), (1, "http://twice", big), (7, "http://f", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.write_archives(pages, archive_bytes=150_000).cache()
    found = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(archives).collect())
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = data == big.encode() and page_id != 1
        want.append((str(page_id), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert found == sorted(want)
    assert archives.count() > 1
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_damaged_archives():
    record = warc.build_record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    archive = warc.build_archive([record] * 40)
    assert len(list(warc.read_archive(archive))) == 40
    for bad in (b"", archive[:6], archive[:-1], b"x" + archive, archive + b"junk and more junk"):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))
    for a, b in ((b"Content-Length: 7", b"Content-Length: 8"), (b"WARC/1.1", b"WARC/9.9"), (b"payload\r\n", b"pAyload\r\n"), (b"WARC-Date", b"WARC-Dote"), (b"response\r\nWARC-Record", b"metadata\r\nWARC-Record")):
        with pytest.raises(ValueError):
            warc.parse_record(record.replace(a, b))


# 5


def brute_lines(rows, least=10):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= least:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


def test_lines(docs, empty):
    want = brute_lines([r[:2] for r in ODD])
    found = linededup.digest_documents(docs).collect()
    assert _sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found) == _sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    kept = linededup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert _sorted((r["doc_id"], r["text"]) for r in kept.collect()) == _sorted((i, t) for i, _, _, t in want)
    assert linededup.digest_documents(empty).count() == 0


def test_lines_with_a_full_filter_and_a_hot_line(spark):
    r = random.Random(5)
    rows = [(k, "\n".join(["the one very common line"] * (k % 3 == 0) + [f"line number {r.randint(0, 300)} of them" for _ in range(5)])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows))
    dropping = [i for i, _, d, _ in want if d]
    for ranges in (1, 3):
        drops = linededup.repeated_lines(df, bits=linededup.CHUNK, ranges=ranges)
        assert sorted(r["doc_id"] for r in drops.collect()) == dropping
    assert sorted(map(tuple, linededup.digest_documents(df).collect())) == want


def test_ranges_keep_small_filters_selective(spark, monkeypatch):
    """Ten times the lines that one pair of the largest filters would take, each line once."""
    rows = [(k, "\n".join(f"a line of its own {k} {j}" for j in range(200))) for k in range(540)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(linededup, "MAX_BITS", linededup.CHUNK)
    bits, ranges = linededup.filter_size(df)
    assert bits == linededup.CHUNK and ranges == 10
    passed = [linededup.suspected(df, bits, 10, ranges, own).count() for own in (0, 9)]
    assert max(passed) < 0.35 * 540 * 200 / ranges
    assert linededup.suspected(df, bits, 10, 1, 0).count() > 0.7 * 540 * 200  # one range for all lets most through


def test_names_of_other_columns_never_matter(spark, docs):
    odd = docs.selectExpr("doc_id", "text", "lang AS __x", "row AS lines", "score AS dropped", "key AS c1", "row AS n_lines", "key AS drops", "doc_id AS __id", "CAST(0 AS INT) AS n_chars", "row AS `a.b`")
    kept = linededup.dedup_lines(odd)
    assert kept.dtypes == odd.dtypes
    want = {(r["doc_id"], r["text"], len(r["text"]), r["lang"]) for r in linededup.dedup_lines(docs).collect()}
    assert {(r["doc_id"], r["text"], r["n_chars"], r["__x"]) for r in kept.collect()} == want
    assert linededup.digest_documents(odd).count() == len(ODD)
    placed = sharding.assign_shards(odd.withColumnRenamed("lines", "__at").withColumnRenamed("dropped", "AT").withColumnRenamed("c1", "free_slot"), "doc_id")
    assert set(placed.columns) >= {"__at", "AT", "free_slot", "a.b", "slot", "shard"} and placed.count() == len(ODD)
    pages = spark.createDataFrame([(1, "u", "x" * 200, "r", 5), (2, "v", "x" * 200, "r", 6)], "page_id long, url string, html string, record_type string, payload_bytes int")
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read_archives(warc.write_archives(pages)).collect()) == [(1, "response"), (2, "revisit")]
    clash = docs.selectExpr("doc_id", "text", "lang AS start", "row AS n_tokens", "score AS sequence_id", "row AS ids")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert check_packing([r[:2] for r in ODD], packing.pack_documents(clash, path, window=256).collect(), 256) == 1
    assert bpe.digest_documents(clash, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == len(ODD)


def test_write_shards(spark, tmp_path):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS shard")
    sharding.write_shards(df, "k", f"file://{tmp_path}/shards")
    found = spark.read.parquet(f"file://{tmp_path}/shards")
    want = {(r["k"], r["shard"]) for r in sharding.assign_shards(df, "k").collect()}
    assert {(r["k"], r["shard"]) for r in found.collect()} == want and found.count() == 3000


def test_filters_never_miss():
    rng = np.random.default_rng(2)
    f = linededup.Filters(linededup.CHUNK)
    a = rng.integers(0, 1 << 63, 500, np.uint64)
    f.add(a)
    f.add(a[:100])
    assert f.holds(f.once, a, f.bits).all() and f.holds(f.twice, a[:100], f.bits).all()
    for part in (f.once, np.full(linededup.CHUNK // 8, 255, np.uint8)):
        assert (linededup.unpack_bits(linededup.pack_bits(part)) == part).all()


# 8


def check_packing(rows, found, window):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i if i is None else int(i), np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in rows if i is not None)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    got = []
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        if i is not None and len({r["doc_tokens"] for r in pieces}) and sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]:
            got.append((i, b"".join(np.array(r["ids"], "<u4").tobytes() for r in pieces)))
    once = [w for w in want if sum(v[0] == w[0] for v in want) == 1]
    assert [g for g in sorted(got) if g[0] in {w[0] for w in once}] == once
    padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padded += at if at & (at - 1) == 0 else window
    return sum(r["length"] for r in found) / max(1, padded)


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, window=256).collect()
    assert check_packing([r[:2] for r in ODD], rows, 256) == 1
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
    assert packing.pack_documents(empty, path, with_ids=False).count() == 0


def test_placement_minimises_the_sum_of_squares():
    r = random.Random(4)
    p = packing.Packer(64, 0)
    levels = [0] * 65
    for k in range(500):
        size = r.randint(1, 63)
        options = []
        for level in range(0, 65 - size):
            if level == 0 or levels[level]:
                after = levels[:]
                after[level] -= level > 0
                after[level + size] += level + size < 64
                options.append((sum(x * x for x in after), -level, after))
        levels = min(options)[2]
        p.add(k, b"\0\0\0\0" * size)
        assert p.count[1:64].astype(int).tolist() == levels[1:64]


def test_the_rule_decides_nearly_all_tokens(spark):
    """The documents of 10,000 in 32 splits, as tasks get them: a tenth at most is placed again."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(32)
    joined = docs.coalesce(docs.count() // packing.LEAST_DOCUMENTS)
    sizes = joined.selectExpr("spark_partition_id() AS part", "size(split(coalesce(text, ''), ' ')) AS n").collect()
    placed = drained = whole = 0
    for part in {r["part"] for r in sizes}:
        p = packing.Packer(2048, 0)
        for k, r in enumerate(sizes):
            if r["part"] == part:
                p.add(k, bytes(4 * (r["n"] + 1)))
                whole += r["n"] + 1
        p.drain()
        assert not p.count[:2048].any() and sum(1 for x in p.rows) >= k // 32
        placed += p.placed
        drained += p.drained
        lengths = defaultdict(int)
        for row in p.rows:
            lengths[row[5]] += row[2]
        assert sum(n != 2048 for n in lengths.values()) <= 11 and all(n & (n - 1) == 0 for n in lengths.values())
    assert drained < 0.1 * whole and drained < 0.2 * placed


def test_words_equal_the_library():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    alphabet = "abcXYZ 'srtleve\n\t\r\x0b\x1c\x85\xa0½²ÀÉßİΣς🙂́-_.,!?0129 ﻿"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


# 9


@pytest.fixture(scope="module")
def own():
    import tiktoken

    e = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.vocabulary.ranks, special_tokens={})


def test_bpe_equals_the_library(own):
    e, library = own
    r = random.Random(1)
    alphabet = "abc 'srtleve  \n\t\x1c\x85½²Ⅷ١五éßİΣ🙂́\x00_-=~#@!?.,0123 the ing​"
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert e.encode(text) == library.encode_ordinary(text)
        assert e.decode(e.encode(text)) == text.encode()
    for text in ("=" * 3000, "a" * 3000 + " " * 3000 + "b", "<|endoftext|>"):
        assert e.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(own):
    e, library = own
    r = random.Random(2)
    for _ in range(500):
        data = bytes(r.choice(b"abcdethingion") for _ in range(r.randint(0, 30)))
        cut, end = sorted(r.randint(0, len(data)) for _ in range(2))
        p = bpe.PrefixEncoding(e.vocabulary, data[:cut])
        before = list(p.last)
        p.append(data[cut:])
        assert p.last[:cut] == before and list(p.ids()) == list(bpe.PrefixEncoding(e.vocabulary, data).ids())
        p.edit(cut, end, b"xyz")
        assert p.ids() == bpe.PrefixEncoding(e.vocabulary, data[:cut] + b"xyz" + data[end:]).ids()
    alphabet = "ab 'reve  \n1!é"
    for _ in range(1000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        a, b = sorted(r.randint(0, len(text)) for _ in range(2))
        changed, spans = e.re_encode(text, e.spans(text), a, b, r.choice(["", "e", " re", "\n\n"]))
        assert [i for s in spans for i in s[2]] == library.encode_ordinary(changed)


def test_bpe_documents(own, docs, empty):
    e, library = own
    options = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    want = []
    for row in ODD:
        ids = library.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert _sorted(map(tuple, bpe.digest_documents(docs, *options).collect())) == _sorted(want)
    whole = bpe.encode_documents(docs, *options).collect()
    assert _sorted((r["doc_id"], len(r["ids"])) for r in whole) == _sorted(w[:2] for w in want)
    assert bpe.digest_documents(empty, *options).count() == 0
