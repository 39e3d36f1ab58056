import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltstone.llm import packing, rans, token_counts, token_output, tokens

BYTE, WORD = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("word_bpe_49k.json")


def library(path, text):
    return tokens.encoder(path, path == WORD).whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_give_the_library_ids(path):
    texts = ["", " ", "a", "  two ", "tab\t x", "it's I'LL don't", "x <|endoftext|> y", "naïve ½ ²3 日本 é ﬁ İ", "a\x1cb \x85 c\xa0d", "\n", "a \nb", "a\n\nb", "ß ẞ", "x\x01y", "İstanbul", "ÅB é"]
    ids, sizes = tokens.encoder(path, path == WORD).encode(texts)
    ends = np.cumsum(sizes)
    for text, size, end in zip(texts, sizes, ends, strict=True):
        assert ids[end - size : end].tolist() == library(path, text), text


@pytest.mark.parametrize("text", ["ab cd " * 3000, "x" * 3000, "a" * 1500 + " b " * 40 + "c" * 900, "  \n \n\n " * 300, "é日本 <|endoftext|>" * 200, "don't it's " * 200])
def test_splicing_equals_the_whole(text):
    ids, chunks, _ = token_counts.spliced(tokens.encoder(BYTE).whole, text, chunk_chars=100, overlap_chars=8)
    assert ids == library(BYTE, text)
    assert chunks > 1


def test_overlaps_widen_when_no_boundary_is_common():
    text = "w " * 60 + "z" * 500 + " w" * 60
    ids, _, widened = token_counts.spliced(tokens.encoder(BYTE).whole, text, chunk_chars=150, overlap_chars=10)
    assert ids == library(BYTE, text) and widened


def test_counts(spark, awkward, nothing):
    rows = token_counts.count_tokens(awkward, BYTE, 1024).collect()
    texts = [r["text"] for r in awkward.collect()]
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library(BYTE, x)) for x in texts)
    assert sorted(r["n_bytes"] for r in rows) == sorted(len((x or "").encode()) for x in texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert token_counts.count_tokens(nothing, BYTE, 1024).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000])
def test_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 900).astype(np.uint32)
    table = rans.Table(rans.frequencies(np.bincount(ids, minlength=900)))
    blocks = rans.encode(ids, table, block_tokens=512)
    assert len(blocks) == -(-n // 512)
    assert [*map(int, np.concatenate(rans.decode(blocks, table)) if blocks else [])] == ids.tolist()


def test_coder_starts_at_checkpoints_and_finds_damage():
    ids = np.arange(rans.BLOCK_TOKENS, dtype=np.uint32) % 77
    table = rans.Table(rans.frequencies(np.bincount(ids)))
    (block,) = rans.encode(ids, table)
    assert (rans.decode([block], table, from_step=1500)[0] == ids[1024 * rans.LANES :]).all()
    with pytest.raises(rans.Damaged):
        rans.decode([block[:-1] + bytes([block[-1] ^ 1])], table)


def test_frequencies_keep_every_id():
    freq = rans.frequencies(np.array([1, 10**12, 0, 3] + [1] * 5000))
    assert freq.sum() == 1 << rans.SCALE_BITS and freq[2] == 0 and (np.delete(freq, 2) > 0).all()


def test_files_round_trip(spark, awkward, nothing, tmp_path):
    token_output.write_ids(awkward, f"file://{tmp_path}/a", BYTE, end_id=2, n_shards=3, group_tokens=2000)
    got = token_output.read_ids(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    rows = sorted(awkward.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at, want = 0, []
    for r, g in zip(rows, got, strict=True):
        ids = [*library(BYTE, r["text"]), 2]
        want.append((r["doc_id"] or -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert (g["doc_id"], g["start"]) == (r["doc_id"], at)
        at += g["n_tokens"]
    assert sorted(want) == sorted((g["doc_id"] or -1, g["n_tokens"], g["ids_crc32"]) for g in got)
    token_output.write_ids(nothing, f"file://{tmp_path}/b", BYTE, end_id=2)
    assert token_output.read_ids(spark, f"file://{tmp_path}/b").count() == 0


def test_one_id_over_many_ranges_and_tasks(spark, tmp_path):
    """A third of the rows share an id and another the null one: rows in are rows out, in one order without gaps."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k % 50} " + "ab " * (k % 9)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    staged = token_output.staged_ids(docs, BYTE, 2, False, 5)
    staged.write.parquet(f"file://{tmp_path}/staged")
    staged = spark.read.schema(token_output.STAGED).parquet(f"file://{tmp_path}/staged")
    # a range is read in several runs, as the splits of a large file are
    runs = staged.filter("row < 200").union(staged.filter("row >= 200 and row < 450")).union(staged.filter("row >= 450"))
    freq = rans.frequencies(np.bincount([r["id"] for r in token_output.counted_ids(staged).collect()]))
    token_output.coded_groups(runs, freq, 300).write.parquet(f"file://{tmp_path}/a/groups")
    spark.createDataFrame([(k, int(n)) for k, n in enumerate(freq) if n], "id int, freq int").write.parquet(f"file://{tmp_path}/a/table")
    groups = spark.read.schema(token_output.GROUPS).parquet(f"file://{tmp_path}/a/groups").drop("data").collect()
    assert len({(g["segment"], g["group"]) for g in groups}) == len(groups) and len({g["segment"] for g in groups}) > 5
    got = token_output.read_ids(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert [g["doc_id"] for g in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for g in got:
        assert g["start"] == at
        at += g["n_tokens"]
    crc = lambda t: zlib.crc32(np.array([*library(BYTE, t), 2], "<u4").tobytes())
    known = {t: crc(t) for t in {t for _, t in rows}}
    assert sorted((d or -1, known[t]) for d, t in rows) == sorted((g["doc_id"] or -1, g["ids_crc32"]) for g in got)


def test_plan_uses_each_piece_once():
    counts = {4096: 5, 4000: 3, 96: 2, 50: 7, 1: 400, 2048: 9, 1365: 31, 700: 13}
    combinations = packing.plan(counts, 4096)
    used = {}
    for chosen, times in combinations:
        assert sum(k * n for k, n in chosen) <= 4096
        for k, n in chosen:
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in combinations) <= -(-total // 4096) + 2


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(5)
    for _ in range(50):
        counts = {int(k): int(n) for k, n in zip(rng.integers(2, 40, 6), rng.integers(1, 4, 6), strict=True)}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        room = int(rng.integers(1, 90))
        chosen = packing.fullest(counts, room)
        assert sum(k * n for k, n in chosen) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in chosen)


def test_packing(spark, awkward, nothing):
    rows = packing.packed(awkward, WORD, capacity=256).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r["doc_id"], [*library(WORD, r["text"]), 1])
    bins = {}
    for r in rows:
        own = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == r["length"]
        assert r["start"] == r["piece"] * 256
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(library(WORD, r["text"])) + 1 for r in awkward.collect())
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.packed(nothing, WORD).count() == 0


def test_files_follow_each_other_as_ids_do(spark, tmp_path):
    """Read by name and row, the part files have documents in ascending order and starts without gaps, however the staged ids are split."""
    rows = [(k * 7 % 4001, f"text {k % 50} " + "ab " * (k % 40)) for k in range(4001)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        token_output.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"file://{tmp_path}/a", BYTE, end_id=2, n_shards=6, group_tokens=3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    table = rans.Table(token_output.read_table(spark, f"file://{tmp_path}/a"))
    starts = {r["doc_id"]: r["start"] for r in token_output.read_ids(spark, f"file://{tmp_path}/a").collect()}
    found, at = [], 0
    for part in sorted((tmp_path / "a/groups").glob("part-*.parquet")):
        for r in pq.read_table(part).to_pylist():
            names, sizes, _ = token_output.unpacked(r["data"], table)
            for name, size in zip(names, sizes.tolist(), strict=True):
                assert starts[name] == at
                at += size
            found += names
    assert found == list(range(4001)) and len(list((tmp_path / "a/groups").glob("part-*.parquet"))) == 6


def test_single_documents_from_checkpoints(spark, tmp_path, monkeypatch):
    """Documents anywhere in a group, over several blocks, repeated, null or absent; a decoder starts at the checkpoint before them."""
    rows = [(k, f"text {k} " + "ab cd é " * (k % 30 * 20)) for k in range(300)] + [(77, "again"), (None, "null one"), (400, "long " * 60_000)]
    token_output.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/a", BYTE, end_id=2, n_shards=2, group_tokens=90_000)
    wanted = [0, 77, 150, 299, 400, 999, None]
    got = sorted((repr(r["doc_id"]), r["ids"]) for r in token_output.read_documents(spark, f"file://{tmp_path}/a", wanted).collect())
    assert got == sorted((repr(d), [*library(BYTE, t), 2]) for d, t in rows if d in wanted)
    table = rans.Table(token_output.read_table(spark, f"file://{tmp_path}/a"))
    starts, inner = [], rans.decode

    def watched(blocks, table, from_step=0):
        out = inner(blocks, table, from_step)
        starts.extend(rans.size_of(b) - len(x) for b, x in zip(blocks, out, strict=True))
        return out

    monkeypatch.setattr(rans, "decode", watched)
    for part in (tmp_path / "a/groups").glob("part-*.parquet"):
        for r in pq.read_table(part).to_pylist():
            token_output.some_documents(r["data"], table, {250, 290, 400})
    assert max(starts) > 0
    damaged = bytearray(r["data"])
    damaged[len(damaged) // 2] ^= 1
    with pytest.raises(rans.Damaged):
        token_output.some_documents(bytes(damaged), table, {d for d, _ in rows})
