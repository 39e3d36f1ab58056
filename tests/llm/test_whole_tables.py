"""Queries over the smallest tables against plain Python or their SQL."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import regex

from siltstone.llm import decontaminate, personal_data, secret_scan
from siltstone.llm import tokens as vocabularies
from siltstone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def tokens(text):
    """Canonical tokens, one at a time."""
    out = []
    plain = regex.sub(r"(?<=[\p{L}\p{N},;)\"'] )(?=\p{Lu}\p{Ll})", "\x02", text or "")
    for t in regex.findall(r"[^ \t-\r]+", "".join(c for c in plain if c not in decontaminate.PUNCTUATION)):
        low = t.lower()
        m = regex.fullmatch(r"[0-9]+(.*)", low)
        if t[0] == "\x02":
            out.append(("\x01name", t))
        elif m and m[1] in ("", *decontaminate.UNITS):
            out.append(("\x01number" + ("unit" if m[1] else ""), t))
        else:
            out.append(("\x01unit" if low in decontaminate.UNITS else low, t))
    return out


def test_decontamination_over_whole_tables(spark):
    windows = defaultdict(list)
    sizes = {}
    for item in table("benchmark"):
        own = tokens(item["text"])
        sizes[item["item_id"]] = len(own)
        for k in range(len(own) - 7):
            if sum(not c.startswith("\x01") for c, _ in own[k : k + 8]) >= 4:
                windows[tuple(c for c, _ in own[k : k + 8])].append((item["item_id"], k))
    assert min(sizes.values()) >= 8 and not any(c.startswith("\x01") for item in table("benchmark") for c, _ in tokens(item["text"]))
    want = set()
    for doc in table("documents"):
        own, covered = [c for c, _ in tokens(doc["text"])], defaultdict(set)
        for k in range(len(own) - 7):
            for item, at in windows.get(tuple(own[k : k + 8]), ()):
                covered[item] |= set(range(at, at + 8))
        want |= {(doc["doc_id"], i) for i, x in covered.items() if 2 * len(x) >= sizes[i] or len(x) >= 13}
    assert want and {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_decontamination"](spark, SF).collect()} == want


def test_scans_over_whole_tables(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    for name, find, kinds in (("op4_secret_scan", secret_scan.findings, secret_scan.KINDS), ("op6_personal_data", personal_data.base_spans, personal_data.KINDS)):
        rows = QUERIES[name](spark, SF).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
        for r in rows:
            found = find(texts[r["doc_id"]])
            assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in found) for k in kinds]
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_shards_over_whole_tables(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table("documents")}
    rows = QUERIES["op2_kd_shards"](spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(d, len(t) + 16, zlib.crc32(t)) for d, t in texts.items()}
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(abs(x - sum(sizes.values()) / 40) for x in sizes.values()) <= max(r["size"] for r in rows)


def plain(value):
    return ("nan" if math.isnan(value) else repr(round(value, 9))) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in got.fetchall())


def library_ids(name, end):
    encode = vocabularies.encoder(vocabularies.vocabulary(name), name == "word_bpe_49k.json").whole.encode
    return {r["doc_id"]: [*encode(r["text"] or "", add_special_tokens=False).ids, *end] for r in table("documents")}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_queries_equal_the_library(spark):
    ids = library_ids("byte_bpe_50k.json", [2])
    at = 0
    for r in sorted(QUERIES["op1_token_output"](spark, SF).collect(), key=lambda r: r["doc_id"]):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), crc(own))
        at += len(own)
    assert at == sum(map(len, ids.values()))
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in table("documents")}
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    assert counted == {d: (sizes[d], len(x) - 1, len(x) - 1 > 1024) for d, x in ids.items()}


def test_packing_query_equals_the_library(spark):
    ids = library_ids("word_bpe_49k.json", [1])
    rows, bins, seen = QUERIES["op5_packing"](spark, SF).collect(), defaultdict(list), Counter()
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(own) == r["length"] and r["ids_crc32"] == crc(own)
        seen[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {d: len(x) for d, x in ids.items()}
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(bins) <= -(-sum(seen.values()) // 4096) + 1
