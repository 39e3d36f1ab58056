import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, personal_data, secret_scan


def plain_secrets(text):
    out = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


SECRETS = ["", "password=abc", "Password: 'abcdefghijkl'", "é漢 token =  \"0123456789abcdef01\" x", "AKIAABCDEFGHIJ12", "AKIAABCDEFGHIJ1234 AKIAZ", "toKen:secret=abcdefghijklmno", "api_key=apikey=zzzzzzzzzzzzzz", "ſecret=abcdefghijklm", "toKen=abcdefghijklm", "deadbeefdeadbee deadbeefdeadbeef0", "x" * 50_000 + " passwd='" + "a" * 20]


@pytest.mark.parametrize("text", SECRETS)
def test_secret_findings(text):
    assert secret_scan.findings(text) == plain_secrets(text)


def test_ledger_scans_a_blob_once(spark, tmp_path, nothing, monkeypatch):
    ledger = f"file://{tmp_path}/ledger"
    rows = [(k, t) for k, t in enumerate([*SECRETS, *SECRETS, None])] + [(3, SECRETS[3]), (None, SECRETS[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("blob", F.lit("clash"))
    got = secret_scan.scan(docs, ledger).collect()
    want = {hashlib.sha256((t or "").encode()).hexdigest(): plain_secrets(t or "") for _, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(x) for x in r["findings"]] == want[r["blob"]]
    held = spark.read.schema(secret_scan.LEDGER).parquet(ledger)
    assert held.count() == len(want)
    secret_scan.scan(docs.limit(9), ledger).collect()
    assert spark.read.schema(secret_scan.LEDGER).parquet(ledger).count() == len(want)
    secret_scan.scan(docs, ledger, rules="2").collect()
    assert spark.read.schema(secret_scan.LEDGER).parquet(ledger).count() == 2 * len(want)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "new token=aaaaaaaaaaaaaa")], "doc_id long, text string"))
    assert secret_scan.scan(more, ledger).count() == len(rows) + 1
    assert spark.read.schema(secret_scan.LEDGER).parquet(ledger).count() == 2 * len(want) + 1
    assert secret_scan.scan(nothing, f"file://{tmp_path}/other").count() == 0


def test_a_blob_that_two_scans_appended_is_read_once(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, SECRETS[2]), (2, SECRETS[2]), (3, "other")], "doc_id long, text string")
    secret_scan.scan(docs, ledger).collect()
    twice = spark.createDataFrame(spark.read.schema(secret_scan.LEDGER).parquet(ledger).collect(), secret_scan.LEDGER)
    twice.write.mode("append").parquet(ledger)
    got = secret_scan.scan(docs, ledger).collect()
    assert sorted((r["doc_id"], len(r["findings"])) for r in got) == [(1, 1), (2, 1), (3, 0)]


def test_base_spans():
    card = "4111 1111 1111 1111"
    text = f"é a.b@mail.example.com, 10.0.0.255 and 10.0.0.256 {card} 4111111111111112 +1 (555) 123-4567 +12 34 1.2.3.4.5.6.7.8"
    got = [(k, text[a:b]) for k, a, b in personal_data.base_spans(text)]
    # the two card numbers are one run of 32 digits, which fails as a whole
    assert got == [("email", "a.b@mail.example.com"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("phone", "+1 (555) 123-4567"), ("phone", "+12 34 1.2.3.4.5.6.7.8")]
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    assert [k for k, *_ in personal_data.base_spans("card " + card)] == ["card"]
    assert personal_data.base_spans("") == []


def test_contexts_find_new_identifiers(spark, nothing):
    rng = random.Random(2)
    fill = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6))
    rows = [(k, f"{fill()} write to user{k}@mail.example.com for more {fill()}", 0) for k in range(30)]
    rows += [(100, f"{fill()} write to ID-99-ABC-77 for more {fill()}", 0), (101, f"{fill()} the part 12345-678 was {fill()}", 0), (102, None, 0), (103, "", 0), (100, f"{fill()} write to ID-99-ABC-77 for more {fill()}", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").select("doc_id", "text")
    got = {r["doc_id"]: r for r in personal_data.detected(docs, ["doc_id", "text"]).select("_kept.doc_id", "text", "base", "added").collect()}
    assert [(s["kind"], got[100]["text"][s["start"] : s["end"]]) for s in got[100]["added"]] == [("context", "ID-99-ABC-77")]
    assert all(not r["added"] for d, r in got.items() if d != 100)
    assert all(len(got[k]["base"]) == 1 for k in range(30))
    clean = {r["doc_id"]: r for r in personal_data.redacted(docs.withColumn("n_chars", F.length("text"))).collect()}
    assert "write to <EMAIL> for more" in clean[3]["text"] and "write to <CONTEXT> for more" in clean[100]["text"]
    assert clean[3]["n_chars"] == len(clean[3]["text"]) and clean[101]["text"] == got[101]["text"] and clean[102]["text"] is None
    assert personal_data.detected(nothing, ["doc_id"]).count() == 0 and personal_data.redacted(nothing).count() == 0


def test_emails_and_addresses_as_the_plain_patterns():
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    rng = random.Random(3)
    for k in range(3000):
        text = "".join(rng.choice("ab1@@..-_é 9" if k % 2 else "12..3 45a") for _ in range(rng.randrange(40)))
        got = personal_data.base_spans(text)
        assert [(a, b) for n, a, b in got if n == "email"] == [m.span() for m in re.finditer(email, text)]
        assert [(a, b) for n, a, b in got if n == "ip"] == [m.span() for m in re.finditer(ip, text) if all(int(x) <= 255 for x in m[0].split("."))]


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " 1", "1" * 1_000_000, "a" * 1_000_000 + "@", "(" * 300_000 + "1" + " ." * 300_000, "a@" * 300_000, "a1 " * 100_000, "x" + ";1a2b3c" * 50_000])
def test_scans_of_long_runs_are_linear(text):
    start = time.perf_counter()
    personal_data.mentions(text, personal_data.base_spans(text))
    assert time.perf_counter() - start < 8


def test_mentions_are_whole():
    text = "call me on (555) 123 4567 now, or 4111 1111 1111 1112; " + "q" * 300 + " ref. A-1234-Z, 12 and user@host"
    got = [text[m["start"] : m["end"]] for m in personal_data.mentions(text, [])]
    assert got == ["(555) 123 4567", "4111 1111 1111 1112", "A-1234-Z", "user@host"]
    assert personal_data.patterns(text, text.index("A-1234"), text.index("A-1234") + 8) == ["L ~ ref", "B ref _ 0", "R 0 and"]


def plainly_scored(edges):
    """Sure patterns and accepted instances, in plain Python."""
    seeds = {i for _, i, s in edges if s}
    of, on = defaultdict(set), defaultdict(set)
    for p, i, _ in edges:
        of[p].add(i)
        on[i].add(p)
    usual = sum(len(on[i]) for i in seeds) / len(seeds)
    negative = {i for i, x in on.items() if len(x) >= personal_data.NEGATIVE_SPREAD * usual and i not in seeds}
    positive, sure = set(seeds), {}
    for _ in range(personal_data.ROUNDS):
        sure = {}
        for p, held in of.items():
            pos, neg = len(held & positive), len(held & negative)
            n = pos + neg + personal_data.UNKNOWN_WEIGHT * (len(held) - pos - neg)
            if pos >= personal_data.SUPPORT:
                x = pos / n
                low = (x + 1 / (2 * n) - math.sqrt(x * (1 - x) / n + 1 / (4 * n * n))) / (1 + 1 / n)
                if low >= personal_data.MIN_CONFIDENCE:
                    sure[p] = low
        for i, own in on.items():
            if 1 - math.prod(max(1 - sure[p], 1e-9) for p in own if p in sure) >= personal_data.MIN_CONFIDENCE and sum(p in sure for p in own) >= personal_data.MIN_SHARE * len(own):
                positive.add(i)
                negative.discard(i)
    return set(sure), positive


@pytest.mark.parametrize("copies", [1, 10])
def test_identifiers_are_found_at_any_size(spark, copies):
    """An identifier beside a sure pattern is marked there and in up to 20 other contexts; years in as many aren't, whatever the copies."""
    rng = random.Random(8)
    fill = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    around = lambda x: f"{fill()} {fill()} {x} {fill()} {fill()}"
    rows = [around(f"write to user{k}@mail.example.com") for k in range(40)]
    want = []
    for k, others in enumerate((0, 4, 9, 14)):
        rows += [around(f"write to ID-{k}-ABC-77")] + [around(f"ID-{k}-ABC-77") for _ in range(others)]
        want += [f"ID-{k}-ABC-77"] * (1 + others)
    rows += [around("2020-21") for _ in range(60)] + [around("write to 2020-21")]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows * copies)], "doc_id long, text string")
    found = [r["text"][s["start"] : s["end"]] for r in personal_data.detected(docs, ["doc_id", "text"]).select("text", "added").collect() for s in r["added"]]
    assert sorted(found) == sorted(want * copies)


def test_masks_in_one_pass():
    text = "a b@c.de f +12 345 678 g" + " x1@y.zz" * 200_000
    spans = [(a, b, "email") for a, b in personal_data.emails(text)] + [(11, 22, "phone"), (13, 16, "context")]
    start = time.perf_counter()
    out = personal_data.masked(text, spans)
    assert out == "a <EMAIL> f <PHONE> g" + " <EMAIL>" * 200_000 and time.perf_counter() - start < 3


def test_second_round_patterns_find_identifiers(spark):
    """Seeds give the first pattern, what it finds gives the second, and that one identifiers no seed stands by."""
    rng = random.Random(5)
    fill = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = [f"{fill()} {fill()} write to user{k}@mail.example.com {fill()} {fill()}" for k in range(40)]
    rows += [f"{fill()} {fill()} write to ID-{k}-ABC-77 {fill()} {fill()}" for k in range(12)]
    rows += [f"{fill()} {fill()} customer number ID-{k}-ABC-77 {fill()} {fill()}" for k in range(12)]
    rows += [f"{fill()} {fill()} customer number 7{k}0 555 12{k} {fill()} {fill()}" for k in range(3)]
    rows += [f"{fill()} {fill()} since 2020-21 {fill()} {fill()}" for _ in range(40)] + [f"{fill()} {fill()} write to 2020-21 {fill()} {fill()}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["added"]] for r in personal_data.detected(docs, ["doc_id", "text"]).select("_kept.doc_id", "text", "added").collect()}
    assert [got[k] for k in range(64, 67)] == [[f"7{k}0 555 12{k}"] for k in range(3)]
    assert all(got[40 + k] == got[52 + k] == [f"ID-{k}-ABC-77"] for k in range(12)) and not any(got[k] for k in range(67, 108))
    edges = defaultdict(bool)
    for t in rows:
        for m in personal_data.mentions(t, personal_data.base_spans(t)):
            for p in m["patterns"]:
                edges[p, m["instance"]] |= m["seed"]
    edges = [(p, i, s) for (p, i), s in edges.items()]
    sure, positive = personal_data.scored(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), common.Scratch(spark, "test"))
    assert ({r[0] for r in sure.collect()}, {r[0] for r in positive.collect()}) == plainly_scored(edges)
