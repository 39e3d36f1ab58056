"""Downloads, caches and hashes against a server on this machine."""

import hashlib
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone.sources import cache, remote, web

BODIES = {f"/f{k}.bin": bytes(range(256)) * (k * 700 + 1) for k in range(6)} | {"/a.xml": b"<article/>"}


class Handler(BaseHTTPRequestHandler):
    asked: Counter = Counter()

    def do_GET(self):  # noqa: N802
        path = self.path.partition("?")[0]
        Handler.asked[path] += 1
        if path == "/flaky" and Handler.asked[path] < 3:
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        body = BODIES.get(path, b"flaky" if path == "/flaky" else None)
        self.send_response(200 if body is not None else 404)
        if body is not None:
            self.send_header("Content-Type", "application/x-test")
            self.send_header("Content-Length", str(len(body) * (2 if "short" in self.path else 1)))
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


@pytest.fixture()
def folder(tmp_path):
    return tmp_path / "files"


def download(spark, rows, folder, **options):
    spark.dataSource.register(remote.Downloads)
    df = spark.createDataFrame(rows, "url string, filename string, role string, retrieval_command string").repartition(3)
    df.write.format("downloads").option("path", str(folder)).options(**options).mode("append").save()


def left(folder):
    return sorted(p for p in folder.rglob("*") if p.is_file()) if folder.exists() else []


def test_downloads_with_hashes(spark, server, folder):
    rows = [(f"{server}{p}", "same.bin" if k % 2 else p[1:], "trajectory", "get") for k, p in enumerate(BODIES)] + [(f"{server}/flaky", "flaky.txt", None, None)]
    download(spark, rows, folder)
    got = {r["source_uri"]: r for r in remote.read_downloads(spark, str(folder)).collect()}
    assert set(got) == {r[0] for r in rows}
    for path, body in BODIES.items():
        r = got[f"{server}{path}"]
        assert (r["byte_size"], r["sha256"], r["content_type"], r["role"]) == (len(body), hashlib.sha256(body).hexdigest(), "application/x-test", "trajectory")
        with open(r["local_path"], "rb") as f:
            assert f.read() == body
    assert got[f"{server}/flaky"]["byte_size"] == 5 and not (folder / "_temporary" / "x").exists()
    # a second job adds to the first; damage and loss are found
    download(spark, [(f"{server}/a.xml", "again.xml", "article", None)], folder)
    assert remote.read_downloads(spark, str(folder)).count() == len(rows) + 1
    manifest = remote.read_downloads(spark, str(folder))
    assert remote.damaged(spark, manifest).count() == 0
    with open(got[f"{server}/f3.bin"]["local_path"], "ab") as f:
        f.write(b"x")
    import os

    os.remove(got[f"{server}/f4.bin"]["local_path"])
    assert {r["source_uri"] for r in remote.damaged(spark, manifest).collect()} == {f"{server}/f3.bin", f"{server}/f4.bin"}


@pytest.mark.parametrize(("bad", "options"), [("/none", {}), ("/f5.bin", {"max_bytes": "500000"}), ("/f1.bin?short", {})])
def test_a_failing_task_leaves_nothing(spark, server, folder, bad, options):
    """A missing file, one over the limit, and one that ends early: the job fails and no file of any task is left or seen."""
    rows = [(f"{server}{p}", p[1:], None, None) for p in ("/f0.bin", "/f1.bin", "/a.xml")] + [(f"{server}{bad}", "bad", None, None)]
    with pytest.raises(Exception, match=r"404|max_bytes|bytes"):
        download(spark, rows, folder, **options)
    assert left(folder) == []


def test_names_that_leave_the_folder(spark, server, folder):
    for name in ("../x", "", "..", "a/b"):
        with pytest.raises(Exception, match="not a file name"):
            download(spark, [(f"{server}/a.xml", name, None, None)], folder)
    download(spark, [], folder)
    assert left(folder) == []


def test_second_run_asks_nothing(spark, server, tmp_path):
    own = cache.ContentCache(spark, f"file://{tmp_path}/cache")
    keys = spark.createDataFrame([(f"{server}{p}",) for p in [*BODIES, "/none"]] + [(None,), (f"{server}/a.xml",)], "key string")
    Handler.asked.clear()
    first = {r["key"].removeprefix(server): (r["status"], r["content"]) for r in own.through(keys, web.fetched).collect()}
    assert {k: (s, bytes(c)) for k, (s, c) in first.items()} == {p: (200, b) for p, b in BODIES.items()} | {"/none": (404, b"")}
    assert set(Handler.asked.values()) == {1}
    Handler.asked.clear()
    again = {r["key"].removeprefix(server): (r["status"], r["content"]) for r in own.through(keys, web.fetched).collect()}
    assert again == first and not Handler.asked
    more = keys.union(spark.createDataFrame([(f"{server}/flaky?1",), ("http://127.0.0.1:1/",)], "key string"))
    rows = {r["key"]: r["status"] for r in own.through(more, web.fetched).collect()}
    assert rows["http://127.0.0.1:1/"] is None and sum(Handler.asked.values()) == 1 and len(own.batches()) == 2


def test_damage_is_fetched_anew(spark, server, tmp_path):
    own = cache.ContentCache(spark, f"file://{tmp_path}/cache")
    keys = spark.createDataFrame([(f"{server}/f{k}.bin",) for k in range(6)], "key string")
    own.through(keys, web.fetched, "one")
    stored = own._stored()
    # an entry whose content changed, and one filed under another's hash
    wrong = stored.withColumn("content", F.when(F.col("key").endswith("f2.bin"), F.lit(b"other")).otherwise(F.col("content"))).withColumn("key", F.when(F.col("key").endswith("f3.bin"), F.lit("elsewhere")).otherwise(F.col("key")))
    wrong.write.partitionBy("batch", "prefix").parquet(f"file://{tmp_path}/damaged")
    bad = cache.ContentCache(spark, f"file://{tmp_path}/damaged")
    assert {r["key"][-6:-4] for r in bad.missing(keys).collect()} == {"f2", "f3"}
    Handler.asked.clear()
    rows = {r["key"]: bytes(r["content"]) for r in bad.through(keys, web.fetched).collect()}
    assert Handler.asked == {"/f2.bin": 1, "/f3.bin": 1}
    assert all(rows[f"{server}{p}"] == b for p, b in BODIES.items() if p != "/a.xml")
    bad.compact()
    assert len(bad.batches()) == 1 and bad.missing(keys).count() == 0 and bad._stored().count() == 6


def test_batches_are_idempotent_and_reads_are_pruned(spark, tmp_path):
    own = cache.ContentCache(spark, f"file://{tmp_path}/cache")
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(200).alias("status"), F.concat(F.lit("v"), "id").cast("binary").alias("content"))
    assert own.append(rows, "a") and not own.append(rows, "a") and own.append(rows.limit(5), "b")
    one = spark.createDataFrame([("k7",), ("absent",)], "key string")
    assert [(r["key"], bytes(r["content"])) for r in own.lookup(one).collect()] == [("k7", b"v7")]
    prefixes = {hashlib.sha256(k.encode()).hexdigest()[:2] for k in ("k7", "absent")}
    opened = own._stored(sorted(prefixes)).select(F.col("_metadata.file_path")).distinct().collect()
    assert len(opened) <= 4 and all(any(f"prefix={p}" in r[0] for p in prefixes) for r in opened)
    plan = own._stored(sorted(prefixes))._jdf.queryExecution().executedPlan().toString()
    assert "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    empty = cache.ContentCache(spark, f"file://{tmp_path}/nothing")
    assert empty.lookup(one).count() == 0 and empty.missing(one).count() == 2


def test_article_snapshots(spark, server, tmp_path):
    own = cache.ArticleCache(spark, f"file://{tmp_path}/articles")
    entries = spark.createDataFrame([("pmc12", 200, bytearray(b"<a/>"))], "key string, status int, content binary")
    assert own.append(entries)
    plan = spark.createDataFrame([("PMC12",), ("PMC13",)], "document_id string")
    assert [(r["document_id"], r["sha256"]) for r in own.articles(plan).collect()] == [("PMC12", hashlib.sha256(b"<a/>").hexdigest())]
    for name in ("../PMC1", "PMC", None):
        with pytest.raises(Exception, match="not an article id"):
            own.append(spark.createDataFrame([(name, 200, bytearray(b"x"))], "key string, status int, content binary"))


def test_hash_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    (tmp_path / "files").mkdir()
    size = 3 * (1 << 30) + 5
    with open(tmp_path / "files" / "big file.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "files" / "small").write_bytes(b"abc")
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in remote.hashed_files(spark, f"file://{tmp_path}/files").collect()}
    want, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(block)
    want.update(bytes(size & ((1 << 20) - 1)))
    assert got == {"big file.bin": (size, want.hexdigest()), "small": (3, hashlib.sha256(b"abc").hexdigest())}
    assert json.dumps(sorted(got))
