"""Screens of whole plans, the evaluation in one row, and the literature source under Spark against a local server."""

import datetime
import json
import re
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone.operators import articles, comparison, screening
from siltstone.plans import analysis
from siltstone.sources import web

BODY = "<body><sec><title>Simulation methods</title> <p>Molecular dynamics of the protein used GROMACS, a force field and TIP3P in the NPT ensemble at 300 K and 1 bar for 10 ns.</p></sec><sec><title>Results</title><p>none</p></sec></body>"


def xml(body, kind="research-article"):
    return bytearray(f"<article article-type='{kind}'><front><article-title>T</article-title></front>{body}</article>".encode())


def test_a_plan_is_screened_with_failures_apart(spark):
    own = [("PMC1", xml(BODY)), ("PMC2", xml(BODY, "review-article")), ("PMC3", bytearray(b"<a><b></a>")), ("PMC4", None), ("PMC6", xml("<body><p>poems</p></body>")), ("PMC9", xml(BODY))]
    plan = spark.createDataFrame([(f"PMC{k}", "validation" if k % 2 else "development") for k in (1, 2, 3, 4, 5, 6)], "document_id string, split string")
    rows = articles.screened_plan(plan, spark.createDataFrame(own, "document_id string, content binary"))
    got = {r["document_id"]: r for r in rows.collect()}
    assert set(got) == {f"PMC{k}" for k in (1, 2, 3, 4, 5, 6)}
    assert (got["PMC1"]["status"], got["PMC1"]["eligible"], got["PMC1"]["engine_mentions"], got["PMC1"]["method_section_titles"]) == (screening.STRONG, True, ["gromacs"], ["Simulation methods"])
    assert (got["PMC2"]["eligible"], got["PMC6"]["status"], got["PMC6"]["error_type"]) == (False, screening.WEAK, None)
    assert [(got[d]["error_type"], got[d]["status"], got[d]["eligible"]) for d in ("PMC3", "PMC4", "PMC5")] == [("not_well_formed", None, None), ("missing_source", None, None), ("missing_source", None, None)]
    assert got["PMC3"]["message"].startswith("not well-formed") and got["PMC1"]["split"] == "validation"
    r = articles.screen_report(rows).first()
    assert (r["requested_articles"], r["screened_articles"], r["failure_count"], r["machine_eligible_count"]) == (6, 3, 3, 1)
    assert r["status_counts"] == {screening.STRONG: 2, screening.WEAK: 1} and r["engine_mention_counts"] == {"gromacs": 2}
    empty = articles.screen_report(rows.filter("false")).first()
    assert empty["requested_articles"] == 0 and not empty["status_counts"]


def test_the_evaluation_as_one_report(spark):
    kind = "document_id string, event_type string, duration_ps double, temperature_k double"
    p = spark.createDataFrame([("a", "production", 5.0, 300.0), ("a", "heating", 7.0, None), ("b", "production", 5.0, 300.0)], kind)
    r = spark.createDataFrame([("a", "production", 5.0, 300.0), ("a", "equilibration", 7.0, None), ("c", "production", 5.0, 300.0)], kind)
    bounds = spark.createDataFrame([(0.1, 0.9)], "low double, high double")
    out = comparison.report(p, r, bounds).first()
    assert out["article_count"] == 3 and out["article_bootstrap_95_ci_f1"] == [0.1, 0.9] and out["bootstrap_iterations"] == 2000
    assert (out["event_exact"]["tp"], out["event_exact"]["fp"], out["event_exact"]["fn"]) == (1, 2, 2) and out["event_exact"]["f1"] == pytest.approx(1 / 3)
    assert out["duration_phase_confusion"] == {"production": {"production": 1, comparison.MISSED: 1}, "equilibration": {"heating": 1}, comparison.SPURIOUS: {"production": 1}}
    table = {r["reference_phase"]: r for r in comparison.pivoted(comparison.confusion(p, r), ["equilibration", "heating", "production"]).collect()}
    assert table["equilibration"]["heating"] == 1 and table["production"][comparison.MISSED] == 1 and table[comparison.SPURIOUS]["heating"] == 0


ARTICLES = [(f"PMC{k}", datetime.date(2016, 1, 1) + datetime.timedelta(days=k * k % 900)) for k in range(700)]


class Search(BaseHTTPRequestHandler):
    """Cursor-paged results for a query with a range of days; fails some pages once."""

    asked: Counter = Counter()
    broken: set = set()

    def do_GET(self):  # noqa: N802
        args = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        days = re.search(r"\[(\S+) TO (\S+)\]", args["query"])
        found = [a for a, d in ARTICLES if not days or days[1] <= str(d) <= days[2]]
        at, size = (0 if args["cursorMark"] == "*" else int(args["cursorMark"])), int(args["pageSize"])
        if args["resultType"] == "core":
            Search.asked[args["query"], at] += 1
        ok = (args["query"], at) not in Search.broken and (args["resultType"] != "core" or at not in Search.broken)
        self.send_response(200 if ok else 400)
        self.end_headers()
        rows = [{"pmcid": a, "title": f"on {a}", "pubYear": 2016} for a in found[at : at + size]]
        self.wfile.write(json.dumps({"hitCount": len(found), "nextCursorMark": str(at + len(rows)), "resultList": {"result": rows}}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    own = ThreadingHTTPServer(("127.0.0.1", 0), Search)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/search"
    own.shutdown()


def test_literature_through_spark(spark, service, tmp_path):
    spark.dataSource.register(web.Literature)
    read = lambda **o: spark.read.format("literature").options(service=service, query="md", most="10000", **o).load()
    one = read()
    assert one.rdd.getNumPartitions() == 1 and one.count() == 700
    assert spark.read.format("literature").options(service=service, query="md\nmd2", most="150").load().count() == 300
    parts = read(first_year="2015", last_year="2019", part_size="100")
    n = parts.rdd.getNumPartitions()
    assert n >= 7 and sorted(r["pmcid"] for r in parts.collect()) == sorted(a for a, _ in ARTICLES)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 100 and len(sizes) == n
    assert articles.from_search(parts).count() == 700


def test_parts_and_cursors(service, tmp_path):
    parts = web.parts_of("md", 2015, 2019, 100, lambda q: web.hit_count(q, service=service))
    bounds = sorted(re.findall(r"\[(\S+) TO (\S+)\]", " ".join(parts)))
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False)) and all(web.hit_count(p, service=service) <= 100 for p in parts)
    same_day = web.parts_of("md", 2016, 2016, 0, lambda q: 5 if "2016-01-01" in q else 0)  # a day isn't cut further
    assert same_day == ["(md) AND FIRST_PDATE:[2016-01-01 TO 2016-01-01]"]
    # the third page fails; the next attempt asks for it and what follows, not for the first two
    Search.asked.clear()
    Search.broken.add(200)
    kept = web.Cursors(str(tmp_path / "cursors"), "md")
    with pytest.raises(OSError, match="400"):
        list(web.pages("md", 10_000, service=service, kept=kept))
    Search.broken.clear()
    assert len(list(web.pages("md", 10_000, service=service, kept=web.Cursors(str(tmp_path / "cursors"), "md")))) == 700
    assert Search.asked["md", 0] == Search.asked["md", 100] == 1 and Search.asked["md", 200] == 2
    before = sum(Search.asked.values())
    assert len(list(web.pages("md", 10_000, service=service, kept=web.Cursors(str(tmp_path / "cursors"), "md")))) == 700 and sum(Search.asked.values()) == before


def test_report_holds_no_draws(spark):
    """the report's interval once broadcast packed draws through the driver; its plan now has none."""
    plan = analysis.ev_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "times#" not in plan and "MapInArrow" in plan
