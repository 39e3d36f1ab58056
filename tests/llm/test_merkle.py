"""The manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from siltstone.llm import common, merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its steps as (before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, own in enumerate(at):
            start = own - own % 3
            steps[k].append(("".join(nodes[start:own]), "".join(nodes[own + 1 : start + 3])))
        nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [x // 3 for x in at]
    return nodes[0], steps


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = own, *tree([leaf(r) for r in own])
    root, tops = tree([built[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        own, subroot, steps = built[s]
        for r, inner in zip(own, steps, strict=True):
            changed = r
            if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                changed = (*r[:4], r[4].replace("\n", ""))
            cur = leaf(changed)
            for a, b in [*inner, *top]:
                cur = digest(a, cur, b)
            proof = digest(*(a + b for a, b in [*inner, *top]))
            out.append((r[0], leaf(r), subroot, root, proof, cur, cur == root))
    return sorted(out, key=repr)


def got(spark, tmp_path, rows, levels, schema="doc_id long, source string, lang string, n_chars long, text string", more=()):
    path = str(tmp_path / f"docs-{levels}")
    spark.createDataFrame([(*r, *more) for r in rows], schema).repartition(4).write.parquet(path)
    return sorted(map(tuple, merkle.manifest(spark.read.parquet(path), common.Scratch(spark, "test"), levels).collect()), key=repr)


ROWS = [(k, "hot" if k % 3 else f"s{k % 7}é", "en", k, f"line {k}\nnext ü\n" * (k % 4)) for k in range(130)]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_rounds_of_any_depth(spark, tmp_path, levels):
    """Buckets of 3, 9 and 2187 leaves give one tree: several rounds, two and one."""
    rows = got(spark, tmp_path, ROWS, levels)
    assert rows == expected(ROWS)
    assert {r[-1] for r in rows} == {True, False}


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a", "en", 1, ""), (3, None, "en", 2, "x\n"), (5, "a", "en", 1, "t" * 90_000 + "\n"), (5, "a", "en", 1, "other"), (5, "a", "en", 1, "other"), (6, "ü", None, 0, "z"), (7, "Z", "de", 1, None)]
    want = expected(rows)
    assert got(spark, tmp_path, rows, 1, "doc_id long, source string, lang string, n_chars long, text string, place string, tree int, size long, digest string", ("p", 1, 2, "d")) == want
    assert got(spark, tmp_path, rows, 2) == want


def test_one_row_and_none(spark, tmp_path):
    own = (1, "a", "en", 1, "x")
    only = leaf(own)
    assert got(spark, tmp_path, [own], 3) == [(1, only, only, only, digest(""), only, True)]
    assert got(spark, tmp_path / "none", [], 3) == []
