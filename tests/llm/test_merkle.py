"""The manifest against a plain computation of the same trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.merkle import manifest

from frames import DOCS


def documents(spark, rows):
    return spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def climb(nodes):
    """(root, sibling lists of every node from below) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append((run[: k % 16], run[k % 16 + 1 :]))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[s] = own, *climb([leaf_of(r, r[4]) for r in own])
    root, upper = climb([trees[s][1] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            path = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            up = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4])
            for before, after in path:
                up = h(*before, up, *after)
            proof = h(*[d for before, after in path for d in before + after])
            out.append((r[0], leaf_of(r, r[4]), subroot, root, proof, up, up == root))
    return sorted(out, key=str)


def result(df):
    got = manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(n, source):
    return [(i, source, "en", 5, f"Text {i}") for i in range(n)]


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (1, 2), (300, 16, 1, 33)])
def test_trees_of_all_heights(spark, sizes):
    rows = [(r[0] * 7 + k, *r[1:]) for k, n in enumerate(sizes) for r in made(n, f"s{k}")]
    assert result(documents(spark, rows)) == brute(rows)


def test_many_sources_make_an_upper_tree(spark):
    rows = [(i, f"s{i % 40}" if i % 41 else None, None, i, "A" * (i % 3)) for i in range(200)]
    assert result(documents(spark, rows)) == brute(rows)


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "en", 0, ""), (5, "", "en", 0, ""), (5, "", "de", 0, None), (5, "é", None, 3, "ÄB" * 40_000), (-3, "z", "en", 1, "Q"), (6, "z", "en", 1, "q")]
    got = result(documents(spark, rows))
    assert got == brute(rows)
    assert all(v for r in got for v in r[1:6])


def test_extra_columns_and_empty_table(spark):
    rows = made(20, "s")
    df = documents(spark, rows)
    clash = df
    for c in ("tree", "idx", "n", "at", "part", "digest", "children", "path", "run", "level", "tampered", "leaf", "root"):
        clash = clash.withColumn(c, F.lit("x"))
    assert result(clash) == brute(rows)
    assert result(df.limit(0)) == []


def test_rows_in_another_order_give_one_root(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Word {i}") for i in range(100)]
    assert result(documents(spark, rows[::-1]).repartition(7)) == brute(rows)
