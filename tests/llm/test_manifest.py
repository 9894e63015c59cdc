import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tabsynth.llm.manifest import ARITY, PathCopyTree, merkle_manifest, without_line_ends

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, i long, h string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)])


def tree(hashes):
    """Root, and each leaf's runs from the bottom: (run, place in it)."""
    paths, at, row = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(row) > 1:
        runs = [row[k : k + 3] for k in range(0, len(row), 3)]
        for p, i in zip(paths, range(len(hashes)), strict=True):
            p.append((runs[at[i] // 3], at[i] % 3))
            at[i] //= 3
        row = [H(*r) for r in runs]
    return row[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        kept = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = kept, *tree([leaf(r, r[4]) for r in kept])
    root, tops = tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        kept, sub, paths = trees[s]
        for r, path in zip(kept, paths, strict=True):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            proof, h = [], leaf(r, text)
            for run, k in path + top:
                proof += [x for j, x in enumerate(run) if j != k]
                h = H(*run[:k], h, *run[k + 1 :])
            out.append((r[0], leaf(r, r[4]), sub, root, H(*proof), h, h == root))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table():
    rows = [(i, ["hot", "b", None, "ä", "Z"][0 if i % 3 else i // 3 % 5], "en", i, f"line {i}\nend\n" if i % 4 else f"line {i}") for i in range(120)]
    rows += [(7, "hot", None, None, "line\n"), (7, "hot", None, None, "line\n"), (None, None, None, None, None), (None, "hot", "", 0, ""), (500, "alone", "de", 3, "x" * 50_000 + "\n")]
    return [(*r, "user", r[3], "user") for r in rows]


@pytest.mark.parametrize("levels", [2, 7])
def test_equals_brute_force(spark, levels):
    docs = spark.createDataFrame(table(), SCHEMA)
    found = merkle_manifest(docs, without_line_ends(docs), levels=levels)
    assert rows_of(found) == sorted(brute(table()), key=repr)


def test_sizes_at_which_runs_end(spark):
    rows = [(100 * size + i, f"s{size}", "en", 1, f"a\n{i}", "", 0, "") for size in (1, 2, 3, 4, 9, 10, 28) for i in range(size)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(merkle_manifest(docs, without_line_ends(docs), levels=1)) == sorted(brute(rows), key=repr)


def test_empty_table_and_unchanged_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(docs).count() == 0
    docs = spark.createDataFrame(table(), SCHEMA)
    assert merkle_manifest(docs).where("not verified").count() == 0


def test_versions_share_all_nodes_but_ancestors():
    plain = PathCopyTree([H(str(i)) for i in range(40)])
    size, root = len(plain.hashes), plain.root
    one = plain.replaced(root, 17, "x")
    two = plain.replaced(one, 5, "y")
    assert len(plain.hashes) == size + 2 * (plain.depth + 1)
    assert plain.hashes[root] == tree([H(str(i)) for i in range(40)])[0]  # an older version stays as it is
    both = [H(str(i)) for i in range(40)]
    both[17], both[5] = "x", "y"
    assert plain.hashes[two] == tree(both)[0]
    shared = set(plain.kids[root]) & set(plain.kids[one])
    assert len(shared) == len(plain.kids[root]) - 1


def test_copies_are_the_ancestors_of_the_changed_leaf(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    got = merkle_manifest(docs, without_line_ends(docs), copies=True).where("doc_id = 500").first()
    assert got["copies"][-1] == got["folded_root"]
    assert len(got["copies"]) == 1 + 2  # the leaf, which is its source's root, and two levels above six sources
    assert ARITY == 3
    assert merkle_manifest(docs, F.col("text")).where("not verified").count() == 0
