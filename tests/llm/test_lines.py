import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tokens(line):
    words = line.split(" ")
    return (len(words) >= 12, words if len(words) >= 12 else line)


def most(a, b):
    """Edits allowed between two lines' tokens; None if they are of different kinds."""
    n = min(len(a[1]), len(b[1]))
    if a[0] != b[0]:
        return None
    return max(1, min(30, (n + 1) // 20 - 1)) if a[0] else 0 if n < 16 else 1 if n < 32 else 2


def linked(a, b):
    k = most(a, b)
    return bool(k) and abs(len(a[1]) - len(b[1])) <= k and distance(a[1], b[1]) <= k


def brute(rows):
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    found = sorted({x for _, t in docs for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)})
    label = {x: x for x in found}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    split = [tokens(x) for x in found]
    for i, a in enumerate(split):
        for j in range(i):
            b = split[j]
            k = most(a, b)
            if k and abs(len(a[1]) - len(b[1])) <= k and sum((Counter(a[1]) - Counter(b[1])).values()) <= k and distance(a[1], b[1]) <= k:
                label[find(found[i])] = find(found[j])
    return {x: find(x) for x in found}


def kept_texts(rows, classes, order):
    seen, out = set(), {}
    for d, t in order:
        left = []
        for x in (t or "").split("\n"):
            c = classes.get(x)
            if c is None or c not in seen:
                left.append(x)
            seen.add(c) if c is not None else None
        out[d, t] = None if t is None else "\n".join(left)
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, line string, n_lines int")
    ids = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").distinct().collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, ids[r[1]]))
    want = kept_texts(rows, brute(rows), order)
    got = lines.dedup_lines(docs).collect()
    assert sorted(((r.row.doc_id, r.row.text, r.kept_text) for r in got), key=str) == sorted(((d, t, want[d, t]) for d, t in rows), key=str)
    for r in got:
        assert r.n_lines - r.n_removed == (0 if r.kept_text is None else r.kept_text.count("\n") + 1) or r.kept_text == ""
    return got


def test_edits_match_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(14, 60))) for _ in range(8)] + [" ".join(rng.choice("abcdé") * rng.randrange(1, 4) for _ in range(rng.randrange(12, 60))) for _ in range(8)]
    pool = list(base)
    for b in base:
        for _ in range(14):
            x = list(b)
            for _ in range(rng.randrange(4)):
                p = rng.randrange(len(x))
                x[p : p + rng.randrange(2)] = rng.choice(["", "z", "yy"[: rng.randrange(3)]])
            pool.append("".join(x))
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    got = check(spark, rows)
    assert sum(r.n_near for r in got) > 20


def test_documents_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").limit(120).collect()]
    check(spark, rows)


def test_edge_rows(spark):
    x = "a line that is long enough to be compared with others"
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, x), (4, x), (5, x + "!"), (None, x), (6, f"{x}\n{x}\nshort\nshort"), (4, "short"), (7, "q " * 40_000), (8, "\n" * 3000 + x), (9, "short\r")]
    got = check(spark, rows)
    assert {r.row.doc_id for r in got if r.emptied} == {5, None, 6, 8}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(docs).collect() == []


@pytest.mark.parametrize("crowd", [lines._GROUP, 0])
def test_links_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "_GROUP", crowd)
    rng = random.Random(5)
    pool = set()
    for n in [11, 12, 13, 37, 38, 39, 40, 41, 58, 59, 60, 78, 79, 80, 120, 160, 161]:
        base = [rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(n)]
        k = max(1, (n + 1) // 20 - 1)
        pool.add(" ".join(base))
        for edits in (1, k, k, k, k + 1, k + 2):
            x = list(base)
            # spread out evenly, which leaves the shortest runs, or anywhere
            for p in [n * (2 * i + 1) // (2 * edits) for i in range(edits)][::-1] if rng.random() < 0.5 else sorted(rng.sample(range(n), edits), reverse=True):
                x[p : p + 1] = rng.choice([["new"], [], ["new", x[p]]])
            pool.add(" ".join(x))
    for n in [15, 16, 20, 31, 32, 33, 60]:
        base = "".join(rng.choice("abcdefghé") for _ in range(n))
        pool.add(base)
        for edits in (1, 1, 2, 2, 3):
            x = list(base)
            for p in sorted(rng.sample(range(n), edits), reverse=True):
                x[p : p + 1] = rng.choice([["Q"], [], ["Q", x[p]]])
            pool.add("".join(x))
    rows = spark.createDataFrame([(x,) for x in pool], "line string").selectExpr("line", "xxhash64(line) id")
    ids = {r.id: tokens(r.line) for r in rows.collect()}
    want = {(a, b) for a in ids for b in ids if a > b and linked(ids[a], ids[b])}
    assert len(want) > 60

    def classes(links):
        label = {i: i for i in ids}
        for _ in ids:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    got = {(r.a, r.b) for r in lines.near_links(rows).collect()}
    assert got <= want and classes(got) == classes(want)


def test_banded_distance(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        n, k = rng.randrange(12, 90), rng.randrange(1, 11)
        a = [rng.randrange(4) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(k + 3)):
            p = rng.randrange(len(b))
            b[p : p + 1] = rng.choice([[9], [], [9, b[p]]])
        rows.append((a, b, k))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, k int").select("a", "b", "k", lines.within("a", "b", F.col("k")).alias("near")).collect()
    assert all(r.near == (distance(r.a, r.b) <= r.k) for r in got)
    assert 100 < sum(r.near for r in got) < 400


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:p] + [f"x{i}"] + base[p + 1 :])) for i, p in enumerate([7, 20, 33, 50] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.row.doc_id for r in lines.dedup_lines(docs).collect() if not r.n_removed} == {0}


def test_query_drops_a_line_with_words_replaced(spark, tmp_path):
    from factloom.llm.queries import op4_lines

    x = "a notice of two hundred characters and some more that stands at the end of many pages of the site, in which the one who copied it has put another name, or a date, where the first had been, and no more"
    rows = [(1, x + " and " + x), (2, (x + " and " + x).replace("notice", "caution")), (3, "a line of under 32 chars"), (4, "a line of under 32 char")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_near for r in op4_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
