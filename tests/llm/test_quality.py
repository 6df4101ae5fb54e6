import random
import re
from collections import Counter

from factloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    n = len(words)
    return (n, len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert tuple(got[r.doc_id][c] for c in COLUMNS) == brute(r.text)
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(q, got[d].kept) for d, q in label.items() if d in got]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    print("kept of good", sum(good) / len(good), "rejected of bad", 1 - sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.02
    # but for what the base rule rejects, all that is labelled good stays
    assert all(got[d].kept or got[d].base_failed for d, q in label.items() if q and d in got)
    # the posterior is not the rule that every vote must pass
    assert any(r.kept and r.n_rejects for r in got.values())
    assert got[rows[0].doc_id].asDict().keys() == {*COLUMNS, "doc_id", "kept", "quality", "n_rejects", "text_id"}


def brute_posterior(votes, rounds):
    """Expectation-maximisation over single documents, with the same counts to start from."""
    good = [0.95 if sum(v) >= 0 else 0.05 for v in votes]
    for _ in range(rounds):
        a, b = sum(good), len(good) - sum(good)
        new = []
        for v in votes:
            x, y = (a + 1) / (a + b + 2), (b + 1) / (a + b + 2)
            for j, vote in enumerate(v):
                same = [g for g, u in zip(good, votes) if u[j] == vote]
                x *= (sum(same) + 1) / (a + 3)
                y *= (len(same) - sum(same) + 1) / (b + 3)
            new.append(x / (x + y))
        good = new
    return good


def test_fit_matches_brute_force():
    rng = random.Random(3)
    votes = []
    for _ in range(300):
        bad = rng.random() < 0.3
        votes.append(tuple(rng.choice([-1, -1, -1, 0, 1]) if bad and j < 3 else rng.choice([-1, 0, 0, 1, 1]) for j in range(5)))
    prior, weights = quality.fit(sorted(Counter(votes).items()), rounds=8)
    want = brute_posterior(votes, 8)
    for v, p in zip(votes, want):
        assert abs(quality._logistic(prior + sum(weights[j][x] for j, x in enumerate(v))) - p) < 1e-9


def test_accuracies_are_learned_from_agreement():
    """A rule that votes at random against three that agree gets little weight."""
    rng = random.Random(8)
    votes = []
    for _ in range(2000):
        good = rng.random() < 0.7
        votes.append((*(1 if good == (rng.random() < 0.9) else -1 for _ in range(3)), rng.choice([1, -1])))
    _, weights = quality.fit(sorted(Counter(votes).items()))
    gain = [w[1] - w[-1] for w in weights]
    assert min(gain[:3]) > 3 and abs(gain[3]) < 0.5


def test_edge_rows(spark):
    texts = [None, "", " \t\n", "a b c a b c a b c", "one\r\ntwo\x0bthree\x0cfour", "x\n\nx\n \nx", "é#$ " * 60, "w " * 30_000, "a\x85b c　d"]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)] + [(None, "p q r", "z", 1), (3, texts[3], "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int")
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in quality.judge(docs).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, *_ in rows), key=str)
    assert quality.judge(docs.limit(0)).collect() == []
