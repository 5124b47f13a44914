"""Quality classifier, pivot clusters and spelling variants."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.llm import pivots, pu_quality, queries, spelling

DOCS = "doc_id long, text string, n string, word string, m int, score string, predicted string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "z") for i, t in rows], DOCS)


# Spelling variants

def brute_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute_near(words):
    near, lacking = defaultdict(set), defaultdict(set)
    for word in words:
        for i in range(len(word)):
            rest = word[:i] + word[i + 1 :]
            lacking[i, len(word), rest].add(word)
            if rest in words:
                near[word].add(rest)
                near[rest].add(word)
    for group in lacking.values():
        for word in group:
            near[word] |= group - {word}
    return near


def brute_variants(rows):
    words = brute_words(rows)
    near = brute_near(words)
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= 2 * n else None

    def root(word):
        return root(form[word]) if form[word] else word

    return {
        w: (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w))
        for w, n in words.items()
    }


def found_variants(df):
    rows = df.collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


def test_near_pairs_are_those_of_brute_force():
    rng = random.Random(3)
    for letters in ("ab", "abcd", "éabz"):
        for _ in range(80):
            size = rng.randint(1, 5)
            short, long = (
                sorted({"".join(rng.choice(letters) for _ in range(n)) for _ in range(rng.randint(0, 14))})
                for n in (size, size + 1)
            )
            same, other = spelling.near_pairs(short, long, at_end=True)
            found = [(short[i], short[j]) for i, j in same] + [(short[i], long[j]) for i, j in other]
            near = brute_near({w: 1 for w in short + long})
            expected = {
                (a, b) for a in near for b in near[a]
                if len(a) == size and (len(b) == size + 1 or (len(b) == size and a < b))
            }
            assert len(found) == len(set(found)) and set(found) == expected


def test_acceptors_share_states_of_equal_rests():
    machine = spelling.Acceptors()
    words = sorted(a + b for a in "abcd" for b in ("xyz", "xyw"))
    machine.build(words, 0, len(words), 0)
    assert len(machine.arcs) == 5  # the end, four places


def test_very_long_words_are_compared():
    base = "ab" * 30_000
    same, other = spelling.near_pairs(sorted([base + "a", base + "b"]), [base + "ab"], at_end=True)
    assert same == [(0, 1)] and other == [(0, 0), (1, 0)]


def dense_rows():
    """Words over few letters, so that groups are large and chains long."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(400)]
    weights = [rng.randint(1, 60) for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=120))) for i in range(60)]
    rows += [(500, "Colour COLOUR colour color color ×÷abcde ×÷abcde ×÷abcde")] * 3
    return rows


@pytest.mark.parametrize("group", [4_096, 8, 2])
def test_variants_equal_brute_force(spark, group):
    """Small limits make every key be halved, down to single code points."""
    rows = dense_rows()
    assert found_variants(spelling.variants(frame(spark, rows), group)) == brute_variants(rows)


def test_variants_of_edges(spark):
    long_word = "pneumono" * 4_000
    rows = [
        (None, "hello hello hello"), (1, None), (2, ""), (3, "hella hella hella"), (3, "hella hella hella"),
        (4, f"{long_word} {long_word} {long_word} {long_word}x {long_word}x {long_word}x"),
        (5, "日本語 hello€hello \U0001f600hello"),
    ]
    assert found_variants(spelling.variants(frame(spark, rows))) == brute_variants(rows)
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, "tiny")])).collect() == []


def test_variants_of_the_sample_equal_brute_force(spark, sample_dir):
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet").select("doc_id", "text").collect()
    found = found_variants(queries.queries()["op13_spelling_variants"](spark, sample_dir))
    assert found == brute_variants([tuple(r) for r in docs])
    assert any(v[4] != k and v[2] != v[4] for k, v in found.items())


# Pivot clusters

def brute_clusters(rows, k=40, rounds=5):
    kept = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (
        r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]
    ))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        distances = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        best = min(range(len(distances)), key=lambda n: (distances[n], n))
        return best, distances[best]

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[0]].append(v)
        for n, members in groups.items():
            centroids[n] = [sum(c) // len(members) for c in zip(*members)]
    last = [(i, *nearest(v)) for i, v in kept]
    totals = Counter()
    for _, n, d in last:
        totals[n] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, totals[n], sum(totals.values()), names[n]) for i, n, d in last)


VECTORS = "vec_id long, embedding array<double>, c string, d string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS)


def made_vectors(seed=1, n=300, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (6, 64))
    return [(i, (centres[i % 6] + rng.normal(0, 0.05, 64)).tolist()) for i in range(n)]


def edge_vectors():
    rows = made_vectors(2, 90)
    first = rows[0][1]
    return rows + [
        (None, first), (7, first), (7, rows[7][1]), (7, rows[7][1]), (200, None), (201, []), (202, first[:63]),
        (203, [*first[:63], None]), (204, [*first[:63], math.nan]), (205, [*first[:63], math.inf]),
        (206, [*first[:63], -math.inf]), (207, [*first, 1.0]), (208, [-0.001] * 64), (209, [1e4] * 64),
    ]


@pytest.mark.parametrize("make", [made_vectors, edge_vectors, lambda: made_vectors(3, 12), lambda: []])
def test_clusters_equal_brute_force(spark, make):
    found, _ = pivots.cluster(vectors(spark, make()))
    assert Counter(map(tuple, found.collect())) == brute_clusters(make())


def test_components_beyond_the_bound_are_kept_within_it(spark):
    rows = made_vectors(2, 50) + [(900, [1e300] * 64), (901, [-1e300] * 64)]
    found, _ = pivots.cluster(vectors(spark, rows))
    inside = [(i, [max(min(x, 2**27 / 256), -(2**27) / 256) for x in v]) for i, v in rows]
    assert Counter(map(tuple, found.collect())) == brute_clusters(inside)


def test_bounds_leave_out_far_centroids_and_never_exceed_distances(spark):
    rows = made_vectors(4, 400, 2.0)
    _, clusters = pivots.cluster(vectors(spark, rows))
    assert all(seen == 400 for seen, _ in clusters.work)
    assert sum(m for _, m in clusters.work) < 0.6 * 5 * 400 * 40
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    chosen = pivots.choose_pivots(x[:40], 8)
    bounds = pivots.lower_bounds(
        pivots.pivot_distances(x, chosen), pivots.pivot_distances(x[:40], chosen),
        pivots.pivot_distances(chosen, chosen),
    )
    exact = pivots.squared(x[:, None], x[None, :40])
    assert (bounds <= exact).all() and (bounds > 0.5 * exact).mean() > 0.3


# Quality classifier

def quality_tables(spark, sample_dir):
    return (spark.read.parquet(f"{sample_dir}/{name}.parquet") for name in ("documents", "labels"))


def test_held_out_quality(spark, sample_dir):
    docs, labels = quality_tables(spark, sample_dir)
    scored = pu_quality.score(docs, labels).where("held_out").join(labels, "doc_id")
    rows = scored.select("predicted", "quality", "score").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 40 and right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_and_negative_labels_do_not_matter(spark, sample_dir):
    docs, labels = quality_tables(spark, sample_dir)
    out = pu_quality.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    only_ones = labels.where(F.col("quality") == 1)
    one, two, three = (pu_quality.fit(docs, each) for each in (labels, turned, only_ones))
    for other in (two, three):
        assert one.prior == other.prior and (one.weights == other.weights).all() and one.bias == other.bias


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(0)
    for prior in (0.2, 0.5, 0.9):
        good, bad = rng.normal(2, 1, 4_000), rng.normal(-3, 1, 4_000)
        mixed = np.where(rng.random(4_000) < prior, good, bad)
        assert abs(pu_quality.estimate_prior(rng.normal(2, 1, 4_000), mixed) - prior) < 0.05


def test_risk_falls_to_that_of_the_true_labels():
    """Against a fit on all true labels: nearly the same decisions."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (3_000, 6)), rng.random(3_000) < 0.6
    x[:, 0] += np.where(y, 2.5, -2.5)
    model = pu_quality.fit_arrays(x[y][:800], x)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.97
    assert abs(model.prior - 0.6) < 0.08


def test_quality_of_edges(spark):
    rows = [(i, f"plain words number {i} and so on, as one writes them.") for i in range(60)]
    rows += [(100 + i, f"{i}$$$ ###{i} %%%") for i in range(40)]
    rows += [(None, None), (None, "a b"), (300, ""), (301, None), (302, "word " * 200_000), (1, rows[1][1])]
    docs = frame(spark, rows)
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 1), (2, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    scored = pu_quality.score(docs, labels)
    assert set(scored.columns) == {*docs.columns, "held_out"}
    found = scored.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[3].predicted == 1 and by_id[103].predicted == 0
    assert by_id[300].score == by_id[301].score
    # Every document labelled, and no label to learn from.
    assert {r.score for r in pu_quality.score(docs, labels.where("quality = 0")).collect()} == {0.5}
    assert pu_quality.score(frame(spark, []), labels).collect() == []
    assert {r.predicted for r in pu_quality.score(docs, labels.limit(0)).collect()} == {1}


def test_shapes_are_counted_across_parts(monkeypatch):
    text = "Some text, with 3 marks!! é\n" * 50
    whole = pu_quality.features(text)
    monkeypatch.setattr(pu_quality, "_PART_BYTES", 37)
    assert np.allclose(pu_quality.features(text), whole)
