import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import similarity
from tallyspark.operators import clustering, similarity_join
from tests.conftest import plan_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            row[j + 1], left = (left + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def key(text):
    return " ".join(sorted(text.split()))


def similar(a, b, threshold):
    a, b = key(a), key(b)
    return 200 * lcs(a, b) >= threshold * (len(a) + len(b))


def greedy(freq, threshold):
    """Rank by rank, each remaining text absorbs what is similar to it."""
    pool = sorted(freq, key=lambda d: (-freq[d], d))
    owner = {}
    while pool:
        anchor = pool[0]
        for text in pool:
            if text == anchor or similar(anchor, text, threshold):
                owner[text] = anchor
        pool = [t for t in pool if t not in owner]
    return owner


WORDS = ["uk", "amazon", "card", "tesco", "pay", "store", "ref", "ab", "x", "12", "345", "marks", "é"]


def texts(seed, n):
    rnd = random.Random(seed)
    out = {}
    while len(out) < n:
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.6:
            i = rnd.randrange(len(text))
            text = (text[:i] + rnd.choice("abxyz0 ") + text[i + 1:]).strip()
        if text:
            out[text] = rnd.randint(1, 4)
    return out


def freq_table(spark, freq):
    return spark.createDataFrame(list(freq.items()), "description string, count long")


def members(spark, freq, threshold, front=clustering.FRONT):
    rows = clustering.cluster_members(freq_table(spark, freq), threshold, front).collect()
    assert len(rows) == len(freq) and all(freq[r.description] == r["count"] for r in rows)
    return {r.description: r.anchor for r in rows}


def test_lcs():
    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 40))),
              "".join(rnd.choice("abc é") for _ in range(rnd.randint(0, 40)))) for _ in range(300)]
    pairs += [("kitten", "sitting"), ("", ""), ("a", ""), ("a" * 3000, "a" * 2500 + "b")]
    got = similarity.lcs_lengths(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]), chunk_cells=1000)
    assert list(got) == [lcs(a, b) if len(a) < 100 else 2500 for a, b in pairs]
    assert len(similarity.lcs_lengths(pd.Series([], dtype=str), pd.Series([], dtype=str))) == 0


def test_token_sort(spark):
    df = spark.createDataFrame([(" b  a　c\t",), ("",), ("  ",)], "t string")
    assert [r[0] for r in df.select(similarity.token_sort(F.col("t"))).collect()] == ["a b c", "", ""]


@pytest.mark.parametrize("threshold", [60, 75, 85, 90, 100])
def test_every_similar_pair_is_found(spark, threshold):
    a, b = list(texts(threshold, 90)), list(texts(threshold + 1, 90))
    pairs = similarity_join.similar_pairs(
        spark.createDataFrame([(t,) for t in a], "anchor string"), spark.createDataFrame([(t,) for t in b], "text string"), threshold)
    got = {(r.anchor, r.text): r.score for r in pairs.collect()}
    expected = {(x, y): 200 * lcs(key(x), key(y)) / (len(key(x)) + len(key(y)))
                for x in a for y in b if similar(x, y, threshold)}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_pairs_meet_by_hash_only(spark):
    df = freq_table(spark, texts(1, 20))
    plan = plan_of(similarity_join.similar_pairs(df.select(F.col("description").alias("anchor")),
                                                 df.select(F.col("description").alias("text"))))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        similarity_join.similar_pairs(spark.range(0).select(F.lit("").alias("anchor")),
                                      spark.range(0).select(F.lit("").alias("text")), 0)


@pytest.mark.parametrize("threshold,front,seed", [(85, 500, 1), (75, 500, 2), (60, 500, 3), (85, 6, 4), (100, 500, 5)])
def test_clusters_equal_the_sequential_walk(spark, threshold, front, seed):
    freq = texts(seed, 70)
    freq.update({"amazon uk": 3, "uk amazon": 5, "": 2, "a": 1, "ab": 1, "ba": 1})
    assert members(spark, freq, threshold, front) == greedy(freq, threshold)


def test_clusters_are_not_transitive(spark):
    freq = {"abcdefghij": 9, "abcdefghkl": 5, "abcdefmnkl": 3}
    assert similar("abcdefghij", "abcdefghkl", 80) and similar("abcdefghkl", "abcdefmnkl", 80)
    assert members(spark, freq, 80) == {"abcdefghij": "abcdefghij", "abcdefghkl": "abcdefghij", "abcdefmnkl": "abcdefmnkl"}


def test_a_dense_group_takes_few_rounds(spark, monkeypatch):
    """All texts are similar to each other: one anchor absorbs them without any pair among them."""
    freq = {f"customer number {i:06d}": 1 for i in range(400)}
    rounds = []
    plain = clustering._round
    monkeypatch.setattr(clustering, "_round", lambda *a: rounds.append(1) or plain(*a))
    assert members(spark, freq, 70) == greedy(freq, 70)
    assert len(rounds) <= 4


def test_report(spark):
    rows = spark.createDataFrame(
        [(f"2024-01-{i + 1:02d}", d, 1.0, 0.0, "Aqua", i) for i, d in enumerate(["uk amazon"] * 7 + ["amazon uk", "gym"])]
        + [(None, "gym", 1.0, 0.0, "Aqua", 50)], "date string, description string, paid_out double, paid_in double, source string, ingest_seq int")
    rows = rows.withColumn("date", F.col("date").cast("date"))
    grouped = clustering.cluster_members(clustering.description_freq(rows))
    report = clustering.cluster_report(rows, grouped).collect()
    assert [(r.anchor, r["count"], r.n_aliases, len(r.samples)) for r in report] == [("uk amazon", 8, 2, 5), ("gym", 2, 1, 2)]
    assert [s.date for s in report[1].samples] == ["2024-01-09", ""]
    assert [s.sample_no for s in report[0].samples] == [1, 2, 3, 4, 5]


def test_uncategorized(spark):
    rows = spark.createDataFrame([("Uncategorized", " A b "), ("Uncategorized", None), ("Food", "x"), (None, "y")],
                                 "category string, description string")
    assert [r.description for r in clustering.uncategorized(rows).collect()] == ["a b"]
    assert clustering.uncategorized(rows.drop("category")).count() == 0


def test_a_common_prefix_adds_no_rounds(spark, monkeypatch):
    """Texts that share a prefix but are not similar: rounds don't grow with their number."""
    rounds = {}
    plain = clustering._round
    monkeypatch.setattr(clustering, "_round", lambda *a: rounds.update({n: rounds.get(n, 0) + 1}) or plain(*a))
    for n in (300, 1200):
        rnd = random.Random(n)
        freq = {"zqx " + "".join(rnd.choice("abcdefghijklmnoprstuvwy") for _ in range(8)): 1 for _ in range(n)}
        rows = clustering.cluster_members(freq_table(spark, freq), 85, 100).collect()
        assert len(rows) == n and sum(r.anchor != r.description for r in rows) < n / 20
    assert rounds.get(1200, 0) <= rounds.get(300, 0) + 1 <= 5


def names(n):
    return [f"Customer#{i:09d}" for i in range(n)]


@pytest.mark.parametrize("threshold", [85, 94])
def test_texts_alike_in_most_characters_meet_only_if_similar(spark, threshold):
    """No run of these texts is rare, yet the keys are those of similar texts alone."""
    own = names(150)
    df = spark.createDataFrame([(t,) for t in own], "key string")
    keys = similarity_join.join_keys(df, threshold)
    met = keys.alias("a").join(keys.alias("b"), "element").select("a.key", F.col("b.key").alias("other")).distinct()
    want = {(x, y) for x in own for y in own if similar(x, y, threshold)}
    assert {(r[0], r[1]) for r in met.collect()} == want
    got = similarity_join.similar_pairs(df.withColumnRenamed("key", "anchor"), df.withColumnRenamed("key", "text"), threshold)
    assert {(r.anchor, r.text) for r in got.collect()} == want


@pytest.mark.parametrize("small", [True, False])
def test_a_table_with_itself_is_compared_in_one_order(spark, monkeypatch, small):
    compared = []
    plain = similarity_join.score_pairs
    monkeypatch.setattr(similarity_join, "score_pairs",
                        lambda pairs, *a, **k: compared.extend(map(tuple, pairs.collect())) or plain(pairs, *a, **k))
    monkeypatch.setattr(similarity_join, "is_small", lambda df: small)
    own = [*names(40), "corner shop", "shop corner", "shop  corner", "", None]
    df = spark.createDataFrame([(t,) for t in own + own[:3]], "anchor string")
    found = similarity_join.similar_pairs(df, df.withColumnRenamed("anchor", "text"), 94)
    got = [tuple(r) for r in found.select("anchor", "text").collect()]
    want = {(x, y) for x in own if x for y in own if y and similar(x, y, 94)}
    assert set(got) == want and len(got) == len(want)
    assert compared and all(a <= b for a, b in compared)
    # The pairs are brought to their texts without a shuffle of their own.
    assert not small or plan_of(found).count("Exchange hashpartitioning(key_b") == 0
    one = df.filter("anchor <> 'corner shop'").withColumnRenamed("anchor", "text")
    got = {(r.anchor, r.text) for r in similarity_join.similar_pairs(df, one, 94).collect()}
    assert got == {(x, y) for x, y in want if y != "corner shop"}


def test_rounds_do_not_grow_with_names(spark, monkeypatch):
    rounds = {}
    plain = clustering._round
    monkeypatch.setattr(clustering, "_round", lambda *a: rounds.update({n: rounds.get(n, 0) + 1}) or plain(*a))
    for n in (100, 1000):
        freq = {t: 1 for t in names(n)}
        found = clustering.cluster_members(freq_table(spark, freq), 94, 50).collect()
        if n == 100:
            assert {r.description: r.anchor for r in found} == greedy(freq, 94)
        assert len(found) == n
    assert rounds[1000] <= rounds[100] + 3


@pytest.mark.parametrize("cell", [7, 500])
def test_texts_that_share_most_keys_are_compared_once(spark, monkeypatch, cell):
    used = []
    plain = similarity_join._all_pairs
    monkeypatch.setattr(similarity_join, "_all_pairs", lambda *a: used.append(1) or plain(*a))
    monkeypatch.setattr(similarity_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity_join, "CELL", cell)
    own = [*[f"to supplier#{i * 37:09d}" for i in range(25)], "", "tesco"]
    left, right = ((spark.createDataFrame([(t,) for t in texts], "key string")) for texts in (own, own[5:] + ["other", "tesco"]))
    pairs = [tuple(r) for r in similarity_join.candidate_pairs(left, right, 80).collect()]
    assert used and len(pairs) == len(set(pairs))
    assert {(a, b) for a in own if a for b in own[5:] if b and similar(a, b, 80)} <= set(pairs)
    assert not any(a == "" or b == "" or "tesco" in (a, b) and a != b for a, b in pairs)


@pytest.mark.parametrize("walked, small", [(400_000, True), (30, True), (13, False)])
def test_texts_that_meet_if_similar_are_walked_in_ranges(spark, monkeypatch, walked, small):
    """No pairs are made, whatever the lengths and however many ranges there are."""
    rnd = random.Random(walked)
    own = [f"Customer#{i:09d}" for i in rnd.sample(range(400), 120)] + [f"Customer#{i:010d}" for i in range(0, 300, 7)]
    own += [t + "x" for t in own[::5]] + ["", "a", "ab", "ba", "abc", "7 Customer#00000001", "Customer#00000001 7", "caf\U0001f600", "caf\uffee"]
    freq = {t: rnd.choice([1, 1, 2]) for t in own}
    monkeypatch.setattr(clustering, "WALK_TEXTS", walked)
    monkeypatch.setattr("tallyspark.operators.scale.is_small", lambda df, n=0: small)
    rounds, pairs = [], []
    plain = clustering._round
    monkeypatch.setattr(clustering, "_round", lambda *a: rounds.append(1) or plain(*a))
    monkeypatch.setattr(clustering, "score_pairs", lambda *a: pairs.append(1))
    assert members(spark, freq, 94) == greedy(freq, 94)
    assert len(rounds) == -(-len(freq) // walked) and not pairs


@pytest.mark.parametrize("cell", [7, 2000])
def test_compared_pairs_are_those_that_reach_their_threshold(spark, monkeypatch, cell):
    monkeypatch.setattr(similarity_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity_join, "CELL", cell)
    monkeypatch.setattr(similarity_join, "TABLE_BYTES", 1000)
    rnd = random.Random(cell)
    long = ["".join(rnd.choice("ab") for _ in range(n)) for n in (64, 65, 66, 127, 128, 129, 200)]
    left = [f"to supplier#{i * 37:09d}" for i in range(30)] + [t[:-1] + "c" for t in long] + ["", "caf\U0001f600 x"]
    right = {**{t: 80 for t in left[5:] + long}, **{f"supplier#{i * 11:09d}": 85 for i in range(40)}, "": 80, "caf\U0001f600 y": 80}
    texts = spark.createDataFrame([(t,) for t in left], "key string")
    needs = spark.createDataFrame(list(right.items()) + [(t, 99) for t in right], "key string, need int")
    found = similarity_join.compared_pairs(texts, needs).collect()
    want = {(a, b): round(200 * lcs(a, b) / (len(a) + len(b)), 6) for a in left if a for b, t in right.items() if b and similar(a, b, t)}
    assert {(r.key_a, r.key_b): round(r.score, 6) for r in found} == want and len(found) == len(want)
    pairs = [tuple(r) for r in similarity_join.candidate_pairs(texts, needs.select("key"), 80).collect()]
    assert sorted(pairs) == sorted((a, b) for a in left if a for b in right if b and similar(a, b, 80))


def resolved(spark, monkeypatch, n, edges, not_ready=()):
    """Anchors that ``_resolve`` finds among texts 0..n-1, and how many tables it wrote."""
    written = []
    plain = clustering.cut_lineage
    monkeypatch.setattr(clustering, "cut_lineage", lambda *a: written.append(1) or plain(*a))
    rank = F.struct(F.lit(-1).cast("long").alias("neg"), F.format_string("t%05d", F.col("i")).alias("text"))
    ready = (spark.createDataFrame([(i,) for i in range(n) if i not in not_ready], "i int")
             .select(F.format_string("t%05d", F.col("i")).alias("key"), rank.alias("rank")))
    pairs = spark.createDataFrame([(f"t{a:05d}", f"t{b:05d}") for a, b in edges if a not in not_ready], "key string, lower_key string")
    found = clustering._resolve(ready, pairs.join(ready, "key").select("key", "rank", "lower_key"), [])
    got = sorted(int(r.key[1:]) for r in found.collect())
    monkeypatch.undo()
    return got, len(written)


def test_a_long_chain_is_decided_in_one_go(spark, monkeypatch):
    got, written = resolved(spark, monkeypatch, 400, [(i, i - 1) for i in range(1, 400)])
    assert got == list(range(0, 400, 2)) and written <= 4


@pytest.mark.parametrize("rows", [40, 4_000_000])
def test_ranges_agree_with_the_sequential_walk(spark, monkeypatch, rows):
    monkeypatch.setattr(clustering, "RANGE_ROWS", rows)
    rnd = random.Random(rows)
    edges = sorted({(max(p), min(p)) for p in ((rnd.randrange(80), rnd.randrange(80)) for _ in range(120)) if p[0] != p[1]})
    not_ready = {7, 31}
    status = {}
    for i in range(80):
        lower = [status[b] for a, b in edges if a == i]
        status[i] = ("open" if i in not_ready else "covered" if "anchor" in lower
                     else "anchor" if all(s == "covered" for s in lower) else "open")
    got, _ = resolved(spark, monkeypatch, 80, edges, not_ready)
    assert got == [i for i in range(80) if status[i] == "anchor"]


@pytest.mark.parametrize("threshold", [50, 85, 97, 100])
def test_length_plan_covers_every_pair(threshold):
    """Texts of any two lengths that may be similar share a kind, or leave out as many characters as makes them meet."""
    lengths = [*range(1, 60), 150, 170, 199, 200, 201, 210, 400]
    plan = {n: (set(kinds), set(out)) for n, kinds, _, out in similarity_join.length_plan(lengths, threshold)}
    for a in lengths:
        for b in lengths:
            if 200 * min(a, b) >= threshold * (a + b):
                common = -(-threshold * (a + b) // 200)
                exact = a - common in plan[a][1] and b - common in plan[b][1]
                kind = max(similarity_join._safe_kind(a, threshold), similarity_join._safe_kind(b, threshold))
                assert exact or kind in plan[a][0] & plan[b][0], (a, b)


@pytest.mark.parametrize("limit, parts, batch", [(3, 1, 10_000), (1, 1, 7), (2, 3, 10_000)])
def test_best_pairs_score_few(spark, limit, parts, batch):
    rnd = random.Random(limit)
    left, right = list(texts(8, 30)), list(texts(9, 80))
    rows = [(key(a), key(b), rnd.choice(["x", "y"])) for a in left for b in right if key(a) and key(b)]
    rows = list(dict.fromkeys(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = similarity_join.best_pairs(spark.createDataFrame(rows, "key_a string, key_b string, g string"),
                                           ["key_a", "g"], limit, 60, parts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in found:
        if r.score is not None:
            got.setdefault((r.key_a, r.g), set()).add((round(r.score, 6), r.key_b))
    groups = {}
    for a, b, g in rows:
        score = 200 * lcs(a, b) / (len(a) + len(b))
        if similar(a, b, 60):
            groups.setdefault((a, g), []).append((round(score, 6), b))
    assert got.keys() == groups.keys()
    for group, scored in groups.items():
        scored.sort(reverse=True)
        least = scored[min(limit, len(scored)) - 1][0]
        assert {s for s in scored if s[0] >= least} <= got[group] <= set(scored)
        if parts == 1 and batch > len(rows):
            assert got[group] == {s for s in scored if s[0] >= least}
    n_scored = sum(r.n_scored for r in found)
    bounded = sum(1 for a, b, _ in rows if (len(a) + len(b)) * 40 // 100 >= abs(len(a) - len(b)))
    assert 0 < n_scored < bounded / (2 if limit == 1 else 1)
