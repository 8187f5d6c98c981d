from pyspark.sql import functions as F

from tallyspark.operators import learning, rules
from tallyspark.schema import DECISIONS, MERCHANTS, PATTERNS


def _merchants(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MERCHANTS)


def _members(spark, clusters):
    rows = [(d, 1, anchor) for anchor, texts in clusters.items() for d in texts]
    return spark.createDataFrame(rows, "description string, count long, anchor string")


SHOPS = [
    ("tesco", "Tesco Stores", "Food", "", "operating", ["tesco", "tesco express"]),
    ("tesco2", "TESCO STORES", "Food", "", "operating", ["tesco"]),
    ("gym", "The Gym", "Health", "", "operating", ["gym london"]),
]


def _suggested(spark, clusters, merchants=SHOPS):
    found = learning.suggest_merchants(_members(spark, clusters), _merchants(spark, merchants))
    return [(r.anchor, r.kind, r.info, r.merchant_id) for r in found.orderBy("anchor", "suggestion_no").collect()]


def test_suggestions(spark):
    assert _suggested(spark, {"stores tesco": ["stores tesco", "tesco"], "london gym": ["london gym"], "zzz": ["zzz"]}) == [
        ("london gym", "alias_fuzzy", "alias 'gym london' (100%)", "gym"),
        # the last merchant owns a shared alias, and a shared name
        ("stores tesco", "alias_exact", "tesco", "tesco2"),
    ]


def test_name_before_alias(spark):
    shops = [("a", "Blue Shop", "x", "", "operating", ["blue shops"]), ("b", "blue shop 1", "x", "", "operating", []),
             ("c", "blue shop 12", "x", "", "operating", []), ("d", "blue shop 123", "x", "", "operating", [])]
    assert _suggested(spark, {"blue shop": ["blue shop"]}, shops) == [
        ("blue shop", "name_fuzzy", "Blue Shop (100%)", "a"), ("blue shop", "name_fuzzy", "blue shop 1 (90%)", "b"),
        ("blue shop", "name_fuzzy", "blue shop 12 (85%)", "c")]


def test_only_three_names(spark):
    shops = [(f"m{i}", f"blue shop {i}", "x", "", "operating", []) for i in range(5)]
    assert [s[3] for s in _suggested(spark, {"blue shop 9": ["blue shop 9"]}, shops)] == ["m0", "m1", "m2"]


def test_suggestions_do_not_depend_on_how_pairs_are_found(spark, monkeypatch):
    shops = [(f"s{i % 25}", f"Supplier#{i % 30:05d}", "x", "", "operating", [f"supplier#{i:05d} to", f"to {i % 7} supplier#{i:05d}"])
             for i in range(40)] + [(None, "no id", "x", "", "operating", ["to supplier#00003 x"])] + SHOPS
    clusters = {f"to supplier#{i:05d}": [f"to supplier#{i:05d}", "tesco", "other"][:1 + i % 3] for i in range(20)}
    want = _suggested(spark, clusters, shops)
    scored = []
    plain = learning.best_pairs
    monkeypatch.setattr(learning, "best_pairs", lambda *a: scored.append(1) or plain(*a))
    monkeypatch.setattr("tallyspark.operators.similarity_join.FEW_PAIRS", 0)
    for small in (True, False):
        monkeypatch.setattr(learning, "is_small", lambda df: small)
        assert _suggested(spark, clusters, shops) == want and not scored
    assert {w[1] for w in want} == {"alias_exact", "name_fuzzy", "alias_fuzzy"}


CLUSTERS = {"uk amazon": ["uk amazon", "amazon  uk"], "tesco": ["tesco", "tesco x"], "joe's cafe": ["joe's cafe"],
            "misc": ["misc"], "none": ["none"]}


def _decide(spark, rows):
    members = _members(spark, CLUSTERS)
    merchants = _merchants(spark, SHOPS)
    suggestions = learning.suggest_merchants(members, merchants)
    decisions = spark.createDataFrame(rows, DECISIONS)
    changes, patterns = learning.apply_decisions(members, suggestions, decisions, merchants)
    return ([(r.id, r.name, r.category, r.subcategory, r.type, r.alias) for r in changes.orderBy("id", "alias").collect()],
            [(r.pattern, r.category, r.subcategory, r.type, r.weight) for r in patterns.orderBy("pattern").collect()])


def test_decisions(spark):
    changes, patterns = _decide(spark, [
        ("tesco", "attach", None, None, None, None, None),
        ("uk amazon", "new", None, None, " Shopping ", None, "x"),
        ("joe's cafe", "pattern", None, " CAFE ", "Food", " Out ", "transfer"),
        ("misc", "new", "Name", None, " ", None, None), ("none", "skip", "n", "p", "c", "s", "operating")])
    assert changes == [
        ("tesco2", "TESCO STORES", "Food", "", "operating", "tesco x"),
        ("uk_amazon", "Uk Amazon", "Shopping", "General", "operating", "amazon  uk"),
        ("uk_amazon", "Uk Amazon", "Shopping", "General", "operating", "uk amazon")]
    assert patterns == [("cafe", "Food", "Out", "transfer", 1.0)]


def test_decision_defaults(spark):
    changes, patterns = _decide(spark, [
        ("misc", "pattern", None, None, "Cat", None, None), ("joe's cafe", "new", "Joe & Co", None, "Food", "Out", "financing"),
        ("none", "attach", None, None, None, None, None)])
    assert patterns == [("misc", "Cat", "Unspecified", "operating", 1.0)]
    assert changes == [("joe_co", "Joe & Co", "Food", "Out", "financing", "joe's cafe")]


def test_upsert(spark):
    old = _merchants(spark, [("a", "A", "x", "s", "operating", ["One", "two"]), (None, "Nameless", "x", "s", "operating", ["n"]),
                             ("b", "B", "x", "s", "operating", [])])
    new = _merchants(spark, [("a", "Changed", "y", "t", "transfer", ["ONE", "three"]), ("c", "C", "z", "", "operating", ["see"])])
    merged = learning.upsert_merchants(learning.alias_rows(old), learning.alias_rows(new))
    got = [(r.id, r.name, r.category, r.alias) for r in merged.orderBy("rule_ord", "alias_ord").collect()]
    assert got == [(None, "Nameless", "x", "n"), ("a", "A", "x", "One"), ("a", "A", "x", "two"), ("a", "A", "x", "three"),
                   ("b", "B", "x", None), ("c", "C", "z", "see")]
    again = learning.upsert_merchants(merged, learning.alias_rows(new))
    assert again.select("id", "alias").exceptAll(merged.select("id", "alias")).count() == 0 and again.count() == merged.count()


def test_learned_rules_categorise(spark):
    old = _merchants(spark, SHOPS)
    new = _merchants(spark, [("gym", "x", "x", "x", "x", ["fitness"])])
    merged = learning.as_merchants(learning.upsert_merchants(learning.alias_rows(old), learning.alias_rows(new)))
    patterns = learning.append_patterns(
        spark.createDataFrame([(0, "park", "Fun", "", "operating", 1.0)], PATTERNS),
        spark.createDataFrame([(0, "park", "Later", "", "operating", 1.0)], PATTERNS))
    txn = spark.createDataFrame([("city fitness",), ("park",), ("nothing",)], "description string")
    got = [(r.category, r.rule_match) for r in rules.categorize(txn, merged, patterns).collect()]
    assert sorted(got) == [("Fun", "pattern:park"), ("Health", "merchant:The Gym"), ("Uncategorized", "none")]
    again = rules.recategorize(txn.withColumns({"category": F.lit("old")}), merged, patterns)
    assert again.columns == ["description", "category"]
    assert sorted(r.category for r in again.collect()) == ["Fun", "Health", "Uncategorized"]
