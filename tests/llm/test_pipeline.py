"""The corpus pipeline, each stage against a plain version of it on its own input."""

import random

import corpus_pipeline
from tallyspark.llm import mixing, quality
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_mixing import plain_copies
from tests.llm.test_quality import plain as plain_measures
from tests.llm.test_simhash import plain_components, plain_fingerprint

_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, kept string"


def rows_of(rng):
    words = [f"w{i}" for i in range(400)]
    shared = ["this very line stands in a number of documents", "and this other one does so as well, it seems"]
    rows = []
    for i in range(70):
        lines = [" ".join(rng.choices(words, k=rng.randint(4, 25))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200 + i, rows[i][1] + " changed") for i in range(8)]
    rows += [(300, None), (301, ""), (302, "few words"), (303, "again and again it is the same " * 30), (304, "# $ % " * 20)]
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), "x", "y") for i, t in rows]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_equal_plain_versions(spark, docs):
    start = rows_of(random.Random(7))
    df = docs(start, _SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "encoding"]

    good = stages["quality_rules"](spark, df, "")
    fields = [c.split()[0] for c in quality.MEASURES.split(", ")]
    conditions = [r.fails.replace(" AND ", " and ") for r in quality.RULES]
    kept = []
    for row in start:
        measured = dict(zip(fields, plain_measures(row[1])))
        if not any([eval(c, {}, measured) for c in conditions]):
            kept.append(row)
    assert good.columns == df.columns and rows(good) == sorted(kept, key=repr) and 50 < len(kept) < len(start)

    lined = stages["line_dedup"](spark, good, "")
    after = plain_lines([(r[0], r[1]) for r in kept])
    kept = [(r[0], a[2], *r[2:4], len(a[2]), *r[5:]) for r, a in zip(kept, after)]
    assert lined.columns == df.columns and rows(lined) == sorted(kept, key=repr) and any(a[1] for a in after)

    single = stages["near_dedup"](spark, lined, "")
    kept.sort()
    root = plain_components([plain_fingerprint(r[1]) for r in kept], 4)
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    assert single.columns == df.columns and rows(single) == sorted(kept, key=repr) and len(kept) < len(root)

    mixed = stages["mixing"](spark, single, "")
    sizes = {s: sum(len(r[1].split()) for r in kept if r[3] == s) for s in {r[3] for r in kept}}
    assert mixed.columns == df.columns
    got = rows(mixed)
    assert set(got) <= set(kept) and abs(sum(len(r[1].split()) for r in got) - sum(sizes.values())) < 150
    targets = {r.doc_id: r.target for r in mixing.queue(single).collect()}
    copies = plain_copies([(r[0], len(r[1].split()), r[3]) for r in kept],
                          {s: targets[next(r[0] for r in kept if r[3] == s)] for s in sizes})
    assert sorted(got, key=repr) == sorted((r for r in kept for _ in range(copies.get(r[0], 0))), key=repr)

    encoded = stages["encoding"](spark, mixed, "").collect()
    assert all(r.round_trip for r in encoded) and len(encoded) == 2 * len(got)


def test_stages_take_empty_tables(spark, docs):
    df = docs(rows_of(random.Random(1)), _SCHEMA).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        assert df.count() == 0
