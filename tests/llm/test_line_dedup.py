"""Dropped lines against a plain loop; runs, levels and compaction."""

import random

import pytest

from tallyspark.llm import line_dedup

_SPACE = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=20, min_docs=3):
    """rows: (id, text) -> list of (n_lines, n_dropped, kept)."""
    def key(line):
        stripped = line.strip(_SPACE)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)

    holders = {}
    for i, text in set(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add((i, text))
    rank = lambda i: (i is not None, i or 0)
    keeper = {k: max((i for i, _ in h), key=rank) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows_of(rng):
    shared = [f"this line number {i} is found in several documents" for i in range(12)] + ["É" * 20, "é" * 19, "short", "", "  "]
    rows = []
    for i in range(60):
        lines = rng.choices(shared, k=rng.randint(1, 6)) + [f"a line of its own, document {i}, long enough"]
        lines = [rng.choice(["", "  ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", " \r"])
                 for x in lines]
        rng.shuffle(lines)
        rows.append((rng.choice([i, i, i, None]), "\n".join(lines)))
    return rows + rows[:3] + [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(shared * 400)), (5, "x" * 30)]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_equals_a_plain_loop(docs, batches):
    rows = rows_of(random.Random(batches))
    df = docs([(i, t, "key", 1) for i, t in rows], "doc_id long, text string, flags string, doc_key int")
    got = line_dedup.dedup_lines(df, batches=batches).select("_row.*", "n_lines", "n_dropped", "kept").collect()
    have = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept) for r in got), key=repr)
    assert have == sorted(((i, t, *p) for (i, t), p in zip(rows, plain(rows))), key=repr)


def test_empty_table_and_all_null_ids(docs):
    schema = "doc_id long, text string"
    assert line_dedup.dedup_lines(docs([(1, "a")], schema).limit(0)).count() == 0
    rows = [(None, "one line that all of them have" + "\n" * i) for i in range(4)]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(docs(rows, schema)).collect())


def test_runs_are_compacted_and_know_new_keys(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for batch in range(5):
        run = runs.add(spark.createDataFrame([(b"k%d" % k, 100 - batch) for k in (0, batch, batch + 1)] + [(None, 1)],
                                             "key binary, doc_id long").distinct())
        new = {bytes(r.key) for r in run.filter("is_new").collect()}
        assert new == ({b"k0", b"k1"} if batch == 0 else {b"k%d" % (batch + 1)})
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {bytes(r.key): (r.n_docs, r.keeper) for r in runs.keys().collect()}
    assert got == {b"k0": (5, 100), **{b"k%d" % k: (2, 101 - k) for k in range(1, 5)}, b"k5": (1, 96)}
