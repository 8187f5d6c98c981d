"""Retrieval and verification against exact containment in every window."""

import random

import pytest

from tallyspark.llm import license_scan
from tallyspark.llm.license_scan import Scanner, Template


def plain_matches(scanner, text):
    """Every window of every template, counted without signatures."""
    words = license_scan.text_words(text)
    shingles = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    found = []
    for t, template in enumerate(scanner.templates):
        own = license_scan.text_words(template.text)
        wanted = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
        length, stride = scanner.window(t)
        verified = []
        for start in range(0, len(shingles), stride):
            inside = [i for i in range(start, min(start + length, len(shingles))) if shingles[i] in wanted]
            share = len({shingles[i] for i in inside}) / len(wanted)
            if share >= scanner.containment:
                verified.append(license_scan.Match(template.name, share, inside[0], inside[-1] + 4))
        found += license_scan._merge(verified)
    return sorted(found, key=lambda m: (m.first_word, m.license))


def texts():
    rng = random.Random(9)
    filler = [f"word{i}" for i in range(50)] + ["the", "license", "software", "licensed", "under"]
    made = [None, "", "the", "Licensed under the", "x " * 20_000]
    for _ in range(60):
        words = rng.choices(filler, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(license_scan.TEMPLATES).text.split()
            for _ in range(rng.randint(0, 3)):
                notice[rng.randrange(len(notice))] = rng.choice(["CHANGED", "", "the"])
            at = rng.randint(0, len(words))
            words[at:at] = notice
        made.append(rng.choice([" ", "\n", " * "]).join(words))
    return made


def test_scan_equals_counting_every_window():
    scanner = Scanner()
    found = 0
    for text in texts():
        got = scanner.scan(text)
        assert got == plain_matches(scanner, text)
        found += len(got)
    assert found > 30


def test_bands_retrieve_what_containment_allows():
    """Windows with just enough of a template are retrieved with the probability the settings promise."""
    rng = random.Random(4)
    template = Template("t", " ".join(f"t{i}" for i in range(64)))
    scanner = Scanner([template])
    hits = 0
    for n in range(400):
        words = template.text.split()
        words = words[:52] + [f"x{n}_{i}" for i in range(30)]  # 48 of 60 shingles
        shift = rng.randint(0, 40)
        hits += bool(scanner.scan(" ".join([f"y{n}_{i}" for i in range(shift)] + words)))
    assert hits >= 398


def test_rows_and_columns(spark):
    text = "Intro. Licensed under the Apache License, Version 2.0.\nRest"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "y"), (2, None, "z")],
                               "doc_id long, text string, matches string")
    got = license_scan.scan(df).collect()
    assert sorted((len(r.matches) for r in got)) == [0, 1, 1, 1]
    match = next(r.matches[0] for r in got if r.matches)
    assert (match.license, match.containment, match.first_word, match.last_word) == ("Apache-2.0-line", 1.0, 1, 8)
    assert license_scan.scan(df.limit(0)).count() == 0
    assert license_scan.scan(df, templates=[]).first().matches == []
    with pytest.raises(ValueError):
        license_scan.scan(df, templates=[Template("short", "too few words here")])
