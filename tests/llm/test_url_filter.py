"""The automaton against regular expressions, and the rules' precedence."""

import random
import re

import pytest

from tallyspark.llm.url_filter import GlobAutomaton, Rule, judge


def as_regex(glob):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + r"\Z", re.S)


def test_automaton_equals_regular_expressions():
    rng = random.Random(1)
    globs = ["", "*", "?", "a*b", "*a", "a?c", "é?", "**x**", "a" * 70 + "*", "*" + "b" * 130, "*.a#*", "*a*b*a*"] + [
        "".join(rng.choices("ab*?é", k=rng.randint(1, 12))) for _ in range(80)]
    strings = ["", "a", "é", "éa", "ab", "a" * 70, "a" * 71, "b" * 130, "x.a#b", "日本"] + [
        "".join(rng.choices("abé#", k=rng.randint(0, 20))) for _ in range(300)]
    got = GlobAutomaton(globs).match([s.encode() for s in strings])
    for i, s in enumerate(strings):
        assert got[i].tolist() == [bool(as_regex(g).match(s)) for g in globs], s
    assert GlobAutomaton([]).match([b"a"]).shape == (1, 0)


RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/")]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("http://WWW.Example.COM/en/a?b#c", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://m.example.com/EN/", "m.example.com", "/EN/", "com/", "allow"),
    ("http://com/x", "com", "/x", "com/", "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://a.com?x=/", "a.com", "", None, "allow"),
    ("http://notcom/", "notcom", "/", None, "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://org/a.net/es/", "org", "/a.net/es/", None, "allow"),
    ("http://bad.org/x.exe", "bad.org", "/x.exe", None, "block"),
    ("a://b://c.com/y", "b:", "//c.com/y", None, "allow"),
    ("line\nbreak://h.com/p\nq", "h.com", "/p\nq", "com/", "allow"),
    ("http://h.com/" + "p" * 50_000, "h.com", "/" + "p" * 50_000, "com/", "allow"),
])
def test_verdicts(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "host"), (None, url, "rule")], "page_id long, url string, verdict string")
    for row in judge(df, RULES, ["*#*.exe"]).collect():
        assert tuple(row)[1:] == (host, path, rule, verdict)


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert judge(df.limit(0), RULES, []).count() == 0
    assert judge(df, [], []).first().verdict == "allow"
    with pytest.raises(ValueError):
        judge(df, [Rule("block", "*.com", "/")], [])
