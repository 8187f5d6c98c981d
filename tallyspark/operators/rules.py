"""Rule normalisation and the match of descriptions against rules."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.automaton import Automaton, find_texts
from tallyspark.functions.text import clean_key, or_blank
from tallyspark.operators.scale import cut_lineage, is_small, lookup_join
from tallyspark.schema import DEFAULT_TYPE, NO_MATCH, UNCATEGORIZED, empty_to_null

POINTS_PER_CHAR = 10
MERCHANT_BONUS = 50
MIN_PATTERN_LENGTH = 2
INLINE_RULES = 64
GRAM = 3
SALTED_ROWS = 100_000
#: Characters of all rule texts together that one automaton takes; it has about 40 bytes for each.
AUTOMATON_CHARS = 1_000_000

_WINNER = ["category", "subcategory", "type", "rule_match", "confidence"]


def normalize_merchants(merchants: DataFrame) -> DataFrame:
    """Aliases stripped and lower-cased, blanks dropped, missing list empty; defaults filled in."""
    cleaned = F.transform(F.col("aliases"), clean_key)
    return merchants.withColumns({
        "aliases": F.coalesce(F.filter(cleaned, lambda a: a != ""), F.array().cast("array<string>")),
        "subcategory": or_blank(F.col("subcategory")),
        "type": F.coalesce("type", F.lit(DEFAULT_TYPE)),
    })


def normalize_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.withColumns({
        "pattern": clean_key(F.col("pattern")),
        "subcategory": or_blank(F.col("subcategory")),
        "type": F.coalesce("type", F.lit(DEFAULT_TYPE)),
        "weight": F.coalesce("weight", F.lit(1.0)),
    })


def rule_table(merchants: DataFrame, patterns: DataFrame, *, points: int = POINTS_PER_CHAR,
               bonus: int = MERCHANT_BONUS, min_length: int = MIN_PATTERN_LENGTH) -> DataFrame:
    """One row per text a rule looks for, with its score and its place in the order of rules.

    ``kind`` 0 (merchant aliases) precedes 1 (patterns); within a kind rules keep their file order.
    A pattern whose score no long can hold is left out.
    """
    m = normalize_merchants(merchants).select(
        F.lit(0).alias("kind"), "rule_ord", F.posexplode("aliases").alias("alias_ord", "match_text"),
        "category", "subcategory", "type",
        F.concat(F.lit("merchant:"), "name").alias("rule_match"), F.lit(None).cast("double").alias("weight"))
    p = normalize_patterns(patterns).select(
        F.lit(1).alias("kind"), "rule_ord", F.lit(0).alias("alias_ord"), F.col("pattern").alias("match_text"),
        "category", "subcategory", "type",
        F.concat(F.lit("pattern:"), "pattern").alias("rule_match"), "weight")
    base = F.length("match_text") * F.lit(points)
    weighted = (base.cast("double") * F.col("weight")).try_cast("long")
    score = F.when(F.col("kind") == 0, (base + bonus).cast("long")).otherwise(weighted)
    return (m.unionByName(p)
            .filter((F.length("match_text") >= min_length) & ~F.isnan(F.coalesce("weight", F.lit(1.0))))
            .withColumn("score", score).filter(F.col("score").isNotNull()).drop("weight"))


def match_rules(descriptions: DataFrame, rules: DataFrame, column: str = "description") -> DataFrame:
    """Every (description, rule) hit for the distinct non-blank descriptions.

    Rule texts of at most ``AUTOMATON_CHARS`` characters together become one automaton, which reads each
    description once. More are matched by runs of characters, see ``_match_by_runs``.
    """
    measured = rules.select("match_text").distinct().agg(F.sum(F.length("match_text"))).first()[0] or 0
    if measured > AUTOMATON_CHARS:
        return _match_by_runs(descriptions, rules, column)
    spark = rules.sparkSession
    listed = sorted(r[0] for r in rules.select("match_text").distinct().collect())
    machine = spark.sparkContext.broadcast(Automaton(listed))
    texts = _distinct_texts(descriptions, column)
    found = texts.mapInArrow(find_texts(machine, column, "match_text"), f"`{column}` string, match_text string")
    # Many rules may look for one text, so the rules themselves may be larger than their texts.
    rules = cut_lineage(rules)
    joined = found.join(F.broadcast(rules) if is_small(rules) else rules, "match_text")
    return joined.select(column, *rules.columns)


def _match_by_runs(descriptions: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """The same for any number of rules.

    A rule can only be in a text that holds all its runs of ``GRAM`` characters, so its key is the one
    of them that the fewest texts hold. Texts offer their runs, of which there are as many as
    characters; only those that are some rule's key travel and meet the rules, and a ``contains``
    decides. Rules are broadcast only when measured small; otherwise both sides are salted by how
    often the commonest key occurs.
    """
    texts = _distinct_texts(descriptions, column)
    rules = cut_lineage(rules.withColumn("_rule", F.monotonically_increasing_id()))
    small = is_small(rules)
    sizes = [r[0] for r in rules.select(_gram_size(F.length("match_text"))).distinct().collect()]  # 1 to GRAM
    grams = _runs(rules.select("_rule", "match_text"), "match_text", _gram_size(F.length("match_text"))).distinct()
    wanted = grams.select("gram").distinct()
    offered = reduce(DataFrame.unionByName, [_runs(texts, "text_key", F.lit(n)) for n in sizes or [GRAM]])
    frequency = (offered.join(F.broadcast(wanted) if small else wanted, "gram", "left_semi")
                 .groupBy("gram").agg(F.count("*").alias("freq")))
    # A run in no text at all has no row here, and its rule no hit.
    held = grams.join(frequency, "gram", "left")
    keys = held.groupBy("_rule").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gram")).alias("k")).select(
        "_rule", "k.gram", "k.freq").filter("freq > 0")
    keyed = cut_lineage(rules.join(keys, "_rule").drop("_rule"))
    if small:
        found = F.broadcast(keyed.select("gram").distinct())
        pairs = offered.join(found, "gram", "left_semi").distinct().join(F.broadcast(keyed), "gram")
    else:
        salts = -(-(keyed.agg(F.max("freq")).first()[0] or 1) // SALTED_ROWS)
        salted = offered.join(keyed.select("gram").distinct(), "gram", "left_semi").distinct().withColumn(
            "salt", F.pmod(F.xxhash64("text_key"), F.lit(salts)).cast("int"))
        copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = salted.join(copies, ["gram", "salt"]).drop("salt")
    return (pairs.filter(F.contains("text_key", F.col("match_text"))).drop("gram", "freq")
            .withColumnRenamed("text_key", column))


def _gram_size(length: Column) -> Column:
    return F.least(length, F.lit(GRAM))


def _runs(df: DataFrame, text: str, size: Column) -> DataFrame:
    """One row per place in ``text`` and the run of ``size`` characters there, as ``gram``."""
    fits = F.length(text) >= size
    places = df.filter(fits).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - size + 1)))
    return places.withColumn("gram", F.substring(F.col(text), F.col("_at"), size)).drop("_at")


def _distinct_texts(df: DataFrame, column: str) -> DataFrame:
    return (df.select(clean_key(F.col(column)).alias("text_key"))
            .filter(F.col("text_key") != "").distinct())


def winners(hits: DataFrame, column: str = "description") -> DataFrame:
    """The best hit per description: highest score, then the earliest rule."""
    order = Window.partitionBy(column).orderBy(
        F.desc("score"), "kind", "rule_ord", "alias_ord", "match_text")
    return (hits.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
            .select(column, "category", "subcategory", "type", "rule_match",
                    F.col("score").alias("confidence")))


def categorize(txn: DataFrame, merchants: DataFrame, patterns: DataFrame, *,
               inline_rules: int = INLINE_RULES, rules: DataFrame | None = None) -> DataFrame:
    """Category, subcategory, type, matched rule and score for every transaction.

    A rule set of at most ``inline_rules`` texts becomes one expression evaluated on each row, so
    the transactions are not shuffled. A larger one is matched on the distinct descriptions and
    joined back.
    """
    if rules is None:
        rules = rule_table(merchants, patterns)
    listed = rules.limit(inline_rules + 1).collect()
    if len(listed) <= inline_rules:
        return _categorize_inline(txn, listed)
    return _categorize_by_join(txn, rules)


def _outcome(category=UNCATEGORIZED, subcategory="", kind=DEFAULT_TYPE, match=NO_MATCH, score=0) -> tuple:
    return category, subcategory, kind, match, score


def _categorize_inline(txn: DataFrame, listed: list) -> DataFrame:
    ranked = sorted(listed, key=lambda r: (-r["score"], r["kind"], r["rule_ord"], r["alias_ord"], r["match_text"]))
    outcomes = [_outcome()] + [
        _outcome(r["category"], r["subcategory"], r["type"], r["rule_match"], r["score"]) for r in ranked]
    # The outcomes number at most ``inline_rules`` + 1. Joined and not looked up by expression, they
    # let a later filter on category or type act on them alone; the match is not repeated for it.
    columns = dict(zip(_WINNER, map(list, zip(*outcomes))))
    table = txn.sparkSession.createDataFrame(pa.table(
        {"_position": list(range(len(outcomes))), **columns}, pa.schema(
            [("_position", pa.int32()), *[(n, pa.string()) for n in _WINNER[:4]], ("confidence", pa.int64())])))
    keep = [c for c in txn.columns if c not in _WINNER]
    return (txn.select(*[f"`{c}`" for c in keep], _first_match(F.col("description"), ranked).alias("_position"))
            .join(F.broadcast(table), "_position").select(*keep, *_WINNER))


def _first_match(description: Column, ranked: list) -> Column:
    """Place of the first rule, best first, whose text the description contains; 0 if there is none."""
    if not ranked:
        return F.lit(0)
    key = F.coalesce(clean_key(description.cast("string")), F.lit(""))
    texts = F.array(*[F.lit(r["match_text"]) for r in ranked])
    found = F.transform(F.array(key), lambda k: F.array_position(
        F.transform(texts, lambda text: F.contains(k, text)), F.lit(True)))
    # Never null: a filter for that would run the match a second time.
    return F.coalesce(F.get(found, F.lit(0)).cast("int"), F.lit(0))


def _categorize_by_join(txn: DataFrame, rules: DataFrame) -> DataFrame:
    keep = [c for c in txn.columns if c not in _WINNER]
    keyed = txn.select(*[f"`{c}`" for c in keep]).withColumn(
        "_text_key", clean_key(F.col("description").cast("string")))
    best = winners(match_rules(keyed.select("description"), rules)).withColumnRenamed("description", "_text_key")
    best = best.withColumn("_hit", F.lit(True))
    joined = lookup_join(keyed, best, "_text_key")
    filled = {n: F.when(F.col("_hit"), F.col(n)).otherwise(F.lit(v)) for n, v in zip(_WINNER, _outcome())}
    return joined.withColumns(filled).select(*keep, *_WINNER)


def recategorize(ledger: DataFrame, merchants: DataFrame, patterns: DataFrame) -> DataFrame:
    """Apply the present rules to rows already in the ledger, which a merge never does."""
    return categorize(ledger, merchants, patterns).select(*ledger.columns)


def affected_texts(ledger: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct ``description`` (stripped and lower-cased) of a ledger that a rule not common to both tables looks for.

    Only for these can the winning rule differ.
    """
    changed = old.subtract(new).unionByName(new.subtract(old))
    return match_rules(ledger.select("description"), changed).select("description").distinct()


def recategorize_changed(ledger: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """What ``recategorize`` gives, for a ledger categorised by the rule table ``old`` (see ``rule_table``): only descriptions
    that a rule added, dropped or changed since looks for are matched again."""
    affected = cut_lineage(affected_texts(ledger, old, new))
    best = winners(match_rules(affected, new)).withColumn("_hit", F.lit(True))
    filled = {n: F.when(F.col("_hit"), F.col(n)).otherwise(F.lit(v)) for n, v in zip(_WINNER, _outcome())}
    outcome = affected.join(best, "description", "left").withColumns(filled).select(
        F.col("description").alias("_text_key"), F.struct(*_WINNER).alias("_now"))
    joined = lookup_join(ledger.withColumn("_text_key", clean_key(F.col("description"))), outcome, "_text_key")
    kept = {n: F.when(F.col("_now").isNotNull(), F.col("_now")[n]).otherwise(F.col(n)) for n in _WINNER if n in ledger.columns}
    kept["subcategory"] = empty_to_null(kept["subcategory"])
    return joined.withColumns(kept).select(*ledger.columns)
