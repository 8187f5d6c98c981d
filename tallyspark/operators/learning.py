"""From clusters of uncategorised descriptions to suggested, decided and stored rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.similarity import token_sort
from tallyspark.functions.text import clean_key, rule_id, strip
from tallyspark.operators.rules import normalize_merchants
from tallyspark.operators.scale import cut_lineage, is_small, lookup_join
from tallyspark.operators.similarity_join import best_pairs, compared_pairs
from tallyspark.schema import DEFAULT_TYPE

NAME_CUTOFF = 85
NAME_LIMIT = 3
ALIAS_CUTOFF = 88
#: Compared pairs whose anchors one task ranks, as many as come on average.
RANKED_PAIRS = 250_000
# Positions of added rules start here, so they follow all rules that exist.
ADDED = 1 << 40

_MERCHANT = ["id", "name", "category", "subcategory", "type"]


def alias_rows(merchants: DataFrame) -> DataFrame:
    """One row per alias (null alias for a merchant without any); the form in which rules are kept.

    An alias list may grow without bound when clusters are attached, hence rows and not an array.
    """
    return merchants.select("rule_ord", *_MERCHANT, F.posexplode_outer("aliases").alias("alias_ord", "alias"))


def as_merchants(rows: DataFrame) -> DataFrame:
    """Alias rows in the shape of a merchant table; several rows of one id act as one merchant."""
    return rows.select("rule_ord", *_MERCHANT, F.when(F.col("alias").isNotNull(), F.array("alias"))
                       .otherwise(F.array().cast("array<string>")).alias("aliases"))


def suggest_merchants(members: DataFrame, merchants: DataFrame, *, name_cutoff: int = NAME_CUTOFF,
                      name_limit: int = NAME_LIMIT, alias_cutoff: int = ALIAS_CUTOFF) -> DataFrame:
    """Existing merchants a cluster may belong to, best first, each merchant once per anchor.

    Kinds in order: a description equals an alias; the anchor resembles a merchant name; the anchor
    resembles an alias. Columns: anchor, suggestion_no, kind, info, merchant_id, merchant_name.
    """
    rules = normalize_merchants(merchants)
    aliases = alias_rows(rules).filter(F.col("alias").isNotNull())
    anchors = cut_lineage(members.select("anchor").distinct().withColumn("key_a", token_sort(F.col("anchor"))))
    names, texts = _names(rules), aliases.select("rule_ord", "alias_ord", "id", "name", F.col("alias").alias("text"),
                                                 token_sort(F.col("alias")).alias("key_b"))
    # Names and aliases meet the anchors in one join, each by the cutoff of its kind.
    pool = (names.select("key_b", F.lit(name_cutoff).alias("need"))
            .unionByName(texts.select("key_b", F.lit(alias_cutoff).alias("need"))).withColumnRenamed("key_b", "key"))
    pairs = cut_lineage(compared_pairs(anchors.withColumnRenamed("key_a", "key"), pool))
    in_order = ["priority", F.desc("score"), "place", "info", "merchant_id"]
    once = F.row_number().over(Window.partitionBy("anchor", "merchant_id").orderBy(*in_order))
    listed = F.row_number().over(Window.partitionBy("anchor").orderBy(*in_order))
    named = (_alias_exact(members, aliases).unionByName(_name_fuzzy(anchors, names, pairs, name_cutoff, name_limit))
             .withColumn("_rn", once).filter("_rn = 1").withColumn("suggestion_no", listed))
    named = _lookup(named.select("anchor", "suggestion_no", "kind", "info", "merchant_id", "merchant_name"))
    # There may be very many of the last kind: they stay with their anchors, behind those of the other kinds.
    taken = (F.col("anchor") == F.col("_anchor")) & F.col("merchant_id").eqNullSafe(F.col("_id"))
    others = named.select(F.col("anchor").alias("_anchor"), F.col("merchant_id").alias("_id"))
    before = _lookup(named.groupBy("anchor").agg(F.max("suggestion_no").alias("_before")))
    in_place = Window.partitionBy("key_a", "anchor").orderBy("place", "info", "merchant_id")
    alike = (_alias_fuzzy(anchors, texts, pairs, alias_cutoff).join(others, taken, "left_anti").join(before, "anchor", "left")
             .withColumn("suggestion_no", F.row_number().over(in_place) + F.coalesce("_before", F.lit(0))))
    return named.unionByName(alike.select(*named.columns))


def _lookup(table: DataFrame) -> DataFrame:
    """A computed ``table``, broadcast where joined if it is measured small."""
    table = cut_lineage(table)
    return F.broadcast(table) if is_small(table) else table


def _alias_exact(members: DataFrame, aliases: DataFrame) -> DataFrame:
    # Of merchants that share an alias the last one owns it here.
    latest = Window.partitionBy("key").orderBy(F.desc("rule_ord"), F.desc("id"))
    owner = (aliases.select(F.lower("alias").alias("key"), "rule_ord", "id", "name")
             .withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn", "rule_ord"))
    hits = (members.select("anchor", F.col("description").alias("info"), F.lower("description").alias("key"))
            .join(owner, "key"))
    # One row per merchant is needed, so a cluster's many hits are reduced before they are ranked.
    return hits.groupBy("anchor", "id", "name").agg(F.min("info").alias("info")).select(
        "anchor", F.lit(1).alias("priority"), F.lit("alias_exact").alias("kind"), "info",
        F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("place"),
        F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))


def _names(rules: DataFrame) -> DataFrame:
    return rules.select(F.lower("name").alias("text"), token_sort(F.lower("name")).alias("key_b"), "rule_ord", "id", "name")


def _scored(pairs: DataFrame, by: list[str], limit: int, cutoff: int) -> DataFrame:
    """Pairs that may be among the best of their group ``by``; those that were compared already have their score."""
    if "score" in pairs.columns:
        return pairs.filter(F.col("score") >= cutoff)
    return best_pairs(pairs, by, limit, cutoff).filter("score is not null").drop("n_scored")


def _name_fuzzy(anchors: DataFrame, named: DataFrame, pairs: DataFrame, cutoff: int, limit: int) -> DataFrame:
    latest = Window.partitionBy("text").orderBy(F.desc("rule_ord"), F.desc("id"))
    owner = (named.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1")
             .select("text", F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name")))
    # Names of equal form score the same, so no more than ``limit`` of them count.
    first = F.row_number().over(Window.partitionBy("key_b").orderBy("rule_ord", "name"))
    few = _lookup(named.withColumn("_rn", first).filter(F.col("_rn") <= limit).drop("id", "_rn"))
    with_name = pairs.join(few.select("key_b").distinct(), "key_b", "left_semi")
    scored = _scored(with_name, ["key_a"], limit, cutoff)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "rule_ord", "name")
    top = (anchors.join(scored, "key_a").join(few, "key_b").withColumn("_rn", F.row_number().over(best))
           .filter(F.col("_rn") <= limit).drop("_rn"))
    return top.join(owner, "text").select(
        "anchor", F.lit(2).alias("priority"), F.lit("name_fuzzy").alias("kind"),
        _percent_info(F.col("name")).alias("info"), "score", F.col("rule_ord").alias("place"),
        "merchant_id", "merchant_name")


def _alias_fuzzy(anchors: DataFrame, texts: DataFrame, pairs: DataFrame, cutoff: int) -> DataFrame:
    """One row per anchor and merchant; partitioned by ``key_a``, so that an anchor's rows need no other shuffle."""
    # Aliases of one form and merchant score the same, so the first of them counts.
    first = texts.groupBy("key_b", "id").agg(F.min(F.struct("rule_ord", "alias_ord", "text", "name")).alias("_t"))
    first = _lookup(first.select("key_b", "id", "_t.*"))
    # Pairs take few bytes, so their number decides on the tasks.
    dealt = pairs.repartition(-(-pairs.count() // RANKED_PAIRS) or 1, "key_a") if "score" in pairs.columns else pairs
    scored = _scored(dealt.join(first.select("key_b", "id"), "key_b"), ["key_a", "id"], 1, cutoff)
    found = scored.withColumnRenamed("id", "_id").withColumnRenamed("key_b", "_key")
    same = (F.col("key_b") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    owners = _lookup(anchors) if "score" in pairs.columns else anchors
    best = Window.partitionBy("key_a", "anchor", "id").orderBy(F.desc("score"), "rule_ord", "alias_ord", "text")
    top = (found.join(owners, "key_a").join(first, same)
           .withColumn("_rn", F.row_number().over(best)).filter("_rn = 1"))
    # Within this kind merchants come in rule order, not by score.
    return top.select(
        "key_a", "anchor", F.lit("alias_fuzzy").alias("kind"),
        _percent_info(F.concat(F.lit("alias '"), "text", F.lit("'"))).alias("info"),
        F.col("rule_ord").alias("place"), F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))


def _percent_info(label: Column) -> Column:
    return F.concat(label, F.lit(" ("), F.floor("score").cast("string"), F.lit("%)"))


def apply_decisions(members: DataFrame, suggestions: DataFrame, decisions: DataFrame,
                    merchants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewer decisions turned into rules: (merchant alias rows, pattern rules).

    ``attach`` adds the descriptions of the cluster to its first suggestion, ``new`` makes a merchant
    of it, ``pattern`` a pattern rule; any other action, or a missing category, adds nothing. Rules
    of bigger clusters come first.
    """
    counts = members.groupBy("anchor").agg(F.sum("count").alias("_count"))
    decided = decisions.join(counts, "anchor").withColumn("rule_ord", F.lit(ADDED) - F.col("_count"))
    wanted = F.coalesce(strip(F.col("category")), F.lit("")) != ""

    new = decided.filter((F.col("action") == "new") & wanted).withColumn(
        "name", _given("name", F.initcap("anchor")))
    new = new.select("anchor", "rule_ord", rule_id(F.col("name")).alias("id"), "name",
                     strip(F.col("category")).alias("category"),
                     _given("subcategory", F.lit("General")).alias("subcategory"), _kind().alias("type"))

    first = suggestions.filter("suggestion_no = 1").select("anchor", F.col("merchant_id").alias("id"))
    targets = alias_rows(normalize_merchants(merchants)).select(*_MERCHANT).distinct()
    attach = (decided.filter(F.col("action") == "attach").select("anchor", "rule_ord")
              .join(first, "anchor").join(targets, "id"))

    heads = new.unionByName(attach)
    added = lookup_join(members.select("anchor", F.col("description")), heads.withColumnRenamed("anchor", "_a")
                        .select(F.col("_a").alias("anchor"), "rule_ord", *_MERCHANT), "anchor")
    rows = added.filter(F.col("id").isNotNull()).select(
        "rule_ord", *_MERCHANT, F.lit(0).alias("alias_ord"), clean_key(F.col("description")).alias("alias"))
    known = alias_rows(normalize_merchants(merchants)).select("id", F.lower("alias").alias("alias")).distinct()
    rows = rows.join(known, ["id", "alias"], "left_anti").select("rule_ord", *_MERCHANT, "alias_ord", "alias")

    patterns = decided.filter((F.col("action") == "pattern") & wanted).select(
        "rule_ord", F.lower(_given("pattern", F.col("anchor"))).alias("pattern"),
        strip(F.col("category")).alias("category"),
        _given("subcategory", F.lit("Unspecified")).alias("subcategory"), _kind().alias("type"),
        F.lit(1.0).alias("weight"))
    return rows, patterns


def _given(column: str, default: Column) -> Column:
    value = strip(F.col(column))
    return F.when(value.isNotNull() & (value != ""), value).otherwise(default)


def _kind() -> Column:
    return F.when(F.col("type").isin("operating", "transfer", "financing"), F.col("type")).otherwise(DEFAULT_TYPE)


def upsert_merchants(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alias rows of ``old`` with those of ``new`` merged in by id.

    A known id only gains the aliases it lacks, whatever else the incoming row says; an unknown id
    is added after all others. Rows without an id stay, before all others.
    """
    anonymous = old.filter(F.col("id").isNull()).withColumn("rule_ord", F.col("rule_ord") - ADDED)
    both = (old.filter(F.col("id").isNotNull()).withColumn("_new", F.lit(0))
            .unionByName(new.filter(F.col("id").isNotNull())
                         .withColumns({"_new": F.lit(1), "rule_ord": F.col("rule_ord") + ADDED})))
    place = F.struct("_new", "rule_ord", "name")
    heads = both.groupBy("id").agg(F.min_by(F.struct("rule_ord", *_MERCHANT[1:]), place).alias("_head"))
    heads = heads.select("id", "_head.*")
    # An id without any alias keeps one row with a null alias.
    first = F.row_number().over(Window.partitionBy("id", "_key").orderBy("_new", "rule_ord", "alias_ord", "alias"))
    aliases = (both.filter(F.col("alias").isNotNull()).withColumn("_key", F.lower("alias"))
               .withColumn("_rn", first).filter("_rn = 1")
               .select("id", (F.col("_new") * F.lit(ADDED) + F.col("alias_ord")).alias("alias_ord"), "alias"))
    bare = heads.join(aliases.select("id"), "id", "left_anti").select(
        "id", F.lit(None).cast("long").alias("alias_ord"), F.lit(None).cast("string").alias("alias"))
    merged = lookup_join(aliases.unionByName(bare), heads, "id")
    columns = ["rule_ord", *_MERCHANT, "alias_ord", "alias"]
    return merged.select(*columns).unionByName(anonymous.select(*columns))


def append_patterns(old: DataFrame, new: DataFrame) -> DataFrame:
    """All patterns, the new ones last; equal ones are not merged."""
    return old.unionByName(new.withColumn("rule_ord", F.col("rule_ord") + ADDED))
