"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import clean
from tallyspark.functions.text import month_label
from tallyspark.operators import clustering, layouts, learning, merge, rules, similarity_join
from tallyspark.operators.scale import shared_dir
from tallyspark.plans import debt, month_table, operating, p2p, pipeline
from tallyspark.plans import sample_inputs as inputs
from tallyspark.schema import CATEGORIZED, MONEY, STAGED
from tallyspark.sources import ledger_table, statements, store
from tallyspark.streaming import ledger_stream

Query = Callable[[SparkSession, str], DataFrame]
ROW = inputs.ROW


def _plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Decimals and doubles as rounded doubles, so results compare across engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name)
                   if kind in ("decimal", "double") else F.col(f.name))
    return df.select(*out)


def _on_ledger(plan: Callable[[DataFrame], DataFrame], columns: list[str] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = plan(inputs.ledger(spark, sf_dir))
        return _plain(out.select(*columns) if columns else out)
    return query


def _clean_currency(spark, d):
    price = F.col("l_extendedprice").cast(MONEY)
    text = inputs.amount_text(price)
    rows = inputs.table(spark, d, "lineitem").select(*ROW, text.alias("text"))
    return _plain(rows.select(*ROW, clean.clean_currency(F.col("text")).alias("amount"),
                              clean.currency_warning(F.col("text")).alias("warning")))


def _parse_dates(spark, d):
    text = inputs.date_text_variants(F.col("l_shipdate").cast("date"))
    rows = inputs.table(spark, d, "lineitem").select(*ROW, text.alias("text"))
    return rows.select(*ROW, clean.parse_date(F.col("text")).alias("date"))


def _month_label(spark, d):
    rows = inputs.txn(spark, d).select(month_label(F.col("date")).alias("month_str"))
    return rows.groupBy("month_str").agg(F.count("*").alias("n"))


def _rule_table(spark):
    return rules.rule_table(inputs.merchants(spark), inputs.patterns(spark))


def _match_rules(spark, d):
    hits = rules.match_rules(inputs.txn(spark, d), _rule_table(spark))
    return hits.select("description", "match_text", "category", "subcategory", "type", "rule_match", "score")


_CATEGORIZED = [*ROW, "description", "category", "subcategory", "type", "rule_match", "confidence"]


def _categorize(spark, d):
    return inputs.categorized(spark, d).select(*_CATEGORIZED)


def _categorize_many_rules(spark, d):
    """Rules as many as there are product and brand names, matched by join."""
    txn = inputs.txn(spark, d)
    many = inputs.directory(spark, d)
    return rules.categorize(txn, many, inputs.patterns(spark), inline_rules=0).select(*_CATEGORIZED)


def _categorized_counts(spark, d):
    return _plain(pipeline.categorized_counts(inputs.ledger(spark, d)))


_MERGED = ["date", "description", "paid_out", "paid_in", "source", "category", "subcategory", "type"]


def _merge_ledger(spark, d):
    merged = merge.merge_ledger(inputs.ledger_old(spark, d), inputs.ledger_new(spark, d))
    return _plain(merge.ledger_sorted(merged).select(*_MERGED))


def _append_ledger(spark, d):
    old = merge.to_ledger(inputs.ledger_old(spark, d))
    added = merge.new_rows(old, inputs.ledger_new(spark, d), dates=inputs.line_dates(spark, d))
    return _plain(added.select(*_MERGED, "month"))


def _ingest_stats(spark, d):
    return merge.ingest_stats(inputs.ledger_new(spark, d))


def _load_ledger(spark, d):
    """A ledger of texts, part of them unreadable, as a text file would give it."""
    loose = inputs.ledger(spark, d).select(
        *ROW, inputs.date_text_variants(F.col("date")).alias("date"),
        F.when(F.col("l_linestatus") == "O", F.col("paid_out").cast("string")).otherwise("n/a").alias("paid_out"),
        F.col("paid_in").cast("string").alias("paid_in"))
    return _plain(store.load_ledger(loose))


def _recategorize(spark, d):
    old = merge.to_ledger(inputs.ledger_old(spark, d))
    again = rules.recategorize(old, inputs.merchants(spark), inputs.patterns(spark))
    return _plain(pipeline.categorized_counts(again))


def _recategorize_changed(spark, d):
    """A ledger categorised by other rules, brought up to date by the difference of the rules."""
    merchants, patterns = inputs.merchants(spark), inputs.patterns(spark)
    fewer = merchants.filter("id <> 'rod_friend'").withColumn("category", F.when(F.col("id") == "gear_shop", "Old").otherwise(F.col("category")))
    other = patterns.filter("pattern <> 'new'").unionByName(patterns.filter("pattern = 'new'").withColumn("pattern", F.lit("blue")))
    old, new = rules.rule_table(fewer, other), rules.rule_table(merchants, patterns)
    ledger = merge.to_ledger(rules.categorize(inputs.txn(spark, d), fewer, other))
    return _plain(pipeline.categorized_counts(rules.recategorize_changed(ledger, old, new)))


def _operating_summary(spark, d):
    ledger = inputs.ledger(spark, d)
    selection = operating.operating_base(ledger).filter("category = 'Bills'")
    return _plain(operating.operating_summary(selection, ledger))


def _subcategory_spend(spark, d):
    return _plain(operating.subcategory_spend(inputs.many_subcategories(spark, d)))


def _operating_transactions(spark, d):
    base = operating.operating_base(inputs.ledger(spark, d))
    return _plain(operating.operating_transactions(base, "Shopping"))


_STAGED = ["date", "description", "paid_out", "paid_in", "source", "account_type", "category", "subcategory",
           "currency_warning"]


def _layout(normalize) -> Query:
    def query(spark, d):
        return _plain(normalize(inputs.raw_rows(spark, d)).select(*ROW, *_STAGED))
    return query


def _standardized(spark, d):
    return layouts.standardize(inputs.raw_rows(spark, d).withColumn("layout", inputs.layout_of_type()))


def _standardize(spark, d):
    return _plain(_standardized(spark, d).select(*ROW, *_STAGED))


def _validate_rows(spark, d):
    checked = layouts.with_reject_reason(_standardized(spark, d))
    return checked.groupBy("source", "reject_reason").agg(F.count("*").alias("n"))


def _find_header(spark, d):
    found = statements.find_header(inputs.statement_text(spark, d))
    return found.select("file_path", "delimiter", "layout", "header_idx", "width")


def _stage_lines(spark, d):
    staged = statements.stage(inputs.statement_text(spark, d))
    return _plain(staged.select("source_file", F.col("ingest_seq.block_start").alias("block_start"),
                                F.col("ingest_seq.line_idx").alias("line_idx"), "date", "description", "paid_out",
                                "paid_in", "source", "account_type", "reject_reason"))


def _stage_documents(line_breaks: bool) -> Query:
    """Rows with a whole text as a quoted cell: on many lines put together, or on one, some with the quote left open."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = inputs.document_lines(spark, sf_dir, line_breaks)
        staged = statements.stage(statements.join_quoted_lines(lines) if line_breaks else lines)
        valid = F.col("reject_reason").isNull()
        return _plain(staged.select("source_file", F.col("ingest_seq.block_start").alias("block_start"), "date", "reject_reason",
                                    F.when(valid, F.col("description")).alias("description"),
                                    F.when(valid, F.col("paid_out")).alias("paid_out")))
    return query


def _stage_files(spark, d):
    """Every document from a quoted cell of a file, read back as files are."""
    lines = statements.read_raw_files(spark, inputs.document_files(spark, d), multi_line=True)
    valid = F.col("reject_reason").isNull()
    return _plain(statements.stage(lines).select(
        F.length("line").alias("line_chars"), "date", "reject_reason", F.when(valid, F.col("description")).alias("description"),
        F.when(valid, F.col("paid_out")).alias("paid_out")))


def _reject_counts(spark, d):
    return store.reject_counts(statements.stage(inputs.statement_text(spark, d)))


def _uncategorized(spark, d):
    rows = clustering.uncategorized(inputs.ledger(spark, d))
    return _plain(rows.select(*ROW, "date", "description", "paid_out", "paid_in"))


def _freq(spark, d):
    return clustering.description_freq(clustering.uncategorized(inputs.ledger(spark, d)))


def _similar_pairs(spark, d):
    texts = _freq(spark, d).select("description")
    pairs = similarity_join.similar_pairs(texts.withColumnRenamed("description", "anchor"),
                                          texts.withColumnRenamed("description", "text"), 80)
    return _plain(pairs)


def _members(spark, d):
    return clustering.cluster_members(_freq(spark, d))


def _cluster_samples(spark, d):
    rows = clustering.uncategorized(inputs.ledger(spark, d))
    return _plain(clustering.cluster_samples(rows, _members(spark, d)))


def _cluster_report(spark, d):
    rows = clustering.uncategorized(inputs.ledger(spark, d))
    report = clustering.cluster_report(rows, _members(spark, d))
    return report.select("anchor", "count", "n_aliases", F.size("samples").cast("long").alias("n_samples"),
                         F.col("samples")[0]["date"].alias("first_date"))


def _suggestions(spark, d, members):
    return learning.suggest_merchants(members, inputs.directory(spark, d))


def _suggest_merchants(spark, d):
    return _suggestions(spark, d, _members(spark, d))


def _names(spark, d):
    return clustering.description_freq(inputs.table(spark, d, "customer").select(F.col("c_name").alias("description")))


def _similar_names(spark, d):
    """Names of customers that differ in one character at most."""
    names = _names(spark, d).select("description")
    return _plain(similarity_join.similar_pairs(names.withColumnRenamed("description", "anchor"),
                                                names.withColumnRenamed("description", "text"), 94))


def _suggest_suppliers(spark, d):
    """Payments to every supplier, against the names and aliases of all products and suppliers."""
    payments = inputs.table(spark, d, "supplier").select(F.concat(F.lit("to "), F.lower("s_name")).alias("description"))
    members = payments.select("description", F.lit(1).cast("long").alias("count"), F.col("description").alias("anchor"))
    return learning.suggest_merchants(members, inputs.directory(spark, d).unionByName(inputs.supplier_directory(spark, d)))


def _decided(spark, d):
    members = _members(spark, d)
    return learning.apply_decisions(members, _suggestions(spark, d, members), inputs.decisions(members),
                                    inputs.directory(spark, d))


def _apply_decisions(spark, d):
    return _decided(spark, d)[0].select("id", "name", "category", "subcategory", "type", "alias")


def _upsert_merchants(spark, d):
    merged = learning.upsert_merchants(learning.alias_rows(inputs.directory(spark, d)),
                                       learning.alias_rows(inputs.directory_changes(spark, d)))
    return merged.select("id", "name", "category", "subcategory", "type", "alias")


def _append_patterns(spark, d):
    part = inputs.table(spark, d, "part")
    old = part.groupBy(F.lower("p_brand").alias("pattern")).agg(F.min("p_partkey").alias("rule_ord")).select(
        "rule_ord", "pattern", F.lit("Brand").alias("category"), F.lit("").alias("subcategory"),
        F.lit("operating").alias("type"), F.lit(1.0).alias("weight"))
    return learning.append_patterns(old, _decided(spark, d)[1]).drop("rule_ord")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a query stores and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _transfers(spark, d):
    """A transfer per customer matched against a rule per supplier and segment."""
    txn = inputs.transfers(spark, d)
    matched = rules.categorize(txn, inputs.payees(spark, d), inputs.segments(spark, d), inline_rules=0)
    return matched.select("c_custkey", "description", "category", "type", "rule_match", "confidence")


def _operating_transactions_all(spark, d):
    base = operating.operating_base(inputs.ledger(spark, d))
    return _plain(operating.operating_transactions(base))


def _staged_table(spark, d):
    """Valid rows read back from the staged table of a batch, whose second writing replaces the first."""
    path = _shared(spark, "staged")
    checked = statements.stage(inputs.statement_text(spark, d))
    store.write_staged(checked, path)
    store.write_staged(checked, path)
    return _plain(store.read_staged(spark, path).select(
        "source_file", F.col("ingest_seq.block_start").alias("block_start"),
        F.col("ingest_seq.line_idx").alias("line_idx"), "date", "description", "paid_out", "paid_in", "source"))


def _categorized_table(spark, d):
    path = _shared(spark, "categorized")
    for _ in range(2):
        store.write_categorized(inputs.categorized(spark, d).drop("ingest_seq"), path)
    return _plain(pipeline.categorized_counts(merge.to_ledger(spark.read.parquet(path))))


def _stored_ledger(spark, d):
    """A ledger table appended to twice; the second batch repeats rows of the first."""
    path = _shared(spark, "ledger")
    for batch in (inputs.ledger_old(spark, d), inputs.ledger_new(spark, d)):
        rows = batch.withColumn("account_type", F.lit("Credit")).select(*CATEGORIZED.fieldNames(), "ingest_seq")
        store.append_ledger(spark, path, rows, dates=inputs.line_dates(spark, d))
    return _plain(store.read_ledger(spark, path).select(*_MERGED, "month"))


def _bucketed_ledger(spark, d):
    """The same on a ledger in buckets, of which an append moves nothing."""
    path = _shared(spark, "ledger")
    for batch in (inputs.ledger_old(spark, d), inputs.ledger_new(spark, d)):
        rows = batch.withColumn("account_type", F.lit("Credit")).select(*CATEGORIZED.fieldNames(), "ingest_seq")
        ledger_table.append(spark, path, rows, 8)
    return _plain(ledger_table.read(spark, path, 8).select(*_MERGED, "month"))


def _month_table_kpis(spark, d):
    """Three batches, the second twice, each leaving its sums; the figures are read from the sums alone."""
    path, months = _shared(spark, "ledger"), _shared(spark, "months")
    rows = inputs.categorized(spark, d).withColumn("account_type", F.lit("Credit")).select(*CATEGORIZED.fieldNames(), "ingest_seq")
    for batch in (0, 1, 1, 2):
        own = rows.filter(F.col("ingest_seq.block_start") % 3 == batch).withColumn(
            "ingest_seq", F.col("ingest_seq").withField("batch_id", F.lit(batch).cast("long")))
        store.append_ledger(spark, path, own, dates=inputs.line_dates(spark, d).filter(F.col("l_orderkey") % 3 == batch))
        month_table.write_month_sums(spark, path, months, batch)
    return _plain(operating.operating_kpis(month_table.read_month_sums(spark, months)))


def _streamed_ledger(spark, d):
    """Two runs of a stream over staged files; the second finds late rows, repeats and rows of the first run again."""
    staged, ledger, checkpoint = (_shared(spark, n) for n in ("staged", "ledger", "stream"))
    rows = inputs.txn(spark, d).withColumns({"account_type": F.lit("Credit"), "category": F.lit(""), "subcategory": F.lit("")}).select(
        *STAGED.fieldNames(), "ingest_seq", "l_linestatus", "l_returnflag")
    late = rows.filter("l_returnflag = 'N'").unionByName(rows.filter("l_linestatus = 'O'"))
    for run, batch in enumerate((rows.filter("l_returnflag <> 'N'"), late)):
        batch.drop("l_linestatus", "l_returnflag").write.parquet(f"{staged}/run-{run}")
        query = ledger_stream.stream_ledger(spark, staged, ledger, checkpoint, inputs.merchants(spark), inputs.patterns(spark))
        query.trigger(availableNow=True).start().awaitTermination()
    return _plain(ledger_stream.read_streamed(spark, ledger).select(
        "date", "description", "paid_out", "paid_in", "source", "category", "subcategory", "type", "month"))


def _json_rules(spark, d):
    """Merchants from a folder of JSON files, one object on a line."""
    path = _shared(spark, "json")
    inputs.directory(spark, d).drop("rule_ord").write.json(path)
    return learning.alias_rows(store.read_merchants(spark, path)).select("id", "name", "category", "subcategory", "type", "alias")


def _stored_rules(spark, d):
    """Merchants written, changed, written as a new version and read back from the newest."""
    path = _shared(spark, "rules")
    old = learning.alias_rows(inputs.directory(spark, d))
    store.write_rules(old, path, 1)
    known = learning.alias_rows(store.read_merchants(spark, path))
    merged = learning.upsert_merchants(known, learning.alias_rows(inputs.directory_changes(spark, d)))
    store.write_rules(merged, path, 2)
    read = learning.alias_rows(store.read_merchants(spark, path))
    return read.select("id", "name", "category", "subcategory", "type", "alias")


def _learn_loop(spark, d):
    """Decisions on uncategorised clusters become stored rules, which then categorise the ledger again."""
    merchants, patterns = _shared(spark, "merchants"), _shared(spark, "patterns")
    rows, found = _decided(spark, d)
    store.write_rules(learning.upsert_merchants(learning.alias_rows(inputs.directory(spark, d)), rows), merchants, 1)
    store.write_rules(learning.append_patterns(inputs.patterns(spark), found), patterns, 1)
    again = rules.recategorize(inputs.ledger(spark, d), store.read_merchants(spark, merchants),
                               store.read_patterns(spark, patterns))
    return again.groupBy("description").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


QUERIES: dict[str, Query] = {
    "clean_currency": _clean_currency,
    "parse_dates": _parse_dates,
    "month_label": _month_label,
    "match_rules": _match_rules,
    "categorize": _categorize,
    "categorize_many_rules": _categorize_many_rules,
    "categorized_counts": _categorized_counts,
    "recategorize": _recategorize,
    "recategorize_changed": _recategorize_changed,
    "merge_ledger": _merge_ledger,
    "append_ledger": _append_ledger,
    "ingest_stats": _ingest_stats,
    "load_ledger": _load_ledger,
    "operating_base": _on_ledger(operating.operating_base, [*ROW, "category", "subcategory", "paid_out", "month_str"]),
    "operating_income": _on_ledger(operating.operating_income, [*ROW, "category", "paid_in", "month_str"]),
    "operating_kpis": _on_ledger(operating.operating_kpis),
    "operating_summary": _operating_summary,
    "monthly_spend": _on_ledger(operating.monthly_spend),
    "monthly_income": _on_ledger(operating.monthly_income),
    "monthly_trend": _on_ledger(operating.monthly_trend),
    "category_spend": _on_ledger(operating.category_spend),
    "subcategory_spend": _subcategory_spend,
    "spend_delta": _on_ledger(operating.spend_delta),
    "coverage_delta": _on_ledger(operating.coverage_delta),
    "operating_transactions": _operating_transactions,
    "available_months": _on_ledger(operating.available_months),
    "available_categories": _on_ledger(operating.available_categories),
    "debt_repayments": _on_ledger(debt.debt_repayments, [*ROW, "subcategory", "paid_out", "month_str"]),
    "debt_interest": _on_ledger(debt.debt_interest, [*ROW, "subcategory", "paid_out", "month_str"]),
    "debt_metrics": _on_ledger(debt.debt_metrics),
    "debt_timeline": _on_ledger(debt.debt_timeline),
    "p2p_balances": _on_ledger(p2p.p2p_balances),
    "p2p_summary": _on_ledger(p2p.p2p_summary),
    "normalize_aqua": _layout(layouts.normalize_aqua),
    "normalize_natwest": _layout(layouts.normalize_natwest),
    "normalize_nationwide": _layout(layouts.normalize_nationwide),
    "standardize": _standardize,
    "validate_rows": _validate_rows,
    "find_header": _find_header,
    "stage_lines": _stage_lines,
    "stage_quoted_text": _stage_documents(False),
    "stage_quoted_lines": _stage_documents(True),
    "stage_quoted_files": _stage_files,
    "reject_counts": _reject_counts,
    "uncategorized": _uncategorized,
    "description_freq": _freq,
    "similar_pairs": _similar_pairs,
    "cluster_members": _members,
    "description_clusters": lambda spark, d: clustering.description_clusters(_members(spark, d)),
    "cluster_samples": _cluster_samples,
    "cluster_report": _cluster_report,
    "suggest_merchants": _suggest_merchants,
    "similar_names": _similar_names,
    "name_clusters": lambda spark, d: clustering.cluster_members(_names(spark, d), 94),
    "suggest_suppliers": _suggest_suppliers,
    "apply_decisions": _apply_decisions,
    "upsert_merchants": _upsert_merchants,
    "append_patterns": _append_patterns,
    "categorize_transfers": _transfers,
    "operating_base_month": _on_ledger(lambda ledger: operating.operating_base(ledger, "1995-03"),
                                       [*ROW, "category", "subcategory", "paid_out", "month_str"]),
    "operating_transactions_all": _operating_transactions_all,
    "dated_monthly_trend": _on_ledger(lambda ledger: operating.monthly_trend(ledger, 1000, drop_null_month=True)),
    "dated_debt_timeline": _on_ledger(lambda ledger: debt.debt_timeline(ledger, drop_null_month=True)),
    "staged_table": _staged_table,
    "categorized_table": _categorized_table,
    "stored_ledger": _stored_ledger,
    "bucketed_ledger": _bucketed_ledger,
    "streamed_ledger": _streamed_ledger,
    "json_rules": _json_rules,
    "stored_rules": _stored_rules,
    "month_table_kpis": _month_table_kpis,
    "learn_loop": _learn_loop,
}
