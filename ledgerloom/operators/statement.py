"""From rows to transactions: kinds, dates, segments, directions, roles and declarations, all keyed by document.

Forward fills and segment ids are windows over one document's rows; a document bounds every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators.geometry import Tolerances, number_rows
from ledgerloom.operators.money_scan import scan_money


def _order():
    return W.partitionBy("doc_id").orderBy("position")


def _before():
    return _order().rowsBetween(W.unboundedPreceding, W.currentRow)


def date_candidates(words: Column) -> Column:
    """array(struct(start, end, value)): every run of 1, 5 or 3 words that spells a date; value is null if impossible."""
    texts = F.transform(words, lambda w: w["text"])

    def at(i: Column) -> Column:
        def window(size: int, shape: str) -> Column:
            text = F.array_join(F.slice(texts, i + 1, F.lit(size)), " ")
            return lexical.let(text, lambda t: F.when(t.rlike(rf"\A{shape}\z"), F.struct(i.alias("start"), (i + size).cast("int").alias("end"), lexical.parse_date(t).alias("value"))))

        return F.array_compact(F.array(window(1, lexical.NUMERIC_DATE), window(5, lexical.LONG_DATE), window(3, lexical.SHORT_DATE)))

    # Every spelling begins with a digit.
    first = lambda i: (F.get(texts, i) >= "0") & (F.get(texts, i) < ":")
    return F.when(F.size(words) > 0, F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), first), at))).otherwise(F.array().cast("array<struct<start:int,end:int,value:date>>"))


def tokens(rows: DataFrame, tolerances: Tolerances = Tolerances()) -> DataFrame:
    """rows with position, dates, amounts (regions with their money) and incomplete."""
    r = number_rows(rows).withColumn("scan", scan_money(F.col("words"), tolerances.token_gap))
    amounts = F.transform("scan.regions", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["x0"].alias("x0"), x["x1"].alias("x1"), lexical.money(x["text"]).alias("money")))
    return r.withColumns({"amounts": amounts, "incomplete": F.col("scan.incomplete")}).drop("scan").withColumn("dates", date_candidates(F.col("words")))


def _label(begin: Column, end: Column) -> Column:
    """Text of words begin to end."""
    return F.array_join(F.transform(F.slice("words", begin + 1, F.greatest(end - begin, F.lit(0))), lambda w: w["text"]), " ")


def classify(rows: DataFrame) -> DataFrame:
    """Adds kind (the first that fits), flow (direction of a signed subtotal) and flow_conflict."""
    one = F.get("amounts", 0)
    single, ends = F.size("amounts") == 1, one["end"] == F.size("words")
    day = F.get("dates", 0)
    leading = F.when(day["start"] == 0, day["end"]).otherwise(0)
    direction = F.when(single, lexical.flow_direction(_label(leading, one["start"])))
    consistent = ends & one["money"]["marker"].isNull() & one["money"]["explicit_sign"] & (F.substring(one["text"], 1, 1) == F.when(direction == 1, "+").otherwise("-"))
    after = F.when(day["start"] == 0, lexical.balance_labels(_label(day["end"], F.size("words"))))
    heading = (F.size("dates") == 1) & (day["start"] == 0) & ((day["end"] == F.size("words")) | ((F.size(after) == 1) & F.get(after, 0).isin("do dia", "diário")))
    own = lexical.balance_labels(F.col("text"))
    declared = F.lower("text").startswith("saldo ") & (F.size(own) == 1) & F.get(own, 0).isin("inicial", "anterior", "final", "total")
    kind = (
        F.when(lexical.is_period(F.col("text")), "period")
        .when(single & (one["start"] == 0) & ends, "monetary_only")
        .when(single & ends & (F.lower(_label(F.lit(0), one["start"])) == "saldo intermediário:"), "checkpoint")
        .when(direction.isNotNull(), "flow")
        .when(heading, "date_heading")
        .when(declared, "balance_declaration")
        .otherwise("content")
    )
    return rows.withColumns({"kind": kind, "flow": direction.cast("int"), "flow_conflict": F.coalesce(direction.isNotNull() & ~consistent, F.lit(False))})


def transaction_area(rows: DataFrame) -> DataFrame:
    """Adds in_area: from the first dated heading or flow, or dated content with money, on."""
    starts = (F.col("kind").isin("date_heading", "flow") & (F.size("dates") > 0)) | ((F.col("kind") == "content") & (F.size("dates") > 0) & (F.size("amounts") > 0))
    first = F.min(F.when(starts, F.col("position"))).over(W.partitionBy("doc_id"))
    return rows.withColumn("in_area", F.coalesce(F.col("position") >= first, F.lit(False)))


def segments(rows: DataFrame, continuation_left: Column | None = None, tolerances: Tolerances = Tolerances(), carry_across_pages: bool = True) -> DataFrame:
    """Adds seg, the number of the transaction a row belongs to, and orphan, a row that belongs to none and should.

    A content row with money opens a segment; rows without attach to it until a heading, flow or checkpoint closes it.
    """
    head = (F.col("kind") == "content") & (F.size("amounts") > 0)
    closes = F.col("kind").isin("date_heading", "flow", "checkpoint")
    page_break = F.lit(False) if carry_across_pages else F.coalesce(F.lag("page").over(_order()) != F.col("page"), F.lit(False))
    r = rows.withColumns({"_head": head, "_mark": F.when(head, "open").when(closes | page_break, "closed")})
    r = r.withColumns({"_seg": F.sum(F.col("_head").cast("int")).over(_before()), "_state": F.last("_mark", True).over(_before()), "_values": F.min(F.expr("array_min(transform(amounts, a -> a.x0))")).over(W.partitionBy("doc_id"))})
    first, last = F.get("words", 0), F.element_at("words", -1)
    misplaced = lexical.has_financial_signal(F.col("text")) | (F.size("dates") > 0) | (last["x1"] >= F.col("_values"))
    if continuation_left is not None:
        misplaced = misplaced | (F.abs(first["x0"] - continuation_left) > tolerances.row_y)
    member = ~closes & (F.col("_state") == "open")
    orphan = (F.col("kind") == "content") & ~F.col("_head") & (~F.coalesce(member, F.lit(False)) | misplaced)
    return r.withColumns({"seg": F.when(F.coalesce(member, F.lit(False)), F.col("_seg")).cast("int"), "is_head": F.col("_head"), "orphan": orphan | ~F.col("kind").isin("content", "date_heading", "flow", "checkpoint")}).drop("_head", "_mark", "_seg", "_state", "_values")


def attribute_dates(rows: DataFrame, mode: str = "grouped", carry_across_pages: bool = True) -> DataFrame:
    """Adds date and date_error: own date, or the latest heading's (as-of), or by mode "either" whichever there is; both at once
    are competing evidence."""
    carrier = F.col("kind").isin("date_heading", "flow") & (F.size("dates") > 0)
    window = _before() if carry_across_pages else W.partitionBy("doc_id", "page").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    heading = F.last(F.when(carrier, F.col("dates")), True).over(window)
    own = F.when(F.size("dates") > 0, F.col("dates")).otherwise(heading)
    r = rows.withColumns({"_heading": heading, "_dates": F.col("dates") if mode == "per_transaction" else own if mode == "either" else heading})
    error = F.when((F.lit(mode) != "per_transaction") & F.col("is_head") & (F.size("dates") > 0) & ((F.lit(mode) == "grouped") | F.col("_heading").isNotNull()), "competing").when(F.col("is_head") & (F.coalesce(F.size("_dates"), F.lit(0)) < 1), "missing").when(F.col("is_head") & (F.size("_dates") > 1), "ambiguous")
    return r.withColumns({"date": F.when(F.size("_dates") == 1, F.get("_dates", 0)["value"]), "date_error": error}).drop("_dates", "_heading")


def date_alternatives(rows: DataFrame, mode: str = "either") -> DataFrame:
    """(doc_id, position, n, date): own dates first unless grouped, then the latest heading's."""
    carrier = F.col("kind").isin("date_heading", "flow") & (F.size("dates") > 0)
    heading = F.coalesce(F.last(F.when(carrier, F.col("dates")), True).over(_before()), F.array().cast("array<struct<start:int,end:int,value:date>>"))
    none = F.array().cast("array<struct<start:int,end:int,value:date>>")
    every = F.concat(none if mode == "grouped" else F.col("dates"), none if mode == "per_transaction" else heading)
    return rows.withColumn("_all", every).where("is_head").select("doc_id", "position", F.posexplode("_all").alias("n", "d")).select("doc_id", "position", "n", F.col("d.value").alias("date"))


def directions(rows: DataFrame) -> DataFrame:
    """Adds direction and basis: from the amount's own marker or sign, or by the flow group a row is in.

    A date heading ends a flow group, so the last of both decides.
    """
    mark = F.when(F.col("kind") == "flow", F.struct(F.col("flow").alias("flow"), F.col("position").alias("at"))).when(F.col("kind") == "date_heading", F.struct(F.lit(None).cast("int").alias("flow"), F.col("position").alias("at")))
    group = F.last(mark, True).over(_before())
    money = F.get("amounts", 0)["money"]
    return rows.withColumn("_group", group).withColumns({
        "group_direction": F.col("_group.flow"),
        "group_position": F.when(F.col("_group.flow").isNotNull(), F.col("_group.at")),
        "direction": money["sign"],
        "basis": F.when(money["marker"].isNotNull(), "direction_marker").when(money["explicit_sign"], "explicit_sign").when(money.isNotNull(), "unsigned_credit_convention"),
    }).drop("_group")


def flow_members(rows: DataFrame) -> DataFrame:
    """(doc_id, flow_position, position): segment heads between a flow and the next flow or heading."""
    return directions(rows).where("is_head and group_position is not null").select("doc_id", F.col("group_position").alias("flow_position"), "position")


def descriptions(rows: DataFrame) -> DataFrame:
    """(doc_id, seg, description, invalid): words outside dates and amounts of the head, then whole continuations."""
    outside = F.filter(F.col("words"), lambda w, i: ~F.exists("amounts", lambda a: (a["start"] <= i) & (i < a["end"])) & ~F.exists("dates", lambda d: (d["start"] <= i) & (i < d["end"])))
    text = F.array_join(F.transform(F.when(F.col("is_head"), outside).otherwise(F.col("words")), lambda w: w["text"]), " ")
    parts = rows.where("seg is not null").select("doc_id", "seg", F.struct("position", text.alias("text")).alias("p"))
    joined = parts.groupBy("doc_id", "seg").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), lambda t: t != ""), " ").alias("description"))
    bare = F.rtrim(F.lower("description"), F.lit(":")).isin("saldo", "subtotal")
    labelled = (F.size(lexical.balance_labels(F.col("description"))) > 0) & F.lower("description").startswith("saldo ")
    invalid = F.when(bare, "monetary_role_domain_empty").when((F.col("description") == "") | lexical.has_financial_signal(F.col("description")) | labelled, "transaction_segmentation")
    return joined.withColumn("invalid", invalid)


def labelled_values(rows: DataFrame, tolerances: Tolerances = Tolerances()) -> DataFrame:
    """(doc_id, label_position, matches, amount, value_position): money-only rows below a balance label on its page, within summary_y and
    aligned at the left edge; exactly one match binds. A range join within a page, on document and page."""
    labels = rows.where((F.size(lexical.balance_labels(F.col("text"))) == 1) & (F.size("amounts") == 0)).select("doc_id", "page", F.col("position").alias("label_position"), F.get("words", 0)["top"].alias("lt"), F.get("words", 0)["x0"].alias("lx"))
    values = rows.where("kind = 'monetary_only'").select("doc_id", "page", F.col("position").alias("value_position"), F.get("words", 0)["top"].alias("vt"), F.get("words", 0)["x0"].alias("vx"), F.get("amounts", 0)["money"]["amount"].alias("amount"))
    below = (F.col("vt") > F.col("lt")) & (F.col("vt") - F.col("lt") <= tolerances.summary_y) & (F.abs(F.col("vx") - F.col("lx")) <= tolerances.row_y)
    pairs = labels.join(values, ["doc_id", "page"]).where(below)
    counted = pairs.groupBy("doc_id", "label_position").agg(F.count("*").alias("matches"), F.min("amount").alias("least"), F.min("value_position").alias("at"))
    return labels.select("doc_id", "label_position").join(counted, ["doc_id", "label_position"], "left").select("doc_id", "label_position", F.coalesce("matches", F.lit(0)).cast("int").alias("matches"), F.when(F.col("matches") == 1, F.col("least")).alias("amount"), F.when(F.col("matches") == 1, F.col("at")).alias("value_position"))


def bind_labels(rows: DataFrame, tolerances: Tolerances = Tolerances()) -> DataFrame:
    """Rows with amounts of labels above their values moved to the labels, and owned, whether an amount has an owner: a
    label's own row, or the label above it."""
    found = labelled_values(rows.where(~F.col("in_area")), tolerances).where("value_position is not null")
    labels = found.select("doc_id", F.col("label_position").alias("position"), F.col("amount").alias("bound"))
    values = found.select("doc_id", F.col("value_position").alias("position"), F.lit(True).alias("_value"))
    r = rows.join(labels, ["doc_id", "position"], "left").join(values, ["doc_id", "position"], "left")
    own = F.col("in_area") | (F.size("amounts") == 0) | F.col("kind").isin("balance_declaration", "period") | F.coalesce("_value", F.lit(False))
    return r.withColumn("owned", own).drop("_value")


def context(rows: DataFrame) -> DataFrame:
    """(doc_id, period_begin, period_end, opening, closing, and whether these conflict): declarations outside the transaction
    area, with the amount on the label's row or, where rows have bound, below it."""
    declared = rows.where(~F.col("in_area"))
    p = lexical.period(F.col("text"))
    labels = lexical.balance_labels(F.col("text"))
    value = F.get("amounts", 0)["money"]["amount"]
    says = F.col("kind") == "balance_declaration"
    if "bound" in rows.columns:
        value, says = F.coalesce("bound", value), says | (F.col("bound").isNotNull() & (F.size(labels) == 1))
    first, last = says & F.get(labels, 0).isin("inicial", "anterior"), says & F.get(labels, 0).isin("final", "total")
    return declared.groupBy("doc_id").agg(
        F.max(p["begin"]).alias("period_begin"), F.max(p["end"]).alias("period_end"),
        F.max(F.when(first, value)).alias("opening"), F.max(F.when(last, value)).alias("closing"),
        (F.count_distinct(F.when(first, value)) > 1).alias("opening_conflict"), (F.count_distinct(F.when(last, value)) > 1).alias("closing_conflict"),
    )


def movements(rows: DataFrame, mode: str = "per_transaction") -> DataFrame:
    """(doc_id, doc_order, posting_date, description, invalid, left_amount, right_amount) of segmented, dated rows, the amounts
    from the left; which of them moves is the search's to say. Under a flow group the group's direction signs a lone amount."""
    heads = directions(attribute_dates(rows, mode)).where("is_head")
    money, balance = F.get("amounts", 0)["money"], F.get("amounts", 1)["money"]
    grouped = F.col("group_direction").isNotNull() & ~money["explicit_sign"] & money["marker"].isNull() & (F.size("amounts") == 1)
    signed = F.when(grouped, F.abs(money["amount"]) * F.col("group_direction")).otherwise(money["amount"])
    named = heads.join(descriptions(rows), ["doc_id", "seg"], "left")
    order = W.partitionBy("doc_id").orderBy("position")
    return named.select("doc_id", F.row_number().over(order).alias("doc_order"), F.col("date").alias("posting_date"), "description", "invalid", signed.cast(lexical.CENTS).alias("left_amount"), balance["amount"].cast(lexical.CENTS).alias("right_amount"))


def transactions(rows: DataFrame, mode: str = "per_transaction") -> DataFrame:
    """(doc_id, doc_order, posting_date, description, amount, balance_after) by the fixed reading (SCH-19): the first amount
    moves, a second one is the running balance."""
    m = movements(rows, mode)
    return m.select("doc_id", "doc_order", "posting_date", "description", F.col("left_amount").alias("amount"), F.col("right_amount").alias("balance_after"))
