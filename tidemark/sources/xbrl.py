"""Facts of business reports in XML: instances and inline ones, as rows.

Elements that name a context are facts, whatever their tags; contexts are read
one by one by Spark's own XML reader. Both are found by patterns, so a document
that is not well-formed elsewhere still tells them. No text leaves the JVM.

Defined results: a null document, or one without facts, gives no row; comments
are not read; an element with elements inside is no fact; a fact of an unknown
context has null dates and members; of contexts with one id the last one in the
document counts; numbers with thousands separators are read, and what is no
number has a null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.functions.text import number

COMMENT = r"(?s)<!--.*?-->"
CONTEXT = r"(?s)<(?:[A-Za-z_][\w.-]*:)?context\s[^<>]*>.*?</(?:[A-Za-z_][\w.-]*:)?context\s*>"
FACT = r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)(\s[^<>]*?\bcontext[Rr]ef\s*=\s*[\"'][^\"']*[\"'][^<>]*)>([^<]*)</"
_MEMBERS = "STRUCT<explicitMember: ARRAY<STRUCT<_VALUE: STRING, _dimension: STRING>>, typedMember: ARRAY<STRUCT<_dimension: STRING>>>"
_CONTEXT = (
    f"_id STRING, entity STRUCT<identifier: STRUCT<_VALUE: STRING, _scheme: STRING>, segment: {_MEMBERS}>, scenario {_MEMBERS}, "
    "period STRUCT<startDate: STRING, endDate: STRING, instant: STRING>"
)
#: What belongs to a metric by the name of its concept, whether it is a flow, and whether its distinct sizes add up.
METRICS = (
    ("revenue", r"(?i)^(?:Revenue|SalesRevenue|RevenueFromContractsWithCustomers)$", True, False),
    ("ebit", r"(?i)(?:OperatingIncomeLoss|ProfitLossFromOperatingActivities)", True, False),
    ("capex", r"(?i)PurchaseOf(?:PropertyPlantAndEquipment|IntangibleAssets)", True, True),
    ("depreciation", r"(?i)(?:DepreciationAndAmortisation|Depreciation|Amortisation)(?:Expense)?$", True, False),
    ("cash", r"(?i)CashAndCashEquivalents$", False, False),
    ("debt_total", r"(?i)^(?:Borrowings|LoansAndBorrowings)$", False, False),
    ("debt_parts", r"(?i)(?:ShortTermBorrowings|LongTermBorrowings|CurrentPortionOfLongTermBorrowings|Bonds|Debentures|LeaseLiabilities)$", False, True),
    ("receivables", r"(?i)(?:TradeAndOtherCurrentReceivables|TradeReceivables)$", False, False),
    ("inventory", r"(?i)Inventories$", False, False),
    ("payables", r"(?i)(?:TradeAndOtherCurrentPayables|TradePayables)$", False, False),
)
#: Days of a year's flow, and what a context is worth.
YEAR_DAYS = (350, 370)
CONSOLIDATED, SEPARATE, OTHER_MEMBER, NO_MEMBER = 100, -100, -10, 25
VALUE = "decimal(38,6)"


def _plain(text: Column) -> Column:
    """Text without character entities and outer white space."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#160;", " "), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?i)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return let(found, lambda x: F.when(x != "", _plain(x)))


_NO_MEMBERS = "array<struct<axis:string,member:string>>"


def _blocks(xml: Column) -> Column:
    """The contexts of a document without comments, as texts without prefixes, whose declarations stand elsewhere."""
    return F.transform(F.regexp_extract_all(xml, F.lit(CONTEXT), F.lit(0)), lambda b: F.regexp_replace(b, r"<(/?)[A-Za-z_][\w.-]*:", "<$1"))


def _told(c: Column) -> Column:
    """A context as it is returned, of one that was read."""
    none = F.array().cast(_NO_MEMBERS)
    of = lambda part: F.coalesce(F.transform(part["explicitMember"], lambda m: F.struct(m["_dimension"].alias("axis"), _plain(m["_VALUE"]).alias("member"))), none)
    typed = lambda part: F.coalesce(F.transform(part["typedMember"], lambda m: F.struct(m["_dimension"].alias("axis"), F.lit("typed").alias("member"))), none)
    day = lambda name: F.try_to_date(F.substring(F.btrim(c["period"][name]), 1, 10), "yyyy-MM-dd").alias(name if name == "instant" else name.removesuffix("Date"))
    segment, scenario = c["entity"]["segment"], c["scenario"]
    members = F.concat(of(segment), of(scenario), typed(segment), typed(scenario))
    return F.struct(c["_id"].alias("context_id"), c["entity"]["identifier"]["_VALUE"].alias("entity"), day("startDate"), day("endDate"), day("instant"), members.alias("members"))


def _contexts(xml: Column) -> Column:
    """The contexts of a document without comments, in order; what has no id is none."""
    read = F.transform(_blocks(xml), lambda b: F.from_xml(b, _CONTEXT, {"mode": "PERMISSIVE"}))
    return F.transform(F.filter(read, lambda c: c["_id"].isNotNull()), _told)


def contexts(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """``key``, ``context_id``, ``entity``, ``start``, ``end``, ``instant`` and ``members`` (``axis``, ``member``) of each context."""
    rows = docs.select(key, F.posexplode(_contexts(F.regexp_replace(xml, COMMENT, ""))).alias("at", "c"))
    last = rows.groupBy(key, F.col("c.context_id").alias("context_id")).agg(F.max_by("c", "at").alias("c"))
    return last.select(key, "context_id", *(f"c.{c}" for c in ("entity", "start", "end", "instant", "members")))


def facts(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """``key``, ``seq``, ``concept``, ``context_id``, ``unit``, ``decimals``, ``raw``, ``value`` and the context's columns of each fact.

    A document is read once: its contexts are put beside its facts before these become rows, so nothing is joined.
    """
    part = lambda m, k: F.regexp_extract(m, FACT, k)

    def fact(m: Column, known: Column) -> Column:
        told = lambda tag: let(_attribute(tag, "context[Rr]ef"), lambda ref: F.struct(tag.alias("told"), ref.alias("context_id"), F.try_element_at(F.filter(known, lambda c: c["context_id"] == ref), F.lit(-1)).alias("c")))
        return F.struct(part(m, 1).alias("tag"), let(part(m, 2), told).alias("at"), part(m, 3).alias("text"))

    met = let(F.regexp_replace(xml, COMMENT, ""), lambda x: let(_contexts(x), lambda known: F.transform(F.regexp_extract_all(x, F.lit(FACT), F.lit(0)), lambda m: fact(m, known))))
    found = docs.select(key, F.posexplode(met).alias("seq", "f"))
    inline = F.lower("f.tag").isin("nonfraction", "nonnumeric")
    attribute = lambda name: _attribute(F.col("f.at.told"), name)
    named = F.when(inline, attribute("name")).otherwise(F.col("f.tag"))
    raw = _plain(F.col("f.text"))
    scale = F.coalesce(F.expr("try_cast(scale as int)"), F.lit(0))
    printed = F.when(F.col("inline"), number(F.col("raw")).cast(VALUE) * F.pow(F.lit(10.0), scale).cast("decimal(30,10)")).otherwise(F.expr(f"try_cast(replace(raw, ',', '') as {VALUE})"))
    rows = found.select(
        key, "seq", F.regexp_replace(named, r"^.*:", "").alias("concept"), F.col("f.at.context_id").alias("context_id"), attribute("unitRef").alias("unit"), attribute("decimals").alias("decimals"),
        raw.alias("raw"), inline.alias("inline"), F.when(inline, attribute("scale")).alias("scale"), *(f"f.at.c.{c}" for c in ("entity", "start", "end", "instant", "members")),
    ).filter("concept is not null")
    return rows.withColumn("value", printed.cast(VALUE)).select(key, "seq", "concept", "context_id", "unit", "decimals", "raw", "value", "entity", "start", "end", "instant", "members")


def _score(flow: bool, period_end: Column) -> Column:
    """How well a fact's context fits a year's flow, or its end; null where it does not."""
    days = F.datediff("end", "start")
    fits = (F.col("end") == period_end) & days.between(*YEAR_DAYS) if flow else F.col("instant") == period_end
    ends = lambda m, name: m["member"].endswith(name)
    whole, alone = F.exists("members", lambda m: ends(m, "ConsolidatedMember")), F.exists("members", lambda m: ends(m, "SeparateMember"))
    others = F.size(F.filter("members", lambda m: ~ends(m, "ConsolidatedMember") & ~ends(m, "SeparateMember")))
    worth = F.when(whole, CONSOLIDATED).otherwise(0) + F.when(alone, SEPARATE).otherwise(0) + OTHER_MEMBER * others + F.when(F.size("members") == 0, NO_MEMBER).otherwise(0)
    return F.when(fits, worth)


def annual_metrics(found: DataFrame, key: str, period_end: Column) -> DataFrame:
    """``key``, the number of numeric facts, and the metrics of the year that ends at ``period_end``, a column of ``found``.

    Of a metric's facts those in the best context count: the largest size, or the
    sum of distinct sizes. Debt is the total if there is one, else its parts;
    working capital is receivables and inventory less payables, if any is known.
    """
    known = found.filter("value is not null and members is not null")
    matches = F.array(*(F.when(F.col("concept").rlike(pattern), F.struct(F.lit(name).alias("metric"), F.lit(adds).alias("adds"), _score(flow, period_end).alias("score"))) for name, pattern, flow, adds in METRICS))
    fits = F.filter(matches, lambda m: m.isNotNull() & m["score"].isNotNull())
    # a fact of no metric stays as one row, and of one with several the first row counts it; all groups are of one document, so one shuffle serves them
    rows = known.select(key, "seq", "value", F.posexplode_outer(fits).alias("at", "m")).select(key, "seq", "value", (F.coalesce("at", F.lit(0)) == 0).cast("long").alias("facts"), "m.*").repartition(key)
    sizes = rows.groupBy(key, "metric", "adds", "score", F.abs("value").alias("size")).agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"), F.sum("facts").alias("facts"))
    by_score = sizes.groupBy(key, "metric", "adds", "score").agg(F.max_by("value", F.struct("size", -F.col("seq"))).alias("largest"), F.sum(F.when(F.col("size") != 0, F.col("size"))).cast(VALUE).alias("total"), F.sum("facts").alias("facts"))
    best = by_score.groupBy(key, "metric").agg(F.max_by(F.when(F.col("adds"), F.col("total")).otherwise(F.col("largest")), "score").alias("value"), F.sum("facts").alias("facts"))
    joined = best.groupBy(key).agg(F.sum("facts").alias("facts"), *(F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name, *_ in METRICS))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(VALUE))
    some = F.col("receivables").isNotNull() | F.col("inventory").isNotNull() | F.col("payables").isNotNull()
    named = joined.select(key, "facts", "revenue", "ebit", "capex", "depreciation", "cash", F.coalesce("debt_total", "debt_parts").alias("debt"), F.when(some, zero("receivables") + zero("inventory") - zero("payables")).alias("nwc"))
    metrics = ("revenue", "ebit", "capex", "depreciation", "cash", "debt", "nwc")
    return named.withColumn("covered", let(F.array(*metrics), lambda a: F.size(F.filter(a, lambda x: x.isNotNull()))))
