"""Queries over texts as evidence, fact labels, axes of operating evidence and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.budget import batches
from tidemark.operators.components import connected_components
from tidemark.plans.companies import WIDE_SQL, fundamentals
from tidemark.plans.views import signal_dates, with_views
from tidemark.sources.tables import table

#: Names as they stand in filings, for the label rules.
CONCEPT_NAMES = (
    "ifrs-full:Revenue", "dart_OperatingIncomeLoss", "ifrs-full_ProfitLoss", "us-gaap:NetCashProvidedByUsedInOperatingActivities", "유형자산의취득", "CashAndCashEquivalents", "총차입금", "ifrs-full:ShorttermBorrowings",
    "LongTermDebt", "NoncurrentLeaseLiabilities", "ConvertibleBonds", "DepreciationAndAmortisationExpense", "연구개발비", "TradeReceivables", "Inventories", "매입채무", "Assets", "ifrs-full:Equity", "PropertyPlantAndEquipment", "OtherThing",
)
UNIT_TEXTS = ("(단위: 백만원)", "단위 : 천원", "(단위：억원) (단위: 원)", "no unit", "단위: USD", "(단위: 명)", "단위: 톤, 단위: 무엇", "(단위: %)")
UNIT_NAMES = ("백만 원", "천USD", "KRW", "percent", "Kg", "ea", "thing", "달러", "톤", "천원")
SECURITY_NAMES = ("가나스팩1호", "다라리츠", "마바우", "사아3우B", "메리츠금융지주", "자차", "카타 REIT", "파하기업인수목적")
TITLES = ("재무제표", "Risk Factors", "경쟁 상황", "Customer base", "Our services", "Outlook 2025", "Business overview", "Corporate governance", "Misc")
#: Roles of sections by their titles, in order.
ROLES = (
    ("FINANCIALS", r"재무제표|financial statements?"), ("RISK", r"위험[ ]*요인|risk factors?"), ("COMPETITION", r"경쟁[ ]*(상황|환경|현황)|competition|competitive landscape"), ("CUSTOMERS", r"고객|customer"),
    ("SUPPLIERS", r"공급|supplier"), ("PRODUCTS", r"제품|서비스|products?|services?"), ("GUIDANCE", r"가이던스|전망|guidance|outlook"), ("BUSINESS", r"사업의[ ]*내용|사업[ ]*개요|business( overview)?"),
    ("COMPANY_OVERVIEW", r"회사의[ ]*개요|company overview"), ("NOTES", r"주석|notes? to"), ("GOVERNANCE", r"지배구조|governance"),
)
#: Terms of economic evidence, and of what has come about.
TERMS = (
    "가격", "판가", "인상", "인하", "마진", "수익성", "원가", "비용", "점유율", "경쟁", "진입", "특허", "허가", "인증", "독점", "네트워크", "플랫폼", "규모", "전환", "교체", "재구매", "갱신", "해지", "고객", "공급", "계약", "반복", "유지",
    "집중", "의존", "규제", "소송", "위험", "감소", "하락", "악화", "회복", "증가", "pricing", "switch", "retention", "renewal", "churn", "barrier", "competition", "risk",
)
REALISED = ("실적", "기록", "달성", "감소", "증가", "하락")
#: Caps of reliability by type of statement.
CAPS = {"DISCLOSED_FACT": 0.95, "DERIVED_METRIC": 0.90, "MANAGEMENT_CLAIM": 0.60, "ANALYST_INTERPRETATION": 0.65, "INDUSTRY_INTERPRETATION": 0.65, "FORECAST": 0.50}
#: How far an axis must move to have a direction; the second is inverted.
TOLERANCES = {"margin": 0.005, "cash_mismatch": 0.05, "growth": 0.05, "capex_intensity": 0.01}
QUOTED = (3, 8)
BATCH_TOKENS = 200


def _texts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def _one_of(values: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def normal_texts(spark, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("digest"))


def ids(spark, sf_dir: str) -> DataFrame:
    """A name made from a document's source and number, the same wherever it is made."""
    parts = F.to_json(F.array(F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")))
    return _texts(spark, sf_dir).select("doc_id", F.concat(F.lit("DOC_"), F.substring(F.sha2(parts, 256), 1, 20)).alias("stable_id"))


def numbers(spark, sf_dir: str) -> DataFrame:
    """Balances as they may be printed, and their values."""
    whole = F.format_number(F.floor(F.abs("c_acctbal")).cast("double"), 0)
    kind = F.col("c_custkey") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit("("), whole, F.lit(".5)"))).when(kind == 1, F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(".5%"))).when(kind == 2, "—")
        .when(kind == 3, F.concat(F.lit(" "), whole)).when(kind == 4, "N/A").otherwise(F.concat(F.lit("-"), whole, F.lit(".25")))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return rows.withColumn("value", F.round(T.number(F.col("raw")), 6))


def units(spark, sf_dir: str) -> DataFrame:
    raw, marked = _one_of(UNIT_NAMES, "p_partkey"), _one_of(UNIT_TEXTS, "p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), marked.alias("text"))
    return rows.select("p_partkey", *(T.unit(F.col("raw"), f).alias(f) for f in ("name", "scale", "currency")), T.marked_unit(F.col("text")).alias("marked"))


def periods(spark, sf_dir: str) -> DataFrame:
    """The newest period of a caption that names several."""
    year = F.year("o_orderdate") + 10
    said = F.concat(year.cast("string"), F.lit("년 "), F.quarter("o_orderdate").cast("string"), F.lit("분기, "), (year - 1).cast("string"), F.lit(" FY, "), (year + 3).cast("string"), F.lit(" plan"))
    found = T.newest_period(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["year"].alias("year"), found["raw"].alias("label"))


def month_shifts(spark, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", T.shifted(F.col("day"), 3).alias("quarter_later"), T.shifted(F.col("day"), -12).alias("year_before"))


def report_periods(spark, sf_dir: str) -> DataFrame:
    """Reports that may have ended before each signal date, over three years, newest first."""
    years = signal_dates(spark).withColumn("year", F.explode(F.sequence(F.year("signal_date") - 2, F.year("signal_date"))))
    reports = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), F.make_date("year", F.lit(m), F.lit(d)).alias("period_end")) for code, (label, m, d) in T.REPORTS.items()))
    rows = years.select("signal_date", "year", F.inline(reports)).filter(F.col("period_end") < F.col("signal_date"))
    order = Window.partitionBy("signal_date").orderBy(F.desc("period_end"))
    return rows.select("signal_date", "code", F.concat(F.col("year").cast("string"), "label").alias("label"), "period_end", F.row_number().over(order).alias("place"))


def receipts(spark, sf_dir: str) -> DataFrame:
    """Receipt numbers, some with a date that is none, and the day from which a receipt counts as known."""
    stamp = F.when(F.col("o_orderkey") % 50 == 0, "19970231").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    number = F.concat(stamp, F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    day = F.try_to_timestamp(F.substring("number", 1, 8), F.lit("yyyyMMdd")).cast("date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"))
    return rows.withColumns({"valid": F.col("number").rlike("^[0-9]{14}$") & day.isNotNull(), "available": F.date_add(day, 1)})


def concepts(spark, sf_dir: str) -> DataFrame:
    """What a fact's name stands for, its basis by length of period, and its value at scale."""
    name = _one_of(CONCEPT_NAMES, "p_partkey")
    local = F.regexp_replace(F.regexp_replace(name, "^.*:", ""), "^[^_]*_", "")
    compact = F.regexp_replace(local, r"[^0-9A-Za-z가-힣]", "")
    days = (F.col("p_partkey") * 37) % 400
    basis = F.when(days >= 300, "FY").when(days <= 100, "Q").when(days <= 200, "H1").otherwise("Q3")
    unit = _one_of(UNIT_NAMES, "p_partkey")
    scaled = F.when(T.unit(unit, "currency").isNotNull(), F.col("p_retailprice") * T.unit(unit, "scale")).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", T.first_match(compact, T.CONCEPTS).alias("concept"), basis.alias("basis"), F.round(scaled, 2).alias("value"), F.coalesce(T.unit(unit, "currency"), T.unit(unit, "name")).alias("unit"))


def labels_of_names(spark, sf_dir: str) -> DataFrame:
    """Kinds of security by two rules for trusts, quote symbols, and roles of section titles."""
    name, ticker = _one_of(SECURITY_NAMES, "s_suppkey"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    current = tuple((kind, T.CURRENT_REIT if kind == "REIT" else pattern) for kind, pattern in T.SECURITY_KINDS)
    symbol = F.concat(ticker, F.when(F.col("s_suppkey") % 2 == 0, ".KS").otherwise(".KQ"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", T.first_match(name, T.SECURITY_KINDS, "COMMON", "").alias("kind"), T.first_match(name, current, "COMMON", "").alias("current_kind"), symbol.alias("symbol"),
        T.first_match(_one_of(TITLES, "s_suppkey"), ROLES).alias("role"),
    )


def atoms(spark, sf_dir: str) -> DataFrame:
    """Each text's sentences and rows: how many, the longest, and a digest that no order of the text's parts changes."""
    rows = _texts(spark, sf_dir).select("doc_id", T.atomic_units(F.col("text")).alias("u"))
    return rows.select("doc_id", F.size("u").cast("long").alias("units"), F.coalesce(F.array_max(F.transform("u", F.length)), F.lit(0)).cast("long").alias("longest"), F.sha2(F.array_join("u", "\n"), 256).alias("digest"))


def token_estimates(spark, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


def packed_lines(spark, sf_dir: str) -> DataFrame:
    """Each text's lines in batches of at most ``BATCH_TOKENS`` estimated tokens, in order: batches, and the tokens of the largest."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    rows = _texts(spark, sf_dir).select("doc_id", F.transform(lines, T.estimated_tokens).alias("t")).withColumn("b", batches(F.col("t"), BATCH_TOKENS))
    sums = rows.select("doc_id", F.explode(F.arrays_zip("b", "t")).alias("x")).groupBy("doc_id", "x.b").agg(F.sum("x.t").alias("tokens"))
    return sums.groupBy("doc_id").agg(F.count("*").alias("batches"), F.max("tokens").alias("largest"))


def printed_numbers(spark, sf_dir: str) -> DataFrame:
    """The numbers of each text in order, as they are compared between versions."""
    found = F.regexp_extract_all("text", F.lit(T.NUMBER), F.lit(0))
    return _texts(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("numbers"), F.sha2(F.array_join(found, "|"), 256).alias("digest"))


def grounded_quotes(spark, sf_dir: str) -> DataFrame:
    """Whether a few words of each text, with other blanks, stand in it and in the next document."""
    words = F.filter(F.split(F.regexp_replace("text", r"[ \t\n\r]+", " "), " ", -1), lambda w: w != "")
    rows = _texts(spark, sf_dir).select("doc_id", F.btrim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("flat"), F.array_join(F.slice(words, *QUOTED), "  ").alias("quote"))
    following = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("flat").alias("later"))
    asked = F.regexp_replace("quote", r" +", " ")
    holds = lambda flat: (asked != "") & F.coalesce(F.col(flat).contains(asked), F.lit(False))
    return rows.join(following, "doc_id", "left").select("doc_id", holds("flat").alias("grounded"), holds("later").alias("in_next"))


def reliability(spark, sf_dir: str) -> DataFrame:
    """Reliability that a policy allows, by type of statement, source, quote, scope and mechanism."""
    key = F.col("c_custkey")
    kind = _one_of(tuple(CAPS), "c_custkey")
    kind = F.when((kind == "DISCLOSED_FACT") & (key % 4 == 0), "MANAGEMENT_CLAIM").otherwise(kind)
    cap = F.lit(None).cast("double")
    for name, value in CAPS.items():
        cap = F.when(kind == name, value).otherwise(cap)
    cap = F.when((key % 3 == 0) & kind.isin("MANAGEMENT_CLAIM", "FORECAST"), cap - 0.05).otherwise(cap)
    cap = F.when(key % 7 == 0, F.least(cap, F.lit(0.20))).otherwise(cap)
    cap = F.when(key % 5 == 0, F.least(cap, F.lit(0.50))).otherwise(cap)
    cap = F.when((key % 11 == 0) & (key % 2 == 0), F.least(cap, F.lit(0.30))).otherwise(cap)
    return table(spark, sf_dir, "customer").select("c_custkey", kind.alias("statement"), F.round(F.greatest(F.lit(0.0), cap), 2).alias("reliability"))


def buckets(spark, sf_dir: str) -> DataFrame:
    """Buckets of stated values, and labels as slots."""
    stated = F.when(F.col("c_custkey") % 4 == 0, F.concat((F.col("c_custkey") % 70).cast("string"), F.lit(" %"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("about -"), (F.col("c_custkey") % 13).cast("string"), F.lit(".5 times"))).when(F.col("c_custkey") % 4 == 2, "Very High!").otherwise("1,200")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", stated.alias("stated"))
    return rows.select("c_custkey", T.value_bucket(F.col("stated")).alias("bucket"), T.slot(F.concat(F.lit(" "), "c_mktsegment", F.lit("-- Unit 가 ")), "other").alias("slot"))


def quarantined(spark, sf_dir: str) -> DataFrame:
    """Each text without lines of market opinion, and how many there were."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(F.regexp_replace(x, "[ \t ]+", " ")))
    kept = F.filter("lines", lambda x: ~x.rlike(T.OPINION))
    rows = _texts(spark, sf_dir).select("doc_id", lines.alias("lines"))
    return rows.select("doc_id", (F.size("lines") - F.size(kept)).cast("long").alias("removed"), F.sha2(F.array_join(kept, "\n"), 256).alias("digest"))


def term_scores(spark, sf_dir: str) -> DataFrame:
    """Three for each term of evidence, two for each percentage, of which eight count, and one for each term of what has come about."""
    low = F.lower("text")
    hits, came = (sum((T.occurrences(low, t) for t in terms), F.lit(0).cast("long")) for terms in (TERMS, REALISED))
    shares = F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)?[ ]*%"), F.lit(0)))
    return _texts(spark, sf_dir).select("doc_id", (3 * hits + 2 * F.least(F.lit(8), shares) + came).cast("long").alias("score"), F.length("text").cast("long").alias("length"))


def anonymous(spark, sf_dir: str) -> DataFrame:
    """Texts without their source's name, their first word, and dates."""
    first = F.regexp_extract("text", r"^[ \t\n\r]*([A-Za-z]{3,})", 1)
    out = T.masked(F.col("text"), [F.col("source"), first], {"[DATE]": r"(19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}"})
    return _texts(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("digest"))


def _axes(spark, sf_dir: str) -> DataFrame:
    """Direction of each axis between an issuer's consecutive years; null where it cannot be told."""
    order = Window.partitionBy("issuer").orderBy("fiscal_year")
    rows = fundamentals(spark, sf_dir).withColumns({
        "margin": F.when(F.col("revenue") > 0, F.col("ebit") / F.col("revenue")), "capex_intensity": F.when(F.col("revenue") > 0, F.col("capex") / F.col("revenue")),
    })
    names = ("fiscal_year", "revenue", "cash", "margin", "capex_intensity")
    pairs = rows.withColumns({f"{c}0": F.lag(c).over(order) for c in names}).filter("fiscal_year0 = fiscal_year - 1")
    growth = F.col("revenue") / F.col("revenue0") - 1
    moves = {"margin": F.col("margin") - F.col("margin0"), "cash_mismatch": F.col("cash") / F.col("cash0") - 1 - growth, "growth": growth, "capex_intensity": F.col("capex_intensity") - F.col("capex_intensity0")}
    sign = lambda x, t: F.when(F.round(x, 9) > t, 1).when(F.round(x, 9) < -t, -1).when(x.isNotNull(), 0)
    return pairs.select("issuer", "fiscal_year", F.round(growth, 9).alias("next_growth"), *((-sign(m, TOLERANCES[n]) if n == "cash_mismatch" else sign(m, TOLERANCES[n])).cast("long").alias(n) for n, m in moves.items()))


def axis_directions(spark, sf_dir: str) -> DataFrame:
    return _axes(spark, sf_dir).drop("next_growth")


def _breadth(spark, sf_dir: str) -> DataFrame:
    known = [F.col(n) for n in TOLERANCES]
    observed = sum((k.isNotNull().cast("long") for k in known), F.lit(0).cast("long"))
    net = sum((F.coalesce(k, F.lit(0).cast("long")) for k in known[:3]), F.lit(0).cast("long"))
    scored = sum((k.isNotNull().cast("long") for k in known[:3]), F.lit(0).cast("long"))
    return _axes(spark, sf_dir).withColumns({"observed": observed, "net": net, "breadth": F.when(scored > 0, F.round(net / scored, 9)), "coverage": F.round(observed / len(known), 6)})


def signed_breadth(spark, sf_dir: str) -> DataFrame:
    """Net direction over the axes that are scored, and the share of axes observed; the last axis is recorded but not scored."""
    return _breadth(spark, sf_dir).select("issuer", "fiscal_year", "observed", "net", F.round("breadth", 6).alias("breadth"), "coverage")


def score_bands(spark, sf_dir: str) -> DataFrame:
    """Five fixed bands of twice the net direction, by year."""
    score = 2 * F.col("net")
    band = F.when(score <= -3, "Q1").when(score <= -1, "Q2").when(score == 0, "Q3").when(score <= 2, "Q4").otherwise("Q5")
    return _breadth(spark, sf_dir).withColumn("band", band).groupBy("fiscal_year", "band").agg(F.count("*").alias("n"))


def sparse_bands(spark, sf_dir: str) -> DataFrame:
    """Cut points half way between neighbouring distinct values, at fifths of their number, from rows with two axes or more."""
    values = _breadth(spark, sf_dir).filter("observed >= 2 and breadth is not null").groupBy("fiscal_year").agg(F.array_sort(F.collect_set("breadth")).alias("v"), F.count("*").alias("rows"))
    cut = lambda k: F.when(F.size("v") >= 5, (F.get("v", F.floor(F.size("v") * k / 5).cast("int") - 1) + F.get("v", F.floor(F.size("v") * k / 5).cast("int"))) / 2)
    return values.select("fiscal_year", "rows", F.size("v").cast("long").alias("distinct_values"), *(F.round(cut(k), 6).alias(f"cut_{k}") for k in range(1, 5)))


def monotone_bands(spark, sf_dir: str) -> DataFrame:
    """Mean growth of the year after by sign of the net direction, and whether the means never fall."""
    later = _axes(spark, sf_dir).select("issuer", (F.col("fiscal_year") - 1).alias("fiscal_year"), F.col("next_growth").alias("outcome"))
    rows = _breadth(spark, sf_dir).withColumn("band", F.signum("net").cast("long")).join(later, ["issuer", "fiscal_year"])
    bands = rows.groupBy("fiscal_year", "band").agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 8).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("band", "mean", "n")))
    wide = bands.groupBy("fiscal_year").agg(ordered.alias("b"))
    rising = F.forall(F.sequence(F.lit(1), F.size("b")), lambda k: (k == F.size("b")) | (F.get("b", k)["mean"] >= F.get("b", k - 1)["mean"]) | F.get("b", k)["mean"].isNull())
    means = F.filter(F.col("b.mean"), lambda x: x.isNotNull())
    last, first = F.try_element_at(means, F.lit(-1)), F.get(means, F.lit(0))
    return wide.select("fiscal_year", F.size("b").cast("long").alias("bands"), F.round(last - first, 6).alias("spread"), F.coalesce(rising, F.lit(True)).alias("monotone"))


def claims(spark, sf_dir: str) -> DataFrame:
    """Turns with the same role and normal opening are one claim: its first holder, and how many conversations make it."""
    opening = T.slot(F.substring(F.coalesce("text", F.lit("")), 1, 24), "empty")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", opening.alias("claim"))
    return rows.groupBy("role", "claim").agg(F.count_distinct("conv_id").alias("conversations"), F.min(F.struct("conv_id", "turn")).alias("first")).select("role", "claim", "conversations", F.col("first.conv_id").alias("conv_id"), F.col("first.turn").alias("turn"))


def run_overlap(spark, sf_dir: str) -> DataFrame:
    """Overlap of the sets of event types and hours that two runs, odd and even events, saw for each user."""
    rows = table(spark, sf_dir, "events").select("user_id", F.concat_ws("|", "event_type", F.hour("ts").cast("string")).alias("seen"), (F.col("event_id") % 2).alias("run"))
    sets = rows.groupBy("user_id", "seen").agg(F.max((F.col("run") == 0).cast("long")).alias("a"), F.max((F.col("run") == 1).cast("long")).alias("b"))
    return sets.groupBy("user_id").agg(F.sum("a").alias("first"), F.sum("b").alias("second"), F.round(F.sum(F.col("a") * F.col("b")) / F.count("*"), 8).alias("jaccard"))


def duplicate_groups(spark, sf_dir: str) -> DataFrame:
    """Groups of documents joined by equal normal text or an equal opening, named by the least document."""
    keys = F.array(F.concat(F.lit("t"), F.sha2(T.normalized(F.col("text")), 256)), F.concat(F.lit("o"), F.sha2(F.substring("text", 1, 40), 256)))
    keyed = _texts(spark, sf_dir).filter(F.length("text") >= 40).select("doc_id", F.explode(keys).alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = connected_components(keyed.join(least, "key").select(F.col("doc_id").alias("u"), "v"))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("group"))


QUERIES = {
    "normalize_text": normal_texts,
    "stable_ids": ids,
    "numeric_parse": numbers,
    "unit_normalise": units,
    "period_markers": periods,
    "month_shift": month_shifts,
    "report_periods": report_periods,
    "receipt_availability": receipts,
    "canonical_concepts": concepts,
    "security_and_section_labels": labels_of_names,
    "atomic_split": atoms,
    "token_estimate": token_estimates,
    "chunk_pack": packed_lines,
    "number_tokens": printed_numbers,
    "quote_grounding": grounded_quotes,
    "reliability_caps": reliability,
    "value_buckets": buckets,
    "opinion_quarantine": quarantined,
    "evidence_terms": term_scores,
    "anonymise": anonymous,
    "axis_direction": axis_directions,
    "signed_breadth": signed_breadth,
    "score_band": score_bands,
    "sparse_bands": sparse_bands,
    "band_monotonicity": monotone_bands,
    "claim_canonical": claims,
    "jaccard_runs": run_overlap,
    "dup_components": duplicate_groups,
}


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, key: str) -> str:
    return f"{_quoted(values)}[{key} % {len(values)} + 1]"


def _ladder(text: str, rules, otherwise: str = "NULL", prefix: str = "(?i)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{prefix}{pattern}') THEN '{name}'" for name, pattern in rules) + f" ELSE {otherwise} END"


def _unit_sql(raw: str, at: int) -> str:
    compact = f"upper(regexp_replace({raw}, '[ \\t\\n]', '', 'g'))"
    say = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE")
    return "CASE " + " ".join(f"WHEN regexp_full_match({compact}, '{rule[0]}') THEN {say(rule[at])}" for rule in T.UNITS) + " END"


_DOCS = "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"
_NORMAL = r"""trim(array_to_string(list_filter(ln, lambda x, i: x <> '' OR (i > 1 AND ln[i - 1] <> '')), chr(10)), chr(10) || ' ')"""
_LINES = r"""list_transform(string_split(replace(text, chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), ' '))"""
_AXES = WIDE_SQL + """,
mg AS (SELECT *, CASE WHEN revenue > 0 THEN ebit / revenue END AS m, CASE WHEN revenue > 0 THEN capex / revenue END AS ci FROM wide),
pr AS (SELECT a.issuer, a.fiscal_year, round(a.revenue / b.revenue - 1, 9) AS g, round(a.m - b.m, 9) AS dm, round(a.cash / b.cash - 1 - (a.revenue / b.revenue - 1), 9) AS dc, round(a.ci - b.ci, 9) AS dx FROM mg a JOIN mg b ON a.issuer = b.issuer AND b.fiscal_year = a.fiscal_year - 1),
ax AS (SELECT issuer, fiscal_year, g AS next_growth, (CASE WHEN dm > 0.005 THEN 1 WHEN dm < -0.005 THEN -1 WHEN dm IS NOT NULL THEN 0 END)::BIGINT AS margin, (CASE WHEN dc > 0.05 THEN -1 WHEN dc < -0.05 THEN 1 WHEN dc IS NOT NULL THEN 0 END)::BIGINT AS cash_mismatch,
  (CASE WHEN g > 0.05 THEN 1 WHEN g < -0.05 THEN -1 WHEN g IS NOT NULL THEN 0 END)::BIGINT AS growth, (CASE WHEN dx > 0.01 THEN 1 WHEN dx < -0.01 THEN -1 WHEN dx IS NOT NULL THEN 0 END)::BIGINT AS capex_intensity FROM pr),
br AS (SELECT *, (margin IS NOT NULL)::BIGINT + (cash_mismatch IS NOT NULL)::BIGINT + (growth IS NOT NULL)::BIGINT AS scored, (margin IS NOT NULL)::BIGINT + (cash_mismatch IS NOT NULL)::BIGINT + (growth IS NOT NULL)::BIGINT + (capex_intensity IS NOT NULL)::BIGINT AS observed,
  coalesce(margin, 0) + coalesce(cash_mismatch, 0) + coalesce(growth, 0) AS net FROM ax)"""

ORACLE_SQL = {
    "normalize_text": _DOCS + f",\nl AS (SELECT doc_id, {_LINES} AS ln FROM d)\nSELECT doc_id, sha256({_NORMAL}) AS digest FROM l",
    "stable_ids": """SELECT doc_id, 'DOC_' || substr(sha256('["' || coalesce(source, '') || '","' || doc_id || '"]'), 1, 20) AS stable_id FROM documents""",
    "numeric_parse": r"""
WITH w AS (SELECT c_custkey, format('{:,}', floor(abs(c_acctbal))::BIGINT) AS w FROM customer),
r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '(' || w || '.5)' WHEN 1 THEN (c_custkey % 90) || '.5%' WHEN 2 THEN '—' WHEN 3 THEN ' ' || w WHEN 4 THEN 'N/A' ELSE '-' || w || '.25' END AS raw FROM w),
v AS (SELECT *, replace(raw, ' ', '') AS v FROM r)
SELECT c_custkey, raw, round(CASE WHEN regexp_full_match(v, '\(([0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\.[0-9]+)?\)') THEN -replace(regexp_extract(v, '\(([0-9,]+)', 1), ',', '')::DOUBLE
  WHEN regexp_full_match(v, '[+-]?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\.[0-9]+)?%?') THEN regexp_replace(v, '[,%]', '', 'g')::DOUBLE / CASE WHEN v LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END END, 6) AS value FROM v""",
    "unit_normalise": f"""
WITH r AS (SELECT p_partkey, {_pick(UNIT_NAMES, 'p_partkey')} AS raw, {_pick(UNIT_TEXTS, 'p_partkey')} AS text FROM part),
m AS (SELECT p_partkey, raw, list_transform(regexp_extract_all(text, '{T.UNIT_MARK}', 1), lambda x: trim(x, ' ()[]')) AS marks FROM r)
SELECT p_partkey, {_unit_sql('raw', 1)} AS name, {_unit_sql('raw', 2)} AS scale, {_unit_sql('raw', 3)} AS currency, list_filter(list_transform(marks, lambda x: {_unit_sql('x', 1)}), lambda x: x IS NOT NULL)[-1] AS marked FROM m""",
    "period_markers": f"""
WITH s AS (SELECT o_orderkey, year(o_orderdate) + 10 AS y, quarter(o_orderdate) AS q FROM orders),
f AS (SELECT o_orderkey, regexp_extract_all(y || '년 ' || q || '분기, ' || (y - 1) || ' FY, ' || (y + 3) || ' plan', '{T.YEAR_MARK}') AS f FROM s),
m AS (SELECT o_orderkey, trim(unnest(f)) AS raw, generate_subscripts(f, 1) AS place FROM f)
SELECT o_orderkey, arg_max(substr(raw, 1, 4)::INTEGER, (substr(raw, 1, 4)::INTEGER, place)) AS year, arg_max(raw, (substr(raw, 1, 4)::INTEGER, place)) AS label FROM m WHERE length(raw) > 4 GROUP BY 1""",
    "month_shift": """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day, CASE WHEN day = last_day(day) THEN last_day((day + INTERVAL 3 MONTH)::DATE) ELSE (day + INTERVAL 3 MONTH)::DATE END AS quarter_later, CASE WHEN day = last_day(day) THEN last_day((day - INTERVAL 12 MONTH)::DATE) ELSE (day - INTERVAL 12 MONTH)::DATE END AS year_before FROM d""",
    "report_periods": with_views("dates") + """,
p AS (SELECT signal_date, code, y || label AS label, make_date(y, m, d) AS period_end FROM dates, LATERAL (SELECT unnest(range(year(signal_date) - 2, year(signal_date) + 1)) AS y), (VALUES ('11013', 'Q1', 3, 31), ('11012', 'H1', 6, 30), ('11014', 'Q3', 9, 30), ('11011', 'FY', 12, 31)) AS r(code, label, m, d))
SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY period_end DESC)::INTEGER AS place FROM p WHERE period_end < signal_date""",
    "receipt_availability": """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '19970231' ELSE strftime(o_orderdate, '%Y%m%d') END || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS number FROM orders),
d AS (SELECT *, try_strptime(substr(number, 1, 8), '%Y%m%d')::DATE AS day FROM n)
SELECT o_orderkey, number, regexp_full_match(number, '[0-9]{14}') AND day IS NOT NULL AS valid, day + 1 AS available FROM d""",
    "canonical_concepts": f"""
WITH n AS (SELECT p_partkey, p_retailprice, regexp_replace(regexp_replace(regexp_replace({_pick(CONCEPT_NAMES, 'p_partkey')}, '^.*:', ''), '^[^_]*_', ''), '[^0-9A-Za-z가-힣]', '', 'g') AS c, p_partkey * 37 % 400 AS days, {_pick(UNIT_NAMES, 'p_partkey')} AS u FROM part),
x AS (SELECT *, {_unit_sql('u', 1)} AS un, {_unit_sql('u', 2)} AS us, {_unit_sql('u', 3)} AS uc FROM n)
SELECT p_partkey, {_ladder('c', T.CONCEPTS)} AS concept, CASE WHEN days >= 300 THEN 'FY' WHEN days <= 100 THEN 'Q' WHEN days <= 200 THEN 'H1' ELSE 'Q3' END AS basis, round(CASE WHEN uc IS NOT NULL THEN p_retailprice * us ELSE p_retailprice END, 2) AS value, coalesce(uc, un) AS unit FROM x""",
    "security_and_section_labels": f"""
WITH n AS (SELECT s_suppkey, {_pick(SECURITY_NAMES, 's_suppkey')} AS name, {_pick(TITLES, 's_suppkey')} AS title FROM supplier)
SELECT s_suppkey, {_ladder('name', T.SECURITY_KINDS, "'COMMON'", '')} AS kind, {_ladder('name', [(k, T.CURRENT_REIT if k == 'REIT' else p) for k, p in T.SECURITY_KINDS], "'COMMON'", '')} AS current_kind,
  lpad(s_suppkey::VARCHAR, 6, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '.KS' ELSE '.KQ' END AS symbol, {_ladder('title', ROLES)} AS role FROM n""",
    "atomic_split": _DOCS + r""",
l AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', chr(10), 'g'), '(?i)<br[ ]*/?>', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), ' ')) AS ln FROM d),
s AS (SELECT doc_id, list_transform(ln, lambda x: CASE WHEN regexp_matches(x, '^#{1,6} ') OR regexp_matches(x, '^\|?( ?:?-{3,}:? ?\|)+$') THEN ''
  WHEN contains(x, '|') THEN chr(10) || chr(10) || array_to_string(list_filter(list_transform(string_split(trim(x, '|'), '|'), lambda c: trim(c, ' ')), lambda c: c <> ''), ' | ') || chr(10) || chr(10) ELSE regexp_replace(x, '^([-*+] |[0-9]+[.)] )', '') END) AS sh FROM l),
p AS (SELECT doc_id, list_transform(list_filter(string_split_regex(array_to_string(sh, chr(10)), '\n\n+'), lambda x: trim(x, ' ' || chr(10)) <> ''), lambda x: trim(regexp_replace(x, '[ \n]+', ' ', 'g'), ' ')) AS f FROM s),
t AS (SELECT doc_id, flatten(list_transform(f, lambda x: CASE WHEN contains(x, ' | ') THEN [x] ELSE string_split(regexp_replace(x, '([.!?。！？]) ', '\1' || chr(1), 'g'), chr(1)) END)) AS s FROM p),
w AS (SELECT doc_id, flatten(list_transform(list_filter(s, lambda x: x <> ''), lambda x: list_transform(range(0, (len(string_split(x, ' ')) - 1) // 180 + 1), lambda k: array_to_string(list_slice(string_split(x, ' '), k * 180 + 1, k * 180 + 180), ' ')))) AS u FROM t),
u AS (SELECT doc_id, list_sort(list_distinct(list_filter(u, lambda x: length(x) >= 8 AND regexp_matches(x, '[\p{L}\p{N}]')))) AS u FROM w)
SELECT doc_id, len(u)::BIGINT AS units, coalesce(list_max(list_transform(u, lambda x: length(x))), 0)::BIGINT AS longest, sha256(coalesce(array_to_string(u, chr(10)), '')) AS digest FROM u""",
    "token_estimate": _DOCS + rf""",
p AS (SELECT doc_id, regexp_extract_all(text, '{T.PIECE}') AS p FROM d)
SELECT doc_id, greatest(1, ceil(coalesce(list_sum(list_transform(p, lambda x: CASE WHEN length(x) = 1 THEN 4 ELSE greatest(4, length(x)) END)), 0) / 4))::BIGINT AS tokens FROM p""",
    "number_tokens": _DOCS + f",\nf AS (SELECT doc_id, regexp_extract_all(text, '{T.NUMBER}') AS f FROM d)\nSELECT doc_id, len(f)::BIGINT AS numbers, sha256(array_to_string(f, '|')) AS digest FROM f",
    "quote_grounding": _DOCS + r""",
f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' ') AS flat FROM d),
q AS (SELECT doc_id, flat, array_to_string(list_slice(list_filter(string_split(flat, ' '), lambda w: w <> ''), 3, 10), ' ') AS q FROM f)
SELECT a.doc_id, a.q <> '' AND contains(a.flat, a.q) AS grounded, a.q <> '' AND coalesce(contains(b.flat, a.q), false) AS in_next FROM q a LEFT JOIN q b ON b.doc_id = a.doc_id + 1""",
    "reliability_caps": f"""
WITH k AS (SELECT c_custkey AS c, {_pick(CAPS, 'c_custkey')} AS k0 FROM customer),
s AS (SELECT c, CASE WHEN k0 = 'DISCLOSED_FACT' AND c % 4 = 0 THEN 'MANAGEMENT_CLAIM' ELSE k0 END AS k FROM k),
b AS (SELECT *, CASE k WHEN 'DISCLOSED_FACT' THEN 0.95 WHEN 'DERIVED_METRIC' THEN 0.90 WHEN 'MANAGEMENT_CLAIM' THEN 0.60 WHEN 'FORECAST' THEN 0.50 ELSE 0.65 END - CASE WHEN c % 3 = 0 AND k IN ('MANAGEMENT_CLAIM', 'FORECAST') THEN 0.05 ELSE 0 END AS v FROM s)
SELECT c AS c_custkey, k AS statement, round(least(v, CASE WHEN c % 7 = 0 THEN 0.20 ELSE 1 END, CASE WHEN c % 5 = 0 THEN 0.50 ELSE 1 END, CASE WHEN c % 22 = 0 THEN 0.30 ELSE 1 END), 2)::DOUBLE AS reliability FROM b""",
    "value_buckets": r"""
WITH r AS (SELECT c_custkey, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 70) || ' %' WHEN 1 THEN 'about -' || (c_custkey % 13) || '.5 times' WHEN 2 THEN 'Very High!' ELSE '1,200' END AS s FROM customer),
n AS (SELECT *, CASE WHEN regexp_matches(s, '[0-9]') THEN abs(regexp_extract(replace(s, ',', ''), '[-+]?[0-9]+(\.[0-9]+)?')::DOUBLE) END AS n FROM r)
SELECT c_custkey, CASE WHEN n IS NULL THEN trim(regexp_replace(lower(s), '[^0-9a-z가-힣一-龥%><=]+', '_', 'g'), '_') WHEN contains(s, '%') THEN CASE WHEN n < 5 THEN 'pct_lt_5' WHEN n < 20 THEN 'pct_5_20' WHEN n < 50 THEN 'pct_20_50' ELSE 'pct_ge_50' END
  ELSE CASE WHEN n < 1 THEN 'lt_1' WHEN n < 3 THEN '1_3' WHEN n < 10 THEN '3_10' ELSE 'ge_10' END END AS bucket, trim(regexp_replace(lower(' ' || c_mktsegment || '-- Unit 가 '), '[^0-9a-z가-힣一-龥%><=]+', '_', 'g'), '_') AS slot FROM n""",
    "opinion_quarantine": _DOCS + rf""",
l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{{00A0}}]+', ' ', 'g'), ' ')) AS ln FROM d),
k AS (SELECT doc_id, ln, list_filter(ln, lambda x: NOT regexp_matches(x, '{T.OPINION}')) AS kept FROM l)
SELECT doc_id, (len(ln) - len(kept))::BIGINT AS removed, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS digest FROM k""",
    "evidence_terms": _DOCS + "\nSELECT doc_id, (3 * (" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in TERMS) + r") + 2 * least(8, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?[ ]*%'))) + " + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in REALISED) + ")::BIGINT AS score, length(text)::BIGINT AS length FROM d",
    "anonymise": _DOCS + r""",
f AS (SELECT doc_id, text, coalesce(source, '') AS source, regexp_extract(text, '^[ \t\n\r]*([A-Za-z]{3,})', 1) AS word FROM d),
o AS (SELECT doc_id, text, CASE WHEN length(word) > length(source) THEN word ELSE source END AS a, CASE WHEN length(word) > length(source) THEN source ELSE word END AS b FROM f),
m AS (SELECT doc_id, CASE WHEN a <> '' THEN regexp_replace(text, a, '[ENTITY]', 'gi') ELSE text END AS t, b FROM o),
n AS (SELECT doc_id, CASE WHEN b <> '' THEN regexp_replace(t, b, '[ENTITY]', 'gi') ELSE t END AS t FROM m)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(t, '(19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}', '[DATE]', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')) AS digest FROM n""",
    "axis_direction": _AXES + "\nSELECT issuer, fiscal_year, margin, cash_mismatch, growth, capex_intensity FROM ax",
    "signed_breadth": _AXES + "\nSELECT issuer, fiscal_year, observed, net, round(CASE WHEN scored > 0 THEN round(net / scored, 9) END, 6) AS breadth, round(observed / 4, 6) AS coverage FROM br",
    "score_band": _AXES + "\nSELECT fiscal_year, CASE WHEN 2 * net <= -3 THEN 'Q1' WHEN 2 * net <= -1 THEN 'Q2' WHEN net = 0 THEN 'Q3' WHEN 2 * net <= 2 THEN 'Q4' ELSE 'Q5' END AS band, count(*) AS n FROM br GROUP BY 1, 2",
    "sparse_bands": _AXES + """,
v AS (SELECT fiscal_year, list_sort(list_distinct(list(round(net / scored, 9)))) AS v, count(*) AS rows FROM br WHERE observed >= 2 AND scored > 0 GROUP BY 1)
SELECT fiscal_year, rows, len(v)::BIGINT AS distinct_values, """ + ", ".join(f"CASE WHEN len(v) >= 5 THEN round((v[len(v) * {k} // 5] + v[len(v) * {k} // 5 + 1]) / 2, 6) END AS cut_{k}" for k in range(1, 5)) + " FROM v",
    "band_monotonicity": _AXES + """,
b AS (SELECT br.fiscal_year, sign(net) AS band, count(*) AS n, round(avg(o.next_growth), 8) AS mean FROM br JOIN ax o ON o.issuer = br.issuer AND o.fiscal_year = br.fiscal_year + 1 GROUP BY 1, 2),
w AS (SELECT *, lag(mean) OVER (PARTITION BY fiscal_year ORDER BY band) AS before FROM b)
SELECT fiscal_year, count(*) AS bands, round(arg_max(mean, band) - arg_min(mean, band), 6) AS spread, coalesce(bool_and(before IS NULL OR mean IS NULL OR mean >= before), true) AS monotone FROM w GROUP BY 1""",
    "claim_canonical": r"""
WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(substr(coalesce(text, ''), 1, 24)), '[^0-9a-z가-힣一-龥%><=]+', '_', 'g'), '_') AS s FROM conversations)
SELECT role, CASE WHEN s = '' THEN 'empty' ELSE s END AS claim, count(DISTINCT conv_id) AS conversations, arg_min(conv_id, (conv_id, turn)) AS conv_id, arg_min(turn, (conv_id, turn)) AS turn FROM c GROUP BY 1, 2""",
    "jaccard_runs": """
WITH s AS (SELECT user_id, event_type || '|' || hour(ts) AS seen, max((event_id % 2 = 0)::BIGINT) AS a, max((event_id % 2 = 1)::BIGINT) AS b FROM events GROUP BY 1, 2)
SELECT user_id, sum(a)::BIGINT AS first, sum(b)::BIGINT AS second, round(sum(a * b) / count(*), 8) AS jaccard FROM s GROUP BY 1""",
    "dup_components": _DOCS.replace("WITH ", "WITH RECURSIVE ", 1) + rf""",
l AS (SELECT doc_id, text, {_LINES} AS ln FROM d WHERE length(text) >= 40),
k AS (SELECT doc_id, 't' || sha256({_NORMAL}) AS key FROM l UNION ALL SELECT doc_id, 'o' || sha256(substr(text, 1, 40)) FROM l),
g AS (SELECT key, min(doc_id) AS v FROM k GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT DISTINCT k.doc_id AS a, g.v AS b FROM k JOIN g USING (key) WHERE k.doc_id <> g.v),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM x UNION SELECT r.node, x.b FROM r JOIN x ON r.reach = x.a)
SELECT node AS doc_id, min(reach) AS "group" FROM r GROUP BY 1""",
}
