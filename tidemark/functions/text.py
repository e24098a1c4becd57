"""Text and label rules as column expressions.

Patterns avoid lookaround, so that other SQL engines read them alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.arrays import let

BLANKS = r"[ \t\r\f\x0B]+"
#: A word of letters, a run of Hangul, or a number; and one piece of an estimate of tokens.
TOKEN = r"[A-Za-z][A-Za-z0-9_-]*|[가-힣]{2,}|[0-9]+(?:\.[0-9]+)?"
PIECE = r"[가-힣]|[一-龥]|[A-Za-z0-9_]+|[^ \t\n\r\f\x0B]"
#: Numbers as they are compared between versions of a text.
NUMBER = r"[-+]?[0-9][0-9,.]*(?:%|개월|년|월|일)?"
#: Units in capitals without blanks, what they are called, their scale and currency; the first that matches whole.
UNITS = (
    (r"백만원|백만KRW|KRW백만", "KRW_MILLION", 1e6, "KRW"), (r"천원|천KRW|KRW천", "KRW_THOUSAND", 1e3, "KRW"), (r"억원|억KRW|KRW억", "KRW_HUNDRED_MILLION", 1e8, "KRW"),
    (r"백만USD|USD백만", "USD_MILLION", 1e6, "USD"), (r"천USD|USD천", "USD_THOUSAND", 1e3, "USD"), (r"USD|달러", "USD", 1.0, "USD"), (r"KRW|원", "KRW", 1.0, "KRW"),
    (r"%|PERCENT", "PERCENT", 1.0, None), (r"명|PERSON", "PERSON", 1.0, None), (r"KG|킬로그램", "KILOGRAM", 1.0, None), (r"TON|TONNE|톤", "TONNE", 1.0, None), (r"EA|개|대|건|주", "COUNT", 1.0, None),
)
UNIT_MARK = r"(?i)단위[ ]*[:：][ ]*([^)\n\r,;]{1,40})"
#: A year of this century with an optional mark and period.
YEAR_MARK = r"(?i)(20[0-9]{2})([ ]*년)?(?:[ ]*(Q[1-4]|[1-4]Q|[1-4]분기|반기|FY|H[12]))?"
#: Concepts by their names without prefix and marks, in order.
CONCEPTS = (
    ("REVENUE", r"^(?:revenue|revenues|salesrevenue|sales|revenuefromcontractwithcustomer.*)$"),
    ("EBIT", r"^(?:operatingincome(?:loss)?|operatingprofit(?:loss)?|profitlossfromoperatingactivities|영업이익)$"),
    ("NET_INCOME", r"^(?:netincome(?:loss)?|profitloss|profitlossfortheperiod|netprofitloss|당기순이익|분기순이익|반기순이익)$"),
    ("CFO", r"^(?:netcashprovidedbyusedinoperatingactivities(?:continuingoperations)?|cashflowsfromusedinoperatingactivities(?:continuingoperations)?|영업활동현금흐름)$"),
    ("CAPEX", r"^(?:paymentstoacquirepropertyplantandequipment|purchaseofpropertyplantandequipment(?:classifiedasinvestingactivities)?|capitalexpenditures?|유형자산의취득)$"),
    ("CASH", r"^(?:cashandcashequivalents|cashandcashequivalentsatendofperiodcf|현금및현금성자산|기말현금및현금성자산)$"),
    ("TOTAL_DEBT", r"^(?:totalborrowings|borrowings|borrowingsanddebentures|총차입금)$"),
    ("SHORT_TERM_DEBT", r"^(?:shorttermborrowings|currentborrowings|currentportionoflongtermdebt|currentportionofdebentures|단기차입금|유동성장기차입금|유동성사채)$"),
    ("LONG_TERM_DEBT", r"^(?:longtermdebt|longtermborrowings|debentures|장기차입금|사채)$"),
    ("LEASE_LIABILITIES", r"^(?:current|noncurrent)?leaseliabilit(?:y|ies)|리스부채$"),
    ("CONVERTIBLE_LIABILITIES", r"^(?:convertiblebonds?|convertibledebts?|전환사채)$"),
    ("PREFERRED_LIABILITIES", r"^(?:redeemablepreferredshares?|preferredshareliabilit(?:y|ies)|상환전환우선주)$"),
    ("DEPRECIATION_AMORTIZATION", r"^(?:depreciation(?:andamorti[sz]ation)?|amorti[sz]ation|depreciationandamortisationexpense|감가상각비|무형자산상각비)$"),
    ("R_AND_D_EXPENSE", r"^(?:researchanddevelopmentexpense|researchdevelopmentexpense|연구개발비)$"),
    ("RECEIVABLES", r"^(?:tradeandothercurrentreceivables|tradereceivables|accountsreceivable|매출채권)$"),
    ("INVENTORY", r"^(?:inventories|inventory|재고자산)$"),
    ("PAYABLES", r"^(?:tradeandothercurrentpayables|tradepayables|accountspayable|매입채무)$"),
    ("TOTAL_ASSETS", r"^(?:assets|totalassets|자산총계)$"),
    ("TOTAL_LIABILITIES", r"^(?:liabilities|totalliabilities|부채총계)$"),
    ("TOTAL_EQUITY", r"^(?:equity|totalequity|자본총계)$"),
    ("PPE", r"^(?:propertyplantandequipment|propertyplantandequipmentnet|유형자산)$"),
    ("DILUTED_SHARES", r"^(?:weightedaveragenumberofdilutedshares(?:outstanding)?|희석.*주식)$"),
)
#: Kinds of security by name, in order.
SECURITY_KINDS = (("SPAC", r"(?i)(스팩|기업인수목적)"), ("REIT", r"(?i)(리츠|REIT)"), ("PREFERRED", r"(?i)(우|우B|우C|[0-9]우|[0-9]우B|[0-9]우C)$"))
CURRENT_REIT = r"(?i)(리츠|REIT)(우|우B|우C|[0-9]우|[0-9]우B|[0-9]우C)?$"
#: Lines of market opinion or price.
OPINION = r"(?i)투자의견|목표주가|적정주가|현재주가|상승여력|target[ \t]*price|(^|[^A-Za-z0-9_])(buy|hold|sell|PER|PBR)([^A-Za-z0-9_]|$)|(매수|중립|매도)([ ]*\(|[ ]*$)"
#: Months and days of report codes.
REPORTS = {"11013": ("Q1", 3, 31), "11012": ("H1", 6, 30), "11014": ("Q3", 9, 30), "11011": ("FY", 12, 31)}


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None, prefix: str = "(?i)") -> Column:
    """The name of the first of ``(name, pattern)`` that is found."""
    out = F.lit(otherwise).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(prefix + pattern), F.lit(name)).otherwise(out)
    return out


def normalized(text: Column) -> Column:
    """Blanks of each line collapsed, and no two blank lines in a row or at either end."""
    lines = F.transform(F.split(F.replace(text, F.lit("\u00a0"), F.lit(" ")), "\n", -1), lambda x: F.btrim(F.regexp_replace(x, BLANKS, " ")))
    kept = let(lines, lambda all_: F.filter(all_, lambda x, i: (x != "") | ((i > 0) & (F.get(all_, i - 1) != ""))))
    return F.btrim(F.array_join(kept, "\n"), F.lit("\n "))


def number(raw: Column) -> Column:
    """The value of a printed number: thousands, brackets for a negative whole part, percent as a share; null for dashes and all else."""
    value = F.regexp_replace(raw, "[ \\t\\n\u00a0]", "")
    bracketed = F.regexp_extract(value, r"^\(([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.[0-9]+)?\)$", 1)
    plain = F.when(value.rlike(r"^[+-]?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\.[0-9]+)?%?$"), F.regexp_replace(value, "[,%]", "").cast("double"))
    percent = F.when(value.endswith("%"), plain / 100).otherwise(plain)
    return F.when(bracketed != "", -F.try_to_number(F.regexp_replace(bracketed, ",", ""), F.lit("999999999999999")).cast("double")).otherwise(percent)


def unit(raw: Column, field: str) -> Column:
    """The ``name``, ``scale`` or ``currency`` of a unit; null for an unknown one."""
    compact = F.upper(F.regexp_replace(raw, r"[ \t\n]", ""))
    at = {"name": 1, "scale": 2, "currency": 3}[field]
    out = F.lit(None).cast("double" if field == "scale" else "string")
    for rule in reversed(UNITS):
        out = F.when(compact.rlike(f"^({rule[0]})$"), F.lit(rule[at])).otherwise(out)
    return out


def marked_unit(text: Column) -> Column:
    """The last unit that the text marks as such and that is known."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(UNIT_MARK), F.lit(1)), lambda x: F.btrim(x, F.lit(" ()[]")))
    return F.try_element_at(F.filter(F.transform(marks, lambda x: unit(x, "name")), lambda x: x.isNotNull()), F.lit(-1))


def newest_period(text: Column) -> Column:
    """``struct<year, at, raw>`` of the newest year that has a mark or a period, the last of equal ones."""
    found = F.transform(F.regexp_extract_all(text, F.lit(YEAR_MARK), F.lit(0)), lambda x, i: F.struct(F.substring(x, 1, 4).cast("int").alias("year"), i.alias("at"), F.btrim(x).alias("raw")))
    return F.array_max(F.filter(found, lambda x: F.length(x["raw"]) > 4))


def shifted(day: Column, months: int) -> Column:
    """The day so many months later; the end of a month stays one."""
    later = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(later)).otherwise(later)


def estimated_tokens(text: Column) -> Column:
    """One for each sign or ideograph, a quarter of each word's letters, at least one in all."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    quarters = F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, p: acc + F.when(F.length(p) == 1, 4).otherwise(F.greatest(F.lit(4), F.length(p))))
    return F.greatest(F.lit(1).cast("long"), F.ceil(quarters / 4))


def atomic_units(text: Column, most_words: int = 180, least: int = 8) -> Column:
    """The sorted distinct sentences and table rows of a marked-up text; headings and comments are left out.

    Compatibility forms of characters are not unified: Spark has no function for that.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", "\n"), r"(?i)<br[ ]*/?>", " ")
    lines = F.transform(F.split(bare, "\n", -1), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    shaped = F.transform(lines, lambda x: F.when(x.rlike(r"^#{1,6} ") | x.rlike(r"^\|?( ?:?-{3,}:? ?\|)+$"), "").when(
        x.contains("|"), F.concat(F.lit("\n\n"), F.array_join(F.filter(F.transform(F.split(F.btrim(x, F.lit("|")), r"\|", -1), lambda c: F.btrim(c)), lambda c: c != ""), " | "), F.lit("\n\n"))
    ).otherwise(F.regexp_replace(x, r"^([-*+] |[0-9]+[.)] )", "")))
    paragraphs = F.filter(F.split(F.array_join(shaped, "\n"), r"\n\n+", -1), lambda x: F.btrim(x, F.lit(" \n")) != "")
    flat = F.transform(paragraphs, lambda x: F.btrim(F.regexp_replace(x, r"[ \n]+", " ")))
    sentences = F.flatten(F.transform(flat, lambda x: F.when(x.contains(" | "), F.array(x)).otherwise(F.split(F.regexp_replace(x, r"([.!?。！？]) ", "$1\u0001"), "\u0001", -1))))

    def bounded(x: Column) -> Column:
        windows = lambda words: F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / most_words).cast("int")), lambda k: F.array_join(F.slice(words, k * most_words + 1, most_words), " "))
        return let(F.split(x, " ", -1), windows)

    pieces = F.flatten(F.transform(F.filter(sentences, lambda x: x != ""), bounded))
    return F.array_sort(F.array_distinct(F.filter(pieces, lambda x: (F.length(x) >= least) & x.rlike(r"[\p{L}\p{N}]"))))


def slot(value: Column, fallback: str) -> Column:
    """A label in lower case, other signs than letters, digits and ``%<>=`` as single underscores."""
    return let(F.btrim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(fallback))), r"[^0-9a-z가-힣一-龥%><=]+", "_"), F.lit("_")), lambda x: F.when(x == "", fallback).otherwise(x))


def value_bucket(value: Column) -> Column:
    """Where the first number of a text lies, apart for percentages; a slot where there is none."""
    bare = F.btrim(F.replace(value, F.lit(","), F.lit("")))
    found = F.abs(F.when(bare.rlike("[0-9]"), F.regexp_extract(bare, r"[-+]?[0-9]+(\.[0-9]+)?", 0)).cast("double"))
    percent = F.when(found < 5, "pct_lt_5").when(found < 20, "pct_5_20").when(found < 50, "pct_20_50").otherwise("pct_ge_50")
    level = F.when(found < 1, "lt_1").when(found < 3, "1_3").when(found < 10, "3_10").otherwise("ge_10")
    return F.when(found.isNull(), slot(value, "unspecified")).when(value.contains("%"), percent).otherwise(level)


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def masked(text: Column, terms: Sequence[Column], patterns: Mapping[str, str]) -> Column:
    """Terms, longest first, and patterns replaced by their masks, and blanks collapsed; letters' case does not count."""
    literal = lambda x: F.concat(F.lit("(?i)"), F.regexp_replace(x, r"([\\.\[\](){}*+?^$|])", r"\\$1"))
    ordered = F.array_sort(F.filter(F.array(*terms), lambda x: x.isNotNull() & (x != "")), lambda a, b: (F.length(b) - F.length(a)).cast("int"))
    out = F.aggregate(ordered, text, lambda acc, term: F.regexp_replace(acc, literal(term), F.lit("[ENTITY]")))
    for mask, pattern in patterns.items():
        out = F.regexp_replace(out, pattern, mask)
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "))
