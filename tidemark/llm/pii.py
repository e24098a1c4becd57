"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression: one row in, one row out, no shuffle. Each
pattern is written with possessive quantifiers and anchored to the start of a
run, so that a text of any length is scanned once and without recursion.

Defined results: a null text is an empty one; a text without data gives zero
counts and empty strings; repeated rows give repeated results; an empty table
gives an empty result; a column ``pii`` of the input is replaced, and all others
stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let, running_sum
from tidemark.functions.names import unused

#: Kinds whose spans are fixed by contract, in order, and those the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "short_card")

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without a match of this has none of the pattern.
GATES = {"email": "@", "ip": ".", "card": r"[0-9][\x20-]?[0-9]", "phone": "+", "iban": "[0-9]{2}", "ssn": "-"}

CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|mailto",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|debit|payment",
    "phone": r"(?i)phone|\btel\b|call|mobile|fax",
    "iban": r"(?i)iban|bank|account",
    "ssn": r"(?i)\bssn\b|social security",
    "short_card": r"(?i)card|amex|diners|credit|payment",
}
CONTEXT_CHARS = 40
#: Score of a pattern alone, and what a checksum and a context word add.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "short_card": 0.1}
CHECKSUM_GAIN, CONTEXT_GAIN = 0.4, 0.2
#: Added kinds need this score.
MIN_SCORE = 0.5


def luhn_valid(digits: Column) -> Column:
    """Luhn's check over a string of digits."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("sum")),
        lambda acc, d: F.struct(
            (1 - acc["at"]).alias("at"),
            (acc["sum"] + let(d.cast("int") * (acc["at"] + 1), lambda x: F.when(x > 9, x - 9).otherwise(x))).alias("sum"),
        ),
    )
    return total["sum"] % 10 == 0


def mod97_valid(iban: Column) -> Column:
    """ISO 13616: the country and check digits go last, letters count from 10, the remainder is 1."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def _found(text: Column, kind: str) -> Column:
    """``array<struct<start, end, match, near>>`` of the leftmost non-overlapping matches, in code points."""
    pattern = PATTERNS[kind]
    none = F.from_json(F.lit("[]"), "array<struct<start:long,end:long,match:string,near:string>>")

    def located(pieces: Column, hits: Column) -> Column:
        widths = F.transform(hits, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))
        return let(
            running_sum(widths),
            lambda ends: F.transform(
                hits,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("match"),
                    F.concat(F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_CHARS))).alias("near"),
                ),
            ),
        )

    def search() -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda p: located(p, h))))

    gate = text.rlike(GATES[kind]) if "[" in GATES[kind] else text.contains(GATES[kind])
    return F.when(gate, search()).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    """What a match must pass: a checksum, or bounds on its numbers."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        return let(_digits(match), lambda d: F.length(d).between(low, high) & luhn_valid(d))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return let(F.replace(match, F.lit(" "), F.lit("")), lambda m: F.length(m).between(15, 34) & mod97_valid(m))
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(found: Column, kind: str) -> Column:
    checked = CHECKSUM_GAIN if kind in ("card", "short_card", "iban") else 0.0
    spans = F.transform(
        F.filter(found, lambda m: _valid(kind, m["match"])),
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["match"].alias("match"),
            F.round(F.lit(PRIOR[kind] + checked) + F.when(m["near"].rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0), 2).alias("score"),
        ),
    )
    return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: ``array<struct<kind, start, end, match, score>>``, by kind, then start.

    Starts and ends count code points; ends are exclusive.
    """
    kept = docs.drop("pii")
    named = dict(zip(PATTERNS, unused(kept, *(f"_{k}" for k in PATTERNS)), strict=True))
    body = F.coalesce(F.col(text), F.lit(""))
    out = kept.withColumns({named[k]: _found(body, k) for k in PATTERNS})
    spans = F.concat(*(_spans(F.col(named["card" if k == "short_card" else k]), k) for k in BASE_KINDS + ADDED_KINDS))
    return out.select(*kept.columns, spans.alias("pii"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``, then ``n_added`` and ``max_score``."""
    from tidemark.sources.tables import table

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_text(base), 256).alias("base_sha256"),
        _text(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size(base)).cast("long").alias("n_added"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("max_score"),
    )
