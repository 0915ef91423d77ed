r"""Operator 3: personal data by regular expressions, checksums and context. DataFrame functions only.

Expressions propose spans, leftmost and non-overlapping for each kind; checks confirm them: parts of an ip at most
255, Luhn for cards, mod-97 for ibans, digit counts for phones. Every confirmed span starts from its kind's score;
context words within ``NEAR`` code points on either side raise it, words that speak of something else lower it. Base
kinds (email, ip, card, phone) are reported whatever their score, as their contract says; kinds that the method adds
(iban, ssn) are reported at ``THRESHOLD`` or more, so a bare ddd-dd-dddd counts only where the context supports it.

Places come from the text between matches: a text split at the matches has one part more than there are matches, and
running sums of both give starts and ends, in code points. The sums run inside stretches of ``STRETCH`` matches, each starting where the
stretch before ends, and only confirmed matches are gathered, so the cost is linear in the matches (but for one number a stretch). Context stops at the
neighbouring match of the kind, so it needs no search in the text either. Possessive quantifiers and the ``\G`` alternative keep the search
linear on endless runs of digits or letters, with the same matches.

Scale: one pass and no shuffle; a text without a kind's telltale character is never searched for that kind.

Defined cases: null texts are empty; repeated rows are searched each; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import documents, text_rows

NEAR, THRESHOLD = 40, 0.5
STRETCH = 256
#: Proposals. A match that may not start inside a run starts at the run's beginning or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Texts that don't match can't hold the kind; these are cheap substring or class searches.
TELLTALE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
RAISING = {
    "email": "mail|contact|e-mail", "ip": "ip|address|host|server", "card": "card|visa|credit|payment|tarjeta|carte|karte",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social security|taxpayer",
}
LOWERING = {"email": "noreply|example\\.org", "ip": "version|release", "card": "order no|tracking|isbn", "phone": "isbn|part no", "iban": "serial|part no", "ssn": "part no|model|invoice"}


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def luhn(s: Column) -> Column:
    """Luhn's sum over the digits from the right; s holds digits only."""
    d = F.transform(F.reverse(chars(s)), lambda x: x.cast("int"))
    double = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, double(x)).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(s: Column) -> Column:
    """ISO 7064 mod 97-10 on an iban without spaces: the first four characters last, letters as 10 to 35."""
    turned = chars(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)))
    step = lambda a, c: F.when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def without_words(s: Column) -> Column:
    """An iban without the capital words that may follow it: the longest run of the match's first groups that passes, or the match."""
    groups = F.split(s, " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    return F.coalesce(F.get(F.filter(runs, lambda x: (F.length(x) >= 15) & mod_97(F.replace(x, F.lit(" "), F.lit("")))), F.lit(0)), s)


def confirmed(kind: str, s: Column) -> Column:
    n = F.length(digits_of(s))
    if kind == "ip":
        bare = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(s, "\\."), lambda x: (F.length(bare(x)) < 3) | ((F.length(bare(x)) == 3) & (bare(x) <= "255")))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod_97(F.replace(s, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a plain expression inside a lambda function would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def proposals(kind: str, text: Column) -> Column:
    """Array of (start, match, before, after) for each confirmed match of the kind's expression, in order; before and after are the text up to the next matches."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    sides = lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(g) - 1), F.slice(g, F.lit(2), F.size(g) - 1), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    around = let(F.split(text, PATTERNS[kind], -1), sides)
    both = F.zip_with(found, around, lambda m, x: F.struct(m.alias("match"), x["before"].alias("before"), x["after"].alias("after")))
    kept = lambda x: confirmed(kind, without_words(x["match"]) if kind == "iban" else x["match"])
    length = lambda x: F.length(x["before"]) + F.length(x["match"])
    placed = lambda at, x: F.array(F.struct((at + F.length(x["before"])).alias("start"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after")))
    step = lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.when(kept(x), F.concat(acc["out"], placed(acc["at"], x))).otherwise(acc["out"]).alias("out"))
    empty = F.array().cast("array<struct<start:int,match:string,before:string,after:string>>")
    inside = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def by_stretches(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STRETCH).cast("int")), lambda k: F.slice(x, k * STRETCH + 1, STRETCH))
        sums = lambda ps: F.transform(ps, lambda part: F.aggregate(part, F.lit(0), lambda a, y: a + length(y)))
        starts = lambda ps: F.aggregate(sums(ps), F.array(F.lit(0)), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, F.slice(starts(ps), F.lit(1), F.size(ps)), inside)))

    return let(both, lambda x: F.when(F.size(x) <= STRETCH, inside(x, F.lit(0))).otherwise(by_stretches(x)))


def spans(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, score) of the confirmed spans that are reported."""

    def scored(x: Column) -> Column:
        after = F.substring(x["after"], 1, NEAR)
        around = F.lower(F.concat(F.substring(x["before"], -NEAR, NEAR), x["match"], after))
        match = without_words(x["match"]) if kind == "iban" else x["match"]
        raised = F.when(around.rlike(rf"(?<![a-z])(?:{RAISING[kind]})"), 0.3).otherwise(0.0)
        lowered = F.when(around.rlike(rf"(?<![a-z])(?:{LOWERING[kind]})"), 0.3).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + raised - lowered)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(match)).alias("end"), score.alias("score"))

    held = F.transform(proposals(kind, text), scored)
    held = held if kind in BASE else F.filter(held, lambda x: x["score"] >= THRESHOLD)
    return F.when(text.rlike(TELLTALE[kind]), held).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, and for each kind an array of spans (kind, start, end, score))."""
    rows = text_rows(docs)
    return rows.select("doc_id", *(spans(kind, F.col("text")).alias(kind) for kind in PATTERNS))


def joined(*kinds: str) -> Column:
    texts = (F.transform(F.col(k), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))) for k in kinds)
    return F.array_join(F.concat(*texts), ",")


def op3_columns(found: DataFrame) -> DataFrame:
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in BASE)
    return found.select("doc_id", *counts, F.sha2(joined(*BASE).cast("binary"), 256).alias("base_sha256"), joined(*PATTERNS).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_columns(find(documents(spark, sf_dir)))
