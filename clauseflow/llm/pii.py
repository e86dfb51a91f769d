"""Personal data by regular expressions, checksums and context, in DataFrame functions only.

Each kind proposes spans by a pattern, leftmost first and not overlapping. A check confirms a span: at most 255 in
each part of an address, Luhn for cards, a digit count for phones, mod 97 for IBANs. IBANs are proposed from every
word start with the length of their country, so that what follows or stands before one can't hide it; of those that
pass and overlap, the first stays. A span's score is its kind's own, raised by whole context words within NEAR signs
before or after it, as far as no other proposal of its kind stands between; kinds with Finder.least keep spans that
reach it, base kinds keep all that pass. Context is cut from the gaps between proposals, so the cost grows with the
text and the number of spans, not with their product.

Patterns begin only where a run of their first signs begins, or where the last match ended (\\G): every other place
inside a run would match the same way or not at all, and so a long run costs one scan. Repeats that nothing follows are
possessive, which takes the same text without the recursion of Java's backtracking groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tucked

NEAR = 40
BLOCK = 4096


def _none(_: Column) -> Column:
    return F.lit(True)


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def is_address(span: Column) -> Column:
    """Every part at most 255, whatever zeros lead it."""
    return ~F.regexp_like(span, F.lit(r"(?<![0-9])0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?![0-9])"))


def luhn(span: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(span))

    def add(total, i):
        n = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(d), F.lit(19)), F.lit(1))), F.lit(0), add)
    return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def is_phone(span: Column) -> Column:
    return F.length(digits(span)).between(9, 15)


def mod97(span: Column) -> Column:
    """ISO 13616: the first four signs moved to the end, letters as 10 to 35, leave 1 by 97."""
    plain = F.regexp_replace(span, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(rest, i):
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(moved), F.lit(34)), F.lit(1))), F.lit(0), add) == 1)


def is_ssn(span: Column) -> Column:
    return ~F.regexp_like(span, F.lit("^(?:000|666|9[0-9]{2})|-00-|-0000$"))


@dataclass(frozen=True)
class Finder:
    kind: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score, in lower case, parted by |
    least: float = 0.0  # of the score; 0 keeps all that pass the check
    ahead: bool = False  # the pattern is a lookahead whose group 1 is the span: proposals may overlap


_LOCAL = "[A-Za-z0-9._%+-]"
#: Signs of an IBAN by country: the ISO 13616 registry, and countries that use the form without an entry there.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{1,4}}){{3,8}}"
BASE = (
    Finder("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", _none, 0.9, "e-mail|email|mail|contact|correo|courriel"),
    Finder("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_address, 0.6, "ip|address|addr|host|server|login"),
    Finder("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.8, "card|visa|mastercard|credit|karte|kreditkarte|carte|tarjeta"),
    Finder("phone", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 0.7, "tel|telephone|telefon|phone|call|fax|mobile|mobil"),
)
ADDED = (
    Finder("iban", rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_KNOWN}|{_OTHER})\b))", mod97, 0.8, "iban|bank|account|konto|compte|cuenta", 0.0, True),
    Finder("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", is_ssn, 0.4, "ssn|social security|tax id", 0.7),
)
FINDERS = BASE + ADDED


def spans_of(text: Column, finder: Finder) -> Column:
    """array<struct<kind, start, end, score>> of one kind in a text; places in code points, the end exclusive."""
    return F.when(F.regexp_like(text, F.lit(finder.pattern)), _spans(text, finder)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item what combine() makes of the values of all items before it; in blocks of 64, so that no step copies
    a long array."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / 64).cast("int")), lambda b: F.slice(items, b * 64 + 1, F.lit(64)))
    nothing = F.array().cast("array<int>")

    def through(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: combine(a, value(x))))
        begins = let(whole, lambda ws: F.transform(ws, lambda _, i: F.aggregate(F.slice(ws, F.lit(1), i), zero, combine)))
        step = lambda acc, x: F.struct(combine(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.flatten(F.zip_with(blocks, begins, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])))

    return F.when(F.size(items) > 0, let(blocks, through)).otherwise(nothing)


def _spans(text: Column, finder: Finder) -> Column:
    found = F.regexp_extract_all(text, F.lit(finder.pattern), F.lit(int(finder.ahead)))
    # A lookahead takes no signs, so gaps run from proposal to proposal. One at the very start would leave no gap
    # before it; so a sign goes before the text.
    gaps = F.split(F.concat(F.lit("\n"), text), finder.pattern, -1) if finder.ahead else F.split(text, finder.pattern, -1)

    def proposal(gaps: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            before, after = F.get(gaps, i), F.get(gaps, i + 1)
            after = F.substr(after, F.length(m) + 1, F.lit(NEAR)) if finder.ahead else F.left(after, F.lit(NEAR))
            near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit("\n"), after))
            return F.struct(F.length(before).alias("gap"), m.alias("m"), near.alias("near"))

        return F.transform(found, one)

    taken = (lambda x: F.lit(0)) if finder.ahead else (lambda x: F.length(x["m"]))

    def located(pairs: Column) -> Column:
        at = running(pairs, lambda x: x["gap"] + taken(x), lambda a, b: a + b, F.lit(0))
        return F.zip_with(pairs, at, lambda x, at: F.struct((at + x["gap"] - int(finder.ahead)).alias("start"), (at + x["gap"] - int(finder.ahead) + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["near"].alias("near")))

    passed = F.filter(let(let(gaps, proposal), located), lambda x: finder.check(x["m"]))
    if finder.ahead:  # of those that overlap, the first: one that begins before the last kept one ends goes
        nothing = F.array().cast("array<struct<start:int,end:int,m:string,near:string>>")
        passed = F.aggregate(passed, nothing, lambda out, x: F.when((F.size(out) > 0) & (x["start"] < F.element_at(out, -1)["end"]), out).otherwise(F.concat(out, F.array(x))))
    words = rf"(?<![\p{{L}}\p{{N}}])(?:{finder.context})(?![\p{{L}}\p{{N}}])"

    def rated(x):
        score = F.when(F.regexp_like(x["near"], F.lit(words)), F.lit(min(1.0, finder.score + 0.3))).otherwise(finder.score)
        return F.struct(F.lit(finder.kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.cast("double").alias("score"))

    out = F.transform(passed, rated)
    return F.filter(out, lambda x: x["score"] >= finder.least) if finder.least else out


def with_spans(docs: DataFrame, finders: tuple[Finder, ...] = FINDERS, name: str = "pii") -> DataFrame:
    """docs with an array column of all spans, by kind as listed and then by start. A null text has none.

    Other columns pass through, whatever their names; a column `name` is replaced. Repeated rows each get their spans;
    ids aren't read.
    """
    rows, back = tucked(docs.drop(name), ["text"])
    rows = rows.withColumn("whole", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({f"of_{f.kind}": spans_of(F.col("whole"), f) for f in finders})
    rows = rows.withColumn("spans", F.concat(*[f"of_{f.kind}" for f in finders]))
    return back(rows, F.col("spans").alias(name))


def redacted(docs: DataFrame, finders: tuple[Finder, ...] = FINDERS) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; spans that overlap go as one, named by the first.

    Pieces between spans are cut from blocks of the text, so a text's cost grows with its length and its spans. A null
    text stays null. All other columns pass through, whatever their names.
    """
    rows, back = tucked(docs, ["text"])
    marked = with_spans(rows, finders, "_pii").withColumn("_blocks", F.when(F.size("_pii") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    marked = marked.withColumn("_pii", F.array_sort(F.transform("_pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    # A span begins a new cut if it starts at or after the furthest end so far; the cut ends at the furthest end before the next.
    marked = marked.withColumn("_ends", running(F.col("_pii"), lambda x: x["end"], lambda a, b: F.greatest(a, b), F.lit(0)))
    marked = marked.withColumn("_first", F.filter(F.transform("_pii", lambda x, i: F.when(x["start"] >= F.get("_ends", i), i)), lambda i: i.isNotNull()))
    last = F.array_max(F.transform("_pii", lambda x: x["end"]))

    def cut(i: Column, k: Column) -> Column:
        x = F.get("_pii", i)
        return F.struct(x["start"].alias("start"), F.coalesce(F.get("_ends", F.get("_first", k + 1)), last).alias("end"), x["kind"].alias("kind"))

    marked = marked.withColumn("_cuts", F.when(F.size("_pii") > 0, F.transform("_first", cut)))

    def piece(begin: Column, end: Column) -> Column:
        first = F.floor(begin / BLOCK).cast("int")
        last = F.floor(F.greatest(end - 1, begin) / BLOCK).cast("int")
        joined = F.array_join(F.slice("_blocks", first + 1, last - first + 1), "")
        return F.when(end > begin, F.substring(joined, begin - first * BLOCK + 1, end - begin)).otherwise("")

    def before(x: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.element_at("_cuts", F.greatest(i, F.lit(1)))["end"]).otherwise(0)
        return F.concat(piece(begin, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))

    rest = piece(F.element_at("_cuts", -1)["end"], F.length("text"))
    new = F.when(F.size("_pii") > 0, F.concat(F.array_join(F.transform("_cuts", before), ""), rest)).otherwise(F.col("text"))
    return back(marked.withColumn("text", new))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: counts and digest of the base kinds, all spans, and each span's score.

    A null or empty text has none. Null ids, repeated rows and an empty table are as they are in documents.
    """
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    kinds = [f.kind for f in BASE]
    base = F.filter("pii", lambda x: x["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(k) for k in kinds}
    scores = F.array_join(F.transform("pii", lambda x: F.format_string("%.2f", x["score"])), ",")
    return found.withColumns(counts | {"base_sha256": F.sha2(joined(base).cast("binary"), 256), "spans": joined(F.col("pii")), "scores": scores}).drop("pii")
