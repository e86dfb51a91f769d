"""Column builders for text: cleaning, matching with places, numbers, dates, tokens. All native expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

FULL_WIDTH = "０１２３４５６７８９"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column, extra: str = "") -> Column:
    return F.regexp_replace(text, rf"(?U)^[\s{extra}]+|[\s{extra}]+$", "")


def clean_text(text: Column) -> Column:
    """Hard and wide blanks become blanks; lines are trimmed, inner runs of blanks and tabs collapse, empty lines go."""
    lines = F.split(F.translate(text, " 　", "  "), r"\R", -1)
    tidy = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def digits(text: Column) -> Column:
    """Full-width digits as ASCII ones, which casts understand."""
    return F.translate(text, FULL_WIDTH, "0123456789")


_MARK, _PART, _NEXT = P.MARKS


def matches(text: Column, pattern: str, groups: int, needs: str | tuple[str, ...] = ()) -> Column:
    """array<struct<start, stop, g0, g1, ...>> of all matches, places in code points; groups without a part are ''.

    A match must not be empty. The text is searched once: a replacement sets matches and their groups between marks, so
    that they come apart by a plain split, and places are running sums. Texts that hold the marks themselves are searched
    by parts, where what a match captures must not depend on what stands around it. needs: literals of which every match
    has one; texts without any aren't searched.
    """
    names = [f"g{i}" for i in range(groups + 1)]
    kind = "array<struct<start:int,stop:int," + ",".join(f"{n}:string" for n in names) + ">>"
    none = F.array().cast(kind)

    def row(start: Column, g: list[Column]) -> Column:
        return F.struct(start.alias("start"), (start + F.length(g[0])).alias("stop"), *[c.alias(n) for c, n in zip(g, names, strict=True)])

    def folded(rows: Column, gap, parts) -> Column:
        def step(acc, x):
            one = let(parts(x), lambda g: row(acc["at"] + F.length(gap(x)), [g[i] for i in range(groups + 1)]))
            return let(one, lambda r: F.struct(r["stop"].alias("at"), F.concat(acc["out"], F.array(r)).alias("out")))

        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])

    marked = F.regexp_replace(text, F.lit(pattern), F.lit(_MARK + _PART.join(f"${i}" for i in range(groups + 1)) + _MARK))
    at_once = let(F.split(marked, _MARK, -1), lambda p: F.when(F.size(p) > 1, folded(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: F.get(p, i - 1), lambda i: F.split(F.get(p, i), _PART, -1))).otherwise(none))
    apart = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("g0"))
    apart = folded(F.filter(apart, lambda x: x["g0"].isNotNull()), lambda x: x["gap"], lambda x: F.array(x["g0"], *[F.regexp_extract(x["g0"], pattern, i) for i in range(1, groups + 1)]))
    found = F.when(F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_PART)), apart).otherwise(at_once)
    if isinstance(needs, str):
        needs = (needs,)
    return F.when(reduce(Column.__or__, [F.contains(text, F.lit(n)) for n in needs]) if needs else text.isNotNull(), found).otherwise(none)


def groups_of(texts: Column, pattern: str, groups: int) -> Column:
    """array<array<string>>: the groups of all matches in an array of texts without marks, whole ones first, in order.

    The texts are searched as one: the pattern must not reach past the last mark.
    """
    marked = F.regexp_replace(F.array_join(texts, _NEXT), F.lit(pattern), F.lit(_MARK + _PART.join(f"${i}" for i in range(groups + 1)) + _MARK))
    found = let(marked, lambda m: F.when(F.contains(m, F.lit(_MARK)), F.split(m, _MARK, -1)).otherwise(F.array().cast("array<string>")))
    return F.transform(F.filter(found, lambda x, i: i % 2 == 1), lambda x: F.split(x, _PART, -1))


def window_before(text: Column, start: Column, width: int) -> Column:
    begin = F.greatest(start - width, F.lit(0))
    return F.substring(text, begin + 1, start - begin)


def nearest_role(text: Column, start: Column, table: Iterable[tuple[str, str]], width: int = 24) -> Column:
    """The role whose keyword ends the search from `start` backwards first; an earlier entry wins a tie; '' without any."""
    roles = dict(table)  # the greedy .* leaves the last place where any keyword begins, and there the first of the table
    return lookup(roles, F.regexp_extract(window_before(text, start, width), f"(?s)^.*({'|'.join(roles)})", 1), F.lit(""))


def plain_number(value: Column) -> Column:
    return F.replace(digits(value), F.lit(","), F.lit(""))


def money_number(value: Column) -> Column:
    """'1,200.00' as '1200', '0.5' as '0.50'; what is no number stays."""

    def of(plain: Column) -> Column:
        return let(plain.try_cast("double"), lambda number: F.when(number.isNull(), plain).when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.2f", number)))

    return let(strip(plain_number(value)), of)


def date_key(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD without a look at the calendar."""
    y, m, d = (digits(c).try_cast("int") for c in (year, month, day))
    return F.format_string("%04d-%02d-%02d", y, m, d)


def date_key_of(text: Column) -> Column:
    """The key of a text that is one date, else null."""
    plain = strip(text)
    whole = f"{P.DATE}$".replace("(?U)", "(?U)^")
    return F.when(F.regexp_like(plain, F.lit(whole)), date_key(*[F.regexp_extract(plain, whole, i) for i in (1, 2, 3)]))


def chinese_number(text: Column) -> Column:
    """Digits, one Chinese digit, or x十y; 百 and more give null."""
    table = constant_map(P.CHINESE_DIGITS)

    def tens_and_ones(plain: Column) -> Column:
        left, right = F.split_part(plain, F.lit("十"), F.lit(1)), F.regexp_replace(plain, "^[^十]*十", "")
        tens = F.when(left == "", 1).otherwise(F.coalesce(F.try_element_at(table, left), F.lit(1)))
        ones = F.when(right == "", 0).otherwise(F.coalesce(F.try_element_at(table, right), F.lit(0)))
        return tens * 10 + ones

    def of(plain: Column) -> Column:
        return F.when(F.regexp_like(plain, F.lit(r"(?U)^\d+$")), digits(plain).try_cast("int")).when(plain.contains("十"), tens_and_ones(plain)).otherwise(F.try_element_at(table, plain)).cast("int")

    return let(strip(text), of)


def constant_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: Mapping, key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(constant_map(values), key)
    return found if default is None else F.coalesce(found, default)


def party_name(raw: Column) -> Column:
    """A party's name cut at the first of the cut words that doesn't begin it, 30 signs at most, without verbs at its end."""
    name = strip(raw, ":：")

    def cut(n: Column) -> Column:
        places = F.filter(F.array(*[F.locate(w, n) - 1 for w in P.PARTY_CUTS]), lambda i: i > 0)
        at = F.coalesce(F.array_min(places), F.length(n))
        return F.substring(strip(F.substring(n, F.lit(1), at), ":：、"), 1, 30)

    verbs = "|".join(P.PARTY_VERBS)
    whole = lambda n: F.regexp_replace(let(n, cut), f"(?<=.{{2}})(?:{verbs})+$", "")
    plain = lambda n: F.substring(strip(n, ":：、"), 1, 30)  # noqa: E731  without any of the words
    return strip(let(name, lambda n: F.when(F.regexp_like(n, F.lit("|".join((*P.PARTY_CUTS, *P.PARTY_VERBS)))), whole(n)).otherwise(plain(n))), ":：、")


def party_side(role: Column) -> Column:
    """The side of a role: a known role in brackets counts, else what stands before them; null for other roles."""
    outer = strip(F.regexp_extract(role, "^([^（(]*)", 1))
    return let(F.regexp_extract(role, "[（(]([^）)]+)[）)]", 1), lambda inner: lookup(P.PARTY_SIDES, F.when(inner.isin(*P.PARTY_PRIMARY), inner).otherwise(outer)))


def tokens(text: Column) -> Column:
    """Lower-case units (a Han sign, or a run of ASCII letters and digits), then the pairs of neighbours of one sign each."""

    def of(u: Column) -> Column:
        pairs = F.transform(F.slice(u, F.lit(1), F.greatest(F.size(u) - 1, F.lit(0))), lambda x, i: F.when((F.length(x) == 1) & (F.length(F.get(u, i + 1)) == 1), F.concat(x, F.get(u, i + 1))))
        return F.concat(u, F.filter(pairs, lambda x: x.isNotNull()))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"[\x{4e00}-\x{9fff}]|[0-9a-z]+"), F.lit(0)), of)


def contained(a: Column, b: Column) -> Column:
    """Whether the shorter text lies in the longer and has at least half its length."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) > 0) & (F.length(short) >= F.length(long) * 0.5) & long.contains(short)


def citation(law: Column, article: Column) -> Column:
    return F.concat(F.lit("《"), law, F.lit("》"), article)


def contract_id(filename: Column, full_text: Column, override: Column | None = None) -> Column:
    made = F.concat(F.lit("c-"), F.substring(F.sha2(F.concat(filename, F.lit("\0"), full_text).cast("binary"), 256), 1, 12))
    return made if override is None else F.coalesce(F.nullif(override, F.lit("")), made)
