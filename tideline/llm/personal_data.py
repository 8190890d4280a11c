"""Personal data: proposed by patterns, confirmed by checksums, weighed by the words around (operator 11). DataFrame functions only.

Each kind has a pattern. Its matches and the gaps between them are two arrays of one row, so positions are running sums of lengths and the words around a
match are the ends of its gaps; nothing is exploded or shuffled. A validator (address ranges, digit counts, Luhn, mod-97) confirms a match, and a score
in per cent starts from the kind, rises with helpful words before or behind it and falls with words of other numbers. Kinds of the base stay whatever
their score; the others need ``ACCEPT``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The score in per cent from which a match of a kind outside the base is personal data.
ACCEPT = 50
#: Code points before and behind a match that are searched for context words, at most up to the next match of the kind.
BEFORE, BEHIND = 40, 20
HELP, HARM = 30, 25
#: Array elements that running sums take at once.
BLOCK = 128
#: Lengths of account numbers by country, of the public registry.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0."""
    return let(digits(hit), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def octets(hit: Column) -> Column:
    """Four numbers of at most 255, leading zeros allowed."""
    return hit.rlike("^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.|$)){4}$")


def mod97(account: Column) -> Column:
    """The account number's first four signs moved to its end, letters counted from 10: the rest by 97 is 1."""
    moved = F.split(F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4)), "")
    rest = lambda acc, c: F.when(
        F.instr(F.lit(LETTERS), c) > 0, (acc * 100 + F.instr(F.lit(LETTERS), c) + 9) % 97
    ).when(c != "", (acc * 10 + F.instr(F.lit(DIGITS), c) - 1) % 97).otherwise(acc)
    return F.aggregate(moved, F.lit(0), rest) == 1


def account_end(hit: Column) -> Column:
    """``hit`` cut to the country's length, blanks not counted; null where the country is unknown, the match too short or the checksum wrong."""
    known = F.call_function("regexp_extract", F.lit(IBAN_LENGTHS), F.concat(F.substring(hit, 1, 2), F.lit("([0-9]{2})")), F.lit(1))
    cut = let(known, lambda n: F.when(n != "", F.call_function("regexp_extract", hit, F.concat(F.lit("^(?:[A-Z0-9] ?){"), (n.cast("int") - 1).cast("string"), F.lit("}[A-Z0-9]")), F.lit(0))))
    return let(cut, lambda x: F.when((x != "") & mod97(F.regexp_replace(x, " ", "")), x))


@dataclass(frozen=True)
class Kind:
    """``needs`` is a sign without which no match exists; ``valid`` gives the confirmed part of a match (its beginning) or null.

    The signs next to a match, where they are not part of the match before or behind it, must not be of ``left`` and ``right``.
    """

    name: str
    pattern: str
    start: int
    valid: Callable[[Column], Column]
    helps: str
    harms: str
    needs: str | None = None
    base: bool = True
    left: str | None = None
    right: str | None = None


def _if(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda hit: F.when(test(hit), hit)


_CALLS = "tel|phone|call|fax|mobile|cell|telefon|ruf|llam|appel|sms"
_LOCAL = "A-Za-z0-9._%+-"
#: Kinds in the order of the output. Patterns take what the plain ones of the contract take: no quantifier gives back what the next
#: element could use, and a start inside a run can only match where the last match ended, so long runs cost no second look.
KINDS: tuple[Kind, ...] = (
    Kind("email", f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", 60, lambda h: h, "mail|contact|write|kontakt|correo|courriel", "example|beispiel|ejemplo|exemple", "@"),
    Kind("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", 60, _if(octets), "(^|[^a-z])ip([^a-z]|$)|address|host|server|adresse|client", "version|section|chapter|release", "."),
    Kind("card", "[0-9](?:[ -]?[0-9])++", 70, _if(luhn), "card|visa|master|credit|karte|tarjeta|carte", "order|isbn|serial|tracking|parcel"),
    Kind("phone", "\\+[0-9][ ().0-9-]+[0-9]", 60, _if(lambda h: F.length(digits(h)).between(9, 15)), _CALLS, "order|isbn|serial|score", "+"),
    Kind("iban", "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", 75, account_end, "iban|account|bank|konto|cuenta|compte", "example|serial", base=False, left="[A-Za-z0-9]"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 30, _if(lambda h: ~h.rlike("^(000|666|9)|-00-|-0000$")), "ssn|social|security|tax", "order|part|serial", "-", base=False, left="[0-9-]", right="[0-9-]"),
    Kind("tel", "\\(?0[1-9][0-9]{1,3}\\)?[ /.-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", 30, _if(lambda h: F.length(digits(h)).between(9, 12)), _CALLS, "order|isbn|serial|article", "0", base=False, left="[0-9+().-]", right="[0-9]"),
)


def running_sum(values: Column) -> Column:
    """Sums up to and with each element, block by block: a row of n matches takes n * BLOCK steps, not n * n."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def within(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda b: F.slice(vs, b * BLOCK + 1, F.lit(BLOCK)))

        def offset(bs: Column) -> Column:
            heads = let(F.transform(bs, total), lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i))))
            return F.flatten(F.zip_with(bs, heads, lambda xs, head: F.transform(xs, lambda _, j: head + total(F.slice(xs, F.lit(1), j + 1)))))

        return let(blocks, offset)

    return let(F.transform(values, lambda x: x.cast("bigint")), within)


def starts(hits: Column, gaps: Column) -> Column:
    """Where each match starts, in code points; ``gaps`` are the texts before, between and behind the matches."""
    sizes = F.concat(F.array(F.lit(0)), F.transform(hits, lambda h: F.length(h)))
    return running_sum(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.slice(sizes, F.lit(1), F.size(hits)), lambda g, s: F.length(g) + s))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:int,base:boolean>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """The kind's accepted spans of a text that is not null, by start."""
    none = F.array().cast(_SPAN)

    def placed(hits: Column, gaps: Column) -> Column:
        behind = F.slice(gaps, F.lit(2), F.size(hits))
        rows = F.arrays_zip(hits.alias("hit"), gaps.alias("before"), behind.alias("behind"), starts(hits, gaps).alias("start"))

        def judged(r: Column) -> Column:
            near = F.concat(F.substring(r["before"], -BEFORE, BEFORE), F.lit(" "), F.substring(r["behind"], 1, BEHIND))
            weigh = lambda w: F.when(w.rlike(kind.helps), HELP).otherwise(0) - F.when(w.rlike(kind.harms), HARM).otherwise(0)
            sure = kind.valid(r["hit"])
            for side, sign, gap in ((kind.left, "{}\\z", "before"), (kind.right, "^{}", "behind")):
                if side:
                    sure = F.when(~r[gap].rlike(sign.format(side)), sure)
            score = let(F.lower(near), lambda w: F.least(F.lit(100), F.lit(kind.start) + weigh(w)))
            return let(sure, lambda s: F.struct(F.lit(kind.name).alias("kind"), r["start"].alias("start"), (r["start"] + F.length(s)).alias("end"), F.when(s.isNotNull(), score).alias("score"), F.lit(kind.base).alias("base")))

        found = F.transform(F.filter(rows, lambda r: r["hit"].isNotNull()), judged)
        return F.filter(found, lambda s: s["end"].isNotNull() & (s["base"] | (s["score"] >= ACCEPT)))

    # split and the matches see the same matches, so there is one gap more
    some = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, kind.pattern, -1), lambda gaps: placed(hits, gaps))).otherwise(none))
    return some if kind.needs is None else F.when(text.contains(kind.needs), some).otherwise(none)


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``: an array of (kind, start, end, score, base) by kind as listed in ``KINDS``, then start. Positions are code points, the end exclusive.

    Matches of one kind do not overlap; those of different kinds may. Null texts have no spans, like empty ones. Rows are judged one by one, so repeated rows, null
    ids and further columns pass as they are; a column named like ``out`` is replaced. An empty table stays empty. Long texts are searched whole, in time
    in proportion to their length.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumn(out, F.concat(*(spans_of(t, k) for k in KINDS)))


def covered(text: Column, kind: Kind) -> Column:
    """A text with the kind's accepted spans replaced by its name in brackets."""
    def cover(hits: Column, gaps: Column, found: Column) -> Column:
        ends = F.map_from_arrays(F.transform(found, lambda s: s["start"]), F.transform(found, lambda s: s["end"]))
        label = F.lit(f"[{kind.name.upper()}]")
        new = lambda m: F.zip_with(hits, starts(hits, gaps), lambda h, at: F.when(m[at].isNull(), h).otherwise(F.concat(label, F.substr(h, (m[at] - at + 1).cast("int")))))
        return F.array_join(F.zip_with(gaps, F.concat(let(ends, new), F.array(F.lit(""))), lambda g, x: F.concat(g, x)), "")

    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    shown = lambda found: let(hits, lambda hs: let(F.split(text, kind.pattern, -1), lambda gaps: cover(hs, gaps, found)))
    return let(spans_of(F.coalesce(text, F.lit("")), kind), lambda found: F.when(F.size(found) > 0, shown(found)).otherwise(text))


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every accepted span of ``text`` replaced by its kind in brackets, kind by kind; null texts stay null, other columns as they are."""
    for kind in KINDS:
        df = df.withColumn(text, covered(F.col(text).cast("string"), kind))
    return df


def digest(df: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans, one row per input row."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    xs = F.col(spans)
    of = lambda name: F.size(F.filter(xs, lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    counts = [of(k.name) for k in KINDS]
    order = [c for k, c in zip(KINDS, counts) if k.base]
    more = [c for k, c in zip(KINDS, counts) if not k.base]
    scores = F.array_join(F.transform(xs, lambda s: s["score"].cast("string")), ",")
    return df.select(F.col(id_col), *order, F.sha2(listed(F.filter(xs, lambda s: s["base"])), 256).alias("base_sha256"), listed(xs).alias("spans"), *more, scores.alias("scores"))
