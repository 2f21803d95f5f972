"""Money regions of a row, in column expressions.

Each word gets a letter for the part it can play in an amount and each space one for its width, so that a row is a short
string in which one pattern finds the amounts. An amount is complete if nothing that might belong to it stands unread
beside it. That is decided by barriers: words or spaces that end a stretch. From an amount, and from a word that holds
unread cents, the stretch goes to the nearest barrier on either side; what lies between makes it incomplete, and a document
with any incomplete stretch is refused as a whole rather than read in part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.lexical import NUMBER, let

# Parts of an amount, and what must not stand unread beside one.
PARTS = [("p", r"\+"), ("m", "-"), ("r", r"R\$"), ("P", r"\+R\$"), ("M", r"-R\$"), ("n", NUMBER), ("N", rf"R\${NUMBER}"), ("q", rf"\+(?:R\$)?{NUMBER}"), ("k", rf"-(?:R\$)?{NUMBER}"), ("C", "C"), ("D", "D")]
REFERENCE = r"[0-9.,_'’]+|[A-Z]{2,3}"
CUE = rf"[+−-]?[0-9.,_'’]+|[A-Z]{{2,3}}|[-+−()CD]|R\$"
DETACHED = r"[-+−]|R\$"
CURRENCY_SIGN = r"\p{Sc}"
CENTS = "[0-9]+,[0-9]+"
#: Words of four letters or more: they can't be any of these.
PROSE = r"\A\p{L}{4,}\z"
#: Letters of spaces: none at all, within the gap, wider.
TOUCHING, NEAR, FAR = "0", "1", "2"

_S = f"[{TOUCHING}{NEAR}]"
_BARE = f"(?:(?:r{_S})?n|N)"
#: A sign agrees with the marker after it.
AMOUNT = f"{_BARE}(?:{_S}[CD])?|(?:p{_S}{_BARE}|P{_S}n|q)(?:{_S}C)?|(?:m{_S}{_BARE}|M{_S}n|k)(?:{_S}D)?"


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def _read(words: Column, gap: float) -> Column:
    """array(struct(part, clings, reference, detached, cents, after)) of a row's words; after is the space's letter."""

    def read(w: Column, i: Column) -> Column:
        text, space = w["text"], F.get(words, i + 1)["x0"] - w["x1"]
        part = F
        for letter, pattern in PARTS:
            part = part.when(text.rlike(_whole(pattern)), letter)
        sign = text.rlike(CURRENCY_SIGN)
        kinds = {"part": part.otherwise("x"), "clings": text.rlike(_whole(CUE)) | sign, "reference": text.rlike(_whole(REFERENCE)), "detached": text.rlike(_whole(DETACHED)) | sign, "cents": text.rlike(CENTS)}
        prose = F.struct(*[F.lit("x" if name == "part" else False).alias(name) for name in kinds])
        # Most words are prose, which one look tells.
        kind = F.when(text.rlike(PROSE), prose).otherwise(F.struct(*[c.alias(name) for name, c in kinds.items()]))
        after = F.when(space <= 0, TOUCHING).when(space <= gap, NEAR).otherwise(FAR)
        return let(kind, lambda k: F.struct(*[k[name].alias(name) for name in kinds], after.alias("after")))

    return F.transform(words, read)


def _amounts(marks: Column) -> Column:
    """array(struct(start, end)) of the amounts, from the left, each as long as it can be."""
    code = F.array_join(F.transform(marks, lambda m: F.concat(m["part"], m["after"])), "")
    pieces = F.split(F.regexp_replace(code, f"({AMOUNT})", "<$1>"), "[<>]")

    def place(pieces: Column) -> Column:
        def at(k: Column) -> Column:
            before = F.length(F.array_join(F.slice(pieces, F.lit(1), k), ""))
            return F.struct(F.floor(before / 2).cast("int").alias("start"), F.ceil((before + F.length(F.get(pieces, k))) / 2).cast("int").alias("end"))

        # Every second piece lies between the marks.
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int")), lambda k: at(2 * k + 1))

    return F.filter(let(pieces, place), lambda r: r["end"].isNotNull())


def _within(spans: Column, i: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))


def _stretches(marks: Column, found: Column) -> Column:
    """struct(regions, incomplete) as arrays of struct(start, end)."""
    n = F.size(marks)
    places = F.sequence(F.lit(0), n - 1)
    mark, space = lambda i: F.get(marks, i), lambda i: F.get(marks, i)["after"]

    def left(start: Column, passes) -> Column:
        """After the last barrier before start."""
        walls = F.filter(places, lambda i: (i < start) & (_within(found, i) | (space(i) == FAR) | ~passes(i)))
        return F.coalesce(F.array_max(walls) + 1, F.lit(0))

    def right(end: Column, passes) -> Column:
        """At the first barrier from end on."""
        walls = F.filter(places, lambda j: (j >= end) & (_within(found, j) | (space(j - 1) == FAR) | ~passes(j)))
        return F.coalesce(F.array_min(walls), n)

    def around(r: Column) -> Column:
        # A sign or symbol of its own sets an amount off from a reference before it.
        opens = mark(r["start"])["part"].isin("p", "m", "r", "P", "M", "N", "q", "k")
        start = left(r["start"], lambda i: (space(i) == TOUCHING) | mark(i)["clings"] & ~(opens & mark(i)["reference"]))
        end = right(r["end"], lambda j: (space(j - 1) == TOUCHING) | mark(j)["clings"])
        # A sign or currency just before is unread evidence at any distance.
        loose = (r["start"] > 0) & F.coalesce(mark(r["start"] - 1)["detached"], F.lit(False)) & ~_within(found, r["start"] - 1)
        return F.struct(r.alias("own"), start.alias("start"), end.alias("end"), loose.alias("loose"))

    def decide(reach: Column) -> Column:
        span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
        whole = lambda x: (x["start"] == x["own"]["start"]) & (x["end"] == x["own"]["end"])
        wide = F.transform(F.filter(reach, lambda x: ~whole(x)), lambda x: span(x["start"], x["end"]))
        loose = F.transform(F.filter(reach, lambda x: x["loose"]), lambda x: span(x["own"]["start"] - 1, x["end"]))
        unread = F.filter(places, lambda i: mark(i)["cents"] & ~_within(found, i))
        cents = F.transform(unread, lambda i: span(left(i, lambda k: mark(k)["clings"]), right(i + 1, lambda k: mark(k)["clings"])))
        regions = F.transform(F.filter(reach, whole), lambda x: x["own"])
        return F.struct(regions.alias("regions"), let(F.concat(wide, loose, cents), lambda spans: _merged(spans, n)).alias("incomplete"))

    return let(F.transform(found, around), decide)


def _merged(spans: Column, n: Column) -> Column:
    """Spans that share a word are one: a border between two words is an edge unless some span runs across it."""
    crossed = lambda i: F.exists(spans, lambda s: (s["start"] < i) & (i < s["end"]))
    edges = lambda side: F.filter(F.sequence(F.lit(0), n), lambda i: F.exists(spans, lambda s: s[side] == i) & ~crossed(i))
    return F.when(F.size(spans) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.arrays_zip(edges("start").alias("start"), edges("end").alias("end")))


def scan_money(words: Column, gap: float) -> Column:
    """struct(regions: array(struct(start, end, text, x0, x1)), incomplete: array(struct(start, end))) of a row's words;
    each region's text reads by lexical.money. A row without a comma has neither."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    scan = let(_read(words, gap), lambda marks: let(_amounts(marks), lambda found: _stretches(marks, found)))
    plain = F.struct(none.alias("regions"), none.alias("incomplete"))
    scanned = F.when(F.exists(words, lambda w: F.contains(w["text"], F.lit(","))), scan).otherwise(plain)

    def named(r: Column) -> Column:
        own = F.slice(words, r["start"] + 1, r["end"] - r["start"])
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), F.array_join(F.transform(own, lambda w: w["text"]), " ").alias("text"), F.get(own, 0)["x0"].alias("x0"), F.element_at(own, -1)["x1"].alias("x1"))

    return let(scanned, lambda s: F.struct(F.transform(s["regions"], named).alias("regions"), s["incomplete"].alias("incomplete")))
