"""Personal data in texts: high-recall span generators, boosted trees over format and context, calibrated thresholds.

Everything on the data is a Spark column expression. A span is found from the pieces between matches: their lengths add up
to its place, in code points.

Base spans (fixed formats with their checks) are always kept. Generators propose wider candidates: digits with any
separators, long numbers inside runs of digits, and addresses with a written-out at or dot. Candidates that overlap a base span of their kind
are positive examples. For the others an independent sign stands in for a label, which no tree sees: the check digit of a card
without its separators, and for the other kinds a key word of the kind on the left. A sign is not a label: of n
candidates with s signs about (s - b n) / (c - b) are real, where c is the rate of signs among real ones and b that among
others. A card's are 1 and 1/10; key words are counted beside base spans of the same kind and of other kinds. With
these estimates trees learn which shapes are real; the same estimates on the other fold, over candidates beside base spans
only, set the margin from which on candidates become further spans. Where signs tell nothing, none is added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import fold, sha256_of, stored

#: Fixed formats. Possessive and anchored forms match what the plain ones match, in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stretches in which all matches made of digits lie: none crosses their ends, and none that is shorter can pass its check.
ZONE = r"(?:\+(?=[0-9])|\((?=[0-9])|[0-9])(?:[\x20().+/-]*+[0-9])++"
ZONE_CHARS = 7
GENERATORS = {
    "email": r"(?i)(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[\p{L}0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[\p{L}0-9-]++)++",
    "number": r"(?:\+|\((?=[0-9]))?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
}
CONTEXT = 24        # characters before a candidate in which key words are looked for
PIECE = r"(?<![0-9])[0-9]{14,19}+(?![0-9])"        # a long number, also inside a run of numbers
WORDS = {"email": r"(?iU)(mail)", "ip": r"(?iU)(host|server|addr|\bip\b)", "phone": r"(?iU)(tel|phone|call|fax|mobil)"}
PRECISION = 0.9     # of the spans added, as the calibration fold estimates it
SIGNS = 5           # candidates with a sign that a threshold must rest on
FEATURES = ("kind", "digits", "separators", "plus", "bracket", "left", "right", "piece")


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, left, right>> of all matches; left and right are the characters beside them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    beside = F.zip_with(F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.coalesce(g, F.lit("")).alias("gap"))),
                        F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))),
                        lambda a, n: F.struct(a["hit"].alias("hit"), a["gap"].alias("gap"), F.substring(n, 1, 1).alias("right")))
    beside = F.filter(beside, lambda b: b["hit"].isNotNull())
    zero = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,hit:string,left:string,right:string>>))")

    def step(acc: Column, b: Column) -> Column:
        start = acc["at"] + F.length(b["gap"])
        end = start + F.length(b["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), b["hit"].alias("hit"), F.right(b["gap"], F.lit(CONTEXT)).alias("left"),
                        F.coalesce(b["right"], F.lit("")).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(beside, zero, step, lambda a: a["out"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts double."""
    turned = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(
        F.substring(turned, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(turned, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(hit))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _typed_empty() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,hit:string,left:string,right:string>>)")


def zones(text: Column) -> Column:
    """The stretches of digits and separators that are long enough to matter."""
    return F.when(text.rlike("[0-9]"), F.filter(located(text, ZONE), lambda z: F.length(z["hit"]) >= ZONE_CHARS)).otherwise(_typed_empty())


def within(zones: Column, pattern: str) -> Column:
    """Matches inside zones, with their places and surroundings in the whole text."""
    def inner(z: Column) -> Column:
        return F.transform(located(z["hit"], pattern), lambda s: F.struct(
            (s["start"] + z["start"]).alias("start"), (s["end"] + z["start"]).alias("end"), s["hit"].alias("hit"),
            F.right(F.concat(z["left"], s["left"]), F.lit(CONTEXT)).alias("left"),
            F.when(s["right"] == "", z["right"]).otherwise(s["right"]).alias("right")))

    return F.flatten(F.transform(zones, inner))


def base_spans(text: Column, zones: Column, kind: str) -> Column:
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), located(text, BASE[kind])).otherwise(_typed_empty())
    return F.filter(within(zones, BASE[kind]), lambda s: valid(kind, s["hit"]))


def _side(char: Column) -> Column:
    """0 nothing, 1 white space, 2 letter, 3 digit, 4 quote or sign of assignment, 5 other."""
    return (F.when(char == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike(r"^\p{L}"), 2).when(char.rlike("^[0-9]"), 3)
            .when(char.rlike("^[\"'=:/]"), 4).otherwise(5))


def features(c: Column) -> list[Column]:
    """The candidate's shape and surroundings as small whole numbers, so that few distinct rows exist in any corpus."""
    kind, span = c["kind"], c["span"]
    hit = span["hit"]
    n = F.length(_digits(hit))
    shape = F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 16, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7)
    gaps = F.least(F.length(F.regexp_replace(hit, "[0-9\\p{L}+]", "")), F.lit(7))
    return [kind, F.when(kind == 0, 0).otherwise(shape), gaps, hit.startswith("+").cast("int"), F.contains(hit, F.lit("(")).cast("int"),
            _side(F.right(span["left"], F.lit(1))), _side(span["right"]), c["piece"]]


#: The most distinct feature rows: the product of the features' numbers of values.
CELLS = 4 * 8 * 8 * 2 * 2 * 6 * 6 * 2


def candidates(text: Column, zones: Column) -> Column:
    """All candidates: array<struct<kind, span, piece>>, kind as a place in KINDS, piece 1 for a number inside a longer run. Their
    shape decides the kind."""
    def kind_of(hit: Column) -> Column:
        n = F.length(_digits(hit))
        return F.when(hit.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), 1).when(n > 12, F.when(hit.startswith("+"), 3).otherwise(2)).otherwise(3)

    def listed(spans: Column, kind: Callable[[Column], Column], piece: int) -> Column:
        return F.transform(spans, lambda s: F.struct(kind(s["hit"]).alias("kind"), s.alias("span"), F.lit(piece).alias("piece")))

    emails = F.when(text.rlike(r"@|[(\[](?i:at)[)\]]"), located(text, GENERATORS["email"])).otherwise(_typed_empty())
    numbers = within(zones, GENERATORS["number"])
    runs = F.filter(zones, lambda z: F.length(_digits(z["hit"])) > 19)
    pieces = F.filter(within(runs, PIECE), lambda s: F.length(_digits(s["hit"])) > 0)
    return F.concat(listed(emails, lambda _: F.lit(0), 0), listed(numbers, kind_of, 0), listed(pieces, lambda _: F.lit(2), 1))


def sign(c: Column, kind: int) -> Column:
    """Whether a candidate bears the sign of a kind."""
    if KINDS[kind] == "card":
        return valid("card", c["span"]["hit"])
    return c["span"]["left"].rlike(WORDS[KINDS[kind]])


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def propose(documents: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind as a column, and the candidates as ``c``: all that is read from the texts."""
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = text.select("doc_id", "t", zones(F.col("t")).alias("z"))
    return found.select("doc_id", *(base_spans(F.col("t"), F.col("z"), k).alias(k) for k in KINDS),
                        candidates(F.col("t"), F.col("z")).alias("c"))


@dataclass
class Model:
    """The trees and, for each kind, the least margin of a span that is added."""

    trees: boosting.Boosted
    least: dict[int, float]

    def margin(self, features: list[Column]) -> Column:
        def value(node: boosting.Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(features[node.feature] <= node.cut, value(node.low)).otherwise(value(node.high))

        return sum((value(t) for t in self.trees.trees), F.lit(self.trees.base))


def calibrate(margin: np.ndarray, real: np.ndarray, n: np.ndarray, signs: np.ndarray, precision: float) -> float:
    """The smallest margin from which on the estimated share of real ones among ``n`` is at least ``precision``, and at least SIGNS of
    them bear a sign; infinite if there is none."""
    if not len(margin):
        return float("inf")
    values, place = np.unique(margin, return_inverse=True)
    good, every, shown = (np.cumsum(np.bincount(place, x, len(values))[::-1])[::-1] for x in (real, n, signs))
    enough = np.flatnonzero((good >= precision * every) & (every > 0) & (shown >= SIGNS))
    return float(values[enough[0]]) if len(enough) else float("inf")


def train(found: DataFrame, precision: float = PRECISION) -> Model:
    """Fitted on what :func:`propose` found, in all documents.

    Spark counts candidates and signs per distinct row of features; there are at most CELLS such rows in each of two
    folds, whatever the corpus, so the driver gathers a bounded table. Trees are grown on documents with an even
    crc32(doc_id); thresholds are set on the others. Without any candidate nothing is added.
    """
    one = found.select(F.coalesce(fold("doc_id", 2), F.lit(0)).alias("fold"), *KINDS, F.explode("c").alias("c"))
    c = F.col("c")
    mine, any_base, has = F.lit(False), F.lit(False), F.lit(False)
    for i, kind in enumerate(KINDS):
        over = _overlaps(F.col(kind), c["span"])
        mine, any_base, has = mine | ((c["kind"] == i) & over), any_base | over, has | ((c["kind"] == i) & sign(c, i))
    words = [i for i, kind in enumerate(KINDS) if kind in WORDS]
    rows = one.select("fold", *(f.alias(n) for f, n in zip(features(c), FEATURES, strict=True)), mine.alias("mine"), any_base.alias("any"), has.alias("sign"),
                      *(sign(c, i).alias(f"w{i}") for i in words)).where("mine OR NOT any")
    count = lambda cond: F.count_if(F.expr(cond))        # noqa: E731
    cells = rows.groupBy("fold", *FEATURES).agg(count("mine"), count("mine AND sign"), count("NOT mine"), count("NOT mine AND sign"),
                                                *(count(f"mine AND w{i}") for i in words)).collect()
    table = np.array(sorted(tuple(r) for r in cells), float).reshape(-1, len(FEATURES) + 5 + len(words))
    x, (base, base_signs, free, signs) = table[:, 1:len(FEATURES) + 1], table[:, len(FEATURES) + 1:len(FEATURES) + 5].T
    kind, real, asked = x[:, 0], np.zeros(len(x)), free.copy()
    for k in range(len(KINDS)):
        here = kind == k
        often, seldom = 1.0, 0.1        # a card's check digit
        if k in words:
            beside = table[:, len(FEATURES) + 5 + words.index(k)]
            often = base_signs[here].sum() / max(base[here].sum(), 1)
            seldom = beside[~here].sum() / max(base[~here].sum(), 1)
        else:
            asked[here] = signs[here]       # only those with a right check digit are ever added
        if often - seldom > 0.05:
            real[here] = (signs[here] - seldom * free[here]) / (often - seldom)
    even = table[:, 0] == 0
    every = base + free
    trees = boosting.fit(x[even], (base + real)[even] / every[even], every[even], trees=16, depth=4, rate=0.4)
    margin, rest = trees.margin(x), ~even if (~even).any() else even
    return Model(trees, {k: calibrate(*(v[rest & (kind == k)] for v in (margin, real, asked, signs)), precision) for k in range(len(KINDS))})


def spans(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and spans: sorted array<struct<start, kind, end, base>> for every row.

    A candidate is added if it overlaps no base span, its margin reaches the threshold of its kind, and, for a card, its check digit is right. Null texts count as empty; repeated rows each get a row.
    """
    def listed(kind: int) -> Column:
        return F.transform(F.col(KINDS[kind]), lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(True).alias("base")))

    found = found.withColumn("base", F.array_sort(F.concat(*(listed(k) for k in range(len(KINDS))))))

    def add(c: Column) -> Column:
        bound = F.element_at(F.array(*(F.lit(model.least.get(k, float("inf"))) for k in range(len(KINDS)))), c["kind"] + 1)
        checked = (c["kind"] != KINDS.index("card")) | sign(c, KINDS.index("card"))
        return ~_overlaps(F.col("base"), c["span"]) & checked & (model.margin(features(c)) >= bound)

    more = F.transform(F.filter("c", add), lambda c: F.struct(
        c["span"]["start"].alias("start"), c["kind"].alias("kind"), c["span"]["end"].alias("end"), F.lit(False).alias("base")))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; where spans overlap, the first one rules."""
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = spans(propose(text.select(F.struct("doc_id", "text").alias("doc_id"), "text")), model)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    whole = F.col("doc_id")["text"]
    cut = F.aggregate("spans", F.expr("named_struct('at', 0, 'out', '')"), lambda acc, s: F.when(
        s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(
            acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1)).alias("out"))))
    done = keyed.select("doc_id", cut.alias("cut"))
    return done.select(F.col("doc_id")["doc_id"].alias("doc_id"), F.concat(
        F.col("cut")["out"], F.substring(whole, F.col("cut")["at"] + 1, F.length(whole))).alias("text"))


def pii(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row; other columns are ignored.

    The texts are read once: proposals are stored, then counted for training and scored. Null texts count as empty, repeated rows
    get a row each, null ids train with the even fold, an empty table gives an empty one.
    """
    proposed = stored(propose(documents), "pii")
    found = spans(proposed, train(proposed))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), sha256_of(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
