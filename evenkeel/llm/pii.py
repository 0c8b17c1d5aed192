"""Personal data by weak supervision. DataFrame operations only.

Candidates are the base kinds (email, ip, card, phone) and looser forms: written-
out addresses, phone numbers without a country code, national ids and names that
begin with a given name of the gazetteer. On each candidate three labelers vote
for (1), against (-1) or not at all (0): the strict format of its kind, a
gazetteer (which never votes against), and the BEFORE characters before it. One
pass over the texts finds all candidates and their votes and writes them beside
the rows; nothing reads the texts for them again. Spark counts each combination
of kind, votes and length over all documents; there are at most PATTERNS of them,
however many documents. From these counts expectation-maximisation estimates each
labeler's reliability and each combination's probability, and a logistic
classifier is fitted to the probabilities. The classifier alone decides on the
looser candidates; base spans always stay.

Defined results: null text is empty, without spans. Every row is judged by
itself, so null or repeated doc_ids do no harm. Texts of any length are searched
whole, and redacted in time linear in the text and its spans. Overlapping spans
are all listed; redaction replaces a run of them by the kind of the first (of
equal starts, the kind listed first). Other columns are ignored (and kept by
`redact`). An empty table gives no rows and leaves the classifier without
evidence, which adds no span.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, store

BASE = ("email", "ip", "card", "phone")
LOOSE = ("written_email", "local_phone", "national_id", "person")
LENGTHS = 4
PATTERNS = (len(BASE) + len(LOOSE)) * 3**3 * LENGTHS
ACCEPT = 0.5

#: The base patterns (with Java's atomic forms of the same languages, so that long runs stay linear).
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9]|[\x20-](?=[0-9]))++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Names and endings of the gazetteer that is used where none is given.
GIVEN = """
    Adam Alexander Alice Ana Andrea Andrew Angela Anna Anne Antonio Barbara Benjamin Brian Carlos Carmen Caroline Catherine Charles
    Charlotte Christian Christine Christopher Claire Daniel David Diego Elena Elizabeth Emily Emma Eric Erika Fernando Florian
    Francisco Frank Franz George Hans Heinrich Helen Henry Isabel Jack James Jane Javier Jean Jennifer Jessica Johannes John Jorge
    Jose Joseph Juan Julia Julie Julien Karin Karl Katharina Kevin Laura Linda Lucas Luis Manuel Marc Maria Marie Mark Martin Mary
    Matthew Michael Miguel Monika Nancy Nicolas Olivier Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Robert Rosa Ruth
    Samuel Sandra Sarah Sofia Sophie Stefan Stephen Susan Teresa Thomas Ursula Victor Walter William Wolfgang
""".split()
FAMILY = """
    Adams Allen Anderson Bailey Baker Bauer Becker Bennett Bernard Brown Campbell Carter Clark Collins Cook Cooper Cruz David Davis
    Diaz Dubois Durand Edwards Evans Fernandez Fischer Fournier Garcia Girard Gomez Gonzalez Green Hall Harris Hernandez Hill
    Hoffmann Jackson Johnson Jones Kelly King Klein Koch Lambert Laurent Lee Lefebvre Leroy Lewis Lopez Martin Martinez Meyer Miller
    Mitchell Moore Moreau Moreno Morgan Morris Muller Murphy Nelson Parker Perez Peterson Petit Phillips Ramirez Reed Richter Rivera
    Roberts Robinson Rodriguez Rogers Romero Roux Ruiz Sanchez Schmidt Schneider Schulz Scott Simon Smith Stewart Suarez Taylor
    Thomas Thompson Torres Turner Vincent Wagner Walker Ward Watson Weber White Williams Wilson Wolf Wood Wright Young
""".split()
DOMAINS = "com de es fr net org edu gov info io uk".split()
#: Cue words.
CUES = "call|contact|correo|courriel|cell|e-?mail|fax|kontakt|mobile|nombre|name|phone|reach|signed|social security|ssn|tel|telefon|telefono|dear|mr|mrs|ms"
COUNTER = "chapter|figure|invoice|isbn|item|model|order|page|part|product|section|serial|version"

WRITTEN = r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]*+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: The places of two capitalised words; cheap to test, and what a name begins with.
CAPITALS = r"\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}"
MOST_NAMES = 2_000


@dataclass(frozen=True)
class Gazetteer:
    """Given names, family names and ends of domains; at most MOST_NAMES of each, for they become part of expressions."""

    given: tuple[str, ...] = tuple(GIVEN)
    family: tuple[str, ...] = tuple(FAMILY)
    domains: tuple[str, ...] = tuple(DOMAINS)

    def __post_init__(self):
        for values in (self.given, self.family, self.domains):
            if len(values) > MOST_NAMES:
                raise ValueError(f"a gazetteer holds at most {MOST_NAMES} values of a kind")

    @property
    def person(self) -> str:
        names = "|".join(re.escape(n) for n in sorted(self.given, key=lambda n: (-len(n), n))) or "(?!)"
        return rf"(?={CAPITALS})(?<![\p{{L}}\p{{N}}])(?:{names})\x20\p{{Lu}}\p{{Ll}}++(?!\p{{L}})"

    @property
    def domain(self) -> str:
        return rf"(?i)(?:\.|dot[\])])\x20?(?:{'|'.join(map(re.escape, self.domains)) or '(?!)'})$"


def gazetteer_of(table: DataFrame) -> Gazetteer:
    """A gazetteer from a table (kind: given, family or domain; value)."""
    rows = table.select("kind", "value").dropna().distinct().limit(3 * MOST_NAMES + 1).collect()
    of = lambda kind: tuple(sorted(r["value"] for r in rows if r["kind"] == kind))
    return Gazetteer(of("given"), of("family"), of("domain"))


def _luhn(what: Column) -> Column:
    """Whether the digits of `what` are 12 to 19 and pass the checksum."""
    digits = F.regexp_replace(what, "[^0-9]", "")

    def value(d: Column, i: Column) -> Column:
        back = F.length(d) - i - 1
        n = F.substring(d, i + 1, F.lit(1)).cast("int")
        return F.when(back % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    total = lambda d: F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + value(d, i))
    return spans.bound(digits, lambda d: F.when(F.length(d).between(12, 19), total(d) % 10 == 0).otherwise(F.lit(False)))


def _valid(kind: str, what: Column) -> Column:
    if kind == "ip":
        return what.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return _luhn(what)
    if kind == "phone":
        return F.length(F.regexp_replace(what, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


PATTERN = dict(zip(BASE + LOOSE[:-1], (EMAIL, IP, CARD, PHONE, WRITTEN, LOCAL_PHONE, NATIONAL)))
#: What every match of a numeric kind begins with or has inside: seven characters of numbers, of which the first is a digit.
NUMBERS = r"[0-9][0-9().\x20-]{6}"


def _needs(text: Column, numbers: Column) -> dict[str, Column]:
    """Cheap conditions without which a text has no match of a kind; `numbers` says whether it has NUMBERS."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": numbers & text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": numbers & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": numbers & F.contains(text, F.lit("+")),
        "written_email": F.contains(text, F.lit("[at]")) | F.contains(text, F.lit("(at)")),
        "local_phone": numbers & text.rlike(r"[0-9][.-][0-9]{4}"),
        "national_id": numbers & text.rlike(r"-[0-9]{2}-[0-9]{4}"),
        "person": text.rlike(CAPITALS),
    }


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def candidates(text: Column, numbers: Column | None = None, gazetteer: Gazetteer = Gazetteer()) -> Column:
    """array<struct<start, end, kind, format, gazetteer, context, length>>: every candidate with its votes.

    Each kind is searched in a pass of its own, so that none hides another; only texts that have what the kind needs are searched.
    """
    needs = _needs(text, text.rlike(NUMBERS) if numbers is None else numbers)

    def strict(kind: str, what: Column) -> Column:
        if kind == "written_email":
            return what.rlike(gazetteer.domain)
        if kind == "local_phone":
            return what.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]")
        if kind == "national_id":
            return ~what.rlike(r"^(?:000|666|9)|-00-|0000$")
        return _valid(kind, what)

    def judged(kind: str, x: Column) -> Column:
        what, before = x["what"], F.lower(x["before"])
        form = strict(kind, what)
        named = what.rlike(gazetteer.domain) if kind in ("email", "written_email") else F.element_at(F.split(what, " "), -1).isin(list(gazetteer.family)) if kind == "person" else F.lit(False)
        context = _vote(before.rlike(rf"\b(?:{CUES})\b[^a-z]*(?:[a-z]+[^a-z]+){{0,2}}$"), before.rlike(rf"\b(?:{COUNTER})\b[^a-z]*$"))
        length = F.least(F.floor(F.char_length(what) / 8).cast("int"), F.lit(LENGTHS - 1))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), _vote(form, ~form).alias("format"), F.when(named, 1).otherwise(0).alias("gazetteer"), context.alias("context"), length.alias("length"))

    def found(kind: str) -> Column:
        return F.transform(spans.matches(text, gazetteer.person if kind == "person" else PATTERN[kind], needs[kind]), lambda x: judged(kind, x))

    return F.concat(*map(found, (*BASE, *LOOSE)))


def _is_base(c: Column) -> Column:
    return c["kind"].isin(*BASE) & (c["format"] == 1)


def outside(found: Column) -> Column:
    """The candidates but those of looser kinds that lie in a base span, in order of their starts."""
    placed = lambda c: F.struct(c["start"].alias("start"), c["kind"].isin(*LOOSE).alias("loose"), c["end"].alias("end"), c.alias("c"))
    reach = lambda xs: spans.running(xs, F.lit(0), lambda at, x: F.when(_is_base(x["c"]), F.greatest(at, x["end"])).otherwise(at), "int", lambda at, x: at)
    both = lambda xs: F.zip_with(xs, reach(xs), lambda x, r: F.struct(x.alias("x"), r.alias("reach")))
    kept = lambda xs: F.filter(both(xs), lambda p: ~p["x"]["loose"] | (p["x"]["end"] > p["reach"]))
    cleared = spans.bound(F.array_sort(F.transform(found, placed)), lambda xs: F.transform(kept(xs), lambda p: p["x"]["c"]))
    return F.when(F.exists(found, lambda c: c["kind"].isin(*LOOSE)), cleared).otherwise(found)


def searched(docs: DataFrame, gazetteer: Gazetteer = Gazetteer(), carry: bool = False) -> DataFrame:
    """row_doc and `found` (the candidates) of each row as a written table, with `carry` the row itself as one column."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("row_doc"), text.alias("text"), text.rlike(NUMBERS).alias("numbers"), *kept)
    found = rows.select("row_doc", candidates(F.col("text"), F.col("numbers"), gazetteer).alias("found"), *(["row"] if carry else []))
    found = found.withColumn("found", outside(F.col("found")))
    return store.written(found, "candidates", compression="zstd")


FIELDS = ("kind", "format", "gazetteer", "context", "length")


def count_patterns(found: DataFrame) -> list[tuple[tuple, int]]:
    """Each combination of kind, votes and length with its count over all `searched` rows; at most PATTERNS."""
    rows = found.where(F.size("found") > 0).select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in FIELDS]).count()
    return sorted((tuple(r[f] for f in FIELDS), r["count"]) for r in rows.collect())


def estimate(patterns: list[tuple[tuple, int]], rounds: int = 60) -> tuple[dict[tuple, float], list[dict[tuple[int, int], float]]]:
    """Each pattern's probability and each labeler's reliability P(vote | truth), by expectation-maximisation."""
    # start from the majority of the votes; add-one counts keep every probability above nothing
    held = {p: 1 / (1 + math.exp(-2.0 * (p[1] + p[2] + p[3] - 0.5))) for p, _ in patterns}
    reliability: list[dict[tuple[int, int], float]] = []
    for _ in range(rounds if patterns else 0):
        prior: dict[str, list[float]] = {}
        reliability = [{(v, y): 1.0 + 2.0 * (v == (1 if y else -1)) for v in (-1, 0, 1) for y in (0, 1)} for _ in range(3)]
        for p, n in patterns:
            mass = prior.setdefault(p[0], [1.0, 1.0])
            for y, share in ((1, held[p]), (0, 1 - held[p])):
                mass[y] += n * share
                for j in range(3):
                    reliability[j][p[j + 1], y] += n * share
        for table in reliability:
            for y in (0, 1):
                total = sum(table[v, y] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    table[v, y] /= total
        for p, _ in patterns:
            odds = math.log(prior[p[0]][1] / prior[p[0]][0]) + sum(math.log(reliability[j][p[j + 1], 1] / reliability[j][p[j + 1], 0]) for j in range(3))
            held[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return held, reliability


def features(pattern: tuple) -> dict[str, float]:
    kind, form, listed, context, length = pattern
    return {"bias": 1.0, f"kind={kind}": 1.0, "format": form, "gazetteer": listed, "context": context, f"length={length}": 1.0}


def fit(patterns: list[tuple[tuple, int]], held: dict[tuple, float], steps: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier fitted to the probabilities, each pattern weighted by the log of its count."""
    weights: dict[str, float] = {}
    total = sum(math.log1p(n) for _, n in patterns)
    for _ in range(steps):
        slope: dict[str, float] = {}
        for p, n in patterns:
            x = features(p)
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) * v for f, v in x.items())))))
            for f, v in x.items():
                slope[f] = slope.get(f, 0.0) + math.log1p(n) * (guess - held[p]) * v / total
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * (g + shrink * weights.get(f, 0.0))
    return weights


def score(weights: dict[str, float], c: Column) -> Column:
    """The classifier's log-odds of a candidate, as a column."""
    of = lambda prefix, values, by: reduce(lambda acc, v: acc.when(by == v, weights.get(f"{prefix}={v}", 0.0)), values, F.when(F.lit(False), 0.0)).otherwise(0.0)
    linear = F.lit(weights.get("bias", -30.0)) + of("kind", (*BASE, *LOOSE), c["kind"]) + of("length", range(LENGTHS), c["length"])
    return linear + sum(F.lit(weights.get(f, 0.0)) * c[f] for f in ("format", "gazetteer", "context"))


def train(found: DataFrame) -> dict[str, float]:
    patterns = count_patterns(found)
    held, _ = estimate(patterns)
    return fit(patterns, held)


def accepted(found: Column, weights: dict[str, float]) -> Column:
    """Base spans and the looser candidates that the classifier accepts: array<struct<start, rank, kind, end>>."""
    threshold = math.log(ACCEPT / (1 - ACCEPT))
    kept = F.filter(found, lambda c: F.when(c["kind"].isin(*BASE), c["format"] == 1).otherwise(score(weights, c) >= threshold))
    rank = lambda c: reduce(lambda acc, x: acc.when(c["kind"] == x[1], x[0]), enumerate((*BASE, *LOOSE)), F.when(F.lit(False), -1))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), rank(c).alias("rank"), c["kind"].alias("kind"), c["end"].alias("end")))


def detect(docs: DataFrame, weights: dict[str, float] | None = None, gazetteer: Gazetteer = Gazetteer()) -> DataFrame:
    """doc_id and `found` (array<struct<start, rank, kind, end>>) of each row."""
    rows = searched(docs, gazetteer)
    weights = train(rows) if weights is None else weights
    return rows.select(F.col("row_doc").alias("doc_id"), accepted(F.col("found"), weights).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    rows = detect(docs)
    of_kind = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    own = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return rows.select("doc_id", *[of_kind(k).alias(f"n_{k}") for k in BASE], F.sha2(spans.listed(own), 256).alias("base_sha256"), spans.listed(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    ends = lambda xs: spans.running(xs, F.lit(0), lambda at, x: F.greatest(at, x["end"]), "int", lambda at, x: at)

    def runs(sorted_: Column, before: Column) -> Column:
        """Of sorted spans and the furthest end before each: the first of every run, with the end of the run."""
        with_before = F.zip_with(sorted_, before, lambda x, b: F.struct(x["start"].alias("low"), x["kind"].alias("kind"), b.alias("before")))
        first = F.filter(with_before, lambda x, i: (i == 0) | (x["low"] >= x["before"]))
        last = F.array_max(F.transform(sorted_, lambda x: x["end"]))
        high = F.concat(F.transform(F.slice(first, 2, F.size(first)), lambda x: x["before"]), F.array(last))
        return F.zip_with(first, high, lambda x, h: F.struct(x["low"].alias("low"), h.alias("high"), x["kind"].alias("kind")))

    def cut(merged: Column) -> Column:
        piece = spans.pieces(text)

        def parts(blocks: Column) -> Column:
            before = lambda i: F.when(i > 0, merged[i - 1]["high"]).otherwise(0)
            kept = F.transform(merged, lambda r, i: F.concat(piece(blocks, before(i), r["low"]), F.lit("<"), F.upper(r["kind"]), F.lit(">")))
            return F.concat(F.array_join(kept, ""), piece(blocks, F.element_at(merged, -1)["high"], F.char_length(text)))

        return spans.bound(spans.blocks_of(text), parts)

    merged = spans.bound(F.array_sort(found), lambda xs: spans.bound(ends(xs), lambda b: spans.bound(runs(xs, b), cut)))
    return F.when(F.size(found) == 0, text).otherwise(merged)


def redact(docs: DataFrame, weights: dict[str, float] | None = None, gazetteer: Gazetteer = Gazetteer()) -> DataFrame:
    """Every row of docs with its spans replaced in `text`, and n_chars to match; null text stays null."""
    rows = searched(docs, gazetteer, carry=True)
    weights = train(rows) if weights is None else weights
    text = F.col("row.text")
    fresh = F.when(text.isNotNull(), spans.bound(accepted(F.col("found"), weights), lambda found: redacted(text.cast("string"), found)))
    changed = F.size("found") > 0
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    name = next(c for c in docs.columns if c.lower() == "text")
    columns[name] = F.when(changed, fresh).otherwise(text)
    out = rows.select(*[v.alias(c) for c, v in columns.items()])
    size = F.char_length(name).cast("long")
    return out.withColumn("n_chars", F.when(F.col(name).isNotNull(), size).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
