"""Secret scan with a trigram inverted index. DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query. One pass over the
texts writes the index: for every trigram that some query names, its postings as
a bitmap over the rows - a Boolean column, which Parquet stores as run-length
coded bits in the order of the rows - beside the text of each row. Queries are
ANDs and ORs of those columns: they intersect postings row block by row block,
where the texts lie, so no posting and no text is moved between tasks, whatever
ids the rows have. Only the texts whose query holds are verified with the rule's
expression. Rules without mandatory trigrams scan every text.

Rules: three base kinds (assign, access, hex) and those of the method, by the
public formats of common tokens. A rule's match may have to be longer than its
pattern says; matches that fail are dropped and not tried again.

Defined results: null text is empty, without spans. Every row is scanned by
itself, so null or repeated doc_ids do no harm. Texts of any length are scanned
whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, store, trigrams


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds and the formats of common tokens.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)


def posting(trigram: str) -> str:
    """The name of a trigram's column."""
    return "t_" + "_".join(f"{ord(c):x}" for c in trigram)


def named(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries name."""
    return sorted({g for r in rules for clause in trigrams.query(r.pattern) or () for g in clause})


def build(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index, a written table: doc_id and text of each row, and the postings of every named trigram as a Boolean column."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = rows.select("doc_id", "text", F.lower("text").alias("low"))
    return store.written(low.select("doc_id", "text", *[F.contains("low", F.lit(g)).alias(posting(g)) for g in named(rules)]), "postings", compression="zstd")


def holds(rule: Rule) -> Column:
    """Whether a row of the index fulfils the rule's query: for some clause, all its postings have the row."""
    clauses = trigrams.query(rule.pattern)
    if clauses is None:
        return F.lit(True)
    every = lambda clause: reduce(lambda a, b: a & b, [F.col(posting(g)) for g in sorted(clause)])
    return reduce(lambda a, b: a | b, map(every, clauses))


def candidates(index: DataFrame, rule: Rule) -> DataFrame:
    """The rows of the index on which a rule is verified; the scan reads their texts and the rule's postings only."""
    return index.where(holds(rule)).select("doc_id", "text")


def _kept(text: Column, rule: Rule, needs: Column) -> Column:
    found = spans.matches(text, rule.pattern, needs)
    if not rule.least:
        return found
    return F.filter(found, lambda x: F.char_length(F.regexp_extract(x["what"], rule.pattern, rule.group)) >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and the spans of each row: array<struct<start, rank, kind, end>> named `found`."""
    index = build(docs, rules)
    found = [spans.ranked(_kept(F.col("text"), rule, holds(rule)), rank, rule.kind) for rank, rule in enumerate(rules)]
    return index.select("doc_id", "text", F.concat(*found).alias("found"))


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for each row."""
    base = [r.kind for r in rules if r.base]
    rows = scan(docs, rules).select("doc_id", "found")
    of_kind = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in base]
    own = F.filter("found", lambda x: x["kind"].isin(base))
    return rows.select("doc_id", *counts, F.sha2(spans.listed(own), 256).alias("base_sha256"), spans.listed(F.col("found")).alias("spans"))
