"""Secret scan by a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean trigram query is derived on the driver (``trigrams``). The trigrams that the queries name are looked
up in every text, which gives postings (trigram, document). Per clause, the postings of its trigrams are intersected, and the
candidates go back to their texts, where the regex is run. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; of them those count whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = True


#: A private key after its first line: to its END line, with no other BEGIN or END before; without one, header and base64 lines, broken by line
#: breaks, blanks, escapes or marks of quotes and comments. Possessive, so that Java needs no stack for long keys.
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
_KEY_LINES = r"""(?:(?:[\s>#*|"',]|\\[nr]|//)*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]{1,15}+={0,2}(?=[ \t"',;+]*(?:[\r\n]|\\[nr]|$))))++"""

#: Fixed values. The first three are the contract's: the second and third are written with their least length, which selects
#: the same spans, as a shorter match holds no longer one.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----(?:{_TO_END}|{_KEY_LINES})?", base=False),
)

SPAN = "struct<start:int,rank:int,stop:int,kind:string>"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``trigram, key``: the index over the trigrams that queries name, in lower case."""
    folded = F.transform(F.array(F.lower("text")), lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))[0]
    return docs.select("key", F.explode(folded).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key, kinds``: the rules whose trigram query a text fulfils, without those that have none."""
    spark = docs.sparkSession
    clauses = [(r.kind, k, sorted(clause)) for r in rules if (q := trigram_query(r.regex)) for k, clause in enumerate(sorted(map(sorted, q)))]
    if not clauses:
        return docs.select("key", F.lit(None).cast("array<string>").alias("kinds")).limit(0)
    named = sorted({g for _, _, clause in clauses for g in clause})
    # The clauses come from the rules alone, some dozens of rows whatever the input.
    lines = [F.struct(F.lit(g).alias("trigram"), F.lit(kind).alias("kind"), F.lit(k).alias("clause"), F.lit(len(clause)).alias("size")) for kind, k, clause in clauses for g in clause]
    wanted = spark.range(1).select(F.inline(F.array(*lines)))
    met = postings(docs, named).join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "clause", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in ``text``: code points, end exclusive. The pieces between matches, and the matches, give the places."""
    pieces, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.least else found
    steps = F.arrays_zip(pieces.alias("piece"), found.alias("match"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["piece"])
        stop = at + F.length(x["match"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
        keep = F.length(x["held"]) >= rule.least
        return F.when(x["match"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, text, secrets``; secrets are structs (start, rank, stop, kind) by start, then by the rules' order.

    Null text is empty and has none. A key is a hash of the text alone: repeated rows and null ids are each scanned
    and kept, and rows of one text share its candidates. Texts whose hashes collide share the union of theirs; the regex is run on each
    row's own text, so that costs time and loses nothing. Empty table: empty result. Texts are
    scanned whole, whatever their length; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    found = candidates(keyed, rules)
    joined = keyed.join(found, "key", "left")
    none = F.array().cast(f"array<{SPAN}>")
    per_rule = []
    for rank, rule in enumerate(rules):
        every = spans(F.col("text"), rule, rank)
        if trigram_query(rule.regex):
            every = F.when(F.array_contains("kinds", rule.kind), every).otherwise(none)
        else:  # nothing is mandatory: a full scan, and spans only where there is a match
            every = F.when(F.rlike("text", F.lit(rule.regex)), every).otherwise(none)
        per_rule.append(every)
    return joined.select(F.col("id").alias(id_col), "text", F.array_sort(F.flatten(F.array(*per_rule))).alias("secrets"))


def joined_spans(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, the digest of their spans, and all spans."""
    found = find_secrets(docs, rules, id_col=id_col, text_col=text_col)
    base = [r.kind for r in rules if r.base]
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    mine = F.filter("secrets", lambda s: s["kind"].isin(base))
    return found.select(id_col, *map(of, base), F.sha2(joined_spans(mine), 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans"))


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span, and spans that overlap it, replaced by ``mark``; texts without secrets, and nulls, stay as they are."""
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    found = find_secrets(docs.select(row.alias("row"), F.col(text_col).alias("body")), rules, id_col="row", text_col="body")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

    clean = F.aggregate("secrets", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    put = F.when(F.size("secrets") > 0, clean)
    return found.select(*[F.coalesce(put, F.col(f"row.c{k}")).alias(c) if c == text_col else F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
