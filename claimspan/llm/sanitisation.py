"""Personal data: patterns, and terms that disclose whom a text is about.

Base spans are found by pattern and checked (address parts, card checksum, digit counts).
Their values are the protected entities. For each term that stands within CONTEXT code
points of an entity, corpus counts tell how strongly the term reveals it:

    P(entity | term) = (documents with both, close together + PRIOR)
                       / (documents with the term + 2 * PRIOR)
    bits             = log2(P(entity | term) / P(entity))

A term is disclosing if both figures reach their thresholds. However few documents there are,
they are judged; PRIOR holds back what one or two can tell. Its occurrences in documents with the entity become
spans of kind `term`: removed from MIN_REMOVE on, generalised below. Base spans stay as they
are; a term inside one is not told again.

Everything is DataFrame functions. All counts cover all documents; they are aggregated
within tasks before they are shuffled, so a common entity or word costs a row per task.
Positions come from the texts between matches, summed per document; only documents with a
match are exploded.

Defined results: a null or empty text has no spans. Repeated rows get equal results, and count
as so many documents. Extra columns are left out by `report`; `redact` keeps them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspan.llm.common import stored

# The kinds in their order, and each kind's pattern. The e-mail and card
# patterns hold possessive quantifiers where giving back can't help, so that Java's matcher
# neither recurses nor rescans; an e-mail starts where its run of characters starts or the
# match before it ends.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}{3,}+"

CONTEXT = 100
PRIOR = 0.5
MIN_SHARE = 0.5
MIN_REMOVE = 0.9
MIN_BITS = 6.0

KEY = ["doc_id", "__text_hash"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, -at, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(at % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _checked(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    count = F.length(digits)
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (F.when(kind == 0, True)
            .when(kind == 1, value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == 2, F.when(count.between(14, 19), _luhn(digits)).otherwise(False))
            .otherwise(count.between(10, 15)))


def _located(texts: DataFrame, patterns: dict[int, str], may: dict[int, Column]) -> DataFrame:
    """KEY, kind, start, end, value of every match; texts has KEY and text, no row twice."""
    found = [F.struct(F.lit(kind).alias("kind"),
                      F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("values"),
                      F.split("text", pattern, -1).alias("gaps"))
             for kind, pattern in patterns.items()]
    some = reduce(lambda a, b: a | b, may.values())
    rows = texts.where(some).select(*KEY, F.explode(F.array(*found)).alias("f")).select(
        *KEY, "f.kind", F.posexplode(F.arrays_zip(
            F.col("f.values").alias("value"),
            F.slice("f.gaps", F.lit(1), F.size("f.values")).alias("gap"))).alias("at", "m"))
    so_far = Window.partitionBy(*KEY, "kind").orderBy("at")
    end = F.sum(F.length("m.gap") + F.length("m.value")).over(so_far).alias("end")
    return rows.select(*KEY, "kind", F.col("m.value").alias("value"), end).select(
        *KEY, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("__text_hash"))


def base_spans(docs: DataFrame) -> DataFrame:
    """KEY, kind (number), start, end, value of the base spans; repeated rows once."""
    tests = {0: F.contains("text", F.lit("@")) & F.col("text").rlike(PATTERNS["email"]),
             1: F.col("text").rlike(PATTERNS["ip"]),
             2: F.col("text").rlike(PATTERNS["card"]),
             3: F.contains("text", F.lit("+")) & F.col("text").rlike(PATTERNS["phone"])}
    some = reduce(lambda a, b: a | b, tests.values())
    texts = _texts(docs).where(some).dropDuplicates(KEY)
    spans = _located(texts, dict(enumerate(PATTERNS.values())), {0: F.lit(True)})
    return spans.where(_checked(F.col("kind"), F.col("value")))


def _entity(spans: DataFrame) -> Column:
    return F.concat_ws(":", F.col("kind"), F.when(
        F.col("kind") >= 2, _digits(F.col("value"))).otherwise(F.lower("value")))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing_terms(docs: DataFrame, spans: DataFrame, context: int = CONTEXT,
                     min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """entity, term, share (P(entity | term)) and bits of the terms over the thresholds."""
    copies = _texts(docs).select(*KEY).join(
        spans.select(*[F.col(k).alias(f"s_{k}") for k in KEY]).distinct(),
        F.col("doc_id").eqNullSafe(F.col("s_doc_id"))
        & (F.col("__text_hash") == F.col("s___text_hash")), "left_semi")
    weight = copies.groupBy(*KEY).agg(F.count("*").alias("copies"))
    entities = (spans.select(*KEY, _entity(spans).alias("entity")).distinct()
                .join(_null_safe(weight), _same_key("w_")))
    known = entities.groupBy("entity").agg(F.sum("copies").alias("entity_docs"))
    near = spans.select(*KEY, _entity(spans).alias("entity"), "before", "after")
    together = (near.select(*KEY, "entity", F.explode(_words(
        F.concat_ws(" ", "before", "after"))).alias("term")).distinct()
        .join(_null_safe(weight), _same_key("w_"))
        .groupBy("entity", "term").agg(F.sum("copies").alias("together")))
    terms = (docs.select(F.explode(_words(F.col("text"))).alias("term"))
             .groupBy("term").agg(F.count("*").alias("term_docs")))
    total = docs.agg(F.count("*").alias("docs"))
    share = (F.col("together") + PRIOR) / (F.greatest("term_docs", "together") + 2 * PRIOR)
    return (together.join(known, "entity").join(terms, "term").crossJoin(F.broadcast(total))
            .select("entity", "term", share.alias("share"),
                    F.log2(share * F.col("docs") / F.col("entity_docs")).alias("bits"))
            .where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)))


def _null_safe(weight: DataFrame) -> DataFrame:
    return weight.select(*[F.col(k).alias(f"w_{k}") for k in KEY], "copies")


def _same_key(prefix: str) -> Column:
    return (F.col("doc_id").eqNullSafe(F.col(f"{prefix}doc_id"))
            & (F.col("__text_hash") == F.col(f"{prefix}__text_hash")))


def all_spans(docs: DataFrame) -> DataFrame:
    """KEY, kind, start, end and action of the base spans and of disclosing terms."""
    located = base_spans(docs)
    hashed = _texts(docs)
    holders = located.select(*[F.col(k).alias(f"h_{k}") for k in KEY]).distinct()
    # Texts with a span, each once; they are few against all.
    texts = hashed.join(holders, _same_key("h_"), "left_semi").dropDuplicates(KEY)
    around = located.join(_prefixed(texts, "t_"), _same_key("t_")).select(
        *KEY, "kind", "start", "end", "value",
        F.expr(f"substring(t_text, greatest(start - {CONTEXT}, 0) + 1, "
               f"least(start, {CONTEXT}))").alias("before"),
        F.expr(f"substring(t_text, end + 1, {CONTEXT})").alias("after"))
    spans = stored(around, "personal_spans")
    terms = disclosing_terms(docs, spans)
    wanted = stored(spans.select(*KEY, _entity(spans).alias("entity")).distinct()
                    .join(terms, "entity").groupBy(*KEY, "term")
                    .agg(F.max("share").alias("share")), "disclosing_terms")
    telling = wanted.select(*[F.col(k).alias(f"h_{k}") for k in KEY]).distinct()
    told = _located(hashed.join(telling, _same_key("h_"), "left_semi").dropDuplicates(KEY),
                    {4: TERM}, {0: F.lit(True)})
    hit = told.join(_prefixed(wanted, "w_"),
                    _same_key("w_") & (F.lower("value") == F.col("w_term")))
    inside = _prefixed(spans.select(*KEY, "start", "end"), "b_")
    added = hit.join(inside, _same_key("b_") & (F.col("start") < F.col("b_end"))
                     & (F.col("b_start") < F.col("end")), "left_anti")
    action = F.when(F.col("w_share") >= MIN_REMOVE, "remove").otherwise("generalise")
    return spans.select(*KEY, "kind", "start", "end", F.lit("remove").alias("action")).union(
        added.select(*KEY, "kind", "start", "end", action.alias("action")))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(name).alias(f"{prefix}{name}") for name in df.columns])


def _listed(docs: DataFrame) -> DataFrame:
    """KEY and its spans, in order of start, kind and end."""
    return all_spans(docs).groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.struct("start", "kind", "end", "action"))).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start, s.end)), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    listed = _prefixed(_listed(docs), "l_")
    joined = _texts(docs).select(*KEY).join(listed, _same_key("l_"), "left")
    spans = F.coalesce("l_spans", F.expr(
        "cast(array() as array<struct<start:bigint,kind:int,end:bigint,action:string>>)"))
    base = F.filter(spans, lambda s: s.kind < 4)

    def counted(kind: int) -> Column:
        found = F.size(F.filter(spans, lambda s: s.kind == kind))
        return found.cast("long").alias(f"n_{KINDS[kind]}")

    counts = [counted(kind) for kind in range(5)]
    return joined.select("doc_id", *counts[:4], F.sha2(_written(base), 256)
                         .alias("base_sha256"), _written(spans).alias("spans"), counts[4])


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind, or by [...] if it is generalised.

    Overlapping spans are replaced as one, by the kind of the first.
    """
    before = Window.partitionBy(*KEY).orderBy("start", "kind", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = all_spans(docs).withColumn(
        "new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    islands = apart.withColumn("island", F.sum("new").over(before)).groupBy(
        *KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                            F.min_by("kind", F.struct("start", "kind")).alias("kind"),
                            F.min_by("action", F.struct("start", "kind")).alias("action"))
    listed = islands.groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.struct("start", "end", "kind", "action"))).alias("spans"))
    joined = docs.withColumn("__text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        _prefixed(listed, "l_"), _same_key("l_"), "left")
    labels = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    kept = F.transform("l_spans", lambda s, i: F.concat(
        F.substring("text", F.when(i == 0, 0).otherwise(F.get(
            F.col("l_spans"), i - 1).end).cast("int") + 1,
            (s.start - F.when(i == 0, 0).otherwise(F.get(F.col("l_spans"), i - 1).end))
            .cast("int")),
        F.when(s.action == "generalise", "[...]").otherwise(F.get(labels, s.kind))))
    last = F.element_at("l_spans", -1).end.cast("int")
    text = F.when(F.col("l_spans").isNull(), F.col("text")).otherwise(F.concat(
        F.array_join(kept, ""), F.substring("text", last + 1, F.length("text"))))
    return joined.withColumn("text", text).select(*docs.columns)
