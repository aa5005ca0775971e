"""Personal data: patterns, and terms that give a protected entity away, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Their values are the
protected entities. Terms (words) that stand in several documents of an entity are tested by what
they tell: with P(e | t), the share of the term's documents that mention the entity, the pointwise
mutual information log2(P(e | t) / P(e)) against the information log2(1 / P(e)) of the entity itself is
the part of the entity that the term discloses. A term at or over the threshold is removed wherever it
stands in that entity's documents, other than inside base spans; the entities are generalised to their
kind.

Plan. One pass over the texts finds base spans; texts that have some are written with them. One more
counts in how many documents each term occurs, by partial aggregation; terms too common to disclose any
entity are ruled out exactly by that count. Only documents of entities with enough support give their
remaining words, which meet the document's entities and are counted with partial aggregation. Joins on
what one entity or one term may hold most of are dealt to parts. What is done inside one text is n log n
in its words and spans.

All four counts are of different documents (doc_id and text): of all, of an entity, of a term, of both.
Support is the least number of documents that an entity and a term must share: of fewer, every word of
a document would disclose its address.

Patterns are written for one linear scan: a run is tried once from its start (or from the end of the
match before it), where trying every place in it would take the square of its length.

Defined results. Null or empty text: no spans. Null doc_id: as any document. Repeated rows: each gets
its spans; for counts, rows alike in doc_id and text are one document. Empty table: empty result.
`sanitise` passes extra columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.bind import let
from seqloom.functions.patterns import blocks, prefix_sums, regex_hits, running, taken
from seqloom.llm.common import cut, fresh, table, written

# Fixed patterns of the base kinds.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = list(PATTERNS)
#: Documents that must hold an entity and a term.
SUPPORT = 3
#: Share of an entity's information at which a term discloses it.
DISCLOSURE = 0.9
TERM = r"[^\x20\x09-\x0D]+"


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 1, F.substr(backwards, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(backwards, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(backwards, i, F.lit(1)).cast("int") * 2 / 10).cast("int")
        ),
    )
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, p.cast("decimal(38,0)") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind, then start."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    def of_kind(kind: str) -> Column:
        may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.rlike(text, F.lit("[0-9][ -]?[0-9]"))
        got = F.filter(F.when(may, regex_hits(text, PATTERNS[kind])).otherwise(empty), lambda s: _passes(kind, s["value"]))
        return F.transform(got, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*map(of_kind, KINDS))


def normal(word: Column) -> Column:
    """A word as a term: lower case, without marks around it."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def entity(kind: Column, value: Column) -> Column:
    plain = F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value))
    return F.concat(kind, F.lit(":"), plain)


#: From a word's first letter or digit to its last: what normal() leaves of it.
CORE = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"


def terms_of(text: Column) -> Column:
    """array<string>: the different terms of a text, by one scan for what is left of its words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({CORE})"), F.lit(1)), F.lower))


def word_places(text: Column) -> Column:
    """array<struct<start, end, term>> of all words."""

    def of(words: Column) -> Column:
        gaps = F.slice(F.split(text, TERM, -1), 1, F.size(words))
        ends = let(F.zip_with(gaps, words, lambda b, m: F.length(b) + F.length(m)), prefix_sums)
        return F.zip_with(words, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), normal(m).alias("term")))

    return let(F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1)), of)


def apart(words: Column, spans: Column) -> Column:
    """The words (sorted, with start and end) that overlap no span. In order of where spans begin and
    words end, a word is apart if no span before it ends behind its start."""
    seen = F.transform(spans, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    asked = F.transform(words, lambda w: F.struct(w["end"].alias("at"), F.lit(0).alias("kind"), w["start"].alias("start"), w["end"].alias("end")))

    def of(events: Column) -> Column:
        reach = let(F.transform(events, lambda x: F.when(x["kind"] == 1, x["end"]).otherwise(0)), lambda v: running(v, lambda a, b: F.greatest(a, b)))
        kept = F.filter(F.zip_with(events, reach, lambda x, r: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), r.alias("reach"))), lambda x: (x["kind"] == 0) & (x["reach"] <= x["start"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return let(F.sort_array(F.concat(seen, asked)), of)


#: Parts that the rows of one entity or one term are dealt to in joins.
PARTS = 32


def _dealt(rows: DataFrame, looked_up: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with a table that has one row for each key; rows of one key go to PARTS tasks."""
    copies = looked_up.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    return rows.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).join(copies.hint("merge"), [*on, "_part"]).drop("_part")


def _with_rows(words: DataFrame, rows_of: DataFrame, n_docs: int) -> DataFrame:
    """words with n_t of their term, without terms that rows_of lacks. Terms in over a thousandth of the
    documents, at most a thousand times the words of a document, are looked up by broadcast, so that no
    task gets all rows of one."""
    limit = max(1, n_docs // 1000)
    looked = words.join(F.broadcast(rows_of.filter(F.col("n_t") > limit)), "term", "left")
    rest = looked.filter("n_t is null").drop("n_t").join(rows_of.filter(F.col("n_t") <= limit).hint("merge"), "term")
    return looked.filter("n_t is not null").unionByName(rest)


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: 128 bits of id and text."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("\x01")), F.coalesce(text, F.lit("")))))


#: Keys of repeated rows up to which they are looked up by broadcast, 16 bytes each.
FEW = 100_000


def _once(base: DataFrame, again: DataFrame, n: int) -> DataFrame:
    """base with one row of those that have one of the n keys `again`."""
    if not n:
        return base
    again = F.broadcast(again) if n <= FEW else again.hint("merge")
    return base.join(again, "key", "left_anti").unionByName(base.join(again, "key", "left_semi").dropDuplicates(["key"]))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, key (hash of id and text), base spans, and terms array<struct<start, end>>: one row for
    each row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), t).alias("key"), t.alias("text"))
    spans = base.select("doc_id", "key", "text", base_spans(F.col("text")).alias("spans"))
    told = written(spans.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")))
    rows = told.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") > 1).alias("again")).first()
    n_docs = counted["docs"]
    named = told.select("key", F.explode(F.array_distinct(F.transform("spans", lambda s: entity(s["kind"], s["value"])))).alias("entity")).distinct()
    named = cut(named)
    of_entity = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support)
    mentions = cut(_dealt(named, of_entity, ["entity"]))
    # A pair's information is at most log2(N / n_t), as n_te is at most n_e, so no term over this n_t
    # can disclose the entity.
    n = F.lit(float(max(n_docs, 1)))
    most = F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - threshold)) + 1e-6 * n
    top = mentions.agg(F.max(most).alias("m")).first()["m"] or 0.0
    # in how many documents each term stands: the words of all texts, counted task by task before the
    # shuffle
    words = _once(base.select("key", "text"), rows.filter("n > 1").select("key"), counted["again"]).select(F.explode(terms_of(F.col("text"))).alias("term"))
    rows_of = cut(words.filter(F.length("term") >= 2).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t").between(support, top)))
    held = told.filter(F.col("text").isNotNull()).join(mentions.select("key").distinct().hint("merge"), "key", "left_semi")
    held = held.dropDuplicates(["key"]).select("key", F.explode(terms_of(F.col("text"))).alias("term"))
    pairs = _with_rows(held, rows_of, n_docs).join(mentions.hint("merge"), "key").filter(F.col("n_t") <= most)
    pairs = written(pairs)
    judged = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= support)
    information = F.log2(n / F.col("n_e"))
    mutual = F.log2(F.col("n_te") * n / (F.col("n_e") * F.col("n_t")))
    risky = judged.filter((information > 0) & (mutual >= threshold * information)).select("entity", "term")
    said = _dealt(pairs, risky, ["entity", "term"]).select("key", "term").distinct()
    texts = told.filter(F.col("text").isNotNull()).join(said.select("key").distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    at = texts.select("key", F.explode(word_places(F.col("text"))).alias("w")).select("key", F.col("w.term").alias("term"), F.struct("w.start", "w.end").alias("w"))
    marked = at.join(said.hint("merge"), ["key", "term"]).groupBy("key").agg(F.sort_array(F.collect_list("w")).alias("words"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = told.drop("text").join(marked.hint("merge"), "key", "left")
    return joined.select("doc_id", "key", "spans", F.when(F.col("words").isNotNull(), apart(F.col("words"), F.col("spans"))).otherwise(none).alias("terms"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_terms(spans: Column, terms: Column) -> Column:
    plain = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.concat(plain, F.transform(terms, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with entities replaced by their kind in brackets and disclosing terms by [term]. Where
    spans overlap, the union of them becomes the kind that begins first."""
    key, found = (fresh(docs, n) for n in ("_pii_key", "_pii_spans"))
    spans = find(docs, **options).select(F.col("key").alias(key), with_terms(F.col("spans"), F.col("terms")).alias(found)).filter(F.size(found) > 0).dropDuplicates([key])
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(spans.hint("merge"), key, "left")
    by_start = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rebuilt(x: Column) -> Column:
        """What is before each span that no earlier one reaches, and the span's kind."""
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(x["reach"], i - 1))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(taken(x["text"], before(i), s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), taken(x["text"], F.element_at(x["reach"], -1), x["n"]))

    def reached(spans: Column) -> Column:
        reach = let(F.transform(spans, lambda s: s["end"]), lambda v: running(v, lambda a, b: F.greatest(a, b)))
        return let(F.struct(spans.alias("spans"), reach.alias("reach"), blocks("text").alias("text"), F.length("text").alias("n")), rebuilt)

    return keyed.withColumn("text", F.when(F.col(found).isNotNull(), let(by_start, reached)).otherwise(F.col("text"))).select(*docs.columns)


def op6(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(span_list(F.col("spans")), 256).alias("base_sha256"), span_list(with_terms(F.col("spans"), F.col("terms"))).alias("spans"))
