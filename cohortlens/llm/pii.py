"""Personal data, with DataFrame functions only: patterns first, then terms that give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers; each found value is a
protected entity. Corpus co-occurrence then says how much a term of a document with an entity reveals
of it: with df counted over all documents and N documents,

    PMI(term; entity) = log2(N * df(term, entity) / (df(term) * df(entity)))
    disclosure        = PMI / -log2(df(entity) / N)          at most 1

Terms of a disclosure of GENERALISE or more are replaced by a general word, of REMOVE or more taken
out, wherever they stand in a document that holds the entity. A pair is evidence if chance hardly makes
it: over distinct texts (copies prove nothing), the hypergeometric probability that so many texts of
the entity hold the term, times the number of terms, is at most CHANCE. Terms are words of a text without
its pattern matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh
from cohortlens.session import pin, stored

# The kinds and their patterns. Runs are matched whole (possessive), which finds the
# same matches as plain repetition in linear time; a local part begins at its run or after a match.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"(?<=[^\p{L}])\p{L}{3,}(?=[^\p{L}])"
GENERALISE, REMOVE = 0.7, 0.95
# Terms that chance alone may tie to an entity, as an expected number for each entity.
CHANCE = 0.05
MARK, OTHER = "\u0001", "\u0002"
# Items of a list that are worked on together, at least.
BLOCK = 64


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once. The result is copied, so it should not be a state that grows."""
    return F.transform(F.array(value), body)[0]


def in_blocks(items: Column, power: float, state: Column, step, finish) -> Column:
    """`aggregate` over blocks of `n ** power` of n items (one at least), `step(state, block)`.

    Adding to an array copies it; arrays that grow by blocks of a block's results keep long lists cheap.
    """
    width = F.greatest(F.lit(BLOCK), F.ceil(F.pow(F.size(items), F.lit(power))).cast("int"))
    firsts = F.sequence(F.lit(1), F.size(items), width)
    return F.aggregate(firsts, state, lambda acc, i: step(acc, F.slice(items, i, width)), finish)


def matches(text: Column, pattern: str, valid) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that `valid` accepts, in code points.

    Matches are set between marks and the text is split there; a mark in the text itself becomes
    another character that no pattern holds.
    """
    plain = F.translate(text, MARK, OTHER)
    split = F.split(F.regexp_replace(plain, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def state(at: Column, inside: Column, found: Column) -> Column:
        return F.struct(at.alias("at"), inside.alias("inside"), found.alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        one = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value"))
        found = F.when(acc["inside"] & valid(part), F.concat(acc["found"], F.array(one))).otherwise(acc["found"])
        return state(end, ~acc["inside"], found)

    def block(acc: Column, parts: Column) -> Column:
        add = lambda r: state(r["at"], r["inside"], F.concat(acc["found"], F.array(r["found"])))
        return F.aggregate(parts, state(acc["at"], acc["inside"], none), step, add)

    lists = F.array().cast("array<array<struct<start:int,end:int,value:string>>>")
    first = state(F.lit(0), F.lit(False), lists)
    return let(split, lambda parts: in_blocks(parts, 0.4, first, block, lambda acc: F.flatten(acc["found"])))


def rebuilt(text: Column, spans: Column, fill) -> Column:
    """The text with `fill(span, at)` in place of each span of a list ordered by start; the text before `at` is done.

    A block of spans is cut out of the text first, so a span is looked for in its block only.
    """
    none = F.array().cast("array<string>")

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"))

    def block(acc: Column, own: Column) -> Column:
        stop = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))

        def step(r: Column, s: Column, chunk: Column) -> Column:
            kept = F.substr(chunk, r["at"] - acc["at"] + 1, F.greatest(s["start"] - r["at"], F.lit(0)))
            return state(F.greatest(r["at"], s["end"]), F.concat(r["out"], F.array(F.concat(kept, fill(s, r["at"])))))

        def piece(chunk: Column) -> Column:
            return F.aggregate(
                own, state(acc["at"], none), lambda r, s: step(r, s, chunk), lambda r: F.array_join(r["out"], "")
            )

        done = let(F.substr(text, acc["at"] + 1, stop - acc["at"]), piece)
        return state(stop, F.concat(acc["out"], F.array(done)))

    def finish(acc: Column) -> Column:
        return F.array_join(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, F.char_length(text)))), "")

    return F.when(F.size(spans) == 0, text).otherwise(
        let(spans, lambda own: in_blocks(own, 0.5, state(F.lit(0), none), block, finish))
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str):
    if kind == "email":
        return lambda v: F.lit(True)
    if kind == "ip":
        return lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        size = lambda v: F.length(digits(v)).between(12, 19)
        return lambda v: F.when(size(v), luhn(digits(v))).otherwise(False)
    return lambda v: F.length(digits(v)).between(9, 15)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> of the pattern matches, by start, then kind as listed."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def named(rank: int, kind: str):
        value = F.lower if kind in ("email", "ip") else digits
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), value(s["value"]).alias("value"),
        )

    found = []
    for rank, kind in enumerate(KINDS):
        # Texts without the sign that a kind needs are not split at all.
        needed = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        spans = F.when(needed, matches(text, PATTERNS[kind], _valid(kind))).otherwise(none)
        found.append(F.transform(spans, named(rank, kind)))
    return F.sort_array(F.concat(*found))


def blanked(text: Column, base: Column) -> Column:
    """The text with spaces in place of its base spans; positions stay."""

    def spaces(s: Column, at: Column) -> Column:
        return F.repeat(F.lit(" "), F.greatest(at, s["end"]) - F.greatest(at, s["start"]))

    return rebuilt(text, base, spaces)


def padded(text: Column, base: Column) -> Column:
    return F.concat(F.lit(" "), blanked(text, base), F.lit(" "))


def term_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def terms_of(text: Column, base: Column) -> Column:
    """Hashes of the different terms of a text."""
    words = F.regexp_extract_all(padded(text, base), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(words, term_hash))


def with_terms(base: Column, text: Column, general: Column, removed: Column) -> Column:
    """Base spans, and every mention of the listed terms (null: none) as a span "generalise" or "remove"."""

    def span(t: Column) -> Column:
        gone = F.array_contains(removed, term_hash(t["value"]))
        return F.struct(
            (t["start"] - 1).alias("start"), F.when(gone, 5).otherwise(4).alias("rank"), (t["end"] - 1).alias("end"),
            F.when(gone, "remove").otherwise("generalise").alias("kind"), F.lit("").alias("value"),
        )

    listed = lambda v: F.array_contains(general, term_hash(v)) | F.array_contains(removed, term_hash(v))
    mentions = F.transform(matches(padded(text, base), TERM, listed), span)
    return F.when(general.isNull(), base).otherwise(F.sort_array(F.concat(base, mentions)))


def found_base(docs: DataFrame, text: str, key: str, base: str) -> DataFrame:
    """`docs` with a hash of the text and its base spans (a null text is empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(key, F.unhex(F.md5(body.cast("binary")))).withColumn(base, base_spans(body))


def least_texts(texts: int, terms: int) -> int:
    """The fewest joint texts that any pair needs: a term and an entity that only occur together, so often."""
    k = 1
    while k <= texts // 2 and terms > CHANCE * math.comb(texts, k):
        k += 1
    return k if terms <= CHANCE * math.comb(texts, k) else texts + 1


def _log_factorial(n: Column) -> Column:
    """Stirling's series, right to 0.001 from 1 on."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 1, 0.0).otherwise(series)


def log_chance(both: Column, term: Column, entity: Column, texts: int) -> Column:
    """ln of (a bound from above on) the chance that `both` or more of the entity's texts hold the term.

    The hypergeometric probability of `both`, and of more by a geometric series: its terms fall
    faster. Where they do not fall yet, at or below the expected number, the bound is 1.
    """
    pick = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    n = F.lit(float(texts))
    point = pick(term, both) + pick(n - term, entity - both) - pick(n, entity)
    ratio = (entity - both) * (term - both) / ((both + 1.0) * (n - entity - term + both + 1.0))
    return F.when(ratio < 1, point - F.ln(1 - ratio)).otherwise(0.0)


def revealing_terms(marked: DataFrame, text: str, key: str, base: str) -> DataFrame:
    """(key, general, removed): for the hash of each text with entities, the hashes of terms that disclose one.

    `marked` has the columns of `found_base`. Each text is counted once for chance, with its copies for disclosure.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = marked.select(F.col(key).alias("key"), F.col(base).alias("base"), body.alias("text"))
    copies = stored(docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "copies")
    size = copies.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("texts")).first()
    total, texts = float(size["docs"] or 0), size["texts"]
    # A text that occurs n times adds 1/n each time to the texts of its terms.
    repeated = pin(copies.where(F.col("n") > 1).select("key", (1 / F.col("n")).alias("share")))
    terms = stored(
        docs.select("key", terms_of(F.col("text"), F.col("base")).alias("terms")).join(repeated, "key", "left")
        .select(F.explode("terms").alias("term"), F.coalesce("share", F.lit(1.0)).alias("share"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_term"), F.round(F.sum("share")).cast("long").alias("k_term")),
        "terms",
    )
    n_terms = terms.count()
    least = least_texts(texts, n_terms)
    # One row for each text: its copies are counted in `n`.
    named = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], s["value"])))
    held = stored(
        docs.where(F.size("base") > 0).select("key", named.alias("entities"), terms_of(F.col("text"), F.col("base")).alias("terms"))
        .groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n")),
        "entities",
    )
    # Rarer entities and pairs cannot pass the test of chance below.
    entities = pin(
        held.select("n", F.explode("entities").alias("entity")).groupBy("entity")
        .agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("k_entity")).where(F.col("k_entity") >= least)
    )
    within = held.select("key", F.explode("entities").alias("entity")).join(entities.select("entity"), "entity")
    within = within.groupBy("key").agg(F.collect_list("entity").alias("entities"))
    pairs = held.select("key", "n", "terms").join(within, "key").select("n", "entities", F.explode("terms").alias("term")).select(
        "n", "term", F.explode("entities").alias("entity")
    ).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("k_both")).where(F.col("k_both") >= least)
    rated = stored(pairs, "pairs").join(entities, "entity").join(terms, "term")
    pmi = F.log2(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    chance = log_chance(F.col("k_both"), F.col("k_term"), F.col("k_entity"), texts)
    rated = rated.where(chance + math.log(max(n_terms, 1)) <= math.log(CHANCE)).withColumn("disclosure", F.when(
        F.col("n_entity") < total, pmi / F.log2(total / F.col("n_entity"))).otherwise(0.0))
    removed = F.col("disclosure") >= REMOVE
    lists = stored(
        rated.where(F.col("disclosure") >= GENERALISE).groupBy("entity").agg(
            F.collect_list(F.when(~removed, F.col("term"))).alias("general"), F.collect_list(F.when(removed, F.col("term"))).alias("removed")),
        "disclosing",
    )
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return held.select("key", F.explode("entities").alias("entity")).join(lists, "entity").groupBy("key").agg(
        every("general"), every("removed"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, text: str = "text", name: str = "personal") -> DataFrame:
    """All rows and columns of `docs`, and a struct `name`: base (pattern spans) and spans (with terms).

    A null or empty text has no spans. Repeated rows get the same spans. Spans may overlap across kinds.
    """
    key, base, general, removed = (fresh(docs, n) for n in ("text_key", "base_spans", "general_terms", "removed_terms"))
    marked = found_base(docs, text, key, base)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    marked = stored(marked.select(*keep, key, base), "base")
    extra = revealing_terms(marked, text, key, base).withColumnsRenamed({"key": key, "general": general, "removed": removed})
    spans = with_terms(F.col(base), F.coalesce(F.col(text), F.lit("")), F.col(general), F.col(removed))
    return marked.join(extra, key, "left").select(
        *keep, F.struct(F.col(base).alias("base"), spans.alias("spans")).alias(name)
    )


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[WORD]", "remove": ""}


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's label; spans that overlap become one."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return rebuilt(text, spans, lambda s, at: F.when(s["start"] >= at, label[s["kind"]]).otherwise(F.lit("")))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of `docs`; personal data and the terms that disclose it are masked in `text`.

    Texts without pattern matches, null ones too, stay as they are and are not shuffled.
    """
    key, base, general, removed = (fresh(docs, n) for n in ("text_key", "base_spans", "general_terms", "removed_terms"))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    marked = found_base(docs, text, key, base)
    clean = marked.where(F.size(base) == 0).select(*keep)
    extra = revealing_terms(marked, text, key, base).withColumnsRenamed({"key": key, "general": general, "removed": removed})
    spans = with_terms(F.col(base), F.col(text), F.col(general), F.col(removed))
    changed = marked.where(F.size(base) > 0).join(extra, key, "left").withColumn(text, masked(F.col(text), spans))
    return clean.unionByName(changed.select(*keep))
