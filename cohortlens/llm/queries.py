"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    ann,
    conversations,
    decontaminate,
    language_id,
    near_dup,
    ngram_lm,
    packing,
    periodic_runs,
    pii,
    quality,
    robust_rules,
    toxicity,
    wrappers,
)
from cohortlens.llm.common import held_out, labelled_rows, remainder, table
from cohortlens.session import stored

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of near duplicates, named by the smallest doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs).select("doc_id", "class_id")


# All pairs that share a shingle, their exact Jaccard index, and the closure of the links.
ORACLES["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE texts AS (
    SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text
), words AS (
    SELECT id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), sh AS (
    SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
    FROM words WHERE len(w) > 0
), n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
both_have AS (
    SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM both_have JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (
    SELECT id, id FROM texts UNION SELECT reach.id, ways.b FROM reach JOIN ways ON reach.r = ways.a
), class AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id
FROM documents d LEFT JOIN texts t ON d.text = t.text LEFT JOIN class c ON c.id = t.id
"""


@query
def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels of ids with crc32 mod 3 other than 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(quality_rows(docs, spark, sf_dir))
    return quality.score(docs, model).select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def quality_rows(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    some = docs.select("doc_id", "text").where(~held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    return labelled_rows(some, labels, "quality", quality.FIT_ROWS, by_class=True).select("text", "quality")


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.report(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "leaks.*")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op6_benchmark_decontamination"] = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM iw WHERE len(w) > 0)
), occ AS (
    SELECT doc_id, i, d.n, item_id
    FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) d
    JOIN win ON win.n = d.n AND win.s = d.s
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: pattern spans, and the terms that disclose it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs.select("doc_id", "text")).select("doc_id", "personal.*")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces, packed best-fit decreasing into sequences of 2048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, tokenizer_file(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by the n-gram model of those with crc32 mod 7 other than 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_lm.train(docs.where(~held_out("doc_id", 7, 2)))
    return ngram_lm.score(docs, model).select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "lm.*")


@query
def op10_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those with crc32 mod 3 other than 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~held_out("doc_id", 3, 1)))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "language.*"
    )


@query
def op9_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels of ids with crc32 mod 5 other than 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    some = docs.where(~held_out("doc_id", 5, 0))
    model = toxicity.fit(labelled_rows(some, labels, "toxic", toxicity.FIT_ROWS).select("text", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op8_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the wrapper of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.extract(pages).select(
        "page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars")
    )


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """The rows with the faults that op11 plants, and how often each row stands there as `copies`."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = remainder(F.concat(named("conv_id"), F.lit(":"), named("turn")), 20)
    rows = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    return conversations.repair(
        damaged_conversations(table(spark, sf_dir, "conversations")), copies=F.col("copies")
    )


# crc32 of an ASCII text, bit by bit.
_CRC32 = """xor(list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::UBIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
            lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""

# The least (cost, letters) of every prefix and state, row after row.
ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           CRC32 % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM source WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged)
), found AS (
    SELECT *, left(role, 1) AS initial,
           left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), moves(origin, added, role, target) AS (VALUES
    ('E', '', 's', 'S'), ('E', '', 'u', 'U'), ('S', '', 'u', 'U'), ('U', '', 'a', 'A'), ('A', '', 'u', 'U'),
    ('E', 'user', 'a', 'A'), ('S', 'user', 'a', 'A'), ('A', 'user', 'a', 'A'), ('U', 'assistant', 'u', 'U'),
    ('E', '', '', 'E'), ('S', '', '', 'S'), ('U', '', '', 'U'), ('A', '', '', 'A')
), paths(conv_id, i, state, best) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, 'E', {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM placed
    UNION ALL
    SELECT conv_id, i, state, min(best) FROM (
        SELECT f.conv_id, f.i, m.target AS state, {
            'cost': p.best.cost + CASE WHEN m.added = '' THEN 0 ELSE 2 END
                    + CASE l.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
                    + CASE WHEN l.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
            'audit': p.best.audit || CASE WHEN m.added = '' THEN '' ELSE 'I' END || l.letter,
            'lines': p.best.lines || CASE WHEN m.added = '' THEN []::VARCHAR[] ELSE [m.added || ':'] END
                     || CASE l.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text]
                        ELSE [CASE m.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] END} AS best
        FROM paths p JOIN found f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
        JOIN moves m ON m.origin = p.state
        JOIN (VALUES ('D'), ('K'), ('R')) l(letter) ON CASE l.letter WHEN 'D' THEN m.role = ''
            ELSE f.fault NOT IN ('blank', 'duplicate') AND m.role <> ''
                 AND CASE l.letter WHEN 'K' THEN m.role = f.initial ELSE m.role IN ('u', 'a') END END
    ) GROUP BY conv_id, i, state
), ends AS (
    SELECT p.conv_id, min(CASE WHEN state = 'U' THEN {'cost': best.cost + 2, 'audit': best.audit || 'I',
        'lines': best.lines || ['assistant:']} ELSE best END) AS best
    FROM paths p JOIN (SELECT conv_id, max(i) AS n FROM placed GROUP BY conv_id) c
        ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n
    WHERE state <> 'S' GROUP BY p.conv_id
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM found GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
""".replace("CRC32", _CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))


def looped_documents(docs: DataFrame) -> DataFrame:
    """The documents, every tenth with its words from some place on repeated in a loop, as op12 plants them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i)))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise("")

    # An array of one array: the words are computed once and have a name inside the lambda.
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    looped = F.get(F.transform(F.array(split), loop), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, looped).otherwise(F.col("text")))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, after planted loops."""
    docs = looped_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find(docs).select("doc_id", "periodic.*")
    order = lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    found = found.withColumn("top", F.array_max(F.transform("runs", order)))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.l").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(F.col("top.l") * 1000 / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Places of equal six-word windows by distance, and their unbroken stretches: a run has such a stretch at its period.
ORACLES["op12_periodic_runs"] = r"""
WITH plain AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           CRC32 AS h
    FROM documents
), placed AS (
    SELECT doc_id, w, len(w) AS n, (h % 10)::BIGINT AS r, (h // 10)::BIGINT AS g FROM plain
), docs AS (
    SELECT doc_id, n, CASE WHEN r = 0 AND n > 0 THEN list_transform(range(0, n), lambda i:
        w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w
    FROM placed
), six AS (
    SELECT doc_id, i, array_to_string(w[i : i + 5], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, n - 4)) AS i FROM docs WHERE n >= 12)
), pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i
), stretches AS (
    SELECT doc_id, q, min(i) - 1 AS a, max(i) + 5 + q AS e
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs)
    GROUP BY doc_id, q, part
), runs AS (
    SELECT doc_id, a, e - a AS n, min(q) AS q FROM stretches
    WHERE e - a >= 2 * q AND e - a >= 12 GROUP BY doc_id, a, e
), told AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || n || ',' || q || chr(10), '' ORDER BY a, q) AS listed,
           max({'n': n, 'a': -a, 'q': -q}) AS top
    FROM runs GROUP BY doc_id
), dropped AS (
    SELECT DISTINCT doc_id, unnest(range(a + q, a + n)) AS i FROM runs
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM docs) x
    WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.doc_id = x.doc_id AND d.i = x.i)
    GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-top.a)::BIGINT AS start, top.n::BIGINT AS length,
       (-top.q)::BIGINT AS period, ((1000 * top.n) // -top.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM docs d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""".replace("CRC32", _CRC32.format("doc_id::VARCHAR"))


@query
def op13_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rule, and the verdict by distance from the bulk of its language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # The counts are written once, without the texts, and read by every step of the fit.
    measured = stored(robust_rules.measure(docs).drop("text"), "measured")
    judged = robust_rules.judge(measured, robust_rules.fit(measured))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[f"statistics.{c}" for c in counts], "rules.*")
