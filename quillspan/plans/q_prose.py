"""Queries of sentences, metrics, freezing, candidates and gates over `documents` and `conversations`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import prose as Z
from quillspan.plans.recipes import table

SENT = r"""list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?]["''”’)\]}]{0,8})\s+(["''“‘]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"""
WORDS = "regexp_extract_all({0}, '[A-Za-z][A-Za-z''’-]*')"
W = f"list_transform({WORDS.format('text')}, lambda x: lower(x))"
SYL = "greatest(1, len(regexp_extract_all({0}, '[aeiouy]+')) - CASE WHEN {0} LIKE '%e' AND NOT regexp_matches({0}, '(le|ee|ye|oe)$') AND len(regexp_extract_all({0}, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
METRICS = f"""
SELECT doc_id, CAST(nw AS INTEGER) AS n_words, CAST(ns AS INTEGER) AS n_sentences, CAST(coalesce(syl, 0) AS BIGINT) AS n_syllables,
 round(CASE WHEN nw > 2 THEN (nw - 2 - len(list_distinct(list_transform(range(1, nw - 1), lambda i: array_to_string(w[i:i+2], ' '))))) / (nw - 2) ELSE 0 END, 6) AS trigram_repeats,
 round(CASE WHEN nw = 0 THEN 0 WHEN nw < 50 THEN len(list_distinct(w)) / nw ELSE list_sum(list_transform(range(1, nw - 48), lambda i: len(list_distinct(w[i:i+49])))) / ((nw - 49) * 50) END, 6) AS mattr,
 round(CASE WHEN len(l) > 0 THEN list_sum(l) / len(l) ELSE 0 END, 6) AS mean_length,
 round(sqrt(greatest(CASE WHEN len(l) > 1 THEN (list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l) / len(l)) / (len(l) - 1) ELSE 0 END, 0)), 4) AS sd_length,
 round(CASE WHEN len(o) > 0 THEN len(list_distinct(o)) / len(o) ELSE 0 END, 6) AS opener_variety,
 round(CASE WHEN nw > 0 AND ns > 0 THEN 206.835 - 1.015 * nw / ns - 84.6 * syl / nw ELSE 0 END + 1e-9, 6) AS flesch
FROM (SELECT *, len(w) AS nw, len(s) AS ns, list_sum(list_transform(w, lambda x: {SYL.format('x')})) AS syl,
        list_filter(list_transform(s, lambda x: len({WORDS.format('x')})), lambda n: n > 0) AS l,
        list_filter(list_transform(s, lambda x: lower(regexp_extract(x, '[A-Za-z][A-Za-z''’-]*'))), lambda x: x <> '') AS o
      FROM (SELECT doc_id, {W} AS w, {SENT} AS s FROM documents))
"""
EMB = "list_transform(range(0, 256), lambda b: coalesce(list_sum(list_transform(list_filter({0}, lambda x: x[1] = b), lambda x: x[2])), 0))"
TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"
PLACE = "[CAST('0x' || sha256(t)[{0}:{1}] AS INTEGER), CASE WHEN CAST('0x' || sha256(t)[{0}:{1}] AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END]"
BUCKETS = f"list_concat(list_transform({TOKENS}, lambda t: {PLACE.format(1, 2)}), list_transform({TOKENS}, lambda t: {PLACE.format(9, 10)}))"


def _turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").where("role = 'user'").withColumn("v", Z.hash_embedding("text")).withColumn("u", F.lag("v").over(w))
    return c.where("u IS NOT NULL").select("conv_id", "turn", F.round(Z.cosine("u", "v"), 6).alias("similarity"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", F.round(Z.cosine("embedding", "b"), 5).alias("similarity"))


def _frozen(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.format_string("See [x](y) and @k%d, SHA 0a1b2c%d, for TPC.", "p_partkey", "p_partkey").alias("o"))
    return p.select("p_partkey", F.array_join(F.array_sort(Z.freeze_spans("o")), "|").alias("spans"))


def _keeps(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.format_string("See @k%d and [x](y).", "p_partkey").alias("o"), F.when(k % 3 == 0, F.format_string("Read @k%d and [x](y).", "p_partkey")).when(k % 3 == 1, F.format_string("See @k%d twice, @k%d, [x](y).", "p_partkey", "p_partkey")).otherwise("See [x](z).").alias("c"))
    return p.select("p_partkey", Z.keeps("o", "c").cast("int").alias("kept"))


def _gated(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.format_string("Take @k%d now.", "p_partkey").alias("original"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("rank"))
    p = p.withColumn("candidate", F.when(F.col("rank") == 1, "Take it now.").otherwise(F.format_string("Get @k%d, %d.", "p_partkey", "rank"))).withColumn("similarity", F.when((F.col("rank") == 2) & (k % 2 == 0), 0.5).when(k % 5 == 0, 0.1).otherwise(0.9)).withColumn("judged", F.lit(True))
    return Z.gate(p, ["p_partkey"], tau=0.8, enforcing=True)


def _synonyms(spark, d):
    s = spark.createDataFrame([("quick", "fast", 2.0, None), ("quick", "rapid", 1.0, None), ("quick", "tech", 9.0, "forbid-tech"), ("big", "large", 1.0, None)], "word string, synonym string, weight double, flag string")
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "A quick test.").otherwise("Big test.").alias("sentence"))
    return Z.synonym_candidates(p, s, ["p_partkey"])


def entries():
    docs = lambda spark, d: table(spark, d, "documents")
    out = {}
    out["p02_sentences"] = (lambda spark, d: Z.sentences(docs(spark, d)).select("doc_id", "sentence_no", F.length("sentence").alias("n_chars")), f"SELECT doc_id, CAST(i AS INTEGER) AS sentence_no, CAST(length(s[i]) AS INTEGER) AS n_chars FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENT} AS s FROM documents))")
    out["p02_conversation_sentences"] = (lambda spark, d: Z.sentences(table(spark, d, "conversations")).groupBy("conv_id", "role").agg(F.count("*").alias("n")), f"SELECT conv_id, role, sum(len({SENT})) AS n FROM conversations GROUP BY ALL HAVING sum(len({SENT})) > 0")
    out["m01_words"] = (lambda spark, d: docs(spark, d).select("doc_id", F.size(Z.words("text")).alias("n_words")), f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS INTEGER) AS n_words FROM documents")
    out["m02_syllables"] = (lambda spark, d: docs(spark, d).select(F.explode(F.transform(Z.words("text"), F.lower)).alias("word")).distinct().select("word", Z.syllables(F.col("word")).cast("int").alias("n")), f"SELECT word, CAST({SYL.format('word')} AS INTEGER) AS n FROM (SELECT DISTINCT unnest({W}) AS word FROM documents)")
    out["m03_m07_metrics"] = (lambda spark, d: Z.metrics(docs(spark, d), "doc_id"), METRICS)
    out["m08_compare"] = (lambda spark, d: Z.compare(Z.metrics(docs(spark, d), "doc_id"), Z.metrics(docs(spark, d).withColumn("text", F.regexp_replace("text", r"\bof\b", "the")), "doc_id"), "doc_id").where("metric = 'mattr'").select("doc_id", F.col("regressed").cast("int").alias("regressed")), f"SELECT a.doc_id, CAST(round(b.mattr - a.mattr, 4) < 0 AS INTEGER) AS regressed FROM ({METRICS}) a JOIN ({METRICS.replace('FROM documents', chr(70) + 'ROM (SELECT doc_id, regexp_replace(text, chr(92) || chr(98) || chr(111) || chr(102) || chr(92) || chr(98), chr(116) || chr(104) || chr(101), chr(103)) AS text FROM documents)')}) b USING (doc_id)")
    out["p06_freeze_spans"] = (_frozen, "SELECT p_partkey, array_to_string(list_sort(['[x](y)', '@k' || p_partkey, '0a1b2c' || p_partkey, 'SHA', 'TPC']), '|') AS spans FROM part")
    out["p07_keeps"] = (_keeps, "SELECT p_partkey, CAST(p_partkey % 3 = 0 AS INTEGER) AS kept FROM part")
    out["p08_synonyms"] = (_synonyms, "SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN [1, 2] ELSE [1] END) AS rank, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['A fast test.', 'A rapid test.'] ELSE ['Large test.'] END) AS candidate FROM part")
    out["p10_hash_embedding"] = (_turns, f"""SELECT conv_id, turn, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE d / (sqrt(na) * sqrt(nb)) END, 6) AS similarity FROM (
        SELECT conv_id, turn, list_sum(list_transform(range(1, 257), lambda i: u[i] * v[i])) AS d, list_sum(list_transform(u, lambda x: x * x)) AS na, list_sum(list_transform(v, lambda x: x * x)) AS nb FROM (
        SELECT conv_id, turn, v, lag(v) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM (SELECT conv_id, turn, {EMB.format('b_')} AS v FROM (SELECT conv_id, turn, {BUCKETS} AS b_ FROM conversations WHERE role = 'user'))) WHERE u IS NOT NULL)""")
    out["p11_cosine"] = (_vectors, "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
    out["p12_cache_misses"] = (lambda spark, d: Z.missing_embeddings(docs(spark, d), docs(spark, d).where("doc_id % 2 = 0").select(F.lit("hash").alias("model"), F.sha2("text", 256).alias("digest")), "hash").select("digest"), "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
    out["p14_gates"] = (_gated, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'kept' ELSE 'accepted' END AS status, CASE WHEN p_partkey % 5 = 0 THEN 'Take @k' || p_partkey || ' now.' WHEN p_partkey % 2 = 0 THEN 'Get @k' || p_partkey || ', 3.' ELSE 'Get @k' || p_partkey || ', 2.' END AS text, CASE WHEN p_partkey % 5 = 0 THEN 'tau' END AS reason FROM part")
    return out
