"""Markdown documents built from the relational tables, whose right answers follow from those tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc(doc_id, path, text):
    return [doc_id.cast("bigint").alias("doc_id"), path.alias("path"), text.alias("text")]


def joined(parts: str, order: str = "o"):
    """The collected pieces in order, one after the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, parts))), lambda x: x[parts]), "")


def outline(spark, sf_dir) -> DataFrame:
    """Region documents: a title, and a section with a sentence for each nation."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    n = n.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("o"), F.format_string("## %s\n\nNation %d.\n\n", "n_name", "n_nationkey").alias("p"))
    n = n.groupBy("k").agg(joined("p").alias("body"))
    out = r.join(n, r.r_regionkey == n.k, "left")
    return out.select(*_doc(F.col("r_regionkey"), F.format_string("region-%d.md", "r_regionkey"), F.concat(F.format_string("# %s\n\nRegion %d.\n\n", "r_name", "r_regionkey"), F.coalesce("body", F.lit("")))))


def repeated(spark, sf_dir) -> DataFrame:
    """Region documents with a section Summary after each nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("o"), F.format_string("## %s\n\nText.\n\n## Summary\n\nText.\n\n", "n_name").alias("p"))
    n = n.groupBy("k").agg(joined("p").alias("body"))
    return n.select(*_doc(F.col("k"), F.format_string("region-%d.md", "k"), F.col("body")))


def _suppliers(spark, sf_dir, piece):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("o"), piece.alias("p"))
    s = s.groupBy("k").agg(joined("p").alias("body"), F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("k"), "left")


def lists(spark, sf_dir) -> DataFrame:
    """Nation documents: a bulleted list of suppliers."""
    n = _suppliers(spark, sf_dir, F.format_string("- %s\n", "s_name"))
    return n.select(*_doc(F.col("n_nationkey"), F.format_string("nation-%d.md", "n_nationkey"), F.concat(F.lit("# "), "n_name", F.lit("\n\n"), F.coalesce("body", F.lit("")))))


def tables(spark, sf_dir) -> DataFrame:
    """Nation documents: a pipe table with a row for each supplier."""
    n = _suppliers(spark, sf_dir, F.format_string("| %d | %s |\n", "s_suppkey", "s_name"))
    return n.select(*_doc(F.col("n_nationkey"), F.format_string("nation-%d.md", "n_nationkey"), F.concat(F.lit("| key | name |\n|-----|------|\n"), F.coalesce("body", F.lit("")))))


def fences(spark, sf_dir) -> DataFrame:
    """Customer documents: a fence with or without a language, closed unless key % 3 = 0."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = F.concat(F.lit("# "), "c_name", F.lit("\n\n"), F.when(k % 2 == 0, "```sql\n").otherwise("```\n"), F.lit("SELECT 1\n"), F.when(k % 3 == 0, "").otherwise("```\n"))
    return c.select(*_doc(k, F.format_string("customer-%d.md", "c_custkey"), text))


def links(spark, sf_dir) -> DataFrame:
    """Nation documents with one link to their own title, which is right for even keys."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    target = F.when(k % 2 == 0, F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).otherwise(F.format_string("no-such-%d", "n_nationkey"))
    return n.select(*_doc(k, F.format_string("nation-%d.md", "n_nationkey"), F.concat(F.lit("# "), "n_name", F.lit("\n\nSee [region](#"), target, F.lit(").\n"))))


def cross_links(spark, sf_dir) -> DataFrame:
    """Region documents that link to a document and anchor of every nation, and those documents where key % 5 > 0; anchors are wrong where key % 7 = 1."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    anchor = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.when(k % 7 == 1, "-gone").otherwise(""))
    p = F.concat(F.lit("[n](nation-"), k.cast("string"), F.lit(".md#"), anchor, F.lit(")\n"))
    r = n.select(F.col("n_regionkey").alias("k"), k.alias("o"), p.alias("p")).groupBy("k").agg(joined("p").alias("body"))
    r = r.select(*_doc(F.col("k") + 1000, F.format_string("region-%d.md", "k"), F.col("body")))
    own = n.where(k % 5 > 0).select(*_doc(k, F.format_string("nation-%d.md", "n_nationkey"), F.concat(F.lit("# "), "n_name", F.lit("\n"))))
    return r.unionByName(own)


def references(spark, sf_dir) -> DataFrame:
    """Nation documents: a reference link for each supplier with an even key, a definition for each with a positive balance."""
    even = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("See [x][s%d].\n\n", "s_suppkey")).otherwise("")
    made = F.when(F.col("s_acctbal") > 0, F.format_string("[s%d]: http://h/%d\n\n", "s_suppkey", "s_suppkey")).otherwise("")
    n = _suppliers(spark, sf_dir, F.concat(even, made))
    return n.select(*_doc(F.col("n_nationkey"), F.format_string("nation-%d.md", "n_nationkey"), F.concat(F.lit("# "), "n_name", F.lit("\n\n"), F.coalesce("body", F.lit("")))))


def notes(spark, sf_dir) -> DataFrame:
    """Customer documents with notes: used twice if key % 7 = 0, undefined if key % 11 = 0, unused if key % 13 = 0."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    ref = F.format_string("Text[^n%d].\n\n", "c_custkey")
    used = F.when(k % 13 == 0, "Text.\n\n").when(k % 7 == 0, F.concat(ref, ref)).otherwise(ref)
    text = F.concat(used, F.when(k % 11 == 0, "").otherwise(F.format_string("[^n%d]: Note.\n", "c_custkey")))
    return c.select(*_doc(k, F.format_string("customer-%d.md", "c_custkey"), text))


def skips(spark, sf_dir) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return n.select(*_doc(k, F.format_string("nation-%d.md", "n_nationkey"), F.concat(F.lit("# "), "n_name", F.when(k % 4 == 0, "\n\n### Deep\n").otherwise("\n\n## Next\n"))))


def terms(spark, sf_dir) -> DataFrame:
    """Supplier documents: a forbidden spelling in prose for odd keys, and for all in code, a fence and a table."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    word = F.when(k % 2 == 1, "data base").otherwise("database")
    text = F.concat(F.lit("# "), "s_name", F.lit("\n\nThe "), word, F.lit(" is here and `data base` is code.\n\n```txt\ndata base\n```\n\n| data base |\n|---|\n"), F.when(k % 3 == 0, "\nAn API (application interface) follows. An API.\n").otherwise("\nAn API follows.\n"))
    return s.select(*_doc(k, F.format_string("supplier-%d.md", "s_suppkey"), text))


def citations(spark, sf_dir) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(F.when(k % 2 == 0, F.format_string("As [@p%d] says.\n", "p_partkey")).otherwise(F.format_string("So @p%d says, mail a@b.c.\n", "p_partkey")))
    return p.select(*_doc(k, F.format_string("part-%d.md", "p_partkey"), text))


def raw_html(spark, sf_dir) -> DataFrame:
    """Nation documents with one raw block, of a kind by key % 5; scripts stay open where key % 2 = 1."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    block = F.when(k % 5 == 0, "<!-- a\nb -->").when(k % 5 == 1, "<![CDATA[\nx\n]]>").when(k % 5 == 2, "<?php x ?>").when(k % 5 == 3, "<!DOCTYPE html>").otherwise(F.when(k % 2 == 1, "<script>\nx\n").otherwise("<script>\nx\n</script>"))
    return n.select(*_doc(k, F.format_string("nation-%d.md", "n_nationkey"), F.concat(F.lit("Text.\n\n"), block, F.lit("\n\nMore.\n"))))


def front_matter(spark, sf_dir) -> DataFrame:
    """Customer documents with a title where key % 2 = 0, a wrong type where key % 3 = 0 and an unknown key where key % 5 = 0; no block where key % 7 = 0."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    fm = F.concat(F.lit("---\n"), F.when(k % 2 == 0, F.concat(F.lit("title: "), "c_name", F.lit("\n"))).otherwise(""), F.when(k % 3 == 0, "count: many\n").otherwise("count: 3\n"), F.when(k % 5 == 0, "extra: 1\n").otherwise(""), F.lit("---\n"))
    return c.select(*_doc(k, F.format_string("customer-%d.md", "c_custkey"), F.concat(F.when(k % 7 == 0, "").otherwise(fm), F.lit("Body.\n"))))


def dirty(spark, sf_dir) -> DataFrame:
    """Supplier documents with defects by key, for the rewrite passes."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    head = F.when(k % 2 == 0, F.concat(F.lit("#"), "s_name")).otherwise(F.concat(F.lit("# "), "s_name"))
    lst = F.when(k % 3 == 0, "Intro:\n- one\n- two\n").otherwise("Intro:\n\n- one\n- two\n")
    quote = F.when(k % 5 == 0, ">quoted\n").otherwise("> quoted\n")
    tail = F.when(k % 7 == 0, "End.   \n").otherwise("End.\n")
    return s.select(*_doc(k, F.format_string("supplier-%d.md", "s_suppkey"), F.concat(head, F.lit("\n\n"), lst, F.lit("\n"), quote, F.lit("\n"), tail)))


def edits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Supplier documents and the edits that rename the supplier in each."""
    s = table(spark, sf_dir, "supplier")
    docs = s.select(*_doc(F.col("s_suppkey"), F.format_string("supplier-%d.md", "s_suppkey"), F.concat(F.lit("Name: "), "s_name", F.lit(".\nKey.\n"))))
    e = s.select(F.col("s_suppkey").alias("doc_id"), F.lit(6).cast("bigint").alias("start"), (F.length("s_name") + 6).cast("bigint").alias("end"), F.format_string("S%d", "s_suppkey").alias("replacement"), F.when(F.col("s_suppkey") % 10 == 0, "stale").otherwise(F.col("s_name")).alias("expect"), F.lit("rename").alias("rule"), F.lit("fix").alias("severity"), F.lit("high").alias("confidence"))
    return docs, e


#: Lines as authors spell them; predicates are also run over these.
SPELLED = [
    "mix. text", "cd) text", "xl. item", "did. text", "(iv)\tx", "@ключ. text", "(@a-b) text", "@. anonymous", "A.  two", "A.", "A.\tx", "I. x", "I.  x", "IV. y", "XX. y", "V.", "iii)", "-\tx", " \t- x", "10)\t\ty", "#.   z", "*", "+  ",
    "p.  9", "p. 9", "p) 9", "q. word", "(Q) word", "VIV. loose", "xxxi. past thirty", "xxx. thirty",
    "", "   ", "\t", "# T", "#T", "####### x", "    # x", "- a", "* a", "+ a", "-", "  - b", "-x", "1. a", "1) a", "(1) a", "#. a", "(#) x", "1.x", "12.", "iv. x", "IV. x", "IV.  x", "a. x", "A. x", "A.  x", "(a) x", "p. 9", "did. x",
    "@lab. x", "(@lab) x", "(@) x", "@x", "```", "```py", "~~~ x", "``` `a`", "--- ", "---", "...", "----", "  cont", "| a | b |", "+---+---+", "+:--+", "-- --", "--- --- ---", "|---|---|", "a | b", "> q", "     > q", ">q", "===", "==", "--", "= =",
    "[a]: http://x", "[^n]: note", "   [a b]:x", "[]: x", "  'title'", "  \"t\"", "  (t)", "* * *", "___", "_ _ _", "-*-", "text", "text  ", "text\t", "<!-- c -->", "<!-- c", "<![CDATA[ x", "<?php", "<!DOCTYPE html>", "<script>", "<SCRIPT src=x>", "<scripty>", "<pre>x</pre>", "</pre>", "A. Smith", "1.  two", "\t- tab", "é. x", "mix. x",
]


def spelled(spark, sf_dir) -> DataFrame:
    """The spelled lines, and all lines of `documents`."""
    from quillspan.operators.lines import lines

    own = spark.createDataFrame([(-1, i + 1, s) for i, s in enumerate(SPELLED)], "doc_id bigint, line_no int, text string")
    return own.unionByName(lines(table(spark, sf_dir, "documents")))


def spelled_sql() -> str:
    values = ", ".join(f"(-1, {i + 1}, {quote(s)})" for i, s in enumerate(SPELLED))
    return f"(SELECT * FROM (VALUES {values}) v(doc_id, line_no, text) UNION ALL {LINES_SQL})"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if "\t" not in s else "('" + s.replace("'", "''").replace("\t", "' || chr(9) || '") + "')"


LINES_SQL = (
    "SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_replace(parts[i], chr(13) || '+$', '') AS text FROM "
    "(SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM "
    "(SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts FROM documents WHERE text <> ''))"
)
