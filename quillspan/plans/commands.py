"""The verbs of the engine as functions over DataFrames, and the flags of rewriting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import blocks, checks, links, prose, repair, rewrite, structure, terms

#: What each flag sets; profiles are taken first, whatever their place.
FLAGS: dict[str, dict] = {
    "--editorial": {"editorial": True}, "-w": {"whitespace": True}, "--chicago-punct": {"chicago_punct": True}, "--chicago-punct-2": {"chicago_punct2": True}, "--chicago-abbrev": {"chicago_abbrev": True},
    "--serial-comma-lint": {"serial_comma": True}, "--chicago-number-lint": {"number_style": True}, "--footnote-canonical": {"footnote": True}, "--heading-canonical": {"heading": True},
    "--fence-canonical": {"fence": True}, "--pandoc-safe-links": {"safe_links": True}, "--scrivener-repair": {"scrivener": True}, "--spaced-emdash": {"spaced_emdash": True}, "--normalize-nfc": {"nfc": True},
    "--no-arrow-aside": {"arrow_aside": False}, "--no-quote-punct": {"quote_punct": False}, "--no-required": {"required": False}, "--wrap": {"wrap": 78},
}
PROFILE_FLAGS = {"--canonical": "canonical", "--canonical-lint": "canonical", "--technical": "technical"}


def options_of(flags: Sequence[str]) -> rewrite.Options:
    """Options of rewriting; a flag that isn't known, or a width under 1, is refused."""
    o = rewrite.PROFILES["required"]
    for name in ("canonical", "technical"):  # the wider one wins
        if any(PROFILE_FLAGS.get(f) == name for f in flags):
            o = rewrite.PROFILES[name]
    for f in flags:
        if f in FLAGS:
            o = replace(o, **FLAGS[f])
        elif f.startswith("--wrap="):
            if not f[7:].isdigit() or not int(f[7:]):
                raise ValueError(f"{f} needs a width of at least 1")
            o = replace(o, wrap=int(f[7:]))
        elif f not in PROFILE_FLAGS:
            raise ValueError(f"unknown flag {f}")
    return o


def fix(docs: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """New texts with their hits; with --canonical-lint (doc_id, verdict), which writes nothing."""
    o = options_of(flags)
    return rewrite.canonical_gate(docs, o) if "--canonical-lint" in flags else rewrite.rewrite_documents(docs, o)


def query(docs: DataFrame, what: str = "records") -> DataFrame:
    rec = blocks.records(docs)
    made: dict[str, Callable[[], DataFrame]] = {"records": lambda: rec, "outline": lambda: structure.outline(rec), "stats": lambda: structure.stats(rec)}
    if what not in made:
        raise ValueError(f"nothing to ask as {what}")
    return made[what]()


def check_links(docs: DataFrame, files: DataFrame, verb: str = "check") -> DataFrame:
    """check gives findings, diff the edits that would be made, fix what is left of them in the repaired documents (`repair.repair_links` gives these too)."""
    if verb == "fix":
        return repair.repair_links(docs, files)[1]
    graph = links.Graph(blocks.records(docs))
    if verb == "diff":
        return repair.link_edits(graph, files)
    if verb != "check":
        raise ValueError(f"unknown verb {verb}")
    return graph.findings(files, docs.select("path"))


def check_terms(docs: DataFrame, glossary: Sequence[terms.Term], verb: str = "check") -> DataFrame:
    if verb == "fix":
        return repair.repair_terms(docs, glossary)[1]
    found = terms.forbidden(blocks.records(docs), docs, glossary)
    if verb not in ("check", "diff"):
        raise ValueError(f"unknown verb {verb}")
    return terms.term_edits(found) if verb == "diff" else found.select(*links.FINDING).unionByName(terms.undefined_acronyms(blocks.records(docs), docs, glossary).select(*links.FINDING))


def check(docs: DataFrame, files: DataFrame, dialect: bool = True, **settings) -> DataFrame:
    return checks.check(blocks.records(docs), docs, files, dialect=checks.dialect(docs) if dialect else None, **settings)


def vary(rows: DataFrame, synonyms: DataFrame, key: Sequence[str], k: int = 3, **gates) -> DataFrame:
    """Sentences (key.., sentence) with the first candidate that passes the gates."""
    c = prose.synonym_candidates(rows, synonyms, key, k=k).join(rows.select(*key, F.col("sentence").alias("original")), list(key))
    return prose.gate(c, key, **gates)


COMMANDS: dict[str, Callable[..., DataFrame]] = {"fix": fix, "query": query, "terms": check_terms, "links": check_links, "vary": vary, "check": check}


def run(command: str, *args, **settings) -> DataFrame:
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command}; there are {', '.join(sorted(COMMANDS))}")
    return COMMANDS[command](*args, **settings)
