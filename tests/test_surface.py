"""Sources, saving, settings, glossaries, commands and logs, on small folders."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspan.functions import sql
from quillspan.operators import blocks, checks, prose, rewrite, structure, terms
from quillspan.plans import commands
from quillspan.sources import readers


def test_folders_are_walked(spark, tmp_path):
    for name, text in {"a.md": "# A\n", "sub/b.md": "b", ".git/c.md": "no", "d.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = readers.markdown_files(spark, [str(tmp_path), str(tmp_path / "sub")])
    assert sorted(os.path.basename(r.path) for r in got.collect()) == ["a.md", "b.md"]


def test_records_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.md", "# T\n\nSee [x](y) and é.\n"), (2, "b.md", "")], "doc_id long, path string, text string")
    rec = blocks.records(docs)
    out = str(tmp_path / "rec")
    readers.write_records(rec, out)
    key = lambda r: (r.doc_id, r.seq)
    assert sorted(map(tuple, readers.read_records(spark, out).select(*rec.columns).collect())) == sorted(map(tuple, rec.collect()), key=lambda r: (r[0], r[2])) or sorted(readers.read_records(spark, out).collect(), key=key) == sorted(rec.collect(), key=key)
    with pytest.raises(Exception):
        readers.write_records(rec, out)
    for bad in ('{"schema":"other","doc_id":1}', "{"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception):
            readers.read_records(spark, str(tmp_path / "bad.json")).collect()


def test_save_is_whole_and_keeps_the_old(spark, tmp_path):
    path, d = str(tmp_path / "t"), spark.range(3)
    readers.save(d, path)
    readers.save(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(f"{path}.bak").count() == 3
    with pytest.raises(FileExistsError):
        readers.save(d, path)
    with pytest.raises(FileExistsError):
        readers.save(d, path, keep_previous=False)
    assert spark.read.parquet(path).count() == 5 and not os.path.exists(f"{path}.new")


def test_settings(tmp_path):
    f = tmp_path / "quillspan.toml"
    f.write_text('roots = ["a"]\nwarnings = true\n')
    (tmp_path / "sub").mkdir()
    assert readers.find_up(str(tmp_path / "sub"), ["quillspan.toml"]) == str(f)
    assert readers.load_config(str(f), warnings=False) == {"roots": ["a"], "warnings": False}
    f.write_text("other = 1\n")
    with pytest.raises(ValueError):
        readers.load_config(str(f))
    with pytest.raises(ValueError):
        readers.load_config(None, roots="a")
    assert readers.state_dir(str(tmp_path / "sub")) == str(tmp_path / ".quillspan")


REFUSED = [
    [{"aliases": ["x"]}], [{"term": "A"}, {"term": "a"}], [{"term": "A", "aliases": [""]}], [{"term": "A", "forbidden": [""]}], [{"term": "A", "exempt": [""]}], [{"term": "A", "aliases": ["B"], "forbidden": ["b"]}],
    [{"term": "A", "forbidden": ["a"]}], [{"term": "A", "expansion": "a"}],
]


@pytest.mark.parametrize("entries", REFUSED)
def test_glossaries_that_contradict_themselves(entries, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"terms": entries}))
    with pytest.raises(ValueError):
        readers.load_glossary(str(tmp_path / "g.json"))


def test_glossary_files(tmp_path):
    rows = [{"term": "database", "aliases": ["DB"], "forbidden": ["data base"], "exempt": ["*.tmp"]}]
    (tmp_path / "g.json").write_text(json.dumps(rows))
    got = readers.load_glossary(str(tmp_path / "g.json"))
    assert terms.freeze_list(got) == ["database", "DB"]
    pytest.importorskip("yaml")
    (tmp_path / "g.yaml").write_text("terms:\n  - term: database\n    aliases: [DB]\n    forbidden:\n      - data base\n    exempt: ['*.tmp']\n")
    assert readers.load_glossary(str(tmp_path / "g.yaml")) == got
    (tmp_path / "g.yaml").write_text("terms: [a, b]\n")
    with pytest.raises(ValueError):
        readers.load_glossary(str(tmp_path / "g.yaml"))


def test_exit_codes(spark):
    f = spark.createDataFrame([("warning",)], "severity string")
    assert checks.exit_code(f) == 0 and checks.exit_code(f, True) == 1 and checks.exit_code(f.select(F.lit("error").alias("severity"))) == 1 and checks.exit_code(None) == 2


def test_flags():
    assert commands.options_of(["--technical"]) == rewrite.TECHNICAL and commands.options_of(["--wrap=60", "--canonical"]).wrap == 60
    assert commands.options_of([]) == rewrite.Options() and not commands.options_of(["--no-required"]).required
    for bad in (["--what"], ["--wrap=0"], ["--wrap=x"]):
        with pytest.raises(ValueError):
            commands.options_of(bad)
    with pytest.raises(ValueError):
        commands.run("what")


def test_verbs(spark):
    docs = spark.createDataFrame([(1, "a.md", "# One\n\n[x](#ONE) and [y](#gone-for-good)\n\nA data base.\n")], "doc_id long, path string, text string")
    files = docs.select("path")
    glossary = terms.load([{"term": "database", "forbidden": ["data base"]}])
    assert commands.run("links", docs, files).count() == 2 and commands.run("links", docs, files, "diff").count() == 1 and commands.run("links", docs, files, "fix").count() == 1
    assert commands.run("terms", docs, glossary).count() == 1 and commands.run("terms", docs, glossary, "diff").count() == 1 and commands.run("terms", docs, glossary, "fix").count() == 0
    assert commands.run("query", docs, "outline").count() == 1 and commands.run("fix", docs, ["--canonical-lint"]).first().verdict == 0
    rows = docs.select("doc_id", F.lit("We utilize it.").alias("sentence"))
    assert commands.run("vary", rows, prose.seed_synonyms(spark), ["doc_id"]).first().text in ("We use it.", "We employ it.")
    assert prose.seed_synonyms(spark).distinct().count() == 28


def test_slug_of_a_text_is_the_column(spark):
    texts = ["A B", "  1. É—x", "", "a--b---c...d", "x  y\tz", "-a-", "§ 3", "Ünï_c.d-"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", structure.slug("t").alias("s"))
    assert all(sql.slug_text(r.t) == r.s for r in d.collect())


def test_decisions_are_logged(spark, tmp_path):
    rows = spark.createDataFrame([(1, "kept")], "doc_id long, status string")
    for run in ("r1", "r2", "r2"):
        got = prose.log_decisions(rows, run, str(tmp_path / "log"))
    assert got.count() == 2
    assert not prose.writable(False, False) and prose.writable(False, True) and prose.writable(False, False, force=True)
