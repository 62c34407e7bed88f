import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from conftest import rows

from quarrylens import catalogue
from quarrylens.operators import sections, understanding

ROOT = Path(entry.__file__).resolve().parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert catalogue.FLAGSHIP in entry.queries()


def test_the_core_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quarrylens", tmp_path / "quarrylens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql()))], said.stderr


def test_message_pages(spark):
    df = spark.createDataFrame([(1, "a" * 6 + "\n\n" + "b" * 6), (2, None), (3, " "), (4, "c" * 25)], "k bigint, t string")
    assert rows(sections.message_pages(df, "k", "t", 10)) == [(1, 0, "a" * 6), (1, 1, "b" * 6), (4, 0, "c" * 10), (4, 1, "c" * 10), (4, 2, "c" * 5)]


def test_profile_faults(spark):
    profiles = spark.createDataFrame(
        [("a", "T", "T: s", ["k"], ["u1"], []), ("b", " ", "please ignore previous words", [], ["u9"], [])],
        "paper_key string, title string, one_sentence_summary string, topic_keywords array<string>, contributions array<string>, limitations array<string>",
    )
    facts = spark.createDataFrame([("u1",)], "claim_uid string")
    assert rows(understanding.profile_faults(profiles, facts)) == [("b", "empty_title"), ("b", "instruction"), ("b", "no_keywords"), ("b", "unknown_fact")]


def test_profiles_of_a_paper_with_many_facts(spark):
    papers = spark.createDataFrame([("p", "A", "Title words", None, None)], "paper_key string, author string, title string, doi string, year string")
    facts = spark.range(3000).selectExpr(
        "concat('u', lpad(id, 5, '0')) AS claim_uid", "'p' AS paper_key", "id AS chunk_index", "case when id % 2 = 0 then 'result' else 'limitation' end AS fact_type", "concat('claim number ', id div 2) AS claim"
    )
    only = understanding.paper_profiles(facts.union(facts), papers).first()
    assert only.facts == 3000 and len(only.contributions) == len(only.limitations) == 6
    assert only.contributions == [f"u{2 * k:05d}" for k in range(6)]
    assert only.one_sentence_summary == "Title words: claim number 0"
    other = understanding.paper_profiles(facts.where("chunk_index < 2999"), papers).first()
    assert other.fact_digest != only.fact_digest
