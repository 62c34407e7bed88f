from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.functions import clean, terms, text
from quarrylens.operators.sections import caption_object, caption_of_line, caption_values, split_chunks, split_text


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(make(F.col("x")).alias("y")).first()["y"]


def test_squash_and_rank_text(spark):
    assert one(spark, "  a \t b\n\nc ", text.squash) == "a b c"
    assert one(spark, "Non-precious/ALLOY_x — y", text.rank_text) == "non precious alloy x y"
    assert one(spark, None, text.squash) is None


def test_occurrences(spark):
    assert one(spark, "aaaa", lambda c: text.occurrences(c, F.lit("aa"))) == 2
    assert one(spark, "abc", lambda c: text.occurrences(c, F.lit(""))) == 0
    assert one(spark, "a b a", lambda c: text.total_occurrences(c, F.array(F.lit("a"), F.lit("b")))) == 3


def test_query_terms(spark):
    q = 'Compare "MOF catalyst" 82% DOI 10.1000/paper-a 氧空位x'
    found = one(spark, q, terms.query_terms)
    assert {"Compare", "MOF", "10.1000/paper-a", "MOF catalyst", "氧空位"} <= set(found)
    assert len({t.lower() for t in found}) == len(found)
    assert one(spark, "", terms.query_terms) == []
    assert one(spark, "?!", terms.query_terms) == ["?!"]
    df = spark.createDataFrame([(q,), ("",), (None,), ("a A b",)], "q string")
    got = [r.terms for r in terms.with_terms(df, "q").collect()]
    assert got == [found, [], [], one(spark, "a A b", terms.query_terms)]


def test_intents_and_rank_terms(spark):
    make = lambda *w: F.array(*map(F.lit, w))
    assert one(spark, "", lambda _: terms.fact_intents(make("methods", "figure"))) == ["method", "figure_caption"]
    assert one(spark, "", lambda _: terms.fact_intents(make("metadata"))) == []
    assert one(spark, "", lambda _: terms.rank_terms(make("MOF", "the", "alloys"))) == [
        "mof", "metal organic framework", "metal organic frameworks", "mofs", "alloys", "alloy",
    ]


def test_cleaning(spark):
    raw = "Advertisement\r\nReal metrics stay here.\n\n\n\n## Metrics (12)\nA  b[url]c\nDownload: Download high-res image (12KB)\n"
    assert one(spark, raw, clean.clean_text) == "Real metrics stay here.\n\nA b c"
    assert one(spark, "Citations 12", lambda c: clean.is_noise_line(c, "ACS Catalysis")) is True
    assert one(spark, "Citations 12", clean.is_noise_line) is False
    assert one(spark, "## References:", clean.is_reference_title) is True
    assert one(spark, "---\na: b\n---\nbody", clean.without_frontmatter) == "body"
    assert one(spark, "---\na: b\nbody", clean.without_frontmatter) == "---\na: b\nbody"


def test_captions(spark):
    assert one(spark, "**Fig. S2a,b.** Rates", caption_of_line).asDict() == {"label": "Figure S2a,b", "text": "Rates"}
    assert one(spark, "图 3：说明", caption_of_line)["label"] == "图 3"
    assert one(spark, "Figures are below", caption_of_line) is None

    def parts(label):
        c = one(spark, label, caption_object)
        return None if c is None else (c.object_type, c.object_label, list(c.panels), list(c.targets))

    assert parts("Figure S1a,b") == ("figure", "S1", ["a", "b"], ["Figure S1a", "Figure S1b"])
    assert parts("Figure 2A-C") == ("figure", "2", ["A", "B", "C"], ["Figure 2A", "Figure 2B", "Figure 2C"])
    assert parts("Table S2-S4") == ("table", "S2-S4", [], ["Table S2", "Table S3", "Table S4"])
    assert parts("Table 7") == ("table", "7", [], ["Table 7"])
    assert parts("Scheme 7") is None
    v = one(spark, "a current density near 3.5 mA and 45 h, conversion of 82%", caption_values)
    assert "82%" in v.measurements and "conversion of 82%" in v.named


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.\n。 ", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_split_text_covers_everything(value, size, overlap):
    pieces = split_text(value, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    kept = [c for c in value if not c.isspace()]
    at = 0
    for piece in pieces:  # every character that is no blank occurs in order
        for c in piece:
            if at < len(kept) and c == kept[at]:
                at += 1
    assert at == len(kept) or overlap > 0


def test_split_chunks_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "x" * 25)], "k bigint, t string")
    assert rows(split_chunks(df, "k", "t", 10, 2)) == [(3, 0, "x" * 10), (3, 1, "x" * 10), (3, 2, "x" * 9)]
    assert rows(split_chunks(df.limit(0), "k", "t")) == []
