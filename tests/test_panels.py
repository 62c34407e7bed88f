from conftest import rows

from quarrylens.operators import panels
from quarrylens.operators.sections import relation_paths


def test_panels(spark):
    text = "Figure 2. (a) Rate at 300 K with a conversion of 82%. (b,c) Spectra; (d-f) images. Heating in (a) leads to growth in (b); (b) is lower than (c). As caused by the loss in Figure 3, see Table S1."
    df = spark.createDataFrame([(1, text, ["Figure 2"]), (2, None, None), (3, "", None), (4, "No panels here.", [])], "k bigint, t string, own array<string>")
    found = panels.panel_segments(df, "k", "t").where("position < 3")
    assert [r[1] for r in rows(found, "position", "panel")] == ["a", "b", "c", "d", "e", "f"]
    first = found.where("panel = 'a'").first()
    assert first.named == ["conversion of 82%"] and "300 K" in first.measurements and first.conditions[0].startswith("at 300 K")
    relations = panels.panel_relations(df, "k", "t")
    assert rows(relations, "subject", "relation", "object") == [("a", "causes", "b"), ("b", "lower_than", "c")]
    paths = relation_paths(relations.withColumnRenamed("k", "key"))
    assert rows(paths, "start", "first", "via", "second", "end") == [("a", "causes", "b", "lower_than", "c")]
    assert rows(panels.cross_references(df, "k", "t", "own"), "target", "relation") == [("Figure 3", "caused_by"), ("Table S1", "references")]
    assert panels.panel_segments(df.limit(0), "k", "t").count() == 0
