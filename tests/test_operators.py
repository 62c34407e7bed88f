import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from quarrylens.operators import answers, embeddings, evaluation, library, logs, retrieval, sections, understanding
from quarrylens.plans import hybrid
from quarrylens.sources import articles, pdf, tables
from quarrylens.streaming import frames, ingest, trends

PAPER = "paper_key string, author string, paper_id string, title string, doi string, year string, source_hash string"
CHUNK = (
    "id bigint, paper_key string, chunk_index bigint, section string, text string, chunk_hash string, section_kind string, "
    "caption_label string, caption_object_type string, caption_object_label string"
)


def library_of(spark):
    papers = spark.createDataFrame(
        [("A/1", "A", "1", "Alloy foam", None, "2020", "h1"), ("A/2", "A", "2", "Zinc film", "10.1/x", None, "h2"), ("B/1", "B", "1", "Other", "", "", "h3")], PAPER
    )
    text = "The alloy foam kept a conversion of 82 percent over many cycles of use."
    made = [
        (1, "A/1", 0, "Abstract", text, None, "body", None, None, None),
        (2, "A/1", 1, "Methods", "We heated the foam in a furnace, see the introduction of the alloy work.", None, "body", None, None, None),
        (3, "A/2", 0, "Results", "A zinc film reached 45 percent. The alloy was absent in this zinc film.", None, None, None, None, None),
        (4, "B/1", 0, "References", "alloy alloy alloy alloy alloy alloy alloy alloy alloy", None, "body", None, None, None),
        (5, "A/9", 0, "Results", "An orphan chunk of a paper that is not there at all, really.", None, "body", None, None, None),
        (1, "A/1", 0, "Abstract", text, None, "body", None, None, None),
    ]
    chunks = spark.createDataFrame(made, CHUNK)
    return papers, chunks


def test_source_chunks_and_upsert(spark):
    papers, chunks = library_of(spark)
    canonical = library.source_chunks(chunks, papers)
    assert rows(canonical, "id", "doi", "year", "section_kind") == [(1, "", "2020", "body"), (2, "", "2020", "body"), (3, "10.1/x", "", "body"), (4, "", "", "body")]
    stored = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", None), ("c", 4), ("d", 5)], "k string, v int")
    assert rows(library.upsert(stored, new.where("k <> 'a'"), ["k"], ["v"])) == [("a", 1, "kept"), ("b", None, "unchanged"), ("c", 4, "updated"), ("d", 5, "inserted")]
    assert library.upsert(stored.limit(0), new.limit(0), ["k"], ["v"]).count() == 0


def test_classes_facts_profiles(spark):
    papers, chunks = library_of(spark)
    canonical = library.source_chunks(chunks, papers)
    classes = understanding.classify(canonical)
    kinds = {r.chunk_id: r.chunk_kind for r in classes.collect()}
    assert kinds == {1: "abstract", 2: "methods", 3: "results", 4: "bibliography_or_reference"}
    facts = understanding.chunk_facts(canonical, classes)
    assert {r.chunk_id: r.fact_type for r in facts.collect()} == {1: "context", 2: "method", 3: "result"}
    profiles = {r.paper_key: r for r in understanding.paper_profiles(facts, papers).collect()}
    assert set(profiles) == {"A/1", "A/2"}
    assert profiles["A/1"].one_sentence_summary.startswith("Alloy foam: The alloy foam")
    assert profiles["A/1"].contribution_types == ["method"]
    assert profiles["A/1"].topic_keywords == sorted(profiles["A/1"].topic_keywords)
    assert understanding.author_themes(understanding.paper_profiles(facts, papers)).count() == 2
    noise = spark.createDataFrame([("Download PDF\nSign in\n",), ("Download PDF\nA result.",), ("",)], "t string")
    assert [r.n for r in noise.select(understanding.is_publisher_noise(F.col("t")).alias("n")).collect()] == [True, False, False]


def test_routes_and_fusion(spark):
    papers, chunks = library_of(spark)
    canonical = library.source_chunks(chunks, papers).cache()
    questions = spark.createDataFrame([(1, "A", "alloy foam?"), (2, "B", "alloy"), (3, "A", None), (4, "C", "alloy")], "query_id bigint, author string, question string")
    like = retrieval.like_route(questions, canonical)
    assert rows(like, "query_id", "position", "chunk_id")[:2] == [(1, 1, 1), (1, 2, 2)]
    assert not like.where("query_id in (3, 4)").count()
    bm25 = retrieval.bm25_scores(questions, canonical).collect()
    # brute force over the same statistics
    import math
    import re

    texts = {r.id: (r.author, re.findall(r"\w+", r.text.lower())) for r in canonical.collect()}
    mean = sum(len(w) for _, w in texts.values()) / len(texts)

    def score(author, phrases):
        out = {}
        for phrase in phrases:
            hits = {i: sum(w[k : k + len(phrase)] == phrase for k in range(len(w))) for i, (_, w) in texts.items()}
            df = sum(h > 0 for h in hits.values())
            idf = max(math.log((len(texts) - df + 0.5) / (df + 0.5)), 1e-6)
            for i, f in hits.items():
                if f and texts[i][0] == author:
                    out[i] = out.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(texts[i][1]) / mean))
        return out

    expected = {(1, i): s for i, s in score("A", [["alloy"], ["foam"], ["alloy", "foam"]]).items()} | {(2, i): s for i, s in score("B", [["alloy"]]).items()}
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in bm25} == {k: round(v, 9) for k, v in expected.items()}
    lib = hybrid.library(canonical, papers)
    fused = hybrid.hybrid(questions, lib)
    assert fused.where("query_id = 1").orderBy("position").first().chunk_id == 1
    assert hybrid.context(questions, lib).where("query_id = 1").count() >= 1
    assert hybrid.hybrid(questions.limit(0), lib).count() == 0
    routes = spark.createDataFrame([(1, "fts", 1, 9), (1, "like", 1, 7), (1, "fact", 1, 7), (1, "like", 2, 7)], "query_id int, route string, position int, chunk_id int")
    assert rows(retrieval.fuse(routes), "position", "chunk_id", "seed") == [(1, 9, 1), (2, 7, None)]
    extra = spark.createDataFrame([(1, 1, 7), (1, 2, 5)], "query_id int, position int, chunk_id int")
    assert rows(retrieval.with_tail(retrieval.fuse(routes), extra, 2, 2), "position", "chunk_id", "origin") == [(1, 9, "hybrid"), (2, 5, "profile")]


def test_hash_bucket_equals_the_64_bit_hash():
    for term in ("alloy", "氧空位", "é-1"):
        h = 1469598103934665603
        for b in term.encode():
            h = ((h ^ b) * 1099511628211) % 2**64
        assert retrieval.hash_bucket(term) == h % 64


def test_vectors(spark):
    df = spark.createDataFrame(
        [(1, "M ", "v2", dt.datetime(2024, 1, 1), [5, 6], [(1, [0.0, 2.0]), (0, [3.0, 4.0]), (7, [1.0, 1.0])]), (2, "m", "v2", dt.datetime(2024, 1, 2), [5], [(0, [1.0, 0.0])])],
        "response_id long, model string, model_version string, received_at timestamp, target_ids array<long>, data array<struct<index int, embedding array<float>>>",
    )
    assert rows(embeddings.response_items(df), "chunk_id", "position") == [(5, 0), (5, 0), (6, 1)]
    assert rows(embeddings.latest_vectors(df, 2), "chunk_id", "model", "vector") == [(5, "m", [1.0, 0.0]), (6, "m", [0.0, 2.0])]
    coded = df.select(embeddings.decode(embeddings.encode(F.lit([1.5, -2.0]).cast("array<float>"))).alias("v"), embeddings.decode(F.lit(b"abc")).alias("bad")).first()
    assert coded.v == [1.5, -2.0] and coded.bad is None
    texts = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, text string")
    assert rows(embeddings.embed(texts, lambda ts: [[float(len(t)), 0.0] for t in ts], 2)) == [(1, [1.0, 0.0]), (2, [0.0, 0.0])]


def test_answers(spark):
    papers, chunks = library_of(spark)
    canonical = library.source_chunks(chunks, papers)
    good = '{"answer": "x", "claims": [{"claim": "c", "evidence_indices": [0], "support": "strong"}], "evidence": [{"paper_key": "A/1", "chunk_id": 1, "section": "ABSTRACT", "quote_or_summary": "a conversion of 82 percent"}], "uncertainty": ""}'
    logs_ = spark.createDataFrame(
        [
            (1, "A", "q", good), (2, "A", "q", "```json\n" + good.replace("82", "83") + "\n```"), (3, "A", "q", "no json"), (4, "A", "q", None),
            (5, "A", "q", good.replace("[0]", "[4]")), (6, "A", "q", '{"answer": "证据不足"}'), (7, "A", "q", good.replace("A/1", "A/2")), (1, "A", "q", good),
        ],
        "id bigint, author string, question string, answer_json string",
    )
    parsed = answers.parsed_answers(logs_)
    assert rows(answers.first_errors(parsed, canonical)) == [
        (1, "valid"), (2, "evidence:number"), (3, "unreadable"), (4, "unreadable"), (5, "claim:missing_evidence"), (6, "valid"), (7, "evidence:other_paper"),
    ]
    assert "依据：" in answers.rendered(parsed).where("log_id = 1").first().text
    assert answers.parsed_answers(logs_.limit(0)).count() == 0


def test_evaluation(spark):
    papers, chunks = library_of(spark)
    canonical = library.source_chunks(chunks, papers)
    golden = spark.createDataFrame([(1, ["A/1"], ["FURNACE"]), (2, ["A/1", "A/2"], ["x"]), (3, [], [])], "query_id int, must_cite array<string>, must_include array<string>")
    got = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 1)], "query_id int, position int, chunk_id int")
    cases = evaluation.cases(got, golden, canonical)
    assert rows(cases) == [(1, True, 0.5, True, ""), (2, False, 1.0, False, "x"), (3, True, 0.0, True, "")]
    a = evaluation.summary(cases)
    assert evaluation.comparison(a, a, {"hit_at_k": (0.0, 1.0), "coverage": (0.0, 0.5)}).where("blocked").count() == 1


def test_logs(spark):
    df = spark.createDataFrame(
        [(1, "a", dt.datetime(2024, 1, 1, 10), 10, 5), (2, "a", dt.datetime(2024, 1, 1, 10, 20), None, None), (3, "a", dt.datetime(2024, 1, 1, 12), 30, 7), (3, "a", dt.datetime(2024, 1, 1, 12), 30, 7)],
        "id bigint, author string, created_at timestamp, latency_ms bigint, total_tokens bigint",
    )
    once = logs.distinct_logs(df)
    assert rows(logs.gaps(once), "session", "questions") == [(1, 2), (2, 1)]
    full = once.select("*", *[F.lit(1).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens")])
    assert logs.totals(full).first().asDict() == {"questions": 3, "mean_latency_ms": 20.0, "prompt_tokens": 3, "completion_tokens": 3, "total_tokens": 12}
    assert logs.totals(full.limit(0)).first().total_tokens is None


def test_sources(spark, tmp_path):
    for author, paper, body in (("Al", "p1", "---\ntitle: 'T: x'\n# c\ndoi: 10.1/a\n---\n# Head\n\ntext\n## References\nr"), ("Bo", "p2", "plain")):
        folder = tmp_path / author / paper
        folder.mkdir(parents=True)
        (folder / "article.md").write_text(body)
    (tmp_path / "Bo" / "p2" / "fetch-result.json").write_text('{"record": {"title": "From record"}}')
    (tmp_path / "Bo" / "empty").mkdir()
    loaded = articles.load(spark, str(tmp_path))
    assert rows(library.resolved_metadata(loaded)) == [("Al/p1", "T: x", "10.1/a", ""), ("Bo/p2", "From record", "", "")]
    assert rows(sections.sections(loaded), "paper_key", "title", "content") == [("Al/p1", "Head", "text"), ("Bo/p2", "Body", "plain")]
    assert articles.load(spark, str(tmp_path), "Al").count() == 1
    assert articles.load(spark, str(tmp_path / "none")).count() == 0
    assert rows(library.fetch_result_state(loaded)) == [("Al/p1", "missing"), ("Bo/p2", "ok")]
    path = str(tmp_path / "out")
    tables.write_partitions(spark.createDataFrame([("a", 1), ("b", 1)], "author string, v int"), path, "author")
    tables.write_partitions(spark.createDataFrame([("b", 2)], "author string, v int"), path, "author")
    assert rows(spark.read.parquet(path), "author", "v") == [("a", 1), ("b", 2)]


def test_pdf(spark):
    df = spark.createDataFrame(
        [(1, "Downloaded from x\nStable alloy foams for propane\nand their long careful use\n2019 doi:10.1234/ab.c1).\n"), (2, ""), (3, None), (1, "Downloaded")],
        "extract_id bigint, text string",
    ).where("text is null or text <> 'Downloaded'")
    found = {r.extract_id: r for r in pdf.metadata(df).collect()}
    assert (found[1].doi, found[1].year) == ("10.1234/ab.c1", "2019")
    assert found[1].title == "Stable alloy foams for propane and their long careful use"
    assert found[2].title == ""
    ids = pdf.paper_ids(spark.createDataFrame([(1, "10.1/A b", "2019", ""), (2, "10.1/A b", "2019", ""), (3, "", "", "")], "extract_id int, doi string, year string, title string"))
    assert rows(ids) == [(1, "2019-10-1-a-b"), (2, "2019-10-1-a-b-2"), (3, "undated-paper")]


def test_relation_paths(spark):
    rel = spark.createDataFrame([("k", "a", "r", "b"), ("k", "b", "s", "c"), ("k", "b", "s", "a"), ("j", "b", "s", "d")], "key string, subject string, relation string, object string")
    assert rows(sections.relation_paths(rel)) == [("k", "a", "r", "b", "s", "c"), ("k", "b", "s", "a", "r", "b")] or rows(sections.relation_paths(rel)) == [("k", "a", "r", "b", "s", "c")]


def test_streaming(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    schema = "id bigint, qa_mode string, created_at timestamp, error_code string, total_tokens bigint"
    first = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, 5), None, 3), (2, "a", dt.datetime(2024, 1, 1, 6), "x", 4)], schema)
    first.write.parquet(source)
    ingest.run_available(ingest.stream_table(spark, source, first.schema), ingest.versioned_sink(sink), str(tmp_path / "ck"))
    spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, 5), None, 9)], schema).write.mode("append").parquet(source)
    ingest.run_available(ingest.stream_table(spark, source, first.schema), ingest.versioned_sink(sink), str(tmp_path / "ck"))
    assert rows(ingest.latest(spark.read.parquet(sink), ["id"]), "id", "total_tokens") == [(1, 9), (2, 4)]
    assert rows(trends.windowed(first), "questions", "errors", "total_tokens") == [(2, 1, 7)]
    live = trends.windowed(trends.once_per_id(ingest.stream_table(spark, source, first.schema)), late=None)
    q = live.writeStream.outputMode("append").format("memory").queryName("live").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("live").columns == ["start", "qa_mode", "questions", "errors", "total_tokens"]
    body = 'data: {"choices":[{"delta":{"content":"Hi"}}]}\r\n\r\ndata: {"choices":[{"delta":{}}]}\n\ndata: [DONE]\n\n'
    df = spark.createDataFrame([(body, '{"answer": "a\\nb\\"c')], "b string, p string")
    got = df.select(frames.deltas(F.col("b")).alias("d"), frames.partial_string(F.col("p"), "answer").alias("s")).first()
    assert got.d == ["Hi"] and got.s == 'a\nb"c'


def test_profiles_are_ranked_by_their_claims(spark):
    none = "array<string>"
    profiles = spark.createDataFrame(
        [("A/1", "A", "2024", "Foam", "", ["foam"], "Foam: sintering"), ("A/2", "A", "2020", "Film", "", ["film"], "Film: casting")],
        f"paper_key string, author string, year string, title string, doi string, topic_keywords {none}, one_sentence_summary string",
    )
    claim = "The zirconium membrane failed."
    facts = spark.createDataFrame(
        [("A/2", "limitation", claim), ("A/2", "limitation", claim), ("A/2", "context", claim), ("A/9", "result", claim)], "paper_key string, fact_type string, claim string"
    )
    questions = spark.createDataFrame([(1, "A", "zirconium")], "query_id int, author string, question string")
    assert rows(retrieval.profile_ranking(questions, profiles, facts=facts), "position", "paper_key", "score") == [(1, "A/2", 5), (2, "A/1", 0)]
    assert rows(retrieval.profile_ranking(questions, profiles, facts=facts.limit(0)), "position", "paper_key", "score") == [(1, "A/1", 0), (2, "A/2", 0)]


def test_article_chunks_by_source(spark):
    body = "Lead.\n# Results\nShow more\nText of results.\nFigure 2A-C: Rates\n## Share\nTable S1 Values\n# References\n1. X"
    frame = spark.createDataFrame(
        [("A/1", body, {"source": "ScienceDirect"}, None), ("A/2", body, None, '{"source": "vellum"}'), ("A/3", None, None, '{"source": ["x"]}'), ("A/4", " ", None, "broken")],
        "paper_key string, raw_body string, metadata map<string,string>, fetch_result string",
    )
    sourced = library.with_source(frame)
    assert rows(sourced, "paper_key", "source") == [("A/1", "ScienceDirect"), ("A/2", "vellum"), ("A/3", ""), ("A/4", "")]
    made = sections.article_chunks(sourced)
    assert rows(made.where("paper_key = 'A/1'"), "chunk_index", "section", "section_kind", "object_label", "text") == [
        (0, "Results", "body", None, "Lead.\n\nText of results.\nFigure 2A-C: Rates\nTable S1 Values"), (1, "Figure 2A-C Caption", "figure_caption", "2", "Figure 2A-C: Rates"),
        (2, "Table S1 Caption", "table_caption", "S1", "Table S1: Values"),
    ]
    assert "Show more" in rows(made.where("paper_key = 'A/2' and chunk_index = 0"), "text")[0][0]
    assert {r[0] for r in rows(made, "paper_key")} == {"A/1", "A/2"}
    assert library.fetch_result_state(frame).where("state = 'ok'").count() == 1


def test_keywords_of_all_facts(spark):
    papers = spark.createDataFrame([("p", "A", "Title words", None, None)], "paper_key string, author string, title string, doi string, year string")
    facts = spark.range(20).selectExpr(
        "concat('u', lpad(id, 2, '0')) AS claim_uid", "'p' AS paper_key", "id AS chunk_index", "'result' AS fact_type", "concat('same claim ', if(id < 14, concat(' ', repeat('ab', int(id) % 2 + 2), repeat('-', int(id))), concat('later', id))) AS claim"
    )
    words = understanding.paper_profiles(facts, papers).first().topic_keywords
    assert {"Title", "words", "same", "claim"} < set(words) and len(words) == 12
    few = understanding.paper_profiles(facts.where("chunk_index > 16"), papers).first().topic_keywords
    assert few == sorted(["Title", "words", "same", "claim", "later17", "later18", "later19"])


def test_class_states(spark):
    chunks = spark.createDataFrame([(i, "p", None if i == 5 else f"h{i}") for i in range(1, 7)], "id bigint, paper_key string, chunk_hash string")
    papers = spark.createDataFrame([("p", "s")], "paper_key string, source_hash string")
    stored = [(1, "v1", "s", "h1"), (1, "v0", "s", "x"), (2, "v1", "s", "x"), (3, "v1", None, "h3"), (4, "v0", "s", "h4"), (5, "v1", "s", None)]
    classes = spark.createDataFrame(stored, "chunk_id bigint, classifier_version string, source_hash string, chunk_hash string")
    found = dict(rows(understanding.class_states(chunks, papers, classes, "v1"), "chunk_id", "state"))
    assert found == {1: "current", 2: "other_text", 3: "other_source", 4: "other_version", 5: "current", 6: "missing"}


def test_sessions_across_midnight(spark):
    at = [dt.datetime(2024, 1, 1, 23, 50), dt.datetime(2024, 1, 2, 0, 10), dt.datetime(2024, 1, 2, 0, 50), dt.datetime(2024, 1, 4, 1, 0)]
    frame = spark.createDataFrame([(i, "a", t) for i, t in enumerate(at)] + [(9, "b", at[0])], "id bigint, author string, created_at timestamp")
    assert rows(logs.gaps(frame), "author", "session", "questions") == [("a", 1, 2), ("a", 2, 1), ("a", 3, 1), ("b", 1, 1)]


def test_publisher_layers(spark):
    from quarrylens.functions import clean

    frame = spark.createDataFrame([("American Chemical Society",), ("RSC",), ("rscx",), ("Springer Nature",), (None,)], "source string")
    named, columns = clean.with_layers(frame)
    assert [tuple(k for k, v in r.asDict().items() if v is True) for r in named.collect()] == [
        ("_for_acs",), ("_for_rsc",), (), ("_for_springer", "_for_nature"), ()
    ] and set(columns) == {"acs", "elsevier", "rsc", "wiley", "springer", "nature"}


def test_the_route_for_logs_equals_the_route_for_batches(spark):
    """Shared and rare phrases, ties, several tasks an author; by ids, scores and places."""
    import random

    from quarrylens.operators import log_retrieval

    random.seed(5)
    common, rare = "the of alloy foam in x-ray pores water after cycles".split(), [f"name{i}ene" for i in range(40)]
    texts = [" ".join(random.choices(common, k=random.randint(1, 12)) + random.choices(rare, k=random.randint(0, 2))) for _ in range(400)]
    texts = [f"Which alloy foam? {t}" if i % 7 == 0 else t for i, t in enumerate(texts)] + [None, "", "?!", texts[0], texts[0]]
    chunks = spark.createDataFrame([(i, None if i == 9 else "AAAB"[i % 4], t) for i, t in enumerate(texts)], "id long, author string, text string")
    asked = [f"Which {random.choice(common)} {random.choice(common)} of {random.choice(rare)} after {i % 5} cycles" for i in range(120)]
    asked += ['the "alloy foam" in water', "which alloy foam", "x-ray", "the alloy", "the alloy", "", None, "nothing here", "氧空位", f"{rare[0]} {rare[1]} foam"]
    questions = spark.createDataFrame([(i, None if i == 3 else "AB"[i % 2], q) for i, q in enumerate(asked)], "query_id long, author string, question string")
    expected = rows(retrieval.bm25_route(questions, chunks, 7))
    assert len(expected) > 700
    for more in ({"block": 60, "slices": 20}, {"frequent": 0.0}):
        found = rows(log_retrieval.bm25_log_route(questions, chunks, 7, **more))
        assert [r[:4] for r in found] == [r[:4] for r in expected]
        assert all(abs(a[4] - b[4]) < 1e-8 for a, b in zip(found, expected))
    assert not log_retrieval.bm25_log_route(questions.limit(0), chunks).count()
