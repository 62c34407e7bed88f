"""The registered queries of the core: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import clean, rules, terms, text
from .operators import answers, embeddings, evaluation, library, log_retrieval, logs, retrieval, sections, understanding
from .oracle import ORACLE
from .plans import hybrid
from .sources import pdf
from .sources.tables import table
from .streaming import trends

FLAGSHIP = "hybrid_retrieval"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


@dataclass(frozen=True)
class Tables:
    """The tables of one directory and what several queries derive from them."""

    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.root, name)

    @cached_property
    def source_chunks(self) -> DataFrame:
        return library.source_chunks(self.chunks, self.papers)

    @cached_property
    def sourced(self) -> DataFrame:
        return library.with_source(self.articles)

    @cached_property
    def questions(self) -> DataFrame:
        return self.golden_items.select(F.col("item_id").alias("query_id"), "author", "question")

    @cached_property
    def golden(self) -> DataFrame:
        return self.golden_items.select(F.col("item_id").alias("query_id"), "must_cite", "must_include")

    @cached_property
    def lib(self) -> hybrid.Library:
        return hybrid.library(self.source_chunks, self.papers)

    @cached_property
    def logs_once(self) -> DataFrame:
        return logs.distinct_logs(self.qa_logs)

    @cached_property
    def parsed(self) -> DataFrame:
        return answers.parsed_answers(self.qa_logs)


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[make.__name__] = lambda spark, root: make(Tables(spark, root))
    return make


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- sources and the library ------------------------------------------------


@query
def article_metadata(t: Tables) -> DataFrame:
    return library.resolved_metadata(t.articles)


@query
def fetch_result_states(t: Tables) -> DataFrame:
    return library.fetch_result_state(t.articles)


@query
def article_fingerprints(t: Tables) -> DataFrame:
    return library.fingerprints(t.articles)


@query
def changed_papers(t: Tables) -> DataFrame:
    return library.changed_papers(library.fingerprints(t.articles), t.papers)


@query
def upsert_outcomes(t: Tables) -> DataFrame:
    """Resolved metadata upserted into the stored papers: how many rows of each outcome."""
    incoming = library.resolved_metadata(t.articles)
    stored = t.papers.select("paper_key", "title", "doi", "year")
    return library.upsert(stored, incoming, ["paper_key"], ["title", "doi", "year"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("papers"))


@query
def pdf_metadata(t: Tables) -> DataFrame:
    return pdf.metadata(t.pdf_extracts)


@query
def pdf_paper_ids(t: Tables) -> DataFrame:
    return pdf.paper_ids(pdf.metadata(t.pdf_extracts))


@query
def pdf_normalised(t: Tables) -> DataFrame:
    once = t.pdf_extracts.dropDuplicates(["extract_id"])
    return once.select("extract_id", F.sha2(pdf.normalised(F.col("text")), 256).alias("text_hash"))


@query
def source_chunk_rows(t: Tables) -> DataFrame:
    return t.source_chunks.select("id", "paper_key", "author", "title", "doi", "year", "chunk_index", "section", "section_kind", "source_hash")


@query
def recent_chunks(t: Tables) -> DataFrame:
    return library.top_per_author(t.source_chunks, 8).select("author", "position", "id")


@query
def stale_chunk_hashes(t: Tables) -> DataFrame:
    return library.stale_chunk_hashes(t.chunks)


@query
def papers_per_author(t: Tables) -> DataFrame:
    return library.paper_counts(t.papers)


@query
def library_status(t: Tables) -> DataFrame:
    return library.library_status(t.papers, t.chunks, t.qa_logs, library.fingerprints(t.articles))


@query
def redacted_keys(t: Tables) -> DataFrame:
    from .sources.tables import redacted

    return t.papers.select("paper_key", redacted(F.col("source_hash")).alias("hidden"))


# --- cleaning, sections, chunks ---------------------------------------------


@query
def cleaned_bodies(t: Tables) -> DataFrame:
    rows, layers = clean.with_layers(t.sourced.where("raw_body is not null"))
    return rows.select("paper_key", clean.clean_text(F.col("raw_body"), layers).alias("text"))


@query
def article_sources(t: Tables) -> DataFrame:
    return library.article_sources(t.articles)


@query
def article_chunks(t: Tables) -> DataFrame:
    """Articles cut into chunks: sections, captions, overlapping pieces, one running index."""
    made = sections.article_chunks(t.sourced)
    return made.select("paper_key", "chunk_index", "section", "section_kind", "caption_label", "object_type", "object_label", F.length("text").alias("characters"), "chunk_hash")


@query
def noise_lines(t: Tables) -> DataFrame:
    rows = library.distinct_chunks(t.chunks).select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(clean.is_noise_line(F.col("line"), "acs elsevier rsc")).select("id", "line_no", clean.normal_line(F.col("line")).alias("line"))


@query
def article_sections(t: Tables) -> DataFrame:
    return sections.sections(t.sourced)


@query
def section_facts(t: Tables) -> DataFrame:
    kinded = sections.sections(t.sourced).withColumn("kind", sections.section_fact_type(F.col("title"), sections.section_kind(F.col("title"))))
    return kinded.where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("characters"))


@query
def analysis_contexts(t: Tables) -> DataFrame:
    return sections.analysis_context(sections.sections(t.sourced))


@query
def caption_lines(t: Tables) -> DataFrame:
    return sections.captions(library.distinct_chunks(t.chunks), "id", "text")


@query
def caption_objects(t: Tables) -> DataFrame:
    labelled = library.distinct_chunks(t.chunks).where("caption_label is not null")
    made = labelled.select("id", sections.caption_object(F.col("caption_label")).alias("c"))
    return made.select("id", "c.object_type", "c.object_label", F.array_join("c.panels", ",").alias("panels"), F.array_join("c.targets", ",").alias("targets"))


@query
def caption_values(t: Tables) -> DataFrame:
    captions = library.distinct_chunks(t.chunks).where("section_kind in ('figure_caption', 'table_caption')")
    found = captions.select("id", sections.caption_values(F.col("text")).alias("v"))
    return found.select("id", F.array_join("v.measurements", "; ").alias("measurements"), F.array_join("v.named", "; ").alias("named"))


@query
def evidence_paths(t: Tables) -> DataFrame:
    """Two-hop paths between the papers that the answers of an author cite one after the other in a month."""
    cited = t.parsed.select(F.col("log_id").alias("id"), F.posexplode("a.evidence").alias("place", "e")).where("e.paper_key is not null")
    trail = cited.join(t.logs_once.select("id", "author", "created_at"), "id").withColumn("month", F.date_trunc("month", "created_at"))
    following = F.lead("e.paper_key").over(W.partitionBy("author", "month").orderBy("created_at", "id", "place"))
    pairs = trail.select(F.struct("author", "month").alias("key"), F.col("e.paper_key").alias("subject"), F.lit("then").alias("relation"), following.alias("object"))
    return sections.relation_paths(pairs.where("object is not null").distinct()).select(F.col("key.author").alias("author"), "start", "via", "end").distinct()


@query
def split_documents(t: Tables) -> DataFrame:
    pieces = sections.split_chunks(t.documents, "doc_id", "text", 800, 100)
    return pieces.select("doc_id", "piece", F.length("text").alias("characters"), F.sha2("text", 256).alias("chunk_hash"))


# --- questions --------------------------------------------------------------


@query
def question_terms(t: Tables) -> DataFrame:
    once = terms.with_terms(t.logs_once.select("id", "question"), "question")
    return once.select("id", F.array_join("terms", "|").alias("terms"))


@query
def question_match_strings(t: Tables) -> DataFrame:
    return terms.with_terms(t.logs_once.select("id", "question"), "question").select("id", terms.match_string(F.col("terms")).alias("match"))


@query
def question_intents(t: Tables) -> DataFrame:
    once = terms.with_terms(t.logs_once.select("id", "question"), "question")
    return once.select("id", F.array_join(terms.fact_intents(F.col("terms")), ",").alias("intents"))


@query
def question_rank_terms(t: Tables) -> DataFrame:
    return terms.with_terms(t.logs_once.select("id", "question"), "question").select("id", F.array_join(terms.rank_terms(F.col("terms")), "|").alias("terms"))


@query
def question_plans(t: Tables) -> DataFrame:
    counts = library.paper_counts(t.papers)
    rows = t.logs_once.join(counts, "author", "left").withColumn("plan", terms.route_mode(F.col("question"), F.coalesce("papers", F.lit(0))))
    return rows.select(
        "id", "plan.qa_mode", "plan.route_reason", text.answer_language(F.col("question")).alias("language"), terms.asks_for_evidence(F.col("question")).alias("asks_for_evidence")
    )


# --- understanding ----------------------------------------------------------


@query
def chunk_classes(t: Tables) -> DataFrame:
    return understanding.classify(library.distinct_chunks(t.chunks)).select("chunk_id", "chunk_kind", "usefulness_score", "skip_reason")


@query
def chunk_class_report(t: Tables) -> DataFrame:
    return understanding.class_counts(understanding.classify(library.distinct_chunks(t.chunks)))


@query
def pending_classification(t: Tables) -> DataFrame:
    return understanding.pending_classification(library.distinct_chunks(t.chunks), t.chunk_classifications)


@query
def class_states(t: Tables) -> DataFrame:
    """How many chunks have a current class, by author; else why not."""
    states = understanding.class_states(library.distinct_chunks(t.chunks), t.papers, t.chunk_classifications, "chunk-classifier-v1")
    owned = t.source_chunks.select(F.col("id").alias("chunk_id"), "author")
    return states.join(owned, "chunk_id").groupBy("author", "state").agg(F.count(F.lit(1)).alias("chunks"))


@query
def fact_report(t: Tables) -> DataFrame:
    """Facts, papers and authors by type of fact."""
    facts = hybrid.facts_of(t.source_chunks).join(t.papers.select("paper_key", "author"), "paper_key")
    # distinct papers first, so that a type held by a third of all rows is counted in parts
    by_paper = facts.groupBy("fact_type", "author", "paper_key").agg(F.count(F.lit(1)).alias("n"))
    return by_paper.groupBy("fact_type").agg(F.sum("n").alias("facts"), F.count(F.lit(1)).alias("papers"), F.countDistinct("author").alias("authors"))


@query
def extraction_outcomes(t: Tables) -> DataFrame:
    """What became of each class of chunks: facts, skipped, or too little useful."""
    classes = understanding.classify(library.distinct_chunks(t.chunks))
    outcome = F.when(F.coalesce("skip_reason", F.lit("")) != "", "skipped").when(F.col("usefulness_score") < 0.5, "low_score").otherwise("eligible")
    return classes.groupBy("chunk_kind", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("chunks"))


@query
def profile_gate(t: Tables) -> DataFrame:
    """Per author: papers, profiles, their facts, and how many profiles cite facts."""
    profiles = t.lib.profiles.select("paper_key", "facts", (F.size("contributions") + F.size("limitations") > 0).alias("cites"))
    joined = t.papers.select("paper_key", "author").join(profiles, "paper_key", "left")
    return joined.groupBy("author").agg(
        F.count(F.lit(1)).alias("papers"), F.count("facts").alias("profiles"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.count_if("cites").alias("citing")
    )


@query
def paper_chunk_counts(t: Tables) -> DataFrame:
    """Every paper with its chunks, or none."""
    counted = library.distinct_chunks(t.chunks).groupBy("paper_key").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").alias("last_index"))
    return t.papers.select("paper_key", "author").join(counted, "paper_key", "left").fillna(0, ["chunks"])


@query
def class_agreement(t: Tables) -> DataFrame:
    """How often the rules and the latest stored class agree, by kind."""
    ours = understanding.classify(library.distinct_chunks(t.chunks)).select("chunk_id", "chunk_kind")
    latest = t.chunk_classifications.groupBy("chunk_id").agg(F.max(F.struct("classified_at", "classifier_version", F.col("chunk_kind").alias("stored"))).alias("m"))
    return ours.join(latest, "chunk_id").groupBy("chunk_kind", F.col("m.stored").alias("stored_kind")).agg(F.count(F.lit(1)).alias("chunks"))


@query
def chunk_facts(t: Tables) -> DataFrame:
    return hybrid.facts_of(t.source_chunks).select("claim_uid", "chunk_id", "fact_type", "confidence")


@query
def ranked_facts(t: Tables) -> DataFrame:
    return understanding.distinct_facts(hybrid.facts_of(t.source_chunks)).select("paper_key", "rank_position", "fact_type", "claim_uid")


@query
def paper_profiles(t: Tables) -> DataFrame:
    return t.lib.profiles.select(
        "paper_key", "facts", "one_sentence_summary", F.array_join("contribution_types", ",").alias("contribution_types"),
        F.array_join("topic_keywords", ",").alias("topic_keywords"), F.size("contributions").alias("contributions"), F.size("limitations").alias("limitations"),
    )


@query
def profile_faults(t: Tables) -> DataFrame:
    """Faults of the profiles, and how many have none."""
    faults = understanding.profile_faults(t.lib.profiles, t.lib.facts)
    every = t.lib.profiles.select("paper_key").join(faults, "paper_key", "left")
    return every.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("papers"))


@query
def instructing_texts(t: Tables) -> DataFrame:
    """Chunks, questions and documents with a phrase that instructs a model."""
    parts = [("chunk", library.distinct_chunks(t.chunks).select("id", "text")), ("log", t.logs_once.select("id", F.col("question").alias("text"))), ("document", t.documents.select(F.col("doc_id").alias("id"), "text"))]
    made = [rows.select(F.lit(name).alias("origin"), "id", text.has_any(F.lower(F.coalesce("text", F.lit(""))), rules.INSTRUCTION_PHRASES).alias("instructs")) for name, rows in parts]
    return made[0].union(made[1]).union(made[2]).groupBy("origin", "instructs").agg(F.count(F.lit(1)).alias("texts"))


@query
def author_themes(t: Tables) -> DataFrame:
    themes = understanding.author_themes(t.lib.profiles)
    return themes.select("author", "theme", "papers", "first_year", "last_year", F.array_join("works", ",").alias("works"))


@query
def keyword_overview(t: Tables) -> DataFrame:
    return understanding.keyword_overview(t.lib.profiles)


@query
def profile_changes(t: Tables) -> DataFrame:
    """Metadata of papers stored against that of their articles, by kind of change."""
    loaded = library.resolved_metadata(t.articles)
    return understanding.profile_difference(t.papers, loaded, ["title", "doi", "year"]).groupBy("change").agg(F.count(F.lit(1)).alias("papers"))


# --- retrieval --------------------------------------------------------------


@query
def like_retrieval(t: Tables) -> DataFrame:
    return retrieval.like_route(t.questions, t.source_chunks)


@query
def bm25_retrieval(t: Tables) -> DataFrame:
    return retrieval.bm25_route(t.questions, t.source_chunks).select("query_id", "position", "chunk_id", F.round("route_score", 6).alias("route_score"))


@query
def fact_retrieval(t: Tables) -> DataFrame:
    return retrieval.fact_route(t.questions, t.source_chunks, hybrid.facts_of(t.source_chunks))


@query
def local_vector_retrieval(t: Tables) -> DataFrame:
    return retrieval.local_vector_route(t.questions, t.source_chunks)


@query
def dense_retrieval(t: Tables) -> DataFrame:
    """Within each label of ``embeddings`` the vectors nearest to those whose id is divisible by 50."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vector"))
    wanted = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "grp", "vector")
    return retrieval.dense_route(wanted, rows, 10).select("query_id", "position", "chunk_id", F.round("route_score", 5).alias("route_score"))


@query
def logged_bm25_retrieval(t: Tables) -> DataFrame:
    """The lexical route for every logged question."""
    asked = t.logs_once.select(F.col("id").alias("query_id"), "author", "question")
    score = F.round(F.col("route_score") * 1e6) / 1e6  # binary halves as the SQL rounds them
    return log_retrieval.bm25_log_route(asked, t.source_chunks).select("query_id", "position", "chunk_id", score.alias("route_score"))


@query
def representative_chunks(t: Tables) -> DataFrame:
    return retrieval.representative_chunks(t.source_chunks)


@query
def best_chunks(t: Tables) -> DataFrame:
    return retrieval.best_chunks(t.questions, t.source_chunks)


@query
def profile_retrieval(t: Tables) -> DataFrame:
    return retrieval.profile_ranking(t.questions, t.lib.profiles, facts=t.lib.facts)


@query
def profile_claim_retrieval(t: Tables) -> DataFrame:
    """Profiles ranked by their claims as well."""
    return retrieval.profile_ranking(t.questions, t.lib.profiles, facts=t.lib.facts)


@query
def fused_lexical(t: Tables) -> DataFrame:
    """Fusion of the lexical and the term-frequency route with lexical seeds."""
    both = retrieval.bm25_route(t.questions, t.source_chunks).unionByName(retrieval.like_route(t.questions, t.source_chunks))
    return retrieval.fuse(both)


@query
def hybrid_retrieval(t: Tables) -> DataFrame:
    return hybrid.hybrid(t.questions, t.lib)


@query
def retrieval_trace(t: Tables) -> DataFrame:
    return retrieval.trace(hybrid.routes(t.questions, t.lib)).select("query_id", "route", "candidates", "top_chunk")


@query
def answer_contexts(t: Tables) -> DataFrame:
    return hybrid.context(t.questions, t.lib)


# --- vectors ----------------------------------------------------------------


@query
def response_items(t: Tables) -> DataFrame:
    items = embeddings.response_items(t.embedding_responses)
    return items.select("response_id", "position", "chunk_id", "model", "model_version", F.size("vector").alias("numbers"))


@query
def latest_vectors(t: Tables) -> DataFrame:
    found = embeddings.latest_vectors(t.embedding_responses, 128)
    return found.groupBy("model", "model_version").agg(F.count(F.lit(1)).alias("chunks"))


@query
def pending_embeddings(t: Tables) -> DataFrame:
    have = embeddings.latest_vectors(t.embedding_responses, 128)
    return embeddings.pending(t.chunks, have, "pe-wide", "v2")


@query
def vector_coverage(t: Tables) -> DataFrame:
    """Per author and model version the chunks with a current vector: vectors joined with chunks and papers."""
    have = embeddings.latest_vectors(t.embedding_responses, 128).select(F.col("chunk_id").alias("id"), "model", "model_version")
    return have.join(t.source_chunks.select("id", "author"), "id").groupBy("author", "model", "model_version").agg(F.count(F.lit(1)).alias("chunks"))


@query
def vector_norms(t: Tables) -> DataFrame:
    unit = t.embeddings.select("vec_id", embeddings.normalised(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.round(retrieval.dot(F.col("v"), F.col("v")), 4).alias("norm2"))


@query
def vector_codec(t: Tables) -> DataFrame:
    """Vectors written as bytes and read again: how many come back equal."""
    coded = t.embeddings.select("vec_id", "embedding", embeddings.decode(embeddings.encode("embedding")).alias("again"))
    return coded.groupBy((F.col("embedding") == F.col("again")).alias("equal")).agg(F.count(F.lit(1)).alias("vectors"))


# --- answers and evaluation -------------------------------------------------


@query
def parsed_answers(t: Tables) -> DataFrame:
    return t.parsed.select("log_id", F.col("a").isNotNull().alias("readable"), F.coalesce(F.size("a.evidence"), F.lit(-1)).alias("evidence"), F.coalesce(F.size("a.claims"), F.lit(-1)).alias("claims"))


@query
def evidence_errors(t: Tables) -> DataFrame:
    return answers.evidence_errors(t.parsed, t.source_chunks)


@query
def claim_errors(t: Tables) -> DataFrame:
    return answers.claim_errors(t.parsed)


@query
def answer_verdicts(t: Tables) -> DataFrame:
    return answers.first_errors(t.parsed, t.source_chunks)


@query
def rendered_answers(t: Tables) -> DataFrame:
    return answers.rendered(t.parsed)


@query
def golden_cases(t: Tables) -> DataFrame:
    return evaluation.cases(hybrid.hybrid(t.questions, t.lib), t.golden, t.source_chunks)


@query
def golden_summary(t: Tables) -> DataFrame:
    return evaluation.summary(evaluation.cases(hybrid.hybrid(t.questions, t.lib), t.golden, t.source_chunks))


@query
def log_modes(t: Tables) -> DataFrame:
    """Logged answers by planned mode and reason, with how many are readable and cite evidence."""
    rows = t.logs_once.select("id", "qa_mode", "route_reason").join(t.parsed.select(F.col("log_id").alias("id"), "a"), "id")
    return rows.groupBy("qa_mode", "route_reason").agg(
        F.count(F.lit(1)).alias("answers"), F.count("a").alias("readable"), F.count_if(F.size("a.evidence") > 0).alias("citing")
    )


@query
def golden_route_rates(t: Tables) -> DataFrame:
    return evaluation.route_rates(hybrid.routes(t.questions, t.lib), t.golden, t.source_chunks)


@query
def golden_comparison(t: Tables) -> DataFrame:
    """The lexical fusion against the hybrid one, gated by greatest drop and least value."""
    lexical = retrieval.bm25_route(t.questions, t.source_chunks).unionByName(retrieval.like_route(t.questions, t.source_chunks))
    before = evaluation.summary(evaluation.cases(retrieval.fuse(lexical), t.golden, t.source_chunks))
    after = evaluation.summary(evaluation.cases(hybrid.hybrid(t.questions, t.lib), t.golden, t.source_chunks))
    return evaluation.comparison(before, after, {"hit_at_k": (0.0, 1.0), "mean_precision": (0.02, 0.4), "coverage": (0.0, 1.0)})


# --- logs -------------------------------------------------------------------


@query
def log_totals(t: Tables) -> DataFrame:
    return logs.totals(t.logs_once)


@query
def log_totals_by_author(t: Tables) -> DataFrame:
    return logs.totals(t.logs_once, ["author"])


@query
def log_trend(t: Tables) -> DataFrame:
    return logs.daily_trend(t.logs_once, 30)


@query
def log_errors(t: Tables) -> DataFrame:
    return logs.error_counts(t.logs_once)


@query
def latest_logs(t: Tables) -> DataFrame:
    return logs.latest_by_author(t.logs_once)


@query
def log_rollup(t: Tables) -> DataFrame:
    return logs.grouping_report(t.logs_once)


@query
def log_latencies(t: Tables) -> DataFrame:
    return logs.latency_percentiles(t.logs_once)


@query
def log_sessions(t: Tables) -> DataFrame:
    return logs.gaps(t.logs_once)


@query
def message_pages(t: Tables) -> DataFrame:
    """Rendered answers in pages of at most 400 characters, cut at a line end past the half if there is one."""
    pages = sections.message_pages(answers.rendered(t.parsed), "log_id", "text", 400)
    return pages.select("log_id", "page", F.length("text").alias("characters"))


@query
def log_windows(t: Tables) -> DataFrame:
    return trends.windowed(t.logs_once)
