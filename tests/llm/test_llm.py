import datetime as dt
import itertools
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import p1_similar_vectors as p1
from quarrylens.llm import p2_near_duplicates as p2
from quarrylens.llm import p3_broken_pairs as p3
from quarrylens.llm import p4_text_quality as p4
from quarrylens.llm import p5_scanned as p5
from quarrylens.llm import p6_leaks as p6
from quarrylens.llm import p7_mixture as p7
from quarrylens.llm import p8_reading_level as p8
from quarrylens.llm.near_duplicates import Covering, candidate_pairs, features, fingerprints
from quarrylens.llm.words import shingle_stream, word_stream

WORD = re.compile("[a-z0-9]+")
random.seed(3)
VOCABULARY = ["".join(random.choice("bcdfglmnprst") + random.choice("aeiou") for _ in range(3)) for _ in range(300)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def passage(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_word_stream_equals_regular_expression(texts):
    hashes, bounds = word_stream(texts)
    expected = [WORD.findall((t or "").lower()) for t in texts]
    assert list(np.diff(bounds)) == [len(w) for w in expected]
    known = {}
    for word, value in zip(itertools.chain(*expected), hashes):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    values, owner = shingle_stream(hashes, bounds, 3)
    assert list(np.bincount(owner, minlength=len(texts))) == [max(0, len(w) - 2) for w in expected]


# --- 1 ----------------------------------------------------------------------


def responses(spark, vectors):
    data = [(i, "m", "v2", "chunk", [int(k)], [(0, [float(x) for x in v])], dt.datetime(2024, 1, 1), "extra") for i, (k, v) in enumerate(vectors)]
    return spark.createDataFrame(
        data,
        "response_id long, model string, model_version string, target_type string, target_ids array<long>, "
        "data array<struct<index int, embedding array<float>>>, received_at timestamp, vector string",
    )


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 128))
    vectors = [(100 + i, centres[i % 30] + 0.3 * rng.normal(size=128)) for i in range(240)]
    vectors += [(900, vectors[0][1]), (901, vectors[0][1] * 2), (902, np.zeros(128)), (903, np.ones(64)), (904, [])]
    good = {k: np.asarray(v) / np.linalg.norm(v) for k, v in vectors if k < 902}
    keys = sorted(good)
    matrix = np.stack([good[k] for k in keys])
    cosine = matrix @ matrix.T
    np.fill_diagonal(cosine, -2)
    expected = set()
    for i, k in enumerate(keys):
        for j in np.argsort(-cosine[i], kind="stable")[:5]:
            if cosine[i, j] >= 0.75:
                expected.add((min(k, keys[j]), max(k, keys[j])))
    found = set(rows(p1.found(responses(spark, vectors))))
    assert len(expected & found) >= 0.9 * len(expected)
    assert (100, 900) in found and (900, 901) in found
    assert not {k for pair in found for k in pair} & {902, 903, 904}
    small = p1.PermutationIndex(block=40, per_pivot=20)  # several blocks a file
    again = p1.neighbours(p1.response_vectors(responses(spark, vectors)), small, least=0.75)
    pairs = {(min(r.id, r.other), max(r.id, r.other)) for r in again.collect()}
    assert len(expected & pairs) >= 0.9 * len(expected)


def test_similar_vectors_of_nothing(spark):
    empty = responses(spark, [(1, np.ones(128))]).limit(0)
    assert p1.found(empty).count() == 0
    assert p1.recall(empty).count() == 0
    assert p1.found(responses(spark, [(1, np.ones(128))])).count() == 0


# --- 2 ----------------------------------------------------------------------


def jaccard(a, b, n):
    wa, wb = WORD.findall(a.lower()), WORD.findall(b.lower())
    sa, sb = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (wa, wb))
    return len(sa & sb) / len(sa | sb) if sa | sb else 0.0


def test_chunk_duplicates_against_all_pairs(spark):
    texts = []
    for g in range(25):
        base = passage(100, g).split()
        texts.append(" ".join(base))
        for k in range(3):
            edited = list(base)
            r = random.Random(g * 7 + k)
            for _ in range(4 + 4 * k):
                edited[r.randrange(len(edited))] = r.choice(VOCABULARY)
            texts.append(" ".join(edited))
    texts += [texts[0], texts[0].upper(), "", None, "short text", texts[5]]
    data = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")]
    chunks = spark.createDataFrame(data, "id bigint, text string, symbols string")
    papers = spark.createDataFrame([], "paper_key string, doi string, title string")
    found = {(int(a), int(b)) for _, a, b in rows(p2.found(papers, chunks))}
    found = {(min(p), max(p)) for p in found}
    usable = [i for i, t in enumerate(texts) if t and len(WORD.findall(t)) or t and t.isupper()]
    usable = [i for i in usable if len({tuple(x) for x in zip(*(WORD.findall(texts[i].lower())[k:] for k in range(3)))}) >= 60]
    expected = {(i, j) for i, j in itertools.combinations(usable, 2) if jaccard(texts[i], texts[j], 3) >= 0.6}
    assert found <= expected
    assert len(found) >= 0.97 * len(expected)
    found_classes = p2.chunk_duplicates(chunks).members
    assert len({c for k, c in rows(found_classes, "key", "class_key") if k in (0, 100, 101)}) == 1


def test_paper_duplicates(spark):
    data = [
        ("a", "10.1/X1", "On alloys of nickel"), ("b", " https://doi.example/10.1%2Fx1.", "Another title"), ("c", None, "On ALLOYS of nickel!"), ("d", "none", "on alloys of nickel"),
        ("e", "10.2/x", "On alloys of nickel"), ("f", None, None), ("g", "(10.1/x1)", ""), ("a", "10.1/X1", "On alloys of nickel"),
    ]
    papers = spark.createDataFrame(data, "paper_key string, doi string, title string")
    chunks = spark.createDataFrame([], "id bigint, text string")
    found = {(a, b) for _, a, b in rows(p2.found(papers, chunks))}
    assert found == {("a", "b"), ("a", "g"), ("b", "g"), ("a", "c"), ("a", "d"), ("c", "d"), ("c", "e"), ("d", "e")}


def test_hot_anchors_are_compared_in_blocks(spark):
    texts = [passage(90, k // 4) + " " + " ".join(f"w{k}x{i}" for i in range(2)) for k in range(40)]
    records = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    prints = fingerprints(records, p2.CHUNKS)
    joined = rows(candidate_pairs(prints, p2.CHUNKS), "a", "b")
    assert joined == rows(candidate_pairs(prints, p2.CHUNKS, hot=2), "a", "b") and len(joined) == 60
    flagged = prints.selectExpr("*", "key % 4 = 0 as marked")
    assert rows(candidate_pairs(flagged, p2.CHUNKS, "marked"), "a", "b") == rows(candidate_pairs(flagged, p2.CHUNKS, "marked", hot=2), "a", "b")


def test_features_are_distinct():
    values, owner = features(["a b c a b c", None, ""], Covering(width=3))
    assert len(values) == 3 and set(owner) == {0}


# --- 3 ----------------------------------------------------------------------

PAIRS = [
    ("What is the yield of the alloy after the test?", {"answer": "The yield was 4% [1]."}, None),
    ("What is the yield of the alloy?", {"answer": "4%"}, None),
    ("What is the yield of the alloy?", {"answer": " … ", "uncertainty": ""}, "empty_answer"),
    ("What is the yield of the alloy?", {"claims": []}, "empty_answer"),
    ("What is the yield of the alloy?", {"answer": "", "uncertainty": "Sorry, I can't help with that request."}, "refusal"),
    ("What is the yield of the alloy?", {"answer": "I’m sorry, but I am not able to answer this question."}, "refusal"),
    ("What is the yield of the alloy?", {"answer": "The phase cannot be recycled more than 6 times, so the authors refuse a general claim."}, None),
    ("What is the yield of the alloy?", {"answer": "what is the yield of the alloy."}, "copied_question"),
    ("What is the yield of the alloy?", {"answer": "You ask: What is the yield of the alloy? It was 4% in the first of all the runs."}, None),
    ("What is the yield of the alloy?", {"answer": "The yield was high and the"}, "truncated_answer"),
    ("What is the yield of the alloy?", {"answer": "Sure. Nach der Behandlung stieg die Leitfähigkeit, weil sich der Rest bildete."}, "other_language"),
    ("为什么过电位下降？", {"answer": "温度升高时，过电位明显下降。"}, None),
    ("为什么过电位下降？", {"answer": "The overpotential was lower after the treatment of the sample."}, "other_language"),
    ("为什么过电位下降？", {"answer": "问题：为什么过电位下降？"}, "copied_question"),
    ("Which values?", {"answer": "- pore volume: 3%\n- band gap: 4.0%"}, None),
]


def test_broken_pairs(spark):
    data = [(i, q, json.dumps(a, ensure_ascii=False)) for i, (q, a, _) in enumerate(PAIRS)]
    fenced = [(100, "What is it?", "```json\n" + json.dumps(PAIRS[0][1]) + "\n```"), (101, "What?", json.dumps(json.dumps(PAIRS[0][1]))), (102, "What?", '{"answer": "The yield'), (103, "What?", None), (104, None, json.dumps(PAIRS[0][1]))]
    logs = spark.createDataFrame(data + fenced + data[:3], "id bigint, question string, answer_json string")
    found = dict(rows(p3.broken_pairs(logs)))
    expected = {i: d for i, (_, _, d) in enumerate(PAIRS) if d} | {102: "truncated_answer", 103: "empty_answer"}
    assert found == expected
    assert p3.broken_pairs(logs.limit(0)).count() == 0


@pytest.mark.parametrize("answer", [
    "I do not feel comfortable discussing this topic.", "That goes against my guidelines.", "This is something I must leave unanswered.",
    "As a language model I do not have an opinion.", "Leider ist es mir nicht erlaubt, darauf einzugehen.", "No me está permitido hablar de eso.", "抱歉，我没有办法就此发表意见。",
])
def test_refusals_outside_the_list(answer):
    judge = p3.PairJudge()
    assert judge.defect("Which catalyst was used for the reaction?", json.dumps({"answer": answer})) == "refusal"


@pytest.mark.parametrize("answer", ["We did not find an effect of temperature on the yield.", "The authors do not discuss the yield.", "I would not use nickel; we measured higher yields with copper."])
def test_answers_with_a_negation_are_no_refusals(answer):
    assert p3.PairJudge().defect("Which catalyst was used for the reaction?", json.dumps({"answer": answer})) is None


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abc", max_size=20), st.text(alphabet="abc", max_size=20))
def test_suffix_automaton_against_search(text, other):
    for i, n in enumerate(p3.SuffixAutomaton(text).matches(other)):
        best = max(k for k in range(i + 2) if other[i + 1 - k : i + 1] in text)
        assert n == best


# --- 4 ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kind",
    [
        ("The alloy was heated under argon. It kept the yield of the first run.", "prose"),
        ("Data are available on request.", "prose"),
        ("No further activity was seen once the\nalloy had been kept under dry air for\nthe whole of the run at 20 K", "prose"),
        ("- spray drying\n- ion exchange\n- acid leaching", "list"),
        ("spray drying; ion exchange; acid leaching; thermal analysis; raman mapping", "list"),
        ("[1] Zab, L. Notes on foam. J. Rot. Stud. 65, 201–760 (2011)\n[2] Daf, T. Notes on film. J. Peh. Stud. 44, 260–802 (1997)", "list"),
        ("1.1 spray drying of foam ........ 3\n1.2 ion exchange ........ 7", "list"),
        ("| a | b |\n|---|---|\n| 1 | 2.5 |\n| 3 | 4 |", "table"),
        ("Run\tLoad\nS1\t3.4\nS2\tn.d.\n", "table"),
        ("Cell\nCycle\n44.7\nS242\n439\n–\n147\nS308\n795\n73.5", "table"),
        ("pore volume ....... 39.4%\nselectivity ..... 13.1%", "table"),
        ("Download PDF | Sign in | Cookie settings", "junk"),
        ("d2 b3 c9 8b c9 93 17 60 c3 0a\n6a 3b 6e 51 00 b4 de 11 25 a5", "junk"),
        ("(cid:16) (cid:248) (cid:12) (cid:152)", "junk"),
        ("==========\n=======\n====", "junk"),
        ("sxeu qfaevzazj kikncsb rkkead zqqefkeoisk opniqnpvamja azdlswrqjd ufbsuzr", "junk"),
        ("", "empty"),
        (None, "empty"),
    ],
)
def test_text_class(text, kind):
    assert p4.text_class(text) == kind


def test_filler_is_junk_by_the_repetition_figures(spark):
    boilerplate = (
        "By the use of this service you agree to the terms that are given in the notice of the publisher and to all of the rules "
        "which it may set out for readers at any later time, and you accept that no claim can be made against it for losses of any kind. "
    )
    short = "The alloy was heated in the furnace again. "
    other = "Samples were kept under a flow of dry argon for the night. "
    data = {
        1: short * 500,  # inside one line
        2: boilerplate * 20,  # a long sentence: no single n-gram covers much
        3: f"{short}\n{other}\n" * 20,  # two lines in turn
        4: f"{short}\n\n{other}\n\n" * 4,
        5: (short + other) * 30,
        6: short + other,
        7: boilerplate,
    }
    chunks = spark.createDataFrame(list(data.items()), "id bigint, text string")
    assert rows(p4.found(chunks)) == [(i, "junk") for i in range(1, 6)]


def test_the_class_needs_no_figures_and_is_that_of_quality(spark, monkeypatch):
    random.seed(4)
    lines = ["Menu", "Home | Search (3)", "Kupfer wurde für die Messung geprüft.", "a\t3.1\t4.5", "(cid:12)(cid:3)", "◊◊¤ x ¦¦", "- first item", "the alloy was heated in it and the alloy was cooled", "±5 µm — größe…", "qzxv wrtk jvbq xxzq"]
    texts = [random.choice(("\n", "\n\n", " ")).join(random.choices(lines, k=random.randint(1, 40))) for _ in range(600)] + [None, "", " \n"]
    expected = [p4.measured(t)[1] for t in texts]
    assert set(expected) == {"prose", "list", "table", "junk", "empty"}
    monkeypatch.setattr(p4, "_figures", None)  # p4_found makes none
    assert [p4.text_class(t) for t in texts] == expected


def test_quality(spark):
    long = "The alloy was heated in the furnace again. " * 5000
    data = [(1, "a b\na b\n\nThe end."), (2, None), (3, ""), (4, long), (1, "a b\na b\n\nThe end.")]
    chunks = spark.createDataFrame([(*r, 9) for r in data], "id bigint, text string, n_words int")
    by_id = {r.chunk_id: r for r in p4.quality(chunks).collect()}
    assert len(by_id) == 4
    assert by_id[1].n_words == 6 and round(by_id[1].duplicate_lines, 6) == round(1 / 3, 6) and round(by_id[1].line_end_share, 6) == round(1 / 3, 6)
    assert by_id[2].text_class == by_id[3].text_class == "empty" and by_id[2].n_words == 0
    assert by_id[4].n_words == 40000
    assert p4.quality(chunks.limit(0)).count() == 0


# --- 5 ----------------------------------------------------------------------


def scanned(spark, extra):
    prose = "The measured conductivity of the zirconium electrode depends on temperature during electrodeposition because oxygen-deficient surfaces react. "
    chunks = spark.createDataFrame([(i, "A/1", f"Start {prose * 5} end") for i in range(80)] + extra, "id bigint, paper_key string, text string")
    extracts = spark.createDataFrame([], "extract_id bigint, paper_key string, text string")
    articles = spark.createDataFrame([], "paper_key string, raw_body string")
    papers = spark.createDataFrame([("A/1", "Effects of temperature on zirconium electrodes", "x")], "paper_key string, title string, text string")
    return p5.records(extracts, articles, chunks), papers


SCAN = (
    "EFFECTS OF TEMPERATURE ON ..., page 7\nThe measured conduc-\ntivity of the zirconium electrode dcpends on tempe-\n— 7 —\n\n"
    "Effects of temperature on zirconium\nrature during electrodepositi0n because oxygen-\ndeficient surfaces react, both short-\nand long-term.\n\nThe electrode"
)


def test_noise_of_scanned_pages(spark):
    clean = "The measured conductivity of oxygen-\ndeficient surfaces.\n12\nThe electrode"
    texts, papers = scanned(spark, [(100, "A/1", SCAN), (101, "A/1", clean), (102, None, ""), (103, "A/1", None), (100, "A/1", SCAN)])
    found = rows(p5.noise(texts, papers), "record_key", "line_no", "noise", "token")
    assert found == sorted([
        ("100", 1, "running_header", "EFFECTS OF TEMPERATURE ON ..., page 7"), ("100", 2, "hyphen_break", "conductivity"), ("100", 3, "misread", "depends"),
        ("100", 3, "hyphen_break", "temperature"), ("100", 4, "page_number", "— 7 —"), ("100", 6, "running_header", "Effects of temperature on zirconium"),
        ("100", 7, "misread", "electrodeposition"), ("100", 7, "hyphen_break", "oxygen-deficient"),
    ])
    mended = dict(rows(p5.repaired(texts, papers), "record_key", "text"))["100"]
    assert mended.startswith("The measured conductivity of the zirconium electrode depends on temperature during electrodeposition because oxygen-deficient surfaces react")
    assert "page 7" not in mended and "short- and long-term." in mended


def test_every_sign_of_a_page_reaches_the_decoder(spark):
    title = "Effects of temperature on zirconium electrodes"
    signs = {
        200: (f"electrode surfaces react.\n{title}\nThe electrode depends.\n{title}\nThe electrode", [2, 4]),  # the title again
        201: ("electrode surfaces react.\nEFFECTS OF TEMPERATURE ON ZIRCONIUM\n12\nThe electrode", [2, 3]),
        202: ("electrode surfaces react.\nEffects of temperature on ...\n12\nThe electrode", [2, 3]),
        203: (f"electrode surfaces react.\n{title}   12\nThe electrode", [2]),
        204: (f"electrode surfaces react.\n12 | {title}\nThe electrode", [2]),
        205: ("electrode surfaces react.\nSeite 4\nThe electrode", [2]),
        206: ("electrode surfaces react.\n3 / 12\nThe electrode", [2]),
        207: ("electrode surfaces react.\npage 3 of 10\nThe electrode", [2]),
        208: ("electrode surfaces react.\r\n- 7 -\r\nThe electrode", [2]),
        209: ("electrode surfaces conduc-\r\ntivity of the electrode", [1]),
        210: (f"{title}\nThe electrode depends on temperature.\n12\nThe electrode", []),  # a title alone
    }
    texts, papers = scanned(spark, [(key, "A/1", text) for key, (text, _) in signs.items()])
    found = rows(p5.noise(texts, papers), "record_key", "line_no")
    assert found == sorted((str(key), line) for key, (_, lines) in signs.items() for line in lines)
    assert set(rows(p5.repaired(texts, papers).where("scanned"), "record_key")) == {(str(key),) for key in signs if key != 210}


def test_words_are_decoded_jointly(spark):
    text = (
        "— 7 —\nThe rneasured conducfivify depends on tempcrafure because\nzirconiumelectrode surfaces react dur ing electrodepositi0n, electr0depositi0n and con-\nducfivity of the electrode"
    )
    texts, papers = scanned(spark, [(100, "A/1", text), (101, "A/1", "Because surfacesreact, they")])
    found = rows(p5.noise(texts, papers).where("noise != 'page_number'"), "line_no", "noise", "token")
    assert found == sorted([
        (2, "misread", "measured"), (2, "misread", "conductivity"), (2, "misread", "temperature"), (3, "misread", "zirconium"), (3, "misread", "electrode"),
        (3, "misread", "during"), (3, "misread", "electrodeposition"), (3, "hyphen_break", "conductivity"), (3, "misread", "conductivity"),
    ])
    mended = dict(rows(p5.repaired(texts, papers), "record_key", "text"))
    assert mended == {"100": "The measured conductivity depends on temperature because zirconium electrode surfaces react during electrodeposition, electrodeposition and conductivity of the electrode"}


def test_counts_of_rare_words_reach_the_decoder():
    words = p5.Lexicon({"electrode": 40_000, "furnace": 30_000}, 30_000_000)
    decoder = p5.Decoder(words)
    assert decoder.judge("furnacc")[0] == "furnace"
    decoder.local = {"furnacc": 12}  # not above the stray rate, but too often for a misreading
    assert p5.Decoder(words).correction("furnacc") is not None and decoder.correction("furnacc")[1] < p5.Decoder(words).correction("furnacc")[1]


def test_decoder_has_one_rule_at_every_size():
    words = {"conductivity": 40, "electrode": 30, "membrane": 10, "turbine": 2, "furnace": 1}
    total = 2_700_000
    small = p5.Decoder(p5.Lexicon(words, total))
    large = p5.Decoder(p5.Lexicon({w: 10 * n for w, n in words.items()}, 10 * total))
    for read in ("conducfivity", "clectrode", "membranc", "furnacc", "qvzxkw"):
        assert (small.judge(read) is None) == (large.judge(read) is None)
    assert small.judge("furnacc") is None  # a single occurrence proves no word
    # more words of other kinds don't change what an unknown word costs
    many = p5.Decoder(p5.Lexicon(words | {f"s{i}": 1 for i in range(60_000)}, total))
    for word in ("turbinel", "turbines", "conductive", "qvzxkw"):
        assert many.cost(word) == small.cost(word)


def test_long_paragraphs_are_not_cut():
    lines = ["the electrode depends on the temperature and"] * 300
    page = p5.Page("\n".join(lines), None, p5.Decoder(p5.Lexicon({}, 1)))
    assert page._breaks(list(range(300))) == {0}


def test_no_scanned_pages(spark):
    texts, papers = scanned(spark, [])
    assert p5.noise(texts, papers).count() == 0
    assert p5.noise(texts.limit(0), papers).count() == 0


# --- 6 ----------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    items = [(i, passage(40, 1000 + i)) for i in range(6)] + [(50, "too short to leak"), (51, None)]
    r = random.Random(5)
    docs = []
    for d in range(60):
        text = passage(80, d)
        if d % 3 == 0:
            words = items[d % 6][1].split()
            n = r.randint(8, 30)
            start = r.randint(0, len(words) - n)
            text = f"{text}. {' '.join(words[start : start + n]).upper()}, {passage(20, d + 500)}"
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, items[0][1]), (903, items[0][1])]
    frame = spark.createDataFrame([(*d, "clash") for d in docs] + [(902, items[0][1], "clash")], "doc_id bigint, text string, item_id string")
    test = spark.createDataFrame(items + items[:1], "item_id bigint, passage string")
    expected = {}
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for i, p in items:
            v = WORD.findall((p or "").lower())
            best = max((k for a in range(len(w)) for b in range(len(v)) for k in [next((n for n in range(min(len(w) - a, len(v) - b), 11, -1) if w[a : a + n] == v[b : b + n]), 0)]), default=0)
            if best >= 12:
                expected[d, i] = best
    assert {(r_.doc_id, r_.item_id): r_.words for r_ in p6.leaks(frame, test).collect()} == expected
    kept = {r_.doc_id for r_ in p6.without_leaks(frame, test).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}
    assert p6.leaks(frame.limit(0), test).count() == 0 and p6.leaks(frame, test.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    docs = [(i, passage(30, i)) for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(i, t) for i, t in docs], "item_id bigint, passage string")
    whole = rows(p6.leaks(frame, items))
    monkeypatch.setattr(p6, "MAX_TEST_WORDS", 40)
    assert rows(p6.leaks(frame, items)) == whole and len(whole) == 6


# --- 7 ----------------------------------------------------------------------


def test_plan_mix():
    plan = p7.plan_mix({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4})
    assert plan.budget == 800 and plan.exponent == 0 and plan.quota == {"a": 400, "b": 400}
    tempered = p7.plan_mix({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, budget=1200)
    assert 0 < tempered.exponent < 1 and tempered.quota["b"] <= 400 and tempered.quota["a"] <= 1000
    assert sum(tempered.quota.values()) == pytest.approx(1200, abs=2)
    assert p7.plan_mix({}, {"a": 1.0}, {"a": 1}).quota == {}
    w = p7.temperature_weights({"a": 900, "b": 100}, p7.entropy({"a": 0.7, "b": 0.3}))
    assert p7.entropy(w) == pytest.approx(p7.entropy({"a": 0.7, "b": 0.3}), abs=1e-6)


def test_mixture(spark):
    docs = [(i, "Big", passage(20, i)) for i in range(200)] + [(1000 + i, " small ", passage(20, i)) for i in range(12)] + [(2000, None, "x"), (2001, "big", None), (2002, "other", "words here")]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = p7.mix(frame, targets, block_tokens=250)
    taken = mixed.rows.collect()
    assert {r.source for r in taken} == {"big", "small"}
    copies = {}
    for r in taken:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(n for d, n in copies.items() if d < 1000) == 1 and max(n for d, n in copies.items() if d >= 1000) <= 3
    report = {r.source: r for r in p7.report(mixed).collect()}
    assert report["small"].actual_share == pytest.approx(1 / 3, abs=0.05) and report["absent"].actual_share == 0
    assert sum(r.tokens for r in taken) == sum(r.taken_tokens for r in report.values())
    assert {tuple(r) for r in taken} == {tuple(r) for r in p7.mix(frame, targets, block_tokens=250).rows.collect()}
    assert p7.report(p7.mix(frame.limit(0), targets)).where("taken_tokens > 0").count() == 0


def test_permutation_of_the_mixture(spark):
    docs = [(i, "big" if i < 150 else "small", passage(5 + i % 30, i)) for i in range(180)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    for how in ({"budget": p7.ALL_TOKENS}, {"budget": p7.MEET_TARGETS}, {"budget": p7.ALL_TOKENS, "tempered": True}):
        mixed = p7.mix(frame, targets, block_tokens=300, **how)
        sizes = dict(rows(p7.token_counts(frame), "doc_id", "tokens"))
        of_source = {name: sum(sizes[d] for d, s, _ in docs if s == name) for name in ("big", "small")}
        for name, quota in mixed.plan.quota.items():
            assert quota <= of_source[name] * {"big": 1, "small": 3}[name]
            taken = sorted((r for r in mixed.rows.collect() if r.source == name), key=lambda r: (r["pass"], r.block, r.place))
            running = 0
            for r in taken:  # the order of blocks and places adds up, document by document
                running += r.tokens
                assert r.tokens == sizes[r.doc_id] and r.running_tokens == running and r.running_share == pytest.approx(running / quota)
            assert quota - max(sizes.values()) < running <= quota
            for k in range(1, quota // of_source[name] + 1):  # whole passes have every document once
                assert sorted(r.doc_id for r in taken if r["pass"] == k) == sorted(d for d, s, _ in docs if s == name)
            assert len({r.block for r in taken}) > 1 or quota < 300


def test_block_starts_in_two_levels(spark):
    sizes = spark.createDataFrame([("a", 1, b, 10 * b + 1) for b in range(23)], "source string, pass int, block bigint, size bigint")
    for at_once in (4, 5, 100):
        found = dict(rows(p7.block_starts(sizes, at_once), "block", "before"))
        assert found == {b: sum(10 * k + 1 for k in range(b)) for b in range(23)}


# --- 8 ----------------------------------------------------------------------


def test_reading_levels(spark):
    r = random.Random(9)
    pools = [VOCABULARY[60 * k : 60 * k + 90] for k in range(4)]

    def text(level):
        return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else r.choice(pools[level - 1]) for _ in range(120))

    docs = [(i, text(1 + i % 4)) for i in range(200)]
    labels = [(i, f"r{i % 3}", 1 + i % 4) for i in range(0, 80)] + [(3, "r9", None), (0, "r0", 1), (9999, "r1", 2)]
    others = [(500, "der die das und ist " * 20), (501, "the of and"), (502, None), (503, ""), (0, docs[0][1])]
    frame = spark.createDataFrame(docs + others, "doc_id bigint, text string")
    rated = spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    found = dict(rows(p8.found(frame, rated)))
    assert set(found) == {d for d, _ in docs}
    assert sum(found[d] == 1 + d % 4 for d, _ in docs if d >= 80) >= 0.9 * 120
    assert len(set(dict(rows(p8.found(frame, rated.limit(0)))).values())) == 1
    assert p8.found(frame.limit(0), rated).count() == 0
