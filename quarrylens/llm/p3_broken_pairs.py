"""Problem 3: logged question and answer pairs that are unusable, with the kind of defect.

Per pair: the suffix automaton of the question is traversed with the answer to measure how much
of the answer is copied; refusals are found by an Aho-Corasick automaton of phrases and, in short
answers, by how a refusal is built in each language; a stack of
delimiters tells strings, objects and brackets that were cut; and stopwords vote on languages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

#: Function words that vote for a language.
STOPWORDS = {
    "en": "the of and to in is was were are that with for on by as at from this these which than when what does how why which between not but no all used kept after under should we it its be been has have had would could can there their each both only",
    "de": "der die das und in ist war wurde wurden nicht mit auf bei den dem des ein eine einen wir im von für um zu nach sich ob oder weil danach als zur zum auch hoch welche welchen wie warum haben nahm diesen diesem kaum lang jede bleibt offen",
    "es": "el la los las de del y en es fue con por para una un que se no al lo como más mucho porque después entre sobre cada hasta este esta estos su sus qué cómo papel tienen subió bajó durante luego solo si",
    "fr": "le la les des du de et en est était été ont avec pour une un que qui dans sur par au aux plus nous cette ces ce se ne pas après pendant puis dont elle il sont leur à chaque entre ou si",
    "it": "il lo la gli le di del della e in è stato stata con per una un che si non al dopo più nel nella dei delle sono questo questa abbiamo",
    "pt": "o a os as de do da e em é foi com por para uma um que se não ao após mais no na dos das são este esta foram entre cada",
    "nl": "de het een van en in is was werd met op voor niet dat die bij zijn na door wij deze dit om te aan",
}
#: Phrases with which an answer is declined.
REFUSALS = [
    "can't help with", "cannot help with", "can not help with", "unable to help", "not able to answer", "unable to answer", "cannot answer", "can't answer", "can not answer",
    "won't be able to provide", "unable to provide", "cannot provide", "can't provide", "must decline", "have to decline", "i decline", "cannot assist", "can't assist", "unable to assist",
    "rather not answer", "prefer not to answer", "outside what i may discuss", "not allowed to discuss", "cannot comment", "can't comment", "i refuse to",
    "kann ich diese frage nicht beantworten", "kann diese frage nicht beantworten", "keine auskunft geben", "nicht beantworten", "kann ich nicht helfen", "kann dabei nicht helfen", "darf ich nicht", "darf ich dazu",
    "no puedo responder", "no es posible ayudar", "no puedo ayudar", "no me es posible", "no puedo proporcionar", "no estoy en condiciones de responder", "debo rechazar", "prefiero no responder",
    "je ne peux pas répondre", "je ne suis pas en mesure", "je ne peux pas aider",
    "无法回答", "不能提供这方面", "不能回答", "不便回答", "无法提供", "不能提供", "无可奉告", "拒绝回答",
]
#: How a refusal is built in each language: who speaks, that it is not done, and the verb of answering.
REFUSING = {
    "en": r"\b(?:i|we)\b[^.!?]{0,25}\b(?:not|never|unable|rather|decline|declining|refuse|refusing)\b[^.!?]{0,45}\b(?:answer|respond|repl|help|assist|discuss|comment|disclos|speculat|weigh in|engage|talk|opinion|advi[sc]e|answering)"
    r"|\b(?:against|outside|beyond) (?:my|our) (?:guidelines?|polic|principles|rules|remit|scope)|\b(?:i|we)\b[^.!?]{0,30}\bleave[^.!?]{0,20}\bunanswered|\bas an? (?:ai|language model|assistant)\b",
    "de": r"\b(?:ich|mir|wir|uns)\b[^.!?]{0,40}\b(?:nicht|keine?n?)\b[^.!?]{0,50}\b(?:beantwort|antwort|eingeh|einzugehen|äußer|helf|auskunft|stellung|meinung|besprech|weitergeb)|\bals sprachmodell\b",
    "es": r"\bno\b[^.!?]{0,12}\b(?:puedo|podemos|debo|me|nos|estoy|quiero|voy)\b[^.!?]{0,40}\b(?:respond|contest|ayud|hablar|coment|opin|tratar|facilit)|\bcomo modelo de lenguaje\b",
    "fr": r"\bje\b[^.!?]{0,15}\b(?:peux|puis|dois|souhaite|veux|suis)\b[^.!?]{0,10}\bpas\b[^.!?]{0,40}\b(?:répond|aider|comment|parler|discut|avis)",
    "zh": r"(?:我|本人|抱歉|对不起)[^。！？]{0,14}(?:不|无法|没有办法|拒绝)[^。！？]{0,10}(?:回答|答复|讨论|评论|协助|帮助|透露|发表意见)|作为(?:一个)?(?:语言模型|人工智能)",
}
#: Up to how many words, or CJK characters, an answer is nothing but a refusal; longer ones answer something as well.
REFUSAL_WORDS = 40

#: Labels and placeholders, in which nothing is answered.
LABELS = ["answer", "antwort", "respuesta", "réponse", "答案", "回答", "frage", "question", "pregunta", "问题", "n/a", "na", "null", "none", "nil", "unknown", "tbd", "-"]

_CITATION = re.compile(r"\[\d+(?:\s*[,;–-]\s*\d+)*\]")
_CJK = re.compile(r"[㐀-鿿]")
_LATIN = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_INVISIBLE = re.compile(r"[​-‏﻿⁠­]")
_REFUSING = [re.compile(form) for form in REFUSING.values()]
_VOTES = {word: [lang for lang, words in STOPWORDS.items() if word in words.split()] for words in STOPWORDS.values() for word in words.split()}


class SuffixAutomaton:
    """The suffix automaton of a text; ``matches`` gives the longest suffix match at each position."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def matches(self, text: str) -> Iterator[int]:
        state = length = 0
        for ch in text:
            while state and ch not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if ch in self.next[state]:
                state = self.next[state][ch]
                length += 1
            else:
                length = 0
            yield length


def _letters(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isalnum())


def copied_share(question: str, answer: str, least: int) -> float:
    """Share of the answer's letters and digits in substrings of the question of ``least`` or more."""
    q, a = _letters(question), _letters(answer)
    if not q or not a:
        return 0.0
    covered = start = 0
    for i, n in enumerate(SuffixAutomaton(q).matches(a)):
        if n >= least:
            begin = max(start, i + 1 - n)
            covered += i + 1 - begin
            start = i + 1
    return covered / len(a)


def unclosed(text: str) -> list[str]:
    """What is open at the end of a JSON text: braces, brackets and ``"`` for a string."""
    stack: list[str] = []
    escaped = False
    for ch in text:
        if stack and stack[-1] == '"':
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                stack.pop()
        elif ch in '{["':
            stack.append(ch)
        elif ch in "}]" and stack:
            stack.pop()
    return stack


def parse_answer(raw: str | None) -> tuple[str | None, str, bool]:
    """``(answer, uncertainty, cut)`` of an answer_json, fenced, escaped or cut as it may be."""
    if raw is None or not raw.strip():
        return None, "", False
    body = _FENCE.sub("", raw.strip())
    for _ in range(3):
        try:
            value = json.loads(body, strict=False)
        except ValueError:
            break
        if isinstance(value, dict):
            answer, unsure = value.get("answer"), value.get("uncertainty")
            return (None if answer is None else answer if isinstance(answer, str) else json.dumps(answer)), unsure if isinstance(unsure, str) else "", False
        if not isinstance(value, str):
            return json.dumps(value), "", False
        body = _FENCE.sub("", value.strip())
    else:
        return body, "", False
    if not body.startswith(("{", '"', "[")):
        return body, "", False
    stack = unclosed(body)
    found = re.search(r'\\*"answer\\*"\s*:\s*\\*"((?:[^"\\]|\\.)*)', body, re.S)
    return (found.group(1) if found else None), "", bool(stack)


def language_votes(text: str) -> dict[str, float]:
    """Votes by language; a CJK character counts for zh as half a word."""
    votes: dict[str, float] = {}
    words = _LATIN.findall(_CJK.sub(" ", text.lower()))
    for word in words:
        for lang in _VOTES.get(word, ()):
            votes[lang] = votes.get(lang, 0.0) + 1.0
    cjk = len(_CJK.findall(text))
    if cjk:
        votes["zh"] = 0.5 * cjk
    return votes


def language(text: str) -> tuple[str | None, dict[str, float]]:
    votes = language_votes(text)
    if not votes:
        return None, votes
    best = max(sorted(votes), key=lambda k: votes[k])
    return best, votes


def says_nothing(answer: str | None) -> bool:
    """No letter or digit but those of a label or placeholder, and citations."""
    if answer is None:
        return True
    bare = _CITATION.sub(" ", _INVISIBLE.sub("", answer)).lower()
    left = "".join(ch if ch.isalnum() or ch == "/" else " " for ch in bare).split()
    return all(word.strip("/") in LABELS or word == "/" or word in LABELS for word in left)


def ends_open(answer: str) -> bool:
    """Whether the text stops within a sentence, a word or a bracket."""
    text = _INVISIBLE.sub("", answer).rstrip()
    cited = _CITATION.sub("", text).rstrip()
    if text != cited and text.endswith("]"):
        return False
    last = text.split("\n")[-1].strip()
    if re.match(r"^(?:[-*•·]|\d+[.)])\s", last):
        return not re.search(r"[\w%)\].°]$", last)
    if text[-1] in ".!?。！？…":
        return text.endswith(("...", "…"))
    if text[-1] in "\"”’»)）」』]*`":
        inner = text.rstrip("\"”’»)）」』]*` ")
        pairs = [("(", ")"), ("（", "）"), ("“", "”"), ("«", "»"), ("「", "」")]
        return not inner or any(text.count(a) > text.count(b) for a, b in pairs)
    # a bare value is a whole answer
    return not re.fullmatch(r"[-+~≈<>]?\s*\d[\d.,]*\s*(?:%|[^\W\d]{1,3}|°C|mol/L)?", text)


class PairJudge:
    """Judges pairs one by one; the automata are built once for a task."""

    def __init__(self):
        import ahocorasick

        self.refusals = ahocorasick.Automaton()
        for phrase in REFUSALS:
            self.refusals.add_word(phrase, phrase)
        self.refusals.make_automaton()

    def refuses(self, text: str) -> bool:
        plain = text.lower().replace("’", "'").replace("n't", " not")
        if next(self.refusals.iter(text.lower().replace("’", "'")), None) is not None:
            return True
        if _CITATION.search(text) or len(_CJK.findall(plain)) + len(_LATIN.findall(_CJK.sub(" ", plain))) > REFUSAL_WORDS:
            return False
        return any(form.search(plain) for form in _REFUSING)

    def defect(self, question: str | None, raw: str | None) -> str | None:
        question = question or ""
        answer, unsure, cut = parse_answer(raw)
        if cut:
            return "truncated_answer"
        if says_nothing(answer):
            return "refusal" if self.refuses(unsure) else "empty_answer"
        if self.refuses(answer):
            return "refusal"
        cjk = bool(_CJK.search(question))
        if copied_share(question, answer, 6 if cjk else 14) >= (0.6 if cjk else 0.75):
            return "copied_question"
        asked, _ = language(question)
        said, votes = language(answer)
        if asked and said and said != asked and votes[said] >= 2 and votes[said] > 2 * votes.get(asked, 0.0):
            return "other_language"
        return "truncated_answer" if ends_open(answer) else None


def broken_pairs(logs: DataFrame) -> DataFrame:
    """``(log_id, defect)`` of the logs ``(id, question, answer_json)`` that are defective.

    Defects are tested in the order cut JSON, nothing said, refusal, copied question, other
    language, open end, and the first that holds is given.  A null answer says nothing, a null
    question can't be copied; repeated rows of an id give one row.
    """
    logs = need(logs, ["id", "question", "answer_json"], "broken_pairs").where("id is not null")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = PairJudge()
        for batch in batches:
            found = [judge.defect(q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = pa.array([d is not None for d in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["log_id", "defect"]).filter(keep)

    return logs.mapInArrow(judge, "log_id bigint, defect string").groupBy("log_id").agg(F.min("defect").alias("defect"))


def defect_report(logs: DataFrame) -> DataFrame:
    """``(qa_mode, defect, pairs)``: how often each defect occurs in each mode."""
    broken = broken_pairs(logs)
    modes = need(logs, ["id", "qa_mode"], "defect_report").groupBy("id").agg(F.min("qa_mode").alias("qa_mode"))
    return (
        modes.join(broken, F.col("id") == F.col("log_id"), "left")
        .groupBy("qa_mode", F.coalesce("defect", F.lit("none")).alias("defect"))
        .agg(F.count(F.lit(1)).alias("pairs"))
    )
