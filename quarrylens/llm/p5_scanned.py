"""Problem 5: noise in text from scanned pages, and its repair into running paragraphs.

A channel model decodes each record: words come from a lexicon counted over all texts, and a
page turns them into what is read by dividing a word at a line's end, losing or adding blanks,
and confusing groups of letters, any number of them in a word.  The decoder takes the page
furniture out, strings the lines together and finds the cheapest words behind the stream by one
dynamic program over divided, joined, split and misread words; the rows of noise are those of
its path.  Another dynamic program chooses the paragraph boundaries.

The lexicon holds every word above a stray rate, which no more than 2.5 million words can have.
Only those can be what a misreading stands for, so nothing is lost by sending no others; how
often rarer words of a record occur is joined to the record from the vocabulary.

Only records with a sign of scanning are decoded, and what is found in one counts only if the
record as a whole shows that it was scanned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, need

#: Letter groups that recognition confuses, (right, read).
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("i", "!"), ("o", "0"), ("l", "1"), ("s", "5"), ("d", "cl"), ("u", "ii"), ("m", "rn"),
    ("h", "b"), ("g", "q"), ("ri", "n"), ("b", "6"), ("w", "vv"), ("cl", "d"), ("li", "h"),
)
#: Words that follow a suspended hyphen ("short- and long-term").
SUSPENDED = frozenset("and or to und oder bis y o et ou".split())
#: Occurrences in a million words that are more than stray ones; at most 2.5 million words have more.
STRAY = 0.4

_EDGE = ".,;:()[]{}\"'“”‘’«»?…*|~<>"
_FRAGMENTS = re.compile(r"\S+[-‐­]\n\s*\S+")
_WORDLIKE = re.compile(r"[a-z]+(?:-[a-z]+)*")
_READ = re.compile(r"(?=.*[a-z].*[a-z])[a-z0156!](?:-?[a-z0156!])*(?<!!)|(?=.*[a-z].*[a-z])[a-z0156!]+!$")
_PAGE_SURE = re.compile(r"\s*(?:[—–·•\-~]\s*\d{1,4}\s*[—–·•\-~]|\[\d{1,4}\]|(?:page|pag\.|seite|p\.)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4})\s*", re.I)
_PAGE_BARE = re.compile(r"\s*(?:\d{1,4}|[ivxlc]{1,7})\s*")
_HEAD_MARKS = (
    re.compile(r"~ (?P<core>\S.*\S) ~"),
    re.compile(r"(?P<core>\S.*\S), page \d{1,4}", re.I),
    re.compile(r"(?P<core>\S.*?\S)\s+\|\s+\d{1,4}"),
    re.compile(r"\d{1,4}\s{2,}(?P<core>[A-Za-z]\S*.*\S)"),
    re.compile(r"(?P<core>[A-Za-z].*\S)\s{3,}\d{1,4}"),
    re.compile(r"\d{1,4}\s+\|\s+(?P<core>\S.*\S)"),
)
_JOURNAL = re.compile(r"[A-Z]\w+(?: [A-Z]\w+)* (?:letters|journal|annals|transactions|reports|proceedings) (?:of|on) \S.*", re.I)
_DIVIDED = re.compile(r"[^\W\d_][-‐­][^\S\n]*\n")
#: The confusions that leave no letters, (read, right).
_SIGNS = tuple((read, right) for right, read in CONFUSIONS if not read.isalpha() and len(right) == 1)
_SIGN_CHARS = "".join(read for read, _ in _SIGNS)
_SIGN_LETTERS = str.maketrans(dict(_SIGNS))
_SKELETON = (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("ri", "n"))
_SKELETON_ONE = str.maketrans("cfqb01!56", "etghoilsh")


def records(extracts: DataFrame, articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(origin, record_key, paper_key, text)`` of the three tables; null keys and texts are left out."""
    parts = [
        need(extracts, ["extract_id", "paper_key", "text"], "records").select(F.lit("pdf_extract").alias("origin"), F.col("extract_id").cast("string").alias("record_key"), "paper_key", "text"),
        need(articles, ["paper_key", "raw_body"], "records").select(F.lit("raw_body").alias("origin"), F.col("paper_key").alias("record_key"), "paper_key", F.col("raw_body").alias("text")),
        need(chunks, ["id", "paper_key", "text"], "records").select(F.lit("chunk").alias("origin"), F.col("id").cast("string").alias("record_key"), "paper_key", "text"),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.where("record_key is not null and text is not null")


@dataclass(frozen=True)
class Lexicon:
    """Counts of the words above ``STRAY``, and the occurrences of all words."""

    counts: dict[str, int]
    total: int
    #: The words of ``counts`` that are more likely misreadings: (right word, gain in nats).
    misread: dict[str, tuple[str, float]] = field(default_factory=dict)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)``: how often each lower-case word, with its own hyphens, occurs in the texts.

    Words divided at a line's end and the possibly cut first and last word of a text don't count.
    Each task sums its own texts first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()

        def flush() -> pa.RecordBatch:
            clean: Counter = Counter()
            for token, n in raw.items():
                word = token.strip(_EDGE).lower()
                if word and len(word) < 64 and any(c.isalpha() for c in word):
                    clean[word] += n
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string()), pa.array(list(clean.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if "-\n" in text:
                    text = _FRAGMENTS.sub(" ", text)
                raw.update(text.split()[1:-1])
            if len(raw) > 2_000_000:
                yield flush()
        yield flush()

    return texts.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(vocabulary: DataFrame) -> Lexicon:
    """The lexicon of a vocabulary ``(word, n)``, its own misreadings found in tasks; under 2.5 million words reach the driver."""
    total = vocabulary.agg(F.sum("n")).first()[0] or 1
    frequent = vocabulary.where(F.col("n") > max(1.0, STRAY * total / 1e6))
    rows = frequent.toArrow()
    known = Lexicon(dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist())), total)
    shared = vocabulary.sparkSession.sparkContext.broadcast(known)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            found = [(w, *f) for w in batch.column(0).to_pylist() if (f := decoder.judge(w)) is not None]
            words, rights, gains = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(rights, pa.string()), pa.array(gains, pa.float64())], names=["word", "right", "gain"])

    misread = frequent.select("word").mapInArrow(judge, "word string, right string, gain double").collect()
    shared.destroy()
    return Lexicon(known.counts, total, {r.word: (r.right, r.gain) for r in misread})


def skeleton(text: str) -> str:
    """Letters in lower case with confusable ones made alike, so that a misread title still matches."""
    text = "".join(c for c in text.lower() if c.isalnum() or c == "!")
    for read, right in _SKELETON:
        text = text.replace(read, right)
    return text.translate(_SKELETON_ONE)


@dataclass
class Noise:
    line: int
    kind: str
    token: str


class Decoder:
    """Reads words with one lexicon; words that were judged are remembered.

    ``local`` has the counts of rarer words of the record at hand.
    """

    #: Costs in nats: a confusion that leaves no letters, one that does, dividing a word, and a word not in the lexicon.
    SURE, LIKELY, BREAK, UNKNOWN = 1.5, 5.0, 1.0, 2.0
    #: Occurrences in a million words that make a part with an own hyphen, a joined word, a split part and a common word.
    STRAY, PART, JOINED, SPLIT, COMMON = STRAY, 0.8, 1.9, 7.4, 18.4

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.counts, self.misread, self.log_total = lexicon.counts, lexicon.misread, log(lexicon.total + 1)
        self.local: dict[str, int] = {}
        self.millions = lexicon.total / 1e6
        self.trigrams: Counter = Counter()  # occurrences of the words that have them
        for word, n in self.counts.items():
            if _WORDLIKE.fullmatch(word):
                for part in set(self._trigrams(word)):
                    self.trigrams[part] += n
        self.words = sorted(w for w, n in self.counts.items() if self.above(n, self.STRAY) and _WORDLIKE.fullmatch(w))
        self.cheapest = self.log_total - log(max(self.counts.values(), default=1))
        self.undone: dict[str, list[tuple[str, str, float]]] = {}
        for right, read in CONFUSIONS:
            self.undone.setdefault(read[0], []).append((read, right, self.SURE if not read.isalpha() else self.LIKELY))
        self.memo: dict[tuple[str, int], tuple[str, float] | None] = {}
        self.apart: dict[str, tuple[float, tuple[str, str]] | None] = {}

    @staticmethod
    def _trigrams(word: str) -> list[str]:
        padded = f"^{word}$"
        return [padded[i : i + 3] for i in range(len(padded) - 2)]

    def above(self, n: int, rate: float) -> bool:
        """Whether ``n`` occurrences are more than ``rate`` in a million words, and more than one."""
        return n > max(1.0, rate * self.millions)

    def count(self, word: str) -> int:
        return self.counts.get(word) or self.local.get(word, 0)

    def frequent(self, word: str, rate: float) -> bool:
        return self.above(self.counts.get(word, 0), rate)

    def cost(self, word: str, seen_here: int = 0) -> float:
        """Nats of a lower-case word; ``seen_here`` occurrences are its own and prove nothing."""
        own = self.count(word)
        if own > seen_here:
            return self.log_total - log(own - seen_here)
        rare = sum(not self.above(self.trigrams[part] - own, self.STRAY) for part in self._trigrams(word))
        return self.log_total + self.UNKNOWN + 2.5 * min(rare, 3)

    def correction(self, token: str) -> tuple[str, float] | None:
        """``(right word, gain in nats)`` of a bare token that is cheaper with confusions undone."""
        low = token.lower()
        if low in self.counts:
            found = self.misread.get(low)
        else:
            key = low, self.local.get(low, 0)
            if key not in self.memo:
                if len(self.memo) > 1_000_000:
                    self.memo.clear()
                self.memo[key] = self.judge(low)
            found = self.memo[key]
        return None if found is None or token.isupper() else (self._cased(token, found[0]), found[1])

    @staticmethod
    def _cased(token: str, right: str) -> str:
        return right[0].upper() + right[1:] if token[0].isupper() else right

    def readings(self, low: str, most: float) -> Iterator[tuple[float, str]]:
        """``(price, word)`` of the words of the lexicon that confusions of a price up to ``most`` turn into ``low``."""
        stack = [(0, "", 0.0)]
        while stack:
            at, made, price = stack.pop()
            if at == len(low):
                if price and self.frequent(made, self.STRAY):
                    yield price, made
                continue
            ways = [(read, right, more) for read, right, more in self.undone.get(low[at], ()) if price + more <= most and low.startswith(read, at)]
            ways.append((low[at], low[at], 0.0))
            for read, right, more in ways:
                prefix = made + right
                # with letters read for letters only a word of the lexicon explains the reading
                k = bisect_left(self.words, prefix)
                if k < len(self.words) and self.words[k].startswith(prefix):
                    stack.append((at + len(read), prefix, price + more))

    def judge(self, low: str) -> tuple[str, float] | None:
        """``(right word, gain)`` of a lower-case word, or None if it is best left as it is."""
        if len(low) < 4 or not _READ.fullmatch(low):  # shorter words are readings of too many others
            return None
        now = self.cost(low, 1)
        most = now - self.cheapest
        if most <= self.SURE:
            return None
        options = [(price + self.cost(word), word) for price, word in self.readings(low, most)]
        # signs within a word that no letters are, whether or not the lexicon has the word behind them
        for read, right in _SIGNS:
            if read in low[1:-1] and _WORDLIKE.fullmatch(word := low[0] + low[1:-1].replace(read, right) + low[-1]):
                options.append((self.SURE * low[1:-1].count(read) + self.cost(word), word))
        if sum(c in low[1:-1] for c, _ in _SIGNS) > 1 and _WORDLIKE.fullmatch(word := low[0] + low[1:-1].translate(_SIGN_LETTERS) + low[-1]):
            options.append((self.SURE * sum(map(low[1:-1].count, _SIGN_CHARS)) + self.cost(word), word))
        best = min(options, default=None)
        return None if best is None or best[0] >= now else (best[1], now - best[0])

    def split(self, low: str) -> tuple[float, tuple[str, str]] | None:
        """The cheapest two words that a lost blank and confusions in one of them make into ``low``, with their cost."""
        if low in self.apart:
            return self.apart[low]
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        options = []
        for at in range(2, len(low) - 1) if len(low) >= 5 and low.isalpha() else ():
            a, b = low[:at], low[at:]
            sure = self.frequent(a, self.SPLIT), self.frequent(b, self.SPLIT)
            if all(sure):
                options.append((self.LIKELY + self.cost(a) + self.cost(b), (a, b)))
            elif any(sure):
                known, other = (a, b) if sure[0] else (b, a)
                most = self.cost(low) - self.LIKELY - self.cost(known) - self.cheapest
                for price, word in self.readings(other, most) if most >= self.LIKELY and len(other) >= 4 else ():
                    if self.frequent(word, self.SPLIT):
                        options.append((self.LIKELY + price + self.cost(known) + self.cost(word), (a, word) if sure[0] else (word, b)))
        self.apart[low] = min(options, default=None)
        return self.apart[low]

    def join(self, lows: list[str], both_odd: bool) -> tuple[float, str] | None:
        """The word that added blanks and confusions make into ``lows``, with its cost."""
        whole, blanks = "".join(lows), self.LIKELY * (len(lows) - 1)
        options = [(blanks + self.cost(whole), whole)] if self.frequent(whole, self.JOINED) else []
        if both_odd:
            most = sum(map(self.cost, lows)) - blanks - self.cheapest
            options += [(blanks + price + self.cost(word), word) for price, word in self.readings(whole, most) if self.frequent(word, self.JOINED)]
        return min(options, default=None)

    def odd(self, low: str) -> bool:
        """Whether a bare word may not be what was printed."""
        return low in self.misread if low in self.counts else _READ.fullmatch(low) is not None

    def bare(self, token: str) -> str:
        return token.strip(_EDGE + "!") if token.rstrip(_EDGE).endswith("!") else token.strip(_EDGE)

    def word(self, token: str) -> tuple[str, float, float]:
        """``(right word, cost, gain)`` of a bare token."""
        fixed = self.correction(token)
        if fixed is None:
            return token, self.cost(token.lower()), 0.0
        return fixed[0], self.cost(fixed[0].lower()), fixed[1]

    def whole(self, head: str, tail: str) -> tuple[str, bool, float]:
        """``(word, divided, gain)`` of the parts before and after a hyphen at a line's end."""
        options = []
        for joined, own in ((head + tail, False), (f"{head}-{tail}", True)):
            right, cost, gain = self.word(joined)
            known = self.count(right.lower()) > 0
            # an own hyphen needs both parts to be words, else the hyphen is the page's
            parts = own and all(self.frequent(p.lower(), self.PART) for p in (head.split("-")[-1], tail))
            options.append((cost + (0 if known else 0 if (own and parts) else 1.0 if not own else 4.0), own, right, gain))
        cost, own, right, gain = min(options)
        return right, not own, gain


def _header_core(line: str) -> tuple[str, bool]:
    """The text of a possible running header and whether its form alone tells."""
    text = line.strip()
    for mark in _HEAD_MARKS:
        found = mark.fullmatch(text)
        if found and sum(c.isalpha() for c in found["core"]) >= 6:
            return found["core"], True
    if _JOURNAL.fullmatch(text) and len(text) < 90:
        return text, True
    letters = [c for c in text if c.isalpha()]
    if len(letters) >= 8 and len(text.split()) >= 2 and sum(c.isupper() for c in letters) >= 0.95 * len(letters):
        return text, True
    return text, False


def _shape(core: str) -> str:
    return skeleton(core.replace("...", "").replace("…", ""))


def _shortened(core: str) -> bool:
    return core.endswith(("...", "…"))


def _marks(lines: list[str]) -> Iterator[tuple[int, str, str, bool]]:
    """``(index, form, core, marked)`` of the lines that can be furniture.

    The form is page_number, bare (a number that its neighbours decide on), header, or title for
    what is a header only if it repeats the paper's title.
    """
    for i, line in enumerate(lines):
        text = line.strip()
        if not text or len(text) > 160 or text[0] == "#":
            continue
        if _PAGE_SURE.fullmatch(line):
            yield i, "page_number", text, True
        elif text[0].islower() and len(text) > 7:
            continue
        elif _PAGE_BARE.fullmatch(line):
            yield i, "bare", text, False
        elif text[-1] not in ".,;" or text.endswith("..."):
            core, marked = _header_core(line)
            sure = _JOURNAL.fullmatch(core) or marked and (text[0] == "~" or re.search(r", page \d+$", text, re.I))
            yield i, "header" if sure else "title", core, marked


def _furnished(lines: list[str]) -> bool:
    """Whether lines can be a sign of scanning under some title: the tests of ``Page`` with the title left open."""
    plain = []
    for _, form, core, marked in _marks(lines):
        if form == "page_number" or form != "bare" and marked:
            return True
        if form == "header":
            plain.append("")
        elif form == "title":
            if _shortened(core):
                return True
            plain.append(core)
    if len(plain) < 2:
        return False
    # two lines can begin the same title only if one begins the other
    shapes = sorted(x[: max(8, len(x) - 1)] for core in plain if not core or len(x := _shape(core)) >= 8) if "" not in plain else [""] * 2
    return any(b.startswith(a) for a, b in zip(shapes, shapes[1:]))


def _split(text: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]


@dataclass(frozen=True)
class _Token:
    """A word of the stream: line, content index, text, bare text, whether it is cut off, and the second part if it is divided."""

    line: int
    at: int
    text: str
    bare: str
    cut: bool
    tail: str | None
    rest: str


class Page:
    """One record: its lines by kind, its divided words and its misreadings."""

    def __init__(self, text: str, title: str | None, decoder: Decoder):
        self.lines = _split(text)
        self.decoder = decoder
        self.kind = ["blank" if not x.strip() else "text" for x in self.lines]
        self.signs = 0
        self._furniture(skeleton(title or ""))
        self._words()

    def _furniture(self, title: str) -> None:
        weak, plain = [], 0
        for i, form, core, marked in _marks(self.lines):
            if form == "page_number":
                self.kind[i] = "page_number"
                self.signs += 1
            elif form == "bare":
                weak.append(i)
            else:
                shape = _shape(core)
                of_title = len(shape) >= 8 and title.startswith(shape[: max(8, len(shape) - 1)])
                if not (of_title or form == "header"):
                    continue
                self.kind[i] = "running_header"
                plain += not marked
                # a title by itself may be that of a text that was never printed; a second or a shortened one is not
                self.signs += marked or plain > 1 or _shortened(core) and len(shape) < len(title)
        # a bare number is a page number if it stands alone, not in a run of values
        for i in weak:
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(self.lines) and self.kind[j] != "blank"]
            if any(j in weak or len(self.lines[j].split()) == 1 and re.search(r"\d|n\.d\.|^\W$", self.lines[j]) and self.kind[j] == "text" for j in near):
                continue
            self.kind[i] = "page_number"

    def _words(self) -> None:
        """Decodes the stream of the text lines' words: ``units`` ``[content index, shown]`` and ``noise``."""
        content = [i for i, k in enumerate(self.kind) if k == "text"]
        self.units: list[tuple[int, str]] = []
        self.noise: list[Noise] = []
        tokens = {i: self.lines[i].split() for i in content}
        stream: list[_Token] = []
        held: int | None = None
        for at, i in enumerate(content):
            words = tokens[i]
            following = content[at + 1] if at + 1 < len(content) else None
            for k, token in enumerate(words):
                if k == 0 and held == i:
                    continue
                last = k == len(words) - 1
                tail = self._tail(token, tokens[following]) if last and following is not None else None
                cut = i == content[0] and k == 0 or i == content[-1] and last  # perhaps only part of a word
                stream.append(_Token(i, at, token, self.decoder.bare(token), cut, tail, tokens[following][0] if tail else ""))
                if tail:
                    held = following
        self._decode(stream)
        for i, k in enumerate(self.kind):
            if k == "running_header":
                for token in self.lines[i].split():
                    self._read(token, self.decoder.bare(token), i + 1)

    @staticmethod
    def _tail(token: str, after: list[str]) -> str | None:
        """The bare second part if ``token`` is the first part of a word divided before ``after``."""
        if not re.search(r"[^\W\d_][-‐­]$", token) or not token.lstrip(_EDGE)[:-1]:
            return None
        rest = after[0]
        tail = rest.rstrip(_EDGE + "!") if not rest.rstrip(_EDGE).endswith("!") else rest.rstrip(_EDGE)
        tail = tail.strip("-") if tail.endswith("-") and len(after) == 1 else tail
        return tail if tail and (tail[0].islower() or tail[0] in "!0156") and tail.lower() not in SUSPENDED else None

    def _decode(self, stream: list[_Token]) -> None:
        """Stretches of odd words, with a neighbour on each side that a word may go on in, are read as a whole."""
        decoder, n = self.decoder, len(stream)
        lows = [t.bare.lower() for t in stream]
        odd = [not t.cut and t.tail is None and decoder.odd(low) for t, low in zip(stream, lows)]
        i = 0
        while i < n:
            if not odd[i] and not (i + 1 < n and odd[i + 1]):
                self._take(stream[i], None)
                i += 1
                continue
            j = i + 1
            while j < n and odd[j]:
                j += 1
            j = min(n, j + 1) if odd[j - 1] else j
            # the last neighbour may also be the first of the next stretch
            if j < n and not odd[j - 1] and odd[j]:
                j -= 1
            j = max(j, i + 1)
            self._stretch(stream[i:j], lows[i:j], odd[i:j])
            i = j

    def _stretch(self, tokens: list[_Token], lows: list[str], odd: list[bool]) -> None:
        """The cheapest words behind the tokens: each as it is or with confusions undone, two or three joined, or one split."""
        decoder, n = self.decoder, len(tokens)
        joinable = [not t.cut and t.tail is None and low.isalpha() for t, low in zip(tokens, lows)]
        best: list[tuple] = [(0.0, -1, "", ())] + [(float("inf"),)] * n
        for i in range(1, n + 1):
            token, low = tokens[i - 1], lows[i - 1]
            fixed = decoder.correction(token.bare) if odd[i - 1] else None
            own = decoder.cost(low, 1)
            options = [(best[i - 1][0] + own - (fixed[1] if fixed else 0.0), i - 1, "one", fixed or ())]
            if odd[i - 1] and fixed is None and joinable[i - 1] and not token.bare.isupper() and low not in decoder.counts:
                parts = decoder.split(low)
                if parts is not None and token.text.startswith(token.bare):
                    options.append((best[i - 1][0] + parts[0], i - 1, "split", parts[1]))
            for k in (2, 3):
                first = i - k
                if first < 0 or not all(joinable[first:i]) or not any(odd[first:i]) or any(t.text != t.bare for t in tokens[first : i - 1]):
                    continue
                whole = decoder.join(lows[first:i], k == 2 and all(odd[first:i]))
                if whole is not None and token.text.startswith(token.bare):
                    options.append((best[first][0] + whole[0], first, "join", (whole[1],)))
            best[i] = min(options, key=lambda o: o[0])
        path, i = [], n
        while i > 0:
            path.append((best[i][1], i, best[i][2], best[i][3]))
            i = best[i][1]
        for first, i, how, words in reversed(path):
            token = tokens[i - 1]
            if how == "one":
                self._take(token, words or None)
                continue
            begin = tokens[first]
            right = [decoder._cased(begin.bare, w) if w[0] == begin.bare[0].lower() else w for w in words[:1]] + list(words[1:])
            self.units.append((begin.at, " ".join(right) + token.text[len(token.bare) :]))
            if begin.line == token.line:
                self.noise.extend(Noise(begin.line + 1, "misread", w) for w in right)

    def _take(self, token: _Token, fixed: tuple[str, float] | None) -> None:
        """One token by itself, with its reading, or with the second part of a divided word."""
        decoder = self.decoder
        if token.tail is None:
            self.units.append((token.at, self._read(token.text, token.bare, token.line + 1, fixed) if fixed else token.text))
            return
        head = token.text.lstrip(_EDGE)[:-1]
        right, divided, gain = decoder.whole(head, token.tail)
        self.noise.append(Noise(token.line + 1, "hyphen_break", right))
        if gain > 0:
            self.noise.append(Noise(token.line + 1, "misread", right))
        if divided and decoder.count(right.lower()) > 0 or gain > 3:
            self.signs += 1
        lead = token.text[: len(token.text) - len(token.text.lstrip(_EDGE))]
        self.units.append((token.at, lead + right + token.rest[len(token.tail) :]))

    def _read(self, token: str, bare: str, line: int, fixed: tuple[str, float] | None = None) -> str:
        fixed = fixed or (self.decoder.correction(bare) if bare else None)
        if fixed is None:
            return token
        right, gain = fixed
        if re.search(r"[!0156]", bare) or gain > 2 and self.decoder.frequent(right.lower(), Decoder.COMMON):
            self.signs += 1
        self.noise.append(Noise(line, "misread", right))
        return token.replace(bare, right, 1)

    def found(self) -> list[Noise]:
        """All noise in order of lines, or none if nothing shows that the record was scanned."""
        if not self.signs:
            return []
        furniture = [Noise(i + 1, k, self.lines[i].strip()) for i, k in enumerate(self.kind) if k in ("page_number", "running_header")]
        return sorted(furniture + self.noise, key=lambda n: n.line)

    def _breaks(self, content: list[int]) -> set[int]:
        """Positions in ``content`` that start a paragraph, by dynamic programming over the lines."""
        n = len(content)
        if not n:
            return set()
        widths = sorted(len(self.lines[i].rstrip()) for i in content)
        usual = widths[(3 * n) // 4]
        gap = [0.0] * n  # cost of a boundary before line k, against none
        for k in range(1, n):
            before, after = self.lines[content[k - 1]].rstrip(), self.lines[content[k]].lstrip()
            between = self.kind[content[k - 1] + 1 : content[k]]
            gap[k] = 3.0
            gap[k] -= 4.0 if "blank" in between and not {"page_number", "running_header"} & set(between) else 0.5 if between else 0.0
            gap[k] += -1.0 if re.search(r"[.!?:。！？][\"'”’)\]]*$", before) else 4.0
            gap[k] += -1.0 if len(before) < 0.75 * usual else 0.5
            gap[k] += 2.0 if after[:1].islower() else -0.5
            if after.startswith("#") or before.startswith("#"):
                gap[k] -= 20.0
        # best[k]: cheapest division of the first k lines; a paragraph of one line costs a little more
        best, start = [0.0] * (n + 1), [0] * (n + 1)
        least = (float("inf"), 0)  # of all starts but the line before
        for k in range(1, n + 1):
            before = best[k - 1] + gap[k - 1]
            best[k], start[k] = min(least, (before + 0.7, k - 1))
            least = min(least, (before, k - 1))
        cuts, k = set(), n
        while k > 0:
            cuts.add(start[k])
            k = start[k]
        return cuts

    def repaired(self) -> str:
        """Running paragraphs without furniture; the text as it is if the record was not scanned."""
        if not self.signs:
            return "\n".join(self.lines)
        content = [i for i, k in enumerate(self.kind) if k == "text"]
        cuts = self._breaks(content)
        paragraphs: list[list[str]] = []
        previous = -1
        for at, shown in self.units:
            if at != previous and (at in cuts or not paragraphs):
                paragraphs.append([])
            previous = at
            paragraphs[-1].append(shown)
        return "\n\n".join(" ".join(p) for p in paragraphs if p)


_LAST: list[Decoder] = []


def _decoder(words: Lexicon) -> Decoder:
    """The decoder of a lexicon, one for all tasks of a worker."""
    if not _LAST or _LAST[0].lexicon is not words:
        _LAST[:] = [Decoder(words)]
    return _LAST[0]


def _divided_forms(lines: list[str]) -> set[str]:
    """Words that may have been divided at the ends of the lines, joined and with the hyphen."""
    marked = {i for i, *_ in _marks(lines)}
    forms = set()
    for i, line in enumerate(lines):
        end = re.search(r"(\S*[^\W\d_])[-‐­]\s*$", line)
        if end is None:
            continue
        head = end[1].lstrip(_EDGE).lower()
        for j in range(i + 1, len(lines)):
            words = lines[j].split(None, 1)
            if words:
                for tail in {words[0].rstrip(_EDGE).lower(), words[0].rstrip(_EDGE + "!-").lower()} - {""}:
                    forms |= {head + tail, f"{head}-{tail}"}
            if words and j not in marked:
                break
    return forms


_KEPT = "origin string, record_key string, paper_key string, text string, rare array<string>"


def suspicious(texts: DataFrame, words: Lexicon) -> DataFrame:
    """The records that ``Page`` can find a sign of scanning in, whatever the title: divided words, furniture, or a word that confusions explain.

    ``rare`` has the words outside the lexicon whose counts decide how they are read.
    """
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        decoder.local = {}
        fine: set[str] = set()

        def judged(text: str) -> tuple[bool, list[str]]:
            misread, rare = False, set()
            for token in set(text.split()) - fine:
                low = decoder.bare(token).lower()
                known = low in decoder.counts
                reading = decoder.misread.get(low) if known else decoder.correction(low)
                if reading is not None and not decoder.bare(token).isupper():
                    misread = True
                if reading is None and (known or decoder.split(low) is None):
                    fine.add(token)
                elif not known:
                    rare.add(low)
            if len(fine) > 1_000_000:
                fine.clear()
            lines = _split(text) if "\n" in text else []
            divided = _DIVIDED.search(text) is not None
            if not (misread or divided or _furnished(lines or [text])):
                return False, []
            return True, sorted(rare | {w for w in (_divided_forms(lines) if divided else ()) if w not in decoder.counts})

        for batch in batches:
            found = [judged(t) for t in batch.column(3).to_pylist()]
            keep = pa.array([k for k, _ in found], pa.bool_())
            rare = pa.array([r for k, r in found if k], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.filter(keep).columns, rare], names=[*batch.schema.names, "rare"])

    return texts.select("origin", "record_key", "paper_key", "text").mapInArrow(select, _KEPT)


def _candidates(texts: DataFrame, papers: DataFrame, words: Lexicon | None) -> tuple[DataFrame, Lexicon]:
    """Suspicious records ``(origin, record_key, text, title, counts)`` and the lexicon; ``counts`` are those of the rare words."""
    vocabulary = cut_lineage(word_counts(texts))
    words = words or lexicon(vocabulary)
    # repeated rows of a record count once
    once = suspicious(texts, words).groupBy("origin", "record_key").agg(F.min(F.struct("paper_key", "text", "rare")).alias("r"))
    once = cut_lineage(once.select("origin", "record_key", "r.*"))
    rare = once.select("origin", "record_key", F.explode("rare").alias("word"))
    counted = rare.join(vocabulary, "word").groupBy("origin", "record_key").agg(F.collect_list(F.struct("word", "n")).alias("counts"))
    titles = need(papers, ["paper_key", "title"], "scanned").groupBy("paper_key").agg(F.min("title").alias("title"))
    known = once.drop("rare").join(counted, ["origin", "record_key"], "left").join(titles, "paper_key", "left")
    return known.select("origin", "record_key", "text", "title", "counts"), words


def _pages(batch: pa.RecordBatch, decoder: Decoder) -> Iterator[tuple[str, str, Page]]:
    for origin, key, text, title, counts in zip(*(c.to_pylist() for c in batch.columns)):
        decoder.local = {c["word"]: c["n"] for c in counts or ()}
        yield origin, key, Page(text, title, decoder)


def noise(texts: DataFrame, papers: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """``(origin, record_key, line_no int, noise, token)`` of the scanned ones of ``records``, each row once.

    A word with a lost or added blank counts as misread; its row has the right word or words.
    """
    candidates, words = _candidates(texts, papers, words)
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            rows = [(origin, key, n.line, n.kind, n.token) for origin, key, page in _pages(batch, decoder) for n in page.found()]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["origin", "record_key", "line_no", "noise", "token"])

    return candidates.mapInArrow(decode, "origin string, record_key string, line_no int, noise string, token string").distinct()


def repaired(texts: DataFrame, papers: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """``(origin, record_key, scanned boolean, text)``: scanned records as paragraphs; only those with a sign of scanning."""
    candidates, words = _candidates(texts, papers, words)
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            rows = [(page.signs > 0, page.repaired()) for _, _, page in _pages(batch, decoder)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string())],
                names=["origin", "record_key", "scanned", "text"],
            )

    return candidates.mapInArrow(decode, "origin string, record_key string, scanned boolean, text string")


def found(extracts: DataFrame, articles: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """``p5_found``: (origin, record_key, line_no, noise, token)."""
    return noise(records(extracts, articles, chunks), papers)
