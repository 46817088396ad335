"""Languages of documents and of the stretches of mixed documents (problem 10).

Script ranges narrow the candidates of each word; within a script a word's scores come from word
counts and, for words not seen in training, from letter n-grams. Viterbi over the words of a text
with a penalty for switching, which is smaller between sentences than within one, labels spans (``Read.runs``). A
sentence counts as whole in the language that most of its words are labelled with, if the evidence is
enough (``Read.whole``, for ``mislabelled`` only). Texts are read in batches: words are numbered and
scored once, and the Viterbi steps of all texts of a batch are taken together.

The model is fitted at run time on at most ``TRAIN_DOCS`` labelled documents (a documented bound), whose
labels are noisy: after a first fit by document label, sentences are labelled by the model itself and
counted again. Every document is then classified whole.

Defined results: null, empty and wordless texts have no language; words of scripts that no language
here is written in decide nothing, and a sentence of only such words is ``und``; ties go to the first language of ``LANGUAGES``; repeated rows give
repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "es", "fr", "pt", "it", "nl", "ru")
#: Bound of the training sample, in documents.
TRAIN_DOCS = 6_000
#: Documents longer than this, in characters, are not used for fitting.
TRAIN_CHARS = 20_000
SWITCH_WITHIN, SWITCH_BETWEEN = 4.0, 1.0
#: A sentence counts from this many words on, if its language leads by this much (log odds).
LEAST_WORDS, LEAST_LEAD = 3, 3.0
#: Label of sentences without a word in a script of the languages, with confidence 0.
UNDETERMINED, _NONE = "und", -1
# Names and codes of the languages, and words for "not known".
SPELLINGS = {
    "en": "en eng english englisch inglés anglais", "de": "de deu ger german deutsch alemán allemand",
    "es": "es spa spanish español espanol castellano spanisch", "fr": "fr fra fre french français francais französisch",
    "pt": "pt por portuguese português portugues", "it": "it ita italian italiano italienisch",
    "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский russisch",
}
UNKNOWN = frozenset("unknown und unk none null n/a na xx ? ?? ??? - zxx undefined undetermined other".split())
_NAMES = {w: code for code, ws in SPELLINGS.items() for w in ws.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.?!…:]+(?=\s|$)|\n")
_LATIN = tuple(i for i, c in enumerate(LANGUAGES) if c != "ru")
_CYRILLIC = (LANGUAGES.index("ru"),)
_CAP = 4.0
_ZERO = (0.0,) * len(LANGUAGES)
#: Texts of a batch that advance together in Viterbi; below this number they go one by one.
_WIDE = 12
#: Bytes of text that are read at once.
_CHARS = 2_000_000


def named(label: str | None) -> set[str] | None:
    """Codes that a label names, the label itself where it names none of ours; None where it is missing."""
    if label is None:
        return None
    low = label.strip().lower()
    if not low or low in UNKNOWN:
        return None
    out = {_NAMES.get(re.split(r"[-_]", part)[0], part) for part in re.split(r"[,;/+|\s]+", low) if part}
    return out or None


def sentences(text: str) -> list[list[str]]:
    """Words by sentence; a line ends a sentence, and so do marks before white space."""
    out: list[list[str]] = []
    now: list[str] = []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would be cut
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for t in _TOKEN.findall(low.replace("’", "'")):
        if t[0].isalpha():
            now.append(t)
        elif now:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def script(word: str) -> tuple[int, ...]:
    """Candidate languages by the script of the word's first letter."""
    c = ord(word[0])
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return _LATIN
    return _CYRILLIC if 0x400 <= c < 0x530 else ()


class Model:
    """Per-word log scores of the languages."""

    def __init__(self, words: dict[int, Counter]):
        n = len(LANGUAGES)
        totals = [sum(words[i].values()) + 1 for i in range(n)]
        seen: dict[str, list[int]] = {}
        for i in range(n):
            for w, c in words[i].items():
                seen.setdefault(w, [0] * n)[i] = c
        self.known: dict[str, tuple[float, ...]] = {}
        grams: list[Counter] = [Counter() for _ in range(n)]
        for w, c in seen.items():
            if sum(c) >= 3:
                self.known[w] = self._scores([(c[i] + 0.02) / totals[i] for i in range(n)], script(w), _CAP)
            for i in range(n):
                if c[i]:
                    for g in self._grams(w):
                        grams[i][g] += 1
        sums = [sum(g.values()) + 1 for g in grams]
        self.grams: dict[str, tuple[float, ...]] = {}
        for g in set().union(*grams):
            if sum(x[g] for x in grams) >= 5:
                self.grams[g] = tuple(math.log((grams[i][g] + 0.5) / sums[i]) for i in range(n))
        self.numbers: dict[str, int] = {}
        self.rows: list[tuple[float, ...]] = []
        self.strong: list[tuple[bool, bool]] = []
        self.seen, self.table, self.flags = 0, np.zeros((0, n)), np.zeros((0, 2), bool)

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    @staticmethod
    def _scores(p: list[float], among: tuple[int, ...], cap: float) -> tuple[float, ...]:
        """Log of each language's share relative to the best, cut at ``-cap``; others get the cut."""
        if not among:
            return ()
        top = max(p[i] for i in among)
        return tuple(max(-cap, math.log(p[i] / top)) if i in among and p[i] > 0 else -cap for i in range(len(p)))

    def scores(self, word: str) -> tuple[float, ...]:
        """One score per language, 0 for the best; empty where the script decides nothing."""
        hit = self.known.get(word)
        if hit is None:
            among = script(word)
            if not among or len(among) == 1:
                return self._scores([1.0 if i in among else 0.0 for i in range(len(LANGUAGES))], among, _CAP)
            logs = [0.0] * len(LANGUAGES)
            for g in self._grams(word):
                if v := self.grams.get(g):
                    logs = [a + b for a, b in zip(logs, v)]
            top = max(logs[i] for i in among)
            # What letters alone say is weak evidence: names look like any language.
            return tuple(max(-1.0, 0.2 * (logs[i] - top)) if i in among else -_CAP for i in range(len(LANGUAGES)))
        return hit

    def number(self, word: str) -> int:
        """Row of ``scored`` that holds the word's scores."""
        at = self.numbers.get(word)
        if at is None:
            e = self.scores(word)
            at = self.numbers[word] = len(self.rows)
            self.rows.append(e or _ZERO)
            self.strong.append((bool(e) and (word in self.known or len(script(word)) == 1), bool(e)))
        return at

    def scored(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every numbered word, and whether it is strong evidence and whether it has a script of ours."""
        if self.seen != len(self.rows):
            if len(self.table) < len(self.rows):
                grown = np.zeros((2 * len(self.rows), len(LANGUAGES)))
                grown[: self.seen] = self.table[: self.seen]
                flags = np.zeros((2 * len(self.rows), 2), bool)
                flags[: self.seen] = self.flags[: self.seen]
                self.table, self.flags = grown, flags
            self.table[self.seen : len(self.rows)] = self.rows[self.seen :]
            self.flags[self.seen : len(self.rows)] = self.strong[self.seen :]
            self.seen = len(self.rows)
        return self.table, self.flags

    def labels(self, emitted: np.ndarray, opens: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Viterbi labels of the words of many texts, one after the other, that have ``size`` words each.

        Texts advance together, word by word, as long as there are ``_WIDE`` of them; the few longest go one
        by one. ``opens`` tells the words that begin a sentence.
        """
        out = np.zeros(len(emitted), np.int8)
        start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(size) else np.empty(0, np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        longest = order[:_WIDE] if len(order) > _WIDE else order
        for t in longest:
            out[start[t] : start[t] + size[t]] = self._one(emitted[start[t] : start[t] + size[t]], opens[start[t] : start[t] + size[t]])
        order = order[_WIDE:]
        if not len(order):
            return out
        begin, length = start[order], size[order]
        best = emitted[begin].copy()
        switched: list[np.ndarray] = []
        leads: list[np.ndarray] = []
        for step in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -step, side="left"))  # texts longer than ``step``
            at = begin[:n] + step
            now = best[:n]
            lead = now.argmax(1)
            cut = (now[np.arange(n), lead] - np.where(opens[at], SWITCH_BETWEEN, SWITCH_WITHIN))[:, None]
            switched.append(now < cut)
            leads.append(lead.astype(np.int8))
            best[:n] = np.maximum(now, cut) + emitted[at]
        state = best.argmax(1).astype(np.int8)
        for step in range(int(length[0]) - 1, -1, -1):
            n = int(np.searchsorted(-length, -step, side="left"))
            out[begin[:n] + step] = state[:n]
            if step:
                jump = switched[step - 1][np.arange(n), state[:n]]
                state[:n] = np.where(jump, leads[step - 1], state[:n])
        return out

    @staticmethod
    def _one(emitted: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Labels of one text."""
        best = emitted[0].tolist()
        leads, moves = bytearray(), bytearray()
        for at in range(1, len(emitted), 10_000):
            for e, opening in zip(emitted[at : at + 10_000].tolist(), opens[at : at + 10_000].tolist()):
                top = max(best)
                cut = top - (SWITCH_BETWEEN if opening else SWITCH_WITHIN)
                leads.append(best.index(top))
                moves.append(sum(1 << k for k, b in enumerate(best) if b < cut))
                best = [(b if b >= cut else cut) + x for b, x in zip(best, e)]
        state = best.index(max(best))
        flat = bytearray([state])
        for lead, moved in zip(reversed(leads), reversed(moves)):
            state = lead if moved >> state & 1 else state
            flat.append(state)
        return np.frombuffer(bytes(flat), np.int8)[::-1]

    def read(self, texts: list[str | None]) -> Read:
        """Words, sentences and Viterbi labels of a batch of texts."""
        numbers: list[int] = []
        ends: list[int] = []  # words up to the end of each sentence
        size: list[int] = []
        held: list[int] = []  # sentences of each text
        if len(self.rows) > 300_000:  # numbers are given anew; the scores stay the same
            self.numbers.clear()
            self.rows, self.strong, self.seen = [], [], 0
        known, number = self.numbers, self.number
        for text in texts:
            before, sentence = len(numbers), len(ends)
            for part in sentences(text) if text else ():
                for word in part:
                    at = known.get(word)
                    numbers.append(number(word) if at is None else at)
                ends.append(len(numbers))
            size.append(len(numbers) - before)
            held.append(len(ends) - sentence)
        table, flags = self.scored()
        word = np.array(numbers, np.int64)
        end = np.array(ends, np.int64)
        begin = np.concatenate(([0], end[:-1])).astype(np.int64) if len(end) else end
        opens = np.zeros(len(word), bool)
        opens[begin] = True
        emitted = table[word]
        count = np.array(size, np.int64)
        return Read(self.labels(emitted, opens, count), emitted, flags[word], begin, end, count, np.array(held, np.int64))


class Read:
    """Labelled words of a batch of texts; sentence s holds the words begin[s]:end[s]."""

    def __init__(self, label, emitted, flags, begin, end, words, sentences_):
        self.label, self.emitted, self.flags, self.begin, self.end, self.words, self.sentences = label, emitted, flags, begin, end, words, sentences_

    def sums(self, begin: np.ndarray) -> np.ndarray:
        """Scores summed over the stretches that begin at these words and follow each other."""
        return np.add.reduceat(self.emitted, begin, axis=0) if len(begin) else np.zeros((0, len(LANGUAGES)))

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, language, confidence) of each sentence with enough evidence, in order."""
        n = len(LANGUAGES)
        size = self.end - self.begin
        owner = np.repeat(np.arange(len(self.sentences)), self.sentences)
        if not len(size):
            return owner, owner, np.empty(0)
        at = np.repeat(np.arange(len(size)), size)
        votes = np.bincount(at * n + self.label, minlength=len(size) * n).reshape(-1, n)
        lang, count = votes.argmax(1), votes.max(1)
        sums = self.sums(self.begin)
        own = sums[np.arange(len(size)), lang]
        others = sums.copy()
        others[np.arange(len(size)), lang] = -np.inf
        lead = own - others.max(1)
        strong = np.add.reduceat(self.flags[:, 0].astype(np.int64), self.begin)
        keep = (size >= LEAST_WORDS) & (strong >= 2) & (lead >= LEAST_LEAD) & (2 * count > size)
        total = np.exp(np.minimum(0.0, sums - own[:, None])).sum(1)
        return owner[keep], lang[keep], 1 / total[keep]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of words, language or _NONE, confidence) of each Viterbi run, in order."""
        if not len(self.label):
            none = np.empty(0, np.int64)
            return none, none, none, np.empty(0)
        size = self.end - self.begin
        blind = ~np.logical_or.reduceat(self.flags[:, 1], self.begin)
        label = np.where(np.repeat(blind, size), _NONE, self.label)
        text = np.repeat(np.arange(len(self.words)), self.words)
        first = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (text[1:] != text[:-1]))))
        sums, lang = self.sums(first), label[first].astype(np.int64)
        own = sums[np.arange(len(first)), np.maximum(lang, 0)]
        share = 1 / np.exp(np.minimum(700.0, sums - own[:, None])).sum(1)
        return text[first], np.diff(np.concatenate((first, [len(label)]))), lang, np.where(lang == _NONE, 0.0, share)


def fit(rows: list[tuple[str, str]], rounds: int = 2) -> Model:
    """A model from (text, code) pairs with noisy codes."""
    parts = [(sentences(t), LANGUAGES.index(c)) for t, c in rows]
    words: dict[int, Counter] = defaultdict(Counter)
    for p, i in parts:
        for s in p:
            words[i].update(s)
    model = Model(words)
    every = [s for p, _ in parts for s in p if len(s) >= LEAST_WORDS]
    begin = np.cumsum([0] + [len(s) for s in every[:-1]]) if every else np.empty(0, np.int64)
    for _ in range(rounds if every else 0):
        at = [model.number(w) for s in every for w in s]
        sums = np.add.reduceat(model.scored()[0][at], begin, axis=0)
        two = np.partition(sums, -2, axis=1)[:, -2:]
        words = defaultdict(Counter)
        for k in np.flatnonzero(two[:, 1] - two[:, 0] >= LEAST_LEAD):
            words[int(sums[k].argmax())].update(every[k])
        model = Model(words)
    return model


def trained(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", bound: int = TRAIN_DOCS) -> Model:
    """A model fitted on at most ``bound`` whole documents of at most ``TRAIN_CHARS`` with a label that names one of the languages.

    The documents are those with the least hashes of their ids; no more than these reach the driver.
    """
    first = F.regexp_extract(F.lower(F.trim(lang)), r"^([^\W\d_]+)", 1)
    code = None
    for c, ws in SPELLINGS.items():
        hit = F.when(first.isin(ws.split()), c) if code is None else code.when(first.isin(ws.split()), c)
        code = hit
    sample = (
        documents.select(F.col(text).alias("t"), code.alias("c"), F.xxhash64(doc_id).alias("h"), F.col(doc_id).alias("d"))
        .where(F.col("c").isNotNull() & F.length("t").between(1, TRAIN_CHARS))
        .orderBy("h", "d")
        .limit(bound)
    )
    return fit([(r.t, r.c) for r in sample.select("t", "c").collect()])


def _found(model: Model, texts: list[str | None], labels: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, confidence) of the whole sentences' languages of the texts whose label does not name just these."""
    n = len(LANGUAGES)
    text, lang, sure = model.read(texts).whole()
    best: dict[int, float] = {}
    for key, c in zip((text * n + lang).tolist(), sure.tolist()):
        if c > best.get(key, 0.0):
            best[key] = c
    there: dict[int, set[str]] = defaultdict(set)
    for key in best:
        there[key // n].add(LANGUAGES[key % n])
    wrong = {t for t, codes in there.items() if (said := named(labels[t])) is None or said != codes}
    keys = sorted(k for k in best if k // n in wrong)
    at = np.array(keys, np.int64)
    return at // n, at % n, np.array([best[k] for k in keys])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part holds no more than ``_CHARS`` of text, or one text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHARS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _languages(model: Model, text: str | None) -> dict[str, float]:
    """Languages in which a whole sentence of one text stands, with the best confidence."""
    out: dict[str, float] = {}
    _, lang, sure = model.read([text]).whole()
    for code, c in zip(_codes(lang).to_pylist(), sure.tolist()):
        out[code] = max(out.get(code, 0.0), c)
    return out


def _codes(lang: np.ndarray) -> pa.Array:
    """Codes of language numbers, ``UNDETERMINED`` for _NONE."""
    names = np.array([*LANGUAGES, UNDETERMINED], object)
    return pa.array(names[lang], pa.string())


def mislabelled(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """(doc_id, language, confidence) of documents whose label is missing, wrong or too narrow."""
    shared = documents.sparkSession.sparkContext.broadcast(model or trained(documents, text, lang, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            at, codes, sure = _found(shared.value, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _codes(codes), pa.array(sure, pa.float64())], [doc_id, "language", "confidence"])

    return documents.select(doc_id, text, lang).mapInArrow(run, f"`{doc_id}` {dict(documents.dtypes)[doc_id]}, language string, confidence double")


def runs(model: Model, text: str | None) -> list[tuple[int, str, float]]:
    """(number of words, language, confidence) of each Viterbi run, in order; together they hold every word."""
    _, size, lang, sure = model.read([text]).runs()
    return list(zip(size.tolist(), _codes(lang).to_pylist(), sure.tolist()))


def main_languages(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, confidence): the language of most words, its confidence weighted with its share of the words."""
    n = len(LANGUAGES) + 1
    text, size, lang, sure = model.read(texts).runs()
    cell = text * n + np.where(lang == _NONE, n - 1, lang)
    words = np.bincount(cell, size, len(texts) * n).reshape(-1, n)
    weight = np.bincount(cell, size * sure, len(texts) * n).reshape(-1, n)
    at = np.flatnonzero(words.sum(1) > 0)
    best = words[at].argmax(1)
    return at, np.where(best == n - 1, _NONE, best), weight[at, best] / words[at].sum(1)


def main_language(model: Model, text: str | None) -> tuple[str, float] | None:
    """The language of most words of one text; None without words."""
    at, lang, sure = main_languages(model, [text])
    return (_codes(lang)[0].as_py(), float(sure[0])) if len(at) else None


def documents_languages(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """(doc_id, language, confidence): one row for every document that has words."""
    shared = documents.sparkSession.sparkContext.broadcast(model or trained(documents, text, lang, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            at, code, sure = main_languages(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _codes(code), pa.array(sure, pa.float64())], [doc_id, "language", "confidence"])

    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {dict(documents.dtypes)[doc_id]}, language string, confidence double")


def _spans(text: str) -> list[tuple[int, int]]:
    """(first, last + 1) character of each word, in code points, in the order of ``sentences``."""
    return [m.span() for m in _TOKEN.finditer(text) if m[0][0].isalpha()]


def segments(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", model: Model | None = None) -> DataFrame:
    """(doc_id, position, begins, ends, words, language, confidence): each stretch of one language, in order.

    The stretches are the Viterbi runs, within sentences too; together they hold every word of a document.
    ``begins`` and ``ends`` are the places of the first character and behind the last one, in code points from 0.
    Thin evidence drops no stretch, it lowers the confidence.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or trained(documents, text, lang, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column(1).to_pylist()
            read = shared.value.read(texts)
            at, size, code, sure = read.runs()
            where = np.array([x for t in texts if t for x in _spans(t)], np.int64).reshape(-1, 2)
            last = np.cumsum(size)
            rank = np.arange(len(at)) - np.searchsorted(at, at) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)), pa.array(rank, pa.int32()), pa.array(where[last - size, 0], pa.int32()), pa.array(where[last - 1, 1], pa.int32()),
                    pa.array(size, pa.int32()), _codes(code), pa.array(sure, pa.float64()),
                ],
                [doc_id, "position", "begins", "ends", "words", "language", "confidence"],
            )

    key = dict(documents.dtypes)[doc_id]
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {key}, position int, begins int, ends int, words int, language string, confidence double")
