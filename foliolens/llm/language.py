"""Language identification by words first, backing off to ever shorter character n-grams.

Training counts words and the character n-grams of words for each language. In each language on its own, a word that the
language knows scores by its log frequency there. A word that it does not know backs off: it is cut greedily into pieces,
at each place the longest n-gram that this language knows (from ``MAX_GRAM`` characters down to one), and scores by the
log frequencies of the pieces among n-grams of their length, with a discount for the step from words and one for each
step down; a character that the language has never seen costs ``UNKNOWN_CHARACTER``. The posterior of the best language,
under equal priors, grows with every word and says which language is likeliest, not whether any is likely. For that there
is the evidence of a text: the median over its words of the log-likelihood of the word's pieces (known words are cut
too), per letter or word end, in the language that suits the word best. The score is the posterior times a logistic function of the
evidence, which is one half at ``least`` and 0.98 at the median of training rows; so letter junk and languages that were not
learned score low however long the text is.

The classifier is fitted on a bounded sample of labelled rows: about ``sample_per_lang`` documents of each language,
chosen by a hash of doc_id. A language keeps the entries that make up at least ``LEAST_SHARE`` of its own words, or of
its own n-grams of a length, and occur twice; so a small language loses nothing to a large one, no language is left out, and a
language's part of the model, which every task receives, has a fixed size bound whatever the corpus. Counting is
distributed and only the bounded tables are collected.

Defined results: null text, or text without a letter: ``und`` with score 0; ties go to the first language by name; rows
with a null lang are not learned from but are predicted; with nothing to learn from every row is ``und``, and so is every row
of an empty table, which has none; very long texts are read whole, word by word; repeated rows each give a row; a null
doc_id stays null; other columns are ignored, but for ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import checkpointed, portions, texts

UNKNOWN = "und"
SAMPLE_PER_LANG = 1500
MAX_GRAM = 5
LEAST_SHARE, LEAST_COUNT = 1e-5, 2
BACKOFF = math.log(0.4)
UNKNOWN_CHARACTER = -20.0
#: The evidence at which the score is halved lies below this quantile of training rows, by this many times the quantile's distance from their median.
LOW_SHARE, MARGIN = 0.001, 2.0
#: Numbers that a worker keeps for words it has met; they are computed again when forgotten.
CACHE = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
_WHOLE = re.compile(r"(?<![\d_])[^\W\d_]++(?![\d_])")


def grams(word: str, longest: int = MAX_GRAM) -> Iterator[str]:
    padded = f" {word} "
    for n in range(1, longest + 1):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


class Language:
    """Log frequencies of the words and n-grams that one language knows; those of n-grams with the discount of their length."""

    def __init__(self, words: dict[str, int], by_gram: dict[str, int]):
        self.words = _logs(words)
        self.grams: dict[str, float] = {}
        for n in range(1, MAX_GRAM + 1):
            self.grams |= {g: v + BACKOFF * (MAX_GRAM - n) for g, v in _logs({g: c for g, c in by_gram.items() if len(g) == n}).items()}

    def pieces(self, padded: str) -> float:
        """Log-likelihood of the longest known pieces of a word between blanks, with the discounts of steps down."""
        at, end, out, known = 0, len(padded), 0.0, self.grams.get
        while at < end:
            to = min(at + MAX_GRAM, end)
            while (own := known(padded[at:to])) is None:
                to -= 1
                if to == at:
                    own, to = UNKNOWN_CHARACTER, at + 1
                    break
            out += own
            at = to
        return out


def _logs(counts: dict[str, int]) -> dict[str, float]:
    total = math.log(sum(counts.values()) or 1)
    return {e: math.log(n) - total for e, n in counts.items()}


class LanguageModel:
    """Languages by name. ``least`` and ``middle`` are the evidence at which the score is halved, and that of training rows."""

    def __init__(self, tables: dict[str, tuple[dict[str, int], dict[str, int]]]):
        self.langs = sorted(tables)
        self.known = [Language(*tables[k]) for k in self.langs]
        self.least, self.middle = -math.inf, 0.0
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.seen = np.zeros((1024, len(self.langs) + 2))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "seen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def word_scores(self, word: str) -> tuple[list[float], float]:
        """The score of a word in each language; and, per letter or word end, the log-likelihood of its pieces in the
        language that suits it best."""
        padded = f" {word} "
        pieces = [k.pieces(padded) for k in self.known]
        own = [k.words[word] if word in k.words else BACKOFF + p for k, p in zip(self.known, pieces, strict=True)]
        return own, max(pieces) / len(padded)

    def _row(self, word: str) -> int:
        """Where ``seen`` has the scores of a word, its fit, and whether it has a letter."""
        at = len(self.place)
        if at == len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        if any(map(str.isalpha, word)):
            own, fit = self.word_scores(word)
            self.seen[at] = [*own, fit, 1.0]
        else:
            self.seen[at] = 0.0
        self.place[word] = at
        return at

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``seen`` for the words of a text that have a letter, and how often each comes."""
        lowered = text.lower()
        # Letters within keys and numbers say nothing, unless there is nothing else.
        found = Counter(_WHOLE.findall(lowered) or _WORD.findall(lowered))
        if len(self.place) * self.seen.shape[1] > CACHE:
            self.forget()
        place = self.place
        rows = np.fromiter((place[w] if w in place else self._row(w) for w in found), np.int64, len(found))
        table = self.seen[rows]
        letters = table[:, -1] > 0
        n = np.fromiter(found.values(), np.float64, len(found))
        return (table, n) if letters.all() else (table[letters], n[letters])

    def read(self, text: str) -> tuple[str, float]:
        """The likeliest language and the score."""
        table, n = self._words(text) if self.langs else ((), ())
        if not len(n):
            return UNKNOWN, 0.0
        total = n @ table[:, :-2]
        best = int(total.argmax())
        posterior = 1 / np.exp(np.clip(total - total[best], -700, 0)).sum()
        return self.langs[best], float(posterior * self._suits(_median(table[:, -2], n)))

    def evidence(self, text: str) -> float:
        """The median fit of the words of a text; minus infinity without a letter."""
        table, n = self._words(text) if self.langs else ((), ())
        return _median(table[:, -2], n) if len(n) else -math.inf

    def _suits(self, evidence: float) -> float:
        if self.least == -math.inf:
            return 1.0
        return 1 / (1 + math.exp(min(700.0, 4 / max(self.middle - self.least, 1e-9) * (self.least - evidence))))


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    upto = np.cumsum(weights[order])
    return float(values[order[np.searchsorted(upto, upto[-1] / 2)]])


def _sample(docs: DataFrame, learn: Column, sample_per_lang: int) -> DataFrame | None:
    """The rows (lang, text) to learn from."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, min(1.0, sample_per_lang / sizes[k]))])
    return rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")


def _counts(chosen: DataFrame) -> DataFrame:
    """lang, size (0 for words, else the length of n-grams), entry, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), texts(b.column("text")), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            out: list[tuple[str, int, str, int]] = []
            for lang, found in words.items():
                pieces: Counter = Counter()
                for w, n in found.items():
                    for g in grams(w):
                        pieces[g] += n
                out += [(lang, 0, w, n) for w, n in found.items()] + [(lang, len(g), g, n) for g, n in pieces.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "size", "entry", "n"])

    return chosen.mapInArrow(count, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, sample_per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """A model of the rows of docs(doc_id, text, lang) for which ``learn`` holds and text and lang are not null."""
    chosen = _sample(docs, learn, sample_per_lang)
    if chosen is None:
        return LanguageModel({})
    counts = checkpointed(_counts(chosen))
    totals = counts.groupBy("lang", "size").agg(F.greatest(F.lit(LEAST_COUNT), F.ceil(F.sum("n") * LEAST_SHARE)).alias("least"))
    kept = counts.join(F.broadcast(totals), ["lang", "size"]).where("n >= least")  # totals: six rows for each language
    tables: dict[str, tuple[dict[str, int], dict[str, int]]] = {}
    for r in kept.select("lang", "size", "entry", "n").toArrow().to_batches():
        for lang, size, entry, n in zip(*(r.column(c).to_pylist() for c in ("lang", "size", "entry", "n")), strict=True):
            tables.setdefault(lang, ({}, {}))[size > 0][entry] = n
    model = LanguageModel(tables)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, whatever the corpus

    @F.arrow_udf("double")
    def evidence(text: pa.Array) -> pa.Array:
        """Null without a letter, which quantiles pass over; a filter would run this twice, in two workers of each task."""
        return pa.array([e if e > -math.inf else None for e in map(held.value.evidence, texts(text))], pa.float64())

    found = chosen.select(evidence("text").alias("evidence"))
    low, middle = found.agg(F.percentile("evidence", F.lit(LOW_SHARE)), F.percentile("evidence", F.lit(0.5))).first()
    if low is not None:
        model.least, model.middle = low - MARGIN * (middle - low), middle
    return model


def _predictor(docs: DataFrame, model: LanguageModel) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(text: pa.Array) -> pa.Array:
        rows = [held.value.read(t) for t in texts(text)]
        return pa.StructArray.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64())], names=["lang_pred", "score"])

    return predicted("text")


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with the columns lang_pred and score, which replace columns of these names."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*rest, _predictor(docs, model).alias("predicted ")).select(*rest, "`predicted `.lang_pred", "`predicted `.score")


def identified(docs: DataFrame, model: LanguageModel, least_score: float) -> DataFrame:
    """The rows of docs whose language is found with at least this score, all columns as they are."""
    p = F.col("predicted ")
    rows = docs.select(F.struct("*").alias("row"), _predictor(docs, model).alias("predicted "))
    return rows.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least_score)).select("row.*")
