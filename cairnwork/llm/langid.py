"""The language of documents, and of the lines of documents in several languages.

Interpolated Kneser-Ney models over characters, one for each language and one for what is in no language
(code, logs, tables), tell how well a sentence fits; the lowest cross-entropy for each character wins, and
what fits none well enough is rejected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.bpe import spread

#: The languages, with their ISO 639 codes and English names.
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish", "castilian"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch", "flemish"),
    "pl": ("pol", "polish"),
    "ru": ("rus", "russian"),
    "uk": ("ukr", "ukrainian"),
    "ja": ("jpn", "japanese"),
    "zh": ("zho", "chi", "cmn", "chinese", "mandarin"),
}
CODE = "-"  # the class of what is in no language
ORDER = 5
#: Most lines of each label, and most characters of a line, on which the models are fitted.
FIT_LINES, FIT_CHARS = 1500, 400
#: Rounds in which lines whose label is in doubt are put aside before the final fit, and the nats by which a
#: line must fit its own label's model better than any other not to be in doubt.
ROUNDS, DOUBT = 3, 5.0
#: Nats by which another language must fit a line better than its document's, and an odd class than a language.
PRIOR = 4.0
#: A sentence is rejected when its cross-entropy is above this quantile of held-out lines, times the slack.
REJECT_QUANTILE, REJECT_SLACK = 0.999, 1.35
#: Share of the log-likelihood difference that counts for the confidence.
TEMPER = 0.2

_KNOWN = {x: code for code, more in LANGUAGES.items() for x in (code, *more)}
#: What is no language by its form: it is scored with its sentence, but its letters do not count.
_MASK = re.compile(
    r"`[^`\n]*`|https?://\S+|\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{6,}\b|(?<!\w)\w+(?:(?:::|/|_)[A-Za-z0-9_.\-]+)+", re.ASCII
)
_MASKED = re.compile(r"[`/_0:]")  # without one of these, a folded text has nothing to mask
_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ][\d:.]+Z?")
_HEAD = re.compile(r"[ >#*•\-–+|]*(?:\[[ x]?\] *)?(?:0+[.)] +)?(?:\[0+\] *)?")
_HEADED = frozenset(" >#*•-–+|[0")
_STOP = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])")
_STOPS = re.compile(r"[.!?…。！？]")  # without one of these before its last character, a line has no inner end
#: A line that teaches a language ends as a sentence does.
_ENDED = re.compile(r"[.!?…。！？][\"')\]]*$")
_DIGITS = "123456789" + "".join(chr(0xFF10 + d) for d in range(10))  # and those of full width
_ZERO_WIDTH = "\u200b\ufeff"
#: Longest text that is scored in one; a longer sentence is scored in parts. Characters scored at once.
PART, AT_ONCE = 1 << 16, 1 << 20


def label_code(label: str | None) -> str | None:
    """The language that a label names: any ISO 639 code, with or without region or script, or the English
    name, in any case; null for labels that name none of the languages."""
    if label is None or label != label:
        return None
    m = re.match(r"([a-z]+)(?:[-_.@( ].*)?$", label.strip().lower(), re.S)
    return _KNOWN.get(m.group(1)) if m else None


def folded_lines(text: str) -> list[str]:
    """The lines of a text as the models see them: composed, no list marks, times or numbers, white space folded,
    lower case."""
    whole = unicodedata.normalize("NFC", text)
    if "-" in whole and ":" in whole:
        whole = _TIME.sub(" ", whole)
    whole = whole.lower()
    for d in _DIGITS if not whole.isascii() else "123456789":
        if d in whole:
            whole = whole.replace(d, "0")
    for z in _ZERO_WIDTH:
        if z in whole:
            whole = whole.replace(z, " ")
    out = []
    for line in whole.split("\n"):
        line = " ".join(line.split())
        if line and line[0] in _HEADED:
            line = line[_HEAD.match(line).end() :]
        out.append(line)
    return out


def fold(line: str) -> str:
    """One line as the models see it."""
    return " ".join(folded_lines(line))


def sentences(line: str) -> list[tuple[str, int]]:
    """(text, letters) of the sentences of a folded line that has letters besides masked ones."""
    out: list[tuple[str, int]] = []
    for part in _STOP.split(line) if _STOPS.search(line, 0, len(line) - 1) or line[-1:] in "。！？" else (line,):
        letters = sum(map(str.isalpha, _MASK.sub("", part) if _MASKED.search(part) else part))
        if not letters:
            continue
        if out and (letters < 8 or out[-1][1] < 8):
            out[-1] = (out[-1][0] + " " + part, out[-1][1] + letters)
        else:
            out.append((part, letters))
    return out


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 ... order the hash of the n codes that end at each place."""
    out = [np.zeros(len(codes), np.uint64)]
    c = codes.astype(np.uint64) + np.uint64(1)
    for n in range(1, order + 1):
        before = np.zeros(len(codes), np.uint64)
        before[1:] = out[n - 1][:-1]
        h = (before ^ (before >> np.uint64(29))) * _MULTIPLIER + c
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def _codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one row of code points, each with a lead of blanks; which places count; whose they are."""
    lead = " " * order
    whole = "".join(lead + t + " " for t in texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + order + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return codes, place >= order, owner


class HashArray:
    """A sorted array of hashes with the places at which each value of their leading bits begins, so that a search
    begins next to where it ends."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.size = len(keys)

    def __len__(self) -> int:
        return self.size

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each wanted hash, and whether it is there."""
        at = self.first[wanted >> self.shift]
        held = self.keys[at]
        open_ = np.flatnonzero(held < wanted)
        while len(open_):
            at[open_] += 1
            held[open_] = again = self.keys[at[open_]]
            open_ = open_[again < wanted[open_]]
        there = held == wanted
        return at, there & (at < self.size)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KneserNey:
    """Interpolated Kneser-Ney models of several classes over the same n-grams.

    For each order: the sorted hashes of all n-grams seen in any class, with a row of log probabilities;
    and the sorted hashes of all contexts, with a row of logs of the weight that a context leaves to the
    lower order.
    """

    def __init__(self, texts: list[list[str]], order: int = ORDER) -> None:
        self.order, classes = order, len(texts)
        counted: list[list[tuple]] = [[] for _ in range(order + 1)]  # [n][class] = grams, counts, contexts, suffixes
        vocabulary: set[int] = set()
        for own in texts:
            codes, counts_here, _ = _codes(own, order)
            vocabulary |= set(np.unique(codes).tolist())
            h = _hashes(codes, order)
            places = np.flatnonzero(counts_here)
            higher_suffix = None
            for n in range(order, 0, -1):
                grams, first, counts = np.unique(h[n][places], return_index=True, return_counts=True)
                where = places[first]
                if higher_suffix is not None:  # lower orders count in how many contexts a gram is new
                    s, c = np.unique(higher_suffix, return_counts=True)
                    counts = np.ones(len(grams), np.int64)
                    at, ok = _find(grams, s)
                    counts[at[ok]] = c[ok]
                contexts, suffixes = h[n - 1][where - 1], h[n - 1][where]
                counted[n].append((grams, counts, contexts, suffixes))
                higher_suffix = suffixes
        self.floor = -np.log(len(vocabulary) + 1)
        self.grams: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.logp: list[np.ndarray] = [np.zeros((0, classes), np.float32)]
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.logw: list[np.ndarray] = [np.zeros((0, classes), np.float32)]
        lower = None
        for n in range(1, order + 1):
            grams = np.unique(np.concatenate([x[0] for x in counted[n]]))
            contexts = np.unique(np.concatenate([x[2] for x in counted[n]]))
            context_of, suffix_of = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
            for own, _, ctx, suf in counted[n]:
                at = np.searchsorted(grams, own)
                context_of[at], suffix_of[at] = ctx, suf
            p, w = np.zeros((len(grams), classes)), np.ones((len(contexts), classes))
            for k, (own, counts, ctx, _) in enumerate(counted[n]):
                if not len(own):
                    continue
                ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
                discount = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
                c = np.searchsorted(contexts, ctx)
                total = np.bincount(c, counts, len(contexts))
                kinds = np.bincount(c, minlength=len(contexts))
                p[np.searchsorted(grams, own), k] = np.maximum(counts - discount, 0) / total[c]
                seen = total > 0
                w[seen, k] = np.maximum(discount * kinds[seen] / total[seen], 1e-12)
            below = np.exp(self.floor) if n == 1 else lower[np.searchsorted(self.grams[n - 1], suffix_of)]
            p += w[np.searchsorted(contexts, context_of)] * below
            lower = p
            self.grams.append(grams), self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(contexts), self.logw.append(np.log(w).astype(np.float32))
        self.places = [(HashArray(g), HashArray(c)) for g, c in zip(self.grams, self.contexts)]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each class, and its number of characters. Texts are taken in lots, and long
        ones in parts, so that memory does not go with their length."""
        sums, lengths = np.zeros((len(texts), self.logp[1].shape[1])), np.zeros(len(texts))
        lot: list[str] = []
        whose: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            for at in range(0, max(len(text), 1), PART):
                lot.append(text[at : at + PART])
                whose.append(i)
                held += len(lot[-1]) + self.order + 1
                if held >= AT_ONCE:
                    self._score_lot(lot, whose, sums, lengths)
                    lot, whose, held = [], [], 0
        if lot:
            self._score_lot(lot, whose, sums, lengths)
        return sums, lengths

    def _score_lot(self, texts: list[str], whose: list[int], sums_of: np.ndarray, lengths_of: np.ndarray) -> None:
        classes = self.logp[1].shape[1]
        codes, counts_here, owner = _codes(texts, self.order)
        h = _hashes(codes, self.order)
        at = np.flatnonzero(counts_here)
        sums = np.zeros((len(texts), classes))
        for n in range(self.order, 0, -1):
            row, ok = self.places[n][0].find(h[n][at])
            self._add(sums, owner[at[ok]], self.logp[n][row[ok]])
            at = at[~ok]
            row, ok = self.places[n][1].find(h[n - 1][at - 1])
            self._add(sums, owner[at[ok]], self.logw[n][row[ok]])
        self._add(sums, owner[at], np.full((len(at), classes), self.floor, np.float32))
        np.add.at(sums_of, whose, sums)
        np.add.at(lengths_of, whose, np.bincount(owner[counts_here], minlength=len(texts)))

    @staticmethod
    def _add(sums: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
        if len(owner):  # owners ascend, so each has one run of rows
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sums[owner[start]] += np.add.reduceat(rows, start, axis=0, dtype=np.float64)


class LanguageModel:
    """The fitted models with their classes and the cross-entropy above which a sentence is rejected."""

    def __init__(self, models: KneserNey, classes: list[str], reject: np.ndarray) -> None:
        self.models, self.classes, self.reject = models, classes, reject


def fit(lines: list[tuple[str, str]]) -> LanguageModel:
    """Fit on (label, line) pairs, labels being languages or CODE. Labels may be wrong for a share of the
    lines: two folds judge each other, and a line that fits another class about as well as its own is put
    aside, in every round anew, before the final fit; no line ever changes its label. The rejection threshold of a class is taken from lines that its model had not seen."""
    texts, labels = [], []
    for label, line in sorted(set(lines)):
        whole = fold(line)
        if any(map(str.isalpha, whole)) and (label == CODE or _ENDED.search(whole)):
            texts.append(whole[:FIT_CHARS])
            labels.append(label)
    classes = sorted(set(labels))
    if not classes:
        classes = ["en"]
    own = np.array([classes.index(x) for x in labels], int)
    half = np.arange(len(texts)) % 2
    sure = np.ones(len(texts), bool)
    by_class = lambda which: [[texts[i] for i in np.flatnonzero(which & sure & (own == k))] for k in range(len(classes))]
    reject = np.full(len(classes), np.inf)
    entropy = np.zeros(len(texts))
    for _ in range(ROUNDS if len(texts) > 1 else 0):
        passed = np.zeros(len(texts), bool)
        for side in (0, 1):
            held = np.flatnonzero(half == side)
            ll, n = KneserNey(by_class(half != side)).score([texts[i] for i in held])
            mine = ll[np.arange(len(held)), own[held]].copy()
            ll[np.arange(len(held)), own[held]] = -np.inf
            passed[held] = (mine > ll.max(1) + DOUBT) if len(classes) > 1 else True
            entropy[held] = -mine / n
        sure = passed
    for k in range(len(classes)):
        if (mine := entropy[sure & (own == k)]).size >= 20:
            reject[k] = np.quantile(mine, REJECT_QUANTILE) * REJECT_SLACK
    return LanguageModel(KneserNey(by_class(np.ones(len(texts), bool))), classes, reject)


def fitting_lines(df: DataFrame, text: str, lang: str, fit_lines: int = FIT_LINES) -> list[tuple[str, str]]:
    """A bounded sample of (label, line): about `fit_lines` lines of each language by its label, and as
    many of fenced code. Chosen by hash, at a rate that follows from the count of labelled documents, so
    neither the order of rows nor the number of partitions matters; a dozen lines of a document at most."""
    stated = F.regexp_extract(F.lower(F.trim(F.col(lang))), r"^([a-z]+)(?:[-_.@( ].*)?$", 1)
    code_of = F.create_map(*(F.lit(x) for kv in _KNOWN.items() for x in kv))
    known = df.where(F.col(text).isNotNull()).select(F.try_element_at(code_of, stated).alias("label"), F.col(text).alias("t"), F.pmod(F.xxhash64(text), F.lit(1 << 40)).alias("h")).where("label is not null and length(t) > 40")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    docs = fit_lines // 3
    rates = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, docs / n) * (1 << 40))))) if counts else F.create_map(F.lit(""), F.lit(0))
    chosen = known.where(F.col("h") < F.try_element_at(rates, F.col("label"))).select("label", F.slice(F.transform(F.split("t", "\n"), lambda x: F.substring(x, 1, FIT_CHARS)), 1, 40).alias("lines"), "h")
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: r["h"]):
        fenced, taken = False, 0
        for line in r["lines"]:
            if line.strip().startswith("```"):
                fenced = not fenced
            elif line.strip() and taken < 12:
                mine = found.setdefault(CODE if fenced else r["label"], [])
                if len(mine) < fit_lines:
                    mine.append(line)
                    taken += 1
    return [(k, x) for k, v in found.items() for x in v]


def _totals(group: np.ndarray, groups: int, chosen: np.ndarray, weights: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of sentences the class with most weight among `chosen`, and the confidence: the class's share
    of the weight times the certainty of the sentences that are in it."""
    classes = score.shape[1]
    amount = np.bincount(group * classes + chosen, weights, groups * classes).reshape(groups, classes)
    best = amount.argmax(1)
    own = chosen == best[group]
    total = np.stack([np.bincount(group[own], score[own, c], groups) for c in range(classes)], 1)
    at = np.arange(groups)
    certain = 1 / np.exp(np.clip(TEMPER * (total - total[at, best][:, None]), -50, 50)).sum(1)
    return best, np.round(amount[at, best] / np.maximum(amount.sum(1), 1) * certain, 4)


def classify(model: LanguageModel, texts: list[str | None]) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
    """For each text its language, the confidence, and the lines that hold a sentence, with theirs. A sentence that
    occurs more than once is scored once."""
    distinct: dict[str, int] = {}
    of: list[tuple[int, int, int, int]] = []
    for d, text in enumerate(texts):
        if text:
            for n, line in enumerate(folded_lines(text), 1):
                if line:
                    for t, letters in sentences(line):
                        of.append((d, n, letters, distinct.setdefault(t, len(distinct))))
    out: list = [(None, 0.0, []) for _ in texts]
    if not of:
        return out
    ll, n_chars = model.models.score(list(distinct))
    languages = [k for k, c in enumerate(model.classes) if c != CODE]
    names = [model.classes[k] for k in languages]
    doc, line, letters, which = np.array(of, np.int64).T
    score = ll[:, languages]
    best = score.argmax(1)
    top = score.max(1)
    fits = top / -n_chars <= model.reject[languages][best]
    if CODE in model.classes:
        fits &= top + PRIOR > ll[:, model.classes.index(CODE)]
    kept = fits[which]
    if not kept.any():
        return out
    doc, line, letters, which = doc[kept], line[kept], letters[kept], which[kept]
    score, best, top = score[which], best[which], top[which]
    docs, doc = np.unique(doc, return_inverse=True)
    classes = len(names)
    whole = np.bincount(doc * classes + best, letters, len(docs) * classes).reshape(len(docs), classes).argmax(1)[doc]
    own = np.where(top > score[np.arange(len(doc)), whole] + PRIOR, best, whole)
    first = np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]
    spot = np.cumsum(first) - 1
    of_doc, sure = _totals(doc, len(docs), own, letters, score)
    of_line, line_sure = _totals(spot, int(spot[-1]) + 1, own, letters, score)
    lines: list[list[tuple[int, str, float]]] = [[] for _ in docs]
    for d, n, k, c in zip(doc[first].tolist(), line[first].tolist(), of_line.tolist(), line_sure.tolist()):
        lines[d].append((n, names[k], c))
    for d, k, c, x in zip(docs.tolist(), of_doc.tolist(), sure.tolist(), lines):
        out[d] = (names[k], c, x)
    return out



def label_languages(df: DataFrame, key: str, text: str, lang: str, model: LanguageModel) -> DataFrame:
    """`key`, `line_no`, `lang`, `confidence`, `stated`: line 0 is the document with the language of most
    letters of its sentences; lines from 1 follow for documents whose lines are in several languages, one
    row for each line with a sentence. `stated` is the language that the label names, or null.

    Null, empty and wordless texts, and texts of code alone, have a null language with confidence 0.
    Whole texts are read, whatever their length. A row depends on its document alone: nothing is
    shuffled but where the input has fewer partitions than cores, and no document is collected. The model travels as one broadcast, its size bounded by the fitting sample.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[str | None, str | None] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                at, numbers, langs, sures, stated = [], [], [], [], []
                for i, (label, (whole, sure, lines)) in enumerate(zip(part.column(2).to_pylist(), classify(own, part.column(1).to_pylist()))):
                    if label not in known:
                        if len(known) > 10_000:  # labels are few; what is not a label may be anything
                            known.clear()
                        known[label] = label_code(label)
                    found = [(0, whole, sure)]
                    if len({x[1] for x in lines}) > 1:
                        found += lines
                    for n, x, c in found:
                        at.append(i), numbers.append(n), langs.append(x), sures.append(c), stated.append(known[label])
                columns = [part.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(langs, pa.string()), pa.array(sures, pa.float64()), pa.array(stated, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "line_no", "lang", "confidence", "stated"])

    chosen = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")))
    return chosen.mapInArrow(run, f"`{key}` {kind}, line_no int, lang string, confidence double, stated string")
