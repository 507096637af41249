"""Language of documents and of their single-language stretches.

A sentence is the average of the embeddings of its hashed subwords (character 2- to 5-grams, word starts and ends
marked), a linear softmax over them gives the language. Both are trained by stochastic gradient descent in numpy on
the labelled samples (at most SAMPLES of a language). As the model is linear, embeddings times softmax weights are stored
as one row of class scores per bucket. A temperature fitted on held-out samples calibrates the confidence; a sentence
below the confidence, or made of subwords of which too few were seen in training, gets no language (rejection).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm import sentences as S
from quirework.session import spread

#: Labelled samples of a language, and sentences of a language that self-training adds.
SAMPLES, SELF_TRAINED = 1000, 150
BUCKETS, DIM = 1 << 17, 16
LEAST_CONFIDENCE, LEAST_SEEN = 0.75, 0.25

# ISO 639-1 code, then 639-2 and 639-3 codes and names.
NAMES = {
    "en": "eng english anglais englisch inglés inglês английский", "fr": "fra fre french français francais französisch francés",
    "es": "spa spanish español espanol castellano castilian espagnol spanisch", "pt": "por portuguese português portugues portugais",
    "de": "deu ger german deutsch allemand alemán alemão", "ru": "rus russian русский russisch russe", "am": "amh amharic አማርኛ amarigna amharique",
    "hi": "hin hindi हिन्दी हिंदी", "ar": "ara arb arabic العربية عربي arabe arabisch", "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語 chinois",
    "ja": "jpn japanese 日本語 japonais", "th": "tha thai ไทย ภาษาไทย", "it": "ita italian italiano", "nl": "nld dut dutch nederlands",
    "om": "orm oromo", "ti": "tir tigrinya", "so": "som somali", "sw": "swa swahili", "ko": "kor korean 한국어", "tr": "tur turkish türkçe",
}
_SPELLED = {w: code for code, text in NAMES.items() for w in [code, *text.split()]}
_QUOTED = S._QUOTE
_QUOTE_MARK = re.compile("[\"«“„「『‹]")
_LETTERS = re.compile(r"[^\W\d_]")


def language_code(label: Column) -> Column:
    """The ISO 639-1 code a label names (code, region variant or name, any case); null for null, blank, unknown, und, n/a and anything else unknown."""
    names = F.create_map(*[F.lit(x) for pair in _SPELLED.items() for x in pair])
    low = F.lower(F.trim(label))
    return F.coalesce(names[low], names[F.regexp_extract(low, r"^([^-_\s(,;/]+)", 1)])


_WORDS = re.compile("[぀-ヿ㐀-鿿]{1,2}|[฀-๿]{1,4}|[^\\s\\d.,;:!?()\\[\\]{}<>\"'“”„«»‘’…。、？！，：；（）「」『』،؟؛።፣፤।॥/|*%#@&+=_~^$-]+")


def words(text: str) -> list[str]:
    """Lower-case words; scripts without spaces in runs of 2 or 4 characters."""
    return _WORDS.findall(text.lower())


def _ngrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every 2- to 5-gram of each word, its start and end marked."""
    text = "".join(f"<{w}>" for w in found)
    flat = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(w) + 2 for w in found])
    h = flat * np.uint64(0x9E3779B97F4A7C15)
    one, owners, buckets = h, [], []
    for n in (2, 3, 4, 5):
        if len(flat) < n:
            break
        one = one[:-1] * np.uint64(0x100000001B3) ^ h[n - 1 :]
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        mixed = one[inside]
        owners.append(owner[n - 1 :][inside])
        buckets.append((((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 17)).astype(np.int64))
    return (np.concatenate(owners), np.concatenate(buckets)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Numbers(dict):
    """Word -> row; new words queue up to be scored."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Model:
    """Class scores per bucket, temperature and the languages in order. Scores of words are remembered."""

    LIMIT = 400_000

    def __init__(self, languages: list[str], scores: np.ndarray, seen: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.scores, self.seen, self.bias, self.temperature = languages, scores, seen, bias, temperature
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.rows = _Numbers(), np.zeros((0, len(self.languages) + 2), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("numbers", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _score(self, found: list[str]) -> np.ndarray:
        """A row a word: summed class scores, subwords seen, subwords."""
        out = np.zeros((len(found), len(self.languages) + 2), np.float32)
        owner, bucket = _ngrams(found)
        known = self.seen[bucket]
        np.add.at(out[:, :-2], owner[known], self.scores[bucket[known]])
        out[:, -2] = np.bincount(owner[known], minlength=len(found))
        out[:, -1] = np.bincount(owner, minlength=len(found))
        return out

    def label(self, pieces: list[str]) -> list[tuple[str | None, float]]:
        """(language or None, confidence) of each piece."""
        if not pieces:
            return []
        if len(self.numbers) > self.LIMIT:
            self._forget()
        number = self.numbers
        ids = [[number[w] for w in words(p)] for p in pieces]
        if number.fresh:
            self.rows = np.vstack([self.rows, self._score(number.fresh)])
            number.fresh = []
        sizes = np.array([len(x) for x in ids])
        total = np.zeros((len(pieces), self.rows.shape[1]))
        some = sizes > 0
        if some.any():
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
            total[some] = np.add.reduceat(self.rows[flat], np.r_[0, np.cumsum(sizes[some])[:-1]], axis=0)
        seen, count = total[:, -2], total[:, -1]
        z = (total[:, :-2] / np.maximum(seen, 1)[:, None] + self.bias) * self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        conf = p[np.arange(len(p)), best]
        good = (seen >= LEAST_SEEN * np.maximum(count, 1)) & (conf >= LEAST_CONFIDENCE)
        return [(self.languages[i], round(float(c), 6)) if k else (None, 0.0) for i, c, k in zip(best, conf, good, strict=True)]


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 16, rate: float = 0.5, least: int = 4, most: int = 24) -> Model:
    """From (language, text). Texts are cut into windows of least to most words; every sixth is held out to fit the temperature, then all are learned."""
    rng = np.random.default_rng(seed)
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    windows, labels = [], []
    for language, text in rows:
        found, at, step = words(text), 0, 0
        while at < len(found):
            size = (least, 2 * least, 3 * least, most)[step % 4]
            piece = found[at : at + size]
            if len(piece) >= min(least, len(found)):
                windows.append(_ngrams(piece)[1])
                labels.append(number[language])
            at, step = at + max(1, size // 2), step + 1
    y = np.array(labels)

    def fit(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        w, b = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
        for t in range(epochs):
            lr = rate * (1 - t / epochs)
            for i in rng.permutation(use):
                ids = windows[i]
                x = e[ids].mean(0)
                z = x @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                gx = w @ p
                w -= lr * np.outer(x, p)
                b -= lr * 0.1 * p
                e[ids] -= lr * gx  # the mean is over many; the step is per subword, as is usual for averaged embeddings
        return e, w, b

    every = np.array([i for i in range(len(windows)) if len(windows[i])], np.int64)
    held, kept = every[5::6], np.setdiff1d(every, every[5::6])
    temperature = 1.0
    seen = np.zeros(BUCKETS, bool)
    if len(held) > len(languages):
        e, w, b = fit(kept)
        for i in kept:
            seen[windows[i]] = True
        z = np.array([(e[k].mean(0) if len(k := windows[i][seen[windows[i]]]) else np.zeros(DIM)) @ w + b for i in held])
        grid = np.geomspace(0.1, 10, 41)
        loss = []
        for t in grid:
            q = z * t
            q -= q.max(1, keepdims=True)
            loss.append(-(q[np.arange(len(held)), y[held]] - np.log(np.exp(q).sum(1))).mean())
        temperature = float(grid[int(np.argmin(loss))])
    e, w, b = fit(every)
    for i in every:
        seen[windows[i]] = True
    scores = np.where(seen[:, None], e @ w, 0).astype(np.float32)
    return Model(languages, scores, seen, b.astype(np.float64), temperature)


def retrain(first: Model, rows: list[tuple[str, str]], texts: list[str], boundaries: S.Model, most: int = SELF_TRAINED) -> Model:
    """Self-training: sentences of texts in which nearly all sure sentences agree take their language, at most most a language; they teach headings and names that the samples lack."""
    taken: dict[str, list[str]] = {x: [] for x in first.languages}
    for text in texts:
        starts = boundaries.starts(text)
        pieces = [_spoken(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        labels = first.label(pieces)
        sure = [x for x, c in labels if x and c > 0.9]
        top = max(set(sure), key=sure.count) if sure else None
        if top and len(sure) >= 2 and sure.count(top) == len(sure) and all(x in (top, None) or c < 0.8 for x, c in labels):
            taken[top] += pieces[: max(0, most - len(taken[top]))]
    extra = [(x, p) for x in first.languages for p in taken[x]]
    return train([*rows, *extra], epochs=4) if extra else first


_trained: dict[str, Model] = {}


def train_on(samples: DataFrame, documents: DataFrame | None = None, boundaries: S.Model | None = None, sample: int = S.SAMPLE) -> Model:
    """From (language, sample_text), at most SAMPLES of each language by hash, labels in any usual spelling; then from texts of documents drawn as in sentences.drawn. The same sample is learned once a process."""
    rows = S.labelled(samples.select(language_code(F.col("language")).alias("language"), "sample_text"), most=SAMPLES)
    texts = S.drawn(documents, sample=sample) if documents is not None and boundaries is not None else []
    name = xxhash.xxh3_128_hexdigest(repr((rows, texts, id(boundaries))).encode("utf-8", "replace"))
    if name not in _trained:
        first = train(rows)
        _trained[name] = retrain(first, rows, texts, boundaries) if texts else first
    return _trained[name]


def _spoken(sentence: str) -> str:
    """The sentence without what it quotes, if enough is left to tell a language."""
    if _QUOTE_MARK.search(sentence) is None:
        return sentence
    bare = _QUOTED.sub(" ", sentence)
    return bare if len(_LETTERS.findall(bare)) >= 20 else sentence


def stretches(documents: DataFrame, boundaries: S.Model, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stretch_ix, start, end, language, confidence, sentences): runs of sentences of one language.

    A sentence without a language of its own joins the run it is in; a text of only such sentences is one run with null
    language. Confidence is the mean over the characters of the run. Null and blank texts have no run. No shuffle.
    """

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                starts = [boundaries.starts(t) for t in part["_text"]]
                pieces = [_spoken(t[a:b]) for t, s in zip(part["_text"], starts, strict=True) for a, b in zip(s, [*s[1:], len(t)], strict=True)]
                labels = iter(model.label(pieces))
                for k, t, s in zip(part["_key"], part["_text"], starts, strict=True):
                    runs: list[list] = []
                    for a, b in zip(s, [*s[1:], len(t)], strict=True):
                        language, confidence = next(labels)
                        size = b - a
                        if runs and (language is None or runs[-1][2] is None or runs[-1][2] == language):
                            run = runs[-1]
                            run[1], run[2], run[4] = b, run[2] or language, run[4] + 1
                            run[3] += confidence * size
                            run[5] += size if language else 0
                        else:
                            runs.append([a, b, language, confidence * size, 1, size if language else 0])
                    out += [(k, i, a, a + len(t[a:b].rstrip()), lang, (c / n if n else 0.0), m) for i, (a, b, lang, c, m, n) in enumerate(runs)]
            yield pd.DataFrame(out, columns=["_key", "stretch_ix", "start", "end", "language", "confidence", "sentences"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key IS NOT NULL AND length(_text) > 0")).mapInPandas(cut, f"_key {kind}, stretch_ix int, start bigint, end bigint, language string, confidence double, sentences int").withColumnRenamed("_key", key)


def document_languages(runs: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, language, confidence, languages), a row a key of documents: the language of most characters, its mean confidence times its share, and all languages by code.

    A document without a sentence of a known language (null, empty, or all rejected) has null language, confidence 0 and no languages.
    """
    by = runs.filter("language IS NOT NULL").groupBy(key, "language").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.sum(F.col("confidence") * (F.col("end") - F.col("start"))).alias("c"))
    known = by.groupBy(key).agg(F.max_by(F.struct("language", "c"), F.struct("n", "language")).alias("b"), F.sum("n").alias("all"), F.sort_array(F.collect_list("language")).alias("languages"))
    every = documents.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left")
    return every.select(key, "b.language", F.coalesce(F.round(F.col("b.c") / F.col("all"), 6), F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"))


def current_profiles(profiles: DataFrame) -> DataFrame:
    """(file_hash, named): the language named by the row with the greatest profiled_at of each doc_id; equal times: the greatest code."""
    code = language_code(F.col("language"))
    return profiles.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("file_hash")).agg(F.max_by(F.struct(code.alias("code")), F.struct(F.coalesce("profiled_at", F.timestamp_seconds(F.lit(0))), F.coalesce(code, F.lit("")))).alias("r")).select("file_hash", F.col("r.code").alias("named"))


def unnamed_languages(documents: DataFrame, profiles: DataFrame, boundaries: S.Model, model: Model) -> DataFrame:
    """(doc_id, language): languages of whole sentences of a document that its current profile does not name."""
    found = stretches(documents, boundaries, model).filter("language IS NOT NULL").select("doc_id", "language").distinct()
    labelled = documents.select("doc_id", "file_hash").join(current_profiles(profiles), "file_hash", "left").select("doc_id", "named")
    return found.join(labelled, "doc_id").filter("named IS NULL OR named <> language").select("doc_id", "language").distinct()
