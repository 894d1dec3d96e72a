"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, learned by expectation maximisation
over all segmentations. A word's likelihood is the sum over all ways to cut it into pieces, found by the forward
algorithm; a text's is the product over its words. Words are scored once for a batch, many side by side."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, tidied

UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")
_MARK = "▁"  # stands before the first letter of a word in the vocabulary
_SCALE = 40.0  # per character, the same for every language and segmentation, so it cancels out
_CACHE_WORDS = 200_000


def public_vocabulary() -> list[str]:
    """The pieces of the public 32k vocabulary."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def letter_runs(text: str) -> list[str]:
    """Runs of letters of the text in lower case."""
    return _RUN.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


@dataclass
class UnigramModel:
    """languages; the alphabet; pieces as a trie: table[state, letter] -> state, 0 dead, 1 root; prob[state, language],
    0 where no piece ends, with the scale of its length. Letter 0 is any character outside the alphabet."""

    languages: list[str]
    alphabet: str
    table: np.ndarray
    prob: np.ndarray
    other: float = 1e-3 * _SCALE
    _letters: dict = field(default_factory=dict, repr=False)

    def codes(self, words: list[str], width: int) -> np.ndarray:
        if not self._letters:
            self._letters.update({c: i + 1 for i, c in enumerate(self.alphabet)})
        get = self._letters.get
        out = np.full((len(words), width), -1, np.int32)
        for row, word in enumerate(words):
            out[row, : len(word) + 1] = [get(c, 0) for c in _MARK + word]
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word | language) up to a constant of the word, one row for each word."""
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):  # words of similar length together, so that padding stays small
            width = len(words[order[at]]) + 1
            end = at
            while end < len(order) and end - at < 20_000 and len(words[order[end]]) < width + width // 4:
                end += 1
            rows = order[at:end]
            out[rows] = self._forward([words[i] for i in rows])
            at = end
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        lengths = np.array([len(w) + 1 for w in words])
        width = int(lengths.max())
        codes = self.codes(words, width)
        n, k, reach = len(words), len(self.languages), self.reach
        # A ring of positions: those a piece can reach from here.
        alpha = np.zeros((reach + 1, n, k))
        alpha[0] = 1.0
        logs, out = np.zeros((n, k)), np.zeros((n, k))
        for i in range(width + 1):
            here = alpha[i % (reach + 1)]
            done = lengths == i
            if done.any():
                out[done] = np.log(np.maximum(here[done], 1e-300)) + logs[done]
            if i == width:
                break
            if i and i % 16 == 0:
                top = np.maximum(alpha.max(axis=0), 1e-300)
                alpha /= top
                logs += np.log(top)
                here = alpha[i % (reach + 1)]
            live = np.flatnonzero(lengths > i)
            state = np.ones(len(live), np.int32)
            code = codes[live, i]
            odd = code == 0
            if odd.any():
                alpha[(i + 1) % (reach + 1), live[odd]] += here[live[odd]] * self.other
            step = 0
            while len(live) and step < reach and i + step < width:
                code = codes[live, i + step]
                state = np.where(code > 0, self.table[state, np.maximum(code, 0)], 0)
                keep = state > 0
                live, state = live[keep], state[keep]
                step += 1
                if len(live):
                    alpha[(i + step) % (reach + 1), live] += here[live] * self.prob[state]
            alpha[i % (reach + 1)] = 0.0
        return out

    @property
    def reach(self) -> int:
        return int(self.table[0, 0])

    def posterior(self, totals: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for the average word of each text."""
        scaled = totals / np.maximum(words, 1)[:, None]
        scaled -= scaled.max(axis=1, keepdims=True)
        weights = np.exp(scaled)
        return weights / weights.sum(axis=1, keepdims=True)


def _trie(pieces: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """The table and the state at which each piece ends. table[0, 0] holds the longest piece's length."""
    letters = {c: i + 1 for i, c in enumerate(alphabet)}
    edges: dict[tuple[int, int], int] = {}
    ends = []
    for piece in pieces:
        state = 1
        for c in piece:
            state = edges.setdefault((state, letters[c]), len(edges) + 2)
        ends.append(state)
    table = np.zeros((len(edges) + 2, len(alphabet) + 1), np.int32)
    for (state, letter), to in edges.items():
        table[state, letter] = to
    table[0, 0] = max(map(len, pieces), default=1)
    return table, np.array(ends, np.int64)


def fit_unigrams(words: dict[str, Counter], vocabulary: list[str], rounds: int = 4, smooth: float = 0.05) -> UnigramModel:
    """Piece probabilities of each language from its word counts, by `rounds` steps of expectation maximisation.
    Every character seen is a piece, so each word has a segmentation."""
    languages = sorted(words)
    seen = {c for counts in words.values() for w in counts for c in w} | {_MARK}
    alphabet = "".join(sorted(seen))
    pieces = sorted({p for p in map(str.lower, vocabulary) if p and set(p) <= seen} | seen)
    table, ends = _trie(pieces, alphabet)
    sizes = np.array([len(p) for p in pieces])
    probs = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        counted = np.zeros_like(probs)
        for k, language in enumerate(languages):
            counted[:, k] = _expected(words[language], table, ends, probs[:, k], sizes, {c: i + 1 for i, c in enumerate(alphabet)})
        counted += smooth
        probs = counted / counted.sum(axis=0)
    used = (counted.max(axis=1, initial=0.0) > smooth + 0.01) | (sizes == 1)
    pieces = [p for p, u in zip(pieces, used, strict=True) if u]
    table, ends = _trie(pieces, alphabet)
    prob = np.zeros((len(table), len(languages)))
    prob[ends] = probs[used] * _SCALE ** sizes[used][:, None]
    return UnigramModel(languages, alphabet, table, prob)


def _expected(counts: Counter, table: np.ndarray, ends: np.ndarray, probs: np.ndarray, sizes: np.ndarray, letters: dict) -> np.ndarray:
    """How often each piece is used over all segmentations of all words (forward-backward), many words at a time."""
    prob = np.zeros(len(table))
    prob[ends] = probs * _SCALE**sizes
    used = np.zeros(len(table))
    reach = int(table[0, 0])
    items = sorted(((w, n) for w, n in counts.items() if len(w) <= 64), key=lambda x: len(x[0]))
    for at in range(0, len(items), 5000):
        part = items[at:at + 5000]
        width = len(part[-1][0]) + 1
        lengths = np.array([len(w) + 1 for w, _ in part])
        amount = np.array([n for _, n in part], float)
        codes = np.zeros((len(part), width), np.int32)
        for row, (word, _) in enumerate(part):
            codes[row, : len(word) + 1] = [letters[c] for c in _MARK + word]
        alpha, beta = np.zeros((len(part), width + 1)), np.zeros((len(part), width + 1))
        alpha[:, 0] = 1.0
        beta[np.arange(len(part)), lengths] = 1.0
        arcs = []
        for i in range(width):
            rows, state = np.flatnonzero(lengths > i), None
            state = np.ones(len(rows), np.int32)
            for step in range(1, min(reach, width - i) + 1):
                state = table[state, codes[rows, i + step - 1]]
                keep = (state > 0) & (lengths[rows] >= i + step)
                rows, state = rows[keep], state[keep]
                if not len(rows):
                    break
                arcs.append((i, i + step, rows, state))
                alpha[rows, i + step] += alpha[rows, i] * prob[state]
        for i, end, rows, state in reversed(arcs):
            beta[rows, i] += beta[rows, end] * prob[state]
        whole = alpha[np.arange(len(part)), lengths]
        weight = np.where(whole > 0, amount / np.maximum(whole, 1e-300), 0.0)
        for i, end, rows, state in arcs:
            np.add.at(used, state, alpha[rows, i] * prob[state] * beta[rows, end] * weight[rows])
    return used[ends]


def held_out(doc_id: Column) -> Column:
    """Documents kept out of fitting: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, vocabulary: list[str] | None = None, per_language: int = 256, total: int = 4096,
                  longest: int = 20_000) -> UnigramModel:
    """Fit on a bounded sample of labelled rows that are not held out: at most `per_language` texts of a language and
    `total` in all, of at most `longest` characters, the lowest by a hash of doc_id. A language's share of hashes
    follows from its count, so tasks hand on a few texts only. Null texts and languages are left out; of more than
    `total` languages the most frequent are learned."""
    taught = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = taught.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(total)
    shares = counts.select("lang", (F.lit(2.0 * per_language) / F.col("count")).alias("_share"))
    hashed = F.xxhash64("doc_id")
    rows = taught.select("doc_id", "text", "lang").filter(F.length("text").between(1, longest)).join(F.broadcast(shares), "lang")
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id", "text")
    sample = rows.filter(hash_share(hashed, F.col("_share"))).withColumn("_rank", F.row_number().over(order))
    sample = sample.filter(F.col("_rank") <= per_language).orderBy("_rank", "lang").limit(total).select("lang", "text")
    words: dict[str, Counter] = {}
    for lang, text in sample.collect():  # at most `total` rows of at most `longest` characters
        found = [w for w in letter_runs(text) if w.isalpha()]
        if found:
            words.setdefault(lang, Counter()).update(found)
    return fit_unigrams(words, public_vocabulary() if vocabulary is None else vocabulary)


def identify(texts: list[str | None], model: UnigramModel, cache: dict[str, int], scores: list[np.ndarray]) -> tuple[list[str], list[float]]:
    """Language and score of each text. `cache` maps a word to its row in scores[0]; both are emptied when large."""
    runs = [letter_runs(t) if t else [] for t in texts]
    if len(cache) > _CACHE_WORDS:
        cache.clear()
        scores[0] = scores[0][:0]
    new = list({w for words in runs for w in words if w not in cache})
    if new:
        base = len(scores[0])
        scores[0] = np.concatenate([scores[0], model.forward(new)])
        cache.update(zip(new, range(base, base + len(new)), strict=True))
    sizes = np.array([len(words) for words in runs])
    get = cache.__getitem__
    totals = np.zeros((len(texts), len(model.languages)))
    for row, words in enumerate(runs):
        if words:
            totals[row] = scores[0][np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
    posterior = model.posterior(totals, sizes)
    names, values = [], []
    for row, words in enumerate(runs):
        best = int(posterior[row].argmax()) if words and has_letter(words) else -1
        names.append(UNKNOWN if best < 0 else model.languages[best])
        values.append(0.0 if best < 0 else float(posterior[row, best]))
    return names, values


def predict_languages(df: DataFrame, model: UnigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for every whole text. score is the posterior of the text's average word, 0 to 1. A
    text that is null, empty or has no letter is `und` with score 0, as is every text where nothing was learned.
    Ties go to the first language in order. Only the two named columns are read."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces of a fixed vocabulary: bounded

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache: dict[str, int] = {}
        scores = [np.zeros((0, len(model.languages)))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model.languages:
                names, values = identify(texts, model, cache, scores)
            else:
                names, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                                             ["id", "lang_pred", "score"])

    picked = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return picked.mapInArrow(tidied(predict), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_column(text: Column, model: UnigramModel) -> Column:
    """lang_pred and score of a text column as a struct, by the rules of predict_languages."""

    @F.pandas_udf("lang_pred string, score double")
    @tidied
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        scores = [np.zeros((0, len(model.languages)))]
        for part in texts:
            if model.languages:
                names, values = identify([t if isinstance(t, str) else None for t in part], model, cache, scores)
            else:
                names, values = [UNKNOWN] * len(part), [0.0] * len(part)
            yield pd.DataFrame({"lang_pred": names, "score": values})

    return predict(text)
