"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of word pieces; for each language a probability of each piece.
The probability of a word in a language is the sum over all its segmentations into
pieces, found by a forward pass; a text is the product of its words. Piece probabilities
are fitted by expected counts (forward and backward pass over the training words, EM).

Words are runs of letters of the lower-cased text, each with a word-start mark. Letters
outside the vocabulary count as one unknown piece each. Words of any length take part in
both; the sums are kept as logarithms or rescaled on the way, so that none becomes 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold_memo, materialize, read_table

#: Bounds on the training sample: rows of a language, those with a small md5 of their id,
#: and languages, those with most rows.
TRAIN_ROWS, TRAIN_LANGS = 3000, 200
EM_ROUNDS = 2
SMOOTH = 0.1
#: Letters of the words that are passed through side by side, and ends that are looked up at once.
BATCH_LETTERS, WIDTH = 1 << 16, 1 << 13
#: Steps after which the forward sums are rescaled.
RESCALE = 8
#: Scores of words by languages that a worker remembers.
MEMO_CELLS = 1_600_000
#: Characters of the texts whose new words are scored together.
BATCH_TEXT = 1 << 20
WORDS = re.compile(r"[^\W\d_]+")
MARK = "▁"


@lru_cache(2)
def load_pieces(name: str) -> dict[str, int]:
    """Pieces of letters, with or without the word-start mark."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    pieces = sorted({x.lower() for x in found if WORDS.fullmatch(x.removeprefix(MARK).lower() or "a") and x.count(MARK) <= 1})
    return {x: i + 1 for i, x in enumerate(pieces)}


class PieceTable:
    """Sorted hashes of all prefixes of all pieces, with the piece that a prefix is, or 0."""

    def __init__(self, pieces: dict[str, int]):
        found: dict[str, int] = {}
        for x, i in pieces.items():
            for k in range(1, len(x)):
                found.setdefault(x[:k], 0)
            found[x] = i
        hashes = np.array([self.of(x) for x in found], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], np.array(list(found.values()), np.int32)[order]
        self.unknown, self.longest = len(pieces) + 1, max(map(len, pieces), default=1)

    BASE = 0x9E3779B97F4A7C15

    @classmethod
    def of(cls, x: str) -> int:
        h = 0
        for c in x:
            h = (h * cls.BASE + ord(c) + 1) % (1 << 64)
        return h

    def ids(self, chars: np.ndarray, first: int, last: int) -> np.ndarray:
        """(word, end - first, length) -> piece, 0: none, for the ends first + 1 .. last.

        A letter that is no piece by itself gets the unknown piece, the last id.
        """
        back = min(first, self.longest)
        own = chars[:, first - back : last]
        m, n = own.shape
        out = np.zeros((m, n + 1, self.longest + 1), np.int32)
        row, start = (x.ravel() for x in np.indices((m, n)))
        h = np.zeros(len(row), np.uint64)
        for k in range(1, min(n, self.longest) + 1):
            inside = start + k <= n
            row, start, h = row[inside], start[inside], h[inside]
            h = h * np.uint64(self.BASE) + own[row, start + (k - 1)]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            row, start, h, at = row[known], start[known], h[known], at[known]
            out[row, start + k, k] = self.piece[at]
        single = out[:, 1:, 1]
        single[single == 0] = self.unknown
        return out[:, back + 1 :]


def letters(words: list[str]) -> np.ndarray:
    """The letters of words, each after a word-start mark, as one row each; shorter rows end in 0."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    out = np.zeros((len(words), sizes.max()), np.uint64)
    points = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = points.astype(np.uint64) + np.uint64(1)
    return out


def batches(sizes: np.ndarray):
    """Indexes of words, in order of length, that are passed through together."""
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        ends = sizes[order[at:]] * np.arange(1, len(order) - at + 1)
        n = max(1, int(np.searchsorted(ends, BATCH_LETTERS, side="right")))
        yield order[at : at + n]
        at += n


@lru_cache(2)
def load_table(name: str) -> PieceTable:
    return PieceTable(load_pieces(name))


def forward(chars: np.ndarray, sizes: np.ndarray, table: PieceTable, prob: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of each word, a column for each language."""
    m, n = chars.shape
    out = np.empty((m, prob.shape[1]))
    shift = np.zeros((m, prob.shape[1]))
    sums = np.zeros((table.longest + 1, m, prob.shape[1]))  # of the last prefixes, in turn
    sums[0] = 1
    ending = np.argsort(sizes, kind="stable")
    done = np.searchsorted(sizes[ending], np.arange(n + 2))
    for first in range(0, n, WIDTH):
        ids = table.ids(chars, first, min(first + WIDTH, n))
        for e in range(first + 1, min(first + WIDTH, n) + 1):
            now = np.zeros((m, prob.shape[1]))
            for k in range(1, min(e, table.longest) + 1):
                col = ids[:, e - first - 1, k]
                hit = np.flatnonzero(col)
                if len(hit):
                    now[hit] += sums[(e - k) % len(sums), hit] * prob[col[hit]]
            sums[e % len(sums)] = now
            if e % RESCALE == 0:
                sums /= now
                shift += np.log(now)
                now = sums[e % len(sums)]
            own = ending[done[e] : done[e + 1]]
            out[own] = np.log(now[own]) + shift[own]
    return out


def _prefix_logs(chars: np.ndarray, sizes: np.ndarray, table: PieceTable, prob: np.ndarray, ahead: bool) -> np.ndarray:
    """Log sums over the segmentations of each prefix (ahead) or of each suffix of words, in one language."""
    m, n = chars.shape
    logs = np.full((m, n + 1), -np.inf)
    logs[np.arange(m), 0 if ahead else sizes] = 0
    lp = np.log(prob, where=prob > 0, out=np.full(len(prob), -np.inf))
    for first in range(0, n, WIDTH) if ahead else reversed(range(0, n, WIDTH)):
        last = min(first + WIDTH, n)
        if ahead:
            ids = table.ids(chars, first, last)
            for e in range(first + 1, last + 1):
                for k in range(1, min(e, table.longest) + 1):
                    col = ids[:, e - first - 1, k]
                    hit = np.flatnonzero(col)
                    if len(hit):
                        logs[hit, e] = np.logaddexp(logs[hit, e], logs[hit, e - k] + lp[col[hit]])
            continue
        top = min(last + table.longest, n)
        ids = table.ids(chars, first, top)
        for s in range(last - 1, first - 1, -1):
            for k in range(1, min(n - s, table.longest) + 1):
                col = ids[:, s + k - first - 1, k]
                hit = np.flatnonzero(col)
                hit = hit[s + k <= sizes[hit]]
                if len(hit):
                    logs[hit, s] = np.logaddexp(logs[hit, s], lp[col[hit]] + logs[hit, s + k])
    return logs


def word_scores(words: list[str], table: PieceTable, prob: np.ndarray) -> np.ndarray:
    """Log probabilities of words, one column for each language."""
    out = np.empty((len(words), prob.shape[1]), np.float32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for own in batches(sizes):
        out[own] = forward(letters([words[i] for i in own.tolist()]), sizes[own], table, prob)
    return out


def expected_counts(words: list[str], weights: np.ndarray, table: PieceTable, prob: np.ndarray) -> np.ndarray:
    """Expected number of each piece in words of one language, by their weights."""
    total = np.zeros(table.unknown + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    lp = np.log(prob, where=prob > 0, out=np.full(len(prob), -np.inf))
    for own in batches(sizes):
        chars, size, weight = letters([words[i] for i in own.tolist()]), sizes[own], weights[own]
        before, after = (_prefix_logs(chars, size, table, prob, ahead) for ahead in (True, False))
        whole, n = before[np.arange(len(own)), size], chars.shape[1]
        for first in range(0, n, WIDTH):
            ids = table.ids(chars, first, min(first + WIDTH, n))
            row, end, k = np.nonzero(ids)
            piece, end = ids[row, end, k], end + first + 1
            inside = end <= size[row]
            row, end, k, piece = row[inside], end[inside], k[inside], piece[inside]
            part = np.exp(before[row, end - k] + lp[piece] + after[row, end] - whole[row]) * weight[row]
            total += np.bincount(piece, part, len(total))
    return total


def _together(frames, rows: int = 10_000):
    """The rows of short batches in longer ones, so that words are passed through in full batches."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def train(labelled: DataFrame, name: str = "piece_bpe_32k.model", rows: int = TRAIN_ROWS, rounds: int = EM_ROUNDS, most_langs: int = TRAIN_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from rows (doc_id, text, lang).

    The sample is bounded by `rows` rows of a language and by the `most_langs` languages
    with most rows (then the one that sorts first), so a label column full of stray values
    can't swell the model. Texts are counted into words and words into expected piece
    counts by Spark; only the table of vocabulary size times languages comes to the
    driver. Repeated rows count as often as they stand; words of all lengths count.
    """
    spark = labelled.sparkSession
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    most = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    sizes = {r.lang: r.n for r in most.collect()}  # at most most_langs rows
    langs = sorted(sizes)
    pieces = load_pieces(name)
    prob = np.full((len(pieces) + 2, max(1, len(langs))), 1.0 / (len(pieces) + 2))
    prob[0] = 0
    if not langs:
        return [], prob
    # an even draw by the hash of the id, nine tenths of the bound on average
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("double") / float(16**15)
    known = spark.createDataFrame([(c, i, 1.0 if sizes[c] <= rows else 0.9 * rows / sizes[c]) for i, c in enumerate(langs)], "lang string, i int, part double")
    sample = usable.join(F.broadcast(known), "lang").where(drawn < F.col("part"))
    words = sample.select(F.col("i").alias("lang"), F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = materialize(words, "langid-words")
    for _ in range(rounds):
        now = prob

        def count(frames, now=now):
            hold_memo("langid", _scorers.clear)
            own, total = load_table(name), {}
            for f in _together(frames):
                for lang, part in f[f.word.map(lambda w: bool(WORDS.fullmatch(w)))].groupby("lang"):
                    found = expected_counts(part.word.tolist(), part.n.to_numpy(float), own, now[:, lang])
                    total[lang] = total.get(lang, 0) + found
            for lang, found in total.items():
                piece = np.flatnonzero(found)
                yield pd.DataFrame({"lang": lang, "piece": piece, "n": found[piece]})

        found = words.mapInPandas(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        fresh = np.full_like(prob, SMOOTH)
        fresh[found.piece.to_numpy(), found.lang.to_numpy()] += found.n.to_numpy()
        fresh[0] = 0
        prob = fresh / fresh.sum(axis=0)
    return langs, prob


class _Scorer:
    """Word scores that a worker remembers, up to MEMO_CELLS of them."""

    def __init__(self, name: str, prob: np.ndarray):
        self.pieces_table, self.prob = load_table(name), prob
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((1 << 16, self.prob.shape[1]), np.float32)

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        start, end = len(self.index), len(self.index) + len(words)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[start:end] = word_scores(words, self.pieces_table, self.prob)
        self.index.update(zip(words, range(start, end)))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text for each language, and its number of words."""
        out, sizes = np.zeros((len(texts), self.prob.shape[1])), np.zeros(len(texts), np.int64)
        start = 0
        while start < len(texts):
            # so many texts at a time that their new words make a batch
            words, chars, end = [], 0, start
            while end < len(texts) and (chars < BATCH_TEXT or end == start):
                chars += len(texts[end])
                words.append(WORDS.findall(texts[end].lower()))
                end += 1
            if len(self.index) * self.prob.shape[1] > MEMO_CELLS:
                self.reset()
            self.learn(list({w for x in words for w in x}.difference(self.index)))
            get = self.index.__getitem__
            for i, x in enumerate(words, start):
                sizes[i] = len(x)
                if x:
                    out[i] = self.table[list(map(get, x))].sum(axis=0, dtype=np.float64)
            start = end
        return out, sizes


_scorers: dict[str, _Scorer] = {}


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], name: str = "piece_bpe_32k.model") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    Only the text is read. score is the posterior of the language, with even priors and
    the likelihood taken to the power 1 / sqrt(words), so that long texts differ in it.
    A text that is null, empty or without a letter, and every text if nothing was
    learned, gives und and 0. Ties go to the language that sorts first. Columns of these
    two names are replaced, others kept.
    """
    langs, prob = model
    key = f"{name}:{hash((tuple(langs), prob.tobytes()))}"
    sent = docs.sparkSession.sparkContext.broadcast((langs, prob))  # vocabulary size times languages
    kept = docs.drop("lang_pred", "score")

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, p = sent.value
        if not names:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
        hold_memo("langid", _scorers.clear)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = _Scorer(name, p)
        plain = [x or "" for x in texts]
        total, sizes = _scorers[key].totals(plain)
        z = total / np.sqrt(np.maximum(sizes, 1))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        known = (sizes > 0) & np.array([any(map(str.isalpha, x)) for x in plain], bool)  # words also hold signs like raised digits
        return pd.DataFrame({"lang_pred": np.where(known, np.array(names, object)[best], "und"), "score": np.where(known, z[np.arange(len(z)), best], 0.0)})

    # not deterministic for the optimizer, as it would move a filter on the result below and predict twice
    guess = guess.asNondeterministic()
    return kept.withColumn("_guess", guess(F.col("text").cast("string"))).select(*kept.columns, "_guess.lang_pred", "_guess.score")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and predict every row."""
    model = train(docs.where(~held_out()))
    return predict(docs, model)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
