"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model predicts characters from the ORDER - 1 before, one model for each language.
Counts of trusted n-grams, continuation counts, context totals and discounts are tables,
built by grouped sums and spread over the cluster by (language, n-gram). Documents are
dealt into blocks; a block asks once for each distinct n-gram that it holds, the
requests are joined with the count tables order by order, and the answers go back to
the block, which sums them to a perplexity for each document and for its worst stretch.
A document is kept if neither is above its bar. The bars are quantiles over trusted
documents of its language that the model has not seen; the one of whole documents is wider
for short texts, whose perplexity spreads more.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import materialize, read_table, shuffle_parts

ORDER = 4
#: Of so many trusted documents one is held out for the thresholds; the model counts all others.
HELD_OUT = 4
#: Ids of trusted documents that are broadcast; where there are more, they and the texts are shuffled.
BROADCAST_IDS = 4_000_000
QUANTILE = 0.98
#: A text of so many characters may exceed the usual log perplexity by 2**0.5 times what a long one may.
SPREAD_CHARS = 200
#: Characters of a stretch. Shorter texts are judged as a whole only.
STRETCH = 200
#: Log perplexities that set bars are told apart by 1 / STEPS.
STEPS = 10_000
#: Characters of the documents of a block, on average.
BLOCK_CHARS = 8 << 20
#: Stands for a null language, which is none of the others.
NO_LANG = "\x00"
PIECE_CHARS = 1 << 20
START = "\x02"
_SPACES, _DIGITS = re.compile(r"\s+"), re.compile(r"\d")


def normalised(text: str) -> str:
    """White space as one space, digits as 0, with start marks before the first character."""
    return START * (ORDER - 1) + _DIGITS.sub("0", _SPACES.sub(" ", text.replace(START, " ")).strip())


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Normalised texts, compressed: they are shuffled once as they are."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return texts.map(lambda x: pack(normalised(x).encode("utf-8", "surrogatepass")))


def unpacked(column) -> list[str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x).decode("utf-8", "surrogatepass") for x in column]


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the n-gram that ends at each character, text of it, alphabet) of normalised texts.

    The alphabet holds single characters, or pairs of them where they are very many.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, ids = np.unique(points, return_inverse=True)
    n, step = len(ids), 1
    if len(alphabet) > 1 << 16:
        alphabet, ids = np.unique((points[:-1].astype(np.uint64) << np.uint64(32)) | points[1:], return_inverse=True)
        step = 2
    code = np.zeros(n - ORDER + 1, np.uint64)
    for k in range(0, ORDER, step):
        code = (code << np.uint64(16 * step)) | ids[k : n - ORDER + 1 + k].astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(texts)), sizes - (ORDER - 1))
    inside = np.repeat(ends - sizes, sizes - (ORDER - 1)) + np.arange(len(own)) - np.repeat(np.cumsum(sizes - (ORDER - 1)) - (sizes - (ORDER - 1)), sizes - (ORDER - 1))
    return code[inside], own, alphabet


def pieces(texts: list[str]):
    """(first, end) of stretches of texts of about PIECE_CHARS characters, which bounds the arrays of a step."""
    first, size = 0, 0
    for i, x in enumerate(texts, 1):
        size += len(x)
        if size >= PIECE_CHARS or i == len(texts):
            yield first, i
            first, size = i, 0


def gram_strings(codes: np.ndarray, alphabet: np.ndarray) -> list[str]:
    step = 2 if alphabet.dtype == np.uint64 else 1
    chars = [chr(c >> 32) + chr(c & 0xFFFFFFFF) for c in alphabet.tolist()] if step == 2 else [chr(c) for c in alphabet.tolist()]
    shifts = [np.uint64(16 * k) for k in range(ORDER - step, -1, -step)]
    return list(map("".join, zip(*([chars[i] for i in ((codes >> s) & np.uint64((1 << 16 * step) - 1)).tolist()] for s in shifts), strict=True)))


def _trusted_counts(frames):
    for f in frames:
        for lang, part in f.groupby("lang"):
            texts = [x for x in map(normalised, part.text) if len(x) >= ORDER]
            for a, b in pieces(texts):
                codes, _, alphabet = gram_codes(texts[a:b])
                codes, n = np.unique(codes, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram_strings(codes, alphabet), "c": n})


def _requests(f: pd.DataFrame) -> pd.DataFrame:
    """The distinct n-grams of a block for each language."""
    out = []
    for lang, part in f.groupby("lang"):
        texts = [x for x in unpacked(part.text) if len(x) >= ORDER]
        grams: set[str] = set()
        for a, b in pieces(texts):
            codes, _, alphabet = gram_codes(texts[a:b])
            grams.update(gram_strings(np.unique(codes), alphabet))
        if grams:
            out.append(pd.DataFrame({"lang": lang, "gram": sorted(grams)}))
    got = pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "gram": pd.Series(dtype=str)})
    return got.assign(block=int(f.block.iloc[0]))


def worst_stretches(costs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The highest mean cost of STRETCH characters in a row of each text; NaN for shorter texts.

    own numbers the text of each character from 0 on, without gaps and in order.
    """
    means = np.full(len(costs), -np.inf)
    if len(costs) >= STRETCH:
        sums = np.concatenate([[0.0], np.cumsum(costs)])
        inside = own[STRETCH - 1 :] == own[: len(own) - STRETCH + 1]
        means[: len(inside)] = np.where(inside, (sums[STRETCH:] - sums[:-STRETCH]) / STRETCH, -np.inf)
    worst = np.maximum.reduceat(means, np.flatnonzero(np.diff(own, prepend=-1)))
    return np.where(np.isinf(worst), np.nan, worst)


def _scores(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Number of characters, sum of log probabilities and worst stretch of each document of a block."""
    n, total, worst = np.zeros(len(docs), np.int64), np.zeros(len(docs)), np.full(len(docs), np.nan)
    known = {lang: dict(zip(a.gram, a.lp, strict=True)) for lang, a in answers.groupby("lang")}
    docs = docs.reset_index(drop=True)
    for lang, part in docs.groupby("lang"):
        texts = unpacked(part.text)
        n[part.index] = [len(x) - (ORDER - 1) for x in texts]
        use = [i for i, x in enumerate(texts) if len(x) >= ORDER]
        if not use or lang not in known:
            total[part.index] = np.nan
            continue
        rows, texts = part.index.to_numpy()[use], [texts[i] for i in use]
        for a, b in pieces(texts):
            codes, own, alphabet = gram_codes(texts[a:b])
            kinds, which = np.unique(codes, return_inverse=True)
            lp = np.array([known[lang][g] for g in gram_strings(kinds, alphabet)])
            total[rows[a:b]] = np.bincount(own, weights=lp[which], minlength=b - a)
            worst[rows[a:b]] = worst_stretches(-lp[which], own)
    return pd.DataFrame({"doc_id": docs.doc_id, "lang": docs.lang, "n": n, "total": total, "worst": worst})


def _discounts(counts: DataFrame) -> DataFrame:
    """D1, D2, D3 of a language from its counts of counts."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in range(1, 5)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [F.lit(k) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    usual = (0.5, 1.0, 1.5)
    safe = [F.coalesce(F.when((x > 0) & (x < k), x), F.lit(usual[k - 1])).alias(f"d{k}") for k, x in enumerate(d, 1)]
    return counts.groupBy("lang").agg(*n).select("lang", *safe)


def _order_tables(counts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, kept count) and (lang, context, total, left-over mass) of an order."""
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    counts = counts.join(_discounts(counts), "lang").withColumn("cut", cut)  # a row for each language
    grams = counts.select(F.col("lang").alias(f"l{k}"), F.col("gram").alias(f"g{k}"), (F.col("c") - F.col("cut")).alias(f"c{k}"))
    contexts = counts.groupBy("lang", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("c").alias("t"), F.sum("cut").alias("m"))
    return grams, contexts.select(F.col("lang").alias(f"lx{k}"), F.col("context").alias(f"x{k}"), F.col("t").alias(f"t{k}"), F.col("m").alias(f"m{k}"))


def fit(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Count tables of the orders 1 to ORDER from trusted (lang, text)."""
    top = trusted.where("text is not null").mapInPandas(_trusted_counts, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    counts = [materialize(top, "grams")]
    for k in range(ORDER - 1, 0, -1):  # in how many ways an n-gram is continued to the left
        counts.append(counts[-1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    return [_order_tables(c, k) for k, c in enumerate(reversed(counts), 1)]


def gram_scores(requests: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """requests (lang, gram) with lp, the log probability of the last character after the others.

    Requests of languages without trusted text have no row.
    """
    out = requests
    for k, (grams, contexts) in enumerate(model, 1):
        tail = F.substring("gram", ORDER - k + 1, k)
        out = out.join(grams, (F.col("lang") == F.col(f"l{k}")) & (tail == F.col(f"g{k}")), "left").drop(f"l{k}", f"g{k}")
        context = F.substring("gram", ORDER - k + 1, k - 1)
        out = out.join(contexts, (F.col("lang") == F.col(f"lx{k}")) & (context == F.col(f"x{k}")), "inner" if k == 1 else "left").drop(f"lx{k}", f"x{k}")
        # below single characters lie all code points, evenly
        lower = F.lit(1.0 / 0x110000) if k == 1 else F.col("p")
        p = (F.coalesce(F.col(f"c{k}"), F.lit(0.0)) + F.col(f"m{k}") * lower) / F.col(f"t{k}")
        out = out.withColumn("p", F.coalesce(p, lower)).drop(f"c{k}", f"t{k}", f"m{k}")
    return out.select("lang", "gram", F.log("p").alias("lp"))


def perplexities(docs: DataFrame, trusted: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, lang, n, perplexity, worst) of docs (doc_id, lang, text) under a model of trusted (lang, text).

    worst is the perplexity of the worst stretch, null for texts shorter than one. Blocks
    are dealt so that they hold block_chars on average; a longer text fills its block.
    """
    n = docs.agg(F.sum(F.length("text") + F.lit(1))).first()[0] or 0
    blocks = max(1, math.ceil(n / block_chars))
    data = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    data = data.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).withColumn("text", packed("text")).repartition(max(blocks, shuffle_parts(docs.sparkSession)), "block")
    requests = data.groupBy("block").applyInPandas(_requests, "lang string, gram string, block int")
    # both uses below read one exchange of all three columns, so blocks are counted once
    requests = requests.repartition(shuffle_parts(docs.sparkSession), "lang", "gram")
    distinct = requests.groupBy("lang", "gram").agg(F.min("block").alias("least")).where("least >= 0").select("lang", "gram")
    answers = gram_scores(distinct, fit(trusted))
    asked = requests.select(F.col("lang").alias("lang2"), F.col("gram").alias("gram2"), "block")
    sent = asked.join(answers, (F.col("lang2") == F.col("lang")) & (F.col("gram2") == F.col("gram"))).select("block", "lang", "gram", "lp")
    found = data.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(_scores, "doc_id string, lang string, n long, total double, worst double")
    ppl = F.when((F.col("n") > 0) & ~F.isnan("total"), F.exp(-F.col("total") / F.col("n")))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "n", ppl.alias("perplexity"), F.when(~F.isnan("worst"), F.exp("worst")).alias("worst"))


def _bars(held: DataFrame, quantile: float) -> DataFrame:
    """For each language of held (lang, n, perplexity, worst): its usual log perplexity, and the bars of the excess and of worst.

    Values are rounded up to 1 / STEPS, so a group holds few distinct ones however
    many rows there are. A bar is the value of a row, not one between two.
    """
    logs = held.where("perplexity is not null").select(F.col("lang").alias("lang2"), "n", *(F.ceil(F.log(c) * STEPS).alias(c) for c in ("perplexity", "worst")))
    usual = logs.groupBy("lang2").agg((F.percentile("perplexity", F.lit(0.5)) / STEPS).alias("usual"))
    excess = F.ceil((F.col("perplexity") - F.col("usual") * STEPS) / _spread())
    bars = logs.join(F.broadcast(usual), "lang2").withColumn("excess", excess)  # a row for each language
    at = "percentile_disc({}) WITHIN GROUP (ORDER BY {}) / {}"
    return bars.groupBy("lang2").agg(F.first("usual").alias("usual"), *(F.expr(at.format(quantile, c, STEPS)).alias(f"{c}_bar") for c in ("excess", "worst")))


def _spread():
    return F.sqrt(1 + SPREAD_CHARS / F.col("n"))


def classify(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, worst, worst_threshold and keep for each row of docs.

    threshold is the bar of the perplexity at the length of the document, worst_threshold
    the one of the worst stretch.

    Trusted are documents labelled quality 1 and not toxic. The model counts all of them
    but one in HELD_OUT, by the hash of its id; the bars are taken over every trusted
    document that the model has not counted. trusted_rows, which the query leaves out,
    bounds the ones that are counted to about three quarters of so many, drawn evenly.
    A text that is null or blank has no perplexity and is not kept; a document whose
    language has no trusted text has none either, and is kept. A null language is a
    language of its own. Repeated rows are judged each by itself.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    held = F.crc32(F.col("good_id").cast("string")) % HELD_OUT == 0
    if trusted_rows is not None and (n := good.count()) > trusted_rows:
        draw = F.conv(F.substring(F.md5(F.col("good_id").cast("string")), 1, 15), 16, 10).cast("double") / float(16**15)
        held = held | (draw >= F.lit(0.97 * trusted_rows / n))
    good = materialize(good.withColumn("held", held), "trusted")
    counted = good.where("not held")
    counted = F.broadcast(counted) if counted.count() <= BROADCAST_IDS else counted.hint("merge")
    trusted = docs.join(counted, F.col("doc_id") == F.col("good_id")).select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    scored = materialize(perplexities(docs.select("doc_id", "lang", "text"), trusted), "perplexities")
    bars = _bars(scored.join(good.where("held").hint("merge"), F.col("doc_id") == F.col("good_id")), quantile)  # a row for each language
    out = scored.join(F.broadcast(bars), F.col("lang") == F.col("lang2"), "left")
    out = out.withColumn("threshold", F.when(F.col("n") > 0, F.exp(F.col("usual") + F.col("excess_bar") * _spread()))).withColumn("worst_threshold", F.exp("worst_bar"))
    fits = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("worst") <= F.col("worst_threshold"), F.lit(True))
    return out.select("doc_id", F.nullif("lang", F.lit(NO_LANG)).alias("lang"), F.col("n").alias("n_chars"), "perplexity", "threshold", "worst", "worst_threshold", (fits & (F.col("n") > 0)).alias("keep"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
