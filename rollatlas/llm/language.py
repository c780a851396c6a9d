"""Language identification with error-correcting output codes (operator 1).

Every language gets a codeword of plus and minus ones (a row of a Hadamard matrix, so any two
differ in half of their bits). For each bit a binary classifier over byte trigrams tells the
languages with plus from those with minus. A text's bits are decoded to the codeword with the
least weighted logistic loss; bits that separate their two sides better weigh more. A text whose
two nearest codewords are almost as near is flagged as ambiguous.

Null text, or text without a letter, is ``und`` with score 0, as is every text when nothing
could be learned. Training takes at most ``train_rows`` rows for each language, those with the
smallest hash of doc_id; prediction reads every whole text, a very long one in pieces. The gap that
flags a text grows with its length, since a short one's margins vary more. Repeated rows get equal
results. An empty table gives an empty result. A column of the input that bears the name of a result is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rollatlas.llm import bytetext

UNKNOWN = "und"
TRAIN_ROWS = 3000
CODES = 1 << 15
#: How sharply losses become scores.
SHARPNESS = 6.0
#: Difference of the two least losses below which a text is ambiguous.
AMBIGUOUS_GAP = 0.12
#: Trigrams of a text for which the gap is half as wide.
AMBIGUOUS_TRIGRAMS = 60
RESULTS = "lang_pred string, score double, ambiguous boolean"
# Lower-case letters; every other ASCII byte counts as a space.
_FOLD = np.array([b | 0x20 if chr(b).isalpha() else b if b > 127 else 0x20 for b in range(256)], np.uint32)


@dataclass
class Model:
    languages: list[str]
    #: Bits by language, plus or minus one.
    code: np.ndarray
    #: Weight of each trigram code in each bit's classifier; the last code is a blank.
    weight: np.ndarray
    #: Middle and half distance of the two sides' mean margins.
    middle: np.ndarray
    half: np.ndarray


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each trigram of each text with a space around it, and where the texts begin.

    A text of ``n`` bytes has ``n`` codes, and two blanks after them.
    """
    rows = len(offsets) - 1
    wide = np.full(len(data) + 2 * rows + 2, 0x20, np.uint32)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    wide[np.arange(len(data)) + 2 * row + 1] = _FOLD[data]
    whole = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    codes = ((whole * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    codes[(wide[:-2] == 0x20) & (wide[1:-1] == 0x20)] = CODES
    begin = offsets + 2 * np.arange(rows + 1)
    codes[begin[1:] - 1] = CODES
    codes[begin[1:] - 2] = CODES
    return codes, begin


def codewords(n: int) -> np.ndarray:
    size = 8
    while size < n + 1:
        size *= 2
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    rows = matrix[1 : n + 1]
    return rows[:, (rows != rows[0]).any(axis=0)]


def training_rows(docs: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text) of at most ``train_rows`` allowed rows for each language.

    Rows are counted for each language and the first 16 bits of the hash; the counts, summed in
    order, tell up to which bits rows can be among the first. Only those are ranked, so neither a
    language's ids nor the texts of others are shuffled.
    """
    known = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "lang", "text", F.xxhash64("doc_id").alias("_hash")
    )
    bits = F.shiftright("_hash", 48)
    counts = known.groupBy("lang", bits.alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("lang").orderBy("_bits").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).filter(F.col("_before") < train_rows)
    # One row a language.
    last = F.broadcast(summed.groupBy("lang").agg(F.max("_bits").alias("_last")))
    early = known.join(last, "lang").filter(bits <= F.col("_last"))
    order = W.partitionBy("lang").orderBy("_hash", "doc_id")
    return early.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= train_rows).select("lang", "text")


def fit(rows: DataFrame) -> Model:
    """Learn from (lang, text): trigram counts of each language, then one classifier for each bit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, end, data, offsets in bytetext.steps(batch.column(1)):
                codes, begin = trigrams(data, offsets)
                for lang in set(langs[first:end]):
                    own = np.array([x == lang for x in langs[first:end]])
                    inside = np.repeat(own, np.diff(begin))
                    found = np.bincount(codes[: begin[-1]][inside], minlength=CODES + 1)
                    total[lang] = total.get(lang, 0) + found
        for lang, found in total.items():
            at = np.flatnonzero(found[:CODES])
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(at), pa.string()), "code": pa.array(at, pa.int32()), "n": pa.array(found[at], pa.int64())}
            )

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, code int, n long")
    # At most one row for each language and code.
    found = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    table = np.zeros((len(languages), CODES))
    at = {lang: i for i, lang in enumerate(languages)}
    table[[at[x] for x in names], found.column("code").to_numpy()] = found.column("n").to_numpy()
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * CODES) if languages else table
    code = codewords(len(languages)).T if len(languages) > 1 else np.zeros((0, len(languages)))
    weight = np.zeros((len(code), CODES + 1), np.float32)
    middle, half = np.zeros(len(code)), np.ones(len(code))
    for b, bits in enumerate(code):
        plus, minus = share[bits > 0].mean(axis=0), share[bits < 0].mean(axis=0)
        own = np.log(plus / minus)
        weight[b, :CODES] = own
        high, low = float(plus @ own), float(minus @ own)
        middle[b], half[b] = (high + low) / 2, max((high - low) / 2, 1e-9)
    return Model(languages, code, weight, middle, half)


def decode(model: Model, margins: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, score and ambiguity for bits-by-texts mean margins over ``count`` trigrams."""
    n = margins.shape[1]
    if len(model.languages) < 2:
        return np.zeros(n, np.int64), np.full(n, float(len(model.languages))), np.zeros(n, bool)
    z = (margins - model.middle[:, None]) / model.half[:, None]
    bit_weight = model.half / model.half.sum()
    loss = np.stack([bit_weight @ np.logaddexp(0, -2 * z * bits[:, None]) for bits in model.code.T])
    order = np.sort(loss, axis=0)
    best = loss.argmin(axis=0)
    score = 1 / np.exp(-SHARPNESS * (loss - order[0])).sum(axis=0)
    # A short text's margins vary more, so it takes a smaller gap to tell a mixture from chance.
    return best, score, order[1] - order[0] < AMBIGUOUS_GAP * count / (count + AMBIGUOUS_TRIGRAMS)


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bit's mean margin for each text, and the texts' numbers of trigrams.

    A text beyond ``bytetext.STEP_BYTES`` is read in pieces that overlap by two bytes, so that
    memory follows the piece: the sums are the same.
    """
    sums, count = np.zeros((len(model.code), len(offsets) - 1)), np.zeros(len(offsets) - 1)

    def add(rows: slice, data: np.ndarray, offsets: np.ndarray, ends: tuple[bool, bool]) -> None:
        codes, begin = trigrams(data, offsets)
        if not ends[0]:
            codes[0] = CODES
        if not ends[1]:
            codes[begin[-1] - 3] = CODES
        codes = codes[: begin[-1]]
        count[rows] += np.add.reduceat(codes < CODES, begin[:-1])
        for b in range(len(model.code)):
            run_sum = np.concatenate([[0.0], np.cumsum(model.weight[b][codes], dtype=np.float64)])
            sums[b, rows] += run_sum[begin[1:]] - run_sum[begin[:-1]]

    size = bytetext.STEP_BYTES
    if len(offsets) == 2 and len(data) > size:
        for at in range(0, len(data) - 2, size):
            piece = data[at : at + size + 2]
            add(slice(0, 1), piece, np.array([0, len(piece)]), (at == 0, at + size + 2 >= len(data)))
    else:
        add(slice(None), data, offsets, (True, True))
    return sums / np.maximum(count, 1), count


def identified(model: Model, text: Column) -> Column:
    """Struct of lang_pred, score and ambiguous for a text.

    Only the text goes to Python, once; other columns stay where they are.
    """
    names = model.languages

    @F.arrow_udf(f"struct<{RESULTS.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pa.Array) -> pa.Array:
        n = len(texts)
        best, score, vague = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        for first, end, data, offsets in bytetext.steps(texts):
            best[first:end], score[first:end], vague[first:end] = decode(model, *margins(model, data, offsets))
        langs = pa.DictionaryArray.from_arrays(best, pa.array(names, pa.string())).cast(pa.string()) if names else pa.nulls(n, pa.string())
        return pa.StructArray.from_arrays([langs, pa.array(score), pa.array(vague)], ["lang_pred", "score", "ambiguous"])

    # Told to vary, so that a filter on the result does not run it a second time.
    return run.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred, score and ambiguous."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    found = docs.withColumn("_found", identified(model, F.col(text_col)))
    told = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    return found.select(
        *keep,
        F.when(told, F.col("_found.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(told, F.col("_found.score")).otherwise(0.0).alias("score"),
        (told & F.col("_found.ambiguous")).alias("ambiguous"),
    )
