"""Problem 10: how much of a text only repeats what the same text has already said.

The measures are exact and taken over whole texts.  Texts are rejected by a score: five words for each start of an
earlier run of five, a bound of the share of repeated words that counts overlaps twice.  Its cutoffs are
risk-controlled.  On a holdout with labels, which do not come from the score, every stratum's cutoff is lowered from
the strictest while an exact binomial test still shows that at most `risk` of its clean texts are rejected; the tests
of a stratum stop at the first failure, and the level is divided by the number of strata.  What the cutoffs do on the
other texts is measured and reported.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .arrow import batch_of, words

#: The cutoffs of the score that are tried, strictest first.
CUTOFFS = [1.0 - 0.01 * k for k in range(100)]

_SENTENCE = re.compile(r"[^.!?\n]+")
_SHARES = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), ("n_words", pa.int64()), ("words_repeated", pa.int64()), ("starts_repeated", pa.int64()), ("sentence_share", pa.float64()), ("paragraph_share", pa.float64())])


def repeated_words(tokens: list[str], width: int = 5) -> tuple[int, int]:
    """How many words lie in a run of width words that already started earlier in the text, and how many such runs there are."""
    n = len(tokens)
    if n <= width:
        return 0, 0
    seen: set = set()
    count = upto = again = 0
    for i in range(n - width + 1):
        run = tuple(tokens[i : i + width])
        if run in seen:
            count += i + width - max(upto, i)
            upto = i + width
            again += 1
        else:
            seen.add(run)
    return count, again


def repeated_share(pieces: list[str]) -> float:
    """The share of characters in pieces that equal an earlier piece, case and space apart."""
    seen: set = set()
    total = again = 0
    for piece in pieces:
        key = " ".join(piece.lower().split())
        if key:
            total += len(key)
            if key in seen:
                again += len(key)
            else:
                seen.add(key)
    return again / total if total else 0.0


def _measured(width: int):
    def run(batches):
        for batch in batches:
            ids, strata, texts = batch.columns
            for lo in range(0, len(ids), 1000):
                part = texts.slice(lo, 1000).to_pylist()
                tokens = [words(t) for t in part]
                repeated = [repeated_words(t, width) for t in tokens]
                yield batch_of(
                    _SHARES,
                    doc_id=ids.slice(lo, 1000),
                    stratum=strata.slice(lo, 1000),
                    n_words=[len(t) for t in tokens],
                    words_repeated=[r[0] for r in repeated],
                    starts_repeated=[r[1] for r in repeated],
                    sentence_share=[repeated_share(_SENTENCE.findall(t or "")) for t in part],
                    paragraph_share=[repeated_share((t or "").split("\n")) for t in part],
                )

    return run


def repetition_measures(documents: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, stratum, n_words, words_repeated, starts_repeated, sentence_share, paragraph_share, word_share, score) of every row.

    stratum is the source in lower case, '' where it is null.  Null, empty and wordless texts have shares of 0.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("stratum"), F.col("text").cast("string").alias("text"))
    measured = rows.mapInArrow(_measured(width), "doc_id long, stratum string, n_words long, words_repeated long, starts_repeated long, sentence_share double, paragraph_share double")
    share = lambda part: F.coalesce(F.try_divide(part.cast("double"), F.col("n_words")), F.lit(0.0))
    return measured.select("*", share(F.col("words_repeated")).alias("word_share"), F.least(F.lit(1.0), share(F.col("starts_repeated") * width)).alias("score"))


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial X, summed exactly."""
    if k >= n:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(0.0, top + math.log(math.fsum(math.exp(t - top) for t in terms)))


def certified(clean: int, rejected: list[int], risk: float, level: float) -> tuple[float, bool]:
    """The lowest cutoff of the sequence that passes; rejected[i]: clean texts at or above CUTOFFS[i]."""
    best, sure = CUTOFFS[0], False
    for cutoff, k in zip(CUTOFFS, rejected):
        if clean == 0 or log_binomial_cdf(k, clean, risk) > math.log(level):
            break
        best, sure = cutoff, True
    return best, sure


def _cut(risk: float, level: float):
    schema = pa.schema([("stratum", pa.string()), ("clean", pa.int64()), ("cutoff", pa.float64()), ("certified", pa.bool_())])

    def run(batches):
        for batch in batches:
            found = [certified(clean, rejected, risk, level / strata) for clean, rejected, strata in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield batch_of(schema, stratum=batch.column(0), clean=batch.column(1), cutoff=[f[0] for f in found], certified=[f[1] for f in found])

    return run


def controlled_cutoffs(labelled: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """(stratum, clean, cutoff, certified) from rows (stratum, score, clean) of a holdout.

    A stratum without enough clean texts keeps the first cutoff, which is not certified.  Holds one row of counts per
    stratum; nothing of a stratum is gathered.
    """
    counts = labelled.groupBy("stratum").agg(
        F.count_if("clean").alias("n"), F.array(*[F.count_if(F.col("clean") & (F.col("score") >= c)) for c in CUTOFFS]).alias("rejected")
    )
    strata = counts.agg(F.count("*").alias("strata"))
    return counts.join(F.broadcast(strata)).mapInArrow(_cut(risk, level), "stratum string, clean long, cutoff double, certified boolean")


def _held(holdout: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(holdout)) == 0


def judged(rows: DataFrame, labels: DataFrame | None = None, risk: float = 0.02, level: float = 0.05, holdout: int = 4) -> tuple[DataFrame, DataFrame]:
    """The measured rows with label, cutoff and rejection, and a report per stratum.

    labels: (doc_id, clean) with one row per doc_id, by hand or by another measure; the statement (clean: less than a quarter of the words repeated) if none.  Rows
    without a label are judged, too.  The cutoffs are set on the holdout, one row in `holdout` by a hash of doc_id; the
    report says how many clean ones of the other rows they reject.
    """
    marked = rows.withColumn("clean", 4 * F.col("words_repeated") < F.greatest("n_words", F.lit(1))) if labels is None else rows.join(labels.select("doc_id", "clean"), "doc_id", "left")
    cutoffs = controlled_cutoffs(marked.where(_held(holdout) & F.col("clean").isNotNull()).select("stratum", "score", "clean"), risk, level).select("stratum", "cutoff", "certified")
    found = marked.join(F.broadcast(cutoffs), "stratum", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(CUTOFFS[0])))  # a row per stratum
    found = found.withColumn("rejected", F.col("score") >= F.col("cutoff"))
    other = ~F.coalesce(_held(holdout), F.lit(False)) & F.col("clean")
    report = found.groupBy("stratum").agg(
        F.first("cutoff").alias("cutoff"), F.coalesce(F.first("certified"), F.lit(False)).alias("certified"), F.count("*").alias("texts"),
        F.count_if("rejected").alias("rejected"), F.count_if(other).alias("clean_judged"), F.count_if(other & F.col("rejected")).alias("clean_rejected"),
    )
    return found, report


def repetition(documents: DataFrame, risk: float = 0.02, level: float = 0.05, holdout: int = 4) -> DataFrame:
    """The measures of every row, with the score's cutoff in its stratum, and whether that rejects the row."""
    found, _ = judged(stage(repetition_measures(documents), "repetition"), None, risk, level, holdout)
    return found.select("doc_id", "stratum", "n_words", "words_repeated", "word_share", "sentence_share", "paragraph_share", "score", "cutoff", "rejected")


def rejection_report(documents: DataFrame) -> DataFrame:
    """Per stratum: cutoff, whether it is certified, texts and rejected ones, and clean texts outside the holdout and how many of them are rejected."""
    return judged(stage(repetition_measures(documents), "repetition"))[1]


def repetitive_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the texts a quarter or more of whose words is repeated.

    Rejected texts and those that the cutoff leaves in doubt, whose score is a quarter at least and so bounds a share
    that may be, are checked exactly; a text below that is clean whatever its cutoff.
    """
    return repetition(documents).where("(rejected or score >= 0.25) and n_words > 0 and 4 * words_repeated >= n_words").select("doc_id")
