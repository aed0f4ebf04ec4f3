"""Operator 4: document quality by a sparse rule ensemble.

Statistics of each text; shallow random trees over them; every path of a tree
from its root is a rule, a conjunction of bounds; a logistic regression with
an L1 penalty weighs the rules, most of them with 0; the others are compiled
into one Spark column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.text import MARKS, byte_column, chunks, words

STATISTICS = ["n_words", "word_length", "upper", "symbols", "stops", "digits", "high", "distinct_words", "top_word", "distinct_lines", "line_words", "bars", "repeated_bigrams"]
#: Labelled rows that the trees and weights are fitted on, at most; chosen by a hash of the id.
FIT_ROWS = 200_000

_KIND = np.zeros((256, 6), np.float64)
_KIND[65:91, 0] = 1  # upper case
_KIND[[65 + i for i in range(26)] + [97 + i for i in range(26)], 1] = 1  # letters
_KIND[[b for b in range(33, 127) if MARKS[b] and chr(b) not in ".,;:'\"-()?"], 2] = 1  # symbols
_KIND[[ord(c) for c in ".,;:?!"], 3] = 1  # stops
_KIND[48:58, 4] = 1  # digits
_KIND[128:, 5] = 1  # other characters


def _row(data: np.ndarray, hashes: np.ndarray, lines: np.ndarray) -> list[float]:
    counts = np.bincount(data, minlength=256)
    upper, letters, symbols, stops, digits, high = counts @ _KIND
    n, size = len(hashes), max(1, len(data))
    _, each = np.unique(hashes, return_counts=True)
    pairs = hashes[1:] * np.uint64(3) ^ hashes[:-1]
    return [
        float(n),
        (size - counts[32]) / max(1, n),
        upper / max(1.0, letters),
        symbols / size,
        stops / max(1, n),
        digits / size,
        high / size,
        len(each) / max(1, n),
        each.max() / n if n else 0.0,
        len(np.unique(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        counts[ord("|")] / max(1, n),
        1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0,
    ]


_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def statistics(docs: DataFrame) -> DataFrame:
    """(id, STATISTICS) of (id, text), over whole texts; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            rows = []
            for a, b in chunks(offsets):
                hashes, at = words(data, offsets[a : b + 1])
                lines, line_at = words(data, offsets[a : b + 1], _NEWLINE)
                for i in range(b - a):
                    rows.append(_row(data[offsets[a + i] : offsets[a + i + 1]], hashes[at[i] : at[i + 1]], lines[line_at[i] : line_at[i + 1]]))
            columns = np.array(rows, np.float64).reshape(-1, len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in columns)], ["id", *STATISTICS])

    return docs.mapInArrow(run, "id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(text: str) -> set[Rule]:
    """The conjunctions along every path of the trees that text, a fitted forest's debug string, shows."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in text.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[3])], m[4], float(m[5])))]
            rules.add(tuple(sorted({p for _, p in path})))
    return rules


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, bound in rule:
        out &= (F.col(name) <= bound) if sign == "<=" else (F.col(name) > bound)
    return out


class RuleEnsemble:
    """Weights of rules; score() is their Spark expression."""

    def __init__(self, bias: float, weights: dict[Rule, float]):
        self.bias, self.weights = bias, weights

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in sorted(self.weights.items()):
            total += F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 1e-3, fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """Fit on rows (id, label 0/1, STATISTICS). Without both labels the score is the share of label 1, or 0.5."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = 0.5 if not n else min(max(ones / n, 1e-6), 1 - 1e-6)
        return RuleEnsemble(math.log(share / (1 - share)), {})
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    rows = rows.repartition(8, "id").coalesce(8).sortWithinPartitions("id", *STATISTICS)
    packed = VectorAssembler(inputCols=STATISTICS, outputCol="features", handleInvalid="keep").transform(rows).select("id", F.col("label").cast("double").alias("label"), "features", *STATISTICS)
    packed = packed.persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7, minInstancesPerNode=max(2, min(20, n // 50))).fit(packed)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        packed.unpersist()
        return RuleEnsemble(math.log(ones / (n - ones)), {})
    names = [f"r{i}" for i in range(len(rules))]
    marked = packed.select("label", *(condition(r).cast("double").alias(c) for r, c in zip(rules, names, strict=True)))
    marked = VectorAssembler(inputCols=names, outputCol="rules").transform(marked).select("label", "rules").persist()
    model = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(marked)
    marked.unpersist()
    packed.unpersist()
    weights = {r: float(w) for r, w in zip(rules, model.coefficients, strict=True) if w}
    return RuleEnsemble(float(model.intercept), weights)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    Labels of ids whose crc32 (of the decimal text) is divisible by 5 are held
    out. Only statistics of the text are inputs. A null or empty text has the
    statistics of no words and is scored by them. A null id is scored, never
    learned from and not held out. Labels that are null, or other than 0 and
    1, are left out; rows that repeat an id are scored each. Other columns
    play no part.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    stats = materialize(statistics(given), "statistics")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    model = fit(materialize(stats.where(~held).join(known, "id"), "labelled"), fit_rows=fit_rows)
    return stats.select(F.col("id").alias(id_col), held.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
