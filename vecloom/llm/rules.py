"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are columns. Shallow trees are fitted to labelled rows, every path from a root to a node is a conjunctive rule
over the statistics, and a lasso logistic regression on the rules' truth keeps few of them. What is left is one Spark expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.text import Words, binary, blocks, extended
from vecloom.session import snapshot

#: Bound on the labelled rows that a model is fitted to: those with the least seeded hash of their id.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO, SEED, THRESHOLD = 16, 3, 0.002, 42, 0.7

#: Bytes counted for each text, and what the count is divided by.
CLASSES = {
    "bang": (b"!", "words"), "pipe": (b"|", "words"), "symbol": (b"#$%&*@^~=+<>\\{}[]_`", "words"), "digit": (b"0123456789", "bytes"),
    "stop": (b".?", "words"), "comma": (b",;:", "words"), "line": (b"\n", "words"), "upper": (bytes(range(65, 91)), "letters"),
    "beyond": (bytes(range(128, 256)), "bytes"),
}
STATS = ["words", "word_bytes", "long_words", "same_as_before", "distinct", "commonest", *CLASSES]


def text_stats(texts: list[bytes]) -> np.ndarray:
    """A row of ``STATS`` for each text: the logarithm of the words, bytes a word, and shares. An empty text has zeros."""
    out = np.zeros((len(texts), len(STATS)))
    words = Words(texts)
    counts, owner = words.counts(), words.owner()
    per_word, lengths = np.maximum(counts, 1), words.ends - words.starts
    out[:, 0] = np.log1p(counts)
    out[:, 1] = np.bincount(owner, lengths, len(texts)) / per_word
    out[:, 2] = np.bincount(owner, lengths > 14, len(texts)) / per_word
    if len(words):
        h = words.hashes()
        again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        out[:, 3] = np.bincount(owner[1:], again, len(texts)) / per_word
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        begins = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
        times, of = np.diff(np.append(begins, len(h))), owner[begins]
        out[:, 4] = np.bincount(of, minlength=len(texts)) / per_word
        np.maximum.at(out[:, 5], of, times)
        out[:, 5] /= per_word
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    lo = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    hi = lo + np.array([len(t) for t in texts], np.int64)
    found = {}
    for name, members in {**{k: v[0] for k, v in CLASSES.items()}, "lower": bytes(range(97, 123))}.items():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        total = np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64)))
        found[name] = total[hi] - total[lo]
    whole = {"words": per_word, "bytes": np.maximum(hi - lo, 1), "letters": np.maximum(found["upper"] + found["lower"], 1)}
    for j, (name, (_, by)) in enumerate(CLASSES.items(), len(STATS) - len(CLASSES)):
        out[:, j] = found[name] / whole[by]
    return out


def stat_column(name: str) -> str:
    return f"_stat_{name}"


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column for each statistic of the whole text; null texts are empty."""
    at, schema = docs.columns.index(text), extended(docs.schema, **{stat_column(s): "double" for s in STATS})

    def run(batches):
        for batch in batches:
            found = [text_stats(b) for b in blocks(binary(batch.column(at)), 2 << 20)]
            stats = np.concatenate(found) if found else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[:, j]) for j in range(len(STATS)))], names=schema.names)

    return docs.mapInArrow(run, schema)


#: A condition: (statistic's place, "<=" or ">", bound). A rule: conditions that must all hold.
Rule = tuple[tuple[int, str, float], ...]


def tree_rules(debug: str) -> list[Rule]:
    """The path to every node but the root, from a tree's printed form; of several bounds one way on a statistic the tightest."""
    rules, path = [], []
    for line in debug.splitlines():
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[3]), m[4], float(m[5])))]
            tight: dict[tuple[int, str], float] = {}
            for _, (j, way, bound) in path:
                held = tight.get((j, way), bound)
                tight[j, way] = min(held, bound) if way == "<=" else max(held, bound)
            rules.append(tuple(sorted((j, way, bound) for (j, way), bound in tight.items())))
    return rules


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for j, way, bound in rule:
        c = F.col(stat_column(STATS[j]))
        out = out & (c <= F.lit(bound) if way == "<=" else c > F.lit(bound))
    return out.cast("double")


@dataclass
class RuleModel:
    intercept: float
    weights: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Chance of label 1, over the statistics' columns."""
        z = F.lit(self.intercept)
        for rule, weight in self.weights:
            z = z + rule_column(rule) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, label_id: str, bound: int, seed: int) -> DataFrame:
    """Statistics and label (``y``) of at most ``bound`` documents ids; of an id's labels the least counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("_id")).agg(F.min(label).cast("double").alias("y"))
    known = snapshot(known.orderBy(F.xxhash64(F.col("_id"), F.lit(seed)), "_id").limit(bound), "labelled")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    # At most ``bound`` ids and numbers.
    rows = rows.join(F.broadcast(known), "_id")
    return snapshot(with_stats(rows).drop("text").repartition(4, "_id").sortWithinPartitions("_id", *map(stat_column, STATS)), "training")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id", bound: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> RuleModel:
    """Fit to the labels given (hold rows out before). Labels other than 0 and 1 and null ids are left out.

    Without labelled documents every text scores 0.5, with one class only its label.
    """
    rows = training_rows(docs, labels, doc_id, text, label, label_id, bound, seed)
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or ones in (0, n):
        return RuleModel(0.0 if not n else 10.0 if ones else -10.0)
    stats = rows.select("y", array_to_vector(F.array(*[F.col(stat_column(s)) for s in STATS])).alias("x"))
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(stats)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)})
    if not rules:
        return RuleModel(float(np.log(ones / (n - ones))))
    truth = rows.select("y", array_to_vector(F.array(*map(rule_column, rules))).alias("x"))
    fitted = LogisticRegression(labelCol="y", featuresCol="x", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(truth)
    return RuleModel(float(fitted.intercept), [(r, float(w)) for r, w in zip(rules, fitted.coefficients) if w])


def scored(docs: DataFrame, model: RuleModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    return with_stats(docs, text).withColumn(score, model.score()).drop(*map(stat_column, STATS))


def keep_quality(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts that score below ``threshold``; columns unchanged."""
    return with_stats(docs, text).where(model.score() >= threshold).select(*docs.columns)
