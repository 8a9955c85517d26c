"""Problem 10: reading level by propagation over the document-word graph.

A document's running text is reduced to the set of its words (pairs of characters where a script has no spaces) and its
sentence lengths, hashed to 2^BITS nodes. Graded documents are clamped; every round sets a word to the mean of its
documents and a document to the mean of its words, words whose documents agree counting more. The vectors that travel
between rounds have 2^BITS entries whatever the size of the corpus; documents stay where they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .figures import line_kind

#: Rounds at most; they end when the grades of words change by less than STILL on average.
BITS, ROUNDS, STILL = 18, 20, 0.001
#: Words of fewer documents carry no grade.
LEAST_DOCS = 4
#: Documents with less running text get no level.
LEAST_CHARS = 200
_word = re.compile(r"[^\W\d_]+")
_wide = re.compile("[一-鿿぀-ヿ㐀-䶿]{2,}|[฀-๿]{3,}")
_ends = re.compile(r"[.!?](?=\s|$)|[。！？।]|\n\s*\n")
_lines = re.compile(r"\r\n|\r|\n")
_seen: dict[str, int] = {}


def _node(name: str) -> int:
    i = _seen.get(name)
    if i is None:
        if len(_seen) > 500_000:
            _seen.clear()
        i = _seen[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1
    return i


def running(text: str | None) -> str:
    """The lines of running text, line ends kept as such."""
    return "\n".join(x for x in _lines.split(text) if line_kind(x) in ("prose", "blank")).strip() if text else ""


def nodes(text: str) -> list[int]:
    """The nodes of a running text, each once, in order."""
    low = text.lower()
    names: set[str] = set()
    wide = _wide.findall(low)
    if sum(map(len, wide)) * 3 > len(low):
        for w in wide:
            k = 3 if "฀" <= w[0] <= "๿" else 2
            names.update(w[i : i + k] for i in range(len(w) - k + 1))
    else:
        names.update(_word.findall(low))
    sizes = [len(s.strip()) for s in _ends.split(text)]
    kind = "w" if wide else "s"
    names.update(f"\t{kind}{min(12, int(np.log2(n) * 2))}" for n in sizes if n > 4)
    return sorted({_node(n) for n in names})


def graph(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chars, nodes) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [running(t) for t in b.column(1).to_pylist()]
            got = [nodes(t) if len(t) >= LEAST_CHARS else [] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int32()), pa.array(got, pa.list_(pa.int32()))], names=[key, "chars", "nodes"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chars int, nodes array<int>")


def _score(flat: np.ndarray, sizes: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
    at = np.repeat(np.arange(len(sizes)), sizes)
    w = weight[flat]
    s = np.bincount(at, w, len(sizes))
    return np.where(s > 0, np.bincount(at, w * word[flat], len(sizes)) / np.maximum(s, 1e-12), np.nan)


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate(list(lists)).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)), sizes


def propagate(docs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Grade and weight of every word. docs: (nodes, label), label null where unknown. Without labels all grades are 0."""
    n = 1 << BITS
    sc = docs.sparkSession.sparkContext
    word, weight = np.zeros(n), np.zeros(n)
    # every task hands over up to 2^BITS sums a round, so a few tasks for every core are enough
    docs = docs.coalesce(4 * sc.defaultParallelism)
    for turn in range(rounds):
        sent = sc.broadcast((word, weight))

        def run(frames: Iterator[pd.DataFrame], sent=sent, turn=turn) -> Iterator[pd.DataFrame]:
            word, weight = sent.value
            sums = np.zeros((4, n))
            for f in frames:
                flat, sizes = _flat(f["nodes"])
                y = f["label"].to_numpy(float)
                known = ~np.isnan(y)
                if turn:
                    y = np.where(known, y, _score(flat, sizes, word, weight))
                use = ~np.isnan(y)
                # a graded document speaks for many that only inherit
                trust = np.where(known, 1.0, 0.02 if turn else 0.0) * use
                at = np.repeat(np.arange(len(sizes)), sizes)
                t, v = trust[at], np.nan_to_num(y)[at]
                sums += np.stack([np.bincount(flat, x, n) for x in (t, t * v, t * v * v, np.ones(len(flat)))])
            i = np.flatnonzero(sums[3])
            yield pd.DataFrame({"node": i, "t": sums[0][i], "s": sums[1][i], "q": sums[2][i], "n": sums[3][i]})

        parts = docs.select("nodes", "label").mapInPandas(run, "node int, t double, s double, q double, n double")
        total = parts.groupBy("node").agg(*(F.sum(c).alias(c) for c in "tsqn")).toPandas().sort_values("node")  # at most 2^BITS rows
        i, t = total.node.to_numpy(), total.t.to_numpy()
        if not (t > 0).any():
            continue
        middle = total.s.sum() / t.sum()
        prior = 0.5
        mean = (total.s.to_numpy() + prior * middle) / (t + prior)
        spread = np.maximum(0.0, (total.q.to_numpy() + prior * (middle**2 + 1.5)) / (t + prior) - mean**2)
        before = word
        word, weight = np.zeros(n), np.zeros(n)
        word[i] = mean
        weight[i] = np.where((total.n.to_numpy() >= LEAST_DOCS) & (t > 0), 1 / (0.15 + spread) ** 2, 0)
        sent.unpersist()
        if turn and np.average(np.abs(word - before), weights=np.maximum(weight, 1e-12)) < STILL:
            break
    return word, weight


def levels(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "reading_level") -> DataFrame:
    """(key, chars, grade, level): level 1 to 5, or 0 for texts with less than LEAST_CHARS characters of running text
    (also null and empty ones). grade is the propagated value without the document's clamp; the bounds between levels
    are those that best part the graded documents. Labels of 0 or null grade nothing; repeated labels count once (the
    greatest); repeated rows stay."""
    given = labels.where(F.col(label) > 0).groupBy(key).agg(F.max(label).cast("double").alias("label"))
    docs = durable(graph(df, key, text).join(given, key, "left"))
    long = docs.where(F.size("nodes") > 0)
    word, weight = propagate(long)
    sent = df.sparkSession.sparkContext.broadcast((word, weight))
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, weight = sent.value
        for f in frames:
            flat, sizes = _flat(f["nodes"])
            yield f[[key, "chars", "label"]].assign(grade=_score(flat, sizes, word, weight))

    graded = durable(docs.mapInPandas(run, f"`{key}` {kind}, chars int, label double, grade double"))
    # graded documents by level and hundredths of a grade: a table of bounded size
    seen = graded.where("label IS NOT NULL AND grade IS NOT NULL AND NOT isnan(grade)").groupBy(F.round(F.col("grade") * 100).cast("int").alias("g"), "label").count().toPandas()
    bounds = []
    for b in (2, 3, 4, 5):
        if seen.empty:
            bounds.append(b - 0.5)
            continue
        at = np.arange(seen.g.min(), seen.g.max() + 2)
        up = seen.label.to_numpy() >= b
        wrong = [(seen["count"][up & (seen.g < c)].sum() + seen["count"][~up & (seen.g >= c)].sum()) for c in at]
        best = at[np.flatnonzero(np.array(wrong) == min(wrong))]
        bounds.append((float(best.mean()) - 0.5) / 100)
    grade = F.col("grade")
    level = F.when(grade.isNull() | F.isnan(grade), 0).otherwise(1 + sum((grade >= b).cast("int") for b in bounds))
    return graded.select(key, "chars", "grade", F.when(F.col("chars") < LEAST_CHARS, 0).otherwise(level).cast("int").alias("level"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).where("level >= 4").select("doc_id").distinct()


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and grade of every document."""
    return _levels(spark, sf_dir)


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels}
SQL: dict[str, str] = {}
