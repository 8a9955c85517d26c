"""Problem 1: figures that describe a text, their distribution by language, and the kind of text.

One map over Arrow batches computes the figures; only they and the sketches (a few kB per language and statistic) move
on. Every line is rated by its form, and a record takes the kind that holds most of its characters. The percentiles and
robust z-scores of its statistics among the running text of its language say whether it lies in a tail that no running
text reaches; where it does, it is no prose, whatever the form says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, records, table
from .figures import KINDS, STATS, UNSPACED, figures, kind_sizes


def describe(df: DataFrame, words: dict[str, list[str]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text unless given) with n_chars, n_lines, n_words, lang, STATS and c_<kind>, the
    characters without white space in lines of each kind. Null texts count as empty, with null ratios. Columns of the
    input that are named like a figure must not be kept."""
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            if not texts:
                continue
            f = figures(texts, words)
            sizes = np.array([kind_sizes(t) for t in texts], np.int32)
            cols = [*(b.column(i) for i in range(len(keep))), *(pa.array(f[c]) for c in ("n_chars", "n_lines", "n_words")), pa.array(f["lang"].tolist(), pa.string())]
            cols += [pa.array(f[c], from_pandas=True) for c in STATS] + [pa.array(sizes[:, i]) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [*keep, "n_chars", "n_lines", "n_words", "lang", *STATS, *(f"c_{k}" for k in KINDS)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = [f"`{c}` {kinds[c]}" for c in keep] + ["n_chars int", "n_lines int", "n_words int", "lang string"] + [f"{c} double" for c in STATS] + [f"c_{k} int" for k in KINDS]
    return df.select(*(df[c] for c in keep), df[text].alias("_text")).mapInArrow(run, ", ".join(schema))


def sketches(stats: DataFrame, where: Column | None = None) -> DataFrame:
    """One row per language: n and a mergeable KLL sketch of every statistic (k_<statistic>); kll_merge_agg_double
    joins those of several loads. Rows with a null statistic are left out of that sketch."""
    rows = stats if where is None else stats.where(where)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(F.col(c).cast("double")).alias(f"k_{c}") for c in STATS))


STEPS = 40


def percentiles(stats: DataFrame, by_lang: DataFrame) -> DataFrame:
    """Adds p_<statistic>, the share of the language's reference records below the value in steps of 1/STEPS, and
    z_<statistic>, the robust z-score (median and quartile distance of the sketch). Null where the value is null or
    the language has no sketch."""
    ranks = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    cut = lambda c: F.when(F.col(f"k_{c}").isNotNull(), F.kll_sketch_get_quantile_double(F.col(f"k_{c}"), ranks)).alias(f"k_{c}")
    cuts = by_lang.where("lang IS NOT NULL").select("lang", *map(cut, STATS))  # one row per language of the fixed lists
    out = stats.join(F.broadcast(cuts), "lang", "left")
    new = {}
    for c in STATS:
        k, v = F.col(f"k_{c}"), F.col(c).cast("double")
        below = F.size(F.filter(k, _below(v)))
        new[f"p_{c}"] = F.when(v.isNotNull() & k.isNotNull(), below / (STEPS + 1))
        at = lambda i, k=k: F.element_at(k, i + 1)
        spread = F.greatest(F.lit(1e-3), (at(3 * STEPS // 4) - at(STEPS // 4)) / 1.349)
        new[f"z_{c}"] = F.when(v.isNotNull() & k.isNotNull(), (v - at(STEPS // 2)) / spread)
    return out.withColumns(new).drop(*(f"k_{c}" for c in STATS))


def _below(v: Column) -> Callable[[Column], Column]:
    return lambda x: x < v


#: Robust z-scores that running text doesn't reach, by statistic, and the kind that a record of no known form gets there.
#: Running text of every language stays under 11 in symbols and digits and under 7 in the length of words.
TAILS = {"symbol_ratio": (12.0, "list"), "digit_ratio": (12.0, "list"), "mean_word_len": (9.0, "junk"), "novowel_ratio": (40.0, "junk")}


def tail(stats: DataFrame) -> Column:
    """The statistic whose z-score lies farthest beyond its limit in TAILS, null where none does. Word lengths and words
    without vowels mean nothing in scripts without spaces."""
    spaced = ~F.col("lang").isin(*UNSPACED)
    over = {c: F.when(spaced | F.lit(c in ("symbol_ratio", "digit_ratio")), F.col(f"z_{c}") / limit) for c, (limit, _) in TAILS.items()}
    far = F.array_max(F.array(*(F.struct(F.when(z > 1, z).alias("z"), F.lit(c).alias("c")) for c, z in over.items())))
    return F.when(far["z"].isNotNull(), far["c"])


def classify(df: DataFrame, words: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The other columns with the figures, their percentiles and z-scores, tail (the statistic in which the record lies
    beyond all running text, if any) and text_kind (prose, list, table, junk; null for blank)."""
    s = durable(describe(df, words, text))  # figures only: what follows reads them twice
    prose = (F.col("c_prose") * 10 > 9 * (F.col("c_prose") + F.col("c_list") + F.col("c_table") + F.col("c_junk"))) & (F.col("line_end_ratio") > 0)
    s = percentiles(s, sketches(s, prose))
    most = F.greatest(*(F.col(f"c_{k}") for k in KINDS))
    # running text has frequent words or at least ends a sentence; a record in neither tail's reach is an inline list
    bare = F.coalesce(F.col("p_common_ratio") < 0.03, F.lit(True)) & (F.coalesce(F.col("line_end_ratio"), F.lit(0.0)) == 0)
    s = s.withColumn("tail", tail(s))
    far = reduce(lambda w, c: w.when(F.col("tail") == c, TAILS[c][1]), TAILS, F.when(F.lit(False), "prose"))
    form = F.when(F.col("n_chars") < 1, None).when((F.col("c_prose") == most) & F.col("tail").isNotNull(), far).when((F.col("c_prose") == most) & bare, "list").when(F.col("c_prose") == most, "prose")
    return s.withColumn("text_kind", reduce(lambda w, k: w.when(F.col(f"c_{k}") == most, k), KINDS[1:], form))


def function_words(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The fixed word lists (210 rows)."""
    out: dict[str, list[str]] = {}
    for r in table(spark, sf_dir, "function_words").where("lang IS NOT NULL AND word IS NOT NULL").distinct().orderBy("lang", "word").collect():
        out.setdefault(r.lang, []).append(r.word)
    return out


def p1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, percentiles and kind of every page and cell."""
    return classify(records(spark, sf_dir), function_words(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = classify(records(spark, sf_dir), function_words(spark, sf_dir))
    # an inline row of items in a cell is a list: tables are found on pages only
    s = s.withColumn("text_kind", F.when((F.col("record_kind") == "cell") & (F.col("text_kind") == "table"), "list").otherwise(F.col("text_kind")))
    long = F.when(F.col("record_kind") == "page", F.col("n_chars") >= 40).otherwise(F.col("n_chars") >= 80)
    fits = F.col("text_kind") != "prose"
    return s.where(long & fits).select("record_kind", "record_id", "text_kind").distinct()


QUERIES = {"p1_found": p1_found, "p1_stats": p1_stats}
SQL: dict[str, str] = {}
